"""Small cases with known answers: renumbering, boundaries, capacity, places, alignment, versions, neighbours, gaps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leafmark.operators import boundaries, neighbours, planning, review, schemes, transfers, trees
from leafmark.operators import numbering as N
from leafmark.streaming import feeds

PAGES = "collection_id long, page_number int, start_chapter long, start_verse long"
LINES = "collection_id long, page_number int, line_number int, type string, chapter long"
SEGMENTS = "collection_id long, page_number int, line_number int, segment_order int, closes boolean, verse long"


def renumbered(spark, pages, lines, segments, start):
    p, l, s = (spark.createDataFrame(r, schema) for r, schema in ((pages, PAGES), (lines, LINES), (segments, SEGMENTS)))
    rows = transfers.renumbered_from(p, l, s, spark.createDataFrame([(1, start)], "collection_id long, from_page int")).collect()
    return sorted(((r.page_number, r.line_number, r.segment_order or 0, r.chapter, r.verse) for r in rows), key=str)


def two(page, chapter, a, b):
    return [(1, page, 1, "text", chapter)], [(1, page, 1, 1, True, a), (1, page, 1, 2, True, b)]


def joined(*parts):
    return [x for l, _ in parts for x in l], [x for _, s in parts for x in s]


def test_renumbering_starts_at_the_settings_and_goes_on(spark):
    lines, segments = joined(two(1, None, 99, 99), two(2, None, 99, 99))
    got = renumbered(spark, [(1, 1, 2, 1), (1, 2, 2, 1)], lines, segments, 1)
    assert got == sorted([(1, 1, 0, 2, None), (1, 1, 1, 2, 1), (1, 1, 2, 2, 2), (2, 1, 0, 2, None), (2, 1, 1, 2, 3), (2, 1, 2, 2, 4)], key=str)


def test_a_header_begins_the_next_chapter(spark):
    lines, segments = joined(two(1, 2, 1, 2))
    lines += [(1, 2, 1, "header", 99), (1, 2, 2, "text", 99)]
    segments += [(1, 2, 2, 1, True, 99)]
    # page 1 is right, so a walk from it stops at once; one from page 2 doesn't
    assert renumbered(spark, [(1, 1, 2, 1), (1, 2, 2, 1)], lines, segments, 1) == []
    assert renumbered(spark, [(1, 1, 2, 1), (1, 2, 2, 1)], lines, segments, 2) == sorted([(2, 1, 0, 3, None), (2, 2, 0, 3, None), (2, 2, 1, 3, 1)], key=str)


def test_a_changed_header_is_a_change(spark):
    """Page 1 has a wrong verse, page 2 right text after a header without chapter, page 3 is wrong: the walk goes through to page 3."""
    lines = [(1, 1, 1, "text", 1), (1, 2, 1, "header", None), (1, 2, 2, "text", 2), (1, 3, 1, "text", 2)]
    segments = [(1, 1, 1, 1, True, 5), (1, 2, 2, 1, True, 1), (1, 3, 1, 1, True, 7)]
    got = renumbered(spark, [(1, k, 1, 1) for k in (1, 2, 3)], lines, segments, 1)
    assert got == sorted([(1, 1, 1, 1, 1), (2, 1, 0, 2, None), (3, 1, 1, 2, 2)], key=str)


def test_renumbering_stops_at_gaps_and_at_pages_without_lines(spark):
    lines, segments = joined(two(1, 1, 9, 9), two(2, 1, 9, 9), two(4, 1, 9, 9))
    assert {r[0] for r in renumbered(spark, [(1, k, 1, 1) for k in (1, 2, 4)], lines, segments, 1)} == {1, 2}
    assert {r[0] for r in renumbered(spark, [(1, k, 1, 1) for k in (1, 2, 3, 4)], lines, segments, 1)} == {1, 2}


def test_renumbering_equals_the_sequential_rule(spark):
    rng = random.Random(12)
    for _ in range(3):
        pages, lines, segments = [], [], []
        for page in range(1, 15):
            if page == 11:
                continue
            pages.append((1, page, 1, rng.randint(1, 3)))
            for line in range(1, rng.randint(1, 5)):
                kind = rng.choice(["header", "basmala", "text", "text", "text"])
                lines.append([1, page, line, kind, None])
                if kind == "text":
                    segments += [[1, page, line, s, rng.random() < 0.5, None] for s in range(1, rng.randint(1, 4))]

        def walk(change, pages=pages, lines=lines, segments=segments):
            chapter, verse, out = 1, pages[0][3], []
            for page in range(1, 11):
                changed = False
                for l in (x for x in lines if x[1] == page):
                    if l[3] == "header" and verse != 1:
                        chapter, verse = chapter + 1, 1
                    changed |= change(l, 4, chapter, out)
                    for s in (x for x in segments if x[1:3] == l[1:3]):
                        changed |= change(s, 5, verse, out)
                        verse += s[4]
                if not changed and change.__name__ == "compare":
                    break
            return out

        def fill(row, at, value, out):
            row[at] = value
            return True

        def compare(row, at, value, out):
            if row[at] != value:
                out.append((row[1], row[2], row[3] if at == 5 else 0, value))
            return row[at] != value

        walk(fill)
        for row in lines + segments:
            if row[1] <= 6 and rng.random() < 0.6:
                row[-1] = rng.choice([None, 1, 2, 77])
        got = renumbered(spark, pages, [tuple(x) for x in lines], [tuple(x) for x in segments], 1)
        assert sorted((p, l, s, c if v is None else v) for p, l, s, c, v in got) == sorted(walk(compare))


def test_two_boundaries_of_one_verse(spark):
    words = spark.createDataFrame([(1, 1, k + 1, w) for k, w in enumerate(["قال", "هدى", "من", "قٰل", "هدى"])], "chapter long, verse long, position int, word string")
    sought = spark.createDataFrame([(1, 1, "a", "هدى", 2), (1, 1, "b", "من", 1), (1, 1, "c", "قل", 1), (1, 1, "d", "غيب", 1), (1, 1, "e", "من", 2)], "chapter long, verse long, boundary string, sought string, occurrence int")
    got = {r.boundary: (r.after_position, r.note) for r in boundaries.placed_boundaries(words, sought).collect()}
    assert got == {"a": (5, "2 occurrences, took #2"), "b": (3, None), "c": (4, None), "d": (None, "no match"), "e": (None, "no such occurrence")}


def test_jobs_that_never_end_count(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    rows = [(1, 7, day(0), None), (2, 8, day(0, 1), None), (3, 7, day(40), None), (4, 9, day(40), day(40)), (5, 9, day(41), day(42)), (6, 9, day(42), None), (7, None, day(43), None)]
    jobs = spark.createDataFrame(rows, "job int, user int, started timestamp, ended timestamp")
    got = {r.job: (r.open, r.own, r.allowed) for r in feeds.capacity(jobs, 2, 1).collect()}
    assert got == {1: (0, 0, True), 2: (1, 0, True), 3: (2, 1, False), 4: (2, 0, False), 5: (3, 0, False), 6: (3, 0, False), 7: (4, 0, False)}


def test_places_are_compared_by_word(spark):
    schema = "chapter long, verse long, kind string, word string, position int"
    ours = spark.createDataFrame([(1, 1, "internal", "a", 2), (1, 1, "internal", "b", 5), (1, 1, "end", "c", 9)], schema)
    assert [tuple(r) for r in schemes.place_differences(ours, ours).orderBy("kind").collect()] == [("end", 1, 0, 0, 0), ("internal", 2, 0, 0, 0)]
    theirs = spark.createDataFrame([(1, 1, "internal", "a", 3), (1, 1, "internal", "d", 5)], schema)
    assert [tuple(r) for r in schemes.place_differences(ours, theirs).orderBy("kind").collect()] == [("end", 0, 0, 1, 0), ("internal", 0, 1, 1, 1)]


def test_a_verse_over_three_lines(spark):
    bodies = spark.createDataFrame([("v", line, x, f"{line}{x}") for line, xs in ((1, (30, 10)), (2, (40, 20, 5)), (3, (50,))) for x in xs] + [("w", 3, 9, "39")], "verse string, line int, x int, label string")
    words = spark.createDataFrame([("v", 1, 3), ("v", 2, 0), ("v", 3, 2), ("v", 4, 1), ("w", 5, 2), ("u", 6, 1)], "verse string, word int, pieces int")
    held, report = review.exact_alignment(bodies, words, ["verse"], ["line", F.desc("x")])
    assert {r.label: r.word for r in held.collect()} == {"130": 1, "110": 1, "240": 1, "220": 3, "25": 3, "350": 4, "39": 5}
    assert {tuple(r) for r in report.collect()} == {("w", 2, 1), ("u", 1, 0)}


def test_versions_of_approvals(spark):
    approvals = spark.createDataFrame([(1, 3, 1), (1, 3, 4), (1, 5, 2), (2, 1, 1)], "collection_id long, page_number int, number long")
    assert {tuple(r) for r in trees.approval_versions(approvals).collect()} == {(1, 1, 3, 4, 4, 5), (1, 2, 5, 2, 6, None), (2, 1, 1, 1, 2, None)}
    pages = spark.createDataFrame([(1, k) for k in range(1, 8)] + [(3, 1)], "collection_id long, page_number int")
    assert {(r.collection_id, r.page_number): r.version for r in trees.approved_before(approvals, pages).collect()} == {(1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 4): 1, (1, 5): 1, (1, 6): 2, (1, 7): 2, (3, 1): 0}


def test_gaps_count_lines_between_islands(spark):
    lines = spark.createDataFrame([(1, p, l) for p in (1, 2) for l in (1, 2, 3)], "collection_id long, page_number int, line_number int")
    islands = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 0), (1, 2, 2, 1, 1, 9, 1), (1, 2, 2, 2, 1, 20, 2)], "collection_id long, page_number int, line_number int, segment_order int, chapter long, verse long, island long")
    assert {r.island: r.unnumbered for r in planning.gaps(islands, lines).collect()} == {0: 3, 1: 0}


@pytest.mark.parametrize("before", [False, True])
def test_neighbours_equal_brute_force(spark, before):
    rng = random.Random(5)
    groups, k = [], 3
    for g in range(240):
        centre = g % 8
        at = [centre + rng.gauss(0, 0.05) if rng.random() < 0.9 else rng.random() * 8 for _ in range(4)]
        refs = [(100 * g + j, rng.randint(0, 30), rng.randint(1, 9)) for j in range(rng.randint(1, 3))]
        groups.append((g % 3, "body" if centre % 2 else "mark", g, at, len(refs), sorted(refs)))
    queries = [(q, q % 4, [q % 8 + rng.gauss(0, 0.1) for _ in range(4)], rng.randint(0, 30) if q % 5 else None, rng.randint(1, 10) if before else None) for q in range(60)]
    g = spark.createDataFrame(groups, "collection_id long, role string, group_id long, features array<double>, copies long, refs array<struct<sample_id:long,snapshot_id:long,page_number:long>>")
    q = spark.createDataFrame(queries, "query_id long, collection_id long, features array<double>, snapshot_id long, before long")
    got = {}
    for r in neighbours.nearest(q, g, "role", k, (0.5, 0.25), 2, pivots=7).collect():
        got.setdefault((r.query_id, r.role), []).append((r.distance, r.group_id, len(r.refs)))
    want = {}
    for name, collection, at, own, page in queries:
        for c, role, group, place, _, refs in groups:
            seen = [r for r in refs if r[1] != own and (page is None or r[2] < page)]
            if c == collection and seen:
                d = sum((a - b) ** 2 * (0.5 if i < 2 else 0.25) for i, (a, b) in enumerate(zip(place, at))) ** 0.5
                want.setdefault((name, role), []).append((round(d, 9), group if page is None else min(r[0] for r in seen), len(seen)))
    assert {key: sorted(v) for key, v in got.items()} == {key: sorted(v)[:k] for key, v in want.items()}
    assert neighbours.nearest(q, g.filter("1 = 0"), "role", k, (0.5, 0.25), 2).count() == 0


def test_words_meet_their_boundaries_in_one_exchange(spark):
    words = spark.range(40).selectExpr("id div 20 AS chapter", "id div 10 AS verse", "id % 10 + 1 AS position", "concat('ق', id % 3) AS word")
    sought = words.filter("position in (1, 4)").selectExpr("chapter", "verse", "concat('b', position) AS boundary", "word AS sought", "1 AS occurrence")
    plan = boundaries.placed_boundaries(words, sought)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {r.after_position for r in boundaries.placed_boundaries(words, sought).collect()} == {1}


@pytest.mark.parametrize("name", ["h02_h03_role_proposals", "h04_type_guesses", "h05_type_evidence"])
def test_examples_of_all_collections_are_asked(name):
    from leafmark.plans import registry

    assert "FROM gr CROSS JOIN qs" in registry.SQL[name]


def test_nearest_of_all_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKED", 7)
    monkeypatch.setattr(neighbours, "BLOCK", 11)
    r = random.Random(5)
    vectors = {i: [r.choice((0.0, 0.5, 1.0)) for _ in range(4)] for i in range(60)}
    rows = [(i // 10, i, "ab"[i % 2], v, [(i, i // 3, 1)], 1) for i, v in vectors.items()]
    groups = spark.createDataFrame(rows, "collection_id long, group_id long, kind string, features array<double>, refs array<struct<sample_id:long,snapshot_id:long,page_number:long>>, copies long")
    queries = groups.filter("group_id % 4 = 0").selectExpr("group_id AS query_id", "features", "group_id div 3 AS snapshot_id")
    got = {}
    for x in neighbours.nearest_of_all(queries, groups, "kind", 3, (0.5, 0.5), 2).collect():
        got.setdefault((x.query_id, x.kind), []).append((x.distance, x.group_id))
    for q in range(0, 60, 4):
        for c in "ab":
            every = sorted((round(sum((a - b) ** 2 * 0.5 for a, b in zip(vectors[q], v, strict=True)) ** 0.5, 9), i) for i, v in vectors.items() if "ab"[i % 2] == c and i // 3 != q // 3)
            assert sorted(got[q, c]) == every[:3]


def test_tokens_stay_where_they_are_when_marks_are_dropped(spark):
    tokens = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(["ab", "12", "c", "--", None, "d"])], "chapter long, verse long, pos long, token string")
    found = schemes.dropped_marks(tokens, spark.createDataFrame([(1, 1, 4), (1, 1, 6)], "chapter long, verse long, position long"))
    exchanges = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "collect_list" in x]
    assert exchanges and not any("token" in x for x in exchanges)
    assert sorted((r.position, r.corrected) for r in found.collect()) == [(4, 2), (6, 3)]
