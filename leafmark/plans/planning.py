"""Queries over runs of words: plans, placements, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.operators import planning as P
from leafmark.operators import words as W
from leafmark.plans.base import domain, query
from leafmark.sources.shared import dealt
from leafmark.sources.views import row_parts

# numbers as a run finds them: some lines have none
_NUMBERED = "nb AS (SELECT collection_id, page_number, line_number, segment_order, CAST(floor(page_number / 20) + 1 AS BIGINT) AS chapter, CASE WHEN (page_number * 7 + line_number) % 23 <> 5 THEN CAST(page_number % 20 * 3 + line_number + CASE WHEN x % 50 = 7 THEN 2 ELSE 0 END AS BIGINT) END AS verse FROM v_segment)"
_SPAN = "en AS (SELECT * FROM nb WHERE verse IS NOT NULL AND (chapter, verse) >= (1, 4 + collection_id % 3) AND (chapter, verse) <= (5, 40))"
_LAST = "lv AS (SELECT CAST(unnest(range(1, 7)) AS BIGINT) AS chapter), la AS (SELECT chapter, 60 + chapter % 2 AS last FROM lv)"
_ISLANDS = f"""{_NUMBERED}, {_SPAN}, {_LAST}, pr AS (SELECT *, lag(chapter) OVER w AS pc, lag(verse) OVER w AS pv FROM en WINDOW w AS (PARTITION BY collection_id ORDER BY page_number, line_number, segment_order)),
br AS (SELECT pr.*, CASE WHEN pc IS NULL OR (pr.chapter = pc AND verse = pv) OR coalesce(CASE WHEN pv < a.last THEN pr.chapter = pc AND verse = pv + 1 WHEN b.chapter IS NOT NULL THEN pr.chapter = pc + 1 AND verse = 1 END, false) THEN 0 ELSE 1 END AS breaks FROM pr LEFT JOIN la a ON a.chapter = pc LEFT JOIN la b ON b.chapter = pc + 1),
isl AS (SELECT collection_id, page_number, line_number, segment_order, chapter, verse, CAST(sum(breaks) OVER (PARTITION BY collection_id ORDER BY page_number, line_number, segment_order ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM br)"""


def _entries(spark, sf_dir):
    lines, segments = domain(spark, sf_dir, "line", "segment")
    verse = F.expr("CASE WHEN (page_number * 7 + line_number) % 23 <> 5 THEN CAST(page_number % 20 * 3 + line_number + CASE WHEN x % 50 = 7 THEN 2 ELSE 0 END AS BIGINT) END")
    numbered = segments.select("collection_id", "page_number", "line_number", "segment_order", (F.floor(F.col("page_number") / 20) + 1).alias("chapter"), verse.alias("verse"))
    spans = numbered.select("collection_id").distinct().selectExpr("collection_id", "1L AS from_chapter", "4L + collection_id % 3 AS from_verse", "5L AS to_chapter", "40L AS to_verse")
    return dealt(P.span_entries(numbered, spans), row_parts(spark, sf_dir), "collection_id"), numbered, lines


def _last(spark):
    return spark.range(1, 7).selectExpr("id AS chapter", "60 + id % 2 AS last")


def _islands(spark, sf_dir):
    entries, numbered, lines = _entries(spark, sf_dir)
    return P.verse_islands(entries, _last(spark)), numbered, lines


@query(f"WITH {_NUMBERED}, {_SPAN} SELECT * FROM en")
def e17_span_entries(spark, sf_dir):
    return _entries(spark, sf_dir)[0]


@query(f"WITH {_ISLANDS} SELECT * FROM isl")
def e14_verse_islands(spark, sf_dir):
    return _islands(spark, sf_dir)[0]


@query(f"""WITH {_ISLANDS}, ends AS (SELECT collection_id, island, min((page_number, line_number, segment_order, chapter, verse)) AS a, max((page_number, line_number, segment_order, chapter, verse)) AS z FROM isl GROUP BY ALL),
pa AS (SELECT collection_id, island, z, lead(a) OVER (PARTITION BY collection_id ORDER BY island) AS nx FROM ends), pb AS (SELECT * FROM pa WHERE nx IS NOT NULL),
un AS (SELECT pb.collection_id, pb.island, count(*) AS n FROM pb JOIN v_line l ON l.collection_id = pb.collection_id AND (l.page_number, l.line_number) > (z[1], z[2]) AND (l.page_number, l.line_number) < (nx[1], nx[2])
  WHERE NOT EXISTS (SELECT 1 FROM isl i WHERE i.collection_id = l.collection_id AND i.page_number = l.page_number AND i.line_number = l.line_number AND i.island IN (pb.island, pb.island + 1)) GROUP BY ALL)
SELECT pb.collection_id, pb.island, z[4] AS after_chapter, z[5] AS after_verse, z[1] AS after_page, nx[4] AS before_chapter, nx[5] AS before_verse, nx[1] AS before_page, coalesce(n, 0) AS unnumbered FROM pb LEFT JOIN un USING (collection_id, island)""")
def e15_gaps(spark, sf_dir):
    islands, _, lines = _islands(spark, sf_dir)
    return P.gaps(islands, lines, row_parts(spark, sf_dir))


# long islands for chunks: numbers that run on
_RUN = """nr AS (SELECT collection_id, page_number, line_number, segment_order, dense_rank() OVER (PARTITION BY collection_id ORDER BY page_number, CAST(floor(line_number / 3) AS BIGINT)) AS k FROM v_segment),
en AS (SELECT collection_id, page_number, line_number, segment_order, CAST(floor((k - 1) / 60) + 1 AS BIGINT) AS chapter, CAST((k - 1) % 60 + 1 AS BIGINT) AS verse FROM nr)"""


@query(f"""WITH RECURSIVE {_RUN}, it AS (SELECT *, row_number() OVER w AS i, dense_rank() OVER (PARTITION BY collection_id ORDER BY page_number, line_number) AS d FROM en WINDOW w AS (PARTITION BY collection_id ORDER BY page_number, line_number, segment_order)),
fi AS (SELECT collection_id, arg_min(chapter, i) AS fc, arg_min(verse, i) AS fv, arg_max(chapter, i) AS ec, arg_max(verse, i) AS ev FROM it GROUP BY ALL),
ok AS (SELECT it.*, CASE WHEN verse < 60 THEN chapter WHEN chapter < 6 THEN chapter + 1 END AS nc, CASE WHEN verse < 60 THEN verse + 1 WHEN chapter < 6 THEN 1 END AS nv FROM it JOIN fi USING (collection_id) WHERE (chapter, verse) < (ec, ev)),
fit AS (SELECT ok.* FROM ok JOIN fi USING (collection_id) WHERE nc IS NOT NULL AND (nc, nv) <= (ec, ev)),
cut(collection_id, n, i, d) AS (SELECT collection_id, 0, 0::BIGINT, 1::BIGINT FROM fi UNION ALL SELECT collection_id, n, f[1], f[2] FROM (SELECT c.collection_id, c.n + 1 AS n, (SELECT min((fit.i, fit.d)) FROM fit WHERE fit.collection_id = c.collection_id AND fit.i > c.i AND fit.d >= c.d + 9) AS f FROM cut c) q WHERE f IS NOT NULL),
cc AS (SELECT cut.collection_id, n, chapter, verse, nc, nv FROM cut JOIN fit USING (collection_id, i)),
al AS (SELECT fi.collection_id, 0 AS n, fc AS c, fv AS v FROM fi UNION ALL SELECT collection_id, n, nc, nv FROM cc)
SELECT al.collection_id, CAST(0 AS BIGINT) AS island, CAST(al.n AS BIGINT) AS chunk, c AS from_chapter, v AS from_verse, coalesce(cc.chapter, ec) AS to_chapter, coalesce(cc.verse, ev) AS to_verse FROM al JOIN fi USING (collection_id) LEFT JOIN cc ON cc.collection_id = al.collection_id AND cc.n = al.n + 1""")
def e16_chunks(spark, sf_dir):
    from pyspark.sql import Window

    (segments,) = domain(spark, sf_dir, "segment")
    k = F.dense_rank().over(Window.partitionBy("collection_id").orderBy("page_number", F.floor(F.col("line_number") / 3)))
    entries = segments.withColumn("k", k).select("collection_id", "page_number", "line_number", "segment_order", (F.floor((F.col("k") - 1) / 60) + 1).alias("chapter"), ((F.col("k") - 1) % 60 + 1).cast("long").alias("verse"))
    last = spark.range(1, 7).selectExpr("id AS chapter", "60L AS last")
    return P.chunks(P.verse_islands(entries, last), last, 10)


@query(f"""WITH {_NUMBERED}, p AS (SELECT collection_id, chapter, verse, min((page_number, line_number, segment_order)) AS a, max((page_number, line_number, segment_order)) AS z FROM nb WHERE verse IS NOT NULL GROUP BY ALL)
SELECT collection_id, chapter, verse, a[1] AS first_page_number, a[2] AS first_line_number, a[3] AS first_segment_order, z[1] AS last_page_number, z[2] AS last_line_number, z[3] AS last_segment_order FROM p""")
def c19_verse_places(spark, sf_dir):
    return P.verse_places(_entries(spark, sf_dir)[1].filter("verse is not null"))


@query(f"""WITH {_NUMBERED}, s AS (SELECT collection_id, min((page_number, line_number, segment_order, chapter, verse)) AS a, max((page_number, line_number, segment_order, chapter, verse)) AS z FROM nb WHERE verse IS NOT NULL AND collection_id % 5 <> 1 GROUP BY ALL)
SELECT collection_id, a[4] AS from_chapter, a[5] AS from_verse, z[4] AS to_chapter, z[5] AS to_verse FROM (SELECT DISTINCT collection_id FROM v_page) LEFT JOIN s USING (collection_id)""")
def d21_available_spans(spark, sf_dir):
    numbered = _entries(spark, sf_dir)[1]
    collections = domain(spark, sf_dir, "page")[0].select("collection_id").distinct()
    return P.available_spans(collections, numbered.filter("collection_id % 5 <> 1"))


_LINES = "SELECT page_id % 20 AS run, CAST(floor(page_id / 100) AS BIGINT) AS chunk, page_id * 10 + line_number AS line, status FROM {s}"
_PLACED_WORDS = "SELECT page_id % 20 AS run, page_id * 10 + line_number AS line, position, word_id FROM {w} WHERE word_id IS NOT NULL"
_CHUNKS = "SELECT page_id % 20 AS run, CAST(floor(page_id / 100) AS BIGINT) AS chunk, count(word_id) + CASE WHEN floor(page_id / 100) % 6 = 2 THEN 1 ELSE 0 END AS expected FROM {w} GROUP BY page_id % 20, floor(page_id / 100)"
_ORNAMENTS = "SELECT line % 20 AS run, line * 10 + label % 7 + 1 AS line, x AS left, x + w AS right FROM {c} WHERE label % 5 = 2"
_RUNS = f"ls AS ({_LINES.format(s='v_status')}), ws AS ({_PLACED_WORDS.format(w='v_word')}), ck AS ({_CHUNKS.format(w='v_word')}), orn AS ({_ORNAMENTS.format(c='v_component').replace('AS left', 'AS l').replace('AS right', 'AS r')})"
_TOTALS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in P.STATUSES)


def _runs(spark, sf_dir):
    words, status = domain(spark, sf_dir, "word", "status")
    return spark.sql(_LINES.format(s="{s}"), s=status), spark.sql(_PLACED_WORDS.format(w="{w}"), w=words), spark.sql(_CHUNKS.format(w="{w}"), w=words)


@query(f"""WITH {_RUNS}, n AS (SELECT run, line, count(*) AS words FROM ws GROUP BY ALL), r AS (SELECT run, chunk, coalesce(words, 0) AS words, status FROM ls LEFT JOIN n USING (run, line)), p AS (SELECT run, chunk, count(*) AS lines, sum(words) AS words, {_TOTALS} FROM r GROUP BY ALL),
b AS (SELECT coalesce(ck.run, p.run) AS run, coalesce(lines, 0) AS lines, coalesce(words, 0) AS words, coalesce(expected, 0) AS expected, {', '.join(f'coalesce({s}, 0) AS {s}' for s in P.STATUSES)} FROM ck FULL JOIN p ON ck.run = p.run AND ck.chunk = p.chunk)
SELECT run, grouping(run) = 1 AS whole, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(words) AS BIGINT) AS words, {', '.join(f'CAST(sum({s}) AS BIGINT) AS {s}' for s in P.STATUSES)}, round((sum(lines) - sum(exact)) / sum(lines), 6) AS flagged, count(*) FILTER (words < expected) AS incomplete FROM b GROUP BY ROLLUP (run)""")
def d20_run_totals(spark, sf_dir):
    return P.run_totals(*_runs(spark, sf_dir))


_HEAD = "'lines': count(*), 'separators_found': CAST(sum(len(o)) AS BIGINT), 'totals': {" + ", ".join(f"'{s}': count(*) FILTER (status = '{s}')" for s in P.STATUSES) + "}"


@query(f"""WITH {_RUNS}, w AS (SELECT run, line, list(word_id ORDER BY position, word_id) AS w FROM ws GROUP BY ALL), o AS (SELECT run, line, list({{'left': l, 'right': r}} ORDER BY l, r) AS o FROM orn GROUP BY ALL), l AS (SELECT run, line, status, coalesce(w, []) AS w, coalesce(o, []) AS o FROM ls LEFT JOIN w USING (run, line) LEFT JOIN o USING (run, line)), m AS (SELECT count(*) // 20 AS most FROM ls)
SELECT run, count(*) <= any_value(most) AS "full", md5(CASE WHEN count(*) <= any_value(most) THEN to_json({{{_HEAD}, 'detail': list({{'line': line, 'status': status, 'separators': len(o), 'words': w, 'ornaments': o}} ORDER BY line)}}) ELSE to_json({{{_HEAD}, 'detail': list({{'line': line, 'status': status, 'separators': len(o), 'word_count': len(w)}} ORDER BY line)}}) END) AS report FROM l, m GROUP BY run""")
def a10_run_report(spark, sf_dir):
    lines, words, _ = _runs(spark, sf_dir)
    (components,) = domain(spark, sf_dir, "component")
    return P.run_report(lines.drop("chunk"), words, spark.sql(_ORNAMENTS.format(c="{c}"), c=components), lines.count() // 20).withColumn("report", F.md5("report"))


_PLACED = "list_reduce({free}, lambda acc, x: list_concat(acc[1:coalesce(list_position([r.end_x < x[1].end_x for r in acc], true) - 1, len(acc))], x, acc[coalesce(list_position([r.end_x < x[1].end_x for r in acc], true), len(acc) + 1):]), {labelled})"
_S = "{'word_id': word_id, 'start_x': start_x, 'end_x': end_x}"
_GROUPED = f"""la AS (SELECT page_id, line_number, list({_S} ORDER BY word_id, ord, start_x, end_x) AS a FROM lab GROUP BY ALL), fr AS (SELECT page_id, line_number, list([{_S}] ORDER BY ord, start_x, end_x) AS b FROM fre GROUP BY ALL),
me AS (SELECT coalesce(la.page_id, fr.page_id) AS page_id, coalesce(la.line_number, fr.line_number) AS line_number, {_PLACED.format(free="coalesce(b, [])", labelled="coalesce(a, [])")} AS m FROM la FULL JOIN fr ON la.page_id = fr.page_id AND la.line_number = fr.line_number),
po AS (SELECT page_id, line_number, i - 1 AS position, m[i].word_id AS word_id, m[i].start_x AS start_x, m[i].end_x AS end_x FROM (SELECT page_id, line_number, m, unnest(range(1, len(m) + 1)) AS i FROM me))"""


@query(f"""WITH ob AS (SELECT page_id, 1 AS line_number, CASE WHEN word_id % 4 <> 1 THEN word_id END AS word_id, start_x, end_x, CAST(line_number * 100 + position AS BIGINT) AS ord FROM v_word), lab AS (SELECT * FROM ob WHERE word_id IS NOT NULL), fre AS (SELECT * FROM ob WHERE word_id IS NULL), {_GROUPED} SELECT * FROM po""")
def e19_placed(spark, sf_dir):
    """Whole pages as lines, a third of the words unlabelled."""
    (words,) = domain(spark, sf_dir, "word")
    rows = words.selectExpr("page_id", "1 AS line_number", "CASE WHEN word_id % 4 <> 1 THEN word_id END AS word_id", "start_x", "end_x", "CAST(line_number * 100 + position AS BIGINT) AS ord")
    return W.placed(rows.filter("word_id is not null"), rows.filter("word_id is null"), W.KEY)


_SAVE = f"""hd AS (SELECT page_id, CASE WHEN line_number > 3 THEN 2 ELSE 1 END AS line_number, word_id, start_x, end_x, CAST(line_number * 100 + position AS BIGINT) AS position FROM v_word),
fs AS (SELECT page_id, line_number, word_id + 1 AS word_id, start_x - 7 AS start_x, end_x - 7 + word_id % 2 AS end_x FROM hd WHERE word_id IS NOT NULL AND word_id % 3 <> 0 AND word_id BETWEEN 20 AND 150),
ln AS (SELECT page_id, line_number, min(CASE WHEN page_id % 4 = 0 THEN 'unresolved' ELSE 'scored' END) AS status FROM hd GROUP BY ALL), tc AS (SELECT * FROM ln WHERE page_id % 6 <> 1),
nw AS (SELECT page_id, line_number, word_id, start_x + 7 AS start_x, end_x + 7 AS end_x, CAST(-1 AS BIGINT) AS ord FROM fs SEMI JOIN tc USING (page_id, line_number)), kp AS (SELECT page_id, line_number, word_id, start_x, end_x, position AS ord FROM hd SEMI JOIN tc USING (page_id, line_number) WHERE word_id IS NULL OR word_id NOT BETWEEN 20 AND 151),
lab AS (SELECT * FROM kp WHERE word_id IS NOT NULL UNION ALL SELECT * FROM nw), fre AS (SELECT * FROM kp ANTI JOIN nw USING (page_id, line_number, end_x) WHERE word_id IS NULL), {_GROUPED}"""


def _saved(spark, sf_dir):
    (words,) = domain(spark, sf_dir, "word")
    held = words.selectExpr("page_id", "CASE WHEN line_number > 3 THEN 2 ELSE 1 END AS line_number", "word_id", "start_x", "end_x", "CAST(line_number * 100 + position AS BIGINT) AS position")
    fresh = held.filter("word_id is not null and word_id % 3 <> 0 and word_id between 20 and 150").selectExpr("page_id", "line_number", "word_id + 1 AS word_id", "start_x - 7 AS start_x", "end_x - 7 + word_id % 2 AS end_x")
    lines = held.selectExpr("page_id", "line_number", "CASE WHEN page_id % 4 = 0 THEN 'unresolved' ELSE 'scored' END AS status").distinct()
    return W.saved_placements(held, fresh, lines, lines.filter("page_id % 6 = 1").select(*W.KEY), 20, 151, 7)


@query(f"WITH {_SAVE} SELECT * FROM po")
def j02_saved_words(spark, sf_dir):
    return _saved(spark, sf_dir)[0]


@query(f"""WITH {_SAVE}, e AS (SELECT DISTINCT page_id, line_number, true AS edited FROM fre), n AS (SELECT page_id, line_number, count(*) AS written FROM nw GROUP BY ALL)
SELECT page_id, line_number, status, coalesce(edited, false) AS edited, coalesce(written, 0) AS written, status = 'unresolved' AND written IS NULL AS open FROM tc LEFT JOIN e USING (page_id, line_number) LEFT JOIN n USING (page_id, line_number)""")
def j02_saved_status(spark, sf_dir):
    return _saved(spark, sf_dir)[1]


@query("""WITH n AS (SELECT page_id, line_number, list({'w': word_id, 's': start_x, 'e': end_x} ORDER BY start_x DESC, end_x, word_id) AS l FROM v_word WHERE page_id % 5 = 2 GROUP BY ALL)
SELECT page_id, line_number, position, word_id, start_x, end_x, false AS edited FROM v_word WHERE page_id % 5 <> 2 UNION ALL SELECT page_id, line_number, CAST(i - 1 AS INT), l[i].w, l[i].s, l[i].e, true FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM n)""")
def j03_replaced_words(spark, sf_dir):
    (words,) = domain(spark, sf_dir, "word")
    order = F.array_sort(F.collect_list(F.struct((-F.col("start_x")).alias("o"), "end_x", F.coalesce("word_id", F.lit(1 << 40)).alias("k"), "word_id", "start_x")))
    lines = words.filter("page_id % 5 = 2").groupBy(*W.KEY).agg(F.transform(order, lambda x: F.struct(x["word_id"].alias("word_id"), x["start_x"].alias("start_x"), x["end_x"].alias("end_x"))).alias("words"))
    return W.replaced_words(words, lines)


@query("""WITH w AS (SELECT page_id, page_id % 3 AS stretch, line_number, position, word_id FROM v_word), n AS (SELECT *, count(word_id) OVER (PARTITION BY page_id, stretch ORDER BY line_number, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM w),
p AS (SELECT DISTINCT page_id, stretch, page_id * 2 AS first, CASE WHEN page_id % 2 = 0 THEN page_id * 2 + 2 END AS last FROM w WHERE page_id % 7 <> 4)
SELECT page_id, stretch, line_number, position, CASE WHEN word_id IS NOT NULL AND (last IS NULL OR first + n <= last) THEN first + n END AS word_id FROM n LEFT JOIN p USING (page_id, stretch)""")
def e21_relabelled(spark, sf_dir):
    (words,) = domain(spark, sf_dir, "word")
    rows = words.selectExpr("page_id", "page_id % 3 AS stretch", "line_number", "position", "word_id")
    pins = rows.filter("page_id % 7 <> 4").selectExpr("page_id", "stretch", "page_id * 2 AS first", "CASE WHEN page_id % 2 = 0 THEN page_id * 2 + 2 END AS last").distinct()
    return W.relabelled(rows, pins)


@query("SELECT page_id, line_number, CAST(1 + CASE WHEN page_id % 3 = 1 THEN 4 ELSE 0 END AS BIGINT) AS number FROM v_status WHERE edited AND page_id % 3 <> 2")
def j09_archived(spark, sf_dir):
    """A third of the hand-made lines has no history, a third an older one, a third the same."""
    words, status = domain(spark, sf_dir, "word", "status")
    hand = status.filter("edited").select(*W.KEY)
    now = W.archived(status.selectExpr(*W.KEY, "0L AS number", "'' AS digest").filter("1 = 0"), words, hand)
    history = now.filter("page_id % 3 = 2").selectExpr(*W.KEY, "9L AS number", "digest").unionAll(now.filter("page_id % 3 = 1").selectExpr(*W.KEY, "4L AS number", "'other' AS digest"))
    return W.archived(history, words, hand).select(*W.KEY, F.col("number").cast("long").alias("number"))


@query("""WITH l AS (SELECT page_id, line_number, status AS value FROM v_status), e AS (SELECT page_id, line_number, arg_max('hand' || position, (position, 'hand' || position)) AS v FROM v_word WHERE page_id % 3 = 0 GROUP BY ALL)
SELECT page_id, line_number, coalesce(v, value) AS value, v IS NOT NULL AS by_hand FROM l LEFT JOIN e USING (page_id, line_number)""")
def j12_overlaid(spark, sf_dir):
    words, status = domain(spark, sf_dir, "word", "status")
    edits = words.filter("page_id % 3 = 0").selectExpr(*W.KEY, "position AS edited_at", "concat('hand', position) AS value")
    return W.overlaid(status.withColumnRenamed("status", "value"), edits)
