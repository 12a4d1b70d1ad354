"""The numbering walk and other ordered operators against sequential Python."""

import random



from leafmark.operators import components, numbering, series



def test_walk_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    pages, lines, segments, want = [], [], [], {}
    for c in range(40):
        chapter = verse = None
        previous = None
        for page in sorted(rng.sample(range(1, 12), 7)):
            seed = (rng.randint(1, 4), rng.randint(1, 3))
            pages.append((c, page, *seed))
            if previous != page - 1:
                chapter, verse = seed
            previous = page
            for line in range(1, rng.randint(2, 5)):
                if rng.random() < 0.25:
                    lines.append((c, page, line, "header"))
                    if verse != 1:
                        chapter, verse = chapter + 1, 1
                    continue
                lines.append((c, page, line, "text"))
                for s in range(1, rng.randint(2, 4)):
                    closes = rng.random() < 0.5
                    segments.append((c, page, line, s, closes, 1, 1))
                    want[c, page, line, s] = (chapter, verse)
                    verse += closes
    p = spark.createDataFrame(pages, "collection_id long, page_number int, start_chapter long, start_verse long")
    l = spark.createDataFrame(lines, "collection_id long, page_number int, line_number int, type string")
    s = spark.createDataFrame(segments, "collection_id long, page_number int, line_number int, segment_order int, closes boolean, x long, w long")
    got = {(r.collection_id, r.page_number, r.line_number, r.segment_order): (r.chapter, r.verse) for r in numbering.walk(p, l, s).collect()}
    assert got == want


def test_interval_union_joins_touching_ones(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (2, 1, 2)], "g int, l int, r int")
    got = sorted((r.g, r.ord, r.left, r.right) for r in components.interval_union(df, "g", "l", "r").collect())
    assert got == [(1, 1, 9, 12), (1, 2, 0, 7), (2, 1, 1, 2)]


def test_strongest_apart(spark):
    df = spark.createDataFrame([("a", p, float(v)) for p, v in enumerate([1, 5, 4, 5, 0, 3])], "grp string, position long, score double")
    got = [(r.rank, r.position) for r in series.strongest_apart(df, 3, 2).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 3), (3, 5)]


