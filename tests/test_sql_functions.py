"""Functions for users of SQL against the expressions and operators that they stand for."""

import random

from pyspark.sql import functions as F

from leafmark.functions import arabic, registered
from leafmark.operators import planning

WORDS = ["بِسْمِ", "ٱللَّهِ", "ٱلرَّحْمَـٰنِ", "ٱلرَّحِيمِ", "قال", "قٰل", "شيء", "رؤوس", "الءايات", "و", "", "abc", "يٓس", "ءامن", "أنزل", "هدى", "هدي", "قائم", "قام", "قل", None]


def test_spellings_from_sql(spark):
    registered.register(spark)
    pairs = spark.createDataFrame([(a, b) for a in WORDS for b in WORDS], "a string, b string")
    pairs.createOrReplaceTempView("pairs_of_words")
    got = spark.sql("SELECT a, b, letters_of(a) AS l, word_pieces(a) AS p, piece_count(a) AS n, dots_above(a) AS x, dots_below(a) AS y, match_level(a, b) AS m FROM pairs_of_words")
    above, below = arabic.dots(F.col("a"))
    want = pairs.select("a", "b", arabic.letters_of(F.col("a")).alias("l"), arabic.pieces(F.col("a")).alias("p"), arabic.piece_count(F.col("a")).alias("n"), above.alias("x"), below.alias("y"), arabic.match_level(F.col("a"), F.col("b")).alias("m"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.m for r in got.collect()} == {0, 1, 2, None}


def test_formula_from_sql(spark):
    registered.register(spark)
    formula = WORDS[:4]
    rows = [(c, v, [*formula, "more"][:n]) for c in (1, 2, 9) for v in (1, 2) for n in (3, 4, 5)] + [(2, 1, ["one"])]
    df = spark.createDataFrame(rows, "chapter long, verse long, words array<string>")
    df.createOrReplaceTempView("verses_of_words")
    got = spark.sql("SELECT chapter, verse, words, without_formula(words, chapter, verse) AS w FROM verses_of_words")
    want = df.withColumn("w", arabic.without_formula(F.col("words"), F.col("chapter"), F.col("verse")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {len(r.w) for r in got.collect() if len(r.words) == 5} == {1, 5}


def test_chunks_from_sql(spark):
    registered.register(spark)
    rng = random.Random(4)
    entries, last = [], 30
    for island in range(6):
        chapter, verse, page, line, order = 1 + island % 2, 1, 1, 1, 1
        for _ in range(rng.randint(1, 200)):
            entries.append((7, island, page, line, order, chapter, verse))
            order += 1
            if rng.random() < 0.5:
                page, line, order = page + (line == 9), line % 9 + 1, 1
            if rng.random() < 0.6:
                chapter, verse = (chapter, verse + 1) if verse < last else (chapter + 1, 1)
    df = spark.createDataFrame(entries, "collection_id long, island long, page_number int, line_number int, segment_order int, chapter long, verse long")
    df.createOrReplaceTempView("entries_of_islands")
    got = spark.sql(f"""SELECT * FROM verse_chunks(TABLE(SELECT *, CASE WHEN verse < {last} THEN chapter ELSE chapter + 1 END AS next_chapter, CASE WHEN verse < {last} THEN verse + 1 ELSE 1L END AS next_verse
      FROM entries_of_islands) PARTITION BY (collection_id, island) ORDER BY (page_number, line_number, segment_order), 8)""")
    verses = spark.range(1, 60).selectExpr("id AS chapter", f"{last}L AS last")
    want = planning.chunks(df, verses, 8).drop("collection_id", "island")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 12
