"""Boundaries named by a word, placed in their verse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions.arabic import LEVELS, forms, match_level, skeleton
from leafmark.functions.values import once


def spelling_index(words: DataFrame) -> DataFrame:
    """(word, level, form): each distinct word's spellings at each level, so that words are alike at a level where they share a form."""
    levels = F.array(*(F.struct(F.lit(k).alias("level"), f.alias("forms")) for k, f in enumerate(forms(F.col("word")))))
    rows = words.select("word").distinct().select("word", F.explode(levels).alias("l"))
    return rows.select("word", "l.level", F.explode(F.array_distinct("l.forms")).alias("form"))


def placed_boundaries(words: DataFrame, sought: DataFrame) -> DataFrame:
    """(chapter, verse, boundary, after_position, note): the asked occurrence of the word that a boundary stands after.

    Words and boundaries meet once, in their verse, which is one row then. words: (chapter, verse, position, word); sought: (chapter, verse,
    boundary, sought, occurrence), where (chapter, verse, boundary) is a boundary's identity."""
    verse = ["chapter", "verse"]
    word = F.struct("position", "word").alias("words")
    asked = F.struct("boundary", "sought", "occurrence").alias("asked")
    left = words.dropna(subset=verse).select(*verse, word, F.lit(None).cast(sought.select(asked).schema["asked"].dataType).alias("asked"))
    both = left.unionByName(sought.select(*verse, F.lit(None).cast(words.select(word).schema["words"].dataType).alias("words"), asked))
    # rows go to their verse before they are collected: in the tasks that read them they would be sorted for nothing
    held = both.repartition(*verse).groupBy(*verse).agg(F.collect_list("words").alias("words"), F.collect_list("asked").alias("asked"))
    return placed_in_verses(held)


def placed_in_verses(verses: DataFrame) -> DataFrame:
    """placed_boundaries for verses whose words are already together: (chapter, verse, words, asked), arrays of (position, word) and of (boundary,
    sought, occurrence).

    Looser spellings count only where no tighter one matches in the verse; a choice among several and a loose match are noted. A boundary is
    compared with its verse's words of the same skeleton only. Nothing leaves its row."""
    w = F.transform("words", lambda w: F.struct(w["position"].alias("position"), w["word"].alias("word"), skeleton(w["word"]).alias("skeleton")))
    rows = verses.filter(F.size("asked") > 0).select("chapter", "verse", w.alias("w"), "asked").select("chapter", "verse", "w", F.explode("asked").alias("s"))
    sought = F.col("s.sought")
    level = lambda w: F.struct(match_level(w["word"], sought).alias("level"), w["position"].alias("position"))
    found = once(skeleton(sought), lambda k: F.array_sort(F.filter(F.transform(F.filter("w", lambda w: w["skeleton"] == k), level), lambda x: x["level"].isNotNull())))
    tightest = once(found, lambda f: once(F.get(f, F.lit(0))["level"], lambda b: F.struct(b.alias("best"), F.filter(f, lambda x: x["level"] == b).alias("same"))))
    # the generator keeps what it makes from being worked out again for each use
    rows = rows.select("chapter", "verse", "s", F.explode(F.array(tightest)).alias("t")).select("chapter", "verse", "s", F.col("t.best").alias("best"), F.col("t.same").alias("same"), F.col("s.occurrence").alias("k"))
    position = F.get("same", (F.col("k") - 1).cast("int"))["position"]
    n = F.size("same")
    several = F.when(n > 1, F.concat(n, F.lit(" occurrences, took #"), F.col("k")))
    loose = F.when(F.col("best") > 0, F.concat(F.lit("matched "), F.get(F.array(*(F.lit(x) for x in LEVELS)), F.col("best"))))
    note = F.when(F.col("best").isNull(), "no match").when(position.isNull(), "no such occurrence").otherwise(F.nullif(F.concat_ws(", ", several, loose), F.lit("")))
    return rows.select("chapter", "verse", F.col("s.boundary").alias("boundary"), position.alias("after_position"), note.alias("note"))
