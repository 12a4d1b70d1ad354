"""Plans of a run over numbered lines: islands of verses, gaps between them, chunks, and what a run gave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.sources.shared import dealt

ENTRY = ["collection_id", "page_number", "line_number", "segment_order", "chapter", "verse"]


def span_entries(numbered: DataFrame, spans: DataFrame) -> DataFrame:
    """Numbered segments of each collection's requested verses. spans: (collection_id, from_chapter, from_verse, to_chapter, to_verse)."""
    inside = F.struct("chapter", "verse").between(F.struct(F.col("from_chapter"), F.col("from_verse")), F.struct(F.col("to_chapter"), F.col("to_verse")))
    return numbered.filter("chapter is not null and verse is not null").join(spans.hint("shuffle_hash"), "collection_id").filter(inside).select(*ENTRY)


def verse_islands(entries: DataFrame, last_verses: DataFrame) -> DataFrame:
    """Entries with `island`: in reading order a verse must be the one before or its successor, else a new island begins.

    last_verses: (chapter, last); the successor of a chapter's last verse is the next chapter's first, if there is such a chapter."""
    w = Window.partitionBy("collection_id").orderBy("page_number", "line_number", "segment_order")
    rows = entries.withColumns({"p_chapter": F.lag("chapter").over(w), "p_verse": F.lag("verse").over(w)})
    last = last_verses.select(F.col("chapter").alias("p_chapter"), "last")
    following = last_verses.select((F.col("chapter") - 1).alias("p_chapter"), F.lit(True).alias("has_next"))
    rows = rows.join(last, "p_chapter", "left").join(following, "p_chapter", "left")
    same = (F.col("chapter") == F.col("p_chapter")) & (F.col("verse") == F.col("p_verse"))
    step = (F.col("chapter") == F.col("p_chapter")) & (F.col("verse") == F.col("p_verse") + 1) & (F.col("p_verse") < F.col("last"))
    turn = (F.col("chapter") == F.col("p_chapter") + 1) & (F.col("verse") == 1) & (F.col("p_verse") >= F.col("last")) & F.coalesce("has_next", F.lit(False))
    breaks = F.when(F.col("p_chapter").isNull() | F.coalesce(same | step | turn, F.lit(False)), 0).otherwise(1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("breaks", breaks).withColumn("island", F.sum("breaks").over(upto)).select(*ENTRY, "island")


def gaps(islands: DataFrame, lines: DataFrame, parts: int | None = None) -> DataFrame:
    """What lies between an island and the next: the verses and pages on both sides, and lines between them without a number in either.

    Islands are runs in reading order, so all lines strictly between two have no number in either. One pass: both ends of each gap are put
    among the lines, and a count of lines so far gives each gap's as a difference."""
    place = F.struct("page_number", "line_number", "segment_order")
    ends = islands.groupBy("collection_id", "island").agg(F.min(F.struct(place.alias("p"), "chapter", "verse")).alias("a"), F.max(F.struct(place.alias("p"), "chapter", "verse")).alias("z"))
    w = Window.partitionBy("collection_id").orderBy("island")
    pairs = ends.withColumn("next", F.lead("a").over(w)).filter("next is not null")
    # the far end stands before a line of its own place, the near end after it
    side = lambda c, order: F.struct(F.col(c)["page_number"].alias("page_number"), F.col(c)["line_number"].alias("line_number"), F.lit(order).alias("order"))
    marks = pairs.select("collection_id", "island", F.explode(F.array(side("next.p", 0), side("z.p", 2))).alias("m")).select("collection_id", "m.*", "island")
    all_ = lines.select("collection_id", "page_number", "line_number", F.lit(1).alias("order"), F.lit(None).cast("long").alias("island")).unionByName(marks)
    order = Window.partitionBy("collection_id").orderBy("page_number", "line_number", "order").rowsBetween(Window.unboundedPreceding, 0)
    so_far = dealt(all_, parts, "collection_id").withColumn("lines", F.count_if(F.col("order") == 1).over(order)).filter("island is not null")
    n = so_far.groupBy("collection_id", "island").agg(F.greatest(F.sum(F.when(F.col("order") == 0, F.col("lines")).otherwise(-F.col("lines"))), F.lit(0)).alias("unnumbered"))
    named = pairs.select("collection_id", "island", F.col("z.chapter").alias("after_chapter"), F.col("z.verse").alias("after_verse"), F.col("z.p.page_number").alias("after_page"), F.col("next.chapter").alias("before_chapter"), F.col("next.verse").alias("before_verse"), F.col("next.p.page_number").alias("before_page"))
    return named.join(n.hint("shuffle_hash"), ["collection_id", "island"])


def chunks(islands: DataFrame, last_verses: DataFrame, target: int = 60) -> DataFrame:
    """(collection_id, island, chunk, from_chapter, from_verse, to_chapter, to_verse): an island cut after `target` distinct lines, at ends
    of verses only. The verse on which the count is reached is the last of its chunk, though it may run on; the line of a cut counts for
    both chunks; nothing is cut at or past the island's last verse. A verse that runs on over
    `target` lines more is cut again, and the chunk between those cuts is empty: it ends before it begins.

    Where a cut falls depends on the cut before, so this is a fold over an island's entries, which a window has put in order."""
    v = lambda c, n: F.struct(c.alias("chapter"), n.alias("verse"))
    rows = islands.join(last_verses, "chapter", "left").join(last_verses.select((F.col("chapter") - 1).alias("chapter"), F.lit(True).alias("has_next")), "chapter", "left")
    following = F.when(F.col("verse") < F.col("last"), v(F.col("chapter"), F.col("verse") + 1)).when(F.coalesce("has_next", F.lit(False)), v(F.col("chapter") + 1, F.lit(1).cast("long")))
    item = F.struct("page_number", "line_number", "segment_order", v(F.col("chapter"), F.col("verse")).alias("v"), following.alias("f"))
    by = rows.groupBy("collection_id", "island").agg(F.array_sort(F.collect_list(item)).alias("e"))
    by = by.withColumns({"first": F.col("e")[0]["v"], "end": F.element_at("e", -1)["v"]})
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("page"), F.lit(-1).alias("line"), F.expr("cast(array() AS array<struct<at:struct<chapter:bigint,verse:bigint>,f:struct<chapter:bigint,verse:bigint>>>)").alias("cuts"))

    def step(s, x):
        new = (s["page"] != x["page_number"]) | (s["line"] != x["line_number"])
        n = s["n"] + F.when(new, 1).otherwise(0)
        cut = (n >= target) & (x["v"] < F.col("end")) & x["f"].isNotNull() & (x["f"] <= F.col("end"))
        return F.struct(F.when(cut, 1).otherwise(n).alias("n"), x["page_number"].alias("page"), x["line_number"].alias("line"), F.when(cut, F.concat(s["cuts"], F.array(F.struct(x["v"].alias("at"), x["f"].alias("f"))))).otherwise(s["cuts"]).alias("cuts"))

    cuts = by.select("collection_id", "island", "first", "end", F.aggregate("e", start, step, lambda s: s["cuts"]).alias("c"))
    ends = F.concat(F.transform("c", lambda x: x["at"]), F.array("end"))
    begins = F.concat(F.array("first"), F.transform("c", lambda x: x["f"]))
    made = cuts.select("collection_id", "island", F.posexplode(F.arrays_zip(begins.alias("a"), ends.alias("z"))).alias("chunk", "s"))
    return made.select("collection_id", "island", F.col("chunk").cast("long").alias("chunk"), F.col("s.a.chapter").alias("from_chapter"), F.col("s.a.verse").alias("from_verse"), F.col("s.z.chapter").alias("to_chapter"), F.col("s.z.verse").alias("to_verse"))


def verse_places(numbered: DataFrame) -> DataFrame:
    """Where each verse's first and last segment stand."""
    place = F.struct("page_number", "line_number", "segment_order")
    by = numbered.groupBy("collection_id", "chapter", "verse").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    return by.select("collection_id", "chapter", "verse", *(F.col(f"{e}.{c}").alias(f"{n}_{c}") for e, n in (("a", "first"), ("z", "last")) for c in ("page_number", "line_number", "segment_order")))


def available_spans(collections: DataFrame, numbered: DataFrame) -> DataFrame:
    """The first and last numbered verse of each collection in reading order, null where there is none."""
    place, verse = F.struct("page_number", "line_number", "segment_order"), F.struct("chapter", "verse")
    some = numbered.filter("chapter is not null and verse is not null").groupBy("collection_id").agg(F.min_by(verse, place).alias("a"), F.max_by(verse, place).alias("z"))
    both = collections.select("collection_id").join(some, "collection_id", "left")
    return both.select("collection_id", F.col("a.chapter").alias("from_chapter"), F.col("a.verse").alias("from_verse"), F.col("z.chapter").alias("to_chapter"), F.col("z.verse").alias("to_verse"))


STATUSES = ("exact", "scored", "partial", "unresolved")


def run_totals(lines: DataFrame, words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines, lines by status, words, the share of lines to look at, and chunks that don't account for all words of their span, for each run
    and (run null, whole true) over all.

    lines: run, chunk, line, status; words: run, line; chunks: run, chunk and expected, the words of its span."""
    n = words.groupBy("run", "line").agg(F.count("*").alias("words"))
    rows = lines.join(n, ["run", "line"], "left").withColumn("words", F.coalesce("words", F.lit(0)))
    parts = rows.groupBy("run", "chunk").agg(F.count("*").alias("lines"), F.sum("words").alias("words"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    both = chunks.join(parts, ["run", "chunk"], "full").fillna(0, ["lines", "words", "expected", *STATUSES])
    by = both.rollup("run").agg(F.grouping("run").alias("g"), *(F.sum(c).alias(c) for c in ("lines", "words", *STATUSES)), F.count_if(F.col("words") < F.col("expected")).alias("incomplete"))
    flagged = F.when(F.col("lines") > 0, (F.col("lines") - F.col("exact")) / F.col("lines")).otherwise(0.0)
    return by.select("run", (F.col("g") == 1).alias("whole"), "lines", "words", *STATUSES, F.round(flagged, 6).alias("flagged"), "incomplete")


def run_report(lines: DataFrame, words: DataFrame, ornaments: DataFrame, most: int) -> DataFrame:
    """One JSON row for each run: totals of all statuses, separators found, and its lines in order, with their words and ornaments up to `most`
    lines, else with word counts alone.

    lines: run, line, status; words: run, line, position, word_id; ornaments: run, line, left, right."""
    item = F.sort_array(F.collect_list(F.struct("position", "word_id")))
    by_line = words.groupBy("run", "line").agg(F.transform(item, lambda x: x["word_id"]).alias("w"))
    marks = ornaments.groupBy("run", "line").agg(F.sort_array(F.collect_list(F.struct("left", "right"))).alias("o"))
    rows = lines.join(by_line, ["run", "line"], "left").join(marks, ["run", "line"], "left")
    rows = rows.withColumns({"w": F.coalesce("w", F.array().cast("array<bigint>")), "o": F.coalesce("o", F.array().cast("array<struct<left:bigint,right:bigint>>"))})
    by = rows.groupBy("run").agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.sum(F.size("o")).alias("separators"), F.sort_array(F.collect_list(F.struct("line", "status", "w", "o"))).alias("l"))
    full = F.transform("l", lambda x: F.struct(x["line"].alias("line"), x["status"].alias("status"), F.size(x["o"]).alias("separators"), x["w"].alias("words"), x["o"].alias("ornaments")))
    slim = F.transform("l", lambda x: F.struct(x["line"].alias("line"), x["status"].alias("status"), F.size(x["o"]).alias("separators"), F.size(x["w"]).alias("word_count")))
    head = lambda lines: F.to_json(F.struct(F.col("n").alias("lines"), F.col("separators").alias("separators_found"), F.struct(*STATUSES).alias("totals"), lines.alias("detail")))
    return by.select("run", (F.col("n") <= most).alias("full"), F.when(F.col("n") <= most, head(full)).otherwise(head(slim)).alias("report"))
