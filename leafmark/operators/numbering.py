"""Chapters and verses numbered over pages by windows: islands, seeds, the walk, rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.sources.shared import dealt

PAGE = ["collection_id", "page_number"]
ORDER = ["page_number", "line_number", "segment_order"]
ORDERED = ["collection_id", *ORDER]


def islands(df: DataFrame, by: str, number: str) -> DataFrame:
    """df with `island`: runs of consecutive numbers have the same."""
    w = Window.partitionBy(by).orderBy(number)
    return df.withColumn("island", F.col(number) - F.row_number().over(w))


def with_seeds(pages: DataFrame) -> DataFrame:
    """Pages with their island and its seed: the first page's settings, or (1, 1)."""
    first = Window.partitionBy("collection_id", "island").orderBy("page_number")
    w = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return islands(pages, "collection_id", "page_number").withColumns({"seed_chapter": F.coalesce(F.first("start_chapter").over(w), F.lit(1)), "seed_verse": F.coalesce(F.first("start_verse").over(w), F.lit(1))})


def walked_rows(pages: DataFrame, lines: DataFrame, segments: DataFrame, seeded: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Headers and text segments in reading order with the chapter and verse that each finds, and those that a header leaves.

    A header moves to the next chapter only if the verse isn't 1, or to its anchor if it has one, and then sets the verse to 1; a
    closing segment ends a verse. After any header the verse is 1, so a header counts if a segment closed since the header before, or,
    as an island's first, if a segment closed or the seed's verse isn't 1. All is sums over windows of an island: islands are spread, not
    the collection. seeded: pages with island, seed_chapter and seed_verse where these don't come from the settings. parts: partitions of the windows."""
    seeds = (with_seeds(pages) if seeded is None else seeded).select(*PAGE, "island", "seed_chapter", "seed_verse")
    anchor = F.col("anchor") if "anchor" in lines.columns else F.lit(None)
    heads = lines.filter("type = 'header'").select(*PAGE, "line_number", F.lit(0).alias("segment_order"), F.lit(True).alias("header"), F.lit(False).alias("closes"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("w"), anchor.cast("long").alias("anchor"))
    texts = segments.select(*PAGE, "line_number", "segment_order", F.lit(False).alias("header"), "closes", "x", "w", F.lit(None).cast("long").alias("anchor"))
    # the smaller side is hashed, so rows are sorted once: by the windows
    rows = dealt(texts.unionByName(heads).join(seeds.hint("shuffle_hash"), PAGE), parts, "collection_id")
    island = Window.partitionBy("collection_id", "island").orderBy(*ORDER)
    upto, before = island.rowsBetween(Window.unboundedPreceding, Window.currentRow), island.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"group": F.sum(F.col("header").cast("long")).over(upto), "closed": F.coalesce(F.sum(F.col("closes").cast("long")).over(before), F.lit(0))})
    # counts never fall, so what had closed by the last header is the greatest of the headers' counts; that way all is one order of an island
    at_header, seed = F.max(F.when(F.col("header"), F.col("closed"))), F.col("seed_verse")
    since = F.col("closed") - F.coalesce(at_header.over(upto), F.lit(0))
    left = F.when(F.col("group") == 1, seed).otherwise(1) + F.col("closed") - F.coalesce(at_header.over(before), F.lit(0))
    rows = rows.withColumns({"since": since, "left_verse": F.when(F.col("header"), left)})
    counts = F.col("header") & F.col("anchor").isNull() & (F.col("left_verse") != 1)
    rows = rows.withColumn("counted", F.sum(counts.cast("long")).over(upto))
    # likewise chapters go on from the last anchor
    at_anchor = F.max(F.when(F.col("anchor").isNotNull(), F.col("counted"))).over(upto)
    chapter = F.coalesce(F.last("anchor", ignorenulls=True).over(upto), "seed_chapter") + F.col("counted") - F.coalesce(at_anchor, F.lit(0))
    verse = F.when(F.col("header"), 1).when(F.col("group") == 0, seed).otherwise(1) + F.when(F.col("header"), 0).otherwise(F.col("since"))
    rows = rows.withColumns({"chapter": chapter, "verse": verse})
    return rows.withColumn("left_chapter", F.when(F.col("header"), F.coalesce(F.lag("chapter").over(island), "seed_chapter")))


NUMBERED = ["collection_id", "page_number", "line_number", "segment_order", "closes", "x", "w", "chapter", "verse"]


def walk(pages: DataFrame, lines: DataFrame, segments: DataFrame, parts: int | None = None) -> DataFrame:
    """Each text segment with its chapter and verse."""
    return walked_rows(pages, lines, segments, parts=parts).filter(~F.col("header")).select(*NUMBERED)


def anchored_warnings(pages: DataFrame, lines: DataFrame, segments: DataFrame, expected: DataFrame, parts: int | None = None) -> DataFrame:
    """Where an anchored walk disagrees with the expected numbers of verses: segments beyond a chapter's last verse (overflow), and
    headers that leave a chapter before or after its last (boundary). lines may have anchors on headers."""
    rows = walked_rows(pages, lines, segments, parts=parts)
    want = expected.select("chapter", "expected")
    over = rows.filter(~F.col("header")).join(want, "chapter").filter(F.col("verse") > F.col("expected")).select(*ORDERED, F.lit("overflow").alias("warning"), "chapter", "verse")
    bad = rows.filter(F.col("header") & (F.col("left_verse") != 1)).join(want.withColumnRenamed("chapter", "left_chapter"), "left_chapter").filter(F.col("left_verse") - 1 != F.col("expected"))
    return over.unionByName(bad.select(*ORDERED, F.lit("boundary").alias("warning"), F.col("left_chapter").alias("chapter"), F.col("left_verse").alias("verse")))


def exit_states(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """(collection_id, page_number, chapter, verse): the state in which a page's stored numbers leave it.

    That is the last line's chapter (1 if null), and verse 1 unless the line is text and its last segment is numbered: then that
    one's verse, or the next if it closes."""
    last = lines.groupBy(*PAGE).agg(F.max(F.struct("line_number", "type", F.coalesce("chapter", F.lit(1)).alias("chapter"))).alias("l"))
    ends = segments.groupBy(*PAGE, "line_number").agg(F.max(F.struct("segment_order", "verse", "closes")).alias("s"))
    both = last.select(*PAGE, F.col("l.line_number").alias("line_number"), F.col("l.type").alias("type"), F.col("l.chapter").alias("chapter")).join(ends, [*PAGE, "line_number"], "left")
    verse = F.when((F.col("type") == "text") & F.col("s.verse").isNotNull(), F.col("s.verse") + F.col("s.closes").cast("long")).otherwise(1)
    return both.select(*PAGE, "chapter", verse.alias("verse"))


def entry_states(pages: DataFrame, lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Each page's entry: the exit of the page before if there is one (1, 1 if that has no lines), else the settings, else (1, 1)."""
    ends = exit_states(lines, segments).select("collection_id", (F.col("page_number") + 1).alias("page_number"), F.col("chapter").alias("e_chapter"), F.col("verse").alias("e_verse"))
    before = pages.select("collection_id", (F.col("page_number") + 1).alias("page_number"), F.lit(True).alias("has_previous"))
    both = pages.join(before, PAGE, "left").join(ends, PAGE, "left")
    state = lambda e, s: F.when(F.col("has_previous"), F.coalesce(e, F.lit(1))).otherwise(F.coalesce(s, F.lit(1)))
    return both.select(*PAGE, state("e_chapter", "start_chapter").alias("chapter"), state("e_verse", "start_verse").alias("verse"))


def renumber_plan(pages: DataFrame, lines: DataFrame, segments: DataFrame, expected: DataFrame) -> DataFrame:
    """(collection_id, chapter, closing, expected): chapters whose closing segments differ from the expected number.

    Only chapters that an island enters at verse 1 and leaves by a header are checked; their closings add up over all islands."""
    rows = walked_rows(pages, lines, segments)
    ends = rows.groupBy("collection_id", "island").agg(F.max("chapter").alias("last"), F.min("seed_chapter").alias("seed"), F.min("seed_verse").alias("seed_verse"))
    entered = rows.select("collection_id", "island", "chapter").distinct().join(ends, ["collection_id", "island"])
    whole = entered.filter((F.col("chapter") < F.col("last")) & ((F.col("chapter") > F.col("seed")) | (F.col("seed_verse") == 1))).select("collection_id", "chapter").distinct()
    closing = rows.filter("closes").groupBy("collection_id", "chapter").agg(F.count("*").alias("closing"))
    both = whole.join(expected, "chapter").join(closing, ["collection_id", "chapter"], "left").withColumn("closing", F.coalesce("closing", F.lit(0)))
    return both.filter("closing <> expected").select("collection_id", "chapter", "closing", "expected")


def held_chapters(numbered: DataFrame) -> DataFrame:
    """Chapters that a collection holds: first and last verse, first and last page, pages and closing segments."""
    return numbered.groupBy("collection_id", "chapter").agg(F.min("verse").alias("first_verse"), F.max("verse").alias("last_verse"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count_distinct("page_number").alias("n_pages"), F.count_if("closes").alias("closing"))


def ending_pages(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(collection_id, page_number, from_page): pages with a header, and where the chapter that ends on each begins: the last page with a
    header before, or the collection's first."""
    heads = lines.filter("type = 'header'").select(*PAGE).distinct().withColumn("header", F.lit(True))
    w = Window.partitionBy("collection_id").orderBy("page_number")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.select(*PAGE).join(heads, PAGE, "left")
    rows = rows.withColumns({"last_header": F.last(F.when(F.col("header"), F.col("page_number")), ignorenulls=True).over(before), "first": F.min("page_number").over(before)})
    return rows.filter("header and first is not null").select(*PAGE, F.coalesce("last_header", "first").alias("from_page"))


def dirty_pages(lines: DataFrame, baseline: DataFrame) -> DataFrame:
    """Pages whose structure differs from a baseline's: by a digest of their lines in order, or held by one side only."""
    def digests(df: DataFrame, name: str) -> DataFrame:
        each = F.sort_array(F.collect_list(F.struct("line_number", "type", "x", "y", "w", "h")))
        return df.groupBy(*PAGE).agg(F.sha2(F.to_json(each), 256).alias(name))

    both = digests(lines, "new").join(digests(baseline, "old"), PAGE, "full")
    return both.filter(~F.col("new").eqNullSafe(F.col("old"))).select(*PAGE, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("state"))


def verse_rectangles(numbered: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for each rectangle of a verse on a page, verses in order of first appearance."""
    page = ["collection_id", "page_number"]
    rect = Window.partitionBy(*page, "chapter", "verse").orderBy("line_number", "segment_order")
    rows = numbered.withColumns({"first": F.first(F.struct("line_number", "segment_order")).over(rect), "rect_order": F.row_number().over(rect)})
    rows = rows.withColumn("verse_order", F.dense_rank().over(Window.partitionBy(*page).orderBy("first", "chapter", "verse")))
    boxes = rows.join(lines.select(*page, "line_number", "y", "h").hint("shuffle_hash"), [*page, "line_number"])
    return boxes.select(*page, "verse_order", "chapter", "verse", "rect_order", "x", "y", "w", "h")


def basmala_lines(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """The first line after a header is a basmala if none of its segments closes; headers may stand on an earlier page."""
    key = ["collection_id", "page_number", "line_number"]
    closing = segments.groupBy(*key).agg(F.bool_or("closes").alias("any_closes"))
    order = Window.partitionBy("collection_id").orderBy("page_number", "line_number")
    rows = lines.join(closing, key, "left").withColumn("previous", F.lag("type").over(order))
    return rows.filter((F.col("type") != "header") & (F.col("previous") == "header")).select(*key, (~F.coalesce("any_closes", F.lit(False))).alias("basmala"))
