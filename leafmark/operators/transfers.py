"""Renumbering by pages: each page as a function from the state in which it is entered to that in which it is left, composed by a scan.

A page's function needs its closings before the first header, how many later headers count, and its closings after the last header: a state
(chapter, verse) is left as (chapter, verse + closings) where there is no header, else as (chapter + [verse + closings before isn't 1] +
later headers that count, 1 + closings after the last). Likewise one row a page says which entry states leave its stored numbers as
they are. So states run over one row a page, not over lines and segments, and lines are numbered in windows of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.numbering import PAGE, entry_states, islands


def page_rows(lines: DataFrame, segments: DataFrame, only: DataFrame | None = None, keep: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Lines (segment_order null) and their segments with what stands before each on its page: group (headers so far), since (closings
    since the last of these) and steps (headers from the second on that end a verse). stored: the line's chapter or the segment's verse.

    lines: page, line_number, type, chapter; segments: page, line_number, segment_order, closes, verse; only text lines have any that count.
    only: pages (PAGE) beside which others are left out; keep: more columns, null where a side lacks them. Rows are dealt out by page once, in so many parts."""
    own = lambda df, taken: [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in keep if c not in taken]
    fixed = ("closes",)
    heads = lines.select(*PAGE, "line_number", F.lit(None).cast("int").alias("segment_order"), (F.col("type") == "header").alias("header"), F.lit(False).alias("closes"), F.col("chapter").cast("long").alias("stored"), (F.col("type") == "text").alias("text"), *own(lines, fixed))
    texts = segments.select(*PAGE, "line_number", "segment_order", F.lit(False).alias("header"), "closes", F.col("verse").cast("long").alias("stored"), F.lit(None).cast("boolean").alias("text"), *own(segments, fixed))
    both = heads.unionByName(texts)
    rows = both.repartition(parts, *PAGE) if parts else both.repartition(*PAGE)
    if only is not None:
        rows = rows.join(only.select(*PAGE).hint("shuffle_hash"), PAGE, "left_semi")
    # both windows run over one order: a line, then its segments
    line = Window.partitionBy(*PAGE, "line_number").orderBy(F.col("segment_order").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("text", F.max("text").over(line)).filter("segment_order is null or text").drop("text")
    w = Window.partitionBy(*PAGE).orderBy("line_number", F.col("segment_order").asc_nulls_first())
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"group": F.sum(F.col("header").cast("int")).over(upto), "closed": F.coalesce(F.sum(F.col("closes").cast("long")).over(before), F.lit(0).cast("long"))})
    last = F.max(F.when(F.col("header"), F.col("closed")))
    rows = rows.withColumns({"since": F.col("closed") - F.coalesce(last.over(upto), F.lit(0)), "step": (F.col("header") & (F.col("group") > 1) & (F.col("closed") > last.over(before))).cast("int")})
    return rows.withColumn("steps", F.sum("step").over(upto)).drop("closed", "step")


def page_functions(rows: DataFrame) -> DataFrame:
    """One row a page: headed, first (closings before a header), later, last (closings after the last header), and the entry states that
    change nothing: whole is false if none does; verse, head_chapter, tail_chapter are what they must be, null where anything will do."""
    line, early = F.col("segment_order").isNull(), F.col("group") == 0
    verse = F.when(~line & early, F.coalesce(F.col("stored") - F.col("since"), F.lit(-1)))
    head = F.when(line & early, F.coalesce("stored", F.lit(-1)))
    tail = F.when(line & ~early, F.coalesce(F.col("stored") - F.col("steps"), F.lit(-1)))
    right = F.when(~line & ~early, F.col("stored").eqNullSafe(F.col("since") + 1))
    per_group = rows.groupBy(*PAGE, "group").agg(F.sum(F.col("closes").cast("long")).alias("closings"), F.max("steps").alias("later"), *(f(c).alias(f"{n}_{side}") for n, c in (("verse", verse), ("head", head), ("tail", tail)) for side, f in (("low", F.min), ("high", F.max))), F.bool_and(right).alias("right"))
    same = lambda n: F.coalesce(F.min(f"{n}_low") == F.max(f"{n}_high"), F.lit(True))
    return per_group.groupBy(*PAGE).agg(
        (F.max("group") > 0).alias("headed"), F.coalesce(F.sum(F.when(F.col("group") == 0, F.col("closings"))), F.lit(0)).alias("first"), F.max("later").alias("later"), F.max_by("closings", "group").alias("last"),
        (F.coalesce(F.bool_and("right"), F.lit(True)) & same("verse") & same("head") & same("tail")).alias("whole"), F.min("verse_low").alias("must_verse"), F.min("head_low").alias("must_head"), F.min("tail_low").alias("must_tail"),
    )


def entered(pages: DataFrame, functions: DataFrame, by: list[str]) -> DataFrame:
    """pages with the state (chapter, verse) in which each is entered, and whether its stored numbers change.

    pages: PAGE, seed_chapter and seed_verse, the state in which each run of pages (`by`, in page order) begins. A page without lines passes
    its state on and doesn't change."""
    rows = pages.join(functions, PAGE, "left").withColumns({"headed": F.coalesce("headed", F.lit(False)), "first": F.coalesce("first", F.lit(0)), "last": F.coalesce("last", F.lit(0)), "later": F.coalesce("later", F.lit(0))})
    w = Window.partitionBy(*by).orderBy("page_number")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # closings since the last header, over the pages before
    rows = rows.withColumns({"headed_before": F.sum(F.col("headed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "gives": F.when(F.col("headed"), F.col("last")).otherwise(F.col("first"))})
    run = Window.partitionBy(*by, "headed_before").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    left = F.when(F.col("headed_before") == 0, F.col("seed_verse")).otherwise(1) + F.sum("gives").over(run)
    rows = rows.withColumn("left_verse", left).withColumn("verse", F.coalesce(F.lag("left_verse").over(w), "seed_verse"))
    moved = F.col("headed") & (F.col("verse") + F.col("first") != 1)
    rows = rows.withColumns({"moved": moved.cast("int"), "adds": moved.cast("int") + F.when(F.col("headed"), F.col("later")).otherwise(0)})
    rows = rows.withColumn("chapter", F.col("seed_chapter") + F.coalesce(F.sum("adds").over(before), F.lit(0)))
    free = lambda must, now: F.col(must).isNull() | (F.col(must) == now)
    same = F.coalesce("whole", F.lit(True)) & free("must_verse", F.col("verse")) & free("must_head", F.col("chapter")) & free("must_tail", F.col("chapter") + F.col("moved"))
    return rows.withColumn("changes", ~same).select(*pages.columns, "chapter", "verse", "moved", "changes")


def numbered(rows: DataFrame, entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines and segments of the pages in entries with the numbers that they find: chapter, and verse for segments; keep: more columns of rows."""
    at = entries.select(*PAGE, F.col("chapter").alias("chapter0"), F.col("verse").alias("verse0"), "moved")
    early, line = F.col("group") == 0, F.col("segment_order").isNull()
    both = rows.join(at, PAGE)
    chapter = F.col("chapter0") + F.when(early, 0).otherwise(F.col("moved") + F.col("steps"))
    verse = F.when(~line, F.when(early, F.col("verse0")).otherwise(1) + F.col("since"))
    both = both.withColumns({"chapter": chapter, "verse": verse})
    changed = ~F.when(line, F.col("stored").eqNullSafe(F.col("chapter"))).otherwise(F.col("stored").eqNullSafe(F.col("verse")))
    return both.select(*PAGE, "line_number", "segment_order", "chapter", "verse", changed.alias("changed"), *keep)


def renumbered_from(pages: DataFrame, lines: DataFrame, segments: DataFrame, start: DataFrame, parts: int | None = None) -> DataFrame:
    """Lines (segment_order and verse null) and segments that a renumbering from one page on changes, with their new numbers.

    It goes forward from the entry state, and stops at a gap or after the first page of which it changes neither a line's chapter, headers
    and formulas too, nor a segment's verse. Only pages up to there are numbered; those after are one row each, and those before the first aren't read
    but for the one that gives the entry state. start: (collection_id, from_page); lines and segments carry stored numbers (chapter, verse); parts: partitions of their rows."""
    near = start.select("collection_id", F.explode(F.array(F.col("from_page") - 1, F.col("from_page"))).alias("page_number"))
    before = start.select("collection_id", (F.col("from_page") - 1).alias("page_number"))
    entry = entry_states(pages.join(near, PAGE, "left_semi"), lines.join(before, PAGE, "left_semi"), segments.join(before, PAGE, "left_semi"))
    seeds = start.join(entry.select("collection_id", F.col("page_number").alias("from_page"), F.col("chapter").alias("seed_chapter"), F.col("verse").alias("seed_verse")), ["collection_id", "from_page"])
    later = islands(pages.select(*PAGE).join(seeds, "collection_id").filter("page_number >= from_page"), "collection_id", "page_number")
    # the first page's own island: its number is the first page's less one
    held = later.filter("island = from_page - 1").select(*PAGE, "seed_chapter", "seed_verse")
    rows = page_rows(lines, segments, only=held, parts=parts)
    states = entered(held, page_functions(rows), ["collection_id"])
    so_far = Window.partitionBy("collection_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    live = states.withColumn("live", F.bool_and("changes").over(so_far)).filter("live")
    return numbered(rows, live).filter("changed").drop("changed")


def renumber_changes(pages: DataFrame, lines: DataFrame, segments: DataFrame) -> DataFrame:
    """(collection_id, lines, segments, lines_changed, segments_changed): what a walk over all islands would change of stored numbers.

    pages: PAGE, island, seed_chapter and seed_verse (numbering.with_seeds)."""
    rows = page_rows(lines, segments)
    seeded = pages.select(*PAGE, "island", "seed_chapter", "seed_verse")
    found = numbered(rows, entered(seeded, page_functions(rows), ["collection_id", "island"]))
    line = F.col("segment_order").isNull()
    return found.groupBy("collection_id").agg(F.count_if(line).alias("lines"), F.count_if(~line).alias("segments"), F.count_if(line & F.col("changed")).alias("lines_changed"), F.count_if(~line & F.col("changed")).alias("segments_changed"))
