"""Boxes of pages and lines: crops, unions, cuts into segments, bands, spans and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["collection_id", "page_number"]
LINE = [*PAGE, "line_number"]


def bound_faults(pages: DataFrame) -> DataFrame:
    """Rows with a bound out of place. pages: first_page, last_page, page_count, n, from_page, to_page."""
    faults = F.array_compact(F.array(
        F.when(~((F.col("first_page") >= 1) & (F.col("first_page") <= F.col("last_page")) & (F.col("last_page") <= F.col("page_count"))), "source_range"),
        F.when(~F.col("n").between(1, F.col("last_page") - F.col("first_page") + 1), "page_number"),
        F.when(~((F.col("from_page") >= 1) & (F.col("from_page") <= F.col("to_page")) & (F.col("to_page") <= F.col("page_count"))), "run_range"),
    ))
    return pages.withColumn("faults", faults).filter(F.size("faults") > 0)


def cropped(pages: DataFrame, width: int, height: int) -> DataFrame:
    """Crop rectangles (x, y, w, h) clamped to the image, mirrored on even pages where margins alternate; an empty one is an error."""
    x = F.when(F.col("alternate") & (F.col("page_number") % 2 == 0), F.lit(width) - (F.col("x") + F.col("w"))).otherwise(F.col("x"))
    box = pages.withColumns({"left": F.greatest(F.lit(0), x), "top": F.greatest(F.lit(0), F.col("y"))})
    box = box.withColumns({"right": F.least(F.lit(width), F.col("left") + F.col("w")), "bottom": F.least(F.lit(height), F.col("top") + F.col("h"))})
    return box.select(*PAGE, "left", "top", "right", "bottom", ((F.col("right") <= F.col("left")) | (F.col("bottom") <= F.col("top"))).alias("empty"))


def page_columns(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Each page's text column: the stored box if it has a width, else the union of its lines, else the stored one."""
    union = lines.groupBy(*PAGE).agg(F.min("x").alias("ux"), F.min("y").alias("uy"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("uw"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("uh"))
    both = pages.join(union, PAGE, "left")
    stored = (F.col("w") > 1) | F.col("ux").isNull()
    return both.select(*PAGE, *(F.when(stored, F.col(c)).otherwise(F.col(f"u{c}")).alias(c) for c in "xywh"))


def export_boxes(lines: DataFrame, segments: DataFrame, pad: int, width: int, height: int) -> DataFrame:
    """Line boxes for export: the union of a text line's segments, the own box of others; padded and clamped to the page."""
    union = segments.groupBy(*LINE).agg(F.min("x").alias("sx"), F.max(F.col("x") + F.col("w")).alias("sr"))
    both = lines.join(union, LINE, "left")
    text = (F.col("type") == "text") & F.col("sx").isNotNull()
    left, right = F.when(text, F.col("sx")).otherwise(F.col("x")), F.when(text, F.col("sr")).otherwise(F.col("x") + F.col("w"))
    return both.select(*LINE, F.greatest(F.lit(0), left - pad).alias("left"), F.greatest(F.lit(0), F.col("y") - pad).alias("top"), F.least(F.lit(width), right + pad).alias("right"), F.least(F.lit(height), F.col("y") + F.col("h") + pad).alias("bottom"))


def content_boxes(cells: DataFrame, group: str, value: str) -> DataFrame:
    """The hull of each group's cells that aren't zero, null if there is none."""
    some = F.col(value) != 0
    return cells.groupBy(group).agg(F.min(F.when(some, F.col("x"))).alias("left"), F.min(F.when(some, F.col("y"))).alias("top"), F.max(F.when(some, F.col("x") + F.col("w"))).alias("right"), F.max(F.when(some, F.col("y") + F.col("h"))).alias("bottom"))


def tightened(headers: DataFrame, content: DataFrame, group: str, margin: int = 10) -> DataFrame:
    """Header boxes drawn in to their content and a margin, never beyond the box; boxes without content stay."""
    hull = content.select(group, *(F.col(c).alias(f"c_{c}") for c in ("left", "top", "right", "bottom")))
    both = headers.join(hull, group, "left")
    return both.select(group, *(F.greatest(c, F.col(f"c_{c}") - margin).alias(c) for c in ("left", "top")), *(F.least(c, F.col(f"c_{c}") + margin).alias(c) for c in ("right", "bottom")))


def cut_segments(lines: DataFrame, share: float = 0.01) -> DataFrame:
    """Segments between a line's cuts, right to left: cuts are rounded and clamped to the line, slivers dropped; a segment closes if its
    left edge is a cut. lines: (key columns, x, w, cuts)."""
    key = [c for c in lines.columns if c not in ("x", "w", "cuts")]
    right, left = F.col("x") + F.col("w"), F.col("x")
    clamped = F.transform("cuts", lambda c: F.greatest(left, F.least(F.greatest(left, right - 1), F.floor(c + 0.5))))
    edges = F.concat(F.array(right), F.reverse(F.array_sort(clamped)), F.array(left))
    rows = lines.withColumn("e", edges).select(*key, "w", "e", F.posexplode(F.slice("e", 2, F.size("e") - 1)).alias("i", "l"))
    wide = rows.withColumn("sw", F.get("e", F.col("i")) - F.col("l")).filter(F.col("sw") >= F.col("w") * share)
    order = F.row_number().over(Window.partitionBy(*key).orderBy("i"))
    return wide.select(*key, order.cast("long").alias("segment_order"), F.col("l").alias("x"), F.greatest(F.lit(1), "sw").alias("w"), (F.col("i") + 2 < F.size("e")).alias("closes"))


def separated_segments(hits: DataFrame, content_left: int, content_right: int, least: int = 20) -> DataFrame:
    """Segments cut at separators' left edges, right to left: a cut that leaves under `least` is skipped and moves no edge; what is left
    over doesn't close; a line without any segment is one. hits: (line, lefts), the lefts in any order.

    A cut depends on the cuts before it, so this is a fold over a line's few hits."""
    none = F.expr("cast(array() as array<bigint>)")
    end = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(content_right))

    def step(acc: Column, hit: Column) -> Column:
        cut = F.least(F.greatest(hit, F.lit(content_left)), end(acc))
        return F.when(end(acc) - cut >= least, F.concat(acc, F.array(cut))).otherwise(acc)

    rows = hits.withColumn("cuts", F.aggregate(F.reverse(F.array_sort("lefts")), none, step))
    rest = end(F.col("cuts"))
    edges = F.concat(F.array(F.lit(content_right).cast("long")), F.col("cuts"), F.when(rest - content_left >= least, F.array(F.lit(content_left).cast("long"))).otherwise(none))
    rows = rows.select("line", F.size("cuts").alias("n"), edges.alias("e"))
    made = rows.filter(F.size("e") > 1).select("line", "n", "e", F.posexplode(F.slice("e", 2, F.size("e") - 1)).alias("i", "left"))
    made = made.select("line", (F.col("i") + 1).cast("long").alias("segment_order"), "left", F.get("e", F.col("i")).alias("right"), (F.col("i") < F.col("n")).alias("closes"))
    whole = rows.filter(F.size("e") < 2).select("line", F.lit(1).cast("long").alias("segment_order"), F.lit(content_left).cast("long").alias("left"), F.lit(content_right).cast("long").alias("right"), F.lit(False).alias("closes"))
    return made.unionByName(whole)


def ordered_bands(bands: DataFrame, group: str) -> DataFrame:
    """Bands numbered from the top, then by their lower edge."""
    return bands.withColumn("line_number", F.row_number().over(Window.partitionBy(group).orderBy("top", "bottom", "id")).cast("long"))


def overlapping(components: DataFrame, segments: DataFrame) -> DataFrame:
    """Components that reach into the hull of their line's chosen segments, and whether they cross its edge."""
    hull = segments.groupBy("line").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"))
    right = F.col("x") + F.col("w")
    inside = components.join(hull, "line").filter((right > F.col("left")) & (F.col("x") < F.col("right")))
    return inside.select("line", "label", ((F.col("x") < F.col("left")) | (right > F.col("right"))).alias("crosses"))


def span_cuts(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """What to keep of the first and last line of each span: left edge (0: all) and right edge (null: all), in image x.

    Lines run from the right. A start keeps all up to its segment's right edge, unless that is the line's first; an end keeps all
    from its segment's left edge on, unless that is the line's last. spans: span_id, from_line, from_order, to_line, to_order, origin."""
    ends = segments.groupBy("line").agg(F.min("segment_order").alias("first"), F.max("segment_order").alias("last"))
    lines = spans.select("span_id", "origin", F.explode(F.array_distinct(F.array("from_line", "to_line"))).alias("line"), "from_line", "from_order", "to_line", "to_order").join(ends, "line")
    at = segments.select("line", F.col("segment_order").alias("o"), "x", "w")
    start = at.select(F.col("line").alias("from_line"), F.col("o").alias("from_order"), (F.col("x") + F.col("w")).alias("start_right"))
    stop = at.select(F.col("line").alias("to_line"), F.col("o").alias("to_order"), F.col("x").alias("stop_left"))
    both = lines.join(start, ["from_line", "from_order"], "left").join(stop, ["to_line", "to_order"], "left")
    left = F.when((F.col("line") == F.col("to_line")) & (F.col("to_order") < F.col("last")), F.greatest(F.lit(0), F.col("stop_left") - F.col("origin"))).otherwise(0)
    right = F.when((F.col("line") == F.col("from_line")) & (F.col("from_order") > F.col("first")), F.greatest(F.lit(0), F.col("start_right") - F.col("origin")))
    return both.select("span_id", "line", left.alias("left"), right.alias("right")).filter("left > 0 or right is not null")


def ornament_spans(segments: DataFrame, origin: int, width: int, template: int) -> DataFrame:
    """Where the ornaments that close segments stand in an image, with the verse that each closes ("" where it isn't numbered)."""
    left = F.col("x") - origin
    label = F.when(F.coalesce("verse", F.lit(0)) != 0, F.concat_ws(":", F.col("chapter").cast("string"), F.col("verse").cast("string"))).otherwise("")
    some = segments.filter("closes").withColumn("l", left).filter((F.col("l") + template > 0) & (F.col("l") < width))
    return some.select("line", "segment_order", F.greatest(F.lit(0), "l").alias("left"), F.least(F.lit(width), F.col("l") + template).alias("right"), label.alias("label"))


def labelled_spans(spans: DataFrame, supplied: DataFrame) -> DataFrame:
    """Merged spans with the label of the last supplied one whose left edge they hold first. spans: (line, ord, left, right); supplied: (line, n, left, label)."""
    s = supplied.select("line", "n", F.col("left").alias("at"), "label")
    first = s.join(spans, "line").filter(F.col("at").between(F.col("left"), F.col("right"))).groupBy("line", "n", "label").agg(F.min("ord").alias("ord"))
    last = first.groupBy("line", "ord").agg(F.max_by("label", "n").alias("label"))
    return spans.join(last, ["line", "ord"], "left").select("line", "ord", "left", "right", "label")


def text_regions(bands: DataFrame, profile: DataFrame, heights: DataFrame, lines: int, slots: int) -> DataFrame:
    """Content between protected bands: regions high enough for 3/4 of a line, with their share of the slots, halves to even, at least one.

    bands: (grp, top, bottom); profile: (grp, position, value); heights: (grp, height)."""
    clamped = bands.join(heights, "grp").select("grp", "height", F.greatest(F.lit(0), F.least("height", "top")).alias("top"), F.greatest(F.lit(0), F.least("height", "bottom")).alias("bottom"))
    ends = clamped.select("grp", "top", "bottom").unionAll(heights.select("grp", F.col("height").alias("top"), F.col("height").alias("bottom")))
    order = Window.partitionBy("grp").orderBy("top", "bottom").rowsBetween(Window.unboundedPreceding, -1)
    gaps = ends.select("grp", F.coalesce(F.max("bottom").over(order), F.lit(0)).alias("from"), F.col("top").alias("to")).filter(F.col("to") > F.col("from"))
    held = gaps.join(profile.filter("value <> 0"), "grp").filter((F.col("position") >= F.col("from")) & (F.col("position") < F.col("to")))
    region = held.groupBy("grp", "from", "to").agg(F.min("position").alias("top"), (F.max("position") + 1).alias("bottom")).withColumn("content", F.col("bottom") - F.col("top"))
    high = region.join(heights, "grp").filter(F.col("content") >= F.greatest(F.lit(1.0), F.bround(F.col("height") / lines * 0.75, 0)))
    whole = F.sum("content").over(Window.partitionBy("grp"))
    return high.select("grp", "top", "bottom", F.greatest(F.lit(1), F.bround(F.col("content") / F.greatest(F.lit(1), whole) * slots, 0).cast("long")).cast("long").alias("slots"))


def ring_candidates(components: DataFrame, least_hole: float = 0.12) -> DataFrame:
    """Bodies that may be hollow rings: tall for their line, nearly square, with a large hole; lines need three bodies."""
    bodies = components.filter("role = 'body'")
    typical = bodies.groupBy("line").agg(F.expr("percentile(h, 0.5)").alias("median"), F.count("*").alias("n")).filter("n >= 3")
    aspect = F.col("w") / F.greatest(F.lit(1), F.col("h"))
    return bodies.join(typical, "line").filter((F.col("h") >= 1.25 * F.col("median")) & aspect.between(0.55, 1.9) & (F.col("hole") >= least_hole)).select("line", "label", F.col("x").alias("left"), (F.col("x") + F.col("w")).alias("right"))


def slot_faults(lines: DataFrame, pages: DataFrame, expected: int) -> DataFrame:
    """Pages without lines, or whose slots don't add up to the expected number, with their lines' heights and slots from the top."""
    by = lines.groupBy(*PAGE).agg(F.sum("slots").alias("detected"), F.sort_array(F.collect_list(F.struct("line_number", "h", "slots"))).alias("l"))
    both = pages.select(*PAGE).join(by, PAGE, "left")
    join = lambda c: F.coalesce(F.array_join(F.transform("l", lambda x: x[c].cast("string")), ","), F.lit(""))
    status = F.when(F.col("l").isNull(), "no_lines").when(F.col("detected") != expected, "line_count_mismatch").otherwise("ok")
    return both.select(*PAGE, status.alias("status"), F.coalesce("detected", F.lit(0)).alias("detected"), join("h").alias("heights"), join("slots").alias("line_slots")).filter("status <> 'ok'")


def batch_status(pages: DataFrame) -> DataFrame:
    """A batch's pages with what became of them: after a failure of line geometry, a cancelled start or the source's end the rest
    is skipped; plain errors stop nothing. pages: batch, page_index, result ('ok', 'error', 'no_lines', 'cancel', 'no_image', ...)."""
    order = Window.partitionBy("batch").orderBy("page_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stops = F.when(F.col("result").isin("no_lines", "line_count_mismatch"), "skipped_batch_abort").when(F.col("result") == "cancel", "skipped_cancelled").when(F.col("result") == "no_image", "skipped_no_image")
    rows = pages.withColumn("stops", stops)
    first = F.first("stops", ignorenulls=True).over(before)
    own = F.when(F.col("result") == "cancel", "skipped_cancelled").when(F.col("result") == "no_image", "skipped_no_image").otherwise(F.col("result"))
    return rows.select("batch", "page_index", F.coalesce(first, own).alias("status"))
