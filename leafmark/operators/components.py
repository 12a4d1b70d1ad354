"""Geometry of measured components inside lines: containment, nearest bodies, unions, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NESTED_SHARE, EDGE_PENALTY = 0.35, 10_000


def nested(components: DataFrame) -> DataFrame:
    """Components wholly inside a larger one of their line that is over 1 / 0.35 their size."""
    big = components.select(*(F.col(c).alias(f"big_{c}") for c in ("line", "label", "x", "y", "w", "h", "area")))
    inside = (F.col("line") == F.col("big_line")) & (F.col("label") != F.col("big_label")) & (F.col("big_x") <= F.col("x")) & (F.col("big_y") <= F.col("y")) & (F.col("x") + F.col("w") <= F.col("big_x") + F.col("big_w")) & (F.col("y") + F.col("h") <= F.col("big_y") + F.col("big_h")) & (F.col("area") < NESTED_SHARE * F.col("big_area"))
    return components.join(big, inside, "left_semi")


def nearest_bodies(components: DataFrame) -> DataFrame:
    """Each mark's body: one whose span holds the mark's centre by distance of centres, else by distance of edges.

    Distances are doubled to stay whole numbers; the first body from the right wins ties; a line without bodies gives no rows."""
    body = components.filter("role = 'body'").select("line", F.col("label").alias("body"), F.col("x").alias("bx"), F.col("w").alias("bw"))
    both = components.filter("role = 'mark'").select("line", "label", "x", "w").join(body, "line")
    centre = 2 * F.col("x") + F.col("w")
    left, right = 2 * F.col("bx"), 2 * (F.col("bx") + F.col("bw"))
    away = F.when(centre.between(left, right), F.abs(centre - (2 * F.col("bx") + F.col("bw")))).otherwise(F.least(F.abs(centre - left), F.abs(centre - right)) + 2 * EDGE_PENALTY)
    best = both.groupBy("line", "label").agg(F.min(F.struct(away.alias("away"), (-(F.col("bx") + F.col("bw"))).alias("from_right"), F.col("body"))).alias("best"))
    return best.select("line", "label", F.col("best.body").alias("body"), F.col("best.away").alias("away"))


def interval_union(df: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """Touching or overlapping intervals of a group as one, numbered from the right."""
    w = Window.partitionBy(group).orderBy(left, right)
    reach = F.max(right).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(group, left, right, F.when(reach.isNull() | (F.col(left) > reach), 1).otherwise(0).alias("new"))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(group, "run").agg(F.min(left).alias("left"), F.max(right).alias("right"), F.count("*").alias("merged"))
    return merged.withColumn("ord", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("right")))).select(group, "ord", "left", "right", "merged")


def typical_sizes(components: DataFrame, peak: int) -> DataFrame:
    """Each line's median area of the components that cross the densest row (and 1.0 for none), median height of bodies, and the
    smallest crossing area (0 for none)."""
    crossing = F.when((F.col("y") <= peak) & (peak < F.col("y") + F.col("h")), F.col("area"))
    body = F.when(F.col("role") == "body", F.col("h"))
    return components.groupBy("line").agg(F.median(crossing).alias("median_area"), F.coalesce(F.median(crossing), F.lit(1.0)).alias("typical_area"), F.median(body).alias("median_height"), F.coalesce(F.min(crossing), F.lit(0)).alias("smallest"))


def body_scores(components: DataFrame, bands: DataFrame) -> DataFrame:
    """Scores as a body, and the costs of taking a component as a body or as a mark; halves round to even.

    bands: (line, top, bottom, peak), each line's own. A component scores for crossing the densest row, for its overlap with the band,
    its area against the median of those that cross, and its height; one nested in a larger component loses."""
    rows = components.join(bands, "line").withColumns({"band": F.greatest(F.lit(1), F.col("bottom") - F.col("top") + 1), "crosses": (F.col("y") <= F.col("peak")) & (F.col("peak") < F.col("y") + F.col("h"))})
    typical = rows.groupBy("line").agg(F.coalesce(F.median(F.when(F.col("crosses"), F.col("area"))), F.lit(1.0)).alias("median"))
    inside = nested(components).select("line", "label", F.lit(4).alias("nested"))
    overlap = F.greatest(F.lit(0), F.least(F.col("y") + F.col("h"), F.col("bottom") + 1) - F.greatest("y", "top"))
    raw = 6 * F.col("crosses").cast("int") + 3 * F.least(F.lit(1.0), overlap / F.col("band")) + 3 * F.least(F.lit(1.0), F.col("area") / F.greatest(F.col("median"), F.lit(1.0))) + 2 * F.least(F.lit(1.0), F.col("h") / F.col("band")) - F.coalesce("nested", F.lit(0))
    scored = rows.join(typical, "line").join(inside, ["line", "label"], "left").withColumn("score", F.greatest(F.lit(0), F.bround(F.round(raw, 9), 0)).cast("int"))
    return scored.select("line", "label", "score", (14 - F.col("score")).alias("cost_as_body"), F.least("score", F.lit(6)).alias("cost_as_mark"))


def role_counts(components: DataFrame) -> DataFrame:
    """Components of each line by role, and those whose role is open."""
    by = {"bodies": "body", "marks": "mark", "ornaments": "ornament", "symbols": "symbol"}
    return components.groupBy("line").agg(*(F.count_if(F.col("role") == r).alias(n) for n, r in by.items()), F.count_if("ambiguous").alias("ambiguous"))


def word_boxes(components: DataFrame) -> DataFrame:
    """The box of each body with its marks."""
    near = nearest_bodies(components).select("line", "label", "body")
    own = components.filter("role = 'body'").select("line", F.col("label"), F.col("label").alias("body"))
    parts = components.join(near.unionByName(own), ["line", "label"])
    box = parts.groupBy("line", "body").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.count("*").alias("parts"))
    return box
