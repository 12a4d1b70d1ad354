"""Series (group, position, value): profiles, averages, minima and picks; every window stays in its group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.sources.shared import ship

#: Positions that one task goes over at a time.
TILE = 4096


def profile(components: DataFrame, group: str) -> DataFrame:
    """Ink in each row of a group's content: the widths (whole numbers) of the components that cover it, 0 for rows between that none covers.

    A component adds its width where it begins and takes it away where it ends, so two rows of each go through one window over a group, and a
    row of the profile is made once, when it is given out."""
    ends = F.explode(F.array(F.struct(F.col("y").alias("position"), F.col("w").alias("change")), F.struct((F.col("y") + F.col("h")).alias("position"), (-F.col("w")).alias("change")))).alias("e")
    rows = components.filter("y is not null and h is not null").select(F.col(group).alias("grp"), ends).select("grp", "e.*")
    w = Window.partitionBy("grp").orderBy("position")
    value = F.coalesce(F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("double")
    # of changes at one position the last has the sum of all, and only it has the next beyond itself
    rows = rows.withColumns({"value": value, "next": F.lead("position").over(w)}).filter("next > position")
    return rows.select("grp", F.explode(F.sequence("position", F.col("next") - 1)).alias("position"), "value")


def filled(df: DataFrame, group: str = "grp", position: str = "position", value: str = "value") -> DataFrame:
    """Missing positions between a group's first and last with value 0."""
    ends = df.groupBy(group).agg(F.min(position).alias("a"), F.max(position).alias("b"))
    every = ends.select(group, F.explode(F.sequence("a", "b")).alias(position))
    return every.join(df, [group, position], "left").select(group, position, F.coalesce(value, F.lit(0)).cast("double").alias(value))


def moving_average(df: DataFrame, width: int, group: str = "grp", position: str = "position", value: str = "value") -> DataFrame:
    """Centred sums over an odd width, always divided by the width: positions outside count as 0."""
    half = width // 2
    w = Window.partitionBy(group).orderBy(position).rowsBetween(-half, half)
    return df.withColumn("smooth", F.sum(value).over(w) / width)


def local_minima(df: DataFrame, group: str = "grp", position: str = "position", value: str = "smooth") -> DataFrame:
    """Positions not above either neighbour and below one; ends excluded."""
    w = Window.partitionBy(group).orderBy(position)
    a, v, b = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    marked = df.withColumns({"_a": a, "_b": b})
    return marked.filter((F.col("_a") >= v) & (v <= F.col("_b")) & ((F.col("_a") > v) | (v < F.col("_b")))).drop("_a", "_b")


def _apart(apart: float):
    """Greedy picks of one cluster of candidates. Two picks can't stand in one bin of the least distance, so a candidate meets three bins at most."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, keep = {}, []
        for score, at, k in sorted(zip(-rows["_score"], rows["_at"], range(len(rows)), strict=True)):
            bin_ = int(at // apart) if apart > 0 else at
            if apart <= 0 or all(abs(held.get(b, math.inf) - at) >= apart for b in (bin_ - 1, bin_, bin_ + 1)):
                held[bin_] = at
                keep.append(k)
        return rows.iloc[keep][["_grp", "_at", "_score"]]

    return run


def strongest_apart(df: DataFrame, most: int, apart: int, group: str = "grp", position: str = "position", score: str = "score") -> DataFrame:
    """Greedily the strongest positions at least `apart` from each other, earlier ones first at ties.

    Candidates with a gap of `apart` or more between them don't meet, so each cluster between such gaps is picked by itself, and the
    first `most` of a group are ranked after that."""
    ship(df.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(F.col(group).alias("_grp"), F.col(position).alias("_at"), F.col(score).cast("double").alias("_score"))
    w = Window.partitionBy("_grp").orderBy("_at")
    rows = rows.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(w) >= apart).cast("int"), F.lit(0)))
    rows = rows.withColumn("_cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    picked = rows.groupBy("_grp", "_cluster").applyInPandas(_apart(apart), f"_grp {kind[group]}, _at {kind[position]}, _score double")
    rank = F.row_number().over(Window.partitionBy("_grp").orderBy(F.desc("_score"), "_at"))
    return picked.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.col("_grp").alias(group), "rank", F.col("_at").alias(position))


def _walls(values: list[float], asked: list[int]) -> tuple[list[tuple[float, bool]], list[tuple[float, float]], float]:
    """What a tile says about walls on the left: for each asked place the highest value from the nearest lower one on, and whether there is one;
    the minima that a place further right can end at, from left to right, each with the highest value after it up to the next; and the
    highest value before the first of them.

    stack: places whose values rise, each with the highest value after it so far."""
    stack: list[list[float]] = []
    base, wanted, found = -math.inf, set(asked), {}
    for k, v in enumerate(values):
        high = -math.inf
        while stack and stack[-1][0] >= v:
            u, after = stack.pop()
            high = max(high, u, after)
        if k in wanted:
            lower = bool(stack)
            found[k] = (max(high, stack[-1][1], v) if lower else max(high, base, v), lower)
        if stack:
            stack[-1][1] = max(stack[-1][1], high)
        else:
            base = max(base, high)
        stack.append([v, -math.inf])
    return [found[k] for k in asked], [(v, after) for v, after in stack], base


_TILE = "_grp {g}, _tile long, _at {p}, _v double, left double, left_done boolean, right double, right_done boolean, ends array<double>, starts array<double>, top double"


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """A tile's minima with their walls inside it, and one more row of what other tiles need to know of it."""
    rows = rows.sort_values("_at").reset_index(drop=True)
    values, n = rows["_v"].tolist(), len(rows)
    asked = rows.index[rows["_min"]].tolist()
    left, ends, before = _walls(values, asked)
    right, starts, after = _walls(values[::-1], [n - 1 - k for k in asked])
    out = rows.loc[asked, ["_grp", "_tile", "_at", "_v"]].assign(left=[x for x, _ in left], left_done=[x for _, x in left], right=[x for x, _ in right], right_done=[x for _, x in right], ends=None, starts=None, top=None)
    flat = lambda base, pairs: [base, *(x for pair in pairs for x in pair)]
    summary = pd.DataFrame({"_grp": [rows["_grp"].iloc[0]], "_tile": [rows["_tile"].iloc[0]], "_at": [None], "_v": [None], "left": [None], "left_done": [None], "right": [None], "right_done": [None], "ends": [flat(before, ends)], "starts": [flat(after, starts)], "top": [max(values)]})
    return pd.concat([out.astype(object), summary.astype(object)], ignore_index=True)


def _carry(rows: pd.DataFrame, done: str, wall: str, summary: str, backwards: bool) -> None:
    """Walls of one side that leave their tile, by what the tiles passed so far hold: a stack of minima as in a tile."""
    stack: list[list[float]] = []
    base = -math.inf
    for _, tile in sorted(rows.groupby("_tile"), key=lambda x: x[0], reverse=backwards):
        for k, r in tile[tile["_at"].notna()].iterrows():
            if r[done]:
                continue
            high, j = r[wall], len(stack) - 1
            while j >= 0 and stack[j][0] >= r["_v"]:
                high = max(high, stack[j][0], stack[j][1])
                j -= 1
            rows.at[k, wall] = max(high, stack[j][1] if j >= 0 else base)
        flat = tile.loc[tile["_at"].isna(), summary].iloc[0]
        high, pairs = flat[0], list(zip(flat[1::2], flat[2::2], strict=True))
        while stack and stack[-1][0] >= pairs[0][0]:
            u, after = stack.pop()
            high = max(high, u, after)
        if stack:
            stack[-1][1] = max(stack[-1][1], high)
        else:
            base = max(base, high)
        stack += [list(p) for p in pairs]


def _between(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.reset_index(drop=True)
    _carry(rows, "left_done", "left", "ends", False)
    _carry(rows, "right_done", "right", "starts", True)
    return rows.loc[rows["_at"].notna(), ["_grp", "_at", "_v", "left", "right"]]


def prominences(minima: DataFrame, series: DataFrame, group: str = "grp", position: str = "position", value: str = "smooth", tile: int = TILE) -> DataFrame:
    """Minima with their prominence: the lower of the highest values on both sides, up to the nearest lower position, less their own.

    Nearest lower positions come from a stack of rising minima over tiles of a series; only minima whose walls leave their tile, and each tile's own
    stack, meet in their group, where the same stack runs over tiles. All is linear in the series' length."""
    ship(series.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in series.schema}
    marks = minima.select(F.col(group).alias("_grp"), F.col(position).alias("_at"), F.lit(True).alias("_min"))
    rows = series.select(F.col(group).alias("_grp"), F.col(position).alias("_at"), F.col(value).cast("double").alias("_v"))
    rows = rows.join(marks, ["_grp", "_at"], "left").withColumns({"_min": F.coalesce("_min", F.lit(False)), "_tile": F.floor(F.col("_at") / tile).cast("long")})
    tiled = rows.groupBy("_grp", "_tile").applyInPandas(_tile, _TILE.format(g=kind[group], p=kind[position]))
    inside = tiled.filter("_at is not null and left_done and right_done").select("_grp", "_at", "_v", "left", "right")
    open_ = tiled.filter("_at is null or not (left_done and right_done)")
    across = open_.groupBy("_grp").applyInPandas(_between, f"_grp {kind[group]}, _at {kind[position]}, _v double, left double, right double")
    both = inside.unionByName(across)
    return both.select(F.col("_grp").alias(group), F.col("_at").alias(position), F.col("_v").alias(value), (F.least("left", "right") - F.col("_v")).alias("prominence"))


def smoothed(df: DataFrame, widths: DataFrame, group: str = "grp", position: str = "position", value: str = "value") -> DataFrame:
    """moving_average with each group's own odd width, by differences of running sums. widths: (group, width)."""
    upto = F.sum(value).over(Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    sums = df.withColumn("_upto", upto)
    ends = df.groupBy(group).agg(F.min(position).alias("_a"), F.max(position).alias("_b"))
    half = F.floor(F.col("width") / 2)
    at = sums.join(widths.join(ends, group), group).withColumns({"_hi": F.least(F.col(position) + half, "_b"), "_lo": F.col(position) - half - 1})
    hi = sums.select(group, F.col(position).alias("_hi"), F.col("_upto").alias("_h"))
    lo = sums.select(group, F.col(position).alias("_lo"), F.col("_upto").alias("_l"))
    both = at.join(hi, [group, "_hi"]).join(lo, [group, "_lo"], "left")
    return both.select(*df.columns, ((F.col("_h") - F.coalesce("_l", F.lit(0.0))) / F.col("width")).alias("smooth"))


def pitch_widths(ends: DataFrame, lines: int, group: str = "grp", share: float = 0.155, least: int = 3) -> DataFrame:
    """(group, width, apart): the odd smoothing width and the least distance of valleys for a content height split into lines."""
    pitch = F.col("height") / lines
    size = F.greatest(F.lit(least).cast("double"), F.bround(pitch * share, 0)).cast("long")
    return ends.select(group, F.when(size % 2 == 0, size + 1).otherwise(size).alias("width"), F.greatest(F.lit(1.0), F.bround(pitch * 0.8, 0)).cast("long").alias("apart"))


def line_boxes(df: DataFrame, lines: int, group: str = "grp", position: str = "position", value: str = "value") -> DataFrame:
    """(group, line, top, bottom): a profile's content split into lines at its most prominent valleys; fewer where too few are found.

    One line is the whole content; a group without content has no boxes."""
    content = df.filter(F.col(value) != 0).groupBy(group).agg(F.min(position).alias("top"), (F.max(position) + 1).alias("end")).withColumn("height", F.col("end") - F.col("top"))
    if lines == 1:
        return content.select(group, F.lit(1).cast("long").alias("line"), "top", F.col("end").alias("bottom"))
    clean = df.join(content.select(group, "top", "end"), group).filter((F.col(position) >= F.col("top")) & (F.col(position) < F.col("end"))).select(group, position, value)
    widths = pitch_widths(content, lines, group)
    smooth = smoothed(clean, widths, group, position, value).withColumn("smooth", F.round("smooth", 9))
    minima = local_minima(smooth, group, position)
    found = prominences(minima, smooth, group, position).join(widths, group)
    ranked = found.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("prominence")).alias("o"), F.col(position).alias("p")))).alias("c"), F.first("apart").alias("apart"))
    none = F.expr("cast(array() as array<bigint>)")
    apart = F.col("apart")
    picked = F.aggregate("c", none, lambda acc, x: F.when((F.size(acc) < lines - 1) & F.forall(acc, lambda s: F.abs(s - x["p"]) >= apart), F.concat(acc, F.array(x["p"]))).otherwise(acc))
    cuts = content.join(ranked.select(group, picked.alias("v")), group).withColumn("e", F.concat(F.array("top"), F.array_sort("v"), F.array("end")))
    return cuts.select(group, "e", F.posexplode(F.slice("e", 2, F.size("e") - 1)).alias("i", "bottom")).select(group, (F.col("i") + 1).cast("long").alias("line"), F.get("e", F.col("i")).alias("top"), "bottom")


def dense_bands(df: DataFrame, share: float = 0.3, group: str = "grp", position: str = "position", value: str = "value") -> DataFrame:
    """(group, peak, top, bottom): the densest position, the first at ties, and the run around it that stays at `share` of it or above."""
    peak = df.groupBy(group).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(position).alias("p"))).alias("m")).select(group, F.col("m.p").alias("peak"), (-F.col("m.v") * share).alias("floor"))
    high = df.join(peak, group).filter(F.col(value) >= F.col("floor"))
    runs = high.withColumn("run", F.col(position) - F.row_number().over(Window.partitionBy(group).orderBy(position)))
    band = runs.groupBy(group, "run", "peak").agg(F.min(position).alias("top"), F.max(position).alias("bottom"))
    return band.filter(F.col("peak").between(F.col("top"), F.col("bottom"))).select(group, "peak", "top", "bottom")


def picked_peaks(df: DataFrame, threshold: float, width: int, share: float = 0.6, least: int = 4, most: int = 1 << 30, group: str = "grp", position: str = "position", score: str = "score") -> DataFrame:
    """(group, left, right): intervals of a width at the strongest scores of the threshold or more that keep their distance."""
    gap = max(least, int(width * share))
    found = strongest_apart(df.filter(F.col(score) >= threshold), most, gap, group, position, score)
    return found.select(group, F.col(position).alias("left"), (F.col(position) + width).alias("right"))
