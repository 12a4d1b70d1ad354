"""Range joins by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join_binned(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, after: str, upto: str, width: int = 32) -> DataFrame:
    """Points with every interval of their key that holds them: after < point <= upto, all whole numbers.

    An interval stands in each bin that it touches, a point in its own, so bins are one more key of an equality join; the exact bounds are checked
    inside a bin. Empty intervals hold nothing. Other columns of both sides must have different names."""
    named = intervals.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in intervals.columns if c not in keys))
    spread = named.filter(F.col(upto) > F.col(after)).withColumn("_bin", F.explode(F.sequence(F.floor((F.col(after) + 1) / width), F.floor(F.col(upto) / width))))
    same = F.floor(F.col(point) / width) == F.col("_bin")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = (F.col(point) > F.col(after)) & (F.col(point) <= F.col(upto))
    return points.join(spread, same & inside).drop("_bin", *(f"_{k}" for k in keys))
