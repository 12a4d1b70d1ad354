"""Exact nearest neighbours of many queries, each among the groups of its own collection that it may see.

Vectors are cut into cells: each belongs to the nearest of a bounded number of pivots, and keeps its distance to it. By the triangle
inequality a cell says how far its groups can be from a query at most and at least, so a summary of a collection's cells (at most pivots
times classes rows, however many groups there are) gives each query an upper bound of its k-th distance in each class, and names the cells
that can hold anything nearer. Only these are joined, by equality of collection, class and cell, and inside a cell only groups whose
distance to the pivot differs from the query's by the bound at most are compared. No queries or groups are broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.sources.shared import ship

PIVOTS = 48
#: Queries and groups that one task compares at a time where all groups are asked.
ASKED, BLOCK = 2048, 8192
#: Queries of a collection that one task bounds together.
CHUNK = 4096
#: What rounding and the order of sums may change in a distance.
SLACK = 1e-7
#: The same for distances by products of matrices, which lose half of the digits near zero.
NEAR_SLACK = 1e-5


def distance(a: Column, b: Column, weights: tuple[float, float], second: int) -> Column:
    """Weighted Euclidean distance of two vectors whose second block begins after `second` elements, to nine places."""
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    total = lambda c, w: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) * w
    return F.round(F.sqrt(total(F.slice(square, 1, second), weights[0]) + total(F.slice(square, second + 1, 1 << 20), weights[1])), 9)


def _pivots(groups: DataFrame, n: int) -> list[list[float]]:
    """Vectors of at most n groups, alike on every run."""
    return [r["features"] for r in groups.select("features", F.xxhash64("features").alias("h")).distinct().orderBy("h").limit(n).collect()]


def _celled(df: DataFrame, pivots: list[list[float]], weights: tuple[float, float], second: int) -> DataFrame:
    """df with `to`, the distances to all pivots, `cell`, the nearest one, and `at`, the distance to it."""
    scale = np.sqrt(np.where(np.arange(max(map(len, pivots), default=0)) < second, *weights))
    points = np.array(pivots) * scale

    @F.pandas_udf("array<double>")
    def to_pivots(features: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(features), 256):
            rows = np.array(features.iloc[k : k + 256].tolist()) * scale
            out += list(np.sqrt(((rows[:, None, :] - points[None, :, :]) ** 2).sum(2)))
        return pd.Series(out)

    near = df.withColumn("to", to_pivots("features"))
    return near.withColumns({"at": F.array_min("to"), "cell": F.array_position("to", F.array_min("to")) - 1})


def _summaries(groups: DataFrame, by: str, k: int) -> DataFrame:
    """(collection_id, cells): each class and cell of a collection with the least and greatest distance to its pivot and up to k + 1
    (page, snapshot) by which as many groups are known, of different snapshots, earliest first."""
    cell = ["collection_id", by, "cell"]
    first = F.array_min(F.transform("refs", lambda r: F.struct(r["page_number"].alias("page"), r["snapshot_id"].alias("snapshot"))))
    rows = groups.select(*cell, "at", first.alias("first"))
    span = rows.groupBy(*cell).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    seen = rows.groupBy(*cell, "first.snapshot").agg(F.min("first.page").alias("page"))
    few = seen.withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy("page", "snapshot"))).filter(F.col("k") <= k + 1)
    known = few.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("page", "snapshot"))).alias("known"))
    both = span.join(known, cell)
    return both.groupBy("collection_id").agg(F.collect_list(F.struct(F.col(by).alias("class"), "cell", "low", "high", "known")).alias("cells"))


def _bounded(k: int):
    """For each query of a chunk the cells that can hold one of its k nearest groups of a class, with the bound."""

    def run(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        found: list[list[dict]] = []
        if not len(queries):
            return pd.DataFrame({"query_id": [], "probes": []})
        rows = [c for many in cells["cells"] for c in many]
        classes = sorted({c["class"] for c in rows})
        of = {c: [r for r in rows if r["class"] == c] for c in classes}
        arrays = {c: (np.array([r["cell"] for r in some], int), np.array([r["low"] for r in some]), np.array([r["high"] for r in some]), [[(x["page"], x["snapshot"]) for x in r["known"]] for r in some]) for c, some in of.items()}
        for to, before, own in zip(queries["to"], queries["before"], queries["snapshot_id"], strict=True):
            probes = []
            for c, (cell, low, high, known) in arrays.items():
                d = to[cell]
                most, least = d + high, np.maximum(np.maximum(d - high, low - d), 0.0)
                bound, n = np.inf, 0
                for j in np.argsort(most):
                    n += sum((pd.isna(before) or p < before) and s != own for p, s in known[j])
                    if n >= k:
                        bound = most[j]
                        break
                for j in np.flatnonzero(least <= bound + SLACK):
                    # a cell whose every group is known from later pages only has nothing to say yet
                    if pd.isna(before) or known[j][0][0] < before:
                        probes.append({"class": c, "cell": int(cell[j]), "from_pivot": float(d[j]), "bound": float(bound)})
            found.append(probes)
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy(), "probes": found})

    return run


def nearest(queries: DataFrame, groups: DataFrame, by: str, k: int, weights: tuple[float, float], second: int, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, by, group_id, copies, refs, distance): for each query and each value of `by` its k nearest groups, by (distance, group_id).

    queries: query_id (one row each), collection_id, features, snapshot_id, and before: the page before which references count, null for all.
    groups: collection_id, by, group_id, features, copies and refs (sample_id, snapshot_id, page_number). References to a query's own
    snapshot, or from its page or later, don't count; a group without any others isn't seen. Groups in refs are those that a query sees."""
    chosen = _pivots(groups, pivots)
    if not chosen:
        kind = {f.name: f.dataType.simpleString() for f in groups.schema}
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, {by} {kind[by]}, group_id {kind['group_id']}, copies {kind['copies']}, refs {kind['refs']}, distance double")
    ship(queries.sparkSession)
    known = _celled(groups, chosen, weights, second)
    asked = _celled(queries.select("query_id", "collection_id", "features", "snapshot_id", "before"), chosen, weights, second)
    sizes = queries.groupBy("collection_id").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    asked = asked.join(sizes, "collection_id").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks"))
    summaries = _summaries(known, by, k).join(sizes, "collection_id").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    kind = queries.schema["query_id"].dataType.simpleString()
    probes = asked.select("collection_id", "chunk", "query_id", "to", "before", "snapshot_id").groupBy("collection_id", "chunk").cogroup(summaries.select(F.col("collection_id").alias("held_by"), F.col("chunk").alias("held_chunk"), "cells").groupBy("held_by", "held_chunk")).applyInPandas(_bounded(k), f"query_id {kind}, probes array<struct<class:string,cell:long,from_pivot:double,bound:double>>")
    probes = probes.withColumn("p", F.explode("probes")).select("query_id", "p.*")
    wanted = queries.select("query_id", "collection_id", F.col("features").alias("asked"), F.col("snapshot_id").alias("own"), "before").join(probes, "query_id")
    there = known.select(F.col("collection_id").alias("held_by"), F.col(by).alias("kind"), F.col("cell").alias("held_in"), "at", "group_id", "features", "copies", "refs")
    meet = F.col("collection_id").eqNullSafe(F.col("held_by")) & (F.col("class") == F.col("kind")) & (F.col("cell") == F.col("held_in")) & (F.abs(F.col("at") - F.col("from_pivot")) <= F.col("bound") + SLACK)
    refs = F.filter("refs", lambda r: ~r["snapshot_id"].eqNullSafe(F.col("own")) & (F.col("before").isNull() | (r["page_number"] < F.col("before"))))
    rows = wanted.join(there, meet).withColumn("refs", refs).filter(F.size("refs") > 0)
    rows = rows.withColumn("distance", distance(F.col("features"), F.col("asked"), weights, second)).filter(F.col("distance") <= F.col("bound") + SLACK)
    # a group is known by the least of the samples that a query sees; without a page, by that of all
    rows = rows.withColumn("group_id", F.when(F.col("before").isNull(), F.col("group_id")).otherwise(F.array_min(F.transform("refs", lambda r: r["sample_id"]))))
    w = Window.partitionBy("query_id", "kind").orderBy("distance", "group_id")
    few = rows.select("query_id", "kind", "group_id", "copies", "refs", "distance").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)
    return few.select("query_id", F.col("kind").alias(by), "group_id", "copies", "refs", "distance")


def _of_block(k: int, weights: tuple[float, float], second: int):
    """A chunk of queries against a block of groups: each query's k nearest of each class, with all that rounding could put among them.

    Products of matrices find them, and their distances are then summed in the order of elements, as everywhere."""

    def run(queries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "class": [], "group_id": [], "exact": []}
        if len(queries) and len(groups):
            asked = np.array(queries["asked"].tolist())
            scale = np.sqrt(np.where(np.arange(asked.shape[1]) < second, *weights))
            own, slack = queries["own"].to_numpy(), NEAR_SLACK * max(1.0, np.abs(asked).max(initial=0.0))
            for c, some in groups.groupby("class"):
                held, only, ids = np.array(some["held"].tolist()), some["only"].to_numpy(), some["group_id"].to_numpy()
                points = held * scale
                for at in range(0, len(asked), 256):
                    rows = asked[at : at + 256] * scale
                    square = np.maximum((rows**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * rows @ points.T, 0.0)
                    # a group of the query's own snapshot alone isn't seen
                    square[own[at : at + 256, None] == only[None, :]] = np.inf
                    d = np.sqrt(square)
                    last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                    q, g = np.nonzero((d <= last[:, None] + slack) & np.isfinite(d))
                    difference = (held[g] - asked[at + q]) ** 2
                    block = [np.zeros(len(q)), np.zeros(len(q))]
                    for j in range(asked.shape[1]):
                        block[j >= second] = block[j >= second] + difference[:, j]
                    for name, values in zip(out, (queries["query_id"].to_numpy()[at + q], np.full(len(q), c, object), ids[g], np.sqrt(block[0] * weights[0] + block[1] * weights[1])), strict=True):
                        out[name].append(values)
        return pd.DataFrame({name: np.concatenate(parts) if parts else [] for name, parts in out.items()})

    return run


def nearest_of_all(queries: DataFrame, groups: DataFrame, by: str, k: int, weights: tuple[float, float], second: int) -> DataFrame:
    """nearest for queries that ask all groups, whatever their collection: chunks of queries meet blocks of groups, each pair in one task.

    That is all pairs, so its time grows with queries times groups; a task holds one chunk, one block and a strip of their distances."""
    ship(queries.sparkSession)
    blocks = groups.agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    chunks = queries.agg(F.ceil(F.count("*") / ASKED).alias("chunks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1))
    sizes = F.broadcast(blocks.crossJoin(chunks))
    # null where a group stands in several snapshots: no query leaves it out then
    only = F.when(F.array_min("refs.snapshot_id") == F.array_max("refs.snapshot_id"), F.array_min("refs.snapshot_id"))
    there = groups.select(F.col(by).alias("class"), "group_id", F.col("features").alias("held"), only.alias("only")).crossJoin(sizes)
    there = there.withColumn("block", F.pmod(F.xxhash64("class", "group_id"), "blocks")).withColumn("chunk", every("chunks")).drop("blocks", "chunks")
    asked = queries.select("query_id", F.col("features").alias("asked"), F.col("snapshot_id").alias("own")).crossJoin(sizes)
    asked = asked.withColumn("by_chunk", F.pmod(F.xxhash64("query_id"), "chunks")).withColumn("by_block", every("blocks")).drop("blocks", "chunks")
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *groups.schema.fields]}
    found = asked.groupBy("by_chunk", "by_block").cogroup(there.groupBy("chunk", "block")).applyInPandas(_of_block(k, weights, second), f"query_id {kind['query_id']}, class {kind[by]}, group_id {kind['group_id']}, exact double")
    w = Window.partitionBy("query_id", "class").orderBy("distance", "group_id")
    few = found.select("query_id", "class", "group_id", F.round("exact", 9).alias("distance")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).drop("k")
    own = queries.select(F.col("query_id").alias("_query"), F.col("snapshot_id").alias("own"))
    known = groups.select(F.col(by).alias("_class"), F.col("group_id").alias("_group"), "copies", "refs")
    rows = few.join(own, F.col("query_id") == F.col("_query")).join(known, (F.col("class") == F.col("_class")) & (F.col("group_id") == F.col("_group")))
    refs = F.filter("refs", lambda r: ~r["snapshot_id"].eqNullSafe(F.col("own")))
    return rows.select("query_id", F.col("class").alias(by), "group_id", "copies", refs.alias("refs"), "distance")
