"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `virtual` points of a ring of 2**32 positions; a row belongs to the first point at or after the
hash of its id and its text's checksum. Shards hold floor or ceil of rows / shards (law "rows"), so that counts are at most one apart. Rows
are placed in ring order; those that find their shard full go on clockwise to the next shard with room. Only counts
for each arc of the ring (shards * virtual numbers, however many rows there are) meet in one place: there a fold
gives each arc's runs of ranks to shards, and rows take their shard by arc and rank.

Cases: rows with equal ids and different texts stand apart; equal rows share a position and are interchangeable; a
null id hashes as an empty one, with its text; a null text is empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import documents

SHARDS, VIRTUAL, CELLS = 40, 64, 4096


def _position(text):
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """(arc, position, shard) of all points, arcs numbered clockwise from 0: shards * virtual rows."""
    points = spark.range(shards * virtual).select((F.col("id") / virtual).cast("int").alias("shard"), (F.col("id") % virtual).alias("v"))
    points = points.withColumn("position", _position(F.concat_ws(":", F.lit("shard"), "shard", "v")))
    order = Window.partitionBy(F.lit(0)).orderBy("position", "shard", "v")
    return points.select((F.row_number().over(order) - 1).alias("arc"), "position", "shard")


def _cells(points: DataFrame) -> DataFrame:
    """For each of CELLS equal parts of the ring, the points before it and the positions inside: CELLS rows."""
    width = (1 << 32) // CELLS
    all_points = points.agg(F.sort_array(F.collect_list("position")).alias("positions"))
    cells = points.sparkSession.range(CELLS).select(F.col("id").alias("cell"))
    low = F.col("cell") * width
    return cells.crossJoin(all_points).select(
        "cell",
        F.size(F.filter("positions", lambda p: p < low)).alias("before"),
        F.filter("positions", lambda p: (p >= low) & (p < low + width)).alias("inside"),
        F.size("positions").alias("points"),
    )


_FOLD = """
aggregate(arcs, struct(cap AS rem, cast(array() AS array<struct<arc:int,low:bigint,high:bigint,shard:int,slot:bigint>>) AS out),
  (acc, a) -> aggregate(a.pref, struct(a.n AS left, acc.rem AS rem, acc.out AS out),
    (s, shard) -> CASE WHEN s.left = 0 OR s.rem[shard] = 0 THEN s ELSE struct(
        s.left - least(s.left, s.rem[shard]) AS left,
        transform(s.rem, (r, i) -> CASE WHEN i = shard THEN r - least(s.left, r) ELSE r END) AS rem,
        concat(s.out, array(struct(a.arc AS arc, a.n - s.left AS low, a.n - s.left + least(s.left, s.rem[shard]) AS high, shard AS shard, cap[shard] - s.rem[shard] AS slot))) AS out) END,
    s -> struct(s.rem AS rem, s.out AS out)),
  acc -> acc.out)
"""


def placements(counts: DataFrame, points: DataFrame, shards: int) -> DataFrame:
    """(arc, low, high, shard, slot): ranks low+1 to high of an arc go to a shard from that slot on.

    counts: (arc, n). At most shards + shards * virtual rows, since each run ends an arc or fills a shard."""
    filled = points.join(counts, "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    one = filled.agg(F.sort_array(F.collect_list(F.struct("arc", "n", "shard"))).alias("a"), F.sum("n").alias("total"))
    one = one.withColumn("owners", F.transform("a", lambda x: x["shard"]))
    one = one.withColumn("arcs", F.expr("transform(a, x -> struct(x.arc AS arc, x.n AS n, array_distinct(concat(slice(owners, x.arc + 1, size(owners)), slice(owners, 1, x.arc))) AS pref))"))
    one = one.withColumn("cap", F.expr(f"transform(sequence(0, {shards - 1}), s -> cast(total div {shards} AS bigint) + CASE WHEN s < total % {shards} THEN 1 ELSE 0 END)"))
    return one.select(F.explode(F.expr(_FOLD)).alias("p")).select("p.*")


def ring_shards(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, home_shard, shard and slot of every row."""
    points = ring(docs.sparkSession, shards, virtual)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    hash_ = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"))
    rows = rows.withColumn("hash", hash_).withColumn("at", F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"))
    rows = rows.withColumn("cell", F.shiftright("at", 20)).join(F.broadcast(_cells(points)), "cell")  # CELLS rows at any size
    arc = F.col("before") + F.size(F.filter("inside", lambda p: p < F.col("at")))
    rows = rows.withColumn("arc", (arc % F.col("points")).cast("int")).select("doc_id", "size", "text_crc32", "hash", "arc")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("hash", "doc_id", "size", "text_crc32")).cast("long"))
    runs = placements(rows.groupBy("arc").agg(F.count("*").alias("n")), points, shards)
    runs = runs.join(points.select("arc", F.col("shard").alias("home_shard")), "arc")
    there = (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high"))
    placed = ranked.join(F.broadcast(runs.withColumnRenamed("arc", "run_arc")), (F.col("arc") == F.col("run_arc")) & there)  # shards * (virtual + 1) rows at most
    return placed.select("doc_id", "size", "text_crc32", "home_shard", "shard", (F.col("slot") + F.col("rank") - F.col("low") - 1).cast("long").alias("slot"))


def op9_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
