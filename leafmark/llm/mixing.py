"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A source's share of tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised.
The exponent is the largest one, found by repeated division of its interval, whose weights reach a target entropy;
a repetition limit keeps it from going so low that a source would be read more often than allowed. The weights times
the token budget are quotas. A source's documents fall into BLOCKS blocks by a hash, which is also their order, so
blocks are permuted and the documents in them too; a quota takes whole passes over a source and then the documents
from the front whose running tokens fit into the rest. No window holds more than a block, or a source's block totals.

Cases: null sources are one source (""); null and empty texts have 0 tokens and come with each pass and the rest's
front; a source without tokens has weight 0 and one copy of each document; rows with equal ids are ordered by tokens;
an empty table gives an empty result; very long texts are one document; columns besides those named are carried or ignored and may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import documents, written

#: Share of the way from the sources' own entropy to the largest possible one; most passes over a source.
GAIN, REPEATS = 0.5, 4.0
#: Hex digits of a document's hash that name its block, parts that one division makes, and divisions: 2**-30.
BLOCK_DIGITS, PARTS, ROUNDS = 4, 32, 6
SEED = "mix-1"


def _words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _narrow(totals: DataFrame, good) -> float:
    """The largest exponent k / 2**30 in [0, 1] for which good(row) holds, or 0; good must hold below any exponent for which it holds.

    totals: (n_tokens) of each source with tokens. Each division is one distributed aggregate over sources x PARTS."""
    low, width = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = totals.select("n_tokens", F.explode(F.sequence(F.lit(0), F.lit(PARTS))).alias("j"))
        alpha = F.lit(low) + F.col("j") * F.lit(width / PARTS)
        power = F.exp(alpha * F.ln(F.col("n_tokens") / F.col("whole")))
        whole = totals.agg(F.sum("n_tokens").alias("whole"))
        sums = grid.crossJoin(F.broadcast(whole)).withColumn("power", power)  # one row
        by = sums.groupBy("j").agg(F.sum("power").alias("z"), F.sum(F.col("power") * F.ln("power")).alias("plogp"), F.max(F.col("power") / F.col("n_tokens")).alias("top"), F.first("whole").alias("whole"))
        fits = [r["j"] for r in by.collect() if good(r)]  # PARTS + 1 rows
        if not fits:
            return low
        if (j := max(fits)) == PARTS:
            return low + width
        low, width = low + j * width / PARTS, width / PARTS
    return low


def exponent(totals: DataFrame, gain: float = GAIN, repeats: float = REPEATS, budget: float | None = None) -> float:
    """The exponent for (source, n_tokens): the entropy target's, or the repetition limit's if that is higher."""
    import math

    some = totals.filter("n_tokens > 0")
    r = some.agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.ln("n_tokens")).alias("nlogn")).first()
    if not r["k"] or r["k"] == 1:
        return 1.0
    own = math.log(r["n"]) - r["nlogn"] / r["n"]
    target = own + gain * (math.log(r["k"]) - own)
    tokens = budget or float(r["n"])
    alike = _narrow(some, lambda x: math.log(x["z"]) - x["plogp"] / x["z"] >= target - 1e-9)
    # passes fall as the exponent rises: the least exponent that keeps them is 1 less the largest drop that does
    if alike == 0.0 or _too_many(some, alike, tokens, repeats):
        lowest = _narrow_up(some, tokens, repeats)
        return max(alike, lowest)
    return alike


def _most_passes(totals: DataFrame, alpha: float, tokens: float) -> float:
    p = F.exp(F.lit(alpha) * F.ln(F.col("n_tokens")))
    r = totals.agg(F.sum(p).alias("z"), F.max(p / F.col("n_tokens")).alias("top")).first()
    return tokens * r["top"] / r["z"]


def _too_many(totals: DataFrame, alpha: float, tokens: float, repeats: float) -> bool:
    return _most_passes(totals, alpha, tokens) > repeats + 1e-9


def _narrow_up(totals: DataFrame, tokens: float, repeats: float) -> float:
    """The least exponent k / 2**30 that keeps passes within the limit; 1 if none does."""
    low, high = 0, 1 << 30
    while low < high:
        middle = (low + high) // 2
        if _too_many(totals, middle / (1 << 30), tokens, repeats):
            low = middle + 1
        else:
            high = middle
    return low / (1 << 30)


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", gain: float = GAIN, repeats: float = REPEATS, budget: float | str = "tokens", seed: str = SEED, digits: int = BLOCK_DIGITS) -> tuple[DataFrame, float]:
    """Every row as a struct `row` with source, n_tokens, weight, copies and reached (its source's tokens up to it in the permuted
    order of blocks, which decides who gets one copy more); and the exponent.

    budget: "tokens" for as many tokens as there are, "cover" for as many as give each source a whole pass, or a number.
    digits: hex digits of the key that name a block; 16 ** digits blocks of a source, one window each, so a source of more rows wants more. The order
    within a source is that of the whole keys, so the result doesn't depend on it."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(source), F.lit("")).alias("source"), _words(text).alias("n_tokens"), key.alias("key")).withColumn("block", F.substring("key", 1, digits))
    light = rows.select("source", "block", "n_tokens")
    blocks = written(light.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")), "mix-blocks")
    totals = written(blocks.groupBy("source").agg(F.sum("block_tokens").alias("n_tokens")), "mix-sources")
    alpha = exponent(totals, gain, repeats, budget if isinstance(budget, (int, float)) else None)
    some = totals.filter("n_tokens > 0").withColumn("power", F.exp(F.lit(alpha) * F.ln("n_tokens")))
    r = some.agg(F.sum("power").alias("z"), F.sum("n_tokens").alias("n"), F.max(F.col("n_tokens") / F.col("power")).alias("far")).first()
    z, tokens = r["z"] or 1.0, float(r["n"] or 0)
    if budget == "cover":
        tokens = (r["far"] or 0.0) * z
    elif budget != "tokens":
        tokens = float(budget)
    power = F.exp(F.lit(alpha) * F.ln(F.greatest("n_tokens", F.lit(1))))
    weight = F.when(F.col("n_tokens") > 0, power / z).otherwise(0.0)
    quota = F.floor(F.col("weight") * tokens + 1e-6)
    plan = totals.withColumn("weight", weight).withColumn("quota", quota)
    plan = plan.select(F.col("source").alias("of"), "weight", F.when(F.col("n_tokens") > 0, F.floor(F.col("quota") / F.col("n_tokens"))).otherwise(1).alias("passes"), F.when(F.col("n_tokens") > 0, F.col("quota") % F.col("n_tokens")).otherwise(-1).alias("rest"))
    before = F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("source", "block", F.coalesce(before, F.lit(0)).alias("offset")).join(plan, F.col("source") == F.col("of")).drop("of")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("key", F.col(f"row.`{id_col}`"), "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("inside", inside).join(offsets, ["source", "block"])
    reached = F.col("offset") + F.col("inside")
    copies = F.col("passes") + F.when(reached <= F.col("rest"), 1).otherwise(0)
    return placed.select("row", "source", "n_tokens", "weight", copies.cast("int").alias("copies"), reached.alias("reached")), alpha


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row as often as its copies say, with the columns of docs."""
    placed, _ = mixed(docs, **options)
    return placed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    narrow = docs.select("doc_id", "source", "text")
    placed, alpha = mixed(narrow)
    return placed.select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", F.round("weight", 9).alias("weight"), F.round(F.lit(alpha), 6).alias("exponent"), "copies", "reached")


OP6_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS n FROM rows GROUP BY source),
held AS (SELECT source, n, n / sum(n) OVER () AS p FROM totals WHERE n > 0),
base AS (SELECT count(*) AS k, sum(n)::DOUBLE AS whole, -sum(p * ln(p)) AS own FROM held),
goal AS (SELECT own + 0.5 * (ln(k) - own) AS target, k, whole FROM base),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT step, low, high, (low + high) / 2 AS mid,
               (SELECT ln(sum(exp(((low + high) / 2) * ln(p)))) - sum(exp(((low + high) / 2) * ln(p)) * ((low + high) / 2) * ln(p)) / sum(exp(((low + high) / 2) * ln(p))) FROM held)
               >= (SELECT target - 1e-9 FROM goal) AS ok
        FROM bisect WHERE step < 30)),
passes(step, low, high) AS (
  SELECT 0, 0::BIGINT, (1 << 30)::BIGINT
  UNION ALL
  SELECT step + 1, CASE WHEN many THEN mid + 1 ELSE low END, CASE WHEN many THEN high ELSE mid END
  FROM (SELECT step, low, high, (low + high) // 2 AS mid,
               (SELECT (SELECT whole FROM base) * max(exp(((low + high) // 2) / (1 << 30)::DOUBLE * ln(n)) / n) / sum(exp(((low + high) // 2) / (1 << 30)::DOUBLE * ln(n))) FROM held) > 4.0 + 1e-9 AS many
        FROM passes WHERE low < high)),
alpha AS (
  SELECT CASE WHEN (SELECT k FROM base) <= 1 THEN 1.0
              ELSE greatest((SELECT max(low) FROM bisect WHERE step = 30), (SELECT max(low) / (1 << 30)::DOUBLE FROM passes)) END AS a),
weights AS (SELECT source, n, exp(a * ln(n)) / sum(exp(a * ln(n))) OVER () AS weight FROM held, alpha),
plan AS (
  SELECT t.source, coalesce(w.weight, 0.0) AS weight,
         CASE WHEN t.n > 0 THEN floor(floor(w.weight * b.whole + 1e-6) / t.n) ELSE 1 END AS passes,
         CASE WHEN t.n > 0 THEN floor(w.weight * b.whole + 1e-6) % t.n ELSE -1 END AS rest
  FROM totals t LEFT JOIN weights w USING (source), base b),
run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM rows)
SELECT doc_id, run.source, n_tokens, round(weight, 9) AS weight, round((SELECT a FROM alpha), 6) AS exponent,
       (passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies, upto::BIGINT AS reached
FROM run JOIN plan USING (source)
"""
