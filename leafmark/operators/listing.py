"""Listings of collections, runs and jobs: filters, pages, latest rows, retention, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_edition(collections: DataFrame, name: str) -> DataFrame:
    """Collections of an edition, without regard to case or spaces around the name."""
    return collections.filter(F.lower("edition") == F.lower(F.trim(F.lit(name))))


def entries(collections: DataFrame, viewer: Column) -> DataFrame:
    """Listing rows: logical pages, and whether the viewer (null: nobody) owns each."""
    return collections.select("collection_id", "name", (F.col("last_page") - F.col("first_page") + 1).alias("n_pages"), (F.col("owner").eqNullSafe(viewer) & viewer.isNotNull()).alias("is_owner"))


def public_page(collections: DataFrame, limit: int, offset: int, most: int = 60) -> DataFrame:
    """One page of the published collections, newest first, with the number of all; limit and offset are clamped."""
    shown = collections.filter("published")
    total = shown.agg(F.count("*").alias("total"))
    page = shown.orderBy(F.desc("published_at"), F.desc("created_at"), "collection_id").offset(max(0, offset)).limit(max(1, min(limit, most)))
    return page.crossJoin(F.broadcast(total)).select("collection_id", "published_at", "total")  # one row


def entry_details(collections: DataFrame, lines: DataFrame) -> DataFrame:
    """Each entry with its lines and exported lines, counted apart from other joins so that nothing multiplies."""
    n = lines.groupBy("collection_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("image") != "").alias("n_exported"))
    return collections.join(n, "collection_id", "left").fillna(0, ["n_lines", "n_exported"])


def run_history(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs numbered in time, with the pages that point at each and the page on which an aborted one stopped."""
    n = pages.filter("run_id is not null").groupBy("run_id").agg(F.count("*").alias("n_pages"))
    number = F.row_number().over(Window.partitionBy("collection_id").orderBy("started_at", "run_id")).cast("long")
    return runs.withColumn("run_number", number).join(n, "run_id", "left").select("collection_id", "run_id", "run_number", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), abort_page(F.col("abort"), F.col("from_page")).alias("abort_page"))


def abort_page(payload: Column, first: Column) -> Column:
    """The page that a run stopped on: its first page and the payload's index, which counts from 1; null without one."""
    return first + F.get_json_object(payload, "$.page_index").try_cast("bigint") - 1


def stale_runs(runs: DataFrame, keep: int) -> DataFrame:
    """Runs beyond the newest `keep` of their collection."""
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.desc("started_at"), F.desc("run_id")))
    return runs.withColumn("place", place).filter(F.col("place") > keep).select("collection_id", "run_id")


def cleared_pointers(pages: DataFrame, stale: DataFrame) -> DataFrame:
    """Pages whose pointer to a stale run is null."""
    gone = stale.select("run_id", F.lit(True).alias("gone"))
    return pages.join(gone, "run_id", "left").select(*(F.when(F.col("gone").isNull(), F.col(c)).alias(c) if c == "run_id" else F.col(c) for c in pages.columns))


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The latest row of each group."""
    rest = [c for c in df.columns if c not in by]
    one = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return one.select(*by, *(F.col("r")[c].alias(c) for c in rest))


def collection_steps(counts: DataFrame) -> DataFrame:
    """What is done of each collection: pages processed, reviewed, words placed; each is todo, active or done, and the first not done is next.

    counts: n_pages, n_processed, n_reviewed, n_worded."""
    step = lambda n, of: F.when(F.col(n) <= 0, "todo").when(F.col(n) < F.col(of), "active").otherwise("done")
    rows = counts.select("collection_id", step("n_processed", "n_pages").alias("process"), step("n_reviewed", "n_pages").alias("review"), step("n_worded", "n_pages").alias("words"))
    following = F.when(F.col("process") != "done", "process").when(F.col("review") != "done", "review").when(F.col("words") != "done", "words")
    return rows.withColumn("next", following)
