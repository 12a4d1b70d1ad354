"""Summaries of pages and collections: counts are taken at each level before joins, so that nothing multiplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["collection_id", "page_number"]


def page_summary(pages: DataFrame, lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Lines, headers, segments, verses and chapters (distinct, in order) of each page; pages without lines have zeros."""
    per_line = lines.groupBy(*PAGE).agg(F.count("*").alias("n_lines"), F.count_if(F.col("type") == "header").alias("n_headers"), F.sort_array(F.collect_set("chapter")).alias("chapters"))
    per_segment = segments.groupBy(*PAGE).agg(F.count("*").alias("n_segments"), F.count_if("closes").alias("n_verses"))
    zero = {c: 0 for c in ("n_lines", "n_headers", "n_segments", "n_verses")}
    out = pages.select(*PAGE, "reviewed").join(per_line, PAGE, "left").join(per_segment, PAGE, "left").fillna(zero)
    return out.withColumns({"has_header": F.col("n_headers") > 0, "chapters": F.coalesce("chapters", F.array().cast("array<bigint>"))})


def collection_stats(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Lines, headers, basmalas, exported images (neither null nor empty), segments and verses of each collection."""
    a = lines.groupBy("collection_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("type") == "header").alias("n_headers"), F.count_if(F.col("type") == "basmala").alias("n_basmalas"), F.count_if(F.col("image") != "").alias("n_exported"))
    b = segments.groupBy("collection_id").agg(F.count("*").alias("n_segments"), F.count_if("closes").alias("n_verses"))
    return a.join(b, "collection_id", "left").fillna(0, ["n_segments", "n_verses"])


def word_coverage(lines: DataFrame, words: DataFrame, status: DataFrame) -> DataFrame:
    """Text lines, those with words, words and lines to review of each page; a page is complete if each text line has words and none is to review."""
    key = ["page_id", "line_number"]
    n = words.groupBy(*key).agg(F.count("*").alias("n"), F.count("word_id").alias("labelled"))
    joined = lines.filter("type = 'text'").select(*key).join(n, key, "left").join(status.select(*key, "status"), key, "left")
    review = F.count_if(F.col("status").isin("scored", "partial", "unresolved"))
    out = joined.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.count("n").alias("n_worded"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("n_labelled"), review.alias("needs_review"))
    return out.withColumn("complete", (F.col("needs_review") == 0) & (F.col("n_worded") == F.col("n_lines")))


def status_histogram(status: DataFrame) -> DataFrame:
    n = status.groupBy("status").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("whole"))
    return n.crossJoin(F.broadcast(whole)).select("status", "n", F.round(F.col("n") / F.col("whole"), 6).alias("share"))  # one row


def reason_histogram(status: DataFrame) -> DataFrame:
    """How many lines give each reason; a line's reasons are joined by "; "."""
    return status.select(F.explode(F.split("reason", "; ")).alias("reason")).filter("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def totals_by(df: DataFrame, group: str, item: str, metrics: list[str]) -> DataFrame:
    """Sums of metrics for each item of each group (whole = false) and for each group (whole = true), in one pass; null groups and
    null items are groups and items like others."""
    sums = df.rollup(group, item).agg(F.grouping_id().alias("level"), *(F.sum(m).alias(m) for m in metrics))
    return sums.filter("level < 3").select(group, item, (F.col("level") == 1).alias("whole"), *metrics)


def collections_listing(collections: DataFrame, pages: DataFrame) -> DataFrame:
    """Collections with their processed and reviewed pages, newest first. collections: (collection_id, created)."""
    by = pages.groupBy("collection_id").agg(F.count("*").alias("n_processed"), F.count_if("reviewed").alias("n_reviewed"))
    place = F.row_number().over(Window.orderBy(F.desc("created"), F.desc("collection_id"))).cast("long")  # a place in the whole list: one row a collection
    return collections.join(by, "collection_id", "left").fillna(0, ["n_processed", "n_reviewed"]).select(place.alias("place"), "collection_id", "n_processed", "n_reviewed")


def source_pages(pages: DataFrame) -> DataFrame:
    """Physical page of each logical one: an override, or counted from the first; and the same with 0 as no override."""
    counted = F.col("first_page") + F.col("page_number") - 1
    return pages.select(*PAGE, F.coalesce("source_page", counted).alias("physical"), F.coalesce(F.nullif("source_page", F.lit(0)), counted).alias("physical_nonzero"))


def shared_files(df: DataFrame, digest: str, created: str, name: str) -> DataFrame:
    """How many rows share a content, whether deleting one frees it, and the earliest row with the same content."""
    twins = df.groupBy(digest).agg(F.count("*").alias("shared"), F.min_by(name, F.struct(created, name)).alias("earliest"))
    return df.join(twins, digest).select(name, "shared", (F.col("shared") == 1).alias("unshared"), "earliest")
