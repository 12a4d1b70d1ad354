"""Pages with their lines and segments as nested documents and back; changes of them with rules; histories of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["collection_id", "page_number"]
LINE = [*PAGE, "line_number"]


def as_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def ordered_scan(lines: DataFrame) -> DataFrame:
    """Lines with their place in their collection's reading order."""
    return lines.select(*LINE, F.row_number().over(Window.partitionBy("collection_id").orderBy("page_number", "line_number")).cast("long").alias("place"))


def review_rows(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Text lines with their cuts: the left edges of closing segments, in order of the segments."""
    cuts = segments.filter("closes").groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct("segment_order", "x"))).alias("c"))
    both = lines.filter("type = 'text'").join(cuts, LINE, "left")
    return both.select(*LINE, F.coalesce(F.transform("c", lambda s: s["x"]), F.array().cast("array<bigint>")).alias("cuts"))


def inspected_bundles(bundles: DataFrame, collections: DataFrame) -> DataFrame:
    """Each bundle with its owner's collection of the same content, where they differ, and whether it may be applied.

    A bundle without a match is refused as unknown, one whose target has pages needs a replacement."""
    mine = collections.select("owner", "digest", "collection_id", F.col("name").alias("own_name"), F.col("first_page").alias("own_first"), F.col("n_pages").alias("own_pages"))
    both = bundles.join(mine, ["owner", "digest"], "left")
    state = F.when(F.col("collection_id").isNull(), "unknown").when(F.col("own_pages") > 0, "needs_replace").otherwise("ok")
    return both.select("bundle_id", "collection_id", F.coalesce(F.col("name") != F.col("own_name"), F.lit(False)).alias("name_differs"), F.coalesce(F.col("first_page") != F.col("own_first"), F.lit(False)).alias("range_differs"), state.alias("state"))


def bulk_saved(pages: DataFrame, flips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with `reviewed` set for the listed ones only; and one event for each collection's newly reviewed pages: a single page or a range."""
    new = flips.select(*PAGE, F.col("reviewed").alias("new"))
    both = pages.join(new, PAGE, "left")
    saved = both.select(*(F.coalesce("new", "reviewed").alias(c) if c == "reviewed" else F.col(c) for c in pages.columns))
    fresh = both.filter("new and not reviewed").groupBy("collection_id").agg(F.count("*").alias("n"), F.min("page_number").alias("first"), F.max("page_number").alias("last"))
    return saved, fresh.select("collection_id", F.when(F.col("n") == 1, "page").otherwise("range").alias("event"), "n", "first", "last")


def free_names(wanted: DataFrame, taken: DataFrame, most: int = 256) -> DataFrame:
    """A free name for each wanted copy: the name itself, "x (copy)", "x (copy 2)", ..., cut to `most` characters.

    Each held name says which copy (k) of which name it is. The least free k is 0 or follows a held one, so only these are looked at,
    not as many candidates as an owner has names."""
    many = r"(?s)\A(.*) \(copy ([1-9][0-9]{0,17})\)\z"
    k = F.regexp_extract("name", many, 2).cast("long")
    form = lambda name, k: F.struct(name.alias("name"), k.cast("long").alias("k"))
    one = F.when(F.col("name").endswith(" (copy)"), form(F.expr("left(name, length(name) - 7)"), F.lit(1)))
    more = F.when(F.col("name").rlike(many) & (F.when(F.col("name").rlike(many), k) > 1), form(F.regexp_extract("name", many, 1), F.when(F.col("name").rlike(many), k)))
    held = taken.select("owner", "name").distinct().select("owner", F.explode(F.array_compact(F.array(form(F.col("name"), F.lit(0)), one, more))).alias("f")).select("owner", "f.name", "f.k").distinct()
    after = held.join(wanted.select("owner", "name").distinct(), ["owner", "name"], "left_semi").select("owner", "name", (F.col("k") + 1).alias("k"))
    # only distinct names meet here; a wanted name without any held form is free itself
    each = wanted.select("owner", "name", F.lit(0).cast("long").alias("k")).unionByName(after)
    free = each.join(held, ["owner", "name", "k"], "left_anti")
    candidate = F.when(F.col("k") == 0, F.col("name")).when(F.col("k") == 1, F.concat("name", F.lit(" (copy)"))).otherwise(F.concat("name", F.lit(" (copy "), F.col("k").cast("string"), F.lit(")")))
    return free.groupBy("owner", "name").agg(F.min("k").alias("k")).select("owner", "name", F.substring(candidate, 1, most).alias("free_name"))


def cascaded(tables: dict[str, DataFrame], gone: DataFrame, key: str = "collection_id") -> dict[str, DataFrame]:
    """Every table without the rows that belong to what is deleted."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def files_to_delete(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Files of deleted rows that no other row shares."""
    left = rows.join(gone.select("id"), "id", "left_anti").select("file").distinct()
    return rows.join(gone.select("id"), "id", "left_semi").select("file").distinct().join(left, "file", "left_anti")


def saved_requests(requests: DataFrame) -> DataFrame:
    """What becomes of save requests, in order of arrival: a repeated id with the same content changes nothing, with another content is
    refused; a confirmation with exceptions must acknowledge them; the rest count up their page's revision.

    requests: review_id, arrival, request_id, digest, confirm, exceptions, acknowledged."""
    by = Window.partitionBy("review_id", "request_id").orderBy("arrival")
    ok = ~F.col("confirm") | (F.col("exceptions") == 0) | F.col("acknowledged")
    rows = requests.withColumn("ok", ok)
    landed = F.first(F.when(F.col("ok"), F.struct("arrival", "digest")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("landed", landed)
    state = F.when(F.col("landed").isNotNull(), F.when(F.col("landed.digest") == F.col("digest"), "repeated").otherwise("refused")).when(~F.col("ok"), "exceptions").otherwise(F.when(F.col("confirm"), "confirmed").otherwise("saved"))
    rows = rows.withColumn("state", state)
    counts = F.col("state").isin("confirmed", "saved")
    number = F.sum(counts.cast("long")).over(Window.partitionBy("review_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("review_id", "arrival", "state", F.when(counts, number).alias("revision"))


def restart_plan(revisions: DataFrame) -> DataFrame:
    """(review_id, first, legacy): each review's first processed revision, and the last archive before it."""
    first = revisions.filter("kind = 'processed'").groupBy("review_id").agg(F.min("number").alias("first"))
    old = revisions.filter("kind = 'legacy'").join(first, "review_id").filter(F.col("number") < F.col("first")).groupBy("review_id").agg(F.max("number").alias("legacy"))
    return first.join(old, "review_id", "left")


def approval_versions(approvals: DataFrame) -> DataFrame:
    """Each collection's approvals in page order as versions of a growing set: version, the approvals up to and with this one, and the pages
    from_page to to_page (null: all later ones) for which that version is in force, which begin after the approval's own.

    approvals: collection_id, page_number and number; of several for a page the greatest number holds. Several versions may begin with one
    page only if it has one approval, so each page has one version: one row for each approval, none for a pair of pages."""
    last = approvals.groupBy(*PAGE).agg(F.max("number").alias("number"))
    w = Window.partitionBy("collection_id").orderBy("page_number")
    rows = last.withColumns({"version": F.row_number().over(w).cast("long"), "next": F.lead("page_number").over(w)})
    return rows.select("collection_id", "version", "page_number", "number", (F.col("page_number") + 1).alias("from_page"), F.col("next").alias("to_page"))


def approved_before(approvals: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, version): the version of its collection's approvals that each page may learn from, those of earlier pages only; 0 if there are
    none. One as-of look-up over pages and approvals together."""
    versions = approval_versions(approvals).select("collection_id", F.col("from_page").alias("page_number"), "version")
    rows = pages.select(*PAGE, F.lit(None).cast("long").alias("version"), F.lit(True).alias("page")).unionByName(versions.select(*PAGE, "version", F.lit(False).alias("page")))
    # a version is in force from its first page on, that page too
    w = Window.partitionBy("collection_id").orderBy("page_number", "page").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("version", F.coalesce(F.max("version").over(w), F.lit(0))).filter("page").select(*PAGE, "version")


def approved_context(revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted pages whose review is approved, with a digest of what the latest approval says."""
    last = revisions.filter("kind = 'assistant'").groupBy("review_id").agg(F.max_by(F.struct("number", "payload"), "number").alias("r"))
    both = wanted.join(last, "review_id")
    return both.select("review_id", F.col("r.number").alias("number"), F.sha2("r.payload", 256).alias("digest"))


def current_pages(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(collection_id, page_number, current): whether each row's line is there, is the same one and has the digest that the row was made from."""
    now = lines.select(*LINE, F.col("line_id").alias("now_id"), F.col("digest").alias("now_digest"))
    both = rows.join(now, LINE, "left")
    same = F.col("line_id").eqNullSafe(F.col("now_id")) & F.col("digest").eqNullSafe(F.col("now_digest"))
    return both.groupBy(*PAGE).agg(F.bool_and(same).alias("current"))


def carried_decisions(old: DataFrame, new: DataFrame, first: int, last: int) -> DataFrame:
    """New components with the old draft's explicit decisions; words outside the span are dropped from what they were given.

    Both: line, label, role; old has explicit and words, an array."""
    a = old.filter("explicit").select("line", "label", F.col("role").alias("old_role"), F.filter("words", lambda w: w.between(first, last)).alias("words"))
    both = new.join(a, ["line", "label"], "left")
    return both.select("line", "label", F.coalesce("old_role", "role").alias("role"), F.col("old_role").isNotNull().alias("explicit"), F.coalesce("words", F.array().cast("array<bigint>")).alias("words"))


def exported_history(revisions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(collection_id, page_number, history): each review's revisions in order, with its profile less the keys that mean something here only."""
    h = revisions.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("number", "kind", "digest"))).alias("history"))
    portable = F.map_filter("profile", lambda k, v: ~k.isin("mode", "activated_by", "activated_at"))
    return h.join(profiles.select(*PAGE, portable.alias("profile")), PAGE, "left")
