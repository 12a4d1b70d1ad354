"""Work bundles: whole page trees and review histories as portable documents, and their way into another collection.

A tree document is one page with its lines, and these with segments, erase strokes, words and word status; a history is typed tables, in which every
column that names a snapshot, a revision, a line or a revision's number is known, so an import moves each by a join with a map of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["collection_id", "page_number"]
LINE = [*PAGE, "line_number"]
#: The tag of a document, and what an import reads.
SCHEMA, SUPPORTED = "page-tree/v2", ("page-tree/v1", "page-tree/v2")
BRUSH = 12

_SEGMENT = "segment_order INT, x BIGINT, w BIGINT, closes BOOLEAN, verse BIGINT"
_STROKE = "size BIGINT, points ARRAY<ARRAY<BIGINT>>"
_WORD = "word_id BIGINT, position INT, start_x BIGINT, end_x BIGINT"
_STATUS = "status STRING, reason STRING, deviations BIGINT, ties BIGINT, edited BOOLEAN"
_struct = lambda fields: "STRUCT<" + ", ".join(f"{a}: {b}" for a, b in (f.strip().split(" ", 1) for f in fields.split(", "))) + ">"
_LINE = f"STRUCT<line_number: INT, type: STRING, chapter: BIGINT, x: BIGINT, y: BIGINT, w: BIGINT, h: BIGINT, segments: ARRAY<{_struct(_SEGMENT)}>, strokes: ARRAY<{_struct(_STROKE)}>, words: ARRAY<{_struct(_WORD)}>, status: {_struct(_STATUS)}>"
PAGE_TREE = f"STRUCT<schema: STRING, source_page: BIGINT, x: BIGINT, y: BIGINT, w: BIGINT, h: BIGINT, reviewed: BOOLEAN, lines: ARRAY<{_LINE}>>"


def _by_page(rows: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
    """A page's rows as one list of (n, v) by line and order: the line's number and the fields."""
    each = F.struct(F.col("line_number").alias("n"), *(F.col(c).alias(f"_{c}") for c in order), F.struct(*fields).alias("v"))
    return rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(each)).alias(name))


def exported_trees(pages: DataFrame, lines: DataFrame, segments: DataFrame, strokes: DataFrame, words: DataFrame, status: DataFrame) -> DataFrame:
    """(collection_id, page_number, tree): each page as one value of PAGE_TREE, lines by number and their parts in order; a line or page without
    some has empty lists, a line without a status null. All is grouped and joined by page alone, so rows that are dealt out by page stay where they are.

    strokes: line, ord, size, points; words: line, position, word_id, start_x, end_x; status: line, status, reason, deviations, ties, edited."""
    found = _by_page(lines, "lines", [], ["type", "chapter", "x", "y", "w", "h"])
    for part in (_by_page(segments, "segments", ["segment_order"], ["segment_order", "x", "w", "closes", "verse"]), _by_page(strokes, "strokes", ["ord"], ["size", "points"]),
                 _by_page(words, "words", ["position", "word_id"], ["word_id", "position", "start_x", "end_x"]), _by_page(status, "status", [], ["status", "reason", "deviations", "ties", "edited"])):
        found = found.join(part, PAGE, "left")
    of = lambda name, n: F.coalesce(F.transform(F.filter(name, lambda p: p["n"] == n), lambda p: p["v"]), F.array())

    def line(l):
        own = [l["v"][c].alias(c) for c in ("type", "chapter", "x", "y", "w", "h")]
        return F.struct(l["n"].alias("line_number"), *own, *(of(name, l["n"]).alias(name) for name in ("segments", "strokes", "words")), F.get(of("status", l["n"]), F.lit(0)).alias("status"))

    tree = F.struct(F.lit(SCHEMA).alias("schema"), "source_page", "x", "y", "w", "h", "reviewed", F.coalesce(F.transform("lines", line), F.array()).alias("lines")).cast(PAGE_TREE)
    return pages.join(found, PAGE, "left").select(*PAGE, tree.alias("tree"))


def tree_json(tree: str | Column = "tree") -> Column:
    return F.to_json(tree, {"ignoreNullFields": "false"})


def imported_lines(documents: DataFrame, text: str = "document") -> DataFrame:
    """(collection_id, page_number, line_number, l): the lines of page documents in JSON with all their parts, as they were written; a document is read once."""
    # the outer form, without a test of its own of what it gives out, which would read the document again
    read = documents.select(*PAGE, F.from_json(text, PAGE_TREE).alias("t"))
    each = read.select(*PAGE, F.posexplode_outer(F.when(_supported(F.col("t.schema")), F.col("t.lines"))).alias("n", "l")).filter("n is not null")
    return each.select(*PAGE, F.col("l.line_number").alias("line_number"), "l")


def _supported(schema: Column) -> Column:
    return F.coalesce(schema.isin(*SUPPORTED), F.lit(False))


def stroke_size(size: Column) -> Column:
    return F.coalesce(size, F.lit(BRUSH).cast("long"))


def stroke_points(points: Column) -> Column:
    return F.coalesce(points, F.array().cast("array<array<bigint>>"))


def imported_trees(documents: DataFrame, text: str = "document") -> dict[str, DataFrame]:
    """pages, lines, segments, strokes, words and status of page documents in JSON (collection_id, page_number, document), and `refused`: documents
    that are no tree or have a tag that isn't supported.

    What may be left out: `reviewed` and `closes` (false), a segment's order (its place from 1), a stroke's size and points, a word's position (its place
    from 0), a status. Pages come without a last run."""
    read = documents.select(*PAGE, F.from_json(text, PAGE_TREE).alias("t"))
    good = _supported(F.col("t.schema"))
    each = imported_lines(documents, text)
    part = lambda name: each.select(*LINE, F.posexplode(f"l.{name}").alias("i", "v"))
    false = lambda c: F.coalesce(c, F.lit(False))
    return {
        "pages": read.filter(good).select(*PAGE, *(F.col(f"t.{c}").alias(c) for c in ("source_page", "x", "y", "w", "h")), false("t.reviewed").alias("reviewed"), F.lit(None).cast("long").alias("last_run")),
        "lines": each.select(*LINE, *(F.col(f"l.{c}").alias(c) for c in ("type", "chapter", "x", "y", "w", "h"))),
        "segments": part("segments").select(*LINE, F.coalesce("v.segment_order", F.col("i") + 1).alias("segment_order"), "v.x", "v.w", false("v.closes").alias("closes"), "v.verse"),
        "strokes": part("strokes").select(*LINE, F.col("i").alias("ord"), stroke_size(F.col("v.size")).alias("size"), stroke_points(F.col("v.points")).alias("points")),
        "words": part("words").select(*LINE, F.coalesce("v.position", "i").alias("position"), "v.word_id", "v.start_x", "v.end_x"),
        "status": each.filter("l.status is not null").select(*LINE, "l.status.*"),
        "refused": read.filter(~good).select(*PAGE, F.col("t.schema").alias("schema")),
    }


def replaced_structure(pages: DataFrame, lines: DataFrame, strokes: DataFrame, new_lines: DataFrame) -> dict[str, DataFrame]:
    """pages, lines and strokes after the lines of new_lines' pages are replaced: new lines have no chapter yet, strokes of the old ones go with them,
    and these pages are no longer reviewed. Segments and words follow their lines in the same way."""
    which = new_lines.select(*PAGE).distinct()
    here = which.withColumn("_new", F.lit(True))
    fresh = new_lines.withColumn("chapter", F.lit(None).cast(lines.schema["chapter"].dataType)).select(*lines.columns)
    return {
        "pages": pages.join(here, PAGE, "left").select(*((F.col("reviewed") & F.col("_new").isNull()).alias(c) if c == "reviewed" else F.col(c) for c in pages.columns)),
        "lines": lines.join(which, PAGE, "left_anti").unionByName(fresh),
        "strokes": strokes.join(which, PAGE, "left_anti"),
    }


def finalized(lines: DataFrame, strokes: DataFrame, given: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and strokes after a page is finished: given tops and heights take the place of lines' own, all else of these stays; the strokes of given
    lines are replaced by those that were drawn, and go where none were. given: line, y, h; drawn: line, ord, size, points."""
    new = given.select(*LINE, F.col("y").alias("_y"), F.col("h").alias("_h"))
    set_ = lines.join(new, LINE, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("y", "h") else F.col(c) for c in lines.columns))
    which = given.select(*LINE).distinct()
    kept = strokes.join(which, LINE, "left_anti")
    return set_, kept.unionByName(drawn.join(which, LINE, "left_semi").select(*strokes.columns))


def _own(kind: str, *parts: str) -> Column:
    """A new id in the target, the same on every try."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *(F.col(p).cast("string") for p in parts)), 256)


def exported_snapshots(snapshots: DataFrame) -> DataFrame:
    """Each collection's snapshots in order of page, line and id, as one list of what travels: no files, no approvals."""
    each = F.sort_array(F.collect_list(F.struct("page_number", "line_number", "snapshot_id", "source_line_id", "fingerprint")))
    return snapshots.groupBy("collection_id").agg(each.alias("snapshots"))


def restored(incoming: dict[str, DataFrame], held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """An imported history as the target's own: snapshots, rows, revisions, reviews, profiles, settings and `unresolved`.

    - A snapshot with a fingerprint that the target has is that one; others get a new id and the target's line of their page and number.
    - Revisions count on after the target's and get new ids; a request id in use is dropped; the number of the revision that they were made from moves along.
    - Rows name the target's snapshot, revision and line, with the old line's id beside where it differs. A row whose line the target lacks keeps its id.
    - Profiles name approvals by the new ids and are in shadow mode; consent never travels, so settings turn `experimental` off.
    - What names a snapshot or an approval that didn't come along is in `unresolved` (kind, owner, id), and kept as it is.

    incoming: snapshots (collection_id, snapshot_id, page_number, line_number, source_line_id, fingerprint), revisions (collection_id, page_number, revision_id, number, kind,
    made_from, request_id), rows (revision_id, ord, snapshot_id, page_number, line_number, line_id), reviews (collection_id, page_number, revision, confirmed), profiles
    (collection_id, signature, approvals, payload map). held: snapshots (collection_id, snapshot_id, fingerprint), reviews (collection_id, page_number, revision,
    confirmed), requests (collection_id, page_number, request_id), lines (collection_id, page_number, line_number, line_id), settings (collection_id, experimental, revision)."""
    lines = held["lines"].select(*LINE, F.col("line_id").alias("own_line"))
    known = held["snapshots"].groupBy("collection_id", "fingerprint").agg(F.min("snapshot_id").alias("own_id"))
    snaps = incoming["snapshots"].join(known, ["collection_id", "fingerprint"], "left").join(lines, LINE, "left")
    snaps = snaps.withColumns({"created": F.col("own_id").isNull(), "new_id": F.coalesce("own_id", _own("snapshot", "collection_id", "fingerprint"))})
    snapshot_ids = snaps.select(F.col("snapshot_id").alias("of_snapshot"), F.col("collection_id").alias("of_collection"), F.col("new_id").alias("new_snapshot")).distinct()

    offsets = held["reviews"].select(*PAGE, F.col("revision").alias("offset"), F.col("confirmed").alias("held_confirmed"))
    shift = F.coalesce("offset", F.lit(0))
    used = held["requests"].select(*PAGE, "request_id").distinct().withColumn("used", F.lit(True))
    revs = incoming["revisions"].join(offsets, PAGE, "left").join(used, [*PAGE, "request_id"], "left")
    revs = revs.withColumn("new_number", F.col("number") + shift).withColumn("new_revision", _own("revision", *PAGE, "new_number"))
    revision_ids = revs.select(F.col("revision_id").alias("of_revision"), "collection_id", "new_revision")

    rows = incoming["rows"].join(revision_ids, F.col("revision_id") == F.col("of_revision")).drop("of_revision")
    rows = rows.join(snapshot_ids, (F.col("snapshot_id") == F.col("of_snapshot")) & (F.col("collection_id") == F.col("of_collection")), "left").join(lines, LINE, "left")
    moved = F.col("own_line").isNotNull() & (F.col("own_line") != F.col("line_id"))

    named = incoming["profiles"].select("collection_id", "signature", F.explode_outer("approvals").alias("approval"))
    mapped = named.join(revision_ids.withColumnRenamed("collection_id", "_c"), (F.col("approval") == F.col("of_revision")) & (F.col("collection_id") == F.col("_c")), "left")
    approvals = mapped.groupBy("collection_id", "signature").agg(F.sort_array(F.collect_list(F.coalesce("new_revision", "approval"))).alias("approvals"))
    portable = F.map_filter("payload", lambda k, v: ~k.isin("index", "cached_index", "index_path", "active_approval", "approved", "approved_at", "mode"))
    lost = rows.filter("snapshot_id is not null and new_snapshot is null").select(F.lit("snapshot").alias("kind"), F.concat_ws(":", "new_revision", "ord").alias("owner"), F.col("snapshot_id").alias("id"))
    lost = lost.unionAll(mapped.filter("approval is not null and new_revision is null").select(F.lit("approval"), "signature", "approval"))
    return {
        "snapshots": snaps.select("collection_id", F.col("new_id").alias("snapshot_id"), "page_number", "line_number", F.coalesce("own_line", "source_line_id").alias("source_line_id"), "fingerprint", "created"),
        "revisions": revs.select(*PAGE, F.col("new_revision").alias("revision_id"), F.col("new_number").alias("number"), "kind", (F.col("made_from") + shift).alias("made_from"), F.when(F.col("used").isNull(), F.col("request_id")).alias("request_id")),
        "rows": rows.select(F.col("new_revision").alias("revision_id"), "ord", F.coalesce("new_snapshot", "snapshot_id").alias("snapshot_id"), "page_number", "line_number", F.coalesce("own_line", "line_id").alias("line_id"), F.when(moved, F.col("line_id")).alias("source_line_id")),
        "reviews": incoming["reviews"].join(offsets, PAGE, "left").select(*PAGE, (F.col("revision") + shift).alias("revision"), F.coalesce(F.col("confirmed") + shift, "held_confirmed").alias("confirmed")),
        "profiles": incoming["profiles"].select("collection_id", "signature", portable.alias("payload")).join(approvals, ["collection_id", "signature"]).withColumn("mode", F.lit("shadow")),
        "settings": held["settings"].select("collection_id", F.lit(False).alias("experimental"), (F.col("revision") + 1).alias("revision")),
        "unresolved": lost,
    }
