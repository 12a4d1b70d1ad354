"""Queries over work bundles: whole page trees and histories that travel."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.operators import bundles as B
from leafmark.plans.base import domain, query

_KEY = "collection_id, page_number, line_number"
_ARRAYS = ("array(array(x, y), array(x + w, y))", "[[x, y], [x + w, y]]")
_PAGES = "SELECT collection_id, page_number, source_page, CAST(o_orderkey % 7 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(1000 AS BIGINT) AS w, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(1400 AS BIGINT) END AS h, reviewed FROM {p}"
_LINES = f"SELECT {_KEY}, type, CASE WHEN x % 5 <> 4 THEN x % 9 END AS chapter, x, y, w, h FROM {{l}}"
_SEGMENTS = f"SELECT {_KEY}, segment_order, x, w, closes, CASE WHEN x % 9 <> 0 THEN CAST(segment_order + line_number AS BIGINT) END AS verse FROM {{s}}"
_STROKES = f"SELECT {_KEY}, 0 AS ord, x % 20 AS size, {{a}} AS points FROM {{l}} WHERE x % 4 = 1 UNION ALL SELECT {_KEY}, 1, y % 9 + 1, {{a}} FROM {{l}} WHERE x % 8 = 1"
_WORDS = "SELECT collection_id, page_number, line_number, CAST(position * 2 AS INT) AS position, word_id, start_x, end_x FROM {w} v JOIN {p} p ON v.page_id = p.o_orderkey"
_STATUS = "SELECT collection_id, page_number, line_number, status, CASE WHEN status IN ('partial', 'unresolved') THEN 'too_few,no_end' END AS reason, page_id % 4 AS deviations, page_id % 3 AS ties, edited FROM {v} v JOIN {p} p ON v.page_id = p.o_orderkey WHERE (page_id + line_number) % 6 <> 2"
_TABLES = f"""tp AS ({_PAGES.format(p='v_page')}), tl AS ({_LINES.format(l='v_line')}), ts AS ({_SEGMENTS.format(s='v_segment')}), tk AS ({_STROKES.format(l='v_line', a=_ARRAYS[1])}), tw AS ({_WORDS.format(w='v_word', p='v_page')}), tt AS ({_STATUS.format(v='v_status', p='v_page')})"""


def _fields(names: str) -> str:
    return "{" + ", ".join(f"'{n}': {n}" for n in names.split()) + "}"


_TREES = f"""{_TABLES}, ls AS (SELECT {_KEY}, list({_fields('segment_order x w closes verse')} ORDER BY segment_order) AS segments FROM ts GROUP BY ALL), lk AS (SELECT {_KEY}, list({_fields('size points')} ORDER BY ord) AS strokes FROM tk GROUP BY ALL),
lw AS (SELECT {_KEY}, list({_fields('word_id position start_x end_x')} ORDER BY position, word_id) AS words FROM tw GROUP BY ALL), lt AS (SELECT {_KEY}, {_fields('status reason deviations ties edited')} AS status FROM tt),
ll AS (SELECT collection_id, page_number, list({{'line_number': line_number, 'type': type, 'chapter': chapter, 'x': x, 'y': y, 'w': w, 'h': h, 'segments': coalesce(segments, []), 'strokes': coalesce(strokes, []), 'words': coalesce(words, []), 'status': status}} ORDER BY line_number) AS lines
  FROM tl LEFT JOIN ls USING ({_KEY}) LEFT JOIN lk USING ({_KEY}) LEFT JOIN lw USING ({_KEY}) LEFT JOIN lt USING ({_KEY}) GROUP BY ALL),
tr AS (SELECT collection_id, page_number, to_json({{'schema': '{B.SCHEMA}', 'source_page': source_page, 'x': x, 'y': y, 'w': w, 'h': h, 'reviewed': reviewed, 'lines': coalesce(lines, [])}}) AS tree FROM tp LEFT JOIN ll USING (collection_id, page_number))"""


def _strokes(lines):
    """_STROKES in one reading of the lines."""
    points = F.expr(_ARRAYS[0])
    of = lambda ord, size: F.struct(F.lit(ord).alias("ord"), size.alias("size"), points.alias("points"))
    both = F.array_compact(F.array(F.when(F.col("x") % 4 == 1, of(0, F.col("x") % 20)), F.when(F.col("x") % 8 == 1, of(1, F.col("y") % 9 + 1))))
    return lines.select(*B.LINE, F.explode(both).alias("k")).select(*B.LINE, "k.*")


def _tables(spark, sf_dir):
    pages, lines, segments, words, status = domain(spark, sf_dir, "page", "line", "segment", "page_word", "page_status")
    # words and status come with their pages
    own = lambda sql: sql.split(" v JOIN {p}")[0] + (" WHERE" + sql.split(" WHERE")[1] if " WHERE" in sql else "")
    return (spark.sql(_PAGES.format(p="{p}"), p=pages), spark.sql(_LINES.format(l="{l}"), l=lines), spark.sql(_SEGMENTS.format(s="{s}"), s=segments), _strokes(lines),
            spark.sql(own(_WORDS).format(w="{w}"), w=words), spark.sql(own(_STATUS).format(v="{v}"), v=status))


@query(f"WITH {_TREES} SELECT collection_id, page_number, md5(tree::VARCHAR) AS tree FROM tr")
def a05_a11_page_trees(spark, sf_dir):
    return B.exported_trees(*_tables(spark, sf_dir)).select("collection_id", "page_number", F.md5(B.tree_json()).alias("tree"))


def _documents(spark, sf_dir):
    """Documents of odd pages have segments without order and closing marks and words without positions; some have a tag of another kind."""
    trees = B.exported_trees(*_tables(spark, sf_dir))
    bare = F.transform("tree.lines", lambda l: l.withField("segments", F.transform(l["segments"], lambda s: F.struct(s["x"].alias("x"), s["w"].alias("w")))).withField("words", F.transform(l["words"], lambda w: F.struct(w["word_id"].alias("word_id"), w["start_x"].alias("start_x"), w["end_x"].alias("end_x")))))
    tag = F.when(F.col("page_number") % 19 == 4, "other/v1").otherwise("page-tree/v1")
    odd = F.to_json(F.col("tree").withField("lines", bare).withField("schema", tag))
    return trees.select("collection_id", "page_number", F.when(F.col("page_number") % 2 == 0, F.to_json(F.col("tree").withField("schema", tag))).otherwise(odd).alias("document"))


def _imported(spark, sf_dir):
    return B.imported_trees(_documents(spark, sf_dir))


_READ = "page_number % 19 <> 4"


@query(f"WITH {_TABLES} SELECT {_KEY}, CASE WHEN page_number % 2 = 0 THEN segment_order ELSE CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY segment_order) AS INT) END AS segment_order, x, w, CASE WHEN page_number % 2 = 0 THEN closes ELSE false END AS closes, CASE WHEN page_number % 2 = 0 THEN verse END AS verse FROM ts WHERE {_READ}")
def a06_tree_rows(spark, sf_dir):
    return _imported(spark, sf_dir)["segments"]


@query(f"WITH {_TABLES} SELECT {_KEY}, CASE WHEN page_number % 2 = 0 THEN position ELSE CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY position, word_id) - 1 AS INT) END AS position, word_id, start_x, end_x FROM tw WHERE {_READ}")
def a06_tree_words(spark, sf_dir):
    return _imported(spark, sf_dir)["words"]


@query(f"WITH {_TABLES} SELECT {_KEY}, 'status' AS part, concat_ws(',', status, reason, deviations, ties, edited) AS content FROM tt WHERE {_READ} UNION ALL SELECT {_KEY}, 'stroke', concat_ws(',', ord, size, points[1][1], points[2][1], len(points)) FROM tk WHERE {_READ} UNION ALL SELECT {_KEY}, 'line', concat_ws(',', type, chapter, x, y, w, h) FROM tl WHERE {_READ}")
def a06_tree_parts(spark, sf_dir):
    """Three kinds of parts out of one reading of the documents."""
    lines = B.imported_lines(_documents(spark, sf_dir))
    of = lambda name, *c: F.struct(F.lit(name).alias("part"), F.concat_ws(",", *c).alias("content"))
    at = lambda name, *fields: [F.col(f"l.{name}{f}") for f in fields]

    def stroke(v, i):
        points = B.stroke_points(v["points"])
        return of("stroke", i, B.stroke_size(v["size"]), F.get(F.get(points, F.lit(0)), F.lit(0)), F.get(F.get(points, F.lit(1)), F.lit(0)), F.size(points))

    status = F.when(F.col("l.status").isNotNull(), of("status", *at("status.", "status", "reason", "deviations", "ties"), F.col("l.status.edited").cast("string")))
    found = F.concat(F.array_compact(F.array(status, of("line", *at("", "type", "chapter", "x", "y", "w", "h")))), F.coalesce(F.transform("l.strokes", stroke), F.array()))
    return lines.select(*B.LINE, F.posexplode_outer(found).alias("i", "p")).select(*B.LINE, "p.part", "p.content")


@query(f"WITH {_TABLES}, n AS (SELECT DISTINCT collection_id, page_number FROM tl WHERE page_number % 4 = 1 AND line_number < 4) SELECT 'page' AS part, collection_id, page_number, CASE WHEN reviewed AND n.page_number IS NULL THEN 1 ELSE 0 END AS line_number, CAST(NULL AS BIGINT) AS value FROM tp LEFT JOIN n USING (collection_id, page_number) UNION ALL SELECT 'line', {_KEY}, chapter FROM tl WHERE (collection_id, page_number) NOT IN (SELECT (collection_id, page_number) FROM n) UNION ALL SELECT 'line', collection_id, page_number, line_number + 1, NULL FROM tl WHERE page_number % 4 = 1 AND line_number < 4 UNION ALL SELECT 'stroke', {_KEY}, size FROM tk WHERE (collection_id, page_number) NOT IN (SELECT (collection_id, page_number) FROM n)")
def j01_replaced_pages(spark, sf_dir):
    pages, lines, _, strokes, _, _ = _tables(spark, sf_dir)
    new = lines.filter("page_number % 4 = 1 and line_number < 4").withColumn("line_number", F.col("line_number") + 1)
    found = B.replaced_structure(pages, lines, strokes, new)
    rows = found["pages"].selectExpr("'page' AS part", "collection_id", "page_number", "CAST(reviewed AS INT) AS line_number", "CAST(NULL AS BIGINT) AS value")
    return rows.unionAll(found["lines"].selectExpr("'line'", *B.LINE, "chapter")).unionAll(found["strokes"].selectExpr("'stroke'", *B.LINE, "size"))


@query(f"WITH {_TABLES} SELECT 'line' AS part, {_KEY}, CASE WHEN x % 3 = 0 THEN y + 2 ELSE y END AS y, CASE WHEN x % 3 = 0 AND x % 2 = 0 THEN h - 1 ELSE h END AS h FROM tl UNION ALL SELECT 'stroke', {_KEY}, ord, size FROM tk SEMI JOIN (SELECT * FROM tl WHERE x % 3 <> 0) g USING ({_KEY}) UNION ALL SELECT 'stroke', {_KEY}, 5, x % 50 FROM tl WHERE x % 3 = 0 AND x % 4 = 1")
def j06_finalized(spark, sf_dir):
    _, lines, _, strokes, _, _ = _tables(spark, sf_dir)
    given = lines.filter("x % 3 = 0").selectExpr(*B.LINE, "y + 2 AS y", "CASE WHEN x % 2 = 0 THEN h - 1 END AS h")
    drawn = lines.filter("x % 4 = 1").selectExpr(*B.LINE, "5 AS ord", "x % 50 AS size", f"{_ARRAYS[0]} AS points")
    set_, left = B.finalized(lines, strokes, given, drawn)
    return set_.selectExpr("'line' AS part", *B.LINE, "y", "h").unionAll(left.selectExpr("'stroke'", *B.LINE, "CAST(ord AS BIGINT)", "size"))


# a history in even collections that joins those of each fourth; one row in some names a snapshot that stayed behind
_IN = "SELECT * FROM {r} WHERE collection_id % 2 = 0"
_REVISIONS = "SELECT collection_id, page_number, concat('r', review_id, '-', number) AS revision_id, number, kind, CASE WHEN number > 1 THEN number - 1 END AS made_from, concat('q', review_id * 10 + number) AS request_id FROM {i}"
_ROWS = "SELECT concat('r', review_id, '-', number) AS revision_id, o AS ord, concat('s', collection_id, '-', page_number, '-', (number + o) % 5) AS snapshot_id, page_number, CAST((number + o) % 5 + 1 AS INT) AS line_number, concat('far', review_id, '-', o) AS line_id FROM {i} CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) z"
_SNAPSHOTS = "SELECT collection_id, concat('s', collection_id, '-', page_number, '-', k) AS snapshot_id, page_number, CAST(k + 1 AS INT) AS line_number, concat('far', k) AS source_line_id, md5(concat(collection_id, '|', page_number, '|', k)) AS fingerprint, k FROM (SELECT DISTINCT collection_id, page_number FROM {i}) d CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) z"
_HELD = "SELECT collection_id, concat('own', snapshot_id) AS snapshot_id, fingerprint FROM {s} WHERE (collection_id + page_number + k) % 3 = 0"
_REVIEWS = "SELECT collection_id, page_number, max(number) AS revision, CASE WHEN page_number % 3 <> 0 THEN max(number) END AS confirmed FROM {i} GROUP BY collection_id, page_number"
_OWN_REVIEWS = "SELECT collection_id, page_number, max(number) AS revision, CASE WHEN page_number % 2 = 0 THEN max(number) END AS confirmed FROM {i} WHERE collection_id % 4 = 0 GROUP BY collection_id, page_number"
_REQUESTS = "SELECT collection_id, page_number, concat('q', review_id * 10 + number) AS request_id FROM {i} WHERE review_id % 5 = 0"
_OWN_LINES = "SELECT collection_id, CAST(page_number AS BIGINT) AS page_number, line_number, concat('own', x) AS line_id FROM {l} WHERE line_number < 4"
_HISTORY = f"""hi AS ({_IN.format(r='v_revision')}), rv AS ({_REVISIONS.format(i='hi')}), rw AS ({_ROWS.format(i='hi')}), sn AS ({_SNAPSHOTS.format(i='hi')}), hs AS ({_HELD.format(s='sn')}), re AS ({_REVIEWS.format(i='hi')}), ore AS ({_OWN_REVIEWS.format(i='hi')}), rq AS ({_REQUESTS.format(i='hi')}), ol AS ({_OWN_LINES.format(l='v_line')}),
sx AS (SELECT sn.*, hs.snapshot_id IS NULL AS created, coalesce(hs.snapshot_id, sha256(concat_ws('|', 'snapshot', sn.collection_id, sn.fingerprint))) AS new_id, ol.line_id AS own_line FROM sn LEFT JOIN hs USING (collection_id, fingerprint) LEFT JOIN ol USING ({_KEY})),
rx AS (SELECT rv.*, coalesce(ore.revision, 0) AS shift, sha256(concat_ws('|', 'revision', rv.collection_id, rv.page_number, rv.number + coalesce(ore.revision, 0))) AS new_revision, EXISTS (SELECT 1 FROM rq WHERE rq.request_id = rv.request_id AND rq.collection_id = rv.collection_id AND rq.page_number = rv.page_number) AS used FROM rv LEFT JOIN ore USING (collection_id, page_number)),
ry AS (SELECT rx.collection_id, new_revision, rw.*, new_id, ol.line_id AS own_line FROM rw JOIN rx USING (revision_id) LEFT JOIN sx ON sx.snapshot_id = rw.snapshot_id AND sx.collection_id = rx.collection_id LEFT JOIN ol ON ol.collection_id = rx.collection_id AND ol.page_number = rw.page_number AND ol.line_number = rw.line_number)"""


def _restored(spark, sf_dir):
    revisions, lines = domain(spark, sf_dir, "revision", "line")
    i = spark.sql(_IN.format(r="{r}"), r=revisions)
    of = lambda sql, **given: spark.sql(sql.format(**{k: f"{{{k}}}" for k in given}), **given)
    snapshots = of(_SNAPSHOTS, i=i)
    named = of(_REVISIONS, i=i)
    approvals = named.filter("number = 1").groupBy("collection_id").agg(F.collect_list("revision_id").alias("a"))
    payload = F.create_map(F.lit("mode"), F.lit("live"), F.lit("k"), F.col("collection_id").cast("string"), F.lit("approved_at"), F.lit("now"))
    profiles = approvals.select("collection_id", F.concat(F.lit("sig"), "collection_id").alias("signature"), F.concat("a", F.array(F.concat(F.lit("lost"), "collection_id"))).alias("approvals"), payload.alias("payload"))
    incoming = {"snapshots": snapshots.drop("k"), "revisions": named, "rows": of(_ROWS, i=i), "reviews": of(_REVIEWS, i=i), "profiles": profiles}
    settings = i.select("collection_id").distinct().select("collection_id", F.lit(True).alias("experimental"), F.col("collection_id").alias("revision"))
    return B.restored(incoming, {"snapshots": of(_HELD, s=snapshots), "reviews": of(_OWN_REVIEWS, i=i), "requests": of(_REQUESTS, i=i), "lines": of(_OWN_LINES, l=lines), "settings": settings})


@query(f"WITH {_HISTORY} SELECT new_revision AS revision_id, ord, coalesce(new_id, snapshot_id) AS snapshot_id, page_number, line_number, coalesce(own_line, line_id) AS line_id, CASE WHEN own_line <> line_id THEN line_id END AS source_line_id FROM ry")
def a07_c20_restored_history(spark, sf_dir):
    return _restored(spark, sf_dir)["rows"]


@query(f"WITH {_HISTORY} SELECT collection_id, page_number, new_revision AS revision_id, number + shift AS number, kind, made_from + shift AS made_from, CASE WHEN NOT used THEN request_id END AS request_id FROM rx")
def a07_restored_revisions(spark, sf_dir):
    return _restored(spark, sf_dir)["revisions"]


@query(f"""WITH {_HISTORY} SELECT 'snapshot' AS part, collection_id, concat_ws(',', new_id, page_number, line_number, coalesce(own_line, source_line_id), created) AS content FROM sx
UNION ALL SELECT 'review', collection_id, concat_ws(',', page_number, re.revision + coalesce(ore.revision, 0), coalesce(re.confirmed + coalesce(ore.revision, 0), ore.confirmed)) FROM re LEFT JOIN ore USING (collection_id, page_number)
UNION ALL SELECT 'profile', collection_id, concat_ws(',', 'sig' || collection_id, 'shadow', 'k=' || collection_id, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT new_revision AS v FROM rx WHERE rx.collection_id = d.collection_id AND number = 1 UNION ALL SELECT 'lost' || d.collection_id) q)) FROM (SELECT DISTINCT collection_id FROM hi) d
UNION ALL SELECT 'settings', collection_id, 'false,' || (collection_id + 1) FROM (SELECT DISTINCT collection_id FROM hi) d
UNION ALL SELECT 'unresolved', 0, concat_ws(',', 'snapshot', new_revision || ':' || ord, snapshot_id) FROM ry WHERE new_id IS NULL UNION ALL SELECT 'unresolved', 0, concat_ws(',', 'approval', 'sig' || collection_id, 'lost' || collection_id) FROM (SELECT DISTINCT collection_id FROM hi) d""")
def a07_restored_parts(spark, sf_dir):
    found = _restored(spark, sf_dir)
    text = lambda *c: F.concat_ws(",", *(F.col(x).cast("string") for x in c)).alias("content")
    flat = found["profiles"].select("collection_id", "signature", "mode", F.array_join(F.transform(F.map_entries("payload"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("p"), F.array_join("approvals", ",").alias("a"))
    parts = {"snapshot": (found["snapshots"], ("snapshot_id", "page_number", "line_number", "source_line_id", "created")), "review": (found["reviews"], ("page_number", "revision", "confirmed")), "profile": (flat, ("signature", "mode", "p", "a")), "settings": (found["settings"], ("experimental", "revision")), "unresolved": (found["unresolved"].withColumn("collection_id", F.lit(0).cast("long")), ("kind", "owner", "id"))}
    out = None
    for name, (df, columns) in parts.items():
        one = df.select(F.lit(name).alias("part"), "collection_id", text(*columns))
        out = one if out is None else out.unionAll(one)
    return out


@query(f"WITH {_HISTORY} SELECT collection_id, md5(to_json(list({{'page_number': page_number, 'line_number': line_number, 'snapshot_id': snapshot_id, 'source_line_id': source_line_id, 'fingerprint': fingerprint}} ORDER BY page_number, line_number, snapshot_id))::VARCHAR) AS snapshots FROM sn GROUP BY collection_id")
def a08_exported_snapshots(spark, sf_dir):
    (revisions,) = domain(spark, sf_dir, "revision")
    i = spark.sql(_IN.format(r="{r}"), r=revisions)
    return B.exported_snapshots(spark.sql(_SNAPSHOTS.format(i="{i}"), i=i)).select("collection_id", F.md5(F.to_json("snapshots", {"ignoreNullFields": "false"})).alias("snapshots"))
