"""All registered queries over the reference's operators, with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import arabic
from leafmark.operators import components as C
from leafmark.operators import numbering as N
from leafmark.operators import series as S
from leafmark.operators import summary as M
from leafmark.operators import words as W
from leafmark.plans.base import QUERIES, SQL, query, tables
from leafmark.plans.base import domain as _views
from leafmark.sources.views import row_parts, view
from leafmark.streaming import jobs as J


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables(spark, sf_dir, name)[0]


_WALK = """WITH isl AS (SELECT *, page_number - row_number() OVER (PARTITION BY collection_id ORDER BY page_number) AS island FROM v_page),
seed AS (SELECT collection_id, page_number, island, first_value(start_chapter) OVER w AS s0, first_value(start_verse) OVER w AS v0 FROM isl WINDOW w AS (PARTITION BY collection_id, island ORDER BY page_number)),
ev AS (SELECT collection_id, page_number, line_number, segment_order, 0 AS header, CAST(closes AS INT) AS c, x, w FROM v_segment
  UNION ALL SELECT collection_id, page_number, line_number, 0, 1, 0, NULL, NULL FROM v_line WHERE type = 'header'),
r1 AS (SELECT ev.*, island, s0, v0, sum(header) OVER (PARTITION BY collection_id, island ORDER BY page_number, line_number, segment_order ROWS UNBOUNDED PRECEDING) AS hgrp FROM ev JOIN seed USING (collection_id, page_number)),
g AS (SELECT collection_id, island, hgrp, sum(c) AS closes_in FROM r1 GROUP BY ALL),
eff AS (SELECT collection_id, island, hgrp, lag(closes_in) OVER (PARTITION BY collection_id, island ORDER BY hgrp) AS prev FROM g),
r2 AS (SELECT r1.*, CASE WHEN header = 1 AND (coalesce(prev, 0) > 0 OR (r1.hgrp = 1 AND v0 <> 1)) THEN 1 ELSE 0 END AS e FROM r1 JOIN eff USING (collection_id, island, hgrp)),
numbered AS (SELECT *, s0 + sum(e) OVER (PARTITION BY collection_id, island ORDER BY page_number, line_number, segment_order ROWS UNBOUNDED PRECEDING) AS chapter,
  CASE WHEN hgrp = 0 THEN v0 ELSE 1 END + coalesce(sum(c) OVER (PARTITION BY collection_id, island, hgrp ORDER BY page_number, line_number, segment_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS verse FROM r2),
walked AS (SELECT collection_id, page_number, line_number, segment_order, c = 1 AS closes, x, w, CAST(chapter AS BIGINT) AS chapter, CAST(verse AS BIGINT) AS verse FROM numbered WHERE header = 0)
"""


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.walk(*_views(spark, sf_dir, "page", "line", "segment"), row_parts(spark, sf_dir))


@query(_WALK + "SELECT * FROM walked")
def e05_numbering_walk(spark, sf_dir):
    return _walked(spark, sf_dir)


@query("SELECT collection_id, page_number, CAST(page_number - row_number() OVER (PARTITION BY collection_id ORDER BY page_number) AS BIGINT) AS island FROM v_page")
def e04_islands(spark, sf_dir):
    return N.islands(view(spark, sf_dir, "v_page"), "collection_id", "page_number").select("collection_id", "page_number", F.col("island").cast("long").alias("island"))


@query(_WALK + """, first AS (SELECT collection_id, page_number, chapter, verse, min(line_number * 1000 + segment_order) AS f FROM walked GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY collection_id, page_number ORDER BY f, chapter, verse) AS verse_order FROM first)
SELECT collection_id, page_number, CAST(verse_order AS INT) AS verse_order, chapter, verse, CAST(row_number() OVER (PARTITION BY collection_id, page_number, chapter, verse ORDER BY line_number, segment_order) AS INT) AS rect_order, s.x, l.y, s.w, l.h
FROM walked s JOIN o USING (collection_id, page_number, chapter, verse) JOIN v_line l USING (collection_id, page_number, line_number)""")
def a09_verse_rectangles(spark, sf_dir):
    pages, lines, segments = _views(spark, sf_dir, "page", "line", "segment")
    return N.verse_rectangles(N.walk(pages, lines, segments, row_parts(spark, sf_dir)), lines)


@query("""WITH cl AS (SELECT collection_id, page_number, line_number, bool_or(closes) AS b FROM v_segment GROUP BY ALL),
l AS (SELECT *, lag(type) OVER (PARTITION BY collection_id ORDER BY page_number, line_number) AS previous FROM v_line)
SELECT collection_id, page_number, line_number, NOT coalesce(b, false) AS basmala FROM l LEFT JOIN cl USING (collection_id, page_number, line_number) WHERE type <> 'header' AND previous = 'header'""")
def e09_basmala_lines(spark, sf_dir):
    return N.basmala_lines(*_views(spark, sf_dir, "line", "segment"))


@query("""WITH a AS (SELECT collection_id, page_number, count(*) AS n_lines, count(*) FILTER (type = 'header') AS n_headers FROM v_line GROUP BY ALL),
ch AS (SELECT collection_id, page_number, string_agg(c, ',' ORDER BY c) AS chapters FROM (SELECT DISTINCT collection_id, page_number, x % 4 AS c FROM v_line WHERE x % 9 <> 0) GROUP BY ALL),
b AS (SELECT collection_id, page_number, count(*) AS n_segments, count(*) FILTER (closes) AS n_verses FROM v_segment GROUP BY ALL)
SELECT collection_id, page_number, reviewed, coalesce(n_lines, 0) AS n_lines, coalesce(n_headers, 0) AS n_headers, coalesce(n_segments, 0) AS n_segments, coalesce(n_verses, 0) AS n_verses, coalesce(n_headers, 0) > 0 AS has_header, coalesce(chapters, '') AS chapters
FROM v_page LEFT JOIN a USING (collection_id, page_number) LEFT JOIN b USING (collection_id, page_number) LEFT JOIN ch USING (collection_id, page_number)""")
def d01_l03_page_summary(spark, sf_dir):
    pages, lines, segments = _views(spark, sf_dir, "page", "line", "segment")
    found = M.page_summary(pages, lines.withColumn("chapter", F.when(F.col("x") % 9 != 0, F.col("x") % 4)), segments)
    return found.withColumn("chapters", F.array_join("chapters", ","))


@query("""WITH a AS (SELECT collection_id, count(*) AS n_lines, count(*) FILTER (type = 'header') AS n_headers, count(*) FILTER (type = 'basmala') AS n_basmalas, count(*) FILTER (line_number % 3 = 0) AS n_exported FROM v_line GROUP BY ALL),
b AS (SELECT collection_id, count(*) AS n_segments, count(*) FILTER (closes) AS n_verses FROM v_segment GROUP BY ALL)
SELECT collection_id, n_lines, n_headers, n_basmalas, n_exported, coalesce(n_segments, 0) AS n_segments, coalesce(n_verses, 0) AS n_verses FROM a LEFT JOIN b USING (collection_id)""")
def d02_collection_stats(spark, sf_dir):
    lines, segments = _views(spark, sf_dir, "line", "segment")
    image = F.when(F.col("line_number") % 3 == 0, "p.png").when(F.col("line_number") % 3 == 1, "")
    return M.collection_stats(lines.withColumn("image", image), segments)


@query("""WITH l AS (SELECT page_id, line_number FROM v_status WHERE (page_id + line_number) % 13 > 1 UNION ALL SELECT DISTINCT page_id, 99 FROM v_status WHERE page_id % 7 = 0), n AS (SELECT page_id, line_number, count(*) AS n, count(word_id) AS k FROM v_word WHERE (page_id * 3 + line_number) % 11 <> 4 GROUP BY ALL),
c AS (SELECT page_id, count(*) AS n_lines, count(n) AS n_worded, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_words, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_labelled, count(*) FILTER (status IN ('scored', 'partial', 'unresolved')) AS needs_review FROM l LEFT JOIN n USING (page_id, line_number) LEFT JOIN v_status USING (page_id, line_number) GROUP BY page_id)
SELECT *, needs_review = 0 AND n_worded = n_lines AS complete FROM c""")
def d03_word_coverage(spark, sf_dir):
    """Some text lines have no words, and headers aren't counted."""
    words, status = _views(spark, sf_dir, "word", "status")
    kind = F.when((F.col("page_id") + F.col("line_number")) % 13 > 1, "text").otherwise("header")
    lines = status.select("page_id", "line_number", kind.alias("type")).unionAll(status.filter("page_id % 7 = 0").select("page_id", F.lit(99), F.lit("text")).distinct())
    return M.word_coverage(lines, words.filter("(page_id * 3 + line_number) % 11 <> 4"), status)


@query("""WITH r AS (SELECT line AS grp, w, unnest(range(y, y + h)) AS position FROM v_component), s AS (SELECT grp, position, sum(w) AS value FROM r GROUP BY ALL), e AS (SELECT grp, unnest(range(min(position), max(position) + 1)) AS position FROM s GROUP BY grp)
SELECT grp, position, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM e LEFT JOIN s USING (grp, position)""")
def f01_profiles(spark, sf_dir):
    return S.profile(view(spark, sf_dir, "v_component"), "line")


@query("""WITH c AS (SELECT DISTINCT CAST(floor(o_orderkey / 100) AS BIGINT) AS collection_id FROM orders), p AS (SELECT * FROM v_page WHERE collection_id % 7 <> 3), s AS (SELECT collection_id, count(*) AS n, count(*) FILTER (reviewed) AS r FROM p GROUP BY ALL)
SELECT row_number() OVER (ORDER BY collection_id * 37 % 101 DESC, collection_id DESC) AS place, collection_id, coalesce(n, 0) AS n_processed, coalesce(r, 0) AS n_reviewed FROM c LEFT JOIN s USING (collection_id)""")
def d04_collections_listing(spark, sf_dir):
    pages = view(spark, sf_dir, "v_page")
    collections = pages.select("collection_id").distinct().withColumn("created", F.col("collection_id") * 37 % 101)
    return M.collections_listing(collections, pages.filter("collection_id % 7 <> 3"))


@query("SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v_status GROUP BY status")
def d12_status_histogram(spark, sf_dir):
    return M.status_histogram(view(spark, sf_dir, "v_status"))


@query("""WITH r AS (SELECT line_number, unnest(string_split(CASE WHEN page_id % 3 = 0 THEN 'a; b' WHEN page_id % 3 = 1 THEN 'b; c' ELSE '' END, '; ')) AS reason FROM v_status WHERE status <> 'exact') SELECT reason, count(*) AS n FROM r WHERE reason <> '' GROUP BY reason""")
def d12_reason_histogram(spark, sf_dir):
    rows = view(spark, sf_dir, "v_status").filter("status <> 'exact'").selectExpr("CASE WHEN page_id % 3 = 0 THEN 'a; b' WHEN page_id % 3 = 1 THEN 'b; c' ELSE '' END AS reason")
    return M.reason_histogram(rows)


@query("""WITH c AS (SELECT *, CASE WHEN y <= 25 AND y + h > 25 THEN area END AS crossing FROM v_component) SELECT line, median(crossing) AS median_area, coalesce(median(crossing), 1.0) AS typical_area, median(CASE WHEN role = 'body' THEN h END) AS median_height, coalesce(min(crossing), 0) AS smallest FROM c GROUP BY line""")
def d17_typical_sizes(spark, sf_dir):
    return C.typical_sizes(view(spark, sf_dir, "v_component"), 25)


@query("SELECT line, count(*) FILTER (role = 'body') AS bodies, count(*) FILTER (role = 'mark') AS marks, count(*) FILTER (role = 'ornament') AS ornaments, count(*) FILTER (role = 'symbol') AS symbols, count(*) FILTER (w % 6 = 0) AS ambiguous FROM (SELECT line, w, CASE WHEN label % 11 = 0 THEN 'ornament' WHEN label % 9 = 4 THEN 'symbol' ELSE role END AS role FROM v_component) GROUP BY line")
def d13_role_counts(spark, sf_dir):
    role = F.when(F.col("label") % 11 == 0, "ornament").when(F.col("label") % 9 == 4, "symbol").otherwise(F.col("role"))
    return C.role_counts(view(spark, sf_dir, "v_component").withColumns({"role": role, "ambiguous": F.col("w") % 6 == 0}))


@query("WITH l AS (SELECT CASE WHEN collection_id % 5 <> 2 THEN collection_id END AS collection_id, CASE WHEN page_number % 9 <> 4 THEN page_number END AS page_number, type FROM v_line) SELECT collection_id, page_number, false AS whole, count(*) FILTER (type = 'header') AS headers, count(*) FILTER (type = 'text') AS texts FROM l GROUP BY collection_id, page_number UNION ALL SELECT collection_id, NULL, true, count(*) FILTER (type = 'header'), count(*) FILTER (type = 'text') FROM l GROUP BY collection_id")
def d24_rollup_totals(spark, sf_dir):
    lines = view(spark, sf_dir, "v_line").selectExpr("CASE WHEN collection_id % 5 <> 2 THEN collection_id END AS collection_id", "CASE WHEN page_number % 9 <> 4 THEN page_number END AS page_number", "type").withColumns({"headers": (F.col("type") == "header").cast("int"), "texts": (F.col("type") == "text").cast("int")})
    return M.totals_by(lines, "collection_id", "page_number", ["headers", "texts"])


@query("SELECT collection_id, page_number, coalesce(source_page, first_page + page_number - 1) AS physical, coalesce(nullif(source_page, 0), first_page + page_number - 1) AS physical_nonzero FROM v_page")
def b03_source_pages(spark, sf_dir):
    return M.source_pages(view(spark, sf_dir, "v_page"))


@query("WITH d AS (SELECT doc_id, md5(text) AS m FROM documents), t AS (SELECT m, count(*) AS shared, min(doc_id) AS earliest FROM d GROUP BY m) SELECT doc_id, shared, shared = 1 AS unshared, earliest FROM d JOIN t USING (m)")
def d22_j08_shared_files(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.col("doc_id").alias("created"))
    return M.shared_files(docs, "digest", "created", "doc_id")


@query("""SELECT DISTINCT a.* FROM v_component a JOIN v_component b ON a.line = b.line AND a.label <> b.label AND b.x <= a.x AND b.y <= a.y AND a.x + a.w <= b.x + b.w AND a.y + a.h <= b.y + b.h AND a.area < 0.35 * b.area""")
def c05_nested(spark, sf_dir):
    return C.nested(view(spark, sf_dir, "v_component"))


_NEAR = """near AS (SELECT m.line, m.label, b.label AS body, CASE WHEN 2 * m.x + m.w BETWEEN 2 * b.x AND 2 * (b.x + b.w) THEN abs(2 * m.x + m.w - 2 * b.x - b.w) ELSE least(abs(2 * m.x + m.w - 2 * b.x), abs(2 * m.x + m.w - 2 * (b.x + b.w))) + 20000 END AS away, b.x + b.w AS edge
  FROM v_component m JOIN v_component b ON m.line = b.line AND m.role = 'mark' AND b.role = 'body'),
best AS (SELECT line, label, body, away FROM near QUALIFY row_number() OVER (PARTITION BY line, label ORDER BY away, edge DESC, body) = 1)"""


@query(f"WITH {_NEAR} SELECT * FROM best")
def c06_nearest_bodies(spark, sf_dir):
    return C.nearest_bodies(view(spark, sf_dir, "v_component"))


@query(f"""WITH {_NEAR}, p AS (SELECT line, label, body FROM best UNION ALL SELECT line, label, label FROM v_component WHERE role = 'body')
SELECT line, body, min(x) AS "left", max(x + w) AS "right", min(y) AS top, max(y + h) AS bottom, count(*) AS parts FROM p JOIN v_component USING (line, label) GROUP BY line, body""")
def d14_word_boxes(spark, sf_dir):
    return C.word_boxes(view(spark, sf_dir, "v_component"))


@query("""WITH m AS (SELECT line, x AS l, x + w AS r, max(x + w) OVER (PARTITION BY line ORDER BY x, x + w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_component),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS run FROM m),
g AS (SELECT line, min(l) AS "left", max(r) AS "right", count(*) AS merged FROM i GROUP BY line, run)
SELECT line, CAST(row_number() OVER (PARTITION BY line ORDER BY "right" DESC) AS INT) AS ord, "left", "right", merged FROM g""")
def f11_interval_union(spark, sf_dir):
    rows = view(spark, sf_dir, "v_component").select("line", F.col("x").alias("left"), (F.col("x") + F.col("w")).alias("right"))
    return C.interval_union(rows, "line", "left", "right")


@query("""WITH geo AS (SELECT line, CAST(8 + line % 5 AS BIGINT) AS top, CAST(38 + line % 7 AS BIGINT) AS bottom, CAST(20 + line % 9 AS BIGINT) AS peak FROM (SELECT DISTINCT line FROM v_component)),
c AS (SELECT v.*, top, bottom, bottom - top + 1 AS band, y <= peak AND peak < y + h AS crosses FROM v_component v JOIN geo USING (line)), m AS (SELECT line, coalesce(median(area) FILTER (crosses), 1.0) AS med FROM c GROUP BY line),
ne AS (SELECT DISTINCT a.line, a.label FROM v_component a JOIN v_component b ON a.line = b.line AND a.label <> b.label AND b.x <= a.x AND b.y <= a.y AND a.x + a.w <= b.x + b.w AND a.y + a.h <= b.y + b.h AND a.area < 0.35 * b.area),
s AS (SELECT c.line, c.label, CAST(greatest(0, round_even(round(6 * CAST(crosses AS INT) + 3 * least(1.0, greatest(0, least(y + h, bottom + 1) - greatest(y, top)) / CAST(band AS DOUBLE)) + 3 * least(1.0, area / greatest(med, 1.0)) + 2 * least(1.0, h / CAST(band AS DOUBLE)) - CASE WHEN ne.line IS NOT NULL THEN 4 ELSE 0 END, 9), 0)) AS INT) AS score
  FROM c JOIN m USING (line) LEFT JOIN ne ON ne.line = c.line AND ne.label = c.label)
SELECT line, label, score, 14 - score AS cost_as_body, least(score, 6) AS cost_as_mark FROM s""")
def g10_g11_body_scores(spark, sf_dir):
    components = view(spark, sf_dir, "v_component")
    return C.body_scores(components, components.selectExpr("line", "8 + line % 5 AS top", "38 + line % 7 AS bottom", "20 + line % 9 AS peak").distinct())


@query("WITH p AS (SELECT *, lag(word_id) OVER (PARTITION BY page_id, line_number ORDER BY position) AS previous FROM v_word WHERE word_id IS NOT NULL) SELECT page_id, line_number, position, word_id, previous FROM p WHERE word_id < previous")
def e18_out_of_sequence(spark, sf_dir):
    return W.out_of_sequence(view(spark, sf_dir, "v_word"))


@query("WITH p AS (SELECT *, max(line_number) OVER (PARTITION BY page_id, word_id ORDER BY line_number RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_line FROM v_word WHERE word_id IS NOT NULL) SELECT page_id, line_number, position, word_id, earlier_line FROM p WHERE earlier_line IS NOT NULL")
def e18_overlaps(spark, sf_dir):
    return W.overlaps(view(spark, sf_dir, "v_word"))


@query("""WITH l AS (SELECT page_id, line_number, arg_min(word_id, position) AS first_id, arg_max(word_id, position) AS last_id FROM v_word WHERE word_id IS NOT NULL GROUP BY ALL),
g AS (SELECT *, lag(last_id) OVER (PARTITION BY page_id ORDER BY line_number) AS before FROM l)
SELECT page_id, line_number, before, first_id, first_id - before - 1 AS n_missing, array_to_string(range(before + 1, least(first_id, before + 21)), ',') AS missing FROM g WHERE first_id > before + 1""")
def e18_line_gaps(spark, sf_dir):
    return W.line_gaps(view(spark, sf_dir, "v_word"))


@query("""WITH v AS (SELECT *, last_value(CAST(floor(word_id / 50) AS BIGINT) IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_number, position ROWS UNBOUNDED PRECEDING) AS verse FROM v_word),
c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(verse) OVER w IS NOT DISTINCT FROM verse OR (row_number() OVER w = 1 AND verse IS NULL) THEN 0 ELSE 1 END AS changed FROM v WINDOW w AS (PARTITION BY page_id ORDER BY line_number, position)),
r AS (SELECT *, sum(changed) OVER (PARTITION BY page_id ORDER BY line_number, position ROWS UNBOUNDED PRECEDING) AS stretch FROM c)
SELECT page_id, CAST(stretch AS BIGINT) AS stretch, any_value(verse) AS verse, count(*) AS drawn, count(word_id) AS pinned, min(word_id) AS least_id, max(word_id) AS greatest_id FROM r GROUP BY page_id, stretch""")
def e20_stretches(spark, sf_dir):
    return W.stretches(view(spark, sf_dir, "v_word"))


@query("""WITH pr AS (SELECT page_id, line_number FROM v_status WHERE edited UNION SELECT page_id, line_number FROM v_word ANTI JOIN v_status USING (page_id, line_number))
SELECT page_id, line_number, status, edited FROM v_status ANTI JOIN pr USING (page_id, line_number) WHERE page_id % 10 <> 0""")
def c13_unprotected_lines(spark, sf_dir):
    words, status = _views(spark, sf_dir, "word", "status")
    confirmed = words.select("page_id").distinct().filter("page_id % 10 = 0")
    return W.unprotected(status, status, words, confirmed)


@query("""WITH d AS (SELECT line % 7 AS scheme, label + x AS token_id, line, label FROM v_component), s AS (SELECT line % 7 AS scheme, x AS start, min(label) AS verse FROM v_component WHERE label = 1 GROUP BY ALL)
SELECT d.scheme, d.token_id, d.line, d.label, s.verse, s.start AS verse_start FROM d ASOF LEFT JOIN s ON d.scheme = s.scheme AND d.token_id >= s.start""")
def c02_asof_verse(spark, sf_dir):
    c = view(spark, sf_dir, "v_component")
    tokens = c.select((F.col("line") % 7).alias("scheme"), (F.col("label") + F.col("x")).alias("token_id"), "line", "label")
    starts = c.filter("label = 1").groupBy((F.col("line") % 7).alias("scheme"), F.col("x").alias("start")).agg(F.min("label").alias("verse")).withColumn("verse_start", F.col("start"))
    return W.asof(tokens, starts, "scheme", "token_id", "start", ["verse", "verse_start"])


_SERIES = """h AS (SELECT event_type AS grp, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS position, count(*) AS value FROM events GROUP BY ALL),
e AS (SELECT grp, unnest(range(min(position), max(position) + 1)) AS position FROM h GROUP BY grp),
f AS (SELECT e.grp, e.position, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM e LEFT JOIN h USING (grp, position)),
a AS (SELECT *, sum(value) OVER (PARTITION BY grp ORDER BY position ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS smooth FROM f)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    counts = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp"), hour.alias("position")).agg(F.count("*").alias("value"))
    return S.filled(counts)


@query(f"WITH {_SERIES} SELECT grp, position, value, round(smooth, 6) AS smooth FROM a")
def f03_moving_average(spark, sf_dir):
    return S.moving_average(_series(spark, sf_dir), 7).withColumn("smooth", F.round("smooth", 6))


@query(f"WITH {_SERIES}, n AS (SELECT *, lag(smooth) OVER w AS p, lead(smooth) OVER w AS q FROM a WINDOW w AS (PARTITION BY grp ORDER BY position)) SELECT grp, position, value, round(smooth, 6) AS smooth FROM n WHERE p >= smooth AND smooth <= q AND (p > smooth OR smooth < q)")
def f04_local_minima(spark, sf_dir):
    return S.local_minima(S.moving_average(_series(spark, sf_dir), 7)).withColumn("smooth", F.round("smooth", 6))


# letters of the test text as Arabic ones; q, x and z as marks and as a letter that only takes part in breaks
_ARABIC = "".join(chr(0x0627 + k) if k < 20 else chr(0x0641 + k - 20) for k in range(26)).translate({0x0627 + 16: 0x064E, 0x0644: 0x0670, 0x0646: 0x0674})


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS raw FROM documents), a AS (SELECT raw, translate(raw, 'abcdefghijklmnopqrstuvwxyz', '{_ARABIC}') AS word FROM t)
SELECT raw, greatest(1, len(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(word, '[{arabic.MARKS}]', '', 'g'), '([{arabic.NON_JOINERS}])', '\\1|', 'g'), '([{arabic.NON_RECEIVERS}])', '|\\1', 'g'), '|'), lambda x: x <> '')))::INTEGER AS pieces,
 (length(word) - length(regexp_replace(word, '[{arabic.DOTS_ABOVE}]', '', 'g')))::INTEGER AS above, (length(word) - length(regexp_replace(word, '[{arabic.DOTS_BELOW}]', '', 'g')))::INTEGER AS below FROM a""")
def g02_g04_spelling(spark, sf_dir):
    raw = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("raw")).distinct()
    word = F.translate("raw", "abcdefghijklmnopqrstuvwxyz", _ARABIC)
    above, below = arabic.dots(word)
    return raw.select("raw", arabic.piece_count(word).alias("pieces"), above.alias("above"), below.alias("below"))


@query("""WITH l AS (SELECT job_id, max(ts) AS heartbeat, arg_max(terminal, (ts, event_id)) AS terminal FROM v_job GROUP BY job_id)
SELECT job_id, heartbeat FROM l WHERE NOT terminal AND epoch((SELECT max(heartbeat) FROM l))::BIGINT - epoch(heartbeat)::BIGINT > 86400""")
def k01_interrupted_jobs(spark, sf_dir):
    return J.interrupted(view(spark, sf_dir, "v_job"), 86_400)


@query("SELECT job_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS heartbeat, count(*) AS n_events FROM v_job GROUP BY job_id")
def k02_latest_state(spark, sf_dir):
    return J.latest_state(view(spark, sf_dir, "v_job"))


@query("""WITH r AS (SELECT *, coalesce(sum(CAST(terminal AS INT)) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM v_job),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id, run ORDER BY ts, event_id) AS k FROM r) SELECT event_id, job_id, CAST(run AS BIGINT) AS run, CAST(k AS INT) AS open, k <= 2 AS allowed FROM n""")
def k05_open_jobs(spark, sf_dir):
    return J.open_jobs(view(spark, sf_dir, "v_job"), 2)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def k04_activity_feed(spark, sf_dir):
    return J.feed(_table(spark, sf_dir, "events").select("event_id", "ts", "event_type"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def k07_throughput(spark, sf_dir):
    return J.throughput(_table(spark, sf_dir, "events"))


from leafmark.plans import bundles, feeds, labels, layout, numbering, planning, review, schemes, trees  # noqa: E402, F401  (they add their queries)
