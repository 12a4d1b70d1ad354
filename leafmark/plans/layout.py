"""Queries over boxes, bands and series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmark.operators import components as C
from leafmark.operators import layout as L
from leafmark.operators import series as S
from leafmark.plans.base import domain, query, tables

_BOUNDS = "SELECT collection_id, page_number, first_page, first_page + 80 + start_chapter * 5 AS last_page, CAST(104 AS BIGINT) AS page_count, CAST(page_number AS BIGINT) AS n, start_verse - 1 + collection_id % 2 AS from_page, CAST(page_number - 3 AS BIGINT) AS to_page FROM v_page"


@query(f"""WITH b AS ({_BOUNDS}), f AS (SELECT collection_id, page_number, concat_ws(',', CASE WHEN NOT (first_page >= 1 AND first_page <= last_page AND last_page <= page_count) THEN 'source_range' END, CASE WHEN n NOT BETWEEN 1 AND last_page - first_page + 1 THEN 'page_number' END,
 CASE WHEN NOT (from_page >= 1 AND from_page <= to_page AND to_page <= page_count) THEN 'run_range' END) AS faults FROM b) SELECT * FROM f WHERE faults <> ''""")
def b02_bound_faults(spark, sf_dir):
    (pages,) = domain(spark, sf_dir, "page")
    rows = spark.sql(_BOUNDS.replace("v_page", "{p}"), p=pages)
    return L.bound_faults(rows).select("collection_id", "page_number", F.array_join("faults", ",").alias("faults"))


_CROP = "SELECT collection_id, page_number, collection_id % 2 = 0 AS alternate, coalesce(source_page, start_chapter * 100) % 1300 - 100 AS x, start_verse * 40 - 60 AS y, CAST(1000 AS BIGINT) AS w, CAST(1600 + start_chapter * 60 AS BIGINT) AS h FROM v_page"


@query(f"""WITH p AS ({_CROP}), c AS (SELECT *, greatest(0, CASE WHEN alternate AND page_number % 2 = 0 THEN 1240 - (x + w) ELSE x END) AS l, greatest(0, y) AS t FROM p)
SELECT collection_id, page_number, l AS "left", t AS top, least(1240, l + w) AS "right", least(1754, t + h) AS bottom, least(1240, l + w) <= l OR least(1754, t + h) <= t AS empty FROM c""")
def b07_cropped(spark, sf_dir):
    (pages,) = domain(spark, sf_dir, "page")
    return L.cropped(spark.sql(_CROP.replace("v_page", "{p}"), p=pages), 1240, 1754)


_STORED = "SELECT collection_id, page_number, start_chapter AS x, start_verse AS y, CASE WHEN start_chapter = 2 THEN CAST(900 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS w, CAST(1500 AS BIGINT) AS h FROM v_page"


@query(f"""WITH s AS ({_STORED}), u AS (SELECT collection_id, page_number, min(x) AS ux, min(y) AS uy, max(x + w) - min(x) AS uw, max(y + h) - min(y) AS uh FROM v_line GROUP BY ALL)
SELECT collection_id, page_number, CASE WHEN w > 1 OR ux IS NULL THEN x ELSE ux END AS x, CASE WHEN w > 1 OR ux IS NULL THEN y ELSE uy END AS y, CASE WHEN w > 1 OR ux IS NULL THEN w ELSE uw END AS w, CASE WHEN w > 1 OR ux IS NULL THEN h ELSE uh END AS h FROM s LEFT JOIN u USING (collection_id, page_number)""")
def b08_page_columns(spark, sf_dir):
    pages, lines = domain(spark, sf_dir, "page", "line")
    return L.page_columns(spark.sql(_STORED.replace("v_page", "{p}"), p=pages), lines)


@query("""WITH u AS (SELECT collection_id, page_number, line_number, min(x) AS sx, max(x + w) AS sr FROM v_segment GROUP BY ALL)
SELECT collection_id, page_number, line_number, greatest(0, CASE WHEN type = 'text' AND sx IS NOT NULL THEN sx ELSE x END - 8) AS "left", greatest(0, y - 8) AS top, least(2000, CASE WHEN type = 'text' AND sx IS NOT NULL THEN sr ELSE x + w END + 8) AS "right", least(300, y + h + 8) AS bottom
FROM v_line LEFT JOIN u USING (collection_id, page_number, line_number)""")
def b09_export_boxes(spark, sf_dir):
    return L.export_boxes(*domain(spark, sf_dir, "line", "segment"), 8, 2000, 300)


_CONTENT = "ct AS (SELECT line, min(CASE WHEN y % 7 <> 0 THEN x END) AS \"left\", min(CASE WHEN y % 7 <> 0 THEN y END) AS top, max(CASE WHEN y % 7 <> 0 THEN x + w END) AS \"right\", max(CASE WHEN y % 7 <> 0 THEN y + h END) AS bottom FROM v_component GROUP BY line)"


@query(f"WITH {_CONTENT} SELECT * FROM ct")
def f02_content_boxes(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    return L.content_boxes(components.withColumn("value", F.when(F.col("y") % 7 != 0, 1).otherwise(0)), "line", "value")


@query(f"""WITH {_CONTENT}, hd AS (SELECT DISTINCT line, line % 300 AS l, line % 20 AS t, line % 300 + 700 AS r, line % 20 + 40 AS b FROM v_component WHERE line % 3 = 0)
SELECT hd.line, greatest(l, ct."left" - 10) AS "left", greatest(t, top - 10) AS top, least(r, ct."right" + 10) AS "right", least(b, bottom + 10) AS bottom FROM hd LEFT JOIN ct USING (line)""")
def b10_tightened(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    content = L.content_boxes(components.withColumn("value", F.when(F.col("y") % 7 != 0, 1).otherwise(0)), "line", "value")
    headers = components.filter("line % 3 = 0").selectExpr("line", "line % 300 AS left", "line % 20 AS top", "line % 300 + 700 AS right", "line % 20 + 40 AS bottom").distinct()
    return L.tightened(headers, content, "line")


@query("""WITH c AS (SELECT collection_id, page_number, line_number, list(x + w / 3.0) FILTER (closes) AS cuts FROM v_segment GROUP BY ALL), l AS (SELECT collection_id, page_number, line_number, x, w, coalesce(cuts, []) AS cuts FROM v_line LEFT JOIN c USING (collection_id, page_number, line_number) WHERE type = 'text'),
e AS (SELECT collection_id, page_number, line_number, w, list_concat([x + w], list_reverse_sort([greatest(x, least(greatest(x, x + w - 1), CAST(floor(c + 0.5) AS BIGINT))) for c in cuts]), [x]) AS e FROM l),
r AS (SELECT collection_id, page_number, line_number, w, e, unnest(range(1, len(e))) AS i FROM e), k AS (SELECT *, e[i] - e[i + 1] AS sw FROM r)
SELECT collection_id, page_number, line_number, row_number() OVER (PARTITION BY collection_id, page_number, line_number ORDER BY i) AS segment_order, e[i + 1] AS x, greatest(1, sw) AS w, i + 1 < len(e) AS closes FROM k WHERE sw >= w * 0.01""")
def e11_cut_segments(spark, sf_dir):
    lines, segments = domain(spark, sf_dir, "line", "segment")
    cuts = segments.groupBy(*L.LINE).agg(F.collect_list(F.when(F.col("closes"), F.col("x") + F.col("w") / 3.0)).alias("c"))
    rows = lines.filter("type = 'text'").join(cuts, L.LINE, "left").select(*L.LINE, "x", "w", F.coalesce("c", F.expr("cast(array() AS array<double>)")).alias("cuts"))
    return L.cut_segments(rows)


_FOLD = """h AS (SELECT line, list([x] ORDER BY x DESC) AS l FROM v_component GROUP BY line),
f AS (SELECT line, list_reduce(l, lambda acc, x: CASE WHEN coalesce(acc[-1], 1100) - least(greatest(x[1], 100), coalesce(acc[-1], 1100)) >= 20 THEN list_concat(acc, [least(greatest(x[1], 100), coalesce(acc[-1], 1100))]) ELSE acc END, []::BIGINT[]) AS cuts FROM h)"""


@query(f"""WITH {_FOLD}, e AS (SELECT line, len(cuts) AS n, list_concat([1100], cuts, CASE WHEN coalesce(cuts[-1], 1100) - 100 >= 20 THEN [100] ELSE [] END) AS e FROM f), r AS (SELECT line, n, e, unnest(range(1, len(e))) AS i FROM e)
SELECT line, i AS segment_order, CAST(e[i + 1] AS BIGINT) AS "left", CAST(e[i] AS BIGINT) AS "right", i <= n AS closes FROM r UNION ALL SELECT line, 1, 100, 1100, false FROM e WHERE len(e) < 2""")
def e12_separated_segments(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    return L.separated_segments(components.groupBy("line").agg(F.collect_list("x").alias("lefts")), 100, 1100)


@query("SELECT line, CAST(label AS BIGINT) AS id, y AS top, y + h AS bottom, row_number() OVER (PARTITION BY line ORDER BY y, y + h, label) AS line_number FROM v_component")
def e13_ordered_bands(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    return L.ordered_bands(components.select("line", F.col("label").cast("long").alias("id"), F.col("y").alias("top"), (F.col("y") + F.col("h")).alias("bottom")), "line")


@query("""WITH hull AS (SELECT line, min(x) AS l, max(x + w) AS r FROM v_component WHERE label IN (2, 3) GROUP BY line)
SELECT c.line, label, x < l OR x + w > r AS crosses FROM v_component c JOIN hull USING (line) WHERE x + w > l AND x < r""")
def c08_overlapping(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    return L.overlapping(components, components.filter("label in (2, 3)"))


_SEG = "sg AS (SELECT line, CAST(label AS BIGINT) AS segment_order, x, w, label % 2 = 0 AS closes, line % 50 + 1 AS chapter, CASE WHEN label % 5 <> 0 THEN CAST(label AS BIGINT) END AS verse FROM v_component)"
_SPAN = "SELECT line AS span_id, line AS from_line, CAST(2 AS BIGINT) AS from_order, line + line % 2 AS to_line, CAST(1 + line % 3 AS BIGINT) AS to_order, line % 400 AS origin FROM v_component WHERE label = 2"


@query(f"""WITH {_SEG}, q AS ({_SPAN}), b AS (SELECT line, min(segment_order) AS f, max(segment_order) AS t FROM sg GROUP BY line), l AS (SELECT *, from_line AS line FROM q UNION SELECT *, to_line FROM q),
j AS (SELECT l.span_id, l.line, CASE WHEN l.line = to_line AND to_order < b.t THEN greatest(0, z.x - origin) ELSE 0 END AS "left", CASE WHEN l.line = from_line AND from_order > b.f THEN greatest(0, a.x + a.w - origin) END AS "right"
 FROM l JOIN b USING (line) LEFT JOIN sg a ON a.line = from_line AND a.segment_order = from_order LEFT JOIN sg z ON z.line = to_line AND z.segment_order = to_order) SELECT * FROM j WHERE "left" > 0 OR "right" IS NOT NULL""")
def c09_span_cuts(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    spans = spark.sql(_SPAN.replace("v_component", "{c}"), c=components)
    return L.span_cuts(spans, _segments(components))


def _segments(components):
    return components.selectExpr("line", "CAST(label AS BIGINT) AS segment_order", "x", "w", "label % 2 = 0 AS closes", "line % 50 + 1 AS chapter", "CASE WHEN label % 5 <> 0 THEN CAST(label AS BIGINT) END AS verse")


@query(f"""WITH {_SEG} SELECT line, segment_order, greatest(0, x - 100) AS "left", least(900, x - 100 + 40) AS "right", CASE WHEN coalesce(verse, 0) <> 0 THEN chapter || ':' || verse ELSE '' END AS label FROM sg WHERE closes AND x - 100 + 40 > 0 AND x - 100 < 900""")
def c10_ornament_spans(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    return L.ornament_spans(_segments(components), 100, 900, 40)


_UNION = """iv AS (SELECT line, x AS l, x + w AS r FROM v_component WHERE label % 4 = 1 UNION ALL SELECT line, x - 10, x + w + 5 FROM v_component WHERE h > 20),
m AS (SELECT *, max(r) OVER (PARTITION BY line ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS run FROM m),
g AS (SELECT line, min(l) AS "left", max(r) AS "right", count(*) AS merged FROM i GROUP BY line, run), un AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY "right" DESC) AS ord, "left", "right", merged FROM g)"""


def _merged(components):
    one = components.filter("label % 4 = 1").selectExpr("line", "x AS left", "x + w AS right")
    other = components.filter("h > 20").selectExpr("line", "x - 10 AS left", "x + w + 5 AS right")
    return C.interval_union(one.unionByName(other), "line", "left", "right").withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {_UNION} SELECT * FROM un")
def f12_merged_detectors(spark, sf_dir):
    return _merged(*domain(spark, sf_dir, "component"))


@query(f"""WITH {_UNION}, s AS (SELECT line, CAST(label AS BIGINT) AS n, x AS place, 'v' || label AS label FROM v_component WHERE label % 4 = 1), f AS (SELECT s.line, n, label, min(ord) AS ord FROM s JOIN un ON un.line = s.line AND place BETWEEN "left" AND "right" GROUP BY ALL),
t AS (SELECT line, ord, arg_max(label, n) AS label FROM f GROUP BY ALL) SELECT line, ord, "left", "right", label FROM un LEFT JOIN t USING (line, ord)""")
def c11_labelled_spans(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    supplied = components.filter("label % 4 = 1").selectExpr("line", "CAST(label AS BIGINT) AS n", "x AS left", "concat('v', label) AS label")
    return L.labelled_spans(_merged(components).select("line", "ord", "left", "right"), supplied)


@query("""WITH b AS (SELECT * FROM v_component WHERE role = 'body'), t AS (SELECT line, median(h) AS med FROM b GROUP BY line HAVING count(*) >= 3)
SELECT line, label, x AS "left", x + w AS "right" FROM b JOIN t USING (line) WHERE h >= 1.25 * med AND w / greatest(1, h) BETWEEN 0.55 AND 1.9 AND (area % 40) / 100.0 >= 0.12""")
def f13_ring_candidates(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    return L.ring_candidates(components.withColumn("hole", (F.col("area") % 40) / 100.0))


@query("""WITH l AS (SELECT collection_id, page_number, line_number, h, CASE type WHEN 'header' THEN 2 ELSE 1 END AS slots FROM v_line WHERE page_number % 7 <> 3),
b AS (SELECT collection_id, page_number, CAST(sum(slots) AS BIGINT) AS detected, string_agg(h, ',' ORDER BY line_number) AS heights, string_agg(slots, ',' ORDER BY line_number) AS line_slots FROM l GROUP BY ALL)
SELECT collection_id, page_number, CASE WHEN detected IS NULL THEN 'no_lines' ELSE 'line_count_mismatch' END AS status, coalesce(detected, 0) AS detected, coalesce(heights, '') AS heights, coalesce(line_slots, '') AS line_slots FROM v_page LEFT JOIN b USING (collection_id, page_number) WHERE detected IS NULL OR detected <> 4""")
def e30_slot_faults(spark, sf_dir):
    pages, lines = domain(spark, sf_dir, "page", "line")
    rows = lines.filter("page_number % 7 <> 3").withColumn("slots", F.when(F.col("type") == "header", 2).otherwise(1).cast("long"))
    return L.slot_faults(rows, pages, 4)


_BATCH = "SELECT user_id AS batch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page_index, CASE WHEN event_id % 37 = 5 THEN 'no_lines' WHEN event_id % 41 = 7 THEN 'cancel' WHEN event_id % 53 = 9 THEN 'no_image' WHEN event_id % 5 = 1 THEN 'error' ELSE 'ok' END AS result FROM events"


@query(f"""WITH b AS ({_BATCH}), s AS (SELECT *, CASE result WHEN 'no_lines' THEN 'skipped_batch_abort' WHEN 'cancel' THEN 'skipped_cancelled' WHEN 'no_image' THEN 'skipped_no_image' END AS stops FROM b)
SELECT batch, page_index, coalesce(first_value(stops IGNORE NULLS) OVER (PARTITION BY batch ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE result WHEN 'cancel' THEN 'skipped_cancelled' WHEN 'no_image' THEN 'skipped_no_image' ELSE result END) AS status FROM s""")
def e29_batch_status(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    rows = spark.sql(_BATCH.replace("FROM events", "FROM {e}"), e=events)
    return L.batch_status(rows.withColumn("page_index", F.col("page_index").cast("long")))


_SERIES = """h AS (SELECT event_type AS grp, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS position, count(*) AS value FROM events GROUP BY ALL), e AS (SELECT grp, unnest(range(min(position), max(position) + 1)) AS position FROM h GROUP BY grp),
f AS (SELECT e.grp, e.position, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM e LEFT JOIN h USING (grp, position))"""


def _series(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    counts = events.groupBy(F.col("event_type").alias("grp"), F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("position")).agg(F.count("*").alias("value"))
    return S.filled(counts)


_LINES = _SERIES + """, ct AS (SELECT grp, min(position) AS top, max(position) + 1 AS "end", max(position) + 1 - min(position) AS height FROM f WHERE value <> 0 GROUP BY grp),
sz AS (SELECT grp, CAST(greatest(3, round_even(height / 15.0 * 0.155, 0)) AS BIGINT) AS k, CAST(greatest(1, round_even(height / 15.0 * 0.8, 0)) AS BIGINT) AS apart FROM ct), wd AS (SELECT grp, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS width, apart FROM sz),
cl AS (SELECT f.* FROM f JOIN ct USING (grp) WHERE position >= top AND position < "end"), sm AS (SELECT a.grp, a.position, round(sum(b.value) / max(width), 9) AS smooth FROM cl a JOIN wd USING (grp) JOIN cl b ON b.grp = a.grp AND b.position BETWEEN a.position - width // 2 AND a.position + width // 2 GROUP BY a.grp, a.position),
nb AS (SELECT *, lag(smooth) OVER w AS p, lead(smooth) OVER w AS q FROM sm WINDOW w AS (PARTITION BY grp ORDER BY position)), mi AS (SELECT * FROM nb WHERE p >= smooth AND smooth <= q AND (p > smooth OR smooth < q)),
bd AS (SELECT m.grp, m.position, m.smooth, max(CASE WHEN s.position < m.position THEN s.position END) AS a, min(CASE WHEN s.position > m.position THEN s.position END) AS b FROM mi m LEFT JOIN sm s ON s.grp = m.grp AND s.smooth < m.smooth GROUP BY m.grp, m.position, m.smooth),
pr AS (SELECT bd.grp, bd.position, bd.smooth, least(max(CASE WHEN s.position <= bd.position THEN s.smooth END), max(CASE WHEN s.position >= bd.position THEN s.smooth END)) - bd.smooth AS prominence FROM bd JOIN sm s ON s.grp = bd.grp AND (a IS NULL OR s.position > a) AND (b IS NULL OR s.position < b) GROUP BY bd.grp, bd.position, bd.smooth)"""


@query(f"WITH {_LINES} SELECT grp, position, round(smooth, 6) AS smooth, round(prominence, 6) AS prominence FROM pr")
def f05_prominences(spark, sf_dir):
    df = _series(spark, sf_dir)
    content = df.filter("value <> 0").groupBy("grp").agg((F.max("position") + 1 - F.min("position")).alias("height"), F.min("position").alias("a"), F.max("position").alias("b"))
    clean = df.join(content.select("grp", "a", "b"), "grp").filter("position between a and b").select("grp", "position", "value")
    smooth = S.smoothed(clean, S.pitch_widths(content, 15)).withColumn("smooth", F.round("smooth", 9))
    return S.prominences(S.local_minima(smooth), smooth).select("grp", "position", F.round("smooth", 6).alias("smooth"), F.round("prominence", 6).alias("prominence"))


@query(f"""WITH {_LINES}, rk AS (SELECT grp, list([position] ORDER BY prominence DESC, position) AS l, any_value(apart) AS apart FROM pr JOIN wd USING (grp) GROUP BY grp),
pk AS (SELECT grp, list_reduce(l, lambda acc, x: CASE WHEN len(acc) < 14 AND len(list_filter(acc, lambda s: abs(s - x[1]) < apart)) = 0 THEN list_concat(acc, x) ELSE acc END, []::BIGINT[]) AS v FROM rk),
ed AS (SELECT ct.grp, list_concat([top], list_sort(v), ["end"]) AS e FROM ct JOIN pk USING (grp)) SELECT grp, i AS line, e[i] AS top, e[i + 1] AS bottom FROM (SELECT grp, e, unnest(range(1, len(e))) AS i FROM ed)""")
def f07_line_boxes(spark, sf_dir):
    return S.line_boxes(_series(spark, sf_dir), 15)


@query(f"""WITH {_SERIES}, pk AS (SELECT grp, arg_min(position, (-value, position)) AS peak, max(value) * 0.3 AS floor FROM f GROUP BY grp), hi AS (SELECT f.grp, position, peak, position - row_number() OVER (PARTITION BY f.grp ORDER BY position) AS run FROM f JOIN pk USING (grp) WHERE value >= floor),
b AS (SELECT grp, run, peak, min(position) AS top, max(position) AS bottom FROM hi GROUP BY ALL) SELECT grp, peak, top, bottom FROM b WHERE peak BETWEEN top AND bottom""")
def f08_dense_bands(spark, sf_dir):
    return S.dense_bands(_series(spark, sf_dir))


_PICK = "pk AS (SELECT grp, list_reduce(list([position] ORDER BY value DESC, position), lambda acc, x: CASE WHEN len(acc) < {most} AND len(list_filter(acc, lambda s: abs(s - x[1]) < {apart})) = 0 THEN list_concat(acc, x) ELSE acc END, []::BIGINT[]) AS v FROM f WHERE value >= {least} GROUP BY grp)"


@query(f"WITH {_SERIES}, {_PICK.format(most=20, apart=6, least=0)} SELECT grp, CAST(i AS INT) AS rank, v[i] AS position FROM (SELECT grp, v, unnest(range(1, len(v) + 1)) AS i FROM pk)")
def f06_l05_strongest_apart(spark, sf_dir):
    return S.strongest_apart(_series(spark, sf_dir).withColumnRenamed("value", "score"), 20, 6)


@query(f"WITH {_SERIES}, {_PICK.format(most=100000, apart=7, least=2)} SELECT grp, p AS \"left\", p + 12 AS \"right\" FROM (SELECT grp, unnest(v) AS p FROM pk)")
def f10_picked_peaks(spark, sf_dir):
    return S.picked_peaks(_series(spark, sf_dir).withColumnRenamed("value", "score"), 2.0, 12)


@query(f"""WITH {_SERIES}, z AS (SELECT grp, position - min(position) OVER (PARTITION BY grp) AS position, value FROM f), ht AS (SELECT grp, max(position) + 1 AS height FROM z GROUP BY grp), bd AS (SELECT grp, position AS top, position + 30 AS bottom FROM z WHERE position % 97 = 40),
en AS (SELECT grp, least(height, top) AS top, least(height, bottom) AS bottom FROM bd JOIN ht USING (grp) UNION ALL SELECT grp, height, height FROM ht), gp AS (SELECT grp, coalesce(max(bottom) OVER (PARTITION BY grp ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, top AS b FROM en),
rg AS (SELECT z.grp, min(position) AS top, max(position) + 1 AS bottom FROM gp JOIN z ON z.grp = gp.grp AND value <> 0 AND position >= a AND position < b WHERE b > a GROUP BY z.grp, a, b), hi AS (SELECT rg.*, bottom - top AS c FROM rg JOIN ht USING (grp) WHERE bottom - top >= greatest(1, round_even(height / 15.0 * 0.75, 0)))
SELECT grp, top, bottom, CAST(greatest(1, round_even(c / sum(c) OVER (PARTITION BY grp) * 11, 0)) AS BIGINT) AS slots FROM hi""")
def f09_text_regions(spark, sf_dir):
    df = _series(spark, sf_dir)
    zero = df.withColumn("position", F.col("position") - F.min("position").over(Window.partitionBy("grp")))
    heights = zero.groupBy("grp").agg((F.max("position") + 1).alias("height"))
    bands = zero.filter("position % 97 = 40").selectExpr("grp", "position AS top", "position + 30 AS bottom")
    return L.text_regions(bands, zero, heights, 15, 11)
