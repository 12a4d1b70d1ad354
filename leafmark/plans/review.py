"""Queries over reviewed ink and closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.operators import closure as K
from leafmark.operators import review as R
from leafmark.plans.base import domain, query
from leafmark.sources.shared import stored

_OWN = "own AS (SELECT *, min(word_id) OVER (PARTITION BY line, label) AS first, max(word_id) OVER (PARTITION BY line, label) AS last FROM v_allocation)"
_EDGES = _OWN + """, edges AS (SELECT line, word_id, max(CASE WHEN first < word_id THEN x + CAST(floor(w / 2) AS BIGINT) ELSE x + w END) AS start_x, min(CASE WHEN last > word_id THEN x + CAST(floor(w / 2) AS BIGINT) ELSE x END) AS end_x FROM own GROUP BY line, word_id)"""


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE start_x > end_x")
def d15_edges_from_ink(spark, sf_dir):
    return R.edges_from_ink(*domain(spark, sf_dir, "allocation"))


@query(f"""WITH {_OWN}, box AS (SELECT line, word_id, min(x) + 5 AS end_x, max(x) + 6 AS start_x FROM v_allocation GROUP BY ALL), alone AS (SELECT line, word_id, max(x + w) AS r, min(x) AS l FROM own WHERE first = last GROUP BY ALL)
SELECT line, word_id, greatest(start_x, r) AS start_x, least(end_x, l) AS end_x FROM box LEFT JOIN alone USING (line, word_id)""")
def d16_fitted_words(spark, sf_dir):
    (allocations,) = domain(spark, sf_dir, "allocation")
    words = allocations.groupBy("line", "word_id").agg((F.max("x") + 6).alias("start_x"), (F.min("x") + 5).alias("end_x"))
    return R.fitted_words(words, allocations)


@query("""WITH p AS (SELECT line, label, sum(pieces) AS pieces FROM v_allocation WHERE word_id % 2 = 0 GROUP BY ALL)
SELECT c.line, c.label, role FROM v_component c LEFT JOIN p USING (line, label) WHERE label % 7 <> 3 AND (role = 'mark' OR p.line IS NULL OR p.pieces = 1)""")
def b11_eligible(spark, sf_dir):
    components, allocations = domain(spark, sf_dir, "component", "allocation")
    held = allocations.filter("word_id % 2 = 0").groupBy("line", "label").agg(F.collect_list(F.struct("word_id", "pieces")).alias("a"))
    rows = components.join(held, ["line", "label"], "left").withColumns({"allocations": F.coalesce("a", F.expr("cast(array() AS array<struct<word_id:bigint,pieces:bigint>>)")), "exception": F.when(F.col("label") % 7 == 3, "flagged")})
    return R.eligible(rows).select("line", "label", "role")


@query("SELECT line, label FROM v_component WHERE role = 'mark' AND label % 4 <> 0 AND label % 5 <> 1")
def b12_typed(spark, sf_dir):
    """The note of who gave a type is absent for most, and false for a fifth."""
    (components,) = domain(spark, sf_dir, "component")
    return R.typed(components.withColumns({"subtype": F.when(F.col("label") % 4 != 0, "t"), "subtype_explicit": F.when(F.col("label") % 5 == 1, False)})).select("line", "label")


@query("""WITH st AS (SELECT * FROM v_status WHERE page_id % 5 <> 2), l AS (SELECT page_id, line_number FROM v_status WHERE page_id % 3 <> 1 UNION SELECT page_id, 99 FROM v_status WHERE page_id % 3 <> 1)
SELECT l.page_id, l.line_number FROM l LEFT JOIN st USING (page_id, line_number) WHERE coalesce(edited, false) OR (status IS NULL AND (page_id, line_number) IN (SELECT (page_id, line_number) FROM v_word))""")
def b13_hand_made(spark, sf_dir):
    words, status = domain(spark, sf_dir, "word", "status")
    some = status.filter("page_id % 3 <> 1")
    lines = some.select("page_id", "line_number").union(some.select("page_id", F.lit(99))).distinct()
    return R.hand_made(lines, status.filter("page_id % 5 <> 2"), words)


_FLAGGED = "label % 8 = 0 AS explicit, label % 9 = 0 AS ownership_explicit, CASE WHEN x % 4 = 0 THEN 'body' ELSE role END AS initial_role, CASE WHEN y % 3 = 0 THEN 'mark' END AS proposed_role, w % 6 = 0 AS ambiguous, x < 40 AS cut, h = 9 AS conflict, y < 6 AS released, CAST(area % 15 AS BIGINT) AS body_score"


@query(f"""WITH c AS (SELECT *, {_FLAGGED} FROM v_component), t AS (SELECT *, NOT (explicit OR ownership_explicit) AS free FROM c)
SELECT line, label, concat_ws(',', CASE WHEN free AND body_score BETWEEN 6 AND 9 THEN 'uncertain' END, CASE WHEN free AND role <> initial_role THEN 'search-override' END, CASE WHEN free AND proposed_role <> role THEN 'calibration-disagreement' END,
  CASE WHEN free AND ambiguous THEN 'ambiguous' END, CASE WHEN cut THEN 'span-boundary' END, CASE WHEN conflict THEN 'constraint-conflict' END, CASE WHEN released AND NOT explicit THEN 'released-lock' END) AS flags FROM t""")
def b14_attention(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    rows = spark.sql(f"SELECT *, {_FLAGGED} FROM {{c}}", c=components)
    return R.attention(rows).withColumn("flags", F.array_join("flags", ","))


@query("""WITH e AS (SELECT line, label, x, CASE WHEN label % 11 = 0 THEN 'ornament' ELSE role END AS initial_role, CASE WHEN x % 10 = 0 THEN 'symbol' ELSE role END AS role, CASE WHEN y = 7 THEN 'odd' WHEN y = 8 THEN 'flagged' ELSE '' END AS exception FROM v_component),
a AS (SELECT line, label, count(*) AS n, count(DISTINCT CASE WHEN label % 13 = 2 THEN 0 ELSE word_id END) AS d, bool_or(word_id % 6 = 5) AS unknown, max(CASE WHEN word_id % 6 <> 5 THEN word_id END) - min(CASE WHEN word_id % 6 <> 5 THEN word_id END) + 1 AS reach,
  count(DISTINCT CASE WHEN word_id % 6 = 5 THEN -1 ELSE CAST(floor(word_id / 2) AS BIGINT) END) AS verses, bool_or(pieces + CASE WHEN w = 30 THEN 8 ELSE 0 END > 8) AS too_many, bool_or(pieces + CASE WHEN w = 30 THEN 8 ELSE 0 END <> 0) AS any_pieces FROM v_allocation GROUP BY line, label),
f AS (SELECT line, label, concat_ws(',', CASE WHEN (initial_role IN ('ornament', 'symbol') AND role <> initial_role) OR (initial_role NOT IN ('ornament', 'symbol') AND role NOT IN ('body', 'mark')) THEN 'role' END, CASE WHEN exception = 'odd' THEN 'exception' END, CASE WHEN d < n THEN 'repeated_word' END,
  CASE WHEN unknown THEN 'unknown_word' END, CASE WHEN n > 1 AND NOT coalesce(role = 'body' AND reach = n AND verses = 1, false) THEN 'not_joinable' END, CASE WHEN too_many OR (role <> 'body' AND any_pieces) THEN 'pieces' END) AS faults FROM e JOIN a USING (line, label))
SELECT * FROM f WHERE faults <> ''""")
def b15_edit_faults(spark, sf_dir):
    components, allocations = domain(spark, sf_dir, "component", "allocation")
    unknown = F.col("word_id") % 6 == 5
    one = F.struct(F.when(F.col("label") % 13 == 2, 0).otherwise(F.col("word_id")).cast("long").alias("word_id"), (F.col("pieces") + F.when(F.col("w") == 30, 8).otherwise(0)).alias("pieces"), F.when(~unknown, F.col("word_id")).alias("place"), F.when(unknown, -1).otherwise(F.floor(F.col("word_id") / 2)).cast("long").alias("verse"))
    held = allocations.groupBy("line", "label").agg(F.collect_list(one).alias("allocations"))
    edits = components.selectExpr("line", "label", "CASE WHEN label % 11 = 0 THEN 'ornament' ELSE role END AS initial_role", "CASE WHEN x % 10 = 0 THEN 'symbol' ELSE role END AS role", "CASE WHEN y = 7 THEN 'odd' WHEN y = 8 THEN 'flagged' ELSE '' END AS exception")
    return R.edit_faults(edits.join(held, ["line", "label"])).withColumn("faults", F.array_join("faults", ","))


@query("""WITH i AS (SELECT line, CASE WHEN x % 50 = 3 THEN label + 100 ELSE label END AS label FROM v_component WHERE y <> 11), s AS (SELECT line, label FROM v_component),
w AS (SELECT line, CASE WHEN word_id % 9 <> 8 THEN word_id END AS word_id, x + w - CASE WHEN h = 4 THEN 60 ELSE 0 END AS start_x, x AS end_x FROM v_allocation JOIN (SELECT line, label, h FROM v_component) h USING (line, label))
SELECT line, CASE WHEN s.label IS NULL THEN 'strange' ELSE 'missing' END AS fault, CAST(label AS BIGINT) AS item FROM s FULL JOIN i USING (line, label) WHERE s.label IS NULL OR i.label IS NULL
UNION ALL SELECT line, 'word_twice', word_id FROM w WHERE word_id IS NOT NULL GROUP BY line, word_id HAVING count(*) > 1
UNION ALL SELECT line, 'no_width', coalesce(word_id, -1) FROM w WHERE start_x <= end_x""")
def b16_edit_set_faults(spark, sf_dir):
    components, allocations = domain(spark, sf_dir, "component", "allocation")
    incoming = components.filter("y <> 11").selectExpr("line", "CASE WHEN x % 50 = 3 THEN label + 100 ELSE label END AS label")
    words = allocations.join(components.select("line", "label", "h"), ["line", "label"]).selectExpr("line", "CASE WHEN word_id % 9 <> 8 THEN word_id END AS word_id", "x + w - CASE WHEN h = 4 THEN 60 ELSE 0 END AS start_x", "x AS end_x")
    return R.edit_set_faults(components, incoming, words)


_SPANS = "sp AS (SELECT line, CAST(row_number() OVER (PARTITION BY line ORDER BY x + w DESC, label) AS BIGINT) AS ord, x AS \"left\", x + w + 60 AS \"right\" FROM v_component WHERE label % 4 = 1)"


@query(f"""WITH {_SPANS}, r AS (SELECT c.line, label, role, x + w AS edge, (SELECT min(ord) FROM sp WHERE sp.line = c.line AND 2 * x + w BETWEEN 2 * "left" AND 2 * "right") AS span FROM v_component c),
n AS (SELECT *, CASE WHEN span IS NOT NULL AND lag(span) OVER (PARTITION BY line ORDER BY edge DESC, label) IS DISTINCT FROM span THEN 1 ELSE 0 END AS new FROM r)
SELECT line, label, span, CASE WHEN span IS NOT NULL THEN CAST(sum(new) OVER o AS BIGINT) END AS "group", CASE WHEN span IS NOT NULL THEN count(*) FILTER (span IS NULL AND role = 'body') OVER o END AS bodies_before FROM n WINDOW o AS (PARTITION BY line ORDER BY edge DESC, label ROWS UNBOUNDED PRECEDING)""")
def c07_partitioned(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    from pyspark.sql import Window

    ord_ = F.row_number().over(Window.partitionBy("line").orderBy(F.desc(F.col("x") + F.col("w")), "label")).cast("long")
    spans = components.filter("label % 4 = 1").select("line", ord_.alias("ord"), F.col("x").alias("left"), (F.col("x") + F.col("w") + 60).alias("right"))
    return R.partitioned(components, spans)


@query("""WITH w AS (SELECT *, CAST(floor(word_id / 40) AS BIGINT) AS verse FROM v_word), s AS (SELECT page_id, line_number, position AS segment_order, CASE WHEN word_id % 3 <> 0 THEN CAST(floor(word_id / 40) AS BIGINT) END AS verse, end_x - word_id % 5 AS x, CAST(60 AS BIGINT) AS w FROM v_word),
l AS (SELECT page_id, line_number, verse, x, w FROM s WHERE verse IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, line_number, verse ORDER BY segment_order DESC) = 1)
SELECT page_id, line_number, verse, position, word_id, end_x, l.x AS "left", l.x + l.w AS "right" FROM w JOIN l USING (page_id, line_number, verse) WHERE word_id IS NOT NULL AND end_x NOT BETWEEN l.x AND l.x + l.w""")
def c12_outside_verse(spark, sf_dir):
    (words,) = domain(spark, sf_dir, "word")
    verse = F.floor(F.col("word_id") / 40)
    segments = words.select("page_id", "line_number", F.col("position").alias("segment_order"), F.when(F.col("word_id") % 3 != 0, verse).alias("verse"), (F.col("end_x") - F.col("word_id") % 5).alias("x"), F.lit(60).cast("long").alias("w"))
    return R.outside_verse(words.withColumn("verse", verse), segments)


@query("""WITH ex AS (SELECT line, label, CASE WHEN y = 3 THEN 'flagged' ELSE '' END AS exception FROM v_component), got AS (SELECT line, word_id, sum(pieces) AS got FROM v_allocation WHERE role = 'body' GROUP BY ALL),
w AS (SELECT DISTINCT line, word_id, word_id % 3 AS expected FROM v_allocation), st AS (SELECT page_id AS line, any_value(status) AS status, CASE WHEN page_id % 2 = 0 THEN 'r' END AS reason FROM v_status WHERE line_number = 1 GROUP BY page_id)
SELECT line, 'flagged' AS kind, CAST(label AS BIGINT) AS item, exception AS detail FROM ex WHERE exception <> ''
UNION ALL SELECT line, 'pieces', word_id, concat_ws('/', CAST(coalesce(got, 0) AS BIGINT), expected) FROM w LEFT JOIN got USING (line, word_id) WHERE coalesce(got, 0) <> expected
UNION ALL SELECT line, 'open', NULL, coalesce(reason, '') FROM st WHERE status IN ('partial', 'unresolved')""")
def d18_confirmation_exceptions(spark, sf_dir):
    components, allocations, status = domain(spark, sf_dir, "component", "allocation", "status")
    words = allocations.selectExpr("line", "word_id", "word_id % 3 AS expected").distinct()
    st = status.filter("line_number = 1").selectExpr("page_id AS line", "status", "CASE WHEN page_id % 2 = 0 THEN 'r' END AS reason")
    return R.confirmation_exceptions(components.selectExpr("line", "label", "CASE WHEN y = 3 THEN 'flagged' ELSE '' END AS exception"), allocations, words, st)


@query("""WITH c AS (SELECT line, w AS cost, x % 3 + 1 AS ties, y % 3 AS deviations, h = 9 AS missed FROM v_component),
r AS (SELECT line, unnest([CASE WHEN missed THEN 'boundary missed' END, CASE WHEN deviations > 0 THEN deviations || ' word(s) off count' END, CASE WHEN ties > 1 THEN ties || ' equal readings' END]) AS r FROM c),
d AS (SELECT line, string_agg(r, '; ' ORDER BY r) AS reason FROM (SELECT DISTINCT line, r FROM r WHERE r IS NOT NULL) GROUP BY line)
SELECT line, max(cost) AS cost, max(ties) AS ties, CAST(sum(deviations) AS BIGINT) AS deviations, any_value(reason) AS reason, CASE WHEN any_value(reason) IS NULL THEN 'exact' ELSE 'scored' END AS status FROM c LEFT JOIN d USING (line) GROUP BY line""")
def d19_line_rollup(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    return R.line_rollup(components.selectExpr("line", "w AS cost", "x % 3 + 1 AS ties", "y % 3 AS deviations", "h = 9 AS missed"))


@query(f"""WITH {_SPANS}, e AS (SELECT line, x + w AS "right", 1 AS kind, CAST(label AS BIGINT) AS item FROM v_component UNION ALL SELECT line, "right", 0, ord FROM sp UNION ALL SELECT DISTINCT line, CAST(NULL AS BIGINT), 2, CAST(NULL AS BIGINT) FROM v_component)
SELECT *, row_number() OVER (PARTITION BY line ORDER BY "right" DESC NULLS LAST, kind, item NULLS FIRST) AS event FROM e""")
def e25_reading_events(spark, sf_dir):
    from pyspark.sql import Window

    (components,) = domain(spark, sf_dir, "component")
    ord_ = F.row_number().over(Window.partitionBy("line").orderBy(F.desc(F.col("x") + F.col("w")), "label")).cast("long")
    return R.reading_events(components, components.filter("label % 4 = 1").select("line", ord_.alias("ord"), (F.col("x") + F.col("w") + 60).alias("right")))


# a page is sixteen lines; ornaments among its components end verses, so verses run over lines; words have a few pieces more or less than bodies
_VERSES = """SELECT *, count(CASE WHEN role = 'mark' AND label % 9 = 4 THEN 1 END) OVER (PARTITION BY page ORDER BY line, x + w DESC, label ROWS UNBOUNDED PRECEDING) AS verse FROM (SELECT *, CAST(floor(line / 16) AS BIGINT) AS page FROM {c}) p"""
_SPOKEN = "SELECT page, verse, CAST(label * 100 + line % 16 AS BIGINT) AS word, CAST((label + line) % 3 + CASE WHEN line % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS pieces FROM {v} WHERE role = 'body' AND (line + label) % 2 = 0"
_ALIGN = f"""v AS MATERIALIZED ({_VERSES.format(c='v_component')}), b AS (SELECT page, verse, line, label, row_number() OVER (PARTITION BY page, verse ORDER BY line, x + w DESC, label) AS n FROM v WHERE role = 'body'), ws AS ({_SPOKEN.format(v='v')}),
u AS (SELECT *, sum(pieces) OVER (PARTITION BY page, verse ORDER BY word ROWS UNBOUNDED PRECEDING) AS upto FROM ws)"""


def _aligned(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    verses = spark.sql(_VERSES.format(c="{c}"), c=components)
    return R.exact_alignment(verses.filter("role = 'body'").select("page", "verse", "line", "label", "x", "w"), spark.sql(_SPOKEN.format(v="{v}"), v=verses), ["page", "verse"], ["line", F.desc(F.col("x") + F.col("w")), "label"])


@query(f"WITH {_ALIGN} SELECT b.page, b.verse, b.line, label, word FROM b JOIN u ON b.page = u.page AND b.verse = u.verse AND n > upto - pieces AND n <= upto")
def e26_exact_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir)[0].select("page", "verse", "line", "label", "word")


@query(f"WITH {_ALIGN}, f AS (SELECT page, verse, count(*) AS found FROM b GROUP BY ALL), x AS (SELECT page, verse, CAST(sum(pieces) AS BIGINT) AS expected FROM ws GROUP BY ALL) SELECT page, verse, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM x FULL JOIN f USING (page, verse) WHERE coalesce(expected, 0) <> coalesce(found, 0)")
def e26_count_report(spark, sf_dir):
    return _aligned(spark, sf_dir)[1]


@query("SELECT line, label, CASE WHEN y <= 25 AND 25 < y + h THEN 'body' WHEN y <= 39 AND y + h > 10 THEN 'mark' ELSE 'mark-only' END AS preferred FROM v_component")
def g09_preferred(spark, sf_dir):
    (components,) = domain(spark, sf_dir, "component")
    return components.select("line", "label", R.preferred(F.lit(10), F.lit(39), F.lit(25), F.col("y"), F.col("h")).alias("preferred"))


@query("""WITH wd AS (SELECT line, word_id, min(x) AS l, max(x + w) AS r, word_id % 3 AS above, word_id % 2 AS below FROM v_allocation WHERE role = 'body' GROUP BY ALL),
s AS (SELECT wd.line, word_id, above, below, count(*) FILTER (m.line IS NOT NULL AND 2 * y + h < 60) AS seen_above, count(*) FILTER (m.line IS NOT NULL AND 2 * y + h >= 60) AS seen_below FROM wd LEFT JOIN (SELECT * FROM v_component WHERE role = 'mark') m ON m.line = wd.line AND 2 * m.x + m.w BETWEEN 2 * l AND 2 * r GROUP BY ALL)
SELECT line, word_id, seen_above, seen_below FROM s WHERE (above > 0 OR below > 0) AND (seen_above < above OR seen_below < below)""")
def g17_dots_missing(spark, sf_dir):
    components, allocations = domain(spark, sf_dir, "component", "allocation")
    words = allocations.filter("role = 'body'").groupBy("line", "word_id").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"))
    return R.dots_missing(words.selectExpr("*", "word_id % 3 AS above", "word_id % 2 AS below", "30 AS peak"), components.filter("role = 'mark'").select("line", "x", "y", "w", "h"))


_WORDS_OF = "wl AS (SELECT line, word_id, word_id + CASE WHEN word_id > 3 THEN 1 ELSE 0 END AS place, CAST(floor(word_id / 4) AS BIGINT) AS verse FROM (SELECT DISTINCT line, word_id FROM v_allocation) d)"
_SHARED = f"""{_WORDS_OF}, sh AS (SELECT line, label, word_id FROM v_allocation WHERE label % 3 = 2 AND role = 'body'), lk AS (SELECT line, min(word_id) AS a, max(word_id) AS b FROM sh GROUP BY line, label HAVING count(DISTINCT word_id) > 1),
reach(line, id, other) AS (SELECT line, a, a FROM lk UNION SELECT line, b, b FROM lk UNION SELECT r.line, r.id, CASE WHEN lk.a = r.other THEN lk.b ELSE lk.a END FROM reach r JOIN lk ON lk.line = r.line AND (lk.a = r.other OR lk.b = r.other)),
rt AS (SELECT line, id AS word_id, min(other) AS root FROM reach GROUP BY ALL),
un AS (SELECT line, root, min(place) AS p FROM rt JOIN wl USING (line, word_id) GROUP BY line, root HAVING count(*) > 1 AND max(place) - min(place) + 1 = count(*) AND count(DISTINCT verse) = 1),
units AS (SELECT rt.line, wl.word_id AS unit, rt.word_id FROM rt JOIN un USING (line, root) JOIN wl ON wl.line = un.line AND wl.place = un.p)"""


def _units(spark, sf_dir):
    components, allocations = domain(spark, sf_dir, "component", "allocation")
    # one table, since links, words and parts all read it
    allocations = stored(allocations.select("line", "label", "x", "w", "role", "word_id"), "allocations")
    words = allocations.select("line", "word_id").distinct().selectExpr("line", "word_id", "word_id + CASE WHEN word_id > 3 THEN 1L ELSE 0L END AS place", "CAST(floor(word_id / 4) AS BIGINT) AS verse")
    shared = allocations.filter("label % 3 = 2 AND role = 'body'").select("line", "label", "word_id")
    return K.fused_units(shared, words), words, allocations, components


@query(f"WITH RECURSIVE {_SHARED} SELECT * FROM units")
def i01_fused_units(spark, sf_dir):
    return _units(spark, sf_dir)[0]


@query(f"""WITH RECURSIVE {_SHARED} SELECT u.line, unit, string_agg('w' || u.word_id, ' ' ORDER BY place) AS text, CAST(sum(u.word_id % 3 + 1) AS BIGINT) AS pieces, CAST(sum(u.word_id % 2) AS BIGINT) AS above, CAST(sum(u.word_id % 4) AS BIGINT) AS below
FROM units u JOIN wl ON wl.line = u.line AND wl.word_id = u.word_id GROUP BY u.line, unit""")
def g18_unit_words(spark, sf_dir):
    units, words, *_ = _units(spark, sf_dir)
    return K.unit_words(units, words.selectExpr("line", "word_id", "place", "concat('w', word_id) AS text", "word_id % 3 + 1 AS pieces", "word_id % 2 AS above", "word_id % 4 AS below"))


@query(f"""WITH RECURSIVE {_SHARED}, mem AS (SELECT *, row_number() OVER (PARTITION BY line, unit ORDER BY word_id) AS member FROM units),
pt AS (SELECT a.line, unit, label, x + w AS r, count(DISTINCT a.word_id) AS owners, max(member) AS reaches FROM v_allocation a JOIN mem ON mem.line = a.line AND mem.word_id = a.word_id GROUP BY ALL),
at_ AS (SELECT *, coalesce(max(CASE WHEN owners > 1 THEN reaches END) OVER (PARTITION BY line, unit ORDER BY r DESC, label ROWS UNBOUNDED PRECEDING), 1) AS member FROM pt)
SELECT at_.line, at_.unit, label, word_id FROM at_ JOIN mem USING (line, unit, member) WHERE owners < 2""")
def i04_split_units(spark, sf_dir):
    units, _, allocations, _ = _units(spark, sf_dir)
    parts = allocations.join(units, ["line", "word_id"]).groupBy("line", "unit", "label").agg((F.max("x") + F.max("w")).alias("right"), F.collect_set("word_id").alias("owners"))
    return K.split_units(parts, units)


_CHANGES = """ch AS (SELECT line * 100 + label AS ink, line * 10 + CAST(floor(word_id / 2) AS BIGINT) AS verse, false AS after FROM v_allocation UNION ALL SELECT line * 100 + label, line * 10 + CAST(floor((word_id + CASE WHEN label % 5 = 2 THEN 1 ELSE 0 END) / 2) AS BIGINT), true FROM v_allocation),
ed AS (SELECT DISTINCT verse FROM ch WHERE verse % 30 = 1)"""


@query(f"""WITH RECURSIVE {_CHANGES}, sets AS (SELECT ink, list(DISTINCT verse ORDER BY verse) FILTER (NOT after) AS was, list(DISTINCT verse ORDER BY verse) FILTER (after) AS now FROM ch GROUP BY ink),
g AS (SELECT ink, unnest(list_concat(was, now)) AS verse FROM sets WHERE was IS DISTINCT FROM now),
scope(verse) AS (SELECT verse FROM ed UNION SELECT b.verse FROM scope s JOIN g a ON a.verse = s.verse JOIN g b ON b.ink = a.ink) SELECT verse FROM scope""")
def i02_affected_verses(spark, sf_dir):
    (allocations,) = domain(spark, sf_dir, "allocation")
    changes = _changes(allocations)
    return K.affected(changes, changes.filter("verse % 30 = 1").select("verse").distinct())


def _changes(allocations):
    before = allocations.selectExpr("line * 100 + label AS ink", "line * 10 + CAST(floor(word_id / 2) AS BIGINT) AS verse", "false AS after")
    return before.unionAll(allocations.selectExpr("line * 100 + label AS ink", "line * 10 + CAST(floor((word_id + CASE WHEN label % 5 = 2 THEN 1 ELSE 0 END) / 2) AS BIGINT) AS verse", "true AS after"))


@query("""WITH o AS (SELECT page_id AS line, word_id, CAST(floor(word_id / 30) AS BIGINT) AS verse, start_x, end_x FROM v_word), n AS (SELECT line, word_id + line % 2 AS word_id, CAST(floor((word_id + line % 2) / 30) AS BIGINT) AS verse, start_x + 1 AS start_x, end_x + 1 AS end_x FROM o)
SELECT *, 'new' AS taken FROM n WHERE word_id IS NOT NULL AND verse % 4 = 1 UNION ALL SELECT *, 'old' FROM o WHERE word_id IS NOT NULL AND verse % 4 <> 1 UNION ALL SELECT *, 'free' FROM o WHERE word_id IS NULL""")
def i03_merged_readings(spark, sf_dir):
    (words,) = domain(spark, sf_dir, "word")
    old = words.selectExpr("page_id AS line", "word_id", "CAST(floor(word_id / 30) AS BIGINT) AS verse", "start_x", "end_x")
    new = old.selectExpr("line", "word_id + line % 2 AS word_id", "CAST(floor((word_id + line % 2) / 30) AS BIGINT) AS verse", "start_x + 1 AS start_x", "end_x + 1 AS end_x")
    return K.merged_readings(old, new, old.filter("verse % 4 = 1").select("verse").union(new.filter("verse % 4 = 1").select("verse")).distinct())
