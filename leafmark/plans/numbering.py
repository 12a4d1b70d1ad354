"""Queries over numbering walks: anchors, entry states, renumbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.operators import numbering as N
from leafmark.operators import transfers as T
from leafmark.plans.base import domain, query
from leafmark.sources.shared import stored
from leafmark.sources.views import row_parts

_SEED = """isl AS (SELECT *, page_number - row_number() OVER (PARTITION BY collection_id ORDER BY page_number) AS island FROM v_page),
seed AS (SELECT collection_id, page_number, island, first_value(start_chapter) OVER w AS s0, first_value(start_verse) OVER w AS v0 FROM isl WINDOW w AS (PARTITION BY collection_id, island ORDER BY page_number))"""


def _rows(seed: str = "seed", anchor: str = "CAST(NULL AS BIGINT)", tag: str = "") -> str:
    """SQL of the walk's rows by the sequential rule in groups that headers begin: rows{tag}."""
    w = "collection_id, island ORDER BY page_number, line_number, segment_order"
    return f"""ev{tag} AS (SELECT collection_id, page_number, line_number, segment_order, 0 AS header, CAST(closes AS INT) AS c, CAST(NULL AS BIGINT) AS anchor FROM v_segment
  UNION ALL SELECT collection_id, page_number, line_number, 0, 1, 0, {anchor} FROM v_line WHERE type = 'header'),
ra{tag} AS (SELECT ev{tag}.*, island, s0, v0, sum(header) OVER o AS hgrp, count(anchor) OVER o AS agrp FROM ev{tag} JOIN {seed} USING (collection_id, page_number) WINDOW o AS (PARTITION BY {w} ROWS UNBOUNDED PRECEDING)),
rb{tag} AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY collection_id, island, hgrp ORDER BY page_number, line_number, segment_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM ra{tag}),
gr{tag} AS (SELECT collection_id, island, hgrp, sum(c) AS n FROM ra{tag} GROUP BY ALL), pv{tag} AS (SELECT collection_id, island, hgrp, coalesce(lag(n) OVER (PARTITION BY collection_id, island ORDER BY hgrp), 0) AS before FROM gr{tag}),
rc{tag} AS (SELECT rb{tag}.*, CASE WHEN header = 1 THEN CASE WHEN hgrp = 1 THEN v0 ELSE 1 END + before END AS left_verse FROM rb{tag} JOIN pv{tag} USING (collection_id, island, hgrp)),
rd{tag} AS (SELECT *, coalesce(max(anchor) OVER (PARTITION BY collection_id, island, agrp), s0) + sum(CASE WHEN header = 1 AND anchor IS NULL AND left_verse <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY collection_id, island, agrp ORDER BY page_number, line_number, segment_order ROWS UNBOUNDED PRECEDING) AS chapter,
  CASE WHEN header = 1 THEN 1 WHEN hgrp = 0 THEN v0 + since ELSE 1 + since END AS verse FROM rc{tag}),
rows{tag} AS (SELECT *, CASE WHEN header = 1 THEN coalesce(lag(chapter) OVER (PARTITION BY {w}), s0) END AS left_chapter FROM rd{tag})"""


_ANCHOR = "CASE WHEN x % 3 = 1 THEN collection_id % 6 + 2 END"
_EXPECTED = "xp AS (SELECT CAST(unnest(range(1, 60)) AS BIGINT) AS chapter), want AS (SELECT chapter, chapter % 4 + 2 AS expected FROM xp WHERE chapter % 9 <> 8)"


def _expected(spark):
    return spark.range(1, 60).filter("id % 9 <> 8").selectExpr("id AS chapter", "id % 4 + 2 AS expected")


@query(f"""WITH {_SEED}, {_rows(anchor=_ANCHOR)}, {_EXPECTED} SELECT collection_id, page_number, line_number, segment_order, 'overflow' AS warning, CAST(chapter AS BIGINT) AS chapter, CAST(verse AS BIGINT) AS verse FROM rows JOIN want USING (chapter) WHERE header = 0 AND verse > expected
UNION ALL SELECT collection_id, page_number, line_number, segment_order, 'boundary', CAST(left_chapter AS BIGINT), CAST(left_verse AS BIGINT) FROM rows JOIN want ON want.chapter = left_chapter WHERE header = 1 AND left_verse <> 1 AND left_verse - 1 <> expected""")
def e10_anchored_warnings(spark, sf_dir):
    pages, lines, segments = domain(spark, sf_dir, "page", "line", "segment")
    anchored = lines.withColumn("anchor", F.when(F.col("x") % 3 == 1, F.col("collection_id") % 6 + 2))
    return N.anchored_warnings(pages, anchored, segments, _expected(spark), row_parts(spark, sf_dir))


_STORED = """sl AS (SELECT collection_id, page_number, line_number, type, CASE WHEN x % 5 <> 4 THEN (collection_id + line_number) % 7 + 1 END AS chapter FROM v_line), ss AS (SELECT collection_id, page_number, line_number, segment_order, closes, CASE WHEN x % 9 <> 0 THEN CAST(segment_order + line_number AS BIGINT) END AS verse FROM v_segment)"""


def _exits(lines: str, segments: str) -> str:
    return f"""ll AS (SELECT collection_id, page_number, max(line_number) AS line_number, arg_max(type, line_number) AS type, coalesce(arg_max(coalesce(chapter, 1), line_number), 1) AS chapter FROM {lines} GROUP BY ALL),
lg AS (SELECT * FROM {segments} QUALIFY row_number() OVER (PARTITION BY collection_id, page_number, line_number ORDER BY segment_order DESC) = 1),
ex AS (SELECT ll.collection_id, ll.page_number, ll.chapter, CASE WHEN type = 'text' AND verse IS NOT NULL THEN verse + CAST(closes AS BIGINT) ELSE 1 END AS verse FROM ll LEFT JOIN lg USING (collection_id, page_number, line_number)),
en AS (SELECT p.collection_id, p.page_number, CASE WHEN q.page_number IS NOT NULL THEN coalesce(ex.chapter, 1) ELSE p.start_chapter END AS chapter, CASE WHEN q.page_number IS NOT NULL THEN coalesce(ex.verse, 1) ELSE p.start_verse END AS verse
  FROM v_page p LEFT JOIN v_page q ON q.collection_id = p.collection_id AND q.page_number = p.page_number - 1 LEFT JOIN ex ON ex.collection_id = p.collection_id AND ex.page_number = p.page_number - 1)"""


@query(f"WITH {_STORED}, {_exits('sl', 'ss')} SELECT * FROM en")
def e06_entry_states(spark, sf_dir):
    pages, lines, segments = domain(spark, sf_dir, "page", "line", "segment")
    stored = lines.withColumn("chapter", F.when(F.col("x") % 5 != 4, (F.col("collection_id") + F.col("line_number")) % 7 + 1))
    return N.entry_states(pages, stored, segments.withColumn("verse", F.when(F.col("x") % 9 != 0, (F.col("segment_order") + F.col("line_number")).cast("long"))))


# every line's chapter by the walk: that of the last numbered row up to it in its island
_LINE_CHAPTERS = """nl AS (SELECT collection_id, page_number, line_number, max(chapter) AS chapter FROM rows0 GROUP BY ALL),
lc AS (SELECT l.*, CAST(coalesce(last_value(nl.chapter IGNORE NULLS) OVER (PARTITION BY l.collection_id, island ORDER BY l.page_number, l.line_number ROWS UNBOUNDED PRECEDING), s0) AS BIGINT) AS walked
  FROM v_line l JOIN seed USING (collection_id, page_number) LEFT JOIN nl ON nl.collection_id = l.collection_id AND nl.page_number = l.page_number AND nl.line_number = l.line_number)"""
_MOVED = "page_number BETWEEN 21 AND 21 + collection_id % 5"
_LATER = f"""sl AS (SELECT collection_id, page_number, line_number, type, CASE WHEN type = 'header' AND {_MOVED} THEN CASE x % 3 WHEN 0 THEN NULL WHEN 1 THEN walked + 5 ELSE walked END ELSE walked END AS chapter FROM lc),
ss AS (SELECT collection_id, page_number, line_number, segment_order, c = 1 AS closes, CAST(verse + CASE WHEN {_MOVED} AND segment_order = 1 THEN 1 ELSE 0 END AS BIGINT) AS verse FROM rows0 WHERE header = 0)"""
# the rule itself, one line or segment after the other; kind -1 begins a page
_SEQUENTIAL = """hp AS (SELECT collection_id, page_number, page_number - row_number() OVER (PARTITION BY collection_id ORDER BY page_number) AS island FROM v_page WHERE page_number >= 21), hi AS (SELECT collection_id, island FROM hp WHERE page_number = 21),
on_ AS (SELECT collection_id, page_number FROM hp JOIN hi USING (collection_id, island)),
ev1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY page_number, line_number, kind, segment_order) AS rn FROM (
  SELECT collection_id, page_number, 0 AS line_number, -1 AS kind, 0 AS segment_order, '' AS type, CAST(NULL AS BIGINT) AS stored, false AS closes FROM on_
  UNION ALL SELECT collection_id, page_number, line_number, 0, 0, type, chapter, false FROM sl SEMI JOIN on_ USING (collection_id, page_number)
  UNION ALL SELECT collection_id, page_number, line_number, 1, segment_order, 'text', verse, closes FROM ss SEMI JOIN on_ USING (collection_id, page_number)) e),
go AS (SELECT collection_id, CAST(0 AS BIGINT) AS rn, CAST(chapter AS BIGINT) AS s, CAST(verse AS BIGINT) AS v, true AS ch, 0 AS page_number, 0 AS line_number, -1 AS kind, 0 AS segment_order, CAST(0 AS BIGINT) AS own, false AS hit FROM en SEMI JOIN on_ USING (collection_id, page_number) WHERE page_number = 21
  UNION ALL SELECT collection_id, rn, s, CASE WHEN type = 'header' THEN 1 WHEN closes THEN own + 1 ELSE own END, CASE kind WHEN -1 THEN false ELSE ch OR hit END, page_number, line_number, kind, segment_order, own, hit FROM (
    SELECT *, CASE kind WHEN 0 THEN stored IS DISTINCT FROM s WHEN 1 THEN stored IS DISTINCT FROM own ELSE false END AS hit FROM (
      SELECT e.*, CASE WHEN e.type = 'header' AND g.v <> 1 THEN g.s + 1 ELSE g.s END AS s, g.v AS own, g.ch FROM go g JOIN ev1 e ON e.collection_id = g.collection_id AND e.rn = g.rn + 1 WHERE e.kind >= 0 OR g.ch) a) b)"""


def _stored(spark, sf_dir):
    """Pages, and lines and segments with the walk's numbers; on some pages from 21 on the first segments of lines are moved by one, and headers have
    none or another chapter."""
    pages, lines, segments = domain(spark, sf_dir, "page", "line", "segment")
    keep, parts = ("type", "x", "closes"), row_parts(spark, sf_dir)
    rows = T.page_rows(lines.withColumn("chapter", F.lit(None).cast("long")), segments.withColumn("verse", F.lit(None).cast("long")), keep=keep, parts=parts)
    seeded = N.with_seeds(pages).select(*N.PAGE, "island", "seed_chapter", "seed_verse")
    # one table, since several steps read it
    walked = stored(T.numbered(rows, T.entered(seeded, T.page_functions(rows), ["collection_id", "island"]), keep), "walked")
    here = F.col("page_number").between(21, 21 + F.col("collection_id") % 5)
    other = F.when(F.col("x") % 3 == 0, None).when(F.col("x") % 3 == 1, F.col("chapter") + 5).otherwise(F.col("chapter"))
    moved = walked.filter("segment_order is null").select(*N.PAGE, "line_number", "type", F.when((F.col("type") == "header") & here, other).otherwise(F.col("chapter")).alias("chapter"))
    verse = F.col("verse") + F.when(here & (F.col("segment_order") == 1), 1).otherwise(0)
    texts = walked.filter("segment_order is not null").select(*N.ORDERED, "closes", verse.alias("verse"))
    return pages, moved, texts, parts


@query(f"""WITH RECURSIVE {_SEED}, {_rows(tag='0')}, {_LINE_CHAPTERS}, {_LATER}, {_exits('sl', 'ss')}, {_SEQUENTIAL}
SELECT collection_id, page_number, line_number, CASE WHEN kind = 1 THEN segment_order END AS segment_order, s AS chapter, CASE WHEN kind = 1 THEN own END AS verse FROM go WHERE hit""")
def e07_renumbered_from(spark, sf_dir):
    """From page 21 of each collection on."""
    pages, lines, segments, parts = _stored(spark, sf_dir)
    start = pages.filter("page_number = 21").select("collection_id", F.lit(21).alias("from_page"))
    return T.renumbered_from(pages, lines, segments, start, parts)


@query(f"""WITH {_SEED}, {_rows()}, {_EXPECTED}, ie AS (SELECT collection_id, island, max(chapter) AS last, min(s0) AS s0, min(v0) AS v0 FROM rows GROUP BY ALL),
ok AS (SELECT DISTINCT r.collection_id, r.chapter FROM rows r JOIN ie USING (collection_id, island) WHERE r.chapter < last AND (r.chapter > ie.s0 OR ie.v0 = 1)), cl AS (SELECT collection_id, chapter, sum(c) AS closing FROM rows GROUP BY ALL)
SELECT collection_id, CAST(ok.chapter AS BIGINT) AS chapter, CAST(coalesce(closing, 0) AS BIGINT) AS closing, expected FROM ok JOIN want USING (chapter) LEFT JOIN cl USING (collection_id, chapter) WHERE coalesce(closing, 0) <> expected""")
def e08_renumber_plan(spark, sf_dir):
    return N.renumber_plan(*domain(spark, sf_dir, "page", "line", "segment"), _expected(spark))


@query(f"""WITH {_SEED}, {_rows(tag='0')}, {_LINE_CHAPTERS}, a AS (SELECT collection_id, count(*) AS lines, count(*) FILTER (walked IS DISTINCT FROM CASE WHEN x % 5 <> 4 THEN (collection_id + line_number) % 7 + 1 END) AS lines_changed FROM lc GROUP BY collection_id),
b AS (SELECT r.collection_id, count(*) AS segments, count(*) FILTER (r.verse IS DISTINCT FROM CASE WHEN s.x % 11 <> 0 THEN CAST(s.segment_order + s.line_number % 3 AS BIGINT) END) AS segments_changed FROM rows0 r JOIN v_segment s USING (collection_id, page_number, line_number, segment_order) WHERE header = 0 GROUP BY r.collection_id)
SELECT collection_id, lines, coalesce(segments, 0) AS segments, lines_changed, coalesce(segments_changed, 0) AS segments_changed FROM a LEFT JOIN b USING (collection_id)""")
def e08_renumber_changes(spark, sf_dir):
    pages, lines, segments = domain(spark, sf_dir, "page", "line", "segment")
    chapters = lines.withColumn("chapter", F.when(F.col("x") % 5 != 4, (F.col("collection_id") + F.col("line_number")) % 7 + 1))
    stored = segments.withColumn("verse", F.when(F.col("x") % 11 != 0, (F.col("segment_order") + F.col("line_number") % 3).cast("long")))
    return T.renumber_changes(N.with_seeds(pages), chapters, stored)


@query(f"""WITH {_SEED}, {_rows()} SELECT collection_id, CAST(chapter AS BIGINT) AS chapter, CAST(min(verse) AS BIGINT) AS first_verse, CAST(max(verse) AS BIGINT) AS last_verse, min(page_number) AS first_page, max(page_number) AS last_page, count(DISTINCT page_number) AS n_pages, CAST(sum(c) AS BIGINT) AS closing FROM rows WHERE header = 0 GROUP BY collection_id, chapter""")
def d11_d23_held_chapters(spark, sf_dir):
    return N.held_chapters(N.walk(*domain(spark, sf_dir, "page", "line", "segment"), row_parts(spark, sf_dir)))


@query("""WITH h AS (SELECT p.collection_id, p.page_number, bool_or(type = 'header') IS TRUE AS header FROM v_page p LEFT JOIN v_line USING (collection_id, page_number) GROUP BY ALL),
w AS (SELECT *, max(CASE WHEN header THEN page_number END) OVER o AS lh, min(page_number) OVER o AS f FROM h WINDOW o AS (PARTITION BY collection_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT collection_id, page_number, coalesce(lh, f) AS from_page FROM w WHERE header AND f IS NOT NULL""")
def e24_ending_pages(spark, sf_dir):
    return N.ending_pages(*domain(spark, sf_dir, "page", "line"))


@query("""WITH b AS (SELECT collection_id, page_number, line_number, type, CASE WHEN page_number % 6 = 2 AND line_number = 1 THEN x + 1 ELSE x END AS x, y, w, h FROM v_line WHERE page_number % 10 <> 7), l AS (SELECT * FROM v_line WHERE page_number % 10 <> 8),
a AS (SELECT collection_id, page_number, list((line_number, type, x, y, w, h) ORDER BY line_number) AS d FROM l GROUP BY ALL), c AS (SELECT collection_id, page_number, list((line_number, type, x, y, w, h) ORDER BY line_number) AS d FROM b GROUP BY ALL)
SELECT collection_id, page_number, CASE WHEN c.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL JOIN c USING (collection_id, page_number) WHERE a.d IS DISTINCT FROM c.d""")
def l06_g13_dirty_pages(spark, sf_dir):
    (lines,) = domain(spark, sf_dir, "line")
    base = lines.filter("page_number % 10 <> 7").withColumn("x", F.when(F.expr("page_number % 6 = 2 AND line_number = 1"), F.col("x") + 1).otherwise(F.col("x")))
    return N.dirty_pages(lines.filter("page_number % 10 <> 8"), base)
