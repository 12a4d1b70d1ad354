"""Queries over labels learned from examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmark.operators import labels as H
from leafmark.plans.base import domain, query, tables

# examples: two roles and types by label, moved so that distances tell them apart, and copies of some under other ids
_EX = """e0 AS (SELECT vec_id AS sample_id, CASE WHEN (label % 2 = 0) = (vec_id % 40 <> 0) THEN 'body' ELSE 'mark' END AS role, CAST(label AS VARCHAR) AS subtype, CAST(vec_id % 25 + 1 AS BIGINT) AS page_number, CAST(floor(vec_id / 4) AS BIGINT) AS snapshot_id, CAST(floor(vec_id / 250) AS BIGINT) AS collection_id, [0.1::DOUBLE * e::DOUBLE + 0.05::DOUBLE * label for e in embedding] AS features FROM embeddings),
ex AS (SELECT * FROM e0 UNION ALL SELECT sample_id + 1000000, role, subtype, page_number % 25 + 1, snapshot_id + 500000, collection_id, features FROM e0 WHERE sample_id % 10 = 3)"""


def _examples(spark, sf_dir):
    (vectors,) = tables(spark, sf_dir, "embeddings")
    features = F.transform("embedding", lambda e: F.lit(0.1) * e.cast("double") + F.lit(0.05) * F.col("label"))
    rows = vectors.select(F.col("vec_id").alias("sample_id"), F.when((F.col("label") % 2 == 0) == (F.col("vec_id") % 40 != 0), "body").otherwise("mark").alias("role"), F.col("label").cast("string").alias("subtype"), (F.col("vec_id") % 25 + 1).cast("long").alias("page_number"), F.floor(F.col("vec_id") / 4).alias("snapshot_id"), F.floor(F.col("vec_id") / 250).alias("collection_id"), features.alias("features"))
    copies = rows.filter("sample_id % 10 = 3").selectExpr("sample_id + 1000000 AS sample_id", "role", "subtype", "page_number % 25 + 1 AS page_number", "snapshot_id + 500000 AS snapshot_id", "collection_id", "features")
    return rows.unionByName(copies)


def _queries(examples, page: int):
    return examples.filter(F.col("page_number") == page).select(F.col("sample_id").alias("query_id"), *(c for c in ("collection_id",) if c in examples.columns), "features", "snapshot_id", "subtype")


def _all_groups(by: str) -> str:
    return f"gr AS (SELECT {by}, features, min(sample_id) AS group_id, count(*) AS copies, list({{'s': sample_id, 'n': snapshot_id, 'p': page_number}} ORDER BY sample_id) AS refs FROM ex GROUP BY {by}, features)"


def _groups(by: str) -> str:
    return f"gr AS (SELECT collection_id, {by}, features, min(sample_id) AS group_id, count(*) AS copies, list({{'s': sample_id, 'n': snapshot_id, 'p': page_number}} ORDER BY sample_id) AS refs FROM ex GROUP BY collection_id, {by}, features)"


_DIFF = "[(features[i] - f[i]) * (features[i] - f[i]) for i in range(1, len(f) + 1)]"
_SQUARE = f"round(sqrt(list_sum({_DIFF}[1:58]) * 0.5 + list_sum({_DIFF}[59:]) * 0.5), 9)"


def _near(by: str, queries: str = "SELECT sample_id AS query_id, collection_id, features AS f, snapshot_id AS own FROM ex WHERE page_number = 7") -> str:
    return f"""{_groups(by)}, qs AS ({queries}), nr AS (SELECT query_id, {by}, group_id, [r for r in refs if r.n IS DISTINCT FROM own] AS refs, {_SQUARE} AS distance FROM gr JOIN qs USING (collection_id)), nn AS (SELECT * FROM nr WHERE len(refs) > 0)"""


def _all_near(by: str) -> str:
    """One page of each collection against the examples of all."""
    return f"""{_all_groups(by)}, qs AS (SELECT sample_id AS query_id, features AS f, snapshot_id AS own FROM ex WHERE page_number = 7), nr AS (SELECT query_id, {by}, group_id, [r for r in refs if r.n IS DISTINCT FROM own] AS refs, {_SQUARE} AS distance FROM gr CROSS JOIN qs), nn AS (SELECT * FROM nr WHERE len(refs) > 0)"""


@query(f"WITH {_EX}, {_groups('role')} SELECT group_id, role, copies, list_sum([r.p for r in refs])::BIGINT AS pages, array_to_string([r.s for r in refs], ',') AS samples FROM gr")
def h01_folded(spark, sf_dir):
    groups = H.folded(_examples(spark, sf_dir), "role")
    return groups.select("group_id", "role", "copies", F.aggregate("refs", F.lit(0).cast("long"), lambda s, r: s + r["page_number"]).alias("pages"), F.array_join(F.transform("refs", lambda r: r["sample_id"].cast("string")), ",").alias("samples"))


@query(f"WITH {_EX} SELECT sample_id, 2 AS contents FROM ex WHERE sample_id % 7 = 1")
def h01_conflicting(spark, sf_dir):
    """Each seventh sample id is used again on another page."""
    examples = _examples(spark, sf_dir)
    again = examples.filter("sample_id % 7 = 1").withColumn("page_number", F.col("page_number") + 1)
    found = H.conflicting(examples.unionByName(again))
    return found.select("sample_id", F.col("contents").cast("int").alias("contents"))


_TOP = """bs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, group_id) AS k FROM nn QUALIFY k <= 5), pg AS (SELECT query_id, list(list_distinct([r.p for r in refs]) ORDER BY k) AS p, arg_min(role, k) AS candidate, count(DISTINCT role) AS roles, count(*) AS n, max(distance) AS farthest FROM bs GROUP BY query_id),
sb AS (SELECT query_id, s, [p[i] for i in range(1, len(p) + 1) if (s >> (i - 1)) & 1 = 1] AS c FROM pg, (SELECT unnest(range(32)) AS s) z WHERE s < (1 << len(p))), lk AS (SELECT query_id, max(len(c) - len(list_distinct(flatten(c)))) AS lack FROM sb GROUP BY query_id)"""


@query(f"""WITH {_EX}, {_all_near('role')}, {_TOP}, rl AS (SELECT query_id, min(distance) FILTER (role = 'body') AS body, min(distance) FILTER (role = 'mark') AS mark FROM nn GROUP BY query_id),
g AS (SELECT qs.query_id, candidate, coalesce(roles = 1, false) AS one, CASE WHEN roles = 1 THEN n ELSE 0 END AS support, CASE WHEN roles = 1 THEN n - lack ELSE 0 END AS pages, farthest, CASE candidate WHEN 'body' THEN mark WHEN 'mark' THEN body END AS opposite FROM qs LEFT JOIN pg USING (query_id) LEFT JOIN lk USING (query_id) LEFT JOIN rl USING (query_id)),
m AS (SELECT *, round(opposite - farthest, 9) AS margin, CASE WHEN opposite > 0 THEN round(farthest / opposite, 9) END AS ratio FROM g),
r AS (SELECT *, concat_ws(',', CASE WHEN candidate IS NULL THEN 'no_examples' WHEN NOT one THEN 'mixed_neighbors' END, CASE WHEN support < 5 THEN 'insufficient_support' END, CASE WHEN pages < 2 THEN 'insufficient_pages' END, CASE WHEN farthest >= 0.15 THEN 'too_far' END, CASE WHEN opposite IS NULL THEN 'missing_opposite' WHEN margin <= 0.10 THEN 'insufficient_margin' END, CASE WHEN opposite IS NOT NULL AND (ratio IS NULL OR ratio >= 0.5) THEN 'insufficient_ratio' END) AS reasons FROM m)
SELECT query_id, CASE WHEN reasons = '' THEN candidate END AS role, CASE WHEN reasons = '' THEN round(least(1 - farthest / 0.15, 1 - 0.10 / margin, 1 - ratio / 0.5), 6) ELSE 0.0 END AS confidence, CAST(support AS BIGINT) AS support, CAST(pages AS BIGINT) AS pages, reasons FROM r""")
def h02_h03_role_proposals(spark, sf_dir):
    """Components of one page of each collection against the examples of all."""
    examples = _examples(spark, sf_dir).drop("collection_id")
    return H.role_proposals(_queries(examples, 7), H.folded(examples, "role"))


_TYPES = """fw AS (SELECT *, row_number() OVER (PARTITION BY query_id, subtype ORDER BY distance, group_id) AS k FROM nn QUALIFY k <= 3), ty AS (SELECT query_id, subtype, round(avg(distance), 9) AS score, min(distance) AS nearest, count(*) FILTER (distance < 0.35) AS close FROM fw GROUP BY ALL),
xa AS (SELECT query_id, count(*) FILTER (close > 0 AND nearest <= 1e-6) AS n_exact FROM ty GROUP BY query_id), rk AS (SELECT ty.*, n_exact, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN close > 0 AND (n_exact <> 1 OR nearest <= 1e-6) THEN 0 ELSE 1 END, score, close DESC, subtype) AS w FROM ty JOIN xa USING (query_id)),
wi AS (SELECT * FROM rk WHERE w = 1 AND close > 0), ru AS (SELECT ty.query_id, ty.subtype, ty.score FROM ty JOIN wi ON wi.query_id = ty.query_id AND ty.subtype <> wi.subtype QUALIFY row_number() OVER (PARTITION BY ty.query_id ORDER BY ty.score, ty.close DESC, ty.subtype) = 1), mn AS (SELECT query_id, min(nearest) AS nearest FROM ty GROUP BY query_id),
gs AS (SELECT qs.query_id, coalesce(wi.subtype, '') AS subtype, CASE WHEN wi.subtype IS NULL THEN 0.0 WHEN wi.n_exact = 1 OR ru.score IS NULL THEN 1.0 WHEN ru.score > 0 THEN round(greatest(0.0, 1 - wi.score / ru.score), 4) ELSE 0.0 END AS confidence, coalesce(wi.close, 0) AS support, round(coalesce(wi.nearest, mn.nearest), 4) AS distance,
  coalesce(wi.n_exact = 1 OR ((ru.score IS NULL OR wi.score <= 0.85 * ru.score) AND wi.close >= 2), false) AS sure, coalesce(ru.subtype, '') AS runner_up, round(ru.score, 4) AS runner_distance FROM qs LEFT JOIN wi USING (query_id) LEFT JOIN ru USING (query_id) LEFT JOIN mn USING (query_id))"""


@query(f"WITH {_EX}, {_all_near('subtype')}, {_TYPES} SELECT * FROM gs")
def h04_type_guesses(spark, sf_dir):
    examples = _examples(spark, sf_dir).drop("collection_id")
    return H.type_guesses(_queries(examples, 7), H.folded(examples, "subtype"))


@query(f"""WITH {_EX}, {_all_near('subtype')}, {_TYPES}, sc AS (SELECT *, round(round(avg(distance) OVER (PARTITION BY query_id, subtype), 9), 4) AS score FROM fw), pl AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY score, subtype) AS place FROM sc)
SELECT query_id, place, subtype, score, k AS example, refs[1].s AS sample_id, round(distance, 4) AS distance, len(refs) AS copies FROM pl WHERE place <= 3""")
def h05_type_evidence(spark, sf_dir):
    examples = _examples(spark, sf_dir).drop("collection_id")
    return H.type_evidence(_queries(examples, 7), H.folded(examples, "subtype"))


_ASKED = "SELECT sample_id AS query_id, collection_id, features AS f, snapshot_id AS own FROM ex0 WHERE page_number = 7 AND sample_id % 3 {} 0"


@query(f"""WITH {_EX.replace('ex AS', 'ex0 AS')}, un AS (WITH ex AS (SELECT * FROM ex0), {_near('subtype', _ASKED.format('='))}, {_TYPES} SELECT * FROM gs), ty_ AS (WITH ex AS (SELECT * FROM ex0 WHERE page_number <> 7), {_near('subtype', _ASKED.format('<>'))}, {_TYPES} SELECT * FROM gs),
ow AS (SELECT sample_id AS query_id, collection_id, CASE WHEN sample_id % 5 = 1 THEN '0' ELSE subtype END AS own_type FROM ex0 WHERE page_number = 7)
SELECT query_id, 'suggestion' AS kind, subtype, sure FROM un WHERE subtype <> '' UNION ALL SELECT query_id, 'doubt', subtype, sure FROM ty_ JOIN ow USING (query_id) WHERE sure AND subtype <> own_type AND EXISTS (SELECT 1 FROM ex0 WHERE page_number <> 7 AND ex0.subtype = own_type AND ex0.collection_id = ow.collection_id)""")
def h06_type_suggestions(spark, sf_dir):
    """A third of the page's components is untyped, a fifth typed alike whatever they are."""
    examples = _examples(spark, sf_dir)
    own = F.when(F.col("query_id") % 3 == 0, "").when(F.col("query_id") % 5 == 1, "0").otherwise(F.col("subtype"))
    return H.type_suggestions(_queries(examples, 7).withColumn("subtype", own), examples, 7)


@query(f"WITH {_EX} SELECT sample_id, page_number, role, round(list_sum(features), 6) AS total FROM ex WHERE page_number IN (SELECT DISTINCT conv_id % 25 + 1 FROM conversations WHERE role = 'assistant') AND sample_id % 4 <> 2")
def h07_training_samples(spark, sf_dir):
    examples = _examples(spark, sf_dir)
    (talks,) = tables(spark, sf_dir, "conversations")
    approved = talks.filter("role = 'assistant'").selectExpr("conv_id % 25 + 1 AS page_number").distinct()
    found = H.training_samples(approved, examples.filter("sample_id % 4 <> 2").select("sample_id", "page_number", "role"), examples.select("sample_id", "features"))
    return found.select("sample_id", "page_number", "role", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# a page's first approval is what profiles were made from; later ones are approved now
_APPROVALS = "SELECT collection_id, page_number, min(review_id * 100 + number) AS revision_id FROM {r} WHERE kind = 'assistant' AND review_id % 4 <> 2 GROUP BY collection_id, page_number"
_SAMPLES = "SELECT review_id * 100 + number AS revision_id, review_id * 1000 + number * 10 + k AS sample_id, CASE WHEN (number + k) % 2 = 0 THEN 'body' ELSE 'mark' END AS role FROM {r} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) z WHERE kind = 'assistant'"
_PROFILES = f"""ap AS ({_APPROVALS.format(r='v_revision')}), pg AS (SELECT DISTINCT collection_id, page_number FROM v_revision), rv AS (SELECT pg.collection_id, pg.page_number, list(revision_id ORDER BY ap.page_number) FILTER (revision_id IS NOT NULL) AS revisions FROM pg LEFT JOIN ap ON ap.collection_id = pg.collection_id AND ap.page_number < pg.page_number GROUP BY ALL),
pf AS (SELECT collection_id, page_number, CASE WHEN collection_id % 3 = 0 THEN 1 ELSE 2 END AS min_pages, coalesce(revisions, []) AS revisions FROM rv), ps AS (SELECT *, sha256(concat_ws('|', '3', 'k=5', 'pages=' || min_pages, array_to_string(revisions, ','))) AS signature FROM pf)"""


def _profiles(spark, sf_dir):
    (revisions,) = domain(spark, sf_dir, "revision")
    pages = revisions.select("collection_id", "page_number").distinct()
    settings = pages.select("collection_id").distinct().withColumn("experimental", F.col("collection_id") % 3 == 0)
    return H.profiles(spark.sql(_APPROVALS.format(r="{r}"), r=revisions), pages, settings, 3, "k=5"), spark.sql(_SAMPLES.format(r="{r}"), r=revisions)


@query(f"WITH {_PROFILES} SELECT collection_id, page_number, signature, min_pages, len(revisions) AS n_revisions FROM ps")
def h08_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir)[0].select("collection_id", "page_number", "signature", "min_pages", F.size("revisions").cast("long").alias("n_revisions"))


@query(f"WITH {_PROFILES}, d AS (SELECT DISTINCT collection_id, signature, revisions FROM ps), x AS (SELECT collection_id, signature, unnest(revisions) AS revision_id FROM d), s AS ({_SAMPLES.format(r='v_revision')}) SELECT collection_id, signature, revision_id, sample_id, role FROM x JOIN s USING (revision_id)")
def h08_rebuilt_examples(spark, sf_dir):
    return H.rebuilt_examples(*_profiles(spark, sf_dir))


@query("SELECT page_number, count(*) FILTER (truth = 'body' AND predicted = 'mark') AS body_as_mark, count(*) FILTER (truth = 'mark' AND predicted = 'body') AS mark_as_body FROM v_truth WHERE truth IS NOT NULL GROUP BY page_number")
def h09_role_errors(spark, sf_dir):
    (rows,) = domain(spark, sf_dir, "truth")
    return H.role_errors(rows.selectExpr("doc_id AS id", "page_number", "predicted AS role"), rows.filter("truth is not null").selectExpr("doc_id AS id", "truth AS role"), ["page_number"])


_READ = "SELECT page_id, word_id + CASE WHEN word_id % 17 = 3 THEN 100000 ELSE 0 END AS word_id, CASE WHEN word_id % 11 = 2 THEN line_number + 1 ELSE line_number END AS line_number, start_x + CASE WHEN word_id % 7 = 1 THEN 5 ELSE 2 END AS start_x, end_x, line_number * 100 + position AS ord FROM {t} WHERE word_id IS NOT NULL AND word_id % 13 <> 4 UNION ALL SELECT page_id, word_id, line_number, start_x, end_x, line_number * 100 + position + 50 FROM {t} WHERE word_id % 19 = 5"


@query(f"""WITH f AS ({_READ.format(t='v_word')}), t AS (SELECT page_id, word_id, arg_min((line_number, start_x, end_x), line_number * 100 + position) AS t FROM v_word WHERE word_id IS NOT NULL GROUP BY ALL),
s AS (SELECT f.page_id, f.word_id, count(*) AS n, min((ord, start_x, end_x)) FILTER (t IS NOT NULL AND line_number = t[1]) AS same FROM f LEFT JOIN t ON t.page_id = f.page_id AND t.word_id = f.word_id GROUP BY ALL),
b AS (SELECT coalesce(t.page_id, s.page_id) AS page_id, t, n, same FROM t FULL JOIN s ON t.page_id = s.page_id AND t.word_id = s.word_id)
SELECT page_id, count(*) FILTER (t IS NOT NULL AND same IS NOT NULL AND (abs(same[2] - t[2]) > 3 OR abs(same[3] - t[3]) > 3)) AS moved, count(*) FILTER (t IS NOT NULL AND n IS NOT NULL AND same IS NULL) AS wrong_line, count(*) FILTER (t IS NOT NULL AND n IS NULL) AS missing, count(*) FILTER (t IS NOT NULL AND n > 1) AS duplicated, count(*) FILTER (t IS NULL) AS extra FROM b GROUP BY page_id""")
def h10_word_errors(spark, sf_dir):
    (words,) = domain(spark, sf_dir, "word")
    found = spark.sql(_READ.format(t="{w}"), w=words)
    return H.word_errors(found, words.filter("word_id is not null").withColumn("ord", F.col("line_number") * 100 + F.col("position")))


@query("SELECT predicted, count(*) AS made, count(*) FILTER (truth <> predicted) AS wrong, count(*) FILTER (exception) AS released FROM v_truth WHERE truth IS NOT NULL GROUP BY predicted")
def h11_proposal_quality(spark, sf_dir):
    return H.proposal_quality(*domain(spark, sf_dir, "truth"))


_GATES = """rl AS (SELECT query_id, min(distance) FILTER (role = 'body') AS body, min(distance) FILTER (role = 'mark') AS mark FROM nn GROUP BY query_id),
g AS (SELECT query_id, candidate, n, n - lack AS pages, farthest, CASE candidate WHEN 'body' THEN mark WHEN 'mark' THEN body END AS opposite FROM pg JOIN lk USING (query_id) JOIN rl USING (query_id) WHERE roles = 1)"""


@query(f"""WITH {_EX}, {_groups('role')}, qs AS (SELECT sample_id AS query_id, collection_id, features AS f, snapshot_id AS own, page_number AS before FROM ex),
nr AS (SELECT query_id, role, [r for r in refs if r.n IS DISTINCT FROM own AND r.p < before] AS refs, {_SQUARE} AS distance FROM gr JOIN qs USING (collection_id)), nn AS (SELECT *, refs[1].s AS group_id FROM nr WHERE len(refs) > 0), {_TOP}, {_GATES},
pr AS (SELECT collection_id, page_number, ex.role, CASE WHEN n >= 5 AND pages >= 2 AND farthest < 0.15 AND round(opposite - farthest, 9) > 0.10 AND opposite > 0 AND round(farthest / opposite, 9) < 0.5 THEN candidate END AS proposed FROM ex LEFT JOIN g ON g.query_id = ex.sample_id)
SELECT collection_id, page_number, CASE grouping(collection_id, page_number) WHEN 0 THEN 'page' WHEN 1 THEN 'collection' ELSE 'all' END AS scope, count(*) AS components, count(*) FILTER (proposed = 'body') AS bodies, count(*) FILTER (proposed = 'body' AND role <> 'body') AS wrong_bodies, count(*) FILTER (proposed = 'mark') AS marks, count(*) FILTER (proposed = 'mark' AND role <> 'mark') AS wrong_marks FROM pr GROUP BY ROLLUP (collection_id, page_number)""")
def h12_prequential(spark, sf_dir):
    """All pages of all collections, each against the pages before it."""
    return H.prequential(_examples(spark, sf_dir))


@query("""WITH r AS (SELECT page_id AS line, CASE position % 2 WHEN 0 THEN 'frozen' ELSE 'live' END AS reading, count(*) AS n, min(word_id) AS a, max(word_id) AS z FROM v_word GROUP BY ALL)
SELECT line, coalesce(max(n) FILTER (reading = 'frozen'), 0) AS frozen_n, max(a) FILTER (reading = 'frozen') AS frozen_a, max(z) FILTER (reading = 'frozen') AS frozen_z, coalesce(max(n) FILTER (reading = 'live'), 0) AS live_n, max(a) FILTER (reading = 'live') AS live_a, max(z) FILTER (reading = 'live') AS live_z FROM r GROUP BY line""")
def h13_side_by_side(spark, sf_dir):
    (words,) = domain(spark, sf_dir, "word")
    reading = F.when(F.col("position") % 2 == 0, "frozen").otherwise("live")
    by = words.groupBy(F.col("page_id").alias("line"), reading.alias("reading")).agg(F.count("*").alias("n_words"), F.min("word_id").alias("first_word"), F.max("word_id").alias("last_word"))
    return H.side_by_side(by, ["frozen", "live"])


@query("""WITH o AS (SELECT page_id AS line, word_id, max(start_x) AS s, min(end_x) AS e FROM v_word WHERE word_id IS NOT NULL GROUP BY ALL), d AS (SELECT line % 10 AS part, CASE WHEN word_id % 3 = 0 THEN word_id % 23 ELSE 0 END + CASE WHEN line % 2 = 0 THEN 2 ELSE 0 END AS d FROM o WHERE word_id % 9 <> 1)
SELECT part, count(*) AS words, count(*) FILTER (d > 0) AS widened, quantile_cont(d, 0.5) FILTER (d > 0) AS median, quantile_cont(d, 0.9) FILTER (d > 0) AS p90, max(d) FILTER (d > 0) AS greatest FROM d GROUP BY part""")
def h14_compared_reports(spark, sf_dir):
    (words,) = domain(spark, sf_dir, "word")
    old = words.filter("word_id is not null").groupBy(F.col("page_id").alias("line"), "word_id").agg(F.max("start_x").alias("start_x"), F.min("end_x").alias("end_x"))
    new = old.filter("word_id % 9 <> 1").selectExpr("line", "word_id", "start_x + CASE WHEN word_id % 3 = 0 THEN word_id % 23 ELSE 0 END AS start_x", "end_x - CASE WHEN line % 2 = 0 THEN 2 ELSE 0 END AS end_x")
    return H.compared_reports(old, new)


@query("SELECT score, count(*) FILTER (truth = 'body') AS bodies, count(*) FILTER (truth = 'mark') AS marks, count(*) FILTER (truth = 'body') > 0 AND count(*) FILTER (truth = 'mark') > 0 AS contested FROM v_truth WHERE truth IS NOT NULL GROUP BY score")
def h15_evidence_bands(spark, sf_dir):
    (rows,) = domain(spark, sf_dir, "truth")
    return H.evidence_bands(rows.filter("truth is not null").select("score", F.col("truth").alias("role")))
