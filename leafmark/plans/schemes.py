"""Queries over counting schemes and reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import schemes as S
from leafmark.plans.base import domain, query, tables
from leafmark.sources.views import text_parts

SCHEMES = ["base", "fewer", "split", "both"]

_INDEX = "idx AS (SELECT chapter, verse, n_words, CAST(1 + coalesce(sum(n_words) OVER (ORDER BY chapter, verse ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM v_verse)"
_STARTS = _INDEX + """, sch AS (SELECT unnest(['base', 'fewer', 'split', 'both']) AS scheme),
stops AS (SELECT scheme, i.chapter, i.start + i.n_words AS stop FROM idx i CROSS JOIN sch LEFT JOIN (SELECT * FROM v_delta WHERE kind = 'end') d ON d.chapter = i.chapter AND d.verse = i.verse
    WHERE d.chapter IS NULL OR list_contains(string_split(d.counted_by, ','), scheme)
  UNION ALL SELECT scheme, i.chapter, i.start + d.after_position FROM v_delta d JOIN idx i ON d.chapter = i.chapter AND d.verse = i.verse CROSS JOIN sch WHERE d.kind = 'internal' AND list_contains(string_split(d.counted_by, ','), scheme)),
starts AS (SELECT scheme, chapter, row_number() OVER (PARTITION BY scheme, chapter ORDER BY stop) AS number, coalesce(lag(stop) OVER (PARTITION BY scheme, chapter ORDER BY stop), f.first) AS start
  FROM stops JOIN (SELECT chapter, min(start) AS first FROM idx GROUP BY chapter) f USING (chapter))"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    verses, deltas = domain(spark, sf_dir, "verse", "delta")
    return S.first_tokens(verses), deltas


def _parts(spark: SparkSession, sf_dir: str) -> int:
    return text_parts(tables(spark, sf_dir, "documents")[0])


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scheme_starts(*_index(spark, sf_dir), SCHEMES, _parts(spark, sf_dir))


def _ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, deltas = _index(spark, sf_dir)
    chapters = index.groupBy("chapter").agg((F.max(F.col("start") + F.col("n_words")) - 1).alias("last_token"))
    return S.with_ends(S.scheme_starts(index, deltas, SCHEMES, _parts(spark, sf_dir)), chapters)


@query(f"WITH {_INDEX} SELECT * FROM idx")
def e01_first_tokens(spark, sf_dir):
    return _index(spark, sf_dir)[0]


@query(f"WITH {_STARTS} SELECT * FROM starts")
def e02_scheme_starts(spark, sf_dir):
    return _starts(spark, sf_dir)


@query("""WITH opted AS (SELECT chapter, verse, 'base' AS counted_by FROM (SELECT chapter, max(verse) AS verse FROM v_verse GROUP BY chapter) WHERE chapter % 9 = 0)
SELECT unnest(['fewer', 'split', 'both']) AS scheme, chapter, verse FROM opted""")
def e02_open_chapters(spark, sf_dir):
    """Faults planted: the last verse of each ninth chapter is counted by one scheme only."""
    index, _ = _index(spark, sf_dir)
    planted = index.groupBy("chapter").agg(F.max("verse").alias("verse")).filter("chapter % 9 = 0").select("chapter", "verse", F.lit("end").alias("kind"), F.lit(0).alias("after_position"), F.lit("base").alias("counted_by"))
    return S.open_chapters(index, planted, SCHEMES)


_FAULTS = """, bad AS (SELECT scheme, chapter, number, CASE WHEN scheme = 'split' AND chapter % 97 = 5 AND number = 1 THEN start + 1 WHEN scheme = 'fewer' AND chapter % 10 = 1 AND number = 2 THEN start - 1 ELSE start END AS start FROM starts
  WHERE scheme <> 'both' AND NOT (scheme = 'fewer' AND start = 1) AND NOT (chapter % 50 = 7 AND number = 1)),
doubled AS (SELECT * FROM bad UNION ALL SELECT scheme, chapter, number + 100000, start FROM bad WHERE scheme = 'base' AND chapter % 40 = 2 AND number = 1)"""


@query(f"""WITH {_STARTS}{_FAULTS}, firsts AS (SELECT chapter, count(DISTINCT start) AS places FROM doubled WHERE number = 1 GROUP BY chapter)
SELECT scheme, 'first_start' AS problem, min(start) AS n FROM doubled GROUP BY scheme HAVING min(start) <> 1
UNION ALL SELECT scheme, 'repeated_start', count(*) - count(DISTINCT start) FROM doubled GROUP BY scheme HAVING count(*) > count(DISTINCT start)
UNION ALL SELECT scheme, 'no_verses', 0 FROM sch WHERE scheme NOT IN (SELECT scheme FROM doubled)
UNION ALL SELECT NULL, 'chapter_start', count(*) FROM firsts WHERE places > 1 HAVING count(*) > 0
UNION ALL SELECT NULL, 'no_first_verse', count(*) FROM (SELECT DISTINCT chapter FROM v_verse) WHERE chapter NOT IN (SELECT chapter FROM firsts) HAVING count(*) > 0""")
def e03_tiling_problems(spark, sf_dir):
    """Faults planted in the derived starts: a scheme is lost, firsts are moved or missing, and starts repeat."""
    starts = _starts(spark, sf_dir)
    moved = F.when(F.expr("scheme = 'split' AND chapter % 97 = 5 AND number = 1"), F.col("start") + 1).when(F.expr("scheme = 'fewer' AND chapter % 10 = 1 AND number = 2"), F.col("start") - 1).otherwise(F.col("start"))
    bad = starts.filter("scheme <> 'both' AND NOT (scheme = 'fewer' AND start = 1) AND NOT (chapter % 50 = 7 AND number = 1)").withColumn("start", moved)
    twice = bad.filter("scheme = 'base' AND chapter % 40 = 2 AND number = 1").withColumn("number", F.col("number") + 100_000)
    return S.tiling_problems(bad.unionByName(twice), SCHEMES, domain(spark, sf_dir, "verse")[0].select("chapter").distinct(), _parts(spark, sf_dir))


_EDITIONS = """ed AS (SELECT n.n_name AS edition, r.r_name AS tradition, CASE r.r_regionkey WHEN 0 THEN 'base' WHEN 1 THEN 'fewer' WHEN 2 THEN 'split' WHEN 3 THEN 'both' END AS scheme
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey % 6 <> 5)"""


def _editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = tables(spark, sf_dir, "nation", "region")
    editions = nation.select(F.col("n_name").alias("edition"), F.when(F.col("n_nationkey") % 6 != 5, F.col("n_regionkey")).alias("tradition_id"))
    schemes = F.element_at(F.array(*(F.lit(s) for s in SCHEMES), F.lit(None)), F.col("r_regionkey").cast("int") + 1)
    traditions = region.select(F.col("r_regionkey").alias("tradition_id"), F.col("r_name").alias("tradition"), schemes.alias("scheme"))
    known = traditions.select("scheme", F.lit(True).alias("known")).filter("scheme is not null").distinct()
    return S.chain(editions, traditions, known)


@query(f"WITH {_EDITIONS} SELECT edition, tradition, scheme, scheme IS NOT NULL AS has_scheme FROM ed")
def c01_edition_chain(spark, sf_dir):
    return _editions(spark, sf_dir)


_ENDED = _STARTS + """, ended AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY scheme ORDER BY start) - 1, (SELECT max(start + n_words) - 1 FROM idx)) AS last FROM starts),
req AS (SELECT scheme, chapter AS from_chapter, number + chapter % 3 AS from_number, chapter + number % 2 AS to_chapter, number + number % 4 - 1 AS to_number FROM starts WHERE number % 5 = 2)"""


@query(f"""WITH {_ENDED}, j AS (SELECT q.*, a.start AS first_token, b.last AS last_token FROM req q LEFT JOIN ended a ON a.scheme = q.scheme AND a.chapter = q.from_chapter AND a.number = q.from_number
  LEFT JOIN ended b ON b.scheme = q.scheme AND b.chapter = q.to_chapter AND b.number = q.to_number),
s AS (SELECT *, CASE WHEN first_token IS NULL THEN 'missing_start' WHEN last_token IS NULL THEN 'missing_end' WHEN last_token < first_token THEN 'backwards' ELSE 'ok' END AS status FROM j)
SELECT *, CASE WHEN status = 'ok' THEN last_token - first_token + 1 END AS n_tokens FROM s""")
def c03_resolved_spans(spark, sf_dir):
    verses = _ended(spark, sf_dir)
    spans = verses.filter("number % 5 = 2").selectExpr("scheme", "chapter AS from_chapter", "number + chapter % 3 AS from_number", "chapter + number % 2 AS to_chapter", "number + number % 4 - 1 AS to_number")
    return S.resolved_spans(spans, verses, _parts(spark, sf_dir))


@query("""WITH s AS (SELECT chapter AS span_id, chapter AS from_chapter, verse AS from_verse, chapter + 1 AS to_chapter, 2 AS to_verse FROM v_verse WHERE verse = 3)
SELECT span_id, v.chapter, v.verse FROM s JOIN v_verse v ON (v.chapter, v.verse) >= (from_chapter, from_verse) AND (v.chapter, v.verse) <= (to_chapter, to_verse)""")
def c04_verses_between(spark, sf_dir):
    (verses,) = domain(spark, sf_dir, "verse")
    spans = verses.filter("verse = 3").selectExpr("chapter AS span_id", "chapter AS from_chapter", "verse AS from_verse", "chapter + 1 AS to_chapter", "2L AS to_verse")
    return S.verses_between(spans, verses)


@query(f"WITH {_STARTS} SELECT scheme, count(*) AS n_verses, count(DISTINCT chapter) AS n_chapters FROM starts GROUP BY scheme")
def d07_scheme_totals(spark, sf_dir):
    return S.scheme_totals(_starts(spark, sf_dir))


@query(f"""WITH {_STARTS}, {_EDITIONS}, n AS (SELECT scheme, chapter, count(*) AS n_verses FROM starts GROUP BY ALL)
SELECT edition, c.chapter, n_verses FROM (SELECT DISTINCT chapter FROM v_verse) c CROSS JOIN ed LEFT JOIN n ON n.scheme = ed.scheme AND n.chapter = c.chapter""")
def d08_chapter_counts(spark, sf_dir):
    chapters = domain(spark, sf_dir, "verse")[0].select("chapter").distinct()
    return S.chapter_counts(chapters, _starts(spark, sf_dir), _editions(spark, sf_dir))


@query(f"""WITH {_STARTS}, l AS (SELECT scheme, chapter, max(number) AS last FROM starts GROUP BY ALL)
SELECT s.scheme, s.chapter, number, CASE WHEN number < l.last THEN s.chapter WHEN r.chapter IS NOT NULL THEN r.chapter END AS next_chapter, CAST(CASE WHEN number < l.last THEN number + 1 WHEN r.chapter IS NOT NULL THEN 1 END AS BIGINT) AS next_number
FROM starts s JOIN l USING (scheme, chapter) LEFT JOIN l r ON r.scheme = s.scheme AND r.chapter = s.chapter + 1""")
def d09_next_verses(spark, sf_dir):
    return S.next_verses(_starts(spark, sf_dir))


@query(f"""WITH {_STARTS}, built AS (SELECT scheme, chapter, count(*) AS n FROM starts GROUP BY ALL),
expected AS (SELECT scheme, v.chapter, count(*) - count(*) FILTER (scheme IN ('fewer', 'both') AND d.kind = 'end') + count(*) FILTER (scheme IN ('split', 'both') AND i.kind = 'internal') + max(CASE WHEN v.chapter % 30 = 3 THEN 1 ELSE 0 END) AS n
  FROM v_verse v CROSS JOIN sch LEFT JOIN v_delta d ON d.chapter = v.chapter AND d.verse = v.verse AND d.kind = 'end' LEFT JOIN v_delta i ON i.chapter = v.chapter AND i.verse = v.verse AND i.kind = 'internal' WHERE v.chapter % 41 <> 5 GROUP BY ALL)
SELECT 'count' AS kind, scheme AS subject, concat_ws(' ', chapter, b.n, e.n) AS detail FROM built b FULL JOIN expected e USING (scheme, chapter) WHERE b.n IS DISTINCT FROM e.n
UNION ALL SELECT 'missing', 'sixth', ''""")
def d10_l01_l02_l07_seed_problems(spark, sf_dir):
    """Counts of each chapter and scheme against counts from the boundaries alone, with planted differences; and a scheme that isn't there."""
    verses, deltas = domain(spark, sf_dir, "verse", "delta")
    starts = _starts(spark, sf_dir)
    built = starts.groupBy("scheme", "chapter").agg(F.count("*").alias("n"))
    end = deltas.filter("kind = 'end'").select("chapter", "verse", F.lit(1).alias("e"))
    inside = deltas.filter("kind = 'internal'").select("chapter", "verse", F.lit(1).alias("i"))
    named = verses.filter("chapter % 41 <> 5").withColumn("scheme", F.explode(F.array(*(F.lit(s) for s in SCHEMES)))).join(end, ["chapter", "verse"], "left").join(inside, ["chapter", "verse"], "left")
    n = F.count("*") - F.count_if(F.col("scheme").isin("fewer", "both") & F.col("e").isNotNull()) + F.count_if(F.col("scheme").isin("split", "both") & F.col("i").isNotNull())
    expected = named.groupBy("scheme", "chapter").agg(n.alias("n")).withColumn("n", F.col("n") + F.when(F.col("chapter") % 30 == 3, 1).otherwise(0))
    required = spark.createDataFrame([(s,) for s in [*SCHEMES, "sixth"]], "scheme string")
    return S.problem_list(count=S.count_differences(built, expected, ["scheme", "chapter"]), missing=S.missing_members(required, starts, "scheme"))


# every eleventh word row was lost, and one scheme is expected to have a verse more
_PIECES = "length(regexp_replace(token, '[^aeiou]', '', 'g')) + 1"
_TOTALS = f"""built AS (SELECT 'words' AS total, count(*) AS n FROM v_token WHERE pos % 11 <> 7 UNION ALL SELECT 'pieces', CAST(sum({_PIECES}) AS BIGINT) FROM v_token WHERE pos % 11 <> 7 UNION ALL SELECT 'index', max(start + n_words - 1) FROM idx UNION ALL SELECT 'verses:' || scheme, count(*) FROM starts GROUP BY scheme),
want AS (SELECT 'words' AS total, CAST(sum(n_words) AS BIGINT) AS n FROM v_verse UNION ALL SELECT 'pieces', CAST(sum({_PIECES}) AS BIGINT) FROM v_token UNION ALL SELECT 'index', CAST(sum(n_words) AS BIGINT) FROM v_verse UNION ALL SELECT 'verses:' || scheme, count(*) + CASE scheme WHEN 'split' THEN 1 ELSE 0 END FROM starts GROUP BY scheme)"""


@query(f"WITH {_STARTS}, {_TOTALS} SELECT total, b.n AS built, w.n AS expected FROM built b FULL JOIN want w USING (total) WHERE b.n IS DISTINCT FROM w.n")
def d10_total_problems(spark, sf_dir):
    tokens, verses = domain(spark, sf_dir, "token", "verse")
    index, deltas = _index(spark, sf_dir)
    starts = S.scheme_starts(index, deltas, SCHEMES)
    words = tokens.withColumn("pieces", F.char_length(F.regexp_replace("token", "[^aeiou]", "")) + 1)
    whole = words.agg(F.sum("pieces").alias("n")).select(F.lit("pieces").alias("total"), F.col("n").cast("long").alias("n"))
    sizes = verses.agg(F.sum("n_words").alias("n")).select(F.explode(F.array(*(F.struct(F.lit(t).alias("total"), F.col("n").cast("long").alias("n")) for t in ("words", "index")))).alias("t")).select("t.*")
    schemes = starts.groupBy("scheme").agg(F.count("*").alias("n")).select(F.concat(F.lit("verses:"), "scheme").alias("total"), (F.col("n") + F.when(F.col("scheme") == "split", 1).otherwise(0)).alias("n"))
    return S.count_differences(S.seed_totals(words.filter("pos % 11 <> 7"), index, starts), whole.unionAll(sizes).unionAll(schemes), ["total"])


# two boundaries inside a verse and one at its end; the other source lacks some, has some elsewhere and some that we don't have
_OURS = "SELECT chapter, verse, CASE pos % 9 WHEN 8 THEN 'end' ELSE 'internal' END AS kind, token AS word, pos % 9 + 1 AS position FROM {} WHERE pos % 9 IN (2, 5, 8) AND (chapter + verse) % 3 = 0"
_THEIRS = "SELECT chapter, verse, kind, word, position + CASE WHEN chapter % 5 = 0 AND position = 3 THEN 1 ELSE 0 END AS position FROM {o} WHERE (verse + position) % 7 <> 3 UNION ALL SELECT chapter, verse, 'internal', token, pos % 9 + 1 FROM {t} WHERE pos % 9 = 0 AND chapter % 8 = 0"
_PLACES = f"ours AS ({_OURS.format('v_token')}), theirs AS ({_THEIRS.format(o='ours', t='v_token')}), last_ AS (SELECT chapter, verse, kind, word, max(position) AS theirs FROM theirs GROUP BY ALL)"


def _places(spark, sf_dir):
    (tokens,) = domain(spark, sf_dir, "token")
    ours = spark.sql(_OURS.format("{t}"), t=tokens)
    return ours, spark.sql(_THEIRS.format(o="{o}", t="{t}"), o=ours, t=tokens)


@query(f"""WITH {_PLACES}, s AS (SELECT kind, CASE WHEN theirs IS NULL THEN 'm' WHEN theirs = position THEN 'a' ELSE 's' END AS st FROM ours LEFT JOIN last_ USING (chapter, verse, kind, word) UNION ALL SELECT kind, 'l' FROM last_ t WHERE NOT EXISTS (SELECT 1 FROM ours o WHERE o.chapter = t.chapter AND o.verse = t.verse AND o.kind = t.kind AND o.word = t.word))
SELECT kind, count(*) FILTER (st = 'a') AS agree, count(*) FILTER (st = 's') AS shifted, count(*) FILTER (st = 'm') AS missing_theirs, count(*) FILTER (st = 'l') AS missing_ours FROM s GROUP BY kind""")
def c17_place_differences(spark, sf_dir):
    return S.place_differences(*_places(spark, sf_dir))


@query(f"WITH {_PLACES} SELECT chapter, verse, kind, word, position AS ours, theirs, CASE WHEN theirs IS NULL THEN 'missing' ELSE 'shifted' END AS state FROM ours LEFT JOIN last_ USING (chapter, verse, kind, word) WHERE theirs IS DISTINCT FROM position")
def c17_disagreements(spark, sf_dir):
    return S.compared_places(*_places(spark, sf_dir)).filter("state <> 'agree'")


@query("""WITH p AS (SELECT *, lag(verse) OVER (PARTITION BY chapter ORDER BY pos) AS before FROM v_token)
SELECT chapter, pos, verse FROM p WHERE before IS DISTINCT FROM verse UNION ALL SELECT chapter, max(pos) + 1, NULL FROM v_token GROUP BY chapter""")
def e27_stream_starts(spark, sf_dir):
    return S.stream_starts(*domain(spark, sf_dir, "token"))


_LINES = "ln AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN pos % 11 = 3 THEN '# ' || l WHEN pos % 7 = 2 THEN 'x|' || pos || '|' || l WHEN pos % 7 = 5 THEN doc_id || '|' || pos WHEN pos % 13 = 6 THEN doc_id || '|' || pos || '|  ' ELSE ' ' || doc_id || '|' || pos || '|' || l END AS value FROM {})"


@query("WITH " + _LINES.format("(SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) d) e") + r""",
t AS (SELECT regexp_replace(value, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line FROM ln), k AS (SELECT line, string_split(line, '|') AS s, regexp_replace(line, '^[^|]*[|][^|]*[|]', '') AS rest FROM t WHERE line <> '' AND NOT starts_with(line, '#')),
e AS (SELECT line, s, rest, CASE WHEN len(s) < 3 THEN 'missing_part' WHEN NOT regexp_matches(s[1], '^[0-9]+$') OR NOT regexp_matches(s[2], '^[0-9]+$') THEN 'bad_key' WHEN len(regexp_extract_all(rest, '[^ \t\n\r]+')) = 0 THEN 'no_words' END AS error FROM k)
SELECT md5(line) AS line, CASE WHEN error IS NULL THEN s[1]::BIGINT END AS chapter, CASE WHEN error IS NULL THEN s[2]::BIGINT END AS verse, CASE WHEN error IS NULL THEN array_to_string(regexp_extract_all(rest, '[^ \t\n\r]+'), ' ') END AS words, error FROM e""")
def a01_numbered_text(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    lines = spark.sql("WITH " + _LINES.format("(SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, l) FROM {d}) e") + " SELECT value FROM ln", d=docs)
    found = S.numbered_text(lines)
    return found.select(F.md5("line").alias("line"), "chapter", "verse", F.array_join("words", " ").alias("words"), "error")


@query("SELECT chapter, verse, kind, after_position, CAST(k AS INT) AS ord, string_split(counted_by, ',')[k + 1] AS scheme FROM v_delta, (SELECT unnest([0, 1]) AS k) o")
def a02_boundary_rows(spark, sf_dir):
    (deltas,) = domain(spark, sf_dir, "delta")
    text = F.to_json(F.struct("chapter", "verse", "kind", "after_position", F.split("counted_by", ",").alias("counted_by")))
    return S.boundary_rows(deltas.select(text.alias("value")))


@query("""WITH o AS (SELECT doc_id, doc_id * 10 AS id, n_chars AS n FROM documents WHERE doc_id % 3 = 0), f AS (SELECT doc_id, doc_id * 10 + 1 AS id, n_chars + 1 AS n FROM documents WHERE doc_id % 5 <> 0 AND lang IN ('en', 'de'))
SELECT doc_id, coalesce(o.id, f.id) AS id, coalesce(f.n, o.n) AS n, CASE WHEN o.id IS NULL THEN 'inserted' WHEN f.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM o FULL JOIN f USING (doc_id)""")
def a03_upsert(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 3 = 0").selectExpr("doc_id", "doc_id * 10 AS id", "n_chars AS n")
    new = docs.filter("doc_id % 5 <> 0").selectExpr("doc_id", "doc_id * 10 + 1 AS id", "n_chars + 1 AS n", "lang")
    return S.upsert(old, new, spark.createDataFrame([("en",), ("de",)], "lang string"), "doc_id", "lang", "n")


@query("SELECT row_number() OVER (ORDER BY lower(n_name), n_name) AS place, n_name AS name, coalesce(CASE WHEN n_nationkey % 4 <> 1 THEN r_name END, '') AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def l04_listing(spark, sf_dir):
    nation, region = tables(spark, sf_dir, "nation", "region")
    both = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # a few rows
    return S.listing(both.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 1, F.col("r_name")).alias("label_own"), F.lit(None).cast("string").alias("label_other")))


@query(r"""WITH t AS (SELECT chapter, verse, list(token ORDER BY pos) AS l FROM v_token GROUP BY ALL)
SELECT d.chapter, d.verse, after_position + 2 AS position, CAST(len(list_filter(l[1:after_position + 2], lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS BIGINT) AS corrected FROM v_delta d JOIN t ON t.chapter = d.chapter AND t.verse = d.verse WHERE kind = 'internal'""")
def g19_dropped_marks(spark, sf_dir):
    tokens, deltas = domain(spark, sf_dir, "token", "delta")
    return S.dropped_marks(tokens, deltas.filter("kind = 'internal'").selectExpr("chapter", "verse", "after_position + 2 AS position"))
