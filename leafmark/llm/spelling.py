"""Spelling variants by pivotal grams: words that one inserted, deleted or replaced code point apart, the form each goes to, and its root.

1. Words are counted over all texts, so what follows works on distinct words only.
2. A word's bigrams are ordered by how often words hold them, rarest first. Its prefix is the first GRAM * EDITS + 1 of them, and any
   others with the same bigram as the last of these. Of the prefix EDITS + 1 disjoint bigrams are its pivots: those that stand in fewest
   places of the index, chosen by dynamic programming over the word's positions.
3. One edit touches one of two disjoint bigrams at most. So of two near words, the one whose prefix ends earlier in the order has a
   pivot that stands in the other's prefix: at the same place if the words are equally long, there or one on if the other is one longer,
   there or one before if it is one shorter. Bigram, length and place are keys of an equality join. Of the pairs that meet, those
   whose letters' parities differ in more than two letters can't be near; the others are verified by edit distance, and no pair is a
   row before that.
4. A form has ten times its word's occurrences or more, so a chain of forms has no cycle and 18 steps at most: five doublings find each root.

The number of bigrams is that of two letters of LETTERS, so their counts are a broadcast of at most 8,100 rows at any size. A word has
at most (letters + 1) * (2 * length + 1) near words, so no key of the later joins holds many rows; the index's keys are spread by Spark's
splitting of skewed joins.

Cases: a null or empty text has no words; a null id counts as empty text before the colon; equal rows count as often as they stand
there; of equally frequent near words the smallest in code-point order is the form; texts may be of any length; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import documents, written, written_n

LETTERS = r"A-Za-zÀ-ÿ"
#: Words have LEAST code points and OCCURRENCES in all texts at least; a form has TIMES its word's.
LEAST, OCCURRENCES, TIMES = 7, 2, 10
GRAM, EDITS = 2, 1
#: Where this divides the checksum of id and run, a code point of the run is left out.
SLIP = 31

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words of all texts. A run of fewer letters than `least` can't become a word, so only longer ones are cut out."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    cut = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.char_length("run")))
    word = F.when(F.col("h") % SLIP == 0, without).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def _pivots(prefix: Column) -> Column:
    """EDITS + 1 = 2 disjoint bigrams of a prefix (places in order) of least cost together, by a fold over the places.

    near: the cheapest bigram up to and with the place before; far: the cheapest before that one; best: the cheapest pair."""
    one = "struct<cost:bigint,gram:string,place:int>"
    start = F.expr(f"named_struct('far', cast(null AS {one}), 'near', cast(null AS {one}), 'at', -9, 'best', cast(null AS struct<cost:bigint,first:{one},second:{one}>))")

    def step(s: Column, g: Column) -> Column:
        # places may be left out between two bigrams of a prefix; then all before stand apart
        apart = F.when(g["place"] - s["at"] >= GRAM, s["near"]).otherwise(s["far"])
        pair = F.when(apart.isNotNull(), F.struct((apart["cost"] + g["cost"]).alias("cost"), apart.alias("first"), g.alias("second")))
        return F.struct(s["near"].alias("far"), F.least(s["near"], g).alias("near"), g["place"].alias("at"), F.least(s["best"], pair).alias("best"))

    best = F.aggregate(prefix, start, step, lambda s: s["best"])
    return F.array(best["first"], best["second"])


def signatures(words: DataFrame) -> DataFrame:
    """(word, n, length, last, parity, prefix, pivots): the last rank of the prefix in the order of bigrams, the letters' parities, bigrams with their places."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(GRAM)))
    cells = words.select("word", "n", F.posexplode(cut).alias("place", "gram"))
    counts = cells.groupBy("gram").agg(F.count("*").alias("cost"))
    # at most 90 * 90 bigrams, whatever the number of words
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy("cost", "gram")))
    ordered = cells.join(F.broadcast(ranked), "gram").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("rank", "place", "gram", "cost"))).alias("all"))
    ordered = ordered.withColumn("last", F.element_at("all", GRAM * EDITS + 1)["rank"])
    held = F.filter("all", lambda g: g["rank"] <= F.col("last"))
    prefix = F.array_sort(F.transform(held, lambda g: F.struct(g["cost"].alias("cost"), g["gram"].alias("gram"), g["place"].alias("place"))), lambda a, b: a["place"] - b["place"])
    # a bit for each letter (some share one): whether the word has it an odd number of times; an edit changes two at most
    parity = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))
    ordered = ordered.select("word", "n", "last", prefix.alias("prefix"), parity.alias("parity"))
    return ordered.select("word", "n", F.char_length("word").alias("length"), "last", "parity", "prefix", _pivots(F.col("prefix")).alias("pivots"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words one edit apart. words: (word, n), each word once, of GRAM * EDITS + 2 code points or more."""
    signed = written(signatures(words), "spelling-signatures")
    index = signed.select("length", F.col("parity").alias("parity_b"), "last", F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode("prefix").alias("g")).select(F.col("g.gram").alias("gram"), "length", F.col("g.place").alias("place"), "b", "n_b", "parity_b", F.col("last").alias("last_b"))
    aligned = F.array(*(F.struct(F.lit(longer).alias("longer"), F.lit(later).alias("later")) for longer, later in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))))
    probes = signed.select("length", F.col("parity").alias("parity_a"), "last", F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode("pivots").alias("g"))
    probes = probes.select("*", F.explode(aligned).alias("s")).select(F.col("g.gram").alias("gram"), (F.col("length") + F.col("s.longer")).alias("length"), (F.col("g.place") + F.col("s.later")).alias("place"), "a", "n_a", "parity_a", F.col("last").alias("last_a"))
    p, i = probes.alias("p"), index.alias("i")
    meet = (F.col("p.gram") == F.col("i.gram")) & (F.col("p.length") == F.col("i.length")) & (F.col("p.place") == F.col("i.place"))
    alike = F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b"))) <= 2 * EDITS
    near = meet & (F.col("last_a") <= F.col("last_b")) & alike & (F.levenshtein("a", "b", EDITS) == EDITS)
    first = F.col("a") < F.col("b")
    pairs = p.join(i, near).select(F.least("a", "b").alias("a"), F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.greatest("a", "b").alias("b"), F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame, most_rounds: int = 5) -> DataFrame:
    """(word, root) of words with a form: the end of each chain, by doubling. forms: (word, form), without cycles, chains under 2**most_rounds."""
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        more = found.join(further, "root", "left_semi").limit(1).count()
        if not more:
            return found
        found = written(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return found


def spelling_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word. words: (word, n)."""
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    stands = -F.col("best.less") >= F.col("n") * times
    best = best.select("word", "n_near", F.when(stands, F.col("best.form")).alias("form"), F.when(stands, -F.col("best.less")).alias("form_n"))
    best, n = written_n(best, "spelling-near")
    ends = roots(best.filter("form is not null").select("word", "form")) if n else best.select("word", F.col("form").alias("root"))
    found = words.join(best, "word", "left").join(ends, "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(written(word_counts(documents(spark, sf_dir)), "spelling-words")).select("word", "form", "root", "n", "n_near", "form_n")


def _crc_nibbles() -> list[int]:
    """The checksum's table for four bits, by its polynomial."""
    out = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return out


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes."""
    digits = f"hex(encode({text}))"
    low_first = f"list_transform(range(length({digits})), lambda i: CAST(strpos('0123456789ABCDEF', substr({digits}, CAST(i - i % 2 * 2 + 2 AS BIGINT), 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {low_first}), lambda c, x: xor({_crc_nibbles()}[(xor(c, x) & 15) + 1], c >> 4)), 4294967295)"


OP11_SQL = f"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
low AS (SELECT translate(r, '{_UPPER}', '{_LOWER}') AS r, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || translate(r, '{_UPPER}', '{_LOWER}') AS k, count(*) AS n FROM runs WHERE length(r) >= {LEAST} GROUP BY ALL),
hashed AS MATERIALIZED (SELECT r, n, {crc32_sql('k')} AS h FROM low),
slips AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
del AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM del a JOIN words b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM del a JOIN words b ON a.rest = b.word),
best AS (SELECT word, n, count(*) AS n_near, arg_min((near, near_n), (-near_n, encode(near))) AS f FROM pairs GROUP BY ALL),
forms AS MATERIALIZED (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN f[2] >= {TIMES} * w.n THEN f[1] END AS form, CASE WHEN f[2] >= {TIMES} * w.n THEN f[2] END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
"""
OP11_SQL = "WITH RECURSIVE " + OP11_SQL[5:] + """chain AS (SELECT word, coalesce(form, word) AS root FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word JOIN forms e ON e.word = c.root WHERE e.form IS NULL"""
