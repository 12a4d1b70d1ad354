"""N-gram perplexity rules: a modified Kneser-Ney model counted by Spark, with bands for each language.

The n-grams are four-grams of a text's bytes, none merged with another (classgrams.py). Spark counts those of all texts,
counts continuations, discounts and interpolates; the log10 probabilities go to the workers as sorted arrays of 64-bit
hashes and are found by binary search. A table of word triples would grow nearly with the corpus, and since the texts that are
scored are those counted, triples that stand once (65 % of sf0.1's) would vouch for themselves.

Cases: a null or empty text has no words, so base_failed is true, its perplexity null and it is not kept; equal
texts get equal values; a null language is a language of its own (""); columns besides the three named are
ignored; an empty table gives an empty result; a long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm import classgrams as cg
from leafmark.llm.common import documents, mapped, mix, owner, range_hashes, slices, sums, word_bounds, written

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Robust standard deviations of log perplexity around a language's median that are kept, and the least half width.
BAND, LEAST_HALF_WIDTH = 6.0, 0.05
#: Bins of a unit of log10 perplexity from which medians are taken, exactly and alike on every run.
BINS = 2000

_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&|<>"]] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands in keys twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(keys), bool)
    found[order] = same[1:] | same[:-1]
    return found


def base_features(part) -> list[np.ndarray]:
    """BASE for each document of a slice."""
    starts, ends, first = word_bounds(part)
    words = np.diff(first)
    head = np.zeros(len(part.data), np.int64)
    head[(part.data & 0xC0) != 0x80] = 1
    so_far = np.concatenate([[0], np.cumsum(head)])
    chars = sums(so_far[ends] - so_far[starts], first)
    symbols = sums(_MARK[part.data].astype(np.int64), part.first)

    # lines: the first byte of a text and each byte after a line feed begin one
    breaks = np.flatnonzero(part.data == 10)
    line_starts = np.unique(np.concatenate([part.first[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(part.data)]
    line_ends = np.append(line_starts[1:], len(part.data))
    doc = np.searchsorted(part.first, line_starts, "right") - 1
    cut = (line_ends > line_starts) & (part.data[line_ends - 1] == 10) if len(line_starts) else np.zeros(0, bool)
    line_ends = line_ends - cut
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    doc, line_starts, line_ends = doc[full], line_starts[full], line_ends[full]
    lines = np.bincount(doc, minlength=part.n)
    keys = np.unique(np.stack([doc.astype(np.uint64), range_hashes(part.data, line_starts, line_ends)]), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
    duplicates = lines - np.bincount(keys[0].astype(np.int64), minlength=part.n)

    # windows of eight words: those met twice cover their words
    word = range_hashes(part.data, starts, ends)
    of = owner(first)
    room = np.arange(len(word)) + WINDOW <= first[1:][of] if len(word) else np.zeros(0, bool)
    at = np.flatnonzero(room)
    if len(at):
        windows = range_hashes(word, at, at + WINDOW)
        twice = at[_repeated(mix(windows + mix(of[at].astype(np.uint64))))]
        cover = np.zeros(len(word) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        repeats = sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), first)
    else:
        repeats = np.zeros(part.n, np.int64)
    return [words, chars, symbols, duplicates, repeats]


def base_failed(features: list[np.ndarray]) -> np.ndarray:
    words, repeats = features[0], features[4]
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def _symbols(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in slices(batch.column(0)):
        yield cg.doc_symbols(part)


def four_gram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): the four-grams of all documents, whether they pass the base rules or not."""
    parts = mapped(docs.select(F.col(text).alias("text")), cg.count_batches(_symbols), "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolated modified Kneser-Ney: (order, code, log_p) of n-grams and (order, code, log_gamma) of contexts.

    counts are those of the highest order; lower orders count distinct continuations to the left. Discounts come
    from the counts of counts of each order, with 0.5, 1 and 1.5 where a corpus is too small to give them.
    """
    a = cg.SYMBOLS
    levels = {cg.ORDER: counts.select("code", "n")}
    for order in range(cg.ORDER - 1, 0, -1):
        levels[order] = levels[order + 1].groupBy((F.col("code") % a**order).alias("code")).agg(F.count("*").alias("n"))
    few = None
    for order, level in levels.items():
        one = level.filter("n <= 4").select(F.lit(order).alias("order"), "n")
        few = one if few is None else few.unionAll(one)
    of = {(r["order"], r["n"]): r["m"] for r in few.groupBy("order", "n").agg(F.count("*").alias("m")).collect()}
    grams = contexts = lower = None
    for order in range(1, cg.ORDER + 1):
        n1, n2, n3, n4 = (of.get((order, k), 0) for k in (1, 2, 3, 4))
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            d = [max(0.05, min(k, k - (k + 1) * y * b / a_)) for k, a_, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        else:
            d = [0.5, 1.0, 1.5]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        level = levels[order].withColumn("context", F.floor(F.col("code") / a)).withColumn("off", off)
        whole = level.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("gamma"))
        level = level.join(whole, "context").withColumn("own", (F.col("n") - F.col("off")) / F.col("total"))
        if lower is None:
            level = level.select("code", (F.col("own") + F.col("gamma") / a).alias("p"))
        else:
            back = lower.select(F.col("code").alias("suffix"), F.col("p").alias("p_lower"))
            level = level.withColumn("suffix", F.col("code") % a ** (order - 1)).join(back, "suffix").select("code", (F.col("own") + F.col("gamma") * F.col("p_lower")).alias("p"))
        lower = level
        g = level.select(F.lit(order).alias("order"), "code", F.log10("p").alias("log_p"))
        c = whole.select(F.lit(order - 1).alias("order"), F.col("context").alias("code"), F.log10("gamma").alias("log_gamma"))
        grams, contexts = (g, c) if grams is None else (grams.unionAll(g), contexts.unionAll(c))
    return grams, contexts


class HashArrays:
    """A table of n-grams: sorted 64-bit hashes beside their values."""

    def __init__(self, order: np.ndarray, code: np.ndarray, value: np.ndarray):
        keys = np.empty(len(code), np.uint64)
        for k in np.unique(order):
            keys[order == k] = cg.key(int(k), code[order == k])
        by = np.argsort(keys)
        self.keys, self.values = keys[by], value[by].astype(np.float32)

    def get(self, order: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether each is there."""
        if not len(self.keys):
            return np.zeros(len(code), np.float32), np.zeros(len(code), bool)
        wanted = cg.key(order, code)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.values[at], self.keys[at] == wanted


def look_up(grams: HashArrays, contexts: HashArrays, code: np.ndarray) -> np.ndarray:
    """log10 probability of each four-gram's last symbol after its first three."""
    result, weight, open_ = np.zeros(len(code)), np.zeros(len(code)), np.ones(len(code), bool)
    for order in range(cg.ORDER, 0, -1):
        if not open_.any():
            break
        part = code % cg.SYMBOLS**order
        value, there = grams.get(order, part)
        hit = open_ & there
        result[hit] = weight[hit] + value[hit]
        open_ &= ~there
        gamma, known = contexts.get(order - 1, part // cg.SYMBOLS)
        weight += np.where(open_ & known, gamma, 0)
    result[open_] = weight[open_] - np.log10(cg.SYMBOLS)
    return result


def _arrays(table: DataFrame, value: str) -> HashArrays:
    """To the driver: the n-grams that occur, 13 bytes each; their number grows far slower than the corpus (README)."""
    got = table.select(F.col("order").cast("byte"), "code", F.col(value).cast("float")).toArrow()
    return HashArrays(*(got.column(i).to_numpy() for i in range(3)))


def score_documents(docs: DataFrame, grams: HashArrays, contexts: HashArrays, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, BASE, base_failed and log_ppl (log10, null without words) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast((grams, contexts))
    schema = f"doc_id {id_type}, lang string, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, log_ppl double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = cg.Scores(lambda code: look_up(*model.value, code))
        for batch in batches:
            for part in slices(batch.column(2)):
                features = base_features(part)
                codes, first = cg.four_grams(*cg.doc_symbols(part))
                log_ppl = -sums(scores.of(codes).astype(np.float64), first) / np.diff(first)
                rows = [batch.column(i).slice(part.at, part.n) for i in (0, 1)]
                values = [pa.array(x.astype(np.int64)) for x in features]
                yield pa.RecordBatch.from_arrays([*rows, *values, pa.array(base_failed(features)), pa.array(log_ppl, mask=features[0] == 0)], names=["doc_id", "lang", *BASE, "base_failed", "log_ppl"])

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text")), run, schema)


def _median(bins: DataFrame) -> DataFrame:
    """(lang, bin): the lower median of binned values given as (lang, bin, n)."""
    w = Window.partitionBy("lang")
    run = bins.select("lang", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    return run.filter(F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg(F.min("bin").alias("bin"))


def bands(scored: DataFrame, width: float = BAND) -> DataFrame:
    """(lang, lower, upper) of log_ppl: median and scaled median deviation of the documents that pass the base rules."""
    hist = scored.filter("not base_failed and log_ppl is not null").groupBy("lang", F.floor(F.col("log_ppl") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    middle = _median(hist)
    off = hist.join(middle.withColumnRenamed("bin", "middle"), "lang").select("lang", F.abs(F.col("bin") - F.col("middle")).alias("bin"), "n")
    spread = _median(off.groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    half = F.greatest(F.lit(LEAST_HALF_WIDTH), width * 1.4826 * F.col("off") / BINS)
    return middle.join(spread.select("lang", F.col("bin").alias("off")), "lang").select("lang", (F.col("bin") / BINS - half).alias("lower"), ((F.col("bin") + 1) / BINS + half).alias("upper"))


def perplexity_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", width: float = BAND) -> DataFrame:
    """BASE, base_failed, log_ppl, the language's band and kept for every document."""
    counts = written(four_gram_counts(docs, text), "four-grams")
    grams, contexts = kneser_ney(counts)
    scored = written(score_documents(docs, _arrays(grams, "log_p"), _arrays(contexts, "log_gamma"), id_col, text, lang), "perplexity")
    limits = written(bands(scored, width), "bands")
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return scored.join(limits, "lang", "left").withColumn("kept", kept)


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_rules(documents(spark, sf_dir)).select("doc_id", *BASE, "base_failed", "kept", F.col("log_ppl").alias("log10_perplexity"))
