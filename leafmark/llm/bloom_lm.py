"""Language-model scores from log-frequency Bloom filters of word pairs.

A pair's training count c is quantised to the number q of powers of b (rounded up, each number once) that are c at most, and
a filter holds its q events (pair, 1) to (pair, q); probing j = 1, 2, ... until an event is missing gives q back, never too
small, and too large by one with the filter's error rate (2.2 % at 8 bits and 5 hash functions an event). q is read as the least
count of its level. A token's probability after the one before it is a share of the pair's read-back count over the first
token's exact count, and the rest of the token's own smoothed share; of the shares in PAIRS that one is taken with which the training texts are
likeliest when each of their tokens is left out of the counts that speak for it. Without the filter's errors the read-back counts of pairs with
one first token add up to its count at most, so probabilities after a token add up to 1 at most; a pair is never read as more often than
either of its tokens, which bounds what an error adds. A text's score is the sum of its tokens' log10 probabilities.

One filter of all pairs would grow with the corpus, past any broadcast, and pruning it would make the model depend on
the corpus size. So lookup.py brings to each block of texts the filters of the pairs that the block asks for, built from counts over
the whole corpus where these are added up; exact token counts, which the base score needs, come the same way.

Cases: null and empty texts are the end token alone; equal texts get equal base scores, and scores that differ by the errors of the
filters of their blocks only; a null id is in no held-out fold; rows with one id are scored one by one; texts may be of any length;
other columns are ignored; an empty table gives an empty result; without training tokens all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import Slice, documents, in_fold, mapped, mix, owner, range_hashes, slices, sums, word_bounds, written
from leafmark.llm.lookup import bucket_number, bucket_of, counted_blocks, get, low_bits

FOLDS, FOLD = 5, 1
#: Base of the quantisation, bits and hash functions of an event.
LOG_BASE, BITS, HASHES = 1.25, 8, 5
#: Least counts of the levels: those of 1 to 6 are exact.
LEVELS = np.unique(np.ceil(LOG_BASE ** np.arange(190) - 1e-9).astype(np.int64))
#: Bytes of a pair's hash besides its bucket, which holds some millions of pairs at any corpus size; and text of a block.
WIDTH, BLOCK = 5, 12 << 20
#: Shares of a pair's own frequency in a probability, of which the best for the training texts is taken.
PAIRS = (0.05, 0.1, 0.2, 0.3, 0.45, 0.6)
_END = np.uint64(0x0E0D)  # hash of the end token, which also stands before a text
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_hashes(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and its end, and tokens before each text."""
    starts, ends, first = word_bounds(part)
    texts = np.arange(part.n + 1)
    out = np.full(len(starts) + part.n, _END, np.uint64)
    out[np.arange(len(starts)) + owner(first)] = range_hashes(_LOWER[part.data], starts, ends)
    return out, first + texts


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hashes of each token after the one before; a text's first follows the end token of the text before or none."""
    before = np.concatenate([[_END], tokens[:-1]]) if len(tokens) else tokens
    return mix(mix(before) + tokens * np.uint64(3))


class LogBloom:
    """A log-frequency Bloom filter of hashed entries with counts."""

    def __init__(self, words: np.ndarray, most: int):
        self.words, self.most = words, most  # 64-bit words, and the highest level

    @staticmethod
    def level(count: np.ndarray) -> np.ndarray:
        return np.searchsorted(LEVELS, np.maximum(count, 1), "right").astype(np.int64)

    @staticmethod
    def places(entry: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
        """Bit positions of events, HASHES to a row."""
        a = mix(entry + mix(level.astype(np.uint64) + np.uint64(1)))
        b = mix(a ^ np.uint64(0x5BF0363546516AD5)) | np.uint64(1)
        return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)

    @classmethod
    def of(cls, entry: np.ndarray, count: np.ndarray) -> LogBloom:
        level = cls.level(count)
        bits = 64 * (1 + int(level.sum()) * BITS // 64)
        held = np.zeros(bits, bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            some = entry[level >= j]
            held[cls.places(some, np.full(len(some), j), bits).ravel().astype(np.int64)] = True
        return cls(np.packbits(held, bitorder="little").view(np.uint64), int(level.max(initial=0)))

    def levels(self, entry: np.ndarray) -> np.ndarray:
        """Each entry's level, 0 if absent: probes rise until one fails."""
        level, alive = np.zeros(len(entry), np.int64), np.arange(len(entry))
        for j in range(1, self.most + 1):
            place = self.places(entry[alive], np.full(len(alive), j), len(self.words) * 64)
            held = ((self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).all(axis=1)
            alive = alive[held]
            if not len(alive):
                break
            level[alive] = j
        return level


def least(level: np.ndarray) -> np.ndarray:
    """The least of a level's counts, 0 for level 0."""
    return np.where(level > 0, LEVELS[np.maximum(level, 1) - 1], 0)


def pack(entry: np.ndarray, count: np.ndarray) -> bytes:
    """The filter of the entries with positive counts, after its highest level."""
    f = LogBloom.of(entry[count > 0], count[count > 0])
    return np.array([f.most], np.uint64).tobytes() + f.words.tobytes()


def pair_counts(packed: list[tuple[int, bytes]], pairs: np.ndarray, buckets: int) -> np.ndarray:
    """Quantised counts of pairs from a block's filters, one for each bucket."""
    level = np.zeros(len(pairs), np.int64)
    bucket = bucket_of(pairs, buckets)
    by = np.argsort(bucket, kind="stable")
    ordered = bucket[by]
    for b, raw in packed:
        words = np.frombuffer(raw, np.uint64)
        mine = by[np.searchsorted(ordered, b) : np.searchsorted(ordered, b, "right")]
        level[mine] = LogBloom(words[1:], int(words[0])).levels(low_bits(pairs[mine], WIDTH))
    return least(level)


def frequencies(count: np.ndarray, before: np.ndarray, both: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens their own smoothed share of all, and how often they follow the tokens before them, by the pairs' read-back counts."""
    return (count + 0.5) / whole, np.minimum(both, np.minimum(count, before)) / np.maximum(before, 1)


def probabilities(count: np.ndarray, before: np.ndarray, both: np.ndarray, whole: float, share: float) -> np.ndarray:
    """Of tokens with their counts, those of the tokens before them, and the pairs' read-back counts."""
    own, after = frequencies(count, before, both, whole)
    return own + share * (after - own)


def without_one(count: np.ndarray, before: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of tokens of the training texts as the other tokens have them: each left out once, so that a text doesn't speak for itself."""
    return tuple(np.maximum(x - 1, 0) for x in (count, before, np.minimum(both, np.minimum(count, before))))


def vocabulary(rows: DataFrame) -> int:
    """Distinct tokens of the rows that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(token_hashes(part)[0]).view(np.int64))], names=["token"])

    return mapped(rows.filter(~F.col("held_out")).select("text"), run, "token long").distinct().count()


def score(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, id_col: str = "doc_id", text: str = "text", shares: tuple[float, ...] = PAIRS) -> DataFrame:
    """The rows of op7 for every document; those of the fold are held out from both models."""
    rows = docs.select(F.col(id_col).alias("doc_id"), in_fold(id_col, folds, fold).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tokens = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
    r = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.when(~F.col("held_out"), tokens)).alias("train")).first()
    size, train = r["bytes"] or 0, r["train"] or 0
    v = vocabulary(rows)
    whole, buckets = train + 0.5 * (v + 1), bucket_number(size)

    names, fits = [f"score_{k}" for k in range(len(shares))], [f"fit_{k}" for k in range(len(shares))]

    def items(part: Slice, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, first = token_hashes(part)
        return h, (~table.column("held_out").to_numpy())[owner(first)].astype(np.int64)

    def pairs(part: Slice, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, w = items(part, table)
        return pair_hashes(h), w

    def finish(texts: pa.Table, hashes: np.ndarray, counts: np.ndarray, packed: list) -> pa.Table:
        out = {k: [] for k in ("n_tokens", "n_known", "log_sum", *names, *fits)}
        trained = ~texts.column("held_out").to_numpy()
        for part in slices(texts.column("text")):
            h, first = token_hashes(part)
            c = get(hashes, counts, h)
            end = get(hashes, counts, np.array([_END]))
            before = np.concatenate([end, c[:-1]])
            both = pair_counts(packed, pair_hashes(h), buckets)
            own, after = frequencies(c, before, both, whole)
            after -= own
            # only training texts say which share is best
            known = trained[part.at : part.to]
            rows = known[owner(first)]
            left, left_after = frequencies(*(x[rows] for x in without_one(c, before, both)), whole)
            left_after -= left
            ends = np.concatenate([[0], np.cumsum(np.diff(first) * known)])
            out["n_tokens"].append(np.diff(first))
            out["n_known"].append(sums((c > 0).astype(np.int64), first))
            out["log_sum"].append(sums(np.log10(c + 0.5), first))
            for share, name, fit in zip(shares, names, fits, strict=True):
                out[name].append(sums(np.log10(own + share * after), first))
                out[fit].append(sums(np.log10(left + share * left_after), ends))
        types = {k: pa.int64() if k.startswith("n_") else pa.float64() for k in out}
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), **{k: pa.array(np.concatenate([[], *x]), types[k]) for k, x in out.items()}})

    columns = ", ".join(f"{c} double" for c in ("log_sum", *names, *fits))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, {columns}"
    found = written(counted_blocks(rows.withColumn("block_key", F.struct("doc_id", F.xxhash64("text"))), items, finish, schema, size, pairs=pairs, pack=pack, width=WIDTH, block_bytes=BLOCK), "lm-scores")
    base = F.col("log_sum") - F.col("n_tokens") * float(np.log10(whole))
    fitted = found.agg(*(F.sum(c).alias(c) for c in fits)).first()
    best = max(range(len(shares)), key=lambda k: fitted[fits[k]] or 0.0)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), F.col(names[best]).alias("score"))


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
