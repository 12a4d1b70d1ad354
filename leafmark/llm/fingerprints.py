"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its runs of SHINGLE consecutive words (one of all words where it has fewer), weighted by how often each
occurs. For each of SAMPLES samples a term draws r and c from Gamma(2, 1) and b from [0, 1), by hash of term and sample alone; with
weight w it has t = floor(ln w / r + b) and y = exp(r (t - b)), and the term of least c / (y e^r) is taken with its t. Two texts take the
same (term, t) with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima. A fingerprint keeps
BITS bits of each sample, so unlike samples agree once in 2**BITS.

Edited texts take part of the next text in the order of ids. Texts move once, to ranges of ids; only the first row of each range goes to
the range before it, over a table of one row for each range.

Cases: null and empty texts, and texts without words, have no terms and one fingerprint, like each other and unlike all others; equal texts
have equal fingerprints; a null id comes first; rows of equal ids are ordered by a hash of their text, and equal rows are interchangeable;
a single row is followed by itself; an empty table gives an empty result; texts may be of any length: terms are gone through in blocks;
other columns are ignored. Logarithms may differ in their last bit between kinds of processors, so workers of one kind are taken for granted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import documents, give_back, mix, range_hashes, ship, slices, word_bounds, written

SHINGLE, SAMPLES, BITS = 3, 128, 16
#: Terms times samples drawn at a time: about what a processor's cache holds.
CELLS = 1 << 15
#: Terms of a text up to which it shares a table with others.
LONG = 1 << 14
#: Texts that a task works on at a time, in code points, and the text for each range of ids.
BATCH_CHARS, RANGE_BYTES = 1 << 18, 32 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SCALE = np.float32(2.0**-32)


def terms(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct terms in order, how often each occurs, and terms before each text."""
    keys, weights, sizes = [], [], []
    for part in slices(pa.array(texts, pa.large_string())):
        starts, ends, first = word_bounds(part)
        words = np.diff(first)
        word = range_hashes(part.data, starts, ends)
        n = np.where(words >= shingle, words - shingle + 1, (words > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(n)])
        begin = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(first[:-1], n)
        h = range_hashes(word, begin, np.minimum(begin + shingle, np.repeat(first[1:], n)))
        doc = np.repeat(np.arange(part.n), n)
        by = np.lexsort((h, doc))
        h, doc = h[by], doc[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        begins = np.flatnonzero(new)
        keys.append(h[begins])
        weights.append(np.diff(np.append(begins, len(h))))
        sizes.append(np.bincount(doc[begins], minlength=part.n))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(keys), np.concatenate(weights), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def drawn(keys: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """For each term and sample one number: above, in the order of ln(c / (y e^r)), and below BITS bits that stand for (term, t)."""
    seed = mix((np.arange(samples, dtype=np.uint64) + np.uint64(1)) * _STEP)
    x = mix(keys[:, None] ^ seed[None, :])
    # four uniform numbers of 16 bits: a Gamma(2, 1) number is minus the logarithm of a product of two
    u = x.view("<u2").reshape(*x.shape, 4).astype(np.float32)
    u += np.float32(0.5)
    u[..., 0] *= u[..., 1]
    u[..., 2] *= u[..., 3]
    less_r, ln_c = np.log(u[..., 0] * _SCALE), np.log(-np.log(u[..., 2] * _SCALE))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    b = (x >> np.uint64(40)).astype(np.float32)
    b *= np.float32(2.0**-24)
    x >>= np.uint64(8)
    if (weights != 1).any():  # with weight 1, t is 0
        t = np.floor(b - np.log(weights.astype(np.float32))[:, None] / less_r)
        b -= t
        x ^= t.astype(np.int64).view(np.uint64) * _STEP >> np.uint64(32)
    b -= np.float32(1)
    b *= less_r
    ln_c -= b
    bits = ln_c.view(np.uint32)
    # numbers of one sign have the order of their bits; negative ones the opposite
    bits ^= (bits.view(np.int32) >> np.int32(31)).view(np.uint32) | np.uint32(1 << 31)
    x &= np.uint64((1 << BITS) - 1)
    x |= bits.astype(np.uint64) << np.uint64(32)
    return x


def _least(keys: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """The least number of each sample over all terms, a block at a time."""
    step = max(1, CELLS // samples)
    out = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(keys), step):
        np.minimum(out, drawn(keys[k : k + step], weights[k : k + step], samples).min(0), out=out)
    return out


def signatures(keys: np.ndarray, weights: np.ndarray, at: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """A row of samples for each text, zeros for one without terms.

    What texts of up to LONG terms share is drawn once; a longer text is gone through by itself."""
    out = np.zeros((len(at) - 1, samples), np.uint64)
    sizes = np.diff(at)
    short = np.repeat(sizes <= LONG, sizes)
    place = np.concatenate([[0], np.cumsum(np.where(sizes <= LONG, sizes, 0))])
    # weight 1, by far the most frequent, comes first
    by = np.lexsort((keys[short], weights[short]))
    k, w = keys[short][by], weights[short][by]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    inverse = np.empty(len(k), np.int64)
    inverse[by] = np.cumsum(new) - 1
    k, w = k[new], w[new]
    step = max(1, CELLS // samples)
    table = np.empty((len(k), samples), np.uint64)
    ones = int(np.searchsorted(w, 1, "right"))
    for at_, to in [*((i, min(i + step, ones)) for i in range(0, ones, step)), *((i, i + step) for i in range(ones, len(k), step))]:
        table[at_:to] = drawn(k[at_:to], w[at_:to], samples)
    for k in np.flatnonzero(sizes):
        if sizes[k] > LONG:
            out[k] = _least(keys[at[k] : at[k + 1]], weights[at[k] : at[k + 1]], samples)
        else:
            out[k] = table[inverse[place[k] : place[k + 1]]].min(0)
    return (out & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the next, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Shares of equal samples, row by row; a text without terms is like another such text only."""
    return np.where(some_a & some_b, (a == b).mean(1), (some_a == some_b).astype(np.float64))


VALUES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
#: As stored between the steps: an edited text's fingerprint is kept by how it differs from the text's own.
_SCHEMA = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = ["doc_id", *VALUES, "range", "first", "open"]


def difference(own: np.ndarray, other: np.ndarray) -> bytes:
    """A bit for each sample that differs, and the other's samples there."""
    apart = own != other
    return np.packbits(apart).tobytes() + other[apart].tobytes()


def restored(own: np.ndarray, stored: bytes) -> np.ndarray:
    bits = -(-len(own) // 8)
    apart = np.unpackbits(np.frombuffer(stored, np.uint8, bits), count=len(own)).astype(bool)
    out = own.copy()
    out[apart] = np.frombuffer(stored, own.dtype, offset=bits)
    return out


def _compared(texts: list[str], shingle: int, samples: int) -> dict[str, pa.Array]:
    """The values of all texts but the last, each compared with the one after it."""
    n = len(texts) - 1
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    keys, weights, at = terms(texts + changed, shingle)
    signs, some = signatures(keys, weights, at, samples), np.diff(at) > 0
    own, other, mine, its = signs[:n], signs[n + 1 :], some[:n], some[n + 1 :]
    stored = [pa.array([x.tobytes() for x in own.astype(">u2")], pa.binary()), pa.array([difference(a, b) for a, b in zip(own.astype(">u2"), other.astype(">u2"), strict=True)], pa.binary())]
    near = [pa.array(likeness(own, b, mine, c)) for b, c in ((other, its), (signs[1 : n + 1], some[1 : n + 1]))]
    found = [pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()), *stored, *near]
    return dict(zip(VALUES, found, strict=True))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # equal rows are told apart by where they were read, so that many of them may be split
    keys = ["doc_id", "hash", "row"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(max(8, -(-size // RANGE_BYTES)), *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def open_row(ids: pa.Array, text: str, first: bool) -> pa.RecordBatch:
        """The first or last row of a range, with its text, since its other side is in another range."""
        blank = [pa.nulls(1, t) for t in _TYPES]
        return pa.RecordBatch.from_arrays([ids, *blank, pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([text], pa.string())], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        ids: list[pa.Array] = []
        chars, begun = 0, False

        def close() -> pa.RecordBatch:
            """Rows of all texts at hand but the last, which stays."""
            n = len(texts) - 1
            found = _compared(texts, shingle, samples)
            done = pa.concat_arrays(ids)
            texts[:], ids[:] = texts[-1:], [done.slice(n)]
            return pa.RecordBatch.from_arrays([done.slice(0, n), *found.values(), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], names=_NAMES)

        for batch in batches:
            for k in range(batch.num_rows):
                texts.append(batch.column(1)[k].as_py())
                ids.append(batch.column(0).slice(k, 1))
                chars += len(texts[-1])
                if not begun:
                    begun = True
                    yield open_row(ids[0], texts[0], True)
                if chars > BATCH_CHARS and len(texts) > 1:
                    yield close()
                    chars = len(texts[0])
            del batch
            give_back()
        if len(texts) > 1:
            yield close()
        if texts:
            yield open_row(ids[-1], texts[-1], False)

    found = written(rows.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}, range int, first boolean, open string"), "fingerprints")
    heads = found.filter("first").select("range", F.col("open").alias("following"))
    # one row for each range, without texts
    order = Window.orderBy("range")
    after = heads.select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(order)).alias("next"))
    lasts = found.filter("not first").select("doc_id", "range", "open").join(after, "range").join(heads.withColumnRenamed("range", "next"), "next").select("doc_id", "open", "following")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = _compared([batch.column(1)[k].as_py(), batch.column(2)[k].as_py()], shingle, samples)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *one.values()], names=["doc_id", *VALUES])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            other = [restored(np.frombuffer(a.as_py(), ">u2"), b.as_py()).tobytes() for a, b in zip(own, batch.column(3), strict=True)]
            yield batch.set_column(3, "edited_fingerprint", pa.array(other, pa.binary()))

    rows = found.filter("range is null").select("doc_id", *VALUES).unionByName(lasts.mapInArrow(pairs, f"doc_id {kind}, {_SCHEMA}"))
    rows = rows.select(*VALUES, "doc_id").mapInArrow(whole, f"{_SCHEMA}, doc_id {kind}")
    return rows.select("doc_id", *(F.lower(F.hex(c)).alias(c) if c in ("edited_sha256", "fingerprint", "edited_fingerprint") else F.col(c) for c in VALUES))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
