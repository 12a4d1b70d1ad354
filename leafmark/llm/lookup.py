"""Corpus counts of hashed items (words, shingles) brought back to the texts that hold them, without a broadcast.

Documents fall into blocks by a hash of their id, so a block is about BLOCK_BYTES of text at any corpus size. Each block
sends its distinct item hashes, with how much each counts, to the bucket of their highest bits; a bucket adds up and
answers each block with one number for each hash that it sent; a block meets its answers again with its texts. Texts
move once, by block (both uses read the same exchange); a block's hashes move once there and once back.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import Slice, give_back, ship, slices

BLOCK_BYTES = 4 << 20
#: Text for each bucket: what it gathers must fit a task.
BUCKET_BYTES = 128 << 20


def counted_blocks(
    docs: DataFrame,
    items: Callable[[Slice, pa.Table], tuple[np.ndarray, np.ndarray]],
    finish: Callable[[pa.Table, np.ndarray, np.ndarray, list], pa.Table],
    schema: str,
    text_bytes: int,
    pairs: Callable[[Slice, pa.Table], tuple[np.ndarray, np.ndarray]] | None = None,
    pack: Callable[[np.ndarray, np.ndarray], bytes] | None = None,
    prepare: Callable[[pa.Table], pa.Table] = lambda table: table,
    width: int = 5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """finish(texts of a block, item hashes, counts, packed) for each block, as rows of schema.

    docs has columns block_key (any hashable identity) and text besides those that items and finish read. items(slice,
    rows of the slice) gives item hashes (repeats allowed) and how much each counts. A bucket answers with counts alone, in the order
    of the hashes; the block finds these again from its texts.

    pairs gives a second, larger family of hashes in the same way. These travel with `width` bytes besides their bucket, and
    their answer is pack(hashes, counts) of a block's hashes in one bucket; finish gets them as a fourth argument, a list of
    (bucket, packed), and finds a hash's bucket by bucket_of. prepare picks the rows of a block that count."""
    blocks = max(8, math.ceil(text_bytes / block_bytes))
    buckets = bucket_number(text_bytes)
    ship(docs.sparkSession)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("block_key"), F.lit(blocks))).drop("block_key").repartition("block")

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        give_back()  # what the group before left
        table = prepare(table)
        families = [items] if pairs is None else [items, pairs]
        found = []
        for family in families:
            hashes, weights = [], []
            for part in slices(table.column("text")):
                h, w = family(part, table.slice(part.at, part.n))
                some, w = _summed(h, w)
                hashes.append(some)
                weights.append(w)
            h, w = _summed(np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(weights or [np.zeros(0, np.int64)]))
            found.append((h, w.astype(np.int32), np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))))
        # only buckets that the block holds items of: never more rows than items, however many blocks and buckets there are
        full = np.unique(np.concatenate([bucket_of(h, buckets) for h, _, _ in found]))
        columns = {"bucket": pa.array(full, pa.int64()), "block": pa.array([key[0].as_py()] * len(full), pa.int64())}
        for name, (h, w, cuts) in zip(("hash", "pair"), found):
            low = h if name == "hash" else np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :width]
            ends = list(zip(cuts[full].tolist(), cuts[full + 1].tolist(), strict=True))
            columns["hashes" if name == "hash" else "pairs"] = pa.array([low[a:b].tobytes() for a, b in ends], pa.binary())
            columns["weights" if name == "hash" else "pair_weights"] = pa.array([w[a:b].tobytes() for a, b in ends], pa.binary())
        return pa.table(columns)

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        give_back()
        counts = _totals([np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")], table.column("weights"))
        packed = [b""] * len(counts)
        if pairs is not None:
            asked_pairs = [_wide(x.as_py(), width) for x in table.column("pairs")]
            packed = [pack(h, m) for h, m in zip(asked_pairs, _totals(asked_pairs, table.column("pair_weights")), strict=True)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "counts": pa.array([_small(m) for m in counts], pa.binary()), "packed": pa.array(packed, pa.binary())})

    def meet(texts: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        rows = prepare(texts.drop_columns(["block"]))
        mine = [np.unique(items(part, rows.slice(part.at, part.n))[0]) for part in slices(rows.column("text"))] if rows.num_rows else []
        hashes = np.unique(np.concatenate(mine or [np.zeros(0, np.uint64)]))
        answers = answers.sort_by("bucket")
        counts = np.concatenate([_large(x.as_py()) for x in answers.column("counts")] or [np.zeros(0, np.int64)])
        packed = [] if pairs is None else [(b.as_py(), p.as_py()) for b, p in zip(answers.column("bucket"), answers.column("packed"), strict=True)]
        return finish(rows, hashes, counts, packed)

    more = "" if pairs is None else ", pairs binary, pair_weights binary"
    asked = dealt.groupBy("block").applyInArrow(gather, f"bucket long, block long, hashes binary, weights binary{more}")
    answers = asked.groupBy("bucket").applyInArrow(add_up, "block long, bucket long, counts binary, packed binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)


def bucket_number(text_bytes: int) -> int:
    return max(24, math.ceil(text_bytes / BUCKET_BYTES))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the highest bits, so that sorted hashes have sorted buckets."""
    return (hashes >> np.uint64(32)).astype(np.int64) * buckets >> 32


def low_bits(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """What a hash of the second family keeps besides its bucket."""
    return hashes & np.uint64((1 << 8 * width) - 1)


def _wide(raw: bytes, width: int) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :width] = low
    return out.view(np.uint64).ravel()


def _summed(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their weights."""
    by = np.argsort(hashes)
    h = hashes[by]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(weights[by].astype(np.int64), first) if len(h) else np.zeros(0, np.int64)


def _totals(asked: list[np.ndarray], weights: pa.ChunkedArray) -> list[np.ndarray]:
    """For each block's hashes their sums over all blocks."""
    w = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in weights] or [np.zeros(0, np.int32)])
    some, at = np.unique(np.concatenate(asked or [np.zeros(0, np.uint64)]), return_inverse=True)
    total = np.bincount(at, weights=w, minlength=len(some)).astype(np.int64)
    ends = np.cumsum([len(x) for x in asked])
    return [total[at[end - len(of) : end]] for of, end in zip(asked, ends, strict=True)]


def _small(counts: np.ndarray) -> bytes:
    """Counts as 32-bit numbers where they fit, after a byte that says so."""
    fits = int(counts.max(initial=0) < 1 << 32)
    return bytes([fits]) + counts.astype(np.uint32 if fits else np.int64).tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if raw[0] else np.int64, offset=1).astype(np.int64)


def get(hashes: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of wanted hashes, 0 for those without an answer; hashes are sorted."""
    if not len(hashes):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, counts[at], 0)
