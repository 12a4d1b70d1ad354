"""What several of the operators share: tables in the shared folder, and text as numpy arrays inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share; a temporary folder only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="leafmark-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with over one in HEAVY rows is brought to its rows by a broadcast, which so has HEAVY rows at most.
HEAVY = 4096


def lookup_join(rows: DataFrame, table: DataFrame, key: str, n: str, values: list[str]) -> DataFrame:
    """rows left-joined by key, a number, with the values of table, which has each key once and in n how many rows hold it.

    Keys with over one in HEAVY of all rows are looked up in a broadcast of at most HEAVY rows, and these rows are then dealt at
    random; so no key of the shuffled join has more than that share. Rows without a match have null values."""
    whole = table.agg(F.sum(n).alias("n")).first()["n"] or 0
    found = F.struct(*values)
    heavy = table.filter(F.col(n) * HEAVY > whole).select(F.col(key).alias("_heavy"), found.alias("_at_once"))
    light = table.filter(F.col(n) * HEAVY <= whole).select(F.col(key).alias("_light"), found.alias("_shuffled"))
    first = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    dealt = F.when(F.col("_heavy").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
    both = first.withColumn("_dealt", dealt).join(light, F.col("_dealt") == F.col("_light"), "left")
    held = F.when(F.col("_heavy").isNull(), F.col("_shuffled")).otherwise(F.col("_at_once"))
    return both.withColumn("_held", held).select(*rows.columns, *(F.col("_held")[v].alias(v) for v in values))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_leafmark_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="leafmark-")) / "leafmark_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._leafmark_sent = True


def written_n(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """written(df), and how many rows it has, counted by the same job."""
    seen = Observation()
    return written(df.observe(seen, F.count(F.lit(1)).alias("n")), tag), seen.get["n"]


def give_back() -> None:
    """Hands memory that this process has freed back to the system; Spark keeps a worker that has ended its task beside the next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with this package at hand in the workers, which give memory back after each batch."""
    ship(df.sparkSession)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(iter([batch]))
            del batch
            give_back()

    return df.mapInArrow(one_by_one, schema)


def in_fold(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds == fold, F.lit(False))


class Slice:
    """Some whole documents of a batch: rows [at, to), their UTF-8 bytes and each one's first byte."""

    def __init__(self, at: int, to: int, data: np.ndarray, first: np.ndarray):
        self.at, self.to, self.data, self.first = at, to, data, first
        self.n = to - at


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Null texts are empty ones."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "").cast(pa.large_string())
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(text))
        yield Slice(at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n of the base or of its inverse, modulo 2**64."""
    name = "inverse" if inverse else "base"
    if len(_powers.get(name, ())) <= n:
        steps = np.full(max(n, SLICE_BYTES // 2) + 1, _P_INV if inverse else _P, np.uint64)
        steps[0] = 1
        if len(steps) > 4 * SLICE_BYTES:  # of a very long document: not kept
            return np.cumprod(steps)
        _powers[name] = np.cumprod(steps)
    return _powers[name][: n + 1]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal ranges hash alike wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(n, False)[:n], out=total[1:])
    found = (total[ends] - total[starts]) * _power(n, True)[starts]
    return mix(found ^ mix((ends - starts).astype(np.uint64)))


def word_bounds(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of a slice, and words before each document."""
    n = len(part.data)
    space = _SPACE[part.data]
    edge = np.zeros(n + 1, bool)
    edge[part.first] = True
    before = np.ones(n + 1, bool)
    before[1:] = space
    before |= edge
    begins = np.flatnonzero(~space & before[:n])
    after = np.ones(n, bool)
    after[:-1] = space[1:] | edge[1:n]
    ends = np.flatnonzero(~space & after) + 1
    return begins, ends, np.searchsorted(begins, part.first)


def owner(first: np.ndarray) -> np.ndarray:
    """For bounds of consecutive groups, each member's group."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups, 0 for empty ones; a group's sum doesn't depend on the others."""
    out = np.zeros(len(first) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.add.reduceat(values[first[0] : first[-1]], first[:-1][some] - first[0], dtype=out.dtype)
    return out
