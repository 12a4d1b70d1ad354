"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

From a bounded sample of labelled rows (SAMPLE of each class, the first by hash of the id) two dictionaries are
trained. A text is cut into pieces of PIECE bytes, each compressed with either dictionary; the difference of the
compressed sizes over the text's size, with the size under the good one, is turned into a probability by a logistic
curve fitted on other rows of the sample. Labels are read for the sample alone.

Cases: null and empty texts have size 0 and features 0; labels that are null or not 0 or 1 are not learned from; without rows of
both classes every score is the share of class 1, or 0.5; rows with equal ids are scored one by one, equal texts
alike; an empty table gives an empty result; other columns are ignored; long texts are scored whole, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import documents, in_fold, labels, mapped

#: Most rows of each class that the model is fitted on, and most bytes of their texts.
SAMPLE, SAMPLE_BYTES = 3000, 64 << 20
PIECE, DICTIONARY, LEVEL = 1000, 110 << 10, 3


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, each: int = SAMPLE, id_col: str = "doc_id", text: str = "text", most: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Up to `each` texts of class 0 and of class 1, the first by hash of the id, as many of these as hold `most` bytes together, and how many rows
    each class has."""
    known = marks.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = [r for k in (0, 1) for r in known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(each).collect()]
    if not ids:
        return [], counts
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for r in ids], known.schema)
    got = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.first("label").alias("label"))  # 2 * each rows
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    got = got.withColumn("so_far", so_far).filter(F.col("so_far") <= most)
    return [(r["text"], r["label"]) for r in got.orderBy("id").collect()], counts


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients (intercept first) of a weighted logistic regression, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    keep = ridge * np.eye(len(b))
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + keep, a.T @ (weight * (y - p)) - keep @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


class CompressionClassifier:
    def __init__(self, good: bytes, bad: bytes, coefficients: np.ndarray, scale: np.ndarray):
        self.good, self.bad, self.coefficients, self.scale = good, bad, coefficients, scale

    @staticmethod
    def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    @staticmethod
    def features(raw: bytes, compressors: list) -> tuple[float, float]:
        if not raw:
            return 0.0, 0.0
        parts = pieces(raw)
        g, b = (sum(len(c.compress(p)) for p in parts) for c in compressors)
        return (b - g) / len(raw), g / len(raw)

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], counts: dict[int, int]) -> CompressionClassifier | float:
        """Three quarters of the sample make the dictionaries, the rest the curve. Without both classes, the share of class 1."""
        of = [[t.encode() for t, k in sample if k == label] for label in (0, 1)]
        if min(map(len, of)) < 4:
            n = counts.get(0, 0) + counts.get(1, 0)
            return counts.get(1, 0) / n if n else 0.5
        dictionaries = []
        for raws in of:
            training = [p for raw in raws[: 3 * len(raws) // 4] for p in pieces(raw)]
            try:
                dictionaries.append(zstandard.train_dictionary(DICTIONARY, training).as_bytes())
            except zstandard.ZstdError:  # too little text to train on: the text itself
                dictionaries.append(b"".join(training)[-DICTIONARY:] or b" " * 8)
        tools = cls.compressors(dictionaries[1], dictionaries[0])
        rest = [(raw, label) for label, raws in enumerate(of) for raw in raws[3 * len(raws) // 4 :]]
        x = np.array([cls.features(raw, tools) for raw, _ in rest])
        y = np.array([label for _, label in rest], float)
        share = np.array([counts[int(k)] / max(1, (y == k).sum()) for k in (0, 1)])
        weight = share[y.astype(int)] * len(y) / sum(counts[k] for k in (0, 1))
        scale = np.maximum(x.std(axis=0), 1e-6)
        return cls(dictionaries[1], dictionaries[0], logistic(x / scale, y, weight), scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + (x / self.scale) @ self.coefficients[1:], -30, 30)))


def score_documents(docs: DataFrame, model: CompressionClassifier | float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tools = None if isinstance(model, float) else model.compressors(model.good, model.bad)
        for batch in batches:
            if tools is None:
                score = np.full(batch.num_rows, float(model))
            else:
                score = model.score(np.array([model.features((t.as_py() or "").encode(), tools) for t in batch.column(1)]).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op3_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sample, counts = labelled_sample(docs, labels(spark, sf_dir).filter(~in_fold("doc_id", 3, 1)), "quality")
    scored = score_documents(docs, CompressionClassifier.fit(sample, counts))
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
