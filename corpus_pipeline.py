"""A corpus from raw documents to token ids: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import lines, mixing, pieces, toxicity, weighted_minhash
from leafmark.llm.common import documents, labels, written
from leafmark.llm.compression import labelled_sample


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, with all their columns.

    Null and empty texts hold no terms and are kept unless the labels' base rate reaches the threshold; repeated rows and rows of one id are judged
    one by one; rows without an id are judged like others, only their labels can't be found; without labels nothing is dropped."""
    sample, counts = labelled_sample(docs, labels(spark, sf_dir), "toxic", toxicity.SAMPLE)
    scored = toxicity.score_documents(docs, toxicity.ToxicityModel.fit(sample, counts), id_col=None)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, equal or within two edits; those with nothing left go. Cases: see lines.py."""
    return lines.without_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class of near-duplicates. Cases: see weighted_minhash.py."""
    return weighted_minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the mixture's weights; the budget gives every source a whole pass, so none is lost.

    A null source is a source of its own; null and empty texts have no tokens and come once; equal rows are told apart by nothing, so either may be the one
    that is repeated once more; columns may have any names."""
    return mixing.mixed_documents(docs, gain=0.25, budget="cover")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, restored and parity of every document of the mixture; other columns end here.

    Null and empty texts have no ids; repeated rows are encoded each; a null id is kept."""
    ids = pieces.encode(docs.select(F.struct("doc_id", "lang", "source").alias("doc"), "text"), pieces.model_bytes(), id_col="doc")
    return ids.select("doc_id.*", "ids", "n_tokens", "restored", "parity")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Fuzzy matching, similarity classes and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
