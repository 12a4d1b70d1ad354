"""Tables between the steps of an iterative operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="leafmark-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """df by these columns in so many partitions, which grow with the input; as it is, and by Spark's setting, if none are given."""
    return df.repartition(parts, *by) if parts else df


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read again: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


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
