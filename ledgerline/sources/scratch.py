"""Tables that cut lineage, in the shared folder that spark.checkpoint.dir names, and small files beside tables."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only on a local master where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}")
    return spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[str], name: str = "sorted") -> DataFrame:
    """df in the order of the columns, dealt over tasks by ranges and written, with __file and __row: rows follow each other by both.

    The ranges are drawn from a sample, so they are written before anything counts on them; order should tell
    rows apart, or equal ones stay in one task.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order), name)
    return rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def file_at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's file system and path of a name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet: of two writers of one name, one fails."""
    fs, at = file_at(spark, path)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
