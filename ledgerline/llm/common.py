"""Helpers that the text operators share: tables, scratch tables and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one call of a batch function sees; bounds the Python worker's memory besides the texts themselves.
SLICE_ROWS = 256
#: Slots of the filter that parts rows before texts move; bounds what it broadcasts to as many numbers.
SLOTS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}")
    return spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: later stages depend on files, not on lineage."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that cut wrote inside it; store a result before."""
    first = len(_written)
    try:
        yield
    finally:
        for path in _written[first:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _written[first:]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package's sources to the executors, once an application, so that their Python finds it wherever they run."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_slices(df: DataFrame, fn: Callable[..., pa.RecordBatch], schema: str | T.StructType, once: Callable[[], Any] | None = None) -> DataFrame:
    """map_batches in slices of SLICE_ROWS rows: fn(batch), or fn(once(), batch) with once() called once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (once(),) if once else ()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield fn(*first, batch.slice(at, SLICE_ROWS))

    return map_batches(df, run, schema)


def parted(rows: DataFrame, own: list[str], keys: DataFrame, theirs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may meet keys, rows that can't), by a hash of the columns own and theirs, so that only the former go on to a shuffled join.

    At most SLOTS numbers are broadcast, however many keys there are; beyond, more rows may meet.
    """
    slot = lambda names: F.pmod(F.xxhash64(*names), F.lit(SLOTS)).alias("__slot")
    taken, dealt = F.broadcast(keys.select(slot(theirs)).distinct()), rows.select("*", slot(own))
    return dealt.join(taken, "__slot", "left_semi").drop("__slot"), dealt.join(taken, "__slot", "left_anti").drop("__slot")


def remainder(key: Column, k: int) -> Column:
    """crc32 of the key written as text, mod k."""
    return F.crc32(key.cast("string").cast("binary")) % k


def _share(n: int, total: Column | int) -> Column:
    """A bound on xxhash64 under which about n of total distinct keys fall, and a quarter more, since total is an estimate."""
    return F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(1.25 * n + 64) / F.greatest(F.lit(1), F.lit(total))) * F.lit(2.0**64)


def sample_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most n distinct non-null keys, the same for the same input: those whose hash is smallest.

    The number of keys is estimated first, so that only about n of them pass a bound on the hash and
    meet in one task, however many partitions or repeated keys there are.
    """
    keys = rows.select(key).where(F.col(key).isNotNull())
    total = keys.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    return keys.where(F.xxhash64(key) <= _share(n, total)).distinct().orderBy(F.xxhash64(key), key).limit(n)


def sample_texts(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) of at most n documents: keys are chosen before texts move; of several texts under one id, the smallest."""
    return docs.select("doc_id", "text").join(F.broadcast(sample_keys(docs, "doc_id", n)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, k: int, r: int, n: int) -> DataFrame:
    """(doc_id, text, y), at most n rows: labelled documents whose remainder mod k is not r.

    Labels that are null, or that contradict each other for one doc_id, are left out; of several texts
    under one doc_id the smallest counts, so n bounds rows as well as ids. At most n ids are broadcast;
    what moves is combined on the map side.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), k) != r)).select("doc_id", F.col(label).alias("y"))
    ids = usable.join(F.broadcast(sample_keys(usable, "doc_id", n)), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("__top"))
    chosen = F.broadcast(ids.where("y = __top").select("doc_id", F.col("y").cast("int").alias("y")))
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
