"""Publications as a stream: an extension beside the batch queries, on Structured Streaming alone.

A late release is a new version, not late data: `current` keeps one state row a key, however many
releases arrive. Event-time rates drop what comes after the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.publication import latest


def current(stream: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The latest version of each key (output mode complete or update); equal versions resolve by the other columns."""
    rest = [c for c in stream.columns if c not in (*keys, *version)]
    top = stream.groupBy(*keys).agg(F.max(F.struct(*version, *rest)).alias("top"))
    return top.select(*keys, "top.*")


def rates(stream: DataFrame, time: str, kind: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows by window and kind, tumbling or sliding, final once the watermark has passed (output mode append)."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key, split at gaps."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Repeated rows of a key inside the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: list[str]) -> StreamingQuery:
    """Keep a Parquet snapshot of the latest versions under path/<batch>; a batch reads the one before and writes its own, so a repeated batch gives the same."""
    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch if epoch == 0 else batch.unionByName(batch.sparkSession.read.parquet(f"{path}/{epoch - 1}"))
        latest(rows, keys, version).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
