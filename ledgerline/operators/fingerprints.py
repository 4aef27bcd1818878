"""Fingerprints of tables as multisets: equal tables are told by sums of hashes, unequal ones by the buckets that differ.

A row adds the hash of its key and each value to its bucket's sums, one a column. Sums don't depend on the order of
rows, and combine before the shuffle. Two tables are compared by these sums first; only the rows of buckets that
differ are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a table: a bound on what is compared, and collected, before rows are.
BUCKETS = 4096
_ROW = "__row"


def _bucket(keys: list[str]):  # noqa: ANN202
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def fingerprint(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(bucket, column_name, n, total): rows, and the sum of the hashes of key and value, of each bucket and column.

    A null has a hash of its own; the column named "" stands for the keys alone, so that missing rows show.
    """
    columns = [c for c in df.columns if c not in keys] if columns is None else columns
    of = lambda c: F.xxhash64(*keys, F.lit(c), *([F.coalesce(F.xxhash64(c), F.lit(0)), F.col(c).isNull()] if c else []))
    sums = df.groupBy(_bucket(keys).alias("bucket")).agg(F.count("*").alias("n"), *[F.sum(of(c).cast("decimal(20,0)")).alias(f"sum_{i}") for i, c in enumerate(["", *columns])])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"sum_{i}").alias("total")) for i, c in enumerate(["", *columns])])).alias("x")
    return sums.select("bucket", "n", each).select("bucket", "x.column_name", "n", "x.total")


def table_fingerprint(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(column_name, n, total) over all buckets: two tables with equal rows have equal fingerprints."""
    return fingerprint(df, keys, columns).groupBy("column_name").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))


def differing(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> dict[int, set[str]]:
    """Columns that differ, by bucket; empty if the tables hold the same rows. Whole columns are compared first, then buckets of those that differ."""
    columns = [c for c in old.columns if c not in keys] if columns is None else columns
    a, b = fingerprint(old, keys, columns), fingerprint(new, keys, columns)
    both = a.withColumn("__new", F.lit(0)).union(b.withColumn("__new", F.lit(1))).groupBy("bucket", "column_name")
    side = lambda c, new: F.sum(F.when(F.col("__new") == new, F.col(c)).otherwise(0))
    found = both.agg((side("n", 0) - side("n", 1)).alias("n"), (side("total", 0) - side("total", 1)).alias("total")).where("n <> 0 OR total <> 0")
    out: dict[int, set[str]] = {}
    for r in found.select("bucket", "column_name").collect():  # at most BUCKETS x columns, and only what differs
        out.setdefault(r["bucket"], set()).add(r["column_name"])
    return out


def changed_cells(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(keys, column_name, old_value, new_value, kind) of each cell that differs, values as text; kind is CHANGED, ADDED or REMOVED.

    Keys are unique in both tables. Rows of buckets whose sums agree are not joined; without any other, no row is.
    """
    columns = [c for c in old.columns if c not in keys] if columns is None else columns
    bad = differing(old, new, keys, columns)
    spark = old.sparkSession
    text = lambda df, flag: df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns], F.lit(True).alias(flag))
    a, b = text(old, "__old"), text(new, "__new")
    if not bad:
        a, b = a.limit(0), b.limit(0)
    else:
        buckets = F.broadcast(spark.createDataFrame([(x,) for x in bad], "__bucket int"))  # BUCKETS rows at most
        a, b = (df.withColumn("__bucket", _bucket(keys)).join(buckets, "__bucket", "left_semi").drop("__bucket") for df in (a, b))
    b = b.select(*[F.col(c).alias(f"new_{c}") for c in (*keys, *columns)], "__new")
    met = a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys]), "full")
    kind = F.when(F.col("__old").isNull(), "ADDED").when(F.col("__new").isNull(), "REMOVED").otherwise("CHANGED")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("old_value"), F.col(f"new_{c}").alias("new_value")) for c in columns])).alias("x")
    key = [F.when(F.col("__old").isNull(), F.col(f"new_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return met.select(*key, kind.alias("kind"), cells).where("kind <> 'CHANGED' OR NOT (x.old_value <=> x.new_value)").select(*keys, "x.column_name", "x.old_value", "x.new_value", "kind")
