"""Extracts and loads: materialised results in versions, their manifest, a reader that falls back, loads that are whole or absent."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.numbering import line_numbers
from ledgerline.sources.scratch import file_at, read_text, write_new


class RowCountError(ValueError):
    """A table or extract has another number of rows than expected."""


def expect_rows(df: DataFrame, name: str, rows: int | None) -> DataFrame:
    """df, if it has the expected number of rows; None expects nothing."""
    if rows is not None and (found := df.count()) != rows:
        raise RowCountError(f"{name} has {found} rows, {rows} expected")
    return df


def count_differences(found: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """(name, expected, found) of the registered inputs whose row counts differ, or that only one side has."""
    have = reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("name"), F.count("*").alias("found")) for n, df in found.items()])
    return expected.select("name", F.col("rows").alias("expected")).join(have, "name", "full").where("NOT (expected <=> found)").select("name", "expected", "found")


# A view is a folder of parts and a folder of versions. A version is a small file that names the folder of each part; the
# highest number is the current one, and naming it is the last step of a refresh, so a reader sees one version, whole.


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = file_at(spark, f"{path}/_versions")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


def _version(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The highest number there is, and what the last whole version holds; one whose writer was lost before it ended doesn't count."""
    known = _versions(spark, path)
    for number in reversed(known):
        try:
            return known[-1], json.loads(read_text(spark, f"{path}/_versions/{number:010d}"))
        except ValueError:
            continue
    return (known[-1] if known else 0), {"parts": {}}


def _publish(spark: SparkSession, path: str, after: int, held: dict) -> None:
    """The next version; fails if another writer has named it meanwhile, and its rows then stay unread."""
    write_new(spark, f"{path}/_versions/{after + 1:010d}", json.dumps(held))


def _written(df: DataFrame, path: str, unique: list[str]) -> str:
    """A new folder with df, of which no two rows share the unique columns."""
    fresh = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{fresh}")
    if df.sparkSession.read.schema(df.schema).parquet(f"{path}/{fresh}").groupBy(*unique).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows of {path} are not unique by {', '.join(unique)}")
    return fresh


def materialise(df: DataFrame, path: str, unique: list[str]) -> DataFrame:
    """Write df as a materialised view whose rows are unique by the given columns, and read it; the same call again refreshes it.

    The rows go to a folder of their own and are checked; the version that names it comes last. A failure at
    any point leaves the version before.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    last, _ = _version(spark, path)
    _publish(spark, path, last, {"schema": df.schema.json(), "parts": {"": _written(df, path, unique)}})
    return view(spark, path)


def view(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A materialised view as of a version, or of now."""
    path = path.rstrip("/")
    held = _version(spark, path)[1] if version is None else json.loads(read_text(spark, f"{path}/_versions/{version:010d}"))
    if "schema" not in held:
        raise FileNotFoundError(f"{path} has no version")
    schema = T.StructType.fromJson(json.loads(held["schema"]))
    folders = [f"{path}/{f}" for f in sorted(set(held["parts"].values()))]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def roll_back(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Make an earlier version the current one, as a version of its own, and read it; nothing is removed or rewritten."""
    path = path.rstrip("/")
    _publish(spark, path, _version(spark, path)[0], json.loads(read_text(spark, f"{path}/_versions/{version:010d}")))
    return view(spark, path)


def refresh(spark: SparkSession, path: str, part: str, changed: DataFrame, build: Callable[[list], DataFrame], unique: list[str]) -> DataFrame:
    """Rebuild the parts of a view that a change set touches, and no others, and read the new version.

    part is a column of changed and of the view (a month, say); build(values) gives the view's rows of those parts,
    which each get a folder; a part with most of the rows is written by several tasks. Parts without rows any more are left out. The first refresh of a new view names all its
    parts in changed. Parts are as many as periods, so their list is small.
    """
    path = path.rstrip("/")
    last, held = _version(spark, path)
    values = [r[0] for r in changed.select(part).distinct().collect()]
    if not values and "schema" in held:
        return view(spark, path)
    rows = build(values)
    fresh = f"data/{uuid.uuid4().hex}"
    rows.withColumn("__part", F.col(part).cast("string")).hint("rebalance", "__part").write.partitionBy("__part").parquet(f"{path}/{fresh}")
    new = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__part", T.StringType())])).parquet(f"{path}/{fresh}")
    if new.groupBy(*unique).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows of {path} are not unique by {', '.join(unique)}")
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    there = {r["__part"]: unquote(r["folder"]) for r in new.select("__part", folder.alias("folder")).distinct().collect()}
    touched = {None if v in (None, "") else str(v) for v in values}
    if set(there) - touched:
        raise ValueError(f"rebuilt parts that did not change: {sorted(map(str, set(there) - touched))}")
    kept = {k: v for k, v in held["parts"].items() if k not in {_key(t) for t in touched}}
    _publish(spark, path, last, {"schema": rows.schema.json(), "parts": kept | {_key(t): f"{fresh}/{name}" for t, name in there.items()}})
    return view(spark, path)


def _key(part: str | None) -> str:
    return "null" if part is None else f"={part}"


def write_extracts(results: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each result under its name and, beside them, the manifest: (name, rows, source, written_at)."""
    spark = next(iter(results.values())).sparkSession
    rows = []
    for name, df in results.items():
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((name, spark.read.schema(df.schema).parquet(path).count(), path))
    manifest = spark.createDataFrame(rows, "name string, rows long, source string").withColumn("written_at", F.current_timestamp())
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/extract_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder.rstrip('/')}/extract_manifest")


def with_fallback(spark: SparkSession, read: Callable[[], DataFrame], folder: str, name: str) -> tuple[DataFrame, str]:
    """What read() gives, and 'live'; if its source can't be reached, the extract of that name with the rows its manifest has, and 'extract'.

    Spark's errors and those of a connector's driver count; read() should reach its source, as a JDBC reader does for its schema.
    """
    try:
        return read(), "live"
    except (PySparkException, Py4JError, OSError):
        known = spark.read.parquet(f"{folder.rstrip('/')}/extract_manifest").where(F.col("name") == name).first()
        if known is None:
            raise
        return expect_rows(spark.read.parquet(known["source"]), name, known["rows"]), "extract"


def load(df: DataFrame, path: str, load_id: str) -> int:
    """Add df under path with load_id and line_number, once: a load id that is there adds nothing. Returns the rows added.

    Line numbers are 1 to n without gaps, in the order of df's rows in its partitions, which for a text scan of one
    file is the order of lines. Rows are written to a folder that readers don't see, numbered from there, and moved
    to their place as a whole, so a load that failed on its way isn't there and the next call does it again. (On a
    store whose renames are copies, a failed move leaves no _SUCCESS file, and counts as absent as well.)
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fs, target = file_at(spark, f"{path}/load_id={load_id}")
    if fs.exists(file_at(spark, f"{path}/load_id={load_id}/_SUCCESS")[1]):
        return 0
    staged = f"{path}/_staging/{uuid.uuid4().hex}"
    df.write.parquet(f"{staged}/raw")  # a file for each partition, named in order
    line_numbers(spark.read.schema(df.schema).parquet(f"{staged}/raw")).write.parquet(f"{staged}/numbered")
    fs.delete(target, True)  # what a move left that did not end
    fs.mkdirs(target.getParent())
    if not fs.rename(file_at(spark, f"{staged}/numbered")[1], target):
        raise OSError(f"{target.toString()} could not be moved into place")
    added = spark.read.parquet(target.toString()).count()
    fs.delete(file_at(spark, staged)[1], True)
    return added


def reread(written: DataFrame, source: DataFrame, keys: list[str], cells: dict[str, Column]) -> DataFrame:
    """(column_name, cells, survive): for each column of a written output, read back as text, the cells whose text gives the source's value again.

    cells: the value that each text column gives, as an expression over `written`; compared with the source's column of
    that name. Keys join both sides; a row that only one side has does not survive.
    """
    a = written.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c.alias(f"__as_{n}") for n, c in cells.items()], F.lit(True).alias("__there"))
    same = [F.col(k).cast("string").eqNullSafe(F.col(f"__{k}").cast("string")) for k in keys]
    met = source.select(*keys, *[c for c in cells if c not in keys], F.lit(True).alias("__own")).join(a, same, "full")
    ok = lambda n: F.count_if(F.col(n).eqNullSafe(F.col(f"__as_{n}")) & F.col("__there").isNotNull() & F.col("__own").isNotNull())
    counts = met.agg(F.count("*").alias("cells"), *[ok(n).alias(f"ok_{i}") for i, n in enumerate(cells)])
    return counts.select("cells", F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"ok_{i}").alias("survive")) for i, n in enumerate(cells)])).alias("x")).select("x.column_name", "cells", "x.survive")
