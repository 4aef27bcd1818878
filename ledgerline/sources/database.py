"""A database as a read-only source over JDBC: partitioned reads, predicates that the database applies, refused writes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: What a query may start with. Readers send nothing else, and this library has no writer for a database.
READS = re.compile(r"\s*(select|with|values)\b", re.IGNORECASE)
WRITES = re.compile(r"\b(insert|update|delete|merge|drop|create|alter|truncate|grant|revoke|call|copy|lock|vacuum|refresh)\b", re.IGNORECASE)
QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.DOTALL)


class ReadOnlyError(ValueError):
    """Something other than a query was to be sent."""


def read_only(sql: str) -> str:
    """sql, if it is one query and nothing that writes; words inside quotes and comments don't count."""
    bare = QUOTED.sub(" ", sql).rstrip().rstrip(";")
    if not READS.match(bare) or ";" in bare or WRITES.search(bare):
        raise ReadOnlyError(f"not a query: {sql[:80]}")
    return sql


def database_table(spark: SparkSession, url: str, name: str, by: str | None = None, bounds: tuple | None = None, tasks: int = 8, **options: str) -> DataFrame:
    """A table of the database. Filters and columns that later steps ask for go to the database.

    With by, a column of numbers, dates or times, and its bounds, so many tasks read a range each; rows beyond the
    bounds go to the first and the last. The bounds are asked for if they aren't given.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**{"fetchsize": "10000", **options})
    if by is None:
        return reader.load()
    if bounds is None:
        bounds = tuple(database_query(spark, url, f"SELECT min({by}) AS lo, max({by}) AS hi FROM {name}", **options).first())
    if bounds[0] is None:  # an empty table
        return reader.load()
    return reader.option("partitionColumn", by).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])).option("numPartitions", tasks).load()


def database_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """The rows of one query, which the database runs as a whole."""
    return spark.read.format("jdbc").option("url", url).option("query", read_only(sql).rstrip().rstrip(";")).options(**options).load()
