"""Constraints as queries: each returns offending rows or counts; nothing raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.skew import dealt_join


def duplicates(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that occur more than once, among the rows for which `where` holds, if given; nulls count as equal."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def duplicate_of(df: DataFrame, keys: list[str], signature: list[str], row_id: str) -> DataFrame:
    """df with status and duplicate_of. Rows of one key that agree in the signature: the one with the smallest id is ACTIVE, the others are its EXACT_DUPLICATE. If they disagree, all are DATE_CONFLICT and none is chosen.

    Facts of a key are aggregated and joined back; a key with very many rows is dealt over tasks.
    """
    twin = df.groupBy(*keys, *signature).agg(F.min(row_id).alias("__kept"), F.count("*").alias("__n"))
    facts = twin.groupBy(*keys).agg(F.min("__kept").alias("__kept"), F.count("*").alias("__signatures"), F.sum("__n").alias("__n"))
    out = dealt_join(df, facts, keys, "__n")
    agree = F.col("__signatures") == 1
    status = F.when(~agree, "DATE_CONFLICT").when(F.col(row_id) == F.col("__kept"), "ACTIVE").otherwise("EXACT_DUPLICATE")
    return out.select(*df.columns, status.alias("status"), F.when(agree & (F.col(row_id) != F.col("__kept")), F.col("__kept")).alias("duplicate_of"))


def offending(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """(check_name, keys, n_rows): the keys of the rows that break each check, in one pass; a check that is null passes.

    Rows that break none are left out first; a task holds a key once, with a count for each check.
    """
    broken = {name: F.coalesce(~c, F.lit(False)) for name, c in checks.items()}
    marked = df.select(*keys, *[c.alias(f"__{i}") for i, c in enumerate(broken.values())]).where(" OR ".join(f"__{i}" for i in range(len(broken))))
    counts = marked.groupBy(*keys).agg(*[F.count_if(f"__{i}").alias(f"__{i}") for i in range(len(broken))])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(f"__{i}").alias("n_rows")) for i, name in enumerate(broken)]))
    return counts.select(each.alias("__x"), *keys).where("__x.n_rows > 0").select("__x.check_name", *keys, "__x.n_rows")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose non-null key the parent lacks."""
    keys = parent.select(F.col(parent_key).alias("__key"))
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("__key"), "left_anti")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, n_rows, n_violations) of all checks in one pass; a check that is null passes, as in SQL."""
    counts = df.agg(F.count("*").alias("n"), *[F.sum(F.when(~c, 1).otherwise(0)).alias(name) for name, c in checks.items()])
    return counts.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("n_violations")) for k in checks])).alias("x")).select("x.check_name", F.col("n").alias("n_rows"), "x.n_violations")


def impure(df: DataFrame, key: str, attribute: str) -> DataFrame:
    """Keys with more than one value of the attribute."""
    return df.groupBy(key).agg(F.countDistinct(attribute).alias("n_values")).where("n_values > 1")


def report(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check_name, offending, ok) of several offending-row queries: all are run, none raises."""
    rows = [df.agg(F.lit(name).alias("check_name"), F.count("*").alias("offending")) for name, df in results]
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("offending") == 0)


def text_survives(text: Column, kind: str = "decimal(38,18)") -> Column:
    """Does a number's text come back from the type, but for trailing zeros? Null where there is no text."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return plain(text) == plain(text.try_cast(kind).cast("string"))
