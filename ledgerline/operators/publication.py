"""Operators over publications: rows with an observation period, a release period and a value.

A later release restates an observation; both rows are kept, and every reader says which it wants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row a key: the greatest by version. An aggregate of structs, so that it combines before the shuffle and no key is a group in one task. version should be a total order."""
    rest = [c for c in df.columns if c not in (*keys, *version)]
    top = df.groupBy(*keys).agg(F.max(F.struct(*version, *rest)).alias("top"))
    return top.select(*keys, *[F.col(f"top.{c}").alias(c) for c in (*version, *rest)]).select(*df.columns)


def primary(df: DataFrame) -> DataFrame:
    """First publications by structure: the release period is the observation period."""
    return df.where(F.col("rel") == F.col("obs"))


def windows(df: DataFrame, dataset: str, is_primary: Column) -> DataFrame:
    """First and last observation of each dataset, over all rows and over primary rows."""
    only = F.when(is_primary, F.col("obs"))
    return df.groupBy(dataset).agg(F.min("obs").alias("first_any"), F.max("obs").alias("last_any"), F.min(only).alias("first_primary"), F.max(only).alias("last_primary"))


def common_window(per_dataset: DataFrame, first: str, last: str) -> DataFrame:
    """The window that all datasets share: latest start, earliest end, months inclusive."""
    out = per_dataset.agg(F.max(first).alias("window_start"), F.min(last).alias("window_end"))
    return out.withColumn("months", (F.months_between("window_end", "window_start") + 1).cast("int"))


def stability(df: DataFrame, keys: list[str]) -> DataFrame:
    """Observations published more than once: publications, distinct values, range, first and last release."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("publications"), F.countDistinct("value").alias("distinct_values"), (F.max("value") - F.min("value")).alias("value_range"), F.min("rel").alias("first_release"), F.max("rel").alias("last_release"))
        .where("publications > 1")
    )


def difference_kind(new: Column, old: Column, conflict: float = 0.5) -> Column:
    """How a restated value differs from the one before."""
    gap = F.abs(new - old) / F.abs(old)
    return F.when(new == old, "IDENTICAL").when(gap < 1e-12, "PRECISION_ONLY").when(gap >= conflict, "KNOWN_CONFLICT").otherwise("SUBSTANTIVE")


def overlap(df: DataFrame, keys: list[str], months: list[int]) -> DataFrame:
    """Pairs of the same observation in releases that lie one of the given months apart (lag_months), from one self-join."""
    lag = F.explode(F.array(*[F.lit(m) for m in months])).alias("lag_months")
    before = df.select(*keys, lag, "rel", F.col("value").alias("old_value")).withColumn("rel", F.expr("add_months(rel, lag_months)"))
    return df.join(before, [*keys, "rel"]).select(*keys, "lag_months", "rel", F.col("value").alias("new_value"), "old_value", difference_kind(F.col("value"), F.col("old_value")).alias("kind"))


def all_pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every two releases of the same observation, earlier and later; an observation has as many releases as months at most."""
    a = df.select(*keys, F.col("rel").alias("earlier"), F.col("value").alias("old_value"))
    b = df.select(*keys, F.col("rel").alias("later"), F.col("value").alias("new_value"))
    apart = F.months_between("later", "earlier").cast("int")
    return a.join(b, keys).where("earlier < later").withColumns({"months_apart": apart, "kind": difference_kind(F.col("new_value"), F.col("old_value"))})


def duplicate_kinds(df: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """Keys that occur more than once: EXACT_DUPLICATE where all rows have one signature, else CONFLICT."""
    grouped = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*signature)).alias("n_signatures"))
    return grouped.where("n_rows > 1").withColumn("kind", F.when(F.col("n_signatures") == 1, "EXACT_DUPLICATE").otherwise("CONFLICT"))


def gaps(df: DataFrame, series: list[str], month: str) -> DataFrame:
    """Months of the table's own range that a series lacks. Gaps are named, never filled."""
    span = df.agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    spine = df.select(*series).distinct().crossJoin(span).select(*series, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias(month))
    return spine.join(df.select(*series, month), [*series, month], "left_anti")
