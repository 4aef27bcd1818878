"""Change between periods. A gap stays a gap: a lag is only used where the row before is the period before, or joined by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio_pct(new: Column, old: Column) -> Column:
    """100 * (new / old - 1); null where old is null or zero."""
    return 100 * (F.try_divide(new, old) - 1)


def previous(series: list[str], order: str, value: str) -> Column:
    """The value of the row before, whatever its period."""
    return F.lag(value).over(Window.partitionBy(*series).orderBy(order))


def period_pct(series: list[str], order: str, value: str) -> Column:
    return ratio_pct(F.col(value), previous(series, order, value))


def shifted(df: DataFrame, keys: list[str], period: str, value: str, shift: Column) -> DataFrame:
    """Inner self-join with the row whose period, shifted, is this one's: (keys, period, value, base)."""
    base = df.select(*keys, shift.alias(period), F.col(value).alias("base"))
    return df.join(base, [*keys, period])


def year_on_year(df: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """Change on the same month a year before, joined by date; months without that base have no row."""
    return shifted(df, keys, month, value, F.add_months(month, 12)).withColumn("yoy_pct", ratio_pct(F.col(value), F.col("base")))


def endpoints(df: DataFrame, keys: list[str], period: str, value: str, first: object, last: object) -> DataFrame:
    """Series that have both end periods: first_value, last_value, change, pct."""
    a = df.where(F.col(period) == F.lit(first)).select(*keys, F.col(value).alias("first_value"))
    b = df.where(F.col(period) == F.lit(last)).select(*keys, F.col(value).alias("last_value"))
    return a.join(b, keys).withColumn("change", F.col("last_value") - F.col("first_value")).withColumn("pct", ratio_pct(F.col("last_value"), F.col("first_value")))


def dispersion(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Min, quartiles, max, interquartile range, range, coefficient of variation and max over min of each group; quantiles are exact."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).alias("lowest"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max(value).alias("highest"),
        (q(0.75) - q(0.25)).alias("iqr"), (F.max(value) - F.min(value)).alias("spread"),
        (100 * F.try_divide(F.stddev_samp(value), F.avg(value))).alias("cv_pct"), F.try_divide(F.max(value), F.min(value)).alias("max_over_min"),
    )
