"""Ranks, runs and association over a long panel. Windows are partitioned by period and metric or by series, never global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.numbering import prefix_sums
from ledgerline.operators.skew import dealt_join


def average_rank(part: list[str], value: str, descending: bool = False) -> Column:
    """Rank 1..n in the partition; ties share the mean of their places."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(Window.partitionBy(*part).orderBy(order)) + (F.count("*").over(Window.partitionBy(*part, value)) - 1) / 2.0


def share_rank(part: list[str], value: str) -> Column:
    """average_rank over the partition's size, in (0, 1]."""
    return average_rank(part, value) / F.count("*").over(Window.partitionBy(*part))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bound: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles of each group, one column a share; null values are left out.

    Where no group has over bound rows, one aggregate gives all shares. Rows of larger groups are counted by value
    and the counts summed up in order over ranges, so no group is held in one task.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    each = lambda part: part.groupBy(*keys).agg(F.percentile("__v", list(shares.values())).alias("__q")).select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(shares)])
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= bound:
        return each(rows)
    met = dealt_join(rows, sizes, keys, "__n")
    counts = met.where(F.col("__n") > bound).groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    sums = prefix_sums(counts, [*keys, "__v"], "__c", "__before")
    first = sums.groupBy(*keys).agg(F.min("__before").alias("__first"), F.sum("__c").alias("__all"), F.count("*").alias("__n"))
    placed = dealt_join(sums, first, keys, "__n").withColumn("__at", F.col("__before") - F.col("__first"))
    held = lambda i: F.max(F.when((F.col("__at") <= i) & (i < F.col("__at") + F.col("__c")), F.col("__v")))
    ends = {n: p * (F.col("__all") - 1) for n, p in shares.items()}
    found = placed.groupBy(*keys).agg(F.max("__all").alias("__all"), *[held(f(at)).alias(f"__{f.__name__}_{n}") for n, at in ends.items() for f in (F.floor, F.ceil)])
    low, high = (lambda n: F.col(f"__floor_{n}")), (lambda n: F.col(f"__ceil_{n}"))
    large = found.select(*keys, *[F.when(low(n) == high(n), low(n)).otherwise(low(n) + (at - F.floor(at)) * (high(n) - low(n))).alias(n) for n, at in ends.items()])
    return each(met.where(F.col("__n") <= bound)).unionByName(large)


def longest_run(df: DataFrame, series: list[str], order: str, flag: Column) -> DataFrame:
    """Longest run of consecutive rows of a series for which flag holds (0 if none)."""
    ordered = Window.partitionBy(*series).orderBy(order)
    marked = df.withColumn("__on", F.coalesce(flag, F.lit(False))).withColumn("__i", F.row_number().over(ordered))
    island = marked.withColumn("__island", F.col("__i") - F.row_number().over(Window.partitionBy(*series, "__on").orderBy(order)))
    runs = island.groupBy(*series, "__on", "__island").agg(F.count("*").alias("__n"))
    return runs.groupBy(*series).agg(F.max(F.when(F.col("__on"), F.col("__n")).otherwise(0)).alias("longest_run"))


def spearman(df: DataFrame, a: str, b: str, part: list[str]) -> DataFrame:
    """Rank correlation of two columns inside each partition."""
    ranked = df.select(*part, average_rank(part, a).alias("__a"), average_rank(part, b).alias("__b"))
    return ranked.groupBy(*part).agg(F.corr("__a", "__b").alias("rho"), F.count("*").alias("n"))


def spearman_pairs(df: DataFrame, item: str, metric: str, value: str) -> DataFrame:
    """(metric_a, metric_b, rho, n), a < b, over the items that both metrics have."""
    left = df.select(item, F.col(metric).alias("metric_a"), F.col(value).alias("__x"))
    right = df.select(item, F.col(metric).alias("metric_b"), F.col(value).alias("__y"))
    return spearman(left.join(right, item).where("metric_a < metric_b"), "__x", "__y", ["metric_a", "metric_b"])


def eta_squared(df: DataFrame, metric: str, factor: str, value: str) -> DataFrame:
    """Share of a metric's variance that lies between the levels of the factor: sums of squares from counts, sums and sums of squares."""
    level = df.groupBy(metric, factor).agg(F.count("*").alias("__n"), F.avg(value).alias("__mean"), F.var_pop(value).alias("__var"))
    grand = level.groupBy(metric).agg((F.sum(F.col("__n") * F.col("__mean")) / F.sum("__n")).alias("__grand"))
    parts = level.join(grand, metric).groupBy(metric).agg(F.sum(F.col("__n") * F.pow(F.col("__mean") - F.col("__grand"), 2)).alias("__between"), F.sum(F.col("__n") * F.col("__var")).alias("__within"))
    return parts.select(metric, F.try_divide(F.col("__between"), F.col("__between") + F.col("__within")).alias("eta_sq"))
