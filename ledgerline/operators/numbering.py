"""Numbers without gaps, prefix sums and runs over a total order, without one window over all rows.

Rows are sorted by ranges and written; each file is then a run of the order. What a file holds is reduced to a
count, a sum or a summary, the summaries of all files are put together in order, and each row adds its own place.
A key with most of the rows lies in many files, so it is no group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.skew import dealt_join
from ledgerline.sources.scratch import placed


def _bases(per_file: DataFrame, amount: str) -> DataFrame:
    """(__file, __base): what the files before hold. One row a file, so the only ordered task, and what is broadcast, is as long as the list of files that the driver plans with."""
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per_file.select("__file", F.coalesce(F.sum(amount).over(before), F.lit(0)).alias("__base")))


def line_numbers(scan: DataFrame, name: str = "line_number") -> DataFrame:
    """scan, read from Parquet files, with the number of each row in the order of the files' names and rows: 1 to n.

    Rows don't move: a file's rows are counted, and a row's place in its file is in its metadata.
    """
    rows = scan.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    bases = _bases(rows.groupBy("__file").agg(F.count("*").alias("n")), "n")
    return rows.join(bases, "__file").select(*scan.columns, (F.col("__base") + F.col("__row") + 1).alias(name))


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with the number of each row in the order of the columns, 1 to n without gaps."""
    rows = placed(df, order, "numbered")
    bases = _bases(rows.groupBy("__file").agg(F.count("*").alias("n")), "n")
    return rows.join(bases, "__file").select(*df.columns, (F.col("__base") + F.col("__row") + 1).alias(name))


def prefix_sums(df: DataFrame, order: list[str], amount: str, name: str = "before") -> DataFrame:
    """df with the sum of the amounts of all rows before each one in the order."""
    rows = placed(df, order, "prefix")
    bases = _bases(rows.groupBy("__file").agg(F.sum(amount).alias("n")), "n")
    within = Window.partitionBy("__file").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return inside.join(bases, "__file").select(*df.columns, (F.col("__base") + F.col("__within")).alias(name))


def value_ranks(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """(part, value, n, average_rank, share_rank) of each distinct value of a part; nulls have no rank.

    Rows are counted by value first, then the counts are summed up in order, so a part with most of the rows is
    as many rows as it has values, and these lie in many tasks. Ties share the mean of their places.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("n"))
    sums = prefix_sums(counts, [*part, value], "n", "__before")
    whole = sums.groupBy(*part).agg(F.sum("n").alias("__all"), F.min("__before").alias("__first"), F.count("*").alias("__values"))
    met = dealt_join(sums, whole, part, "__values")
    rank = F.col("__before") - F.col("__first") + (F.col("n") + 1) / 2.0
    return met.select(*part, value, "n", rank.alias("average_rank"), (rank / F.col("__all")).alias("share_rank"))


def with_ranks(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """df with average_rank and share_rank, null where the value is; the rows of a value that very many have are dealt over tasks."""
    met = dealt_join(df.where(F.col(value).isNotNull()), value_ranks(df, part, value), [*part, value], "n").drop("n")
    return met.unionByName(df.where(F.col(value).isNull()).select("*", F.lit(None).cast("double").alias("average_rank"), F.lit(None).cast("double").alias("share_rank")))


def longest_runs(df: DataFrame, series: list[str], order: list[str], flag: Column) -> DataFrame:
    """(series, longest_run): most consecutive rows of a series for which flag holds, 0 if none; a null flag doesn't hold.

    Each file's stretch of a series is summed up as its length, the runs at both of its ends and the best inside; the
    summaries of a series, one a file, are merged in order.
    """
    rows = placed(df.select(*series, *order, F.coalesce(flag, F.lit(False)).alias("__on")), [*series, *order], "runs")
    at = Window.partitionBy(*series, "__file").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__breaks", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(at))
    runs = marked.groupBy(*series, "__file", "__breaks").agg(F.count_if("__on").alias("__n"))
    parts = runs.groupBy(*series, "__file").agg(
        F.max("__breaks").alias("breaks"), F.max("__n").alias("best"),
        F.sum(F.when(F.col("__breaks") == 0, F.col("__n")).otherwise(0)).alias("first"), F.max_by("__n", "__breaks").alias("last"))
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("__file", "breaks", "best", "first", "last"))),
        F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best")),
        lambda held, x: F.struct(
            F.when(x["breaks"] == 0, held["run"] + x["last"]).otherwise(x["last"]).cast("long").alias("run"),
            F.greatest(held["best"], x["best"], held["run"] + x["first"]).cast("long").alias("best")),
        lambda held: held["best"])
    return parts.groupBy(*series).agg(merged.alias("longest_run"))
