"""The longest of many prefixes that a text begins with, by equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.skew import dealt_join


def longest_prefix(texts: DataFrame, text: str, table: DataFrame, prefix: str) -> DataFrame:
    """texts with the columns of the row of table whose prefix is the longest that the text begins with; null where none is.

    The lengths of prefixes that the table has are few, whatever its rows. Each distinct text is cut to each of them,
    the cuts meet the table by equality, and the longest stays. Prefixes are unique in the table; the empty one matches
    every text that isn't null.
    """
    lengths = sorted(r[0] for r in table.where(F.col(prefix).isNotNull()).select(F.length(prefix)).distinct().collect())  # as many as the longest prefix has characters, at most
    mine = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    counts = texts.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("__rows"))
    cuts = counts.select(F.col(text).alias("__text"), F.explode(F.filter(mine, lambda n: n <= F.length(text))).alias("__n")).withColumn("__cut", F.substring("__text", F.lit(1), F.col("__n")))
    other = [c for c in table.columns if c != prefix]
    best = cuts.join(table.select(F.col(prefix).alias("__cut"), F.col(prefix), *other), "__cut").groupBy("__text").agg(F.max_by(F.struct(prefix, *other), "__n").alias("__best"))
    found = counts.join(best, F.col(text) == F.col("__text"), "left").select(text, "__rows", "__best")
    met = dealt_join(texts.where(F.col(text).isNotNull()), found, [text], "__rows").select(*texts.columns, "__best")
    none = texts.where(F.col(text).isNull()).withColumn("__best", F.lit(None).cast(met.schema["__best"].dataType))
    return met.union(none).select(*texts.columns, *[F.col(f"__best.{c}").alias(c) for c in (prefix, *other)])
