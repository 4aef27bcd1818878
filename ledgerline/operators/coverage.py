"""Coverage of series as bitmaps: which periods of a range each series has, 64 periods a number.

Rows set bits, which combine before the shuffle; a series is then a short list of (word, bits). What is missing is
found inside the row, so no table of series x periods is built or moved: output grows with the gaps, shuffles with
the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def bitmaps(df: DataFrame, series: list[str], index: Column) -> DataFrame:
    """(series, words map<int, long>): the periods that each series has; index is a period's whole number. Null periods set no bit."""
    words = df.select(*series, index.cast("long").alias("__i")).where("__i IS NOT NULL")
    words = words.groupBy(*series, F.floor(F.col("__i") / WORD).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("__i", F.lit(WORD)).cast("int"))).alias("bits"))
    return words.groupBy(*series).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def counted(df: DataFrame, by: list[str], keys: list[str], name: str, otherwise: Column | None = None) -> DataFrame:
    """(by, n, name): rows and distinct keys, one or two whole-number columns, of each group.

    Exact for any keys. A group's keys are bits of words: 64 neighbours, or 8 times 8 where there are two columns, are
    one row of what tasks hold and shuffle. Scattered keys have a word each, as a distinct count has a row for each.
    otherwise: a text that stands for the key where a column of it is null; without one, such rows are in n alone.
    """
    width = 6 // len(keys)  # bits of each key inside the word
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    low = lambda k: F.col(k).cast("long").bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    place = reduce(lambda at, k: at * (1 << width) + low(k), keys[1:], low(keys[0])).cast("int")
    text = F.when(~whole, F.lit(None).cast("string") if otherwise is None else otherwise)
    bit = F.when(whole, F.call_function("shiftleft", F.lit(1).cast("long"), place)).when(text.isNotNull(), F.lit(1).cast("long"))
    words = [F.when(whole, F.shiftright(F.col(k).cast("long"), width)).alias(f"__word_{i}") for i, k in enumerate(keys)]
    rows = df.select(*by, *words, text.alias("__text"), bit.alias("__bit"))
    held = rows.groupBy(*by, *[f"__word_{i}" for i in range(len(keys))], "__text").agg(F.count("*").alias("n"), F.bit_or("__bit").alias("__bits"))
    return held.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.bit_count("__bits")), F.lit(0).cast("long")).alias(name))


def has(words: Column, index: Column) -> Column:
    """Is the bit of a period set?"""
    bits = F.coalesce(F.try_element_at(words, F.floor(index / WORD).cast("int")), F.lit(0).cast("long"))
    return F.getbit(bits, F.pmod(index, F.lit(WORD)).cast("int")) == 1


def present(words: Column) -> Column:
    """How many periods a series has."""
    return F.aggregate(F.map_values(words), F.lit(0).cast("long"), lambda n, bits: n + F.bit_count(bits))


def missing(covered: DataFrame, lo: Column, hi: Column, wanted: Callable[[Column], Column] | None = None, name: str = "index") -> DataFrame:
    """covered, one row a missing period of lo to hi (whole numbers), among the wanted ones."""
    lacks = lambda i: ~has(F.col("words"), i) & (wanted(i) if wanted else F.lit(True))
    return covered.withColumn(name, F.explode(F.filter(F.sequence(lo.cast("long"), hi.cast("long")), lacks))).drop("words")


def gap_runs(covered: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """covered, one row a run of missing periods: first, last and length. A run starts where the period before is there, and ends likewise."""
    span = F.sequence(lo.cast("long"), hi.cast("long"))
    out = lambda i: ~has(F.col("words"), i)
    starts = F.filter(span, lambda i: out(i) & ((i == lo) | has(F.col("words"), i - 1)))
    ends = F.filter(span, lambda i: out(i) & ((i == hi) | has(F.col("words"), i + 1)))
    rows = covered.withColumn("x", F.explode(F.arrays_zip(starts.alias("first"), ends.alias("last"))))
    return rows.drop("words").select("*", F.col("x.first").alias("first"), F.col("x.last").alias("last"), (F.col("x.last") - F.col("x.first") + 1).alias("length")).drop("x")
