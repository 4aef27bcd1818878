"""A join of rows with facts about their keys in which a key with very many rows is dealt over many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which a key is dealt over SALTS tasks, and slots that keys are told apart by: a bound on what is broadcast.
BIG, SALTS, SLOTS = 10_000, 64, 1 << 20


def dealt_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, merge: bool = False) -> DataFrame:
    """rows with the other columns of facts, which has one row a key and, in n, the number of its rows; nulls are equal.

    Only the slots of keys with over BIG rows are broadcast, SLOTS numbers at most. Rows of those slots get a salt,
    and the facts of those slots a copy for each; all others have salt 0. Each side is read once for the join. merge: facts grow with the rows, so
    they are never broadcast, whatever size Spark takes them for after the copies are made.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).alias("__slot")
    hot = F.broadcast(facts.where(F.col(n) > BIG).select(slot).distinct().withColumn("__hot", F.lit(True)))
    other = [c for c in facts.columns if c not in keys]
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    theirs = facts.select(*[F.col(k).alias(f"__{k}") for k in keys], *other, slot).join(hot, "__slot", "left").withColumn("__copy", F.explode(copies)).drop("__slot", "__hot")
    theirs = theirs.hint("merge") if merge else theirs
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0)
    mine = rows.select("*", slot).join(hot, "__slot", "left").withColumn("__salt", salt)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return mine.join(theirs, same & (F.col("__salt") == F.col("__copy"))).select(*rows.columns, *other)
