"""Loads and restatements: numbered lines, keys in order, fingerprints, changed cells, refreshed parts, re-read outputs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import fingerprints, numbering
from ledgerline.plans.stand_in import money_mean, query, r6
from ledgerline.sources import extracts
from ledgerline.sources.scratch import folder
from ledgerline.sources.tables import TABLES, scan_text, table

#: What the text of a column stands for, by its type.
KINDS = {"int": "NUMBER", "bigint": "NUMBER", "double": "NUMBER", "string": "TEXT", "timestamp": "TIME"}


@query("SELECT row_number() OVER () AS line_number, l_orderkey, l_linenumber, l_partkey FROM lineitem")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the load with their number in the order of the file, without gaps and without moving a row."""
    return numbering.line_numbers(table(spark, sf_dir, "lineitem")).select("line_number", "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS surrogate, o_orderkey FROM orders")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys 1 to n by date and order, from ranges whose counts are summed up."""
    return numbering.numbered(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "surrogate").select("surrogate", "o_orderkey")


#: A restatement of orders: some totals rise, some states change, some rows go and some come.
COLUMNS = ["o_totalprice", "o_orderstatus", "o_orderpriority"]
RESTATED = """restated AS (SELECT o_orderkey, (o_totalprice::DECIMAL(18,2) + CASE WHEN o_orderkey % 101 = 0 THEN 10 ELSE 0 END)::DECIMAL(18,2) AS o_totalprice,
  CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 997 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 211 <> 0
  UNION ALL SELECT o_orderkey + 1000000000, o_totalprice::DECIMAL(18,2), o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 307 = 0)"""
BASE = "base AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS o_totalprice, o_orderstatus, o_orderpriority FROM orders)"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderstatus", "o_orderpriority")


def restated(rows: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    total = (F.col("o_totalprice") + F.when(key % 101 == 0, 10).otherwise(0)).cast("decimal(18,2)")
    status = F.when(key % 89 == 0, "X").otherwise(F.col("o_orderstatus"))
    changed = rows.where(key % 211 != 0).select("o_orderkey", total.alias("o_totalprice"), status.alias("o_orderstatus"), F.when(key % 997 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return changed.union(rows.where(key % 307 == 0).withColumn("o_orderkey", key + 1_000_000_000))


@query(
    " UNION ALL ".join(
        f"""SELECT coalesce(b.o_orderkey, r.o_orderkey) AS o_orderkey, '{c}' AS column_name, b.{c}::VARCHAR AS old_value, r.{c}::VARCHAR AS new_value,
    CASE WHEN b.o_orderkey IS NULL THEN 'ADDED' WHEN r.o_orderkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS kind FROM base b FULL JOIN restated r ON b.o_orderkey = r.o_orderkey
    WHERE b.o_orderkey IS NULL OR r.o_orderkey IS NULL OR b.{c} IS DISTINCT FROM r.{c}""" for c in COLUMNS),
    BASE, RESTATED,
)
def restated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that a restatement changes, adds or removes, from the buckets whose fingerprints differ."""
    rows = base(spark, sf_dir)
    return fingerprints.changed_cells(rows, restated(rows), ["o_orderkey"], COLUMNS)


@query(
    """SELECT stage, n_rows, n_rows = (SELECT count(*) FROM base) AND differing = 0 AS equals_base FROM (
    SELECT 'BASE' AS stage, (SELECT count(*) FROM base) AS n_rows, 0 AS differing
    UNION ALL SELECT 'RESTATED', (SELECT count(*) FROM restated), (SELECT count(*) FROM (SELECT * FROM base EXCEPT ALL SELECT * FROM restated))
    UNION ALL SELECT 'ROLLED_BACK', (SELECT count(*) FROM base), 0)""",
    BASE, RESTATED,
)
def rollback_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restatement is published as a version and taken back; fingerprints tell that the base is as it was."""
    rows, path = base(spark, sf_dir), f"{folder(spark)}/orders-{uuid.uuid4().hex}"
    first = extracts.materialise(rows, path, ["o_orderkey"])
    after = extracts.materialise(restated(rows), path, ["o_orderkey"])
    extracts.roll_back(spark, path, 1)
    stages = {"BASE": first, "RESTATED": after, "ROLLED_BACK": extracts.view(spark, path)}
    prints = None
    for stage, df in stages.items():
        one = fingerprints.table_fingerprint(df, ["o_orderkey"], COLUMNS).withColumn("stage", F.lit(stage))
        prints = one if prints is None else prints.union(one)
    own = fingerprints.table_fingerprint(rows, ["o_orderkey"], COLUMNS).select("column_name", F.col("n").alias("base_n"), F.col("total").alias("base_total"))
    met = prints.join(own, "column_name")
    return met.groupBy("stage").agg(F.max("n").alias("n_rows"), F.every((F.col("n") == F.col("base_n")) & (F.col("total") == F.col("base_total"))).alias("equals_base"))


PANEL = """SELECT month, priority, count(*) AS n, round(sum(total::DECIMAL(18,2))::DOUBLE / count(*), 6) AS value FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS priority,
    CASE WHEN date_trunc('month', o_orderdate) = '1996-03-01' AND o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS total FROM orders
    WHERE NOT (date_trunc('month', o_orderdate) = '1997-05-01' AND o_orderpriority = '5-LOW')) GROUP BY ALL"""


@query(PANEL)
def refreshed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel by month after two months were restated: only these are rebuilt, and the whole equals a full recompute."""
    orders = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "MM").alias("month"), F.col("o_orderpriority").alias("priority"), "o_orderstatus", "o_totalprice")
    panel = lambda rows: rows.groupBy("month", "priority").agg(F.count("*").alias("n"), r6(money_mean("o_totalprice")).alias("value"))
    path = f"{folder(spark)}/panel-{uuid.uuid4().hex}"
    extracts.refresh(spark, path, "month", orders, lambda months: panel(orders.where(F.col("month").isin(months))), ["month", "priority"])
    doubled = (F.col("month") == "1996-03-01") & (F.col("o_orderstatus") == "F")
    gone = (F.col("month") == "1997-05-01") & (F.col("priority") == "5-LOW")
    changes = orders.where(doubled | gone)
    now = orders.where(~gone).withColumn("o_totalprice", F.when(doubled, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    return extracts.refresh(spark, path, "month", changes, lambda months: panel(now.where(F.col("month").isin(months))), ["month", "priority"])


#: Tables whose extracts are read back: all of numbers, codes and times.
KEPT = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, kind, cells, cells AS survive FROM (SELECT count(*) AS cells FROM {t}), (VALUES "
        + ", ".join(f"('{c.split(' ')[0]}', '{KINDS[c.split(' ')[1]]}')" for c in TABLES[t].split(", ")) + ") v(column_name, kind)" for t in KEPT)
)
def preserved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts are written as text, read back, and every cell of every column held against its source, by line number: 43 columns of eight tables, by what their text stands for. The text is packed; each file is read by one task, packed or not."""
    out = []
    for name in KEPT:
        rows = numbering.line_numbers(table(spark, sf_dir, name))
        path, kinds = f"{folder(spark)}/{name}-{uuid.uuid4().hex}", dict(rows.dtypes)
        as_text = lambda c, k: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if k.startswith("timestamp") else F.col(c).cast("string")
        rows.select([as_text(c, k).alias(c) for c, k in kinds.items()]).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
        cells = {c: F.nullif(F.col(c), F.lit("")).try_cast(k) for c, k in kinds.items() if c != "line_number"}
        registered = {c.split(" ")[0]: KINDS[c.split(" ")[1]] for c in TABLES[name].split(", ")}
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in registered.items() for x in pair]), F.col("column_name"))
        back = extracts.reread(scan_text(spark, path, list(kinds)), rows, ["line_number"], cells)
        out.append(back.select(F.lit(name).alias("table_name"), "column_name", kind.alias("kind"), "cells", "survive"))
    return reduce(DataFrame.unionByName, out)


@query(
    """SELECT event_type, count(*) AS n, count(number) AS numbers, count(*) FILTER (number = 0) AS zeros, sum(number) AS total FROM (
    SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0 ELSE event_id END::DECIMAL(18,0) AS number FROM events) GROUP BY event_type"""
)
def safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells are absent and never zero; the other cells of a text column are numbers."""
    cell = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "0").otherwise(F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_type", labels.safe_number(cell, "decimal(18,0)").alias("number"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("number").alias("numbers"), F.count_if(F.col("number") == 0).alias("zeros"), F.sum("number").alias("total"))


@query(
    """SELECT name, expected, found FROM (VALUES ('region', 5), ('nation', 24)) e(name, expected) FULL JOIN (SELECT 'region' AS name, count(*) AS found FROM region UNION ALL SELECT 'nation', count(*) FROM nation
    UNION ALL SELECT 'part', count(*) FROM part) f USING (name) WHERE expected IS DISTINCT FROM found"""
)
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs whose rows are not as many as a manifest expects, or that only one side has."""
    expected = spark.createDataFrame([("region", 5), ("nation", 24)], "name string, rows long")
    return extracts.count_differences({n: table(spark, sf_dir, n) for n in ("region", "nation", "part")}, expected)


@query("SELECT o_orderpriority AS priority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderpriority <> '5-LOW' GROUP BY ALL HAVING count(*) >= 3")
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement whose values are bound by name and never written into its text; so is the table."""
    text = """SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {orders}
    WHERE o_orderdate >= :since AND o_orderpriority <> :out GROUP BY o_orderpriority HAVING count(*) >= :least"""
    return spark.sql(text, args={"since": "1996-01-01", "out": "5-LOW", "least": 3}, orders=table(spark, sf_dir, "orders"))
