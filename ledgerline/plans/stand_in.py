"""The observation panel over the star-schema tables.

Entity = nation, zone = region, metric = order priority, observation period = order month, release
period = ship month. Everything is reduced to these grains by one partial aggregate before any join
with itself, window or pivot: entities x periods x metrics don't grow with the rows. Averages of money
are exact decimal sums over counts, so they don't depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a function under its name, and its SQL with the common table expressions that it needs."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"WITH {', '.join(ctes)}\n" if ctes else "") + sql.strip()
        return f

    return put


#: The two halves of the zones, the months and years that bound the windows.
SOUTH = ["ASIA", "AFRICA"]
FIRST_YEAR, LAST_YEAR = 1995, 2000
HIGH, LOW, PERSISTENT, LEAST_PERIODS, STABLE = 0.75, 0.25, 0.80, 5, 1.0


def money_mean(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count("*")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, entity, zone): the resolved geography."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("entity"), F.col("r_name").alias("zone"))


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, zone, metric, month, n, value)."""
    rows = placed_orders(spark, sf_dir).select("entity", "zone", F.col("o_orderpriority").alias("metric"), F.trunc("o_orderdate", "MM").alias("month"), "o_totalprice")
    return rows.groupBy("entity", "zone", "metric", "month").agg(F.count("*").alias("n"), money_mean("o_totalprice").alias("value"))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, zone, metric, year, n, value)."""
    rows = placed_orders(spark, sf_dir).select("entity", "zone", F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return rows.groupBy("entity", "zone", "metric", "year").agg(F.count("*").alias("n"), money_mean("o_totalprice").alias("value"))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, zone, obs, rel, n, value): one publication per entity, observation and release month."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.trunc("l_shipdate", "MM").alias("rel"))
    orders = placed_orders(spark, sf_dir).select("o_orderkey", "entity", "zone", F.trunc("o_orderdate", "MM").alias("obs"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("entity", "zone", "obs", "rel").agg(F.count("*").alias("n"), money_mean("l_extendedprice").alias("value"))


PLACED = """placed AS (SELECT orders.*, n_name AS entity, r_name AS zone FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MONTHLY = PLACED + """, monthly AS (SELECT entity, zone, o_orderpriority AS metric, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS value FROM placed GROUP BY ALL)"""
YEARLY = PLACED + """, yearly AS (SELECT entity, zone, o_orderpriority AS metric, year(o_orderdate)::INT AS year, count(*) AS n,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS value FROM placed GROUP BY ALL)"""
PUBLISHED = PLACED + """, published AS (SELECT entity, zone, date_trunc('month', o_orderdate)::DATE AS obs, date_trunc('month', l_shipdate)::DATE AS rel, count(*) AS n,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*) AS value FROM lineitem JOIN placed ON l_orderkey = o_orderkey GROUP BY ALL)"""
LATEST = "latest AS (SELECT entity, zone, obs, rel, n, value FROM published WHERE rel >= obs QUALIFY row_number() OVER (PARTITION BY entity, obs ORDER BY rel DESC) = 1)"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
