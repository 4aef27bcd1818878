"""Data-quality queries: keys, references, rules, purity, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import constraints
from ledgerline.plans.mart import FLAG_SQL, anomaly_flags
from ledgerline.plans.stand_in import PUBLISHED, YEARLY, money_mean, placed_orders, published, query, r6, yearly
from ledgerline.sources.tables import TABLES, missing_columns, table


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def natural_key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT check_name, offending, offending = 0 AS ok FROM (
    SELECT 'lineitem_orders' AS check_name, count(*) AS offending FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'lineitem_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customer_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))"""
)
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]
    return constraints.report([(f"{c}_{p}", constraints.orphans(table(spark, sf_dir, c).select(k), k, table(spark, sf_dir, p), pk)) for c, k, p, pk in pairs])


@query(
    """SELECT check_name, n_rows, n_violations FROM (SELECT count(*) AS n_rows, unnest([
    {'c': 'observation_not_after_release', 'v': count(*) FILTER (WHERE NOT date_trunc('month', o_orderdate) <= date_trunc('month', l_shipdate))},
    {'c': 'positive_price', 'v': count(*) FILTER (WHERE NOT l_extendedprice > 0)},
    {'c': 'discount_in_band', 'v': count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.08)},
    {'c': 'status_domain', 'v': count(*) FILTER (WHERE NOT l_linestatus IN ('O'))},
    {'c': 'returned_implies_filled', 'v': count(*) FILTER (WHERE NOT (l_returnflag <> 'R' OR l_linestatus = 'F'))},
    {'c': 'flag_equivalence', 'v': count(*) FILTER (WHERE NOT ((l_returnflag = 'N') = (l_linestatus = 'O')))}]) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey), LATERAL (SELECT x.c AS check_name, x.v AS n_violations)"""
)
def check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return constraints.violations(rows, {
        "observation_not_after_release": F.trunc("o_orderdate", "MM") <= F.trunc("l_shipdate", "MM"),
        "positive_price": F.col("l_extendedprice") > 0,
        "discount_in_band": F.col("l_discount").between(0, 0.08),
        "status_domain": F.col("l_linestatus").isin("O"),
        "returned_implies_filled": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F"),
        "flag_equivalence": (F.col("l_returnflag") == "N") == (F.col("l_linestatus") == "O"),
    })


@query("SELECT p_brand, count(DISTINCT p_type) AS n_values FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def metric_unit_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.impure(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query(
    f"""SELECT (SELECT count(*) FROM f WHERE source_anomaly <> '') AS flagged_rows, (SELECT count(*) FROM b) AS bridge_rows, (SELECT sum(len(string_split(source_anomaly, '|')))::BIGINT FROM f WHERE source_anomaly <> '') AS expected_rows,
    (SELECT count(*) FROM b WHERE flag NOT IN ('DEEP_DISCOUNT', 'BULK', 'HIGH_TAX')) AS unknown_flags""",
    f"f AS (SELECT {FLAG_SQL} AS source_anomaly FROM lineitem)", "b AS (SELECT unnest(string_split(source_anomaly, '|')) AS flag FROM f WHERE source_anomaly <> '')",
)
def bridge_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flagged row has its bridge rows, no more and no fewer, and every flag is known."""
    facts = anomaly_flags(spark, sf_dir).select("source_anomaly").where("source_anomaly <> ''")
    a = facts.agg(F.count("*").alias("flagged_rows"), F.sum(F.size(labels.flags(F.col("source_anomaly"))).cast("long")).alias("expected_rows"))
    b = facts.select(F.explode(labels.flags(F.col("source_anomaly"))).alias("flag")).agg(F.count("*").alias("bridge_rows"), F.count_if(~F.col("flag").isin("DEEP_DISCOUNT", "BULK", "HIGH_TAX")).alias("unknown_flags"))
    return a.crossJoin(b)


@query(
    """SELECT a.metric, a.year, round(a.v, 6) AS national, round(b.v, 6) AS weighted, abs(a.v - b.v) / a.v < 1e-9 AS reconciles FROM
    (SELECT o_orderpriority AS metric, year(o_orderdate)::INT AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS v FROM placed GROUP BY ALL) a JOIN
    (SELECT metric, year, sum(value * n) / sum(n) AS v FROM (SELECT zone, metric, year, sum(n) AS n, sum(value * n) / sum(n) AS value FROM yearly GROUP BY ALL) GROUP BY ALL) b ON a.metric = b.metric AND a.year = b.year""",
    YEARLY,
)
def weighted_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall mean against the mean of zones weighted by their counts."""
    national = placed_orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("year")).agg(money_mean("o_totalprice").alias("a"))
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    zones = yearly(spark, sf_dir).groupBy("zone", "metric", "year").agg(mean.alias("value"), F.sum("n").alias("n"))
    weighted = zones.groupBy("metric", "year").agg(mean.alias("b"))
    return national.join(weighted, ["metric", "year"]).select("metric", "year", r6("a").alias("national"), r6("b").alias("weighted"), (F.abs(F.col("a") - F.col("b")) / F.col("a") < 1e-9).alias("reconciles"))


@query(
    """SELECT metric, year, round(lowest, 6) AS lowest, round(mean, 6) AS mean, round(highest, 6) AS highest, mean BETWEEN lowest AND highest AS national_in, zone_lo >= lowest AND zone_hi <= highest AS zones_in FROM
    (SELECT metric, year, min(value) AS lowest, max(value) AS highest, avg(value) AS mean FROM yearly GROUP BY ALL) JOIN
    (SELECT metric, year, min(v) AS zone_lo, max(v) AS zone_hi FROM (SELECT metric, year, zone, median(value) AS v FROM yearly GROUP BY ALL) GROUP BY ALL) USING (metric, year)""",
    YEARLY,
)
def extreme_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly(spark, sf_dir)
    ext = rows.groupBy("metric", "year").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mid"))
    zone = rows.groupBy("metric", "year", "zone").agg(F.median("value").alias("v")).groupBy("metric", "year").agg(F.min("v").alias("zlo"), F.max("v").alias("zhi"))
    out = ext.join(zone, ["metric", "year"])
    return out.select("metric", "year", r6("lo").alias("lowest"), r6("mid").alias("mean"), r6("hi").alias("highest"), F.col("mid").between(F.col("lo"), F.col("hi")).alias("national_in"), ((F.col("zlo") >= F.col("lo")) & (F.col("zhi") <= F.col("hi"))).alias("zones_in"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice::VARCHAR::DECIMAL(38,18)::DOUBLE = o_totalprice) AS survive FROM orders")
def numeric_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as text and read as decimals give the same number."""
    text = F.col("o_totalprice").cast("string")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count_if(text.try_cast("decimal(38,18)").cast("double") == F.col("o_totalprice")).alias("survive"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, 0 AS missing, count(*) AS n_rows, count(*) - count({cols.split(' ')[0]}) AS null_keys, count(DISTINCT {cols.split(' ')[0]}) AS keys FROM {t}" for t, cols in TABLES.items()))
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered columns that each table lacks, its rows, and the nulls and distinct values of its first key."""
    each = []
    for name, columns in TABLES.items():
        rows, key = table(spark, sf_dir, name), columns.split(" ")[0]
        each.append(rows.agg(F.lit(name).alias("table_name"), F.lit(len(missing_columns(rows, name))).alias("missing"), F.count("*").alias("n_rows"), F.count_if(F.col(key).isNull()).alias("null_keys"), F.countDistinct(key).alias("keys")))
    return reduce(DataFrame.unionByName, each)


@query(
    """SELECT metric, year, round(value, 6) AS value, round(prior, 6) AS prior, round(100 * (value / prior - 1), 6) AS recomputed, abs(100 * (value / prior - 1) - pct) < 1e-9 AS agrees FROM
    (SELECT metric, year, value, lag(value) OVER w AS prior, 100 * (value - lag(value) OVER w) / lag(value) OVER w AS pct FROM (SELECT metric, year, sum(n)::DOUBLE AS value FROM yearly GROUP BY ALL) WINDOW w AS (PARTITION BY metric ORDER BY year)) WHERE prior IS NOT NULL""",
    YEARLY,
)
def change_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published change against the change of the published levels."""
    w = Window.partitionBy("metric").orderBy("year")
    rows = yearly(spark, sf_dir).groupBy("metric", "year").agg(F.sum("n").cast("double").alias("value"))
    rows = rows.withColumn("prior", F.lag("value").over(w)).withColumn("pct", 100 * (F.col("value") - F.col("prior")) / F.col("prior")).where("prior IS NOT NULL")
    again = 100 * (F.col("value") / F.col("prior") - 1)
    return rows.select("metric", "year", r6("value").alias("value"), r6("prior").alias("prior"), r6(again).alias("recomputed"), (F.abs(again - F.col("pct")) < 1e-9).alias("agrees"))


@query("SELECT grain, entities, n FROM (SELECT 'ENTITY' AS grain, count(DISTINCT entity) AS entities, count(*) AS n FROM published UNION ALL SELECT 'ZONE', count(DISTINCT zone), count(DISTINCT (zone, obs, rel)) FROM published)", PUBLISHED)
def grain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at each grain; grains are counted apart and never added up."""
    rows = published(spark, sf_dir)
    a = rows.agg(F.lit("ENTITY").alias("grain"), F.countDistinct("entity").alias("entities"), F.count("*").alias("n"))
    return a.unionByName(rows.agg(F.lit("ZONE").alias("grain"), F.countDistinct("zone").alias("entities"), F.countDistinct(F.struct("zone", "obs", "rel")).alias("n")))
