"""Queries over several fact tables at once: a panel of metric codes, stability of publications, anomalies with a bridge.

Each fact table is reduced to its grain first; only the small results are put together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import constraints, coverage
from ledgerline.operators import publication as pub
from ledgerline.plans.stand_in import places, query, r6
from ledgerline.sources.tables import table

BUYERS = """buyers AS (SELECT c_custkey, n_name AS entity FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
SELLERS = """sellers AS (SELECT s_suppkey, n_name AS seller FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
LINES = """lines AS (SELECT lineitem.*, entity, seller, date_trunc('month', o_orderdate)::DATE AS obs, date_trunc('month', l_shipdate)::DATE AS rel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN buyers ON o_custkey = c_custkey JOIN sellers ON l_suppkey = s_suppkey)"""


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return customer.join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "entity")


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return supplier.join(places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("entity").alias("seller"))


def exact_mean(column: str) -> Column:
    """Mean of a column with two to six decimals, whatever the order of addition."""
    return F.sum(F.col(column).cast("decimal(18,6)")).cast("double") / F.count(column)


def _coded(rows: DataFrame, dataset: str, kind: str, measures: list[tuple[str, str, str]]) -> DataFrame:
    """A fact table in panel form: one row for each entity, metric code and month, from one aggregate over all its measures (unit, prefix, column)."""
    name = F.upper(F.regexp_replace(kind, "[^A-Za-z0-9]+", "_"))
    sums = [F.struct(F.count(c).alias("n"), exact_mean(c).alias("value")).alias(f"m{i}") for i, (_, _, c) in enumerate(measures)]
    grain = rows.groupBy(name.alias("name"), "entity", "month").agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(unit).alias("unit"), F.lit(prefix).alias("prefix"), F.col(f"m{i}.n").alias("n"), F.col(f"m{i}.value").alias("value")) for i, (unit, prefix, _) in enumerate(measures)]))
    rows = grain.select("name", "entity", "month", each.alias("x"))
    return rows.select(F.lit(dataset).alias("dataset"), F.concat("x.prefix", "name").alias("metric_code"), "x.unit", "entity", "month", "x.n", "x.value")


def union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, metric_code, unit, entity, month, n, value) of orders, lines and events: 5 + 3 + 3 + 5 metric codes."""
    who = buyers(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select("entity", F.trunc("o_orderdate", "MM").alias("month"), "o_orderpriority", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").join(sellers(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("seller").alias("entity"), F.trunc("l_shipdate", "MM").alias("month"), "l_returnflag", "l_extendedprice", "l_discount")
    events = table(spark, sf_dir, "events").join(who, F.col("user_id") == F.col("c_custkey")).select("entity", F.trunc("ts", "MM").alias("month"), "event_type", "value")
    return reduce(DataFrame.unionByName, [
        _coded(orders, "orders", "o_orderpriority", [("MONEY", "ORDER_", "o_totalprice")]), _coded(events, "events", "event_type", [("INDEX", "EVENT_", "value")]),
        _coded(lines, "lineitem", "l_returnflag", [("MONEY", "PRICE_", "l_extendedprice"), ("RATE", "DISCOUNT_", "l_discount")])])


def _coded_sql(dataset: str, unit: str, prefix: str, kind: str, value: str, source: str, entity: str, day: str) -> str:
    return (
        f"SELECT '{dataset}' AS dataset, '{prefix}' || upper(regexp_replace({kind}, '[^A-Za-z0-9]+', '_', 'g')) AS metric_code, '{unit}' AS unit, {entity} AS entity, date_trunc('month', {day})::DATE AS month, "
        f"count({value}) AS n, sum({value}::DECIMAL(18,6))::DOUBLE / count({value}) AS value FROM {source} GROUP BY ALL"
    )


BOUGHT, SOLD, SEEN = "orders JOIN buyers ON o_custkey = c_custkey", "lineitem JOIN sellers ON l_suppkey = s_suppkey", "events JOIN buyers ON user_id = c_custkey"
UNION_PANEL = "panel AS ({})".format(" UNION ALL ".join([
    _coded_sql("orders", "MONEY", "ORDER_", "o_orderpriority", "o_totalprice", BOUGHT, "entity", "o_orderdate"),
    _coded_sql("lineitem", "MONEY", "PRICE_", "l_returnflag", "l_extendedprice", SOLD, "seller", "l_shipdate"),
    _coded_sql("lineitem", "RATE", "DISCOUNT_", "l_returnflag", "l_discount", SOLD, "seller", "l_shipdate"),
    _coded_sql("events", "INDEX", "EVENT_", "event_type", "value", SEEN, "entity", "ts")]))


@query("SELECT dataset, metric_code, unit, entity, month, n, round(value, 6) AS value FROM panel", BUYERS, SELLERS, UNION_PANEL)
def union_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_rows(spark, sf_dir).withColumn("value", r6("value"))


@query(
    """SELECT metric_code, count(*) AS n_rows, count(DISTINCT (entity, month)) AS cells, count(*) - count(DISTINCT (entity, month)) AS duplicates, count(DISTINCT unit) AS units,
    count(DISTINCT dataset) AS datasets FROM panel GROUP BY metric_code""",
    BUYERS, SELLERS, UNION_PANEL,
)
def union_panel_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's grain is entity, metric code and month; a metric code has one unit and one dataset."""
    rows, cells = union_rows(spark, sf_dir), F.countDistinct(F.struct("entity", "month"))
    return rows.groupBy("metric_code").agg(F.count("*").alias("n_rows"), cells.alias("cells"), (F.count("*") - cells).alias("duplicates"), F.countDistinct("unit").alias("units"), F.countDistinct("dataset").alias("datasets"))


#: Measures that each line publishes, and the side that it is published for.
MEASURES = {"PRICE": "l_extendedprice", "QUANTITY": "l_quantity", "DISCOUNT": "l_discount", "TAX": "l_tax"}


def publications_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, entity, obs, rel, value): eight datasets, four measures for buyers and sellers, from one pass over the joined lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", *MEASURES.values(), F.trunc("l_shipdate", "MM").alias("rel"))
    orders = table(spark, sf_dir, "orders").join(buyers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "entity", F.trunc("o_orderdate", "MM").alias("obs"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).where("rel >= obs")
    side = F.explode(F.array(F.struct(F.lit("BUYER").alias("side"), F.col("entity").alias("entity")), F.struct(F.lit("SELLER").alias("side"), F.col("seller").alias("entity"))))
    grain = rows.select("obs", "rel", *MEASURES.values(), side.alias("x")).groupBy("x.side", "x.entity", "obs", "rel").agg(*[exact_mean(c).alias(m) for m, c in MEASURES.items()])
    long = grain.unpivot(["side", "entity", "obs", "rel"], list(MEASURES), "measure", "value")
    return long.select(F.concat_ws("_", "measure", F.lit("BY"), "side").alias("dataset"), "entity", "obs", "rel", "value")


PUBLISHED_ALL = "published_all AS ({})".format(" UNION ALL ".join(
    f"SELECT '{m}_BY_{side}' AS dataset, {e} AS entity, obs, rel, sum({c}::DECIMAL(18,6))::DOUBLE / count({c}) AS value FROM lines WHERE rel >= obs GROUP BY ALL"
    for m, c in MEASURES.items() for side, e in (("BUYER", "entity"), ("SELLER", "seller"))))


@query(
    """SELECT dataset, entity, obs, count(*) AS publications, count(DISTINCT value) AS distinct_values, round(max(value) - min(value), 6) AS value_range, min(rel) AS first_release, max(rel) AS last_release
    FROM published_all GROUP BY ALL HAVING count(*) > 1""",
    BUYERS, SELLERS, LINES, PUBLISHED_ALL,
)
def union_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pub.stability(publications_of_all(spark, sf_dir), ["dataset", "entity", "obs"]).withColumn("value_range", r6("value_range"))


#: Flags: dataset, key columns, and the condition of each flag, which Spark and the SQL both read.
FLAGS = {
    "orders": (["o_orderkey"], {"HIGH_TOTAL": "o_totalprice > 450000", "UNFILLED": "o_orderstatus = 'P'"}),
    "lineitem": (["l_orderkey", "l_linenumber"], {"DEEP_DISCOUNT": "l_discount > 0.08", "BULK": "l_quantity > 45", "HIGH_TAX": "l_tax > 0.07"}),
    "events": (["event_id"], {"NO_VALUE": "value IS NULL", "SMALL_VALUE": "value < 1", "HIGH_TOTAL": "value > 400"}),
}
FAMILIES = {"HIGH_TOTAL": "level", "SMALL_VALUE": "level", "NO_VALUE": "missing", "UNFILLED": "missing", "DEEP_DISCOUNT": "price", "HIGH_TAX": "price", "BULK": "volume"}


def bridge(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    """(dataset, keys, flag): one row for each flag of each flagged fact of a dataset, as the facts' own text has them."""
    keys, conditions = FLAGS[dataset]
    text = F.concat_ws("|", *[F.when(F.expr(c), name) for name, c in conditions.items()])
    rows = table(spark, sf_dir, dataset).select(F.lit(dataset).alias("dataset"), *keys, text.alias("source_anomaly")).where("source_anomaly <> ''")
    return rows.select("dataset", *keys, F.explode(labels.flags(F.col("source_anomaly"))).alias("flag"))


BRIDGE = "bridge AS ({})".format(" UNION ALL ".join(
    f"SELECT '{d}' AS dataset, concat_ws(':', {', '.join(keys)}) AS key, '{name}' AS flag FROM {d} WHERE {c}" for d, (keys, conditions) in FLAGS.items() for name, c in conditions.items()))
FAMILY_SQL = "families(flag, family) AS (VALUES {})".format(", ".join(f"('{f}', '{x}')" for f, x in FAMILIES.items()))


@query("SELECT family, flag, dataset, count(*) AS n, count(DISTINCT key) AS facts FROM bridge JOIN families USING (flag) GROUP BY ALL", BRIDGE, FAMILY_SQL)
def union_anomaly_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(FAMILIES.items()), "flag string, family string")
    found = [coverage.counted(bridge(spark, sf_dir, dataset), ["flag", "dataset"], keys, "facts", F.concat_ws(":", *keys)) for dataset, (keys, _) in FLAGS.items()]
    return reduce(DataFrame.unionByName, found).join(names, "flag").select("family", "flag", "dataset", "n", "facts")


EVENT_KEY = ["user_id", "event_type", "month"]


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, date_trunc('month', ts)::DATE AS month, floor(value / 50)::BIGINT AS level FROM events),
    k AS (SELECT user_id, event_type, month, count(DISTINCT coalesce(level, -1)) AS levels, min(event_id) AS kept FROM e GROUP BY ALL)
    SELECT e.*, CASE WHEN levels > 1 THEN 'DATE_CONFLICT' WHEN event_id = kept THEN 'ACTIVE' ELSE 'EXACT_DUPLICATE' END AS status,
    CASE WHEN levels = 1 AND event_id <> kept THEN kept END AS duplicate_of FROM e JOIN k USING (user_id, event_type, month)"""
)
def duplicate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its status: of those with one key, the first is ACTIVE and the others repeat it if all agree in the level; if not, all are in conflict."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.trunc("ts", "MM").alias("month"), F.floor(F.col("value") / 50).alias("level"))
    return constraints.duplicate_of(rows, EVENT_KEY, ["level"], "event_id")


@query(
    """SELECT entity, obs, datediff('month', a.rel, b.rel)::INT AS months_apart, a.rel AS earlier, b.rel AS later, CASE WHEN a.value = b.value THEN 'IDENTICAL' WHEN abs(b.value - a.value) / abs(a.value) < 1e-12 THEN 'PRECISION_ONLY'
    WHEN abs(b.value - a.value) / abs(a.value) >= 0.5 THEN 'KNOWN_CONFLICT' ELSE 'SUBSTANTIVE' END AS kind
    FROM published_all a JOIN published_all b USING (dataset, entity, obs) WHERE dataset = 'PRICE_BY_BUYER' AND a.rel < b.rel""",
    BUYERS, SELLERS, LINES, PUBLISHED_ALL,
)
def release_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of releases of the same observation, and how the later one differs."""
    rows = publications_of_all(spark, sf_dir).where("dataset = 'PRICE_BY_BUYER'")
    return pub.all_pairs(rows, ["entity", "obs"]).select("entity", "obs", "months_apart", "earlier", "later", "kind")


RULES = {
    "observation_not_after_release": "date_trunc('month', o_orderdate) <= date_trunc('month', l_shipdate)",
    "discount_in_band": "l_discount BETWEEN 0 AND 0.09",
    "returned_implies_filled": "l_returnflag <> 'R' OR l_linestatus = 'F'",
    "quantity_in_band": "l_quantity BETWEEN 1 AND 49",
}


@query(
    " UNION ALL ".join(f"SELECT '{name}' AS check_name, l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT ({c}) GROUP BY ALL" for name, c in RULES.items())
)
def violating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the rows that break each rule, from one pass over the facts. What a line breaks by itself is a number before lines are sorted for the join."""
    keys, alone = ["l_orderkey", "l_linenumber"], [name for name, c in RULES.items() if "o_" not in c]
    breaks = reduce(lambda a, b: a + b, [F.when(~F.expr(RULES[name]), 1 << i).otherwise(0) for i, name in enumerate(alone)]).cast("byte")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").select(*keys, "l_shipdate", breaks.alias("breaks")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    holds = {name: F.col("breaks").bitwiseAND(F.lit(1 << alone.index(name))) == 0 if name in alone else F.expr(c) for name, c in RULES.items()}
    return constraints.offending(rows, keys, holds)


@query(
    """SELECT o_custkey, count(*) AS n_rows FROM (SELECT o_custkey, o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders WHERE o_orderstatus = 'F')
    WHERE n > 1 GROUP BY o_custkey"""
)
def partial_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique key that holds for some rows only: a customer has one filled order of each priority."""
    broken = constraints.duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "F")
    return broken.groupBy("o_custkey").agg(F.sum("n_rows").alias("n_rows"))
