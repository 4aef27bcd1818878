"""Mart queries: geography, panel, spreads, premiums, cross-sections, series summaries, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import coverage, ranking
from ledgerline.operators import publication as pub
from ledgerline.plans.publications import valid
from ledgerline.plans.stand_in import FIRST_YEAR, LAST_YEAR, LATEST, MONTHLY, PUBLISHED, YEARLY, monthly, placed_orders, places, published, query, r6, yearly
from ledgerline.sources.scratch import cut
from ledgerline.sources.tables import table

METRICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    """SELECT geography_type, geography_name, zone, is_aggregate FROM (
    SELECT 'STATE' AS geography_type, n_name AS geography_name, r_name AS zone, false AS is_aggregate FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'ZONE', r_name, r_name, true FROM region UNION ALL SELECT 'NATIONAL', 'ALL', NULL, true)"""
)
def geography_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    state = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.lit("STATE").alias("geography_type"), F.col("n_name").alias("geography_name"), F.col("r_name").alias("zone"), F.lit(False).alias("is_aggregate"))
    zone = region.select(F.lit("ZONE").alias("geography_type"), F.col("r_name").alias("geography_name"), F.col("r_name").alias("zone"), F.lit(True).alias("is_aggregate"))
    whole = spark.range(1).select(F.lit("NATIONAL").alias("geography_type"), F.lit("ALL").alias("geography_name"), F.lit(None).cast("string").alias("zone"), F.lit(True).alias("is_aggregate"))
    return state.unionByName(zone).unionByName(whole)


@query(
    """SELECT entity, zone, metric, month, round(value, 6) AS value, month >= w.lo AND month <= w.hi AS in_window FROM monthly,
    (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT metric, min(month) AS lo, max(month) AS hi FROM monthly GROUP BY metric)) w""",
    MONTHLY,
)
def cost_panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = monthly(spark, sf_dir)
    window = pub.common_window(panel.groupBy("metric").agg(F.min("month").alias("lo"), F.max("month").alias("hi")), "lo", "hi")
    return panel.crossJoin(window).select("entity", "zone", "metric", "month", r6("value").alias("value"), F.col("month").between(F.col("window_start"), F.col("window_end")).alias("in_window"))


@query(
    "SELECT entity, month, " + ", ".join(f"""round(max(value) FILTER (WHERE metric = '{m}'), 6) AS m{i}""" for i, m in enumerate(METRICS, 1)) + " FROM monthly GROUP BY entity, month",
    MONTHLY,
)
def cost_panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduced to one row a cell first, then turned; the column list is fixed, so no pass looks for it."""
    wide = monthly(spark, sf_dir).groupBy("entity", "month").pivot("metric", METRICS).agg(F.max("value"))
    return wide.select("entity", "month", *[r6(F.col(f"`{m}`")).alias(f"m{i}") for i, m in enumerate(METRICS, 1)])


@query("SELECT entity, zone, metric, month, round(value, 6) AS value FROM monthly WHERE metric LIKE '1%' OR metric IN ('2-HIGH', '5-LOW')", MONTHLY)
def rates_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = monthly(spark, sf_dir).where(F.col("metric").like("1%") | F.col("metric").isin("2-HIGH", "5-LOW"))
    return kept.select("entity", "zone", "metric", "month", r6("value").alias("value"))


@query(
    """SELECT metric, year, count(*) AS entities, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, round(max(value) - min(value), 6) AS spread,
    round(avg(value), 6) AS mean, arg_min(entity, (value, entity)) AS cheapest, arg_max(entity, (value, entity)) AS dearest,
    arg_min(zone, (value, entity)) AS cheapest_zone, arg_max(zone, (value, entity)) AS dearest_zone FROM yearly GROUP BY metric, year""",
    YEARLY,
)
def price_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("value", "entity")
    return yearly(spark, sf_dir).groupBy("metric", "year").agg(
        F.count("*").alias("entities"), r6(F.min("value")).alias("lowest"), r6(F.max("value")).alias("highest"), r6(F.max("value") - F.min("value")).alias("spread"),
        r6(F.avg("value")).alias("mean"), F.min_by("entity", key).alias("cheapest"), F.max_by("entity", key).alias("dearest"), F.min_by("zone", key).alias("cheapest_zone"), F.max_by("zone", key).alias("dearest_zone"),
    )


ITEMS = """items AS (SELECT p_type AS item, entity, zone, date_trunc('month', o_orderdate)::DATE AS obs, date_trunc('month', l_shipdate)::DATE AS rel, l_extendedprice AS price
  FROM lineitem JOIN placed ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE date_trunc('month', l_shipdate) >= date_trunc('month', o_orderdate)),
zonal AS (SELECT item, zone, obs, rel, sum(price::DECIMAL(18,2))::DOUBLE / count(*) AS value FROM items GROUP BY ALL),
overall AS (SELECT item, obs, rel, sum(price::DECIMAL(18,2))::DOUBLE / count(*) AS value FROM items GROUP BY ALL)"""
PREMIUM = "round(z.value, 6) AS zone_value, round(o.value, 6) AS national_value, round(100 * (z.value / nullif(o.value, 0) - 1), 6) AS premium_pct"


def item_prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Item prices by zone and overall, per observation and release month."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", F.trunc("l_shipdate", "MM").alias("rel"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("item"))
    orders = placed_orders(spark, sf_dir).select("o_orderkey", "zone", F.trunc("o_orderdate", "MM").alias("obs"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("rel >= obs").join(part, F.col("l_partkey") == F.col("p_partkey"))
    base = rows.groupBy("item", "zone", "obs", "rel").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"), F.count("*").alias("n"))
    mean = lambda total, n: (total.cast("double") / n).alias("value")
    zonal = base.select("item", "zone", "obs", "rel", mean(F.col("total"), F.col("n")))
    return zonal, base.groupBy("item", "obs", "rel").agg(mean(F.sum("total"), F.sum("n")))  # from the zones' exact sums: the lines are read once


def premium(zonal: DataFrame, overall: DataFrame, keys: list[str]) -> DataFrame:
    joined = zonal.withColumnRenamed("value", "z").join(overall.withColumnRenamed("value", "o"), keys, "left")
    return joined.withColumns({"zone_value": r6("z"), "national_value": r6("o"), "premium_pct": r6(100 * (F.try_divide("z", "o") - 1))}).drop("z", "o")


@query(f"SELECT z.item, z.zone, z.obs, {PREMIUM} FROM zonal z LEFT JOIN overall o ON z.item = o.item AND z.obs = o.obs AND o.rel = o.obs WHERE z.rel = z.obs", PUBLISHED, ITEMS)
def zone_vs_national_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    zonal, overall = item_prices(spark, sf_dir)
    return premium(pub.primary(zonal).drop("rel"), pub.primary(overall).drop("rel"), ["item", "obs"])


@query(
    f"""SELECT z.item, z.zone, z.obs, z.rel AS zone_release, o.rel AS national_release, {PREMIUM}
    FROM (SELECT * FROM zonal QUALIFY row_number() OVER (PARTITION BY item, zone, obs ORDER BY rel DESC) = 1) z
    LEFT JOIN (SELECT * FROM overall QUALIFY row_number() OVER (PARTITION BY item, obs ORDER BY rel DESC) = 1) o ON z.item = o.item AND z.obs = o.obs""",
    PUBLISHED, ITEMS,
)
def zone_vs_national_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    zonal, overall = item_prices(spark, sf_dir)
    z = pub.latest(zonal, ["item", "zone", "obs"], ["rel"]).withColumnRenamed("rel", "zone_release")
    return premium(z, pub.latest(overall, ["item", "obs"], ["rel"]).withColumnRenamed("rel", "national_release"), ["item", "obs"])


@query("SELECT metric, zone, month, count(*) AS entities, round(avg(value), 6) AS mean, round(min(value), 6) AS lowest, round(max(value), 6) AS highest FROM monthly GROUP BY ALL", MONTHLY)
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).groupBy("metric", "zone", "month").agg(F.count("*").alias("entities"), r6(F.avg("value")).alias("mean"), r6(F.min("value")).alias("lowest"), r6(F.max("value")).alias("highest"))


@query(
    """SELECT r_name AS zone, n_name AS entity, p_type AS band, count(*) AS n, round(median(p_retailprice), 6) AS median_price, round(quantile_cont(p_retailprice, 0.25), 6) AS p25,
    round(quantile_cont(p_retailprice, 0.75), 6) AS p75 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def band_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = sold.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    keys = ["zone", "entity", "band"]
    rows = cut(rows.select("zone", "entity", F.col("p_type").alias("band"), "p_retailprice"), "band-prices")  # read three times
    found = ranking.quantiles(rows, keys, "p_retailprice", {"median_price": 0.5, "p25": 0.25, "p75": 0.75})
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(found, keys, "left").select(*keys, "n", *[r6(c).alias(c) for c in ("median_price", "p25", "p75")])


@query(
    """SELECT event_type, date_trunc('month', ts)::DATE AS month, count(*) AS n, round(sum(value::DECIMAL(18,6))::DOUBLE / count(*), 6) AS mean, min(value) AS lowest, max(value) AS highest,
    arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE value IS NOT NULL GROUP BY ALL"""
)
def fx_monthly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = table(spark, sf_dir, "events").where("value IS NOT NULL"), F.struct("ts", "event_id")
    return rows.groupBy("event_type", F.trunc("ts", "MM").alias("month")).agg(
        F.count("*").alias("n"), r6(F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.min_by("value", key).alias("first_value"), F.max_by("value", key).alias("last_value"),
    )


@query(
    """SELECT event_id, events.event_type, ts::DATE AS day, value, CASE WHEN value < lo THEN 'BELOW' ELSE 'ABOVE' END AS side FROM events JOIN
    (SELECT event_type, ts::DATE AS day, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events GROUP BY ALL) b
    ON events.event_type = b.event_type AND ts::DATE = b.day WHERE value NOT BETWEEN lo AND hi"""
)
def fx_band_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), "value")
    band = ranking.quantiles(rows, ["event_type", "day"], "value", {"lo": 0.1, "hi": 0.9})
    out = rows.join(band, ["event_type", "day"]).where(~F.col("value").between(F.col("lo"), F.col("hi")))
    return out.select("event_id", "event_type", "day", "value", F.when(F.col("value") < F.col("lo"), "BELOW").otherwise("ABOVE").alias("side"))


FLAG_SQL = "concat_ws('|', CASE WHEN l_discount > 0.08 THEN 'DEEP_DISCOUNT' END, CASE WHEN l_quantity > 45 THEN 'BULK' END, CASE WHEN l_tax > 0.07 THEN 'HIGH_TAX' END)"


def anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its source_anomaly text."""
    when = lambda c, name: F.when(c, name)
    text = F.concat_ws("|", when(F.col("l_discount") > 0.08, "DEEP_DISCOUNT"), when(F.col("l_quantity") > 45, "BULK"), when(F.col("l_tax") > 0.07, "HIGH_TAX"))
    return table(spark, sf_dir, "lineitem").withColumn("source_anomaly", text)


FLAG_NAMES = "(VALUES ('DEEP_DISCOUNT', 'price'), ('BULK', 'volume'), ('HIGH_TAX', 'price')) f(flag, family)"


@query(
    f"""SELECT family, flag, l_returnflag AS dataset, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM
    (SELECT l_returnflag, l_orderkey, unnest(string_split(source_anomaly, '|')) AS flag FROM (SELECT *, {FLAG_SQL} AS source_anomaly FROM lineitem) WHERE source_anomaly <> '')
    JOIN {FLAG_NAMES} USING (flag) GROUP BY ALL"""
)
def anomaly_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = anomaly_flags(spark, sf_dir).where("source_anomaly <> ''").select("l_returnflag", "l_orderkey", F.explode(labels.flags(F.col("source_anomaly"))).alias("flag"))
    names = spark.createDataFrame([("DEEP_DISCOUNT", "price"), ("BULK", "volume"), ("HIGH_TAX", "price")], "flag string, family string")
    found = coverage.counted(exploded.withColumnRenamed("l_returnflag", "dataset"), ["flag", "dataset"], ["l_orderkey"], "orders")
    return found.join(names, "flag").select("family", "flag", "dataset", "n", "orders")


@query(f"SELECT obs, count(*) AS entities, round(avg(value), 6) AS mean_latest FROM latest WHERE year(obs) BETWEEN {FIRST_YEAR} AND {LAST_YEAR} GROUP BY obs", PUBLISHED, LATEST)
def latest_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pub.latest(valid(spark, sf_dir), ["entity", "obs"], ["rel"]).where(F.year("obs").between(FIRST_YEAR, LAST_YEAR))
    return rows.groupBy("obs").agg(F.count("*").alias("entities"), r6(F.avg("value")).alias("mean_latest"))


@query("SELECT entity, obs, count(*) AS rows_by_entity, sum(n)::BIGINT AS lines FROM published GROUP BY ALL", PUBLISHED)
def published_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).groupBy("entity", "obs").agg(F.count("*").alias("rows_by_entity"), F.sum("n").alias("lines"))
