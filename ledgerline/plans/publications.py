"""Publication queries: versions, windows, stability, overlaps, duplicates, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import coverage
from ledgerline.operators import publication as pub
from ledgerline.plans.stand_in import LATEST, MONTHLY, PUBLISHED, monthly, placed_orders, published, query, r6
from ledgerline.sources.tables import table


def month_index() -> Column:
    """A month's whole number."""
    return 12 * F.year("month") + F.month("month") - 1


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications that don't precede what they observe."""
    return published(spark, sf_dir).where("rel >= obs")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid publications with is_primary: the first release of the observation."""
    rows = valid(spark, sf_dir)
    first = rows.groupBy("entity", "obs").agg(F.min("rel").alias("first_rel"))
    return rows.join(first, ["entity", "obs"]).withColumn("is_primary", F.col("rel") == F.col("first_rel")).drop("first_rel")


FLAGGED = "flagged AS (SELECT *, rel = min(rel) OVER (PARTITION BY entity, obs) AS is_primary FROM published WHERE rel >= obs)"


@query("SELECT entity, zone, obs, rel, n, round(value, 6) AS value FROM flagged WHERE is_primary", PUBLISHED, FLAGGED)
def primary_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).where("is_primary").select("entity", "zone", "obs", "rel", "n", r6("value").alias("value"))


@query("SELECT entity, zone, obs, rel, n, round(value, 6) AS value FROM published WHERE rel = obs", PUBLISHED)
def primary_by_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pub.primary(published(spark, sf_dir)).withColumn("value", r6("value"))


@query("SELECT entity, zone, obs, rel, n, round(value, 6) AS value FROM latest", PUBLISHED, LATEST)
def latest_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pub.latest(valid(spark, sf_dir), ["entity", "obs"], ["rel"]).select("entity", "zone", "obs", "rel", "n", r6("value").alias("value"))


@query(
    """SELECT entity, date_trunc('month', o_orderdate)::DATE AS obs, date_trunc('month', l_shipdate)::DATE AS rel, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
    FROM lineitem JOIN placed ON l_orderkey = o_orderkey WHERE date_trunc('month', l_shipdate) >= date_trunc('month', o_orderdate)
    QUALIFY row_number() OVER (PARTITION BY entity, obs ORDER BY rel DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
    PUBLISHED,
)
def latest_restatement_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.trunc("l_shipdate", "MM").alias("rel"))
    orders = placed_orders(spark, sf_dir).select("o_orderkey", "entity", F.trunc("o_orderdate", "MM").alias("obs"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("rel >= obs").drop("o_orderkey")
    return pub.latest(rows, ["entity", "obs"], ["rel", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


WINDOWS = """windows AS (SELECT zone, min(obs) AS first_any, max(obs) AS last_any, min(obs) FILTER (WHERE is_primary) AS first_primary,
  max(obs) FILTER (WHERE is_primary) AS last_primary FROM flagged GROUP BY zone)"""


@query("SELECT * FROM windows", PUBLISHED, FLAGGED, WINDOWS)
def dataset_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pub.windows(flagged(spark, sf_dir), "zone", F.col("is_primary"))


@query(
    """SELECT kind, window_start, window_end, (datediff('month', window_start, window_end) + 1)::INT AS months FROM (
    SELECT 'AVAILABLE' AS kind, max(first_any) AS window_start, min(last_any) AS window_end FROM windows
    UNION ALL SELECT 'PRIMARY', max(first_primary), min(last_primary) FROM windows)""",
    PUBLISHED, FLAGGED, WINDOWS,
)
def analysis_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = pub.windows(flagged(spark, sf_dir), "zone", F.col("is_primary"))
    both = [pub.common_window(per, f"first_{k}", f"last_{k}").withColumn("kind", F.lit(label)) for k, label in (("any", "AVAILABLE"), ("primary", "PRIMARY"))]
    return both[0].unionByName(both[1])


@query(
    """SELECT entity, obs, count(*) AS publications, count(DISTINCT value) AS distinct_values, round(max(value) - min(value), 6) AS value_range,
    min(rel) AS first_release, max(rel) AS last_release FROM published WHERE rel >= obs GROUP BY ALL HAVING count(*) > 1""",
    PUBLISHED,
)
def cross_release_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pub.stability(valid(spark, sf_dir), ["entity", "obs"]).withColumn("value_range", r6("value_range"))


@query(
    """SELECT a.entity, months AS lag_months, CASE WHEN a.value = b.value THEN 'IDENTICAL' WHEN abs(a.value - b.value) / abs(b.value) < 1e-12 THEN 'PRECISION_ONLY'
    WHEN abs(a.value - b.value) / abs(b.value) >= 0.5 THEN 'KNOWN_CONFLICT' ELSE 'SUBSTANTIVE' END AS kind, count(*) AS n
    FROM published a JOIN published b ON a.entity = b.entity AND a.obs = b.obs, (VALUES (1), (12)) v(months)
    WHERE a.rel >= a.obs AND b.rel >= b.obs AND a.rel = b.rel + to_months(months) GROUP BY ALL""",
    PUBLISHED,
)
def overlap_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pub.overlap(valid(spark, sf_dir), ["entity", "obs"], [1, 12]).groupBy("entity", "lag_months", "kind").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) AS n_signatures,
    CASE WHEN count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) = 1 THEN 'EXACT_DUPLICATE' ELSE 'CONFLICT' END AS kind
    FROM lineitem GROUP BY ALL HAVING count(*) > 1"""
)
def exact_duplicate_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pub.duplicate_kinds(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])


@query(
    """SELECT dataset, month, count(*) AS n FROM (SELECT 'orders' AS dataset, date_trunc('month', o_orderdate)::DATE AS month FROM orders
    UNION ALL SELECT 'lineitem', date_trunc('month', l_shipdate)::DATE FROM lineitem UNION ALL SELECT 'events', date_trunc('month', ts)::DATE FROM events) GROUP BY ALL"""
)
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, c: table(spark, sf_dir, name).groupBy(F.trunc(c, "MM").alias("month")).agg(F.count("*").alias("n")).withColumn("dataset", F.lit(name))
    return reduce(DataFrame.unionByName, [one("orders", "o_orderdate"), one("lineitem", "l_shipdate"), one("events", "ts")])


@query(
    """SELECT entity, metric, month FROM (SELECT DISTINCT entity, metric FROM monthly),
    (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM monthly)
    EXCEPT SELECT entity, metric, month FROM monthly""",
    MONTHLY,
)
def named_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that a series lacks, from its bitmap of months."""
    rows = monthly(spark, sf_dir).select("entity", "metric", month_index().alias("i"))
    span = rows.agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    gaps = coverage.missing(coverage.bitmaps(rows, ["entity", "metric"], F.col("i")).crossJoin(span), F.col("lo"), F.col("hi"))
    at = F.col("index").cast("int")
    return gaps.select("entity", "metric", F.make_date(F.floor(at / 12).cast("int"), at % 12 + 1, F.lit(1)).alias("month"))


@query(
    """SELECT metric, count(*) AS n_rows, count(DISTINCT entity) AS entities, count(DISTINCT month) AS months,
    count(DISTINCT entity) * count(DISTINCT month) AS expected, count(DISTINCT entity) * count(DISTINCT month) - count(*) AS missing FROM monthly GROUP BY metric""",
    MONTHLY,
)
def completeness_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, entities and months of each metric against the full grid, counted in the bitmaps of its series."""
    series = coverage.bitmaps(monthly(spark, sf_dir).select("entity", "metric", month_index().alias("i")), ["entity", "metric"], F.col("i"))
    rows = series.groupBy("metric").agg(F.sum(coverage.present(F.col("words"))).alias("n_rows"), F.count("*").alias("entities"))
    words = series.select("metric", F.explode("words").alias("word", "bits")).groupBy("metric", "word").agg(F.bit_or("bits").alias("bits"))
    counts = rows.join(words.groupBy("metric").agg(F.sum(F.bit_count("bits")).alias("months")), "metric")
    return counts.select("metric", "n_rows", "entities", "months").withColumn("expected", F.col("entities") * F.col("months")).withColumn("missing", F.col("expected") - F.col("n_rows"))


@query(
    """SELECT obs, count(*) AS before_rows, count(*) + 1 AS after_rows, round(max(value), 6) AS before_top, round(max(value) * 2, 6) AS restated_top
    FROM latest GROUP BY obs""",
    PUBLISHED, LATEST,
)
def restatement_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restatement of the dearest entity of each month at twice its value is added as a later release: it becomes the latest, and the rows of the month grow by one."""
    rows = valid(spark, sf_dir)
    now = pub.latest(rows, ["entity", "obs"], ["rel"])
    top = now.groupBy("obs").agg(F.max(F.struct("value", "entity", "zone", "n", "rel")).alias("t"))
    synthetic = top.select(F.col("t.entity").alias("entity"), F.col("t.zone").alias("zone"), "obs", F.add_months("t.rel", 1).alias("rel"), F.col("t.n").alias("n"), (2 * F.col("t.value")).alias("value"))
    both = now.select(*rows.columns).unionByName(synthetic)
    after = pub.latest(both, ["entity", "obs"], ["rel"]).groupBy("obs").agg(F.max("value").alias("restated_top"))
    counts = both.groupBy("obs").agg(F.count("*").alias("after_rows"))
    before = now.groupBy("obs").agg(F.count("*").alias("before_rows"), F.max("value").alias("before_top"))
    return before.join(counts, "obs").join(after, "obs").select("obs", "before_rows", "after_rows", r6("before_top").alias("before_top"), r6("restated_top").alias("restated_top"))
