"""Level, dispersion, change and rank queries over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import change, ranking
from ledgerline.plans.stand_in import FIRST_YEAR, HIGH, LAST_YEAR, LOW, MONTHLY, YEARLY, monthly, query, r6, yearly

SERIES = ["entity", "metric"]
Q = lambda p: F.percentile("value", F.lit(p))


@query(
    """SELECT metric, arg_min(med, year) AS first_median, arg_max(med, year) AS last_median, round(arg_max(med, year) - arg_min(med, year), 6) AS change,
    round(100 * (arg_max(med, year) / arg_min(med, year) - 1), 6) AS pct, min(med) AS trough, max(med) AS peak, arg_min(year, (med, year)) AS trough_year,
    arg_max(year, (med, -year)) AS peak_year, round(100 * (arg_max(med, year) / min(med) - 1), 6) AS trough_to_last_pct
    FROM (SELECT metric, year, round(median(value), 6) AS med FROM yearly GROUP BY ALL) GROUP BY metric""",
    YEARLY,
)
def level_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    med = yearly(spark, sf_dir).groupBy("metric", "year").agg(r6(Q(0.5)).alias("med"))
    first, last = F.min_by("med", "year"), F.max_by("med", "year")
    return med.groupBy("metric").agg(
        first.alias("first_median"), last.alias("last_median"), r6(last - first).alias("change"), r6(change.ratio_pct(last, first)).alias("pct"), F.min("med").alias("trough"), F.max("med").alias("peak"),
        F.min_by("year", F.struct("med", "year")).alias("trough_year"), F.max_by("year", F.struct("med", -F.col("year"))).alias("peak_year"), r6(change.ratio_pct(last, F.min("med"))).alias("trough_to_last_pct"),
    )


@query("SELECT month, round(median(value) FILTER (WHERE metric = '1-URGENT'), 6) AS urgent, round(median(value) FILTER (WHERE metric = '2-HIGH'), 6) AS high FROM monthly GROUP BY month", MONTHLY)
def rate_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = monthly(spark, sf_dir).groupBy("month").pivot("metric", ["1-URGENT", "2-HIGH"]).agg(Q(0.5))
    return wide.select("month", r6(F.col("`1-URGENT`")).alias("urgent"), r6(F.col("`2-HIGH`")).alias("high"))


DISPERSED = """dispersed AS (SELECT metric, year, count(*) AS n, min(value) AS lowest, quantile_cont(value, 0.25) AS p25, median(value) AS median, quantile_cont(value, 0.75) AS p75, max(value) AS highest,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, max(value) - min(value) AS spread, 100 * stddev_samp(value) / avg(value) AS cv_pct, max(value) / min(value) AS max_over_min FROM yearly GROUP BY metric, year)"""
FIGURES = ["lowest", "p25", "median", "p75", "highest", "iqr", "spread", "cv_pct", "max_over_min"]


@query("SELECT metric, year, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in FIGURES) + " FROM dispersed", YEARLY, DISPERSED)
def dispersion_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.dispersion(yearly(spark, sf_dir), ["metric", "year"], "value").select("metric", "year", "n", *[r6(c).alias(c) for c in FIGURES])


@query("SELECT metric, round(avg(cv_pct), 6) AS mean_cv, round(min(cv_pct), 6) AS min_cv, round(max(cv_pct), 6) AS max_cv, round(avg(max_over_min), 6) AS mean_ratio FROM dispersed GROUP BY metric", YEARLY, DISPERSED)
def dispersion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.dispersion(yearly(spark, sf_dir), ["metric", "year"], "value").groupBy("metric").agg(r6(F.avg("cv_pct")).alias("mean_cv"), r6(F.min("cv_pct")).alias("min_cv"), r6(F.max("cv_pct")).alias("max_cv"), r6(F.avg("max_over_min")).alias("mean_ratio"))


ENDS = f"""ends AS (SELECT a.entity, a.zone, a.metric, a.value AS first_value, b.value AS last_value, b.value - a.value AS change, 100 * (b.value / a.value - 1) AS pct
  FROM yearly a JOIN yearly b ON a.entity = b.entity AND a.metric = b.metric WHERE a.year = {FIRST_YEAR} AND b.year = {LAST_YEAR})"""


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.endpoints(yearly(spark, sf_dir), ["entity", "zone", "metric"], "year", "value", FIRST_YEAR, LAST_YEAR)


@query("SELECT entity, zone, metric, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("first_value", "last_value", "change", "pct")) + " FROM ends", YEARLY, ENDS)
def endpoint_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ends(spark, sf_dir).select("entity", "zone", "metric", *[r6(c).alias(c) for c in ("first_value", "last_value", "change", "pct")])


@query("SELECT metric, count(*) AS entities, round(min(pct), 6) AS min_pct, round(median(pct), 6) AS median_pct, round(max(pct), 6) AS max_pct, round(max(pct) - min(pct), 6) AS spread_pp FROM ends GROUP BY metric", YEARLY, ENDS)
def growth_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ends(spark, sf_dir).groupBy("metric").agg(F.count("*").alias("entities"), r6(F.min("pct")).alias("min_pct"), r6(F.median("pct")).alias("median_pct"), r6(F.max("pct")).alias("max_pct"), r6(F.max("pct") - F.min("pct")).alias("spread_pp"))


@query(
    """SELECT entity, zone, metric, month, round(value, 6) AS value, round(base, 6) AS base, round(100 * (value / base - 1), 6) AS yoy_pct FROM
    (SELECT a.*, b.value AS base FROM monthly a JOIN monthly b ON a.entity = b.entity AND a.metric = b.metric AND a.month = (b.month + INTERVAL 12 MONTH)::DATE)""",
    MONTHLY,
)
def yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = change.year_on_year(monthly(spark, sf_dir), SERIES, "month", "value")
    return out.select("entity", "zone", "metric", "month", *[r6(c).alias(c) for c in ("value", "base", "yoy_pct")])


@query(
    """SELECT metric, month, count(*) AS n, round(median(100 * (value / base - 1)), 6) AS median_yoy, round(avg((value > base)::INT), 6) AS share_up FROM
    (SELECT a.*, b.value AS base FROM monthly a JOIN monthly b ON a.entity = b.entity AND a.metric = b.metric AND a.month = (b.month + INTERVAL 12 MONTH)::DATE) GROUP BY ALL""",
    MONTHLY,
)
def yoy_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = change.year_on_year(monthly(spark, sf_dir), SERIES, "month", "value")
    return out.groupBy("metric", "month").agg(F.count("*").alias("n"), r6(F.median("yoy_pct")).alias("median_yoy"), r6(F.avg((F.col("value") > F.col("base")).cast("int"))).alias("share_up"))


MOVES = "moves AS (SELECT *, 100 * (value / lag(value) OVER (PARTITION BY entity, metric ORDER BY month) - 1) AS mom FROM monthly)"


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).withColumn("mom", change.period_pct(SERIES, "month", "value"))


@query("SELECT entity, metric, count(mom) AS n, round(stddev_samp(mom), 6) AS sd_mom, round(min(mom), 6) AS min_mom, round(max(mom), 6) AS max_mom FROM moves GROUP BY ALL", MONTHLY, MOVES)
def mom_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).groupBy("entity", "metric").agg(F.count("mom").alias("n"), r6(F.stddev_samp("mom")).alias("sd_mom"), r6(F.min("mom")).alias("min_mom"), r6(F.max("mom")).alias("max_mom"))


RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY metric, year ORDER BY n) + (count(*) OVER (PARTITION BY metric, year, n) - 1) / 2.0::DOUBLE AS n_rank,
  rank() OVER (PARTITION BY metric, year ORDER BY value) + (count(*) OVER (PARTITION BY metric, year, value) - 1) / 2.0::DOUBLE AS value_rank,
  count(*) OVER (PARTITION BY metric, year) AS size FROM yearly)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = ["metric", "year"]
    return yearly(spark, sf_dir).withColumns({"n_rank": ranking.average_rank(part, "n"), "value_rank": ranking.average_rank(part, "value"), "size": F.count("*").over(Window.partitionBy(*part))})


@query("SELECT entity, metric, year, n, n_rank, value_rank FROM ranked", YEARLY, RANKED)
def rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("entity", "metric", "year", "n", "n_rank", "value_rank")


@query(f"SELECT entity, metric, year, round(n_rank / size, 6) AS pct_rank, n_rank / size > {HIGH} AS high, n_rank / size <= {LOW} AS low FROM ranked", YEARLY, RANKED)
def rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = yearly(spark, sf_dir).withColumn("p", ranking.share_rank(["metric", "year"], "n"))
    return out.select("entity", "metric", "year", r6("p").alias("pct_rank"), (F.col("p") > HIGH).alias("high"), (F.col("p") <= LOW).alias("low"))


@query(
    """SELECT entity, metric, round(avg(value_rank), 6) AS mean_rank, min(value_rank) AS best_rank, max(value_rank) AS worst_rank, max(value_rank) - min(value_rank) AS swing,
    round(avg((value_rank >= 0.75 * size)::INT), 6) AS share_top, round(avg((value_rank <= 0.25 * size)::INT), 6) AS share_bottom FROM ranked GROUP BY ALL""",
    YEARLY, RANKED,
)
def rank_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: r6(F.avg(c.cast("int")))
    return ranked(spark, sf_dir).groupBy("entity", "metric").agg(
        r6(F.avg("value_rank")).alias("mean_rank"), F.min("value_rank").alias("best_rank"), F.max("value_rank").alias("worst_rank"), (F.max("value_rank") - F.min("value_rank")).alias("swing"),
        share(F.col("value_rank") >= 0.75 * F.col("size")).alias("share_top"), share(F.col("value_rank") <= 0.25 * F.col("size")).alias("share_bottom"),
    )


@query(
    f"""SELECT a.entity, a.metric, a.value_rank AS first_rank, b.value_rank AS last_rank, b.value_rank - a.value_rank AS moved FROM ranked a JOIN ranked b
    ON a.entity = b.entity AND a.metric = b.metric WHERE a.year = {FIRST_YEAR} AND b.year = {LAST_YEAR}""",
    YEARLY, RANKED,
)
def rank_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = change.endpoints(ranked(spark, sf_dir), SERIES, "year", "value_rank", FIRST_YEAR, LAST_YEAR)
    return out.select(*SERIES, F.col("first_value").alias("first_rank"), F.col("last_value").alias("last_rank"), F.col("change").alias("moved"))


@query(
    """SELECT metric, round(avg(churn), 6) AS mean_churn, round(max(churn), 6) AS max_churn, CASE WHEN avg(churn) > 8 THEN 'UNSTABLE' WHEN avg(churn) > 5 THEN 'BORDERLINE' ELSE 'STABLE' END AS label FROM
    (SELECT metric, abs(value_rank - lag(value_rank) OVER (PARTITION BY entity, metric ORDER BY year)) AS churn FROM ranked) GROUP BY metric""",
    YEARLY, RANKED,
)
def rank_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranked(spark, sf_dir).withColumn("churn", F.abs(F.col("value_rank") - change.previous(SERIES, "year", "value_rank"))).groupBy("metric").agg(F.avg("churn").alias("c"), r6(F.max("churn")).alias("max_churn"))
    return out.select("metric", r6("c").alias("mean_churn"), "max_churn", F.when(F.col("c") > 8, "UNSTABLE").when(F.col("c") > 5, "BORDERLINE").otherwise("STABLE").alias("label"))


@query("SELECT metric, year, round(cv_pct, 6) AS cv_pct, round(abs(cv_pct - lag(cv_pct) OVER (PARTITION BY metric ORDER BY year)), 6) AS cv_change FROM dispersed", YEARLY, DISPERSED)
def cv_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = change.dispersion(yearly(spark, sf_dir), ["metric", "year"], "value")
    return out.select("metric", "year", r6("cv_pct").alias("cv_pct"), r6(F.abs(F.col("cv_pct") - change.previous(["metric"], "year", "cv_pct"))).alias("cv_change"))


@query(
    """(SELECT 'TOP' AS side, entity, metric, round(pct, 6) AS pct FROM ends ORDER BY pct DESC, entity, metric LIMIT 6)
    UNION ALL (SELECT 'BOTTOM', entity, metric, round(pct, 6) FROM ends ORDER BY pct, entity, metric LIMIT 6)""",
    YEARLY, ENDS,
)
def growth_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six largest and six smallest changes: a top-k report."""
    rows = ends(spark, sf_dir).select("entity", "metric", "pct")
    top = rows.orderBy(F.desc_nulls_last("pct"), "entity", "metric").limit(6).withColumn("side", F.lit("TOP"))
    bottom = rows.orderBy(F.asc_nulls_last("pct"), "entity", "metric").limit(6).withColumn("side", F.lit("BOTTOM"))
    return top.unionByName(bottom).withColumn("pct", r6("pct"))
