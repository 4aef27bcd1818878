"""Association, divergence, persistence and stability queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import change, ranking
from ledgerline.plans.stand_in import HIGH, LAST_YEAR, LEAST_PERIODS, LOW, MONTHLY, PERSISTENT, SOUTH, STABLE, YEARLY, query, r6, yearly
from ledgerline.plans.statistics import DISPERSED, ENDS, MOVES, RANKED, SERIES, ends, moves, ranked

PAIRED = """paired AS (SELECT a.entity, a.metric AS metric_a, b.metric AS metric_b, a.pct AS x, b.pct AS y FROM ends a JOIN ends b ON a.entity = b.entity),
pair_ranks AS (SELECT metric_a, metric_b, rank() OVER (PARTITION BY metric_a, metric_b ORDER BY x) + (count(*) OVER (PARTITION BY metric_a, metric_b, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY metric_a, metric_b ORDER BY y) + (count(*) OVER (PARTITION BY metric_a, metric_b, y) - 1) / 2.0 AS ry FROM paired)"""


@query("SELECT metric_a, metric_b, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM pair_ranks WHERE metric_a < metric_b GROUP BY ALL", YEARLY, ENDS, PAIRED)
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.spearman_pairs(ends(spark, sf_dir), "entity", "metric", "pct").withColumn("rho", r6("rho"))


@query(
    "SELECT metric_a AS metric, " + ", ".join(f"round(corr(rx, ry) FILTER (WHERE metric_b LIKE '{i}%'), 6) AS m{i}" for i in range(1, 6)) + " FROM pair_ranks GROUP BY metric_a",
    YEARLY, ENDS, PAIRED,
)
def spearman_growth_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = ranking.spearman_pairs(ends(spark, sf_dir), "entity", "metric", "pct").select("metric_a", "metric_b", "rho")
    own = ends(spark, sf_dir).select(F.col("metric").alias("metric_a"), F.col("metric").alias("metric_b"), F.lit(1.0).alias("rho")).distinct()
    whole = half.union(half.select("metric_b", "metric_a", "rho")).union(own)
    wide = whole.groupBy(F.col("metric_a").alias("metric")).pivot("metric_b", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.max("rho"))
    return wide.select("metric", *[r6(F.col(f"`{c}`")).alias(f"m{c[0]}") for c in wide.columns[1:]])


@query(
    """SELECT a.metric AS metric_a, b.metric AS metric_b, round(corr(a.value, b.value), 6) AS r, count(*) AS n FROM yearly a JOIN yearly b
    ON a.entity = b.entity AND a.year = b.year AND a.metric < b.metric GROUP BY ALL""",
    YEARLY,
)
def level_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = yearly(spark, sf_dir).select("entity", "year", F.col("metric").alias("metric_a"), F.col("value").alias("x"))
    b = yearly(spark, sf_dir).select("entity", "year", F.col("metric").alias("metric_b"), F.col("value").alias("y"))
    return a.join(b, ["entity", "year"]).where("metric_a < metric_b").groupBy("metric_a", "metric_b").agg(r6(F.corr("x", "y")).alias("r"), F.count("*").alias("n"))


@query(
    """SELECT metric, round(corr(a, b), 6) AS rho, count(*) AS n, corr(a, b) < 0 AS converging FROM (SELECT metric,
    rank() OVER (PARTITION BY metric ORDER BY first_value) + (count(*) OVER (PARTITION BY metric, first_value) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY metric ORDER BY pct) + (count(*) OVER (PARTITION BY metric, pct) - 1) / 2.0 AS b FROM ends) GROUP BY metric""",
    YEARLY, ENDS,
)
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.spearman(ends(spark, sf_dir), "first_value", "pct", ["metric"])
    return out.select("metric", r6("rho").alias("rho"), "n", (F.col("rho") < 0).alias("converging"))


GAPPED = "gapped AS (SELECT *, median(value) OVER (PARTITION BY metric, year) AS mid FROM yearly)"


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = yearly(spark, sf_dir).groupBy("metric", "year").agg(F.median("value").alias("mid"))
    return yearly(spark, sf_dir).join(mid, ["metric", "year"])


@query("SELECT entity, metric, year, round(value - mid, 6) AS gap, round(100 * (value / mid - 1), 6) AS gap_pct FROM gapped", YEARLY, GAPPED)
def gap_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapped(spark, sf_dir).select("entity", "metric", "year", r6(F.col("value") - F.col("mid")).alias("gap"), r6(change.ratio_pct(F.col("value"), F.col("mid"))).alias("gap_pct"))


@query("SELECT entity, metric, round(pct, 6) AS pct, round(mid, 6) AS median_pct FROM (SELECT *, median(pct) OVER (PARTITION BY metric) AS mid FROM ends) WHERE sign(pct) <> sign(mid)", YEARLY, ENDS)
def contrarians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ends(spark, sf_dir)
    out = rows.join(rows.groupBy("metric").agg(F.median("pct").alias("mid")), "metric").where(F.signum("pct") != F.signum("mid"))
    return out.select("entity", "metric", r6("pct").alias("pct"), r6("mid").alias("median_pct"))


@query(
    f"""SELECT zone, metric, arg_max(entity, (value, entity)) AS highest, arg_min(entity, (value, entity)) AS lowest, round(100 * (max(value) / min(value) - 1), 6) AS gap_pct
    FROM yearly WHERE year = {LAST_YEAR} GROUP BY ALL""",
    YEARLY,
)
def within_group_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("value", "entity")
    return yearly(spark, sf_dir).where(F.col("year") == LAST_YEAR).groupBy("zone", "metric").agg(F.max_by("entity", key).alias("highest"), F.min_by("entity", key).alias("lowest"), r6(change.ratio_pct(F.max("value"), F.min("value"))).alias("gap_pct"))


@query(
    f"""SELECT metric, year, round(north, 6) AS north, round(south, 6) AS south, round(100 * (north / south - 1), 6) AS premium_pct FROM (SELECT metric, year,
    median(value) FILTER (WHERE zone NOT IN ('{"', '".join(SOUTH)}')) AS north, median(value) FILTER (WHERE zone IN ('{"', '".join(SOUTH)}')) AS south FROM yearly GROUP BY ALL)""",
    YEARLY,
)
def half_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly(spark, sf_dir).withColumn("half", F.when(F.col("zone").isin(SOUTH), "SOUTH").otherwise("NORTH"))
    wide = rows.groupBy("metric", "year").pivot("half", ["NORTH", "SOUTH"]).agg(F.median("value"))
    return wide.select("metric", "year", r6("NORTH").alias("north"), r6("SOUTH").alias("south"), r6(change.ratio_pct(F.col("NORTH"), F.col("SOUTH"))).alias("premium_pct"))


@query(
    """SELECT a.zone, count(*) AS pairs, sum((a.mom > 0)::INT)::BIGINT AS fuel_up, sum((a.mom > 0 AND b.mom > 0)::INT)::BIGINT AS both_up, sum((a.mom < 0 AND b.mom >= 0)::INT)::BIGINT AS sticky,
    round(sum((a.mom > 0 AND b.mom > 0)::INT) / nullif(sum((a.mom > 0)::INT), 0), 6) AS share_following
    FROM moves a JOIN moves b ON a.entity = b.entity AND a.month = b.month AND a.metric = '1-URGENT' AND b.metric = '5-LOW' WHERE a.mom IS NOT NULL AND b.mom IS NOT NULL GROUP BY a.zone""",
    MONTHLY, MOVES,
)
def stickiness_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).where("mom IS NOT NULL")
    fuel = rows.where("metric = '1-URGENT'").select("entity", "zone", "month", F.col("mom").alias("a"))
    fare = rows.where("metric = '5-LOW'").select("entity", "month", F.col("mom").alias("b"))
    count = lambda c: F.sum(c.cast("int"))
    up, both = count(F.col("a") > 0), count((F.col("a") > 0) & (F.col("b") > 0))
    return fuel.join(fare, ["entity", "month"]).groupBy("zone").agg(F.count("*").alias("pairs"), up.alias("fuel_up"), both.alias("both_up"), count((F.col("a") < 0) & (F.col("b") >= 0)).alias("sticky"), r6(F.try_divide(both, up)).alias("share_following"))


MARKED = f"marked AS (SELECT *, n_rank / size > {HIGH} AS high, n_rank / size <= {LOW} AS low FROM ranked)"
PERSIST = f"""persist AS (SELECT entity, metric, count(*) AS observed, sum(high::INT)::BIGINT AS n_high, sum(low::INT)::BIGINT AS n_low, avg(high::INT) AS share_high, avg(low::INT) AS share_low,
  count(*) >= {LEAST_PERIODS} AND avg(high::INT) >= {PERSISTENT} AS persistent_high, count(*) >= {LEAST_PERIODS} AND avg(low::INT) >= {PERSISTENT} AS persistent_low FROM marked GROUP BY ALL)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("n_rank") / F.col("size")
    return ranked(spark, sf_dir).withColumns({"high": share > HIGH, "low": share <= LOW})


def persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("int"))
    out = marked(spark, sf_dir).groupBy("entity", "metric").agg(F.count("*").alias("observed"), F.sum(F.col("high").cast("int")).alias("n_high"), F.sum(F.col("low").cast("int")).alias("n_low"), share("high").alias("share_high"), share("low").alias("share_low"))
    enough = F.col("observed") >= LEAST_PERIODS
    return out.withColumns({"persistent_high": enough & (F.col("share_high") >= PERSISTENT), "persistent_low": enough & (F.col("share_low") >= PERSISTENT)})


@query("SELECT entity, metric, observed, n_high, n_low, round(share_high, 6) AS share_high, round(share_low, 6) AS share_low, persistent_high, persistent_low FROM persist", YEARLY, RANKED, MARKED, PERSIST)
def quartile_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persist(spark, sf_dir).withColumns({"share_high": r6("share_high"), "share_low": r6("share_low")})


@query(
    """SELECT entity, metric, coalesce(max(k) FILTER (WHERE high), 0) AS longest_run FROM (SELECT entity, metric, high, count(*) AS k FROM (SELECT *,
    row_number() OVER (PARTITION BY entity, metric ORDER BY year) - row_number() OVER (PARTITION BY entity, metric, high ORDER BY year) AS island FROM marked) GROUP BY entity, metric, high, island) GROUP BY ALL""",
    YEARLY, RANKED, MARKED,
)
def longest_high_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.longest_run(marked(spark, sf_dir), SERIES, "year", F.col("high"))


STABILITY = f"""stability AS (SELECT m.metric, m.mean_abs_mom, c.mean_cv, m.mean_abs_mom / nullif(c.mean_cv, 0) AS ratio, m.mean_abs_mom / nullif(c.mean_cv, 0) < {STABLE} AS stable FROM
  (SELECT metric, avg(abs(100 * (value / prev - 1))) AS mean_abs_mom FROM (SELECT *, lag(value) OVER (PARTITION BY entity, metric ORDER BY year) AS prev FROM yearly) GROUP BY metric) m
  JOIN (SELECT metric, avg(cv_pct) AS mean_cv FROM dispersed GROUP BY metric) c ON m.metric = c.metric)"""


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly(spark, sf_dir)
    move = rows.withColumn("m", F.abs(change.period_pct(SERIES, "year", "value"))).groupBy("metric").agg(F.avg("m").alias("mean_abs_mom"))
    cv = change.dispersion(rows, ["metric", "year"], "value").groupBy("metric").agg(F.avg("cv_pct").alias("mean_cv"))
    ratio = F.try_divide("mean_abs_mom", "mean_cv")
    return move.join(cv, "metric").withColumns({"ratio": ratio, "stable": ratio < STABLE})


@query("SELECT metric, round(mean_abs_mom, 6) AS mean_abs_mom, round(mean_cv, 6) AS mean_cv, round(ratio, 6) AS ratio, stable FROM stability", YEARLY, DISPERSED, STABILITY)
def rank_stability_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability(spark, sf_dir).select("metric", *[r6(c).alias(c) for c in ("mean_abs_mom", "mean_cv", "ratio")], "stable")


@query(
    """SELECT entity, count(*) FILTER (WHERE n_high >= 2) AS metrics_high, count(*) FILTER (WHERE n_low >= 2) AS metrics_low,
    coalesce(string_agg(metric, '; ' ORDER BY metric) FILTER (WHERE n_high >= 2), '') AS high_list FROM persist GROUP BY entity""",
    YEARLY, RANKED, MARKED, PERSIST,
)
def multi_metric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("n_high") >= 2, F.col("metric")))), "; ")
    return persist(spark, sf_dir).groupBy("entity").agg(F.count_if(F.col("n_high") >= 2).alias("metrics_high"), F.count_if(F.col("n_low") >= 2).alias("metrics_low"), names.alias("high_list"))


@query(
    """SELECT scope, entity, count(DISTINCT CASE WHEN metric < '3' THEN 'FAST' ELSE 'SLOW' END) AS families, count(*) AS metrics FROM
    (SELECT 'ALL' AS scope, * FROM persist WHERE n_high >= 1 UNION ALL SELECT 'STABLE', persist.* FROM persist JOIN stability USING (metric) WHERE n_high >= 1 AND stable) GROUP BY ALL""",
    YEARLY, RANKED, MARKED, PERSIST, DISPERSED, STABILITY,
)
def family_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = persist(spark, sf_dir).where("n_high >= 1").select("entity", "metric")
    stable = rows.join(stability(spark, sf_dir).where("stable").select("metric"), "metric", "left_semi").withColumn("scope", F.lit("STABLE"))
    both = rows.withColumn("scope", F.lit("ALL")).unionByName(stable)
    return both.groupBy("scope", "entity").agg(F.countDistinct(F.when(F.col("metric") < "3", "FAST").otherwise("SLOW")).alias("families"), F.count("*").alias("metrics"))


@query(
    """SELECT metric, round(b / (b + w), 6) AS eta_sq FROM (SELECT metric, sum(n * (m - g) * (m - g)) AS b, sum(n * v) AS w FROM (SELECT *, sum(n * m) OVER (PARTITION BY metric) / sum(n) OVER (PARTITION BY metric) AS g FROM
    (SELECT metric, year, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM yearly GROUP BY ALL)) GROUP BY metric)""",
    YEARLY,
)
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.eta_squared(yearly(spark, sf_dir), "metric", "year", "value").withColumn("eta_sq", r6("eta_sq"))


LOCAL = "metric IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"


@query(f"SELECT entity, metric, observed, n_high, n_low, round(share_high, 6) AS share_high, round(share_low, 6) AS share_low FROM persist WHERE {LOCAL}", YEARLY, RANKED, MARKED, PERSIST)
def local_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persist(spark, sf_dir).where(LOCAL).select("entity", "metric", "observed", "n_high", "n_low", r6("share_high").alias("share_high"), r6("share_low").alias("share_low"))


@query(
    f"""SELECT entity, string_agg(metric, '; ' ORDER BY metric) FILTER (WHERE share_high >= 0.4) AS dear, string_agg(metric, '; ' ORDER BY metric) FILTER (WHERE share_low >= 0.4) AS cheap
    FROM persist WHERE {LOCAL} GROUP BY entity HAVING count(*) FILTER (WHERE share_high >= 0.4) > 0 AND count(*) FILTER (WHERE share_low >= 0.4) > 0""",
    YEARLY, RANKED, MARKED, PERSIST,
)
def split_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that are often dear in one local metric and often cheap in another."""
    rows = persist(spark, sf_dir).where(LOCAL)
    side = lambda c, name: rows.where(F.col(c) >= 0.4).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("metric")), "; ").alias(name))
    return side("share_high", "dear").join(side("share_low", "cheap"), "entity")


@query(
    """SELECT metric, round(avg(high::INT) FILTER (WHERE prev), 6) AS p_high_after_high, round(avg(high::INT) FILTER (WHERE NOT prev), 6) AS p_high_after_other, count(prev) AS n FROM
    (SELECT *, lag(high) OVER (PARTITION BY entity, metric ORDER BY year) AS prev FROM marked) GROUP BY metric""",
    YEARLY, RANKED, MARKED,
)
def quartile_stickiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir).withColumn("prev", F.lag("high").over(Window.partitionBy(*SERIES).orderBy("year")))
    high = F.col("high").cast("int")
    return rows.groupBy("metric").agg(r6(F.avg(F.when(F.col("prev"), high))).alias("p_high_after_high"), r6(F.avg(F.when(~F.col("prev"), high))).alias("p_high_after_other"), F.count("prev").alias("n"))


DRAWS, DRAW_SEED, MANY_METRICS, HIGH_YEARS = 10_000, 20260916, 3, 2
DRAWN = f"""sizes AS (SELECT metric, count(*) FILTER (WHERE n_high >= {HIGH_YEARS}) AS k FROM persist GROUP BY metric),
places AS (SELECT draw, entity, metric, row_number() OVER (PARTITION BY draw, metric ORDER BY md5('{DRAW_SEED}|' || draw || '|' || metric || '|' || entity), entity) AS place
  FROM range({DRAWS}) d(draw), (SELECT DISTINCT entity FROM persist), sizes),
tallies AS (SELECT draw, entity, count(*) FILTER (WHERE place <= k) AS m FROM places JOIN sizes USING (metric) GROUP BY draw, entity),
null_draws AS (SELECT draw, count(*) FILTER (WHERE m >= {MANY_METRICS}) AS many, max(m) AS largest FROM tallies GROUP BY draw),
seen AS (SELECT count(*) FILTER (WHERE m >= {MANY_METRICS}) AS seen_many, max(m) AS seen_largest FROM (SELECT entity, count(*) FILTER (WHERE n_high >= {HIGH_YEARS}) AS m FROM persist GROUP BY entity))"""


@query(
    """SELECT statistic, max(observed)::BIGINT AS observed, round(avg(drawn), 6) AS mean_null, round(avg((drawn >= observed)::INT), 6) AS p_value, count(*) AS draws FROM (
    SELECT 'entities_with_many' AS statistic, many AS drawn, seen_many AS observed FROM null_draws, seen UNION ALL SELECT 'largest_count', largest, seen_largest FROM null_draws, seen) GROUP BY statistic""",
    YEARLY, RANKED, MARKED, PERSIST, DRAWN,
)
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Could chance alone put so many entities into the high quartile of many metrics, or one entity into so many?

    A draw gives each metric its observed number of high entities: those whose digest of seed, draw, metric
    and entity is smallest. Draws x metrics x entities rows, ranked in groups of entities.
    """
    rows = persist(spark, sf_dir).withColumn("on", F.col("n_high") >= HIGH_YEARS)
    sizes = rows.groupBy("metric").agg(F.count_if("on").alias("k"))
    grid = spark.range(DRAWS).withColumnRenamed("id", "draw").join(F.broadcast(rows.select("entity").distinct().crossJoin(sizes)))  # entities x metrics: the panel's own grid
    digest = F.md5(F.concat_ws("|", F.lit(str(DRAW_SEED)), "draw", "metric", "entity").cast("binary"))
    place = F.row_number().over(Window.partitionBy("draw", "metric").orderBy(digest, "entity"))
    hits = grid.withColumn("place", place).groupBy("draw", "entity").agg(F.count_if(F.col("place") <= F.col("k")).alias("m"))
    both = lambda df: df.agg(F.count_if(F.col("m") >= MANY_METRICS).alias("entities_with_many"), F.max("m").alias("largest_count"))
    drawn = both(hits.groupBy("draw")).unpivot("draw", ["entities_with_many", "largest_count"], "statistic", "drawn")
    seen = both(rows.groupBy("entity").agg(F.count_if("on").alias("m"))).unpivot([], ["entities_with_many", "largest_count"], "statistic", "observed")
    out = drawn.join(seen, "statistic").groupBy("statistic")
    return out.agg(F.max("observed").alias("observed"), r6(F.avg("drawn")).alias("mean_null"), r6(F.avg((F.col("drawn") >= F.col("observed")).cast("int"))).alias("p_value"), F.count("*").alias("draws"))
