"""Decision inputs and guarded measures: queries that decline to answer where a comparison is not valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import change
from ledgerline.plans.mart import METRICS
from ledgerline.plans.relations import STABILITY, marked, stability
from ledgerline.plans.stand_in import FIRST_YEAR, LAST_YEAR, MONTHLY, YEARLY, monthly, query, r6, yearly
from ledgerline.plans.statistics import DISPERSED, ENDS, MOVES, RANKED, ends, moves
from ledgerline.sources.tables import table

LEVELS = """levels AS (SELECT metric, quantile_cont(abs(mom), 0.75) AS p75, quantile_cont(abs(mom), 0.9) AS p90, quantile_cont(abs(mom), 0.95) AS p95 FROM moves GROUP BY metric)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.percentile(F.abs("mom"), F.lit(p))
    return moves(spark, sf_dir).groupBy("metric").agg(q(0.75).alias("p75"), q(0.9).alias("p90"), q(0.95).alias("p95"))


@query("SELECT metric, round(p75, 6) AS p75, round(p90, 6) AS elevated, round(p95, 6) AS extreme FROM levels", MONTHLY, MOVES, LEVELS)
def movement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir).select("metric", r6("p75").alias("p75"), r6("p90").alias("elevated"), r6("p95").alias("extreme"))


@query("SELECT metric, month, count(*) AS n_entities, (count(*) FILTER (WHERE abs(mom) >= p95)) AS n_extreme FROM moves JOIN levels USING (metric) WHERE mom IS NOT NULL GROUP BY ALL", MONTHLY, MOVES, LEVELS)
def extreme_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).where("mom IS NOT NULL").join(levels(spark, sf_dir), "metric")
    return rows.groupBy("metric", "month").agg(F.count("*").alias("n_entities"), F.count_if(F.abs("mom") >= F.col("p95")).alias("n_extreme"))


EFFICIENCIES = [2.5, 3.0, 3.5, 4.0]


@query(
    f"""SELECT month, eff::DOUBLE AS efficiency, round(med / eff::DOUBLE, 6) AS unit_cost, round(med / eff::DOUBLE / nullif(reference, 0), 6) AS multiple FROM
    (SELECT month, median(value) FILTER (WHERE metric = '1-URGENT') AS med, median(value) FILTER (WHERE metric = '5-LOW') AS reference FROM monthly GROUP BY month), (VALUES {", ".join(f"({e})" for e in EFFICIENCIES)}) v(eff)""",
    MONTHLY,
)
def reference_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of one metric at four efficiencies as a multiple of a reference metric: months x 4 rows."""
    med = lambda m: F.median(F.when(F.col("metric") == m, F.col("value")))
    rows = monthly(spark, sf_dir).groupBy("month").agg(med("1-URGENT").alias("med"), med("5-LOW").alias("reference"))
    rows = rows.withColumn("efficiency", F.explode(F.array(*[F.lit(e) for e in EFFICIENCIES])))
    return rows.select("month", "efficiency", r6(F.col("med") / F.col("efficiency")).alias("unit_cost"), r6(F.try_divide(F.col("med") / F.col("efficiency"), "reference")).alias("multiple"))


@query("SELECT p_type AS band, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price, round(avg(p_retailprice) * 3.0, 6) AS breakeven FROM part GROUP BY p_type")
def breakeven(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg("p_retailprice")
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("band")).agg(F.count("*").alias("n"), r6(mean).alias("mean_price"), r6(mean * 3.0).alias("breakeven"))


YOY = """yoy AS (SELECT a.entity, a.zone, a.metric, a.month, 100 * (a.value / b.value - 1) AS pct FROM monthly a JOIN monthly b ON a.entity = b.entity AND a.metric = b.metric AND a.month = (b.month + INTERVAL 12 MONTH)::DATE)"""


@query(
    """SELECT a.entity, count(*) AS months, round(median(a.pct - b.pct), 6) AS median_gap_pp, round(avg((a.pct > b.pct)::INT), 6) AS share_above
    FROM yoy a JOIN yoy b ON a.entity = b.entity AND a.month = b.month AND a.metric = '2-HIGH' AND b.metric = '3-MEDIUM' GROUP BY a.entity""",
    MONTHLY, YOY,
)
def rate_vs_rate_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = change.year_on_year(monthly(spark, sf_dir), ["entity", "metric"], "month", "value").select("entity", "metric", "month", "yoy_pct")
    side = lambda m, name: rows.where(F.col("metric") == m).select("entity", "month", F.col("yoy_pct").alias(name))
    both = side("2-HIGH", "a").join(side("3-MEDIUM", "b"), ["entity", "month"])
    return both.groupBy("entity").agg(F.count("*").alias("months"), r6(F.median(F.col("a") - F.col("b"))).alias("median_gap_pp"), r6(F.avg((F.col("a") > F.col("b")).cast("int"))).alias("share_above"))


WINDOWS = [("FULL", FIRST_YEAR, LAST_YEAR), ("RECENT", 1998, LAST_YEAR), ("FUTURE", 2050, 2051)]


@query(
    f"""SELECT w.label, m.metric, count(DISTINCT a.entity) AS jurisdictions, round(median(100 * (b.value / a.value - 1)), 6) AS median_pct, round(median(100 * (b.value / a.value - 1)) / 100, 6) AS impact_per_pp
    FROM (VALUES {", ".join(f"('{a}', {b}, {c})" for a, b, c in WINDOWS)}) w(label, lo, hi) CROSS JOIN (SELECT DISTINCT metric FROM yearly) m
    LEFT JOIN (yearly a JOIN yearly b ON a.entity = b.entity AND a.metric = b.metric) ON a.metric = m.metric AND a.year = w.lo AND b.year = w.hi GROUP BY ALL""",
    YEARLY,
)
def exposure_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows x metrics; a series that is absent from a window shows 0 jurisdictions and nulls."""
    at = lambda year: F.max(F.when(F.col("year") == year, F.col("value")))
    ends = yearly(spark, sf_dir).groupBy("entity", "metric").agg(*[at(y).alias(f"y{y}") for y in sorted({y for _, lo, hi in WINDOWS for y in (lo, hi)})])
    windows = F.array(*[F.struct(F.lit(label).alias("label"), change.ratio_pct(F.col(f"y{hi}"), F.col(f"y{lo}")).alias("pct")) for label, lo, hi in WINDOWS])
    pct = ends.select("entity", "metric", F.explode(windows).alias("w")).select("metric", "w.label", "w.pct", F.when(F.col("w.pct").isNotNull(), F.col("entity")).alias("entity"))
    return pct.groupBy("label", "metric").agg(F.countDistinct("entity").alias("jurisdictions"), r6(F.median("pct")).alias("median_pct"), r6(F.median("pct") / 100).alias("impact_per_pp"))


@query(
    f"""SELECT metric, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, round(max(value) - min(value), 6) AS spread, round(max(value) / nullif(min(value), 0), 6) AS ratio, bool_or(stable) AS stable,
    CASE WHEN bool_or(stable) THEN arg_max(entity, (value, entity)) END AS dearest, CASE WHEN bool_or(stable) THEN arg_min(entity, (value, entity)) END AS cheapest
    FROM yearly JOIN stability USING (metric) WHERE year = {LAST_YEAR} GROUP BY metric""",
    YEARLY, DISPERSED, STABILITY,
)
def location_value_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the last year; places are named only for metrics whose ranks are stable."""
    key, stable = F.struct("value", "entity"), F.bool_or("stable")
    rows = yearly(spark, sf_dir).where(F.col("year") == LAST_YEAR).join(stability(spark, sf_dir).select("metric", "stable"), "metric")
    return rows.groupBy("metric").agg(
        r6(F.min("value")).alias("lowest"), r6(F.max("value")).alias("highest"), r6(F.max("value") - F.min("value")).alias("spread"), r6(F.try_divide(F.max("value"), F.min("value"))).alias("ratio"), stable.alias("stable"),
        F.when(stable, F.max_by("entity", key)).alias("dearest"), F.when(stable, F.min_by("entity", key)).alias("cheapest"),
    )


@query(
    f"""SELECT metric, trough_year, count(*) AS entities, (count(*) FILTER (WHERE b.value > a.value)) AS entities_up, round(min(100 * (b.value / a.value - 1)), 6) AS min_pct, round(median(100 * (b.value / a.value - 1)), 6) AS median_pct,
    round(max(100 * (b.value / a.value - 1)), 6) AS max_pct FROM (SELECT metric, arg_min(year, (round(med, 6), year)) AS trough_year FROM (SELECT metric, year, median(value) AS med FROM yearly WHERE year < {LAST_YEAR} GROUP BY ALL) GROUP BY metric) t
    JOIN yearly a USING (metric) JOIN yearly b ON a.entity = b.entity AND a.metric = b.metric WHERE a.year = trough_year AND b.year = {LAST_YEAR} GROUP BY metric, trough_year""",
    YEARLY,
)
def shock_from_trough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of every entity from the trough of the national median, one fixed year a metric, to the last year."""
    rows = yearly(spark, sf_dir)
    med = rows.where(F.col("year") < LAST_YEAR).groupBy("metric", "year").agg(r6(F.median("value")).alias("med"))
    trough = med.groupBy("metric").agg(F.min_by("year", F.struct("med", "year")).alias("trough_year"))
    base = rows.join(trough, "metric").where("year = trough_year").select("entity", "metric", "trough_year", F.col("value").alias("base"))
    now = rows.where(F.col("year") == LAST_YEAR).select("entity", "metric", "value")
    out = base.join(now, ["entity", "metric"]).withColumn("pct", change.ratio_pct(F.col("value"), F.col("base")))
    return out.groupBy("metric", "trough_year").agg(F.count("*").alias("entities"), F.count_if(F.col("value") > F.col("base")).alias("entities_up"), r6(F.min("pct")).alias("min_pct"), r6(F.median("pct")).alias("median_pct"), r6(F.max("pct")).alias("max_pct"))


# Measures. A filter context is a set of rows; a measure is an aggregate over it, null where it must not be compared.

NOT_COMPARABLE = "4-NOT SPECIFIED"


def by_entity(rows: DataFrame, *context: str) -> DataFrame:
    return rows.groupBy(*context, "entity").agg(F.avg("value").alias("value"), F.max("metric").alias("metric"), F.max((F.col("metric") == NOT_COMPARABLE).cast("int")).alias("mixed"))


@query(
    f"""SELECT zone, month, count(*) AS jurisdictions, CASE WHEN max(mixed) = 0 THEN round(median(value), 6) END AS median_value FROM
    (SELECT zone, month, entity, avg(value) AS value, max((metric = '{NOT_COMPARABLE}')::INT) AS mixed FROM monthly GROUP BY ALL) GROUP BY ALL""",
    MONTHLY,
)
def guarded_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_entity(monthly(spark, sf_dir), "zone", "month")
    return rows.groupBy("zone", "month").agg(F.count("*").alias("jurisdictions"), F.when(F.max("mixed") == 0, r6(F.median("value"))).alias("median_value"))


@query("SELECT metric, month AS latest_month, round(median(value), 6) AS latest_median FROM monthly JOIN (SELECT metric, max(month) AS month FROM monthly GROUP BY metric) USING (metric, month) GROUP BY metric, month", MONTHLY)
def latest_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly(spark, sf_dir)
    last = rows.groupBy("metric").agg(F.max("month").alias("month"))
    return rows.join(last, ["metric", "month"]).groupBy("metric", F.col("month").alias("latest_month")).agg(r6(F.median("value")).alias("latest_median"))


MEDIANS = "medians AS (SELECT metric, month, round(median(value), 6) AS med FROM monthly GROUP BY ALL)"


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).groupBy("metric", "month").agg(r6(F.median("value")).alias("med"))


@query("SELECT metric, month, med, round(100 * (med / nullif(lag(med) OVER (PARTITION BY metric ORDER BY month), 0) - 1), 6) AS mom_pct FROM medians", MONTHLY, MEDIANS)
def value_mom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medians(spark, sf_dir).withColumn("mom_pct", r6(change.period_pct(["metric"], "month", "med")))


@query("SELECT a.metric, a.month, a.med, round(100 * (a.med / nullif(b.med, 0) - 1), 6) AS yoy_pct FROM medians a LEFT JOIN medians b ON a.metric = b.metric AND a.month = (b.month + INTERVAL 12 MONTH)::DATE", MONTHLY, MEDIANS)
def value_yoy_blank_on_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = medians(spark, sf_dir)
    base = rows.select("metric", F.add_months("month", 12).alias("month"), F.col("med").alias("base"))
    return rows.join(base, ["metric", "month"], "left").select("metric", "month", "med", r6(change.ratio_pct(F.col("med"), F.col("base"))).alias("yoy_pct"))


def extreme_place(spark: SparkSession, sf_dir: str, descending: bool, name: str) -> DataFrame:
    """Names at rank one (all ties, by name) per metric and year, by order counts; blank where ranks are not stable."""
    part = ["metric", "year"]
    rows = yearly(spark, sf_dir).withColumn("r", F.rank().over(Window.partitionBy(*part).orderBy(F.col("n").desc() if descending else F.col("n").asc()))).where("r = 1")
    named = rows.groupBy(*part).agg(F.array_join(F.array_sort(F.collect_list("entity")), "; ").alias("names"))
    return named.join(stability(spark, sf_dir).select("metric", "stable"), "metric").select(*part, F.when(F.col("stable"), F.col("names")).alias(name))


PLACE = "SELECT metric, year, CASE WHEN bool_or(stable) THEN string_agg(entity, '; ' ORDER BY entity) END AS {} FROM (SELECT *, rank() OVER (PARTITION BY metric, year ORDER BY n {}) AS r FROM yearly) JOIN stability USING (metric) WHERE r = 1 GROUP BY metric, year"


@query(PLACE.format("dearest", "DESC"), YEARLY, DISPERSED, STABILITY)
def dearest_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extreme_place(spark, sf_dir, True, "dearest")


@query(PLACE.format("cheapest", "ASC"), YEARLY, DISPERSED, STABILITY)
def cheapest_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extreme_place(spark, sf_dir, False, "cheapest")


@query(
    f"""SELECT metric, count(*) AS observations, count(DISTINCT entity) AS jurisdictions, count(DISTINCT year) AS periods, max(year) AS latest_year,
    round(sum(value) FILTER (WHERE year = {LAST_YEAR}), 6) AS pinned_sum, round(max(value), 6) AS peak FROM yearly GROUP BY metric""",
    YEARLY,
)
def measure_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yearly(spark, sf_dir).groupBy("metric").agg(
        F.count("*").alias("observations"), F.countDistinct("entity").alias("jurisdictions"), F.countDistinct("year").alias("periods"), F.max("year").alias("latest_year"),
        r6(F.sum(F.when(F.col("year") == LAST_YEAR, F.col("value")))).alias("pinned_sum"), r6(F.max("value")).alias("peak"),
    )


@query("SELECT metric, round(max(v) - min(v), 6) AS spread_value, round(max(v) / nullif(min(v), 0), 6) AS dearest_over_cheapest FROM (SELECT metric, entity, avg(value) AS v FROM yearly GROUP BY ALL) GROUP BY metric", YEARLY)
def spread_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = yearly(spark, sf_dir).groupBy("metric", "entity").agg(F.avg("value").alias("v"))
    return per.groupBy("metric").agg(r6(F.max("v") - F.min("v")).alias("spread_value"), r6(F.try_divide(F.max("v"), F.min("v"))).alias("dearest_over_cheapest"))


@query("SELECT zone, CASE WHEN count(DISTINCT metric) = 1 THEN max(metric) ELSE 'Select one metric' END AS note, count(DISTINCT metric) AS metrics FROM yearly WHERE zone <> 'ASIA' OR metric = '5-LOW' GROUP BY zone", YEARLY)
def selected_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text for the one metric in context, else a prompt."""
    rows = yearly(spark, sf_dir).where("zone <> 'ASIA' OR metric = '5-LOW'")
    return rows.groupBy("zone").agg(F.when(F.countDistinct("metric") == 1, F.max("metric")).otherwise("Select one metric").alias("note"), F.countDistinct("metric").alias("metrics"))


@query(
    "SELECT zone, " + ", ".join(f"round(avg(med) FILTER (WHERE metric = '{m}'), 6) AS m{m[0]}" for m in METRICS) + " FROM (SELECT zone, metric, year, median(value) AS med FROM yearly GROUP BY ALL) GROUP BY zone",
    YEARLY,
)
def pivot_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of medians that were taken before the pivot; no totals across grains."""
    med = yearly(spark, sf_dir).groupBy("zone", "metric", "year").agg(F.median("value").alias("med"))
    wide = med.groupBy("zone").pivot("metric", METRICS).agg(F.avg("med"))
    return wide.select("zone", *[r6(F.col(f"`{m}`")).alias(f"m{m[0]}") for m in METRICS])


#: Names that a visual may ask for, and their aggregates.
AGGREGATES = {"Sum": F.sum, "Average": F.avg, "DistinctCount": F.countDistinct, "Min": F.min, "Max": F.max, "Count": F.count, "Median": F.median}


@query("SELECT metric, round(sum(value), 6) AS \"Sum\", round(avg(value), 6) AS \"Average\", count(DISTINCT value) AS \"DistinctCount\", min(value) AS \"Min\", max(value) AS \"Max\", count(value) AS \"Count\", round(median(value), 6) AS \"Median\" FROM (SELECT * REPLACE (round(value, 6) AS value) FROM yearly) GROUP BY metric", YEARLY)
def aggregate_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly(spark, sf_dir).withColumn("value", r6("value"))
    rounded = {"Sum", "Average", "Median"}
    return rows.groupBy("metric").agg(*[(r6(f("value")) if n in rounded else f("value")).alias(n) for n, f in AGGREGATES.items()])


@query(
    f"""SELECT entity, round(a.value, 6) AS first_urgent, round(b.value, 6) AS last_urgent, e.pct IS NOT NULL AS has_growth, round(e.pct, 6) AS pct FROM
    (SELECT * FROM yearly WHERE metric = '1-URGENT' AND year = {FIRST_YEAR}) a LEFT JOIN (SELECT * FROM yearly WHERE metric = '1-URGENT' AND year = {LAST_YEAR}) b USING (entity)
    LEFT JOIN (SELECT * FROM ends WHERE metric = '1-URGENT') e USING (entity)""",
    YEARLY, ENDS,
)
def lookup_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-key lookups of single values, as left joins on filtered rows."""
    rows = yearly(spark, sf_dir).where("metric = '1-URGENT'")
    at = lambda y, name: rows.where(F.col("year") == y).select("entity", F.col("value").alias(name))
    growth = ends(spark, sf_dir).where("metric = '1-URGENT'").select("entity", "pct")
    out = at(FIRST_YEAR, "a").join(at(LAST_YEAR, "b"), "entity", "left").join(growth, "entity", "left")
    return out.select("entity", r6("a").alias("first_urgent"), r6("b").alias("last_urgent"), F.col("pct").isNotNull().alias("has_growth"), r6("pct").alias("pct"))


@query(
    """SELECT entity, zone, zone IN ('ASIA', 'AFRICA') AS is_south, count(DISTINCT metric) AS metrics, min(year) AS first_year, max(year) AS last_year, max(value_rank = size) AS ever_dearest FROM ranked GROUP BY ALL""",
    YEARLY, RANKED,
)
def star_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity dimension with its derived flags."""
    return marked(spark, sf_dir).groupBy("entity", "zone").agg(
        F.countDistinct("metric").alias("metrics"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.bool_or(F.col("value_rank") == F.col("size")).alias("ever_dearest"),
    ).withColumn("is_south", F.col("zone").isin("ASIA", "AFRICA"))

