"""Surfaces, provenance, extremes, extracts for a dashboard, set operations and text-layer queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import change, ranking
from ledgerline.operators import publication as pub
from ledgerline.plans.mart import ITEMS, item_prices
from ledgerline.plans.publications import valid
from ledgerline.plans.relations import STABILITY, stability
from ledgerline.plans.stand_in import FIRST_YEAR, LAST_YEAR, LATEST, MONTHLY, PUBLISHED, SOUTH, YEARLY, monthly, placed_orders, places, published, query, r6, yearly
from ledgerline.plans.statistics import DISPERSED, MOVES, moves
from ledgerline.sources.tables import TABLES, table


@query(" UNION ALL ".join(f"SELECT '{t}' AS object, count(*) AS n FROM {t}" for t in TABLES))
def surface_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every registered table; counts come from file footers."""
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.lit(t).alias("object"), F.count("*").alias("n")) for t in TABLES])


@query(
    """SELECT item, count(*) AS n, round(avg(p), 6) AS mean_premium, round(median(p), 6) AS median_premium, round(max(p) - min(p), 6) AS spread FROM
    (SELECT z.item, 100 * (z.value / nullif(o.value, 0) - 1) AS p FROM zonal z JOIN overall o ON z.item = o.item AND z.obs = o.obs AND z.rel = o.rel WHERE z.rel = z.obs) GROUP BY item""",
    PUBLISHED, ITEMS,
)
def item_premium_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    zonal, overall = item_prices(spark, sf_dir)
    both = pub.primary(zonal).join(pub.primary(overall).withColumnRenamed("value", "o"), ["item", "obs", "rel"]).withColumn("p", change.ratio_pct(F.col("value"), F.col("o")))
    return both.groupBy("item").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_premium"), r6(F.median("p")).alias("median_premium"), r6(F.max("p") - F.min("p")).alias("spread"))


@query(
    """SELECT o_orderpriority AS metric, o_orderstatus AS status, zone, count(*) AS n, count(*) FILTER (WHERE month(o_orderdate) = 12) AS december, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day
    FROM placed GROUP BY ALL""",
    YEARLY,
)
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed_orders(spark, sf_dir)
    return rows.groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("status"), "zone").agg(
        F.count("*").alias("n"), F.count_if(F.month("o_orderdate") == 12).alias("december"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day")
    )


@query("SELECT metric, year(month)::INT AS year, count(mom) AS n, round(median(mom), 6) AS median_move, round(quantile_cont(mom, 0.9), 6) AS p90 FROM moves WHERE month(month) = 12 GROUP BY ALL", MONTHLY, MOVES)
def december_move_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).where(F.month("month") == 12)
    return rows.groupBy("metric", F.year("month").alias("year")).agg(F.count("mom").alias("n"), r6(F.median("mom")).alias("median_move"), r6(F.percentile("mom", F.lit(0.9))).alias("p90"))


@query(
    """SELECT metric, year, min(n) AS lowest, count(*) FILTER (WHERE n = lo) AS tied_low, max(n) AS highest, count(*) FILTER (WHERE n = hi) AS tied_high FROM
    (SELECT *, min(n) OVER (PARTITION BY metric, year) AS lo, max(n) OVER (PARTITION BY metric, year) AS hi FROM yearly) GROUP BY ALL""",
    YEARLY,
)
def declared_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities share each extreme."""
    rows = yearly(spark, sf_dir)
    ext = rows.groupBy("metric", "year").agg(F.min("n").alias("lowest"), F.max("n").alias("highest"))
    return rows.join(ext, ["metric", "year"]).groupBy("metric", "year", "lowest", "highest").agg(F.count_if(F.col("n") == F.col("lowest")).alias("tied_low"), F.count_if(F.col("n") == F.col("highest")).alias("tied_high"))


@query(
    """SELECT zone, obs, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.95), 6) AS p95, round(100 * stddev_samp(value) / avg(value), 6) AS cv_pct FROM latest GROUP BY ALL HAVING count(*) > 1""",
    PUBLISHED, LATEST,
)
def latest_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pub.latest(valid(spark, sf_dir), ["entity", "obs"], ["rel"]).groupBy("zone", "obs")
    sd, mean = F.stddev_samp("value"), F.avg("value")
    return rows.agg(F.count("*").alias("n"), r6(mean).alias("mean"), r6(sd).alias("sd"), r6(F.percentile("value", F.lit(0.95))).alias("p95"), r6(100 * F.try_divide(sd, mean)).alias("cv_pct")).where("n > 1")


@query(
    f"""SELECT entity, 'BOTH' AS side FROM (SELECT DISTINCT entity FROM yearly WHERE n >= 12 INTERSECT SELECT DISTINCT entity FROM yearly WHERE year = {LAST_YEAR} AND metric = '5-LOW' AND value > 0)
    UNION ALL SELECT entity, 'ONLY_FIRST' FROM (SELECT DISTINCT entity FROM yearly WHERE zone IN ('{"', '".join(SOUTH)}') EXCEPT SELECT DISTINCT entity FROM yearly WHERE n >= 12)""",
    YEARLY,
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly(spark, sf_dir)
    names = lambda c: rows.where(c).select("entity").distinct()
    many, low, south = names(F.col("n") >= 12), names((F.col("year") == LAST_YEAR) & (F.col("metric") == "5-LOW") & (F.col("value") > 0)), names(F.col("zone").isin(SOUTH))
    return many.intersect(low).withColumn("side", F.lit("BOTH")).unionByName(south.subtract(many).withColumn("side", F.lit("ONLY_FIRST")))


@query("SELECT lang, source, round(abs(m - (SELECT avg(n_chars) FROM documents)), 6) AS distance FROM (SELECT lang, source, avg(n_chars) AS m FROM documents GROUP BY ALL) ORDER BY abs(m - (SELECT avg(n_chars) FROM documents)) DESC, lang, source LIMIT 10")
def farthest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten groups farthest from the overall mean: a top-k report in a total order."""
    docs = table(spark, sf_dir, "documents")
    groups = docs.groupBy("lang", "source").agg(F.sum("n_chars").alias("s"), F.count("n_chars").alias("c"))
    whole = groups.agg((F.sum("s") / F.sum("c")).alias("whole"))
    return groups.crossJoin(whole).withColumn("d", F.abs(F.col("s") / F.col("c") - F.col("whole"))).orderBy(F.desc_nulls_last("d"), "lang", "source").limit(10).select("lang", "source", r6("d").alias("distance"))


@query(
    """SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY mean DESC NULLS LAST, p_type ASC NULLS LAST) AS place FROM
    (SELECT p_brand, p_type, CASE WHEN count(*) > 3 THEN sum(p_retailprice::DECIMAL(18,2))::DOUBLE / count(*) END AS mean FROM part GROUP BY ALL)"""
)
def nulls_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order with the place of nulls said, in either direction."""
    mean = F.when(F.count("*") > 3, F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double") / F.count("*"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(mean.alias("mean"))
    w = Window.partitionBy("p_brand").orderBy(F.desc_nulls_last("mean"), F.asc_nulls_last("p_type"))
    return rows.select("p_brand", "p_type", F.row_number().over(w).cast("long").alias("place"))


@query(
    r"""SELECT band, mdclass, count(*) AS n FROM (SELECT nullif(regexp_extract(c, '^([A-E]) ', 1), '') AS band, regexp_replace(c, '^[A-E] ', '') AS mdclass FROM
    (SELECT regexp_replace(regexp_replace(upper(trim(regexp_replace(chr(65 + p_size % 7) || '  ' || p_type || ' - MD  ' || (p_size % 3), '\s+', ' ', 'g'))), ' ?- ?', '-', 'g'), ' (\d)', '\1', 'g') AS c FROM part)) GROUP BY ALL"""
)
def class_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.char(F.lit(65) + F.col("p_size") % 7), F.lit("  "), "p_type", F.lit(" - MD  "), (F.col("p_size") % 3).cast("string"))
    band, kind = labels.split_class(labels.canonical_class(raw))
    return table(spark, sf_dir, "part").groupBy(band.alias("band"), kind.alias("mdclass")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT page_id, count(*) AS n_tags, count(DISTINCT tag) AS kinds FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY page_id"""
)
def regex_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy("page_id").agg(F.count("*").alias("n_tags"), F.countDistinct("tag").alias("kinds"))


@query("SELECT page_id, i::INT AS place, part FROM (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT page_id, list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM pages))")
def marked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an address between slashes, in order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(labels.segments(F.col("url"), "/")).alias("k", "part")).select("page_id", (F.col("k") + 1).alias("place"), "part")


@query(
    """SELECT metric, min(year) AS first_year, max(year) AS last_year, count(DISTINCT entity) AS entities, bool_or(stable) AS rank_stable, CASE WHEN metric < '3' THEN 'FAST' ELSE 'SLOW' END AS family,
    metric <> '4-NOT SPECIFIED' AS comparable, CASE WHEN bool_or(stable) THEN 'May name places' ELSE 'Ranks move too much to name places' END AS note FROM yearly JOIN stability USING (metric) GROUP BY metric""",
    YEARLY, DISPERSED, STABILITY,
)
def star_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yearly(spark, sf_dir).groupBy("metric").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("entity").alias("entities"))
    out = rows.join(stability(spark, sf_dir).select("metric", F.col("stable").alias("rank_stable")), "metric")
    return out.withColumns({
        "family": F.when(F.col("metric") < "3", "FAST").otherwise("SLOW"), "comparable": F.col("metric") != "4-NOT SPECIFIED",
        "note": F.when(F.col("rank_stable"), "May name places").otherwise("Ranks move too much to name places"),
    })


@query("SELECT DISTINCT month, year(month)::INT AS year, quarter(month)::INT AS quarter, month(month)::INT AS month_number, strftime(month, '%Y-%m') AS label, (year(month) * 12 + month(month))::INT AS sort_key FROM monthly", MONTHLY)
def star_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = monthly(spark, sf_dir).select("month").distinct()
    return months.select("month", F.year("month").alias("year"), F.quarter("month").alias("quarter"), F.month("month").alias("month_number"), F.date_format("month", "yyyy-MM").alias("label"), (F.year("month") * 12 + F.month("month")).alias("sort_key"))


@query("SELECT metric, month, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(min(value), 6) AS lowest, round(max(value), 6) AS highest FROM monthly WHERE metric <> '4-NOT SPECIFIED' GROUP BY ALL", MONTHLY)
def extract_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: r6(F.percentile("value", F.lit(p)))
    return monthly(spark, sf_dir).where("metric <> '4-NOT SPECIFIED'").groupBy("metric", "month").agg(F.count("*").alias("n"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"), r6(F.min("value")).alias("lowest"), r6(F.max("value")).alias("highest"))


@query(
    f"""SELECT zone, round(sum(value) FILTER (WHERE metric = '1-URGENT' AND year = {LAST_YEAR}), 6) AS urgent_now, round(sum(value) FILTER (WHERE metric = '1-URGENT' AND year = {FIRST_YEAR}), 6) AS urgent_then,
    round(max(value) FILTER (WHERE metric = '5-LOW'), 6) AS peak_low, round(avg(value) FILTER (WHERE metric = '2-HIGH' AND year = {LAST_YEAR}), 6) AS mean_high FROM yearly GROUP BY zone""",
    YEARLY,
)
def pinned_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, peaks and means under pinned filters: the pins replace whatever the context filters on these columns."""
    at = lambda m, y: F.when((F.col("metric") == m) & (F.col("year") == y), F.col("value"))
    return yearly(spark, sf_dir).groupBy("zone").agg(
        r6(F.sum(at("1-URGENT", LAST_YEAR))).alias("urgent_now"), r6(F.sum(at("1-URGENT", FIRST_YEAR))).alias("urgent_then"),
        r6(F.max(F.when(F.col("metric") == "5-LOW", F.col("value")))).alias("peak_low"), r6(F.avg(at("2-HIGH", LAST_YEAR))).alias("mean_high"),
    )


@query("SELECT geo.entity, geo.zone, p.publications, p.first_obs FROM (SELECT n_name AS entity, r_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey) geo LEFT JOIN (SELECT entity, count(*) AS publications, min(obs) AS first_obs FROM published WHERE rel >= obs AND zone <> 'ASIA' GROUP BY entity) p ON geo.entity IS NOT DISTINCT FROM p.entity", PUBLISHED)
def null_safe_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose keys match nulls to nulls; places without publications keep nulls, not zeros."""
    counts = valid(spark, sf_dir).where("zone <> 'ASIA'").groupBy(F.col("entity").alias("e")).agg(F.count("*").alias("publications"), F.min("obs").alias("first_obs"))
    return places(spark, sf_dir).join(counts, F.col("entity").eqNullSafe(F.col("e")), "left").select("entity", "zone", "publications", "first_obs")


@query("SELECT obs, rel, n_entities, first_rank FROM (SELECT obs, rel, count(*) AS n_entities, round(avg(r), 6) AS first_rank FROM (SELECT *, rank() OVER (PARTITION BY obs, rel ORDER BY n) + (count(*) OVER (PARTITION BY obs, rel, n) - 1) / 2.0 AS r FROM published) GROUP BY ALL)", PUBLISHED)
def rank_by_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = published(spark, sf_dir).withColumn("r", ranking.average_rank(["obs", "rel"], "n"))
    return rows.groupBy("obs", "rel").agg(F.count("*").alias("n_entities"), r6(F.avg("r")).alias("first_rank"))


@query("SELECT n_name AS state, count(*) FILTER (WHERE s_suppkey IS NOT NULL) AS suppliers, bool_and(coalesce(s_acctbal > -1000, true)) AS all_in_band FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) GROUP BY n_name")
def exists_and_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    rows = nation.join(customer.select("c_nationkey"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").join(supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.groupBy(F.col("n_name").alias("state")).agg(F.count("s_suppkey").alias("suppliers"), F.bool_and(F.coalesce(F.col("s_acctbal") > -1000, F.lit(True))).alias("all_in_band"))


#: Tables that a measure may join, many to one; any other pair is refused rather than multiplied.
RELATIONSHIPS = {("lineitem", "orders"): ("l_orderkey", "o_orderkey"), ("orders", "customer"): ("o_custkey", "c_custkey"), ("customer", "nation"): ("c_nationkey", "n_nationkey"), ("nation", "region"): ("n_regionkey", "r_regionkey"), ("lineitem", "part"): ("l_partkey", "p_partkey"), ("lineitem", "supplier"): ("l_suppkey", "s_suppkey")}


def related(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Tables joined along the allowed relationships, in order; a pair without one raises."""
    out = table(spark, sf_dir, names[0])
    for i, name in enumerate(names[1:], 1):
        pair = next(((a, name) for a in reversed(names[:i]) if (a, name) in RELATIONSHIPS), None)
        if pair is None:
            raise ValueError(f"no relationship leads to {name} from {', '.join(names[:i])}")
        many, one = RELATIONSHIPS[pair]
        out = out.join(table(spark, sf_dir, name), F.col(many) == F.col(one))
    return out


@query("SELECT r_name AS zone, p_type AS item, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def allowed_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = related(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region", "part")
    return rows.groupBy(F.col("r_name").alias("zone"), F.col("p_type").alias("item")).agg(F.count("*").alias("n"))
