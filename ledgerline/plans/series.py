"""Series and models: coverage bitmaps, ranks and runs over raw rows, prefixes, measures over related tables, closed domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import coverage, numbering, prefixes
from ledgerline.operators.model import Edge, Model
from ledgerline.plans.stand_in import MONTHLY, ORACLE, QUERIES, monthly, query, r6
from ledgerline.sources.tables import table


@query(
    """SELECT event_type, user_id, first, last, length FROM (SELECT event_type, user_id, min(d)::DATE AS first, max(d)::DATE AS last, count(*) AS length FROM (
    SELECT *, d - (row_number() OVER (PARTITION BY event_type, user_id ORDER BY d))::INT AS island FROM (
    SELECT event_type, user_id, unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS d FROM (SELECT DISTINCT event_type, user_id FROM events)
    EXCEPT SELECT event_type, user_id, ts::DATE FROM events)) GROUP BY event_type, user_id, island)"""
)
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days on which a series has no row: first, last and length, from its bitmap."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.unix_date(F.to_date("ts")).alias("day"))
    span = rows.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    covered = coverage.bitmaps(rows, ["event_type", "user_id"], F.col("day")).crossJoin(span)
    runs = coverage.gap_runs(covered, F.col("lo"), F.col("hi"))
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int")).alias(c)
    return runs.select("event_type", "user_id", day("first"), day("last"), "length")


@query(
    """SELECT event_type, value, n, round(first + (n - 1) / 2.0, 6) AS average_rank, round((first + (n - 1) / 2.0) / whole, 9) AS share_rank FROM (
    SELECT event_type, value, count(*) AS n, min(r) AS first, any_value(whole) AS whole FROM (SELECT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS whole
    FROM events WHERE value IS NOT NULL) GROUP BY event_type, value)"""
)
def raw_value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average and share rank of every value among the raw rows of its type, from counts and prefix sums."""
    ranks = numbering.value_ranks(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")
    return ranks.select("event_type", "value", "n", r6("average_rank").alias("average_rank"), F.round("share_rank", 9).alias("share_rank"))


@query(
    """SELECT user_id, count(*) AS n, round(sum((r + (t - 1) / 2.0)::DECIMAL(18,1))::DOUBLE / count(*), 6) AS mean_rank FROM (SELECT user_id, rank() OVER (PARTITION BY event_type ORDER BY value) AS r,
    count(*) OVER (PARTITION BY event_type, value) AS t FROM events WHERE value IS NOT NULL) GROUP BY user_id"""
)
def mean_rank_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank of each user's rows, the ranks of raw rows joined back."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").where("value IS NOT NULL")
    mean = F.sum(F.col("average_rank").cast("decimal(18,1)")).cast("double") / F.count("*")
    return numbering.with_ranks(rows, ["event_type"], "value").groupBy("user_id").agg(F.count("*").alias("n"), r6(mean).alias("mean_rank"))


@query(
    """SELECT event_type, coalesce(max(n) FILTER (high), 0) AS longest_run FROM (SELECT event_type, high, island, count(*) AS n FROM (SELECT event_type, high,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - row_number() OVER (PARTITION BY event_type, high ORDER BY ts, event_id) AS island
    FROM (SELECT event_type, ts, event_id, coalesce(value > 20, false) AS high FROM events)) GROUP BY ALL) GROUP BY event_type"""
)
def longest_raw_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most consecutive raw rows of a type, by time, with a high value, from the summaries of ranges."""
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return numbering.longest_runs(rows, ["event_type"], ["ts", "event_id"], F.col("value") > 20)


PREFIXES = "SELECT left(p_type || '-' || p_brand, 1 + (p_partkey * 7 % 16)::INT) AS prefix, min(p_partkey) AS rule FROM part GROUP BY 1"


@query(
    f"""SELECT label, prefix, rule FROM (SELECT DISTINCT p_type || '-' || p_brand || '-' || p_size AS label FROM part UNION SELECT p_name FROM part) LEFT JOIN ({PREFIXES}) p ON starts_with(label, prefix)
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY length(prefix) DESC NULLS LAST) = 1"""
)
def longest_prefix_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule whose prefix is the longest that a label begins with; the rules are a table, made of the parts."""
    part = table(spark, sf_dir, "part")
    full = F.concat_ws("-", "p_type", "p_brand")
    rules = part.groupBy(F.left(full, (1 + F.col("p_partkey") * 7 % 16).cast("int")).alias("prefix")).agg(F.min("p_partkey").alias("rule"))
    named = part.select(F.concat_ws("-", "p_type", "p_brand", F.col("p_size").cast("string")).alias("label")).union(part.select("p_name")).distinct()
    return prefixes.longest_prefix(named, "label", rules, "prefix")


#: Relationships, many to one, and pairs that must not be joined, with the reason.
EDGES = [
    Edge("lineitem", "l_orderkey", "orders", "o_orderkey"), Edge("orders", "o_custkey", "customer", "c_custkey"), Edge("customer", "c_nationkey", "nation", "n_nationkey"),
    Edge("nation", "n_regionkey", "region", "r_regionkey"), Edge("lineitem", "l_partkey", "part", "p_partkey"), Edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
ABSENT = {
    ("supplier", "nation"): "lines have a nation by their buyer; a second path would make it ambiguous", ("events", "customer"): "users are not customers", ("events", "orders"): "events have no order",
    ("part", "supplier"): "a part has many suppliers", ("orders", "part"): "an order has many parts", ("pages", "part"): "pages are not about parts", ("documents", "nation"): "languages are not nations",
}


def model(spark: SparkSession, sf_dir: str) -> Model:
    names = {n for e in EDGES for n in (e.many, e.one)}
    return Model({n: table(spark, sf_dir, n) for n in sorted(names)}, EDGES, ABSENT)


@query(
    """SELECT zone, item, count(*) AS lines, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS revenue, max(l_quantity) AS largest, min(l_discount) AS least_discount,
    count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*), 6) AS mean_quantity, max(l_shipdate)::DATE AS last_ship FROM (
    SELECT l.*, r_name AS zone, p_type AS item FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE r_name IN ('ASIA', 'EUROPE') AND p_size > 10 AND s_acctbal > 0 AND o_orderstatus <> 'P') GROUP BY ALL"""
)
def model_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten measures of one context: filters on four tables reach the lines along the relationships, and one aggregate gives all."""
    filters = {"region": F.col("r_name").isin("ASIA", "EUROPE"), "part": F.col("p_size") > 10, "supplier": F.col("s_acctbal") > 0, "orders": F.col("o_orderstatus") != "P"}
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    measures = {
        "lines": F.count("*"), "orders": F.countDistinct("l_orderkey"), "parts": F.countDistinct("l_partkey"), "revenue": F.round(total("l_extendedprice"), 2), "largest": F.max("l_quantity"),
        "least_discount": F.min("l_discount"), "returned": F.count_if(F.col("l_returnflag") == "R"), "suppliers": F.countDistinct("l_suppkey"),
        "mean_quantity": r6(total("l_quantity") / F.count("*")), "last_ship": F.to_date(F.max("l_shipdate")),
    }
    out = model(spark, sf_dir).measures("lineitem", {"region": ["r_name"], "part": ["p_type"]}, filters, measures)
    return out.withColumnsRenamed({"r_name": "zone", "p_type": "item"})


@query(
    " UNION ALL ".join(
        f"SELECT '{e.many}' AS many, '{e.one}' AS one, (SELECT count(*) FROM (SELECT {e.key} FROM {e.one} GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(*) FROM {e.many} WHERE {e.column} NOT IN (SELECT {e.key} FROM {e.one})) AS orphan_rows"
        for e in EDGES)
)
def broken_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each relationship, keys that aren't unique on the one side, and rows of the many side that lead nowhere."""
    return model(spark, sf_dir).broken()


CLASS_TEXT = ["  {}  -  non - md", "{} – MD 1", "{} -MD2", "{} - md 2 Special", "Life - line", "{} - MD 9", "{}-Non-MD ", "lifeline R2", "no such class", "F - MD1"]


@query(
    """SELECT raw, band, mdclass, known, count(*) AS n FROM (SELECT CASE k WHEN 0 THEN '  ' || lower(b) || '  -  non - md' WHEN 1 THEN b || ' – MD 1' WHEN 2 THEN b || ' -MD2' WHEN 3 THEN b || ' - md 2 Special' WHEN 4 THEN 'Life - line'
    WHEN 5 THEN b || ' - MD 9' WHEN 6 THEN b || '-Non-MD ' WHEN 7 THEN 'lifeline R2' WHEN 8 THEN 'no such class' ELSE 'F - MD1' END AS raw, CASE WHEN k IN (0, 1, 2, 3, 6) THEN b WHEN k IN (4, 7) THEN 'LIFELINE' END AS band,
    CASE k WHEN 0 THEN 'NON_MD' WHEN 1 THEN 'MD1' WHEN 2 THEN 'MD2' WHEN 3 THEN 'MD2_SPECIAL' WHEN 4 THEN 'NON_MD' WHEN 6 THEN 'NON_MD' WHEN 7 THEN 'NON_MD' END AS mdclass, k NOT IN (5, 8, 9) AS known
    FROM (SELECT p_partkey % 10 AS k, chr(65 + (p_size % 5)::INT) AS b FROM part)) GROUP BY ALL"""
)
def tariff_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published class labels, in their spellings, as band and metering class; a label outside the domain is reported as unknown, not guessed."""
    band = F.char(F.lit(65) + F.col("p_size") % 5)
    spelt = [F.concat(*[x for part in zip([F.lit(t) for t in form.split("{}")], [*[F.lower(band) if i == 0 else band] * (form.count("{}")), F.lit("")], strict=True) for x in part]) for i, form in enumerate(CLASS_TEXT)]
    raw = F.element_at(F.array(*spelt), (F.col("p_partkey") % 10 + 1).cast("int"))
    found = labels.tariff_class(F.col("raw"))
    rows = table(spark, sf_dir, "part").select(raw.alias("raw")).select("raw", found[0].alias("band"), found[1].alias("mdclass"))
    return rows.withColumn("known", F.col("band").isNotNull()).groupBy("raw", "band", "mdclass", "known").agg(F.count("*").alias("n"))


@query(
    """SELECT kind, count(*) AS n, count(number) AS numbers, sum(number) AS total FROM (SELECT event_id % 6 AS kind, CASE event_id % 6 WHEN 0 THEN value::DECIMAL(18,2) WHEN 4 THEN -(event_id::DECIMAL(18,2)) END AS number FROM events) GROUP BY kind"""
)
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as text: numbers pass, truth values, words, blanks and numbers that their text would not give back are refused."""
    form = F.col("event_id") % 6
    cell = (
        F.when(form == 0, F.col("value").cast("decimal(18,2)").cast("string")).when(form == 1, F.lit("true")).when(form == 2, F.lit("n/a")).when(form == 3, F.lit(" "))
        .when(form == 4, F.concat(F.lit("-"), F.col("event_id").cast("string"))).otherwise(F.lit("1.23456789012345678901234567890"))
    )
    number = labels.number_text(cell, "decimal(18,2)")
    return table(spark, sf_dir, "events").groupBy(form.alias("kind")).agg(F.count("*").alias("n"), F.count(number).alias("numbers"), F.sum(number).alias("total"))


@query(
    """SELECT alias, min(spelling) AS canonical, count(DISTINCT spelling) AS spellings, count(*) AS n FROM (SELECT spelling, lower(regexp_replace(spelling, '[^A-Za-z0-9]', '', 'g')) AS alias FROM (
    SELECT CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) WHEN 2 THEN replace(p_brand, '#', ' ') ELSE lower(p_brand) || '.' END AS spelling FROM part)) GROUP BY alias"""
)
def canonical_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of one name under one alias, the least of them as the canonical one."""
    form, brand = F.col("p_partkey") % 4, F.col("p_brand")
    spelling = F.when(form == 0, brand).when(form == 1, F.upper(brand)).when(form == 2, F.replace(brand, F.lit("#"), F.lit(" "))).otherwise(F.concat(F.lower(brand), F.lit(".")))
    rows = table(spark, sf_dir, "part").select(spelling.alias("spelling")).withColumn("alias", F.lower(F.regexp_replace("spelling", "[^A-Za-z0-9]", "")))
    counted = rows.groupBy("alias", "spelling").agg(F.count("*").alias("n"))
    return counted.groupBy("alias").agg(F.min("spelling").alias("canonical"), F.count("*").alias("spellings"), F.sum("n").alias("n"))


@query(
    """SELECT month, count(*) AS datasets FROM (SELECT 'o' AS d, date_trunc('month', o_orderdate)::DATE AS month FROM orders UNION SELECT 'l', date_trunc('month', l_shipdate)::DATE FROM lineitem UNION SELECT 'e', date_trunc('month', ts)::DATE FROM events) GROUP BY month"""
)
def month_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct union of the months that the facts have, and how many facts have each."""
    spine = lambda name, c: table(spark, sf_dir, name).select(F.lit(name[0]).alias("d"), F.trunc(c, "MM").alias("month")).distinct()
    return reduce(DataFrame.union, [spine("orders", "o_orderdate"), spine("lineitem", "l_shipdate"), spine("events", "ts")]).groupBy("month").agg(F.count("*").alias("datasets"))


#: Columns of a wide sheet that are facts, and ones that are derived from them and left out by name.
MEASURES, DERIVED = ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"]
OTHERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS measure, count({c}) AS n, sum({c}::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY l_returnflag" for c in MEASURES))
def excluded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of a sheet without its derived columns; a column that is neither known nor left out by name stops the read."""
    rows = labels.known_columns(table(spark, sf_dir, "lineitem"), [*MEASURES, *OTHERS], DERIVED)
    sums = rows.groupBy("l_returnflag").agg(*[F.struct(F.count(c).alias("n"), F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias("total")).alias(c) for c in MEASURES])
    return sums.unpivot("l_returnflag", MEASURES, "measure", "x").select("l_returnflag", "measure", "x.n", "x.total")


#: Objects of the mart whose rows are counted: the queries that make them.
MART = ["primary_by_flag", "primary_by_structure", "latest_restatement", "cross_release_stability", "coverage_matrix", "dataset_windows", "analysis_windows", "cost_panel_long", "cost_panel_wide", "anomaly_register", "fx_monthly_summary", "zone_vs_national_primary"]


def register_mart_counts() -> None:
    """Registered last, since its SQL holds that of the objects."""

    @query(" UNION ALL ".join(f"SELECT '{name}' AS object, count(*) AS n FROM ({ORACLE[name]})" for name in MART))
    def mart_object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rows of each object of the mart."""
        counts = [QUERIES[name](spark, sf_dir).agg(F.lit(name).alias("object"), F.count("*").alias("n")) for name in MART]
        return reduce(DataFrame.unionByName, counts)


@query(
    """SELECT metric, count(*) AS series, sum(months)::BIGINT AS n_rows, max(months)::BIGINT AS best, min(months)::BIGINT AS least FROM (SELECT entity, metric, count(DISTINCT month) AS months FROM monthly GROUP BY ALL) GROUP BY metric""",
    MONTHLY,
)
def covered_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that the series of a metric have, counted in their bitmaps."""
    rows = monthly(spark, sf_dir).select("entity", "metric", (12 * F.year("month") + F.month("month")).alias("i"))
    per = coverage.bitmaps(rows, ["entity", "metric"], F.col("i")).select("metric", coverage.present(F.col("words")).alias("months"))
    return per.groupBy("metric").agg(F.count("*").alias("series"), F.sum("months").alias("n_rows"), F.max("months").alias("best"), F.min("months").alias("least"))
