"""Label, callout, period and sheet-shape queries over text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import coverage
from ledgerline.plans.stand_in import YEARLY, query, r6, yearly
from ledgerline.sources.tables import table


@query("SELECT label, count(*) AS n FROM (SELECT lower(trim(regexp_replace('  ' || p_name || '  ' || p_type || ' ', '\\s+', ' ', 'g'))) AS label FROM part) GROUP BY label")
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type", F.lit(" "))
    return table(spark, sf_dir, "part").groupBy(labels.normalise(raw).alias("label")).agg(F.count("*").alias("n"))


@query(
    """SELECT name, count(*) AS n, round(sum(price::DECIMAL(18,2))::DOUBLE, 6) AS total FROM (SELECT trim(left(t, length(t) - length(list_last(string_split(t, '('))) - 1)) AS name,
    TRY_CAST(replace(rtrim(list_last(string_split(t, '(')), ')'), ',', '') AS DOUBLE) AS price
    FROM (SELECT p_brand || ' (' || (p_size // 10) || ',' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.5)' AS t FROM part)) GROUP BY name"""
)
def regex_callout_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(" ("), F.floor(F.col("p_size") / 10).cast("string"), F.lit(","), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".5)"))
    name, number = labels.callout(text)
    return table(spark, sf_dir, "part").select(name.alias("name"), number.alias("price")).groupBy("name").agg(F.count("*").alias("n"), r6(F.sum(F.col("price").cast("decimal(18,2)")).cast("double")).alias("total"))


@query(
    """SELECT p_partkey, member FROM (SELECT p_partkey, unnest(string_split(p_type || '/' || p_brand, '/')) AS member FROM part) WHERE p_partkey NOT IN (
    SELECT p_partkey FROM (SELECT p_partkey, unnest(string_split(p_type || '/' || p_brand, '/')) AS member FROM part)
    WHERE member NOT IN (SELECT p_type FROM part UNION SELECT p_brand FROM part WHERE p_partkey <= 12))"""
)
def slash_tie_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'A/B' becomes two rows only if every part is in the dimension: known types, and the brands of the first parts."""
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_type").alias("member")).union(part.where("p_partkey <= 12").select("p_brand")).distinct()
    rows = part.select("p_partkey", F.explode(F.split(F.concat_ws("/", "p_type", "p_brand"), "/")).alias("member"))
    unresolved = rows.join(known, "member", "left_anti").select("p_partkey").distinct()
    return rows.join(unresolved, "p_partkey", "left_anti").select("p_partkey", "member")


PREFIXES = [("part-1", "ONE"), ("part-19", "NINETEEN"), ("part-2", "TWO"), ("part-", "OTHER")]


@query(
    f"""SELECT kind, count(*) AS n FROM (SELECT p_partkey, kind FROM part JOIN (VALUES {", ".join(map(str, PREFIXES))}) v(prefix, kind) ON starts_with('part-' || p_partkey, prefix)
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) = 1) GROUP BY kind"""
)
def prefix_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest matching prefix decides. The prefix list is a constant, so it becomes a chain of conditions, longest first."""
    label = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    kind = F.coalesce(*[F.when(label.startswith(p), k) for p, k in sorted(PREFIXES, key=lambda x: -len(x[0]))])
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def sha256_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query("SELECT digest, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')))) AS digest FROM documents) GROUP BY digest HAVING count(*) > 1")
def digest_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.lower(F.trim(F.regexp_replace("text", "[ \t\n]+", " "))), 256)
    return table(spark, sf_dir, "documents").groupBy(digest.alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT p_size AS index, CASE WHEN k <= 26 THEN chr(64 + k) ELSE chr(64 + (k - 1) // 26) || chr(65 + (k - 1) % 26) END AS letter, count(*) AS n FROM (SELECT p_size, (p_size * 14 - 13)::INT AS k FROM part) GROUP BY ALL")
def a1_column_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("index"), labels.column_letter(F.col("p_size") * 14 - 13).alias("letter")).agg(F.count("*").alias("n"))


@query("SELECT month, count(*) AS n FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month FROM orders) GROUP BY month")
def month_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months written as labels ('Average of Mar-97') and read back; two-digit years are those from 1951 to 2050. Labels are counted first, then read, so each is read once."""
    label = F.concat(F.lit("Average of "), F.date_format("o_orderdate", "MMM-yy"))
    counted = table(spark, sf_dir, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return counted.groupBy(labels.period(F.col("label"))[0].alias("month")).agg(F.sum("n").alias("n"))


@query(
    """SELECT first, last, form, count(*) AS n FROM (SELECT date_trunc('month', o_orderdate)::DATE AS m, o_orderkey % 6 AS form FROM orders), LATERAL (SELECT m AS first,
    (CASE form WHEN 2 THEN m + to_months(12 - month(m)::INT) WHEN 3 THEN m + to_months(14) ELSE m END)::DATE AS last) GROUP BY ALL"""
)
def period_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of period labels, one for each remainder of the order key, written, counted and read back: first and last month."""
    day, form = F.col("o_orderdate"), F.col("o_orderkey") % 6
    of = lambda d, p: F.date_format(d, p)
    label = (
        F.when(form == 0, of(day, "MMM yyyy")).when(form == 1, F.concat(F.lit("Average of "), of(day, "MMM-yy")))
        .when(form == 2, F.concat(of(day, "MMM"), F.lit("-Dec "), of(day, "yyyy"))).when(form == 3, F.concat(of(day, "MMM yyyy"), F.lit(" - "), of(F.add_months(F.trunc(day, "MM"), 14), "MMM yyyy")))
        .when(form == 4, F.concat(F.lit("1st "), of(day, "MMMM yyyy"))).otherwise(of(day, "MMMM yyyy"))
    )
    counted = table(spark, sf_dir, "orders").groupBy(label.alias("label"), form.alias("form")).agg(F.count("*").alias("n"))
    first, last = labels.period(F.col("label"))
    return counted.groupBy(first.alias("first"), last.alias("last"), "form").agg(F.sum("n").alias("n"))


@query(
    """SELECT label, class, count(*) AS n FROM (SELECT lower(trim(regexp_replace(raw, '[ ]+', ' ', 'g'))) AS label FROM (
    SELECT '  ' || n_name || ' ' AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'All  Nations' FROM region UNION ALL SELECT c_mktsegment FROM customer)), LATERAL (SELECT CASE WHEN label IN (SELECT lower(n_name) FROM nation) THEN 'STATE' WHEN label IN (SELECT lower(r_name) FROM region) THEN 'ZONE'
    WHEN label = 'all nations' THEN 'NATIONAL' ELSE 'UNCLASSIFIED' END AS class) GROUP BY ALL"""
)
def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row labels by class: state, zone, national, or unclassified, which is reported and not dropped. Labels are counted first, then resolved."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    raw = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("raw"))
    raw = raw.union(placed.select("r_name")).union(region.select(F.lit("All  Nations"))).union(customer.select("c_mktsegment"))
    counted = raw.groupBy(labels.normalise(F.col("raw")).alias("label")).agg(F.count("*").alias("n"))
    known = nation.select(labels.normalise(F.col("n_name")).alias("label"), F.lit("STATE").alias("class")).union(region.select(labels.normalise(F.col("r_name")), F.lit("ZONE")))
    known = known.union(spark.createDataFrame([("all nations", "NATIONAL")], "label string, class string"))
    return counted.join(known, "label", "left").select("label", F.coalesce("class", F.lit("UNCLASSIFIED")).alias("class"), "n")


@query(
    """SELECT o_orderstatus AS status, prev, next, count(*) AS n FROM (SELECT o_orderstatus, lag(o_orderstatus) OVER w AS prev, lead(o_orderstatus) OVER w AS next FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE prev = next AND prev <> o_orderstatus GROUP BY ALL"""
)
def neighbour_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ from both neighbours in their sequence, which agree with each other."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.lag("o_orderstatus").over(w).alias("prev"), F.lead("o_orderstatus").over(w).alias("next"))
    return rows.where("prev = next AND prev <> status").groupBy("status", "prev", "next").agg(F.count("*").alias("n"))


@query(
    """SELECT CASE WHEN k <= 26 THEN chr(64 + k) ELSE chr(64 + (k - 1) // 26) || chr(65 + (k - 1) % 26) END AS letters, k AS column_index, row_number, count(*) AS n FROM (SELECT (p_size * 17 % 700 + 1)::INT AS k, (p_partkey % 40 + 1)::INT AS row_number FROM part) GROUP BY ALL"""
)
def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet references written from a column index and a row, and taken apart again."""
    text = F.concat(labels.column_letter(F.col("p_size") * 17 % 700 + 1), (F.col("p_partkey") % 40 + 1).cast("string"))
    letters, number = labels.cell_reference(text)
    return table(spark, sf_dir, "part").groupBy(letters.alias("letters"), labels.column_index(letters).alias("column_index"), number.alias("row_number")).agg(F.count("*").alias("n"))


@query("SELECT entity, metric, 'y' || year AS period, round(value, 6) AS value FROM yearly", YEARLY)
def unpivot_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a column a year, turned back into rows; empty cells give no row."""
    rows = yearly(spark, sf_dir)
    years = sorted(r["year"] for r in rows.select("year").distinct().collect())  # the sheet's header: one cell a year
    sheet = rows.groupBy("entity", "metric").pivot("year", years).agg(F.max("value"))
    sheet = sheet.select("entity", "metric", *[F.col(f"`{y}`").alias(f"y{y}") for y in years])
    return sheet.unpivot(["entity", "metric"], [f"y{y}" for y in years], "period", "value").where("value IS NOT NULL").withColumn("value", r6("value"))


@query(
    """SELECT page_id, line, block FROM (SELECT page_id, i, line, last_value(CASE WHEN line LIKE '<h%' OR line LIKE '%<p%' THEN line END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS block FROM
    (SELECT page_id, generate_subscripts(string_split(html, chr(10)), 1) AS i, unnest(string_split(html, chr(10))) AS line FROM pages)) WHERE block IS NOT NULL"""
)
def carry_forward_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading line above each line of a page, carried down: lines are cut at the headings inside the row, so none moves."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.split("html", "\n", -1).alias("lines"))
    heading = lambda x: x.like("<h%") | x.like("%<p%")
    heads = lines.withColumn("heads", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: heading(F.element_at("lines", i)))).where(F.size("heads") > 0)
    ends = F.concat(F.slice("heads", 2, F.size("heads")), F.array(F.size("lines") + 1))
    blocks = F.zip_with("heads", ends, lambda at, end: F.transform(F.slice("lines", at, end - at), lambda x: F.struct(x.alias("line"), F.element_at("lines", at).alias("block"))))
    return heads.select("page_id", F.inline(F.flatten(blocks)))


@query(
    """SELECT page_id, count(*) AS kept FROM (SELECT page_id, max((trim(line) = '')::INT) OVER (PARTITION BY page_id ORDER BY i) AS ended FROM
    (SELECT page_id, generate_subscripts(string_split(html, chr(10)), 1) AS i, unnest(string_split(html, chr(10))) AS line FROM pages)) WHERE ended = 0 GROUP BY page_id"""
)
def block_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a block up to its first blank row, found inside the row."""
    lines = F.split("html", "\n", -1)
    first = F.array_position(F.transform(lines, lambda x: F.trim(x) == ""), True)
    kept = F.when(first > 0, first - 1).otherwise(F.size(lines)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", kept.alias("kept")).where("kept > 0")


@query("SELECT event_type, (props->>'k')::INT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return rows.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query(
    """SELECT event_type, user_id, day FROM (SELECT DISTINCT event_type, user_id FROM events), (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day)
    WHERE dayofweek(day) BETWEEN 1 AND 5 EXCEPT SELECT event_type, user_id, ts::DATE FROM events"""
)
def weekday_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays of the table's range on which a series, an event type of a user, has no row: each series is a bitmap of days."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.unix_date(F.to_date("ts")).alias("day"))
    span = rows.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    covered = coverage.bitmaps(rows, ["event_type", "user_id"], F.col("day")).crossJoin(span)
    gaps = coverage.missing(covered, F.col("lo"), F.col("hi"), lambda d: F.pmod(d + 3, F.lit(7)) < 5)  # day 0 was a Thursday
    return gaps.select("event_type", "user_id", F.date_from_unix_date(F.col("index").cast("int")).alias("day"))
