"""Table registry, text scans and sinks. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in (c.split(" ", 1) for c in text.split(", "))])


#: Columns that each table must have, as Spark types.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A registered Parquet table; Parquet carries its own types, so only the name is checked here."""
    if name not in TABLES:
        raise KeyError(f"{name} is not registered")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def missing_columns(df: DataFrame, name: str) -> list[str]:
    """Registered columns that df lacks or has with another type (timestamps with or without zone count as one)."""
    have = {c: t.replace("timestamp_ntz", "timestamp") for c, t in df.dtypes}
    return [c for c, t in (x.split(" ", 1) for x in TABLES[name].split(", ")) if have.get(c) != t]


def scan_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, every column text and absence as '': no value is read as a number or turned into null. Quotes inside quotes are doubled."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    read = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return read.select([F.coalesce(c, F.lit("")).alias(c) for c in columns])


def scan_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records under a given schema."""
    return spark.read.schema(schema).json(path)


def write_text(df: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """A CSV extract in a total order: sorted ranges, whose files follow each other by name; on request one file, for small extracts."""
    rows = df.orderBy(*order)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of stored files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of a full outer join on path whose digests differ or that only one side has."""
    a, b = found.select("path", F.col("sha256").alias("found")), expected.select("path", F.col("sha256").alias("expected"))
    return a.join(b, "path", "full").where(~F.col("found").eqNullSafe(F.col("expected")))
