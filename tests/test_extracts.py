"""Extracts, manifests, the fallback reader, repeatable loads, and the newer operators on small frames."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import constraints, ranking
from ledgerline.operators import publication as pub
from ledgerline.sources import extracts, tables


def test_extracts_manifest_and_fallback(spark, tmp_path):
    df = spark.range(7).toDF("k")
    manifest = extracts.write_extracts({"a": df, "b": df.limit(2)}, str(tmp_path))
    assert {(r["name"], r["rows"]) for r in manifest.collect()} == {("a", 7), ("b", 2)}
    assert extracts.with_fallback(spark, lambda: df, str(tmp_path), "a")[1] == "live"

    def unreachable():
        return spark.read.parquet(f"{tmp_path}/nothing-here")

    got, how = extracts.with_fallback(spark, unreachable, str(tmp_path), "a")
    assert how == "extract" and got.count() == 7
    with pytest.raises(AnalysisException):
        extracts.with_fallback(spark, unreachable, str(tmp_path), "unknown")
    df.limit(3).write.mode("overwrite").parquet(f"{tmp_path}/a")
    with pytest.raises(extracts.RowCountError):
        extracts.with_fallback(spark, unreachable, str(tmp_path), "a")


def test_expected_row_counts(spark):
    expected = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "name string, rows long")
    got = extracts.count_differences({"a": spark.range(3), "b": spark.range(5), "d": spark.range(1)}, expected).collect()
    assert {tuple(r) for r in got} == {("b", 2, 5), ("c", 1, None), ("d", None, 1)}


def test_materialise_and_refresh(spark, tmp_path):
    path = f"{tmp_path}/view"
    assert extracts.materialise(spark.range(3).toDF("k"), path, ["k"]).count() == 3
    assert extracts.materialise(spark.range(5).toDF("k"), path, ["k"]).count() == 5
    with pytest.raises(ValueError, match="not unique"):
        extracts.materialise(spark.createDataFrame([(1,), (1,)], "k long"), path, ["k"])
    assert extracts.view(spark, path).count() == 5  # the old rows stay


def test_a_load_is_added_once(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("y",)], "v string")
    assert [extracts.load(df, str(tmp_path / "t"), i) for i in ("l1", "l1", "l2")] == [2, 0, 2]
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.count() == 4 and got.select("load_id", "line_number").distinct().count() == 4


def test_sorted_extracts_in_several_files(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("string").alias("k"))
    for one in (False, True):
        tables.write_text(df, str(tmp_path / f"out{one}"), ["k"], one)
        lines = [x for f in sorted((tmp_path / f"out{one}").glob("part-*")) for x in f.read_text().splitlines() if x != "k"]
        assert lines == sorted(lines) and len(lines) == 1000


def test_wrong_schemas_are_seen(spark):
    assert tables.missing_columns(spark.createDataFrame([(1, "x")], "r_regionkey long, r_name string"), "region") == ["r_regionkey"]
    assert tables.missing_columns(spark.createDataFrame([(1,)], "r_regionkey int"), "region") == ["r_name"]


@pytest.mark.parametrize("bound", [10_000, 500, 1])
def test_quantiles_are_exact(spark, bound):
    rng = np.random.default_rng(2)
    rows = [(g, float(x)) for g, xs in (("a", rng.normal(size=4000)), ("b", np.repeat([1.0, 2.0, 9.0], [900, 90, 10])), (None, [5.0, 6.0]), ("c", rng.integers(0, 5, 700))) for x in xs] + [("a", None), ("d", None)]
    shares = {"lo": 0.1, "mid": 0.5, "hi": 0.9, "least": 0.0, "most": 1.0}
    got = {r["g"]: r for r in ranking.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, bound).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert all(abs(r[n] - np.quantile(values, p)) < 1e-12 for n, p in shares.items()), g


def test_period_labels(spark):
    forms = {
        "Mar 1997": ("1997-03-01", "1997-03-01"), "Average of Mar-24": ("2024-03-01", "2024-03-01"), "Mar-97": ("1997-03-01", "1997-03-01"), "Jan-Mar 1997": ("1997-01-01", "1997-03-01"),
        "Nov 1996 - Feb 1997": ("1996-11-01", "1997-02-01"), "1st March 1997": ("1997-03-01", "1997-03-01"), "22nd September 2001": ("2001-09-01", "2001-09-01"),
        "nothing": (None, None), "Foo 1997": (None, None), "Mar-Jan 1997": (None, None), "": (None, None),
    }
    first, last = labels.period(F.col("t"))
    got = {r["t"]: (r["a"] and str(r["a"]), r["b"] and str(r["b"])) for r in spark.createDataFrame([(t,) for t in forms], "t string").select("t", first.alias("a"), last.alias("b")).collect()}
    assert got == forms


def test_callouts_and_cell_references(spark):
    name, number = labels.callout(F.col("t"))
    texts = {"Place (1,234.5)": ("Place", 1234.5), " A b ( 7 ) ": ("A b", 7.0), "Place (x)": (None, None), "Place 12": (None, None), "(12)": (None, None), "P (a) (3)": ("P (a)", 3.0), "Place (12": (None, None), "": (None, None)}
    assert {r["t"]: (r["n"], r["v"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", name.alias("n"), number.alias("v")).collect()} == texts
    letters, row = labels.cell_reference(F.col("t"))
    refs = {"AB12": ("AB", 12, 28), "Z1": ("Z", 1, 26), "12": (None, None, None), "A": (None, None, None), "1A": (None, None, None), "A-1": (None, None, None)}
    got = spark.createDataFrame([(t,) for t in refs], "t string").select("t", letters.alias("l"), row.alias("r"), labels.column_index(letters).alias("i")).collect()
    assert {r["t"]: (r["l"], r["r"], r["i"]) for r in got} == refs


def test_classes_duplicates_and_offending_rows(spark):
    df = spark.createDataFrame([(" North  East ",), ("lagos",), ("Total",)], "t string")
    got = [r[0] for r in df.select(labels.classify(F.col("t"), {"north east": "ZONE", "lagos": "STATE"})).collect()]
    assert got == ["ZONE", "STATE", "UNCLASSIFIED"]
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 6), (4, "a", 6), (5, None, 1), (6, None, 1)], "id int, k string, v int")
    status = {r["id"]: (r["status"], r["duplicate_of"]) for r in constraints.duplicate_of(rows, ["k"], ["v"], "id").collect()}
    assert status == {**dict.fromkeys((1, 2, 3, 4), ("DATE_CONFLICT", None)), 5: ("ACTIVE", None), 6: ("EXACT_DUPLICATE", 5)}
    bad = constraints.offending(rows, ["id"], {"small": F.col("v") < 6, "named": F.col("k").isNotNull(), "null": F.lit(None).cast("boolean")}).collect()
    assert {(r["check_name"], r["id"]) for r in bad} == {("small", 3), ("small", 4), ("named", 5), ("named", 6)}
    assert [tuple(r) for r in constraints.duplicates(rows, ["k"], F.col("v") == 6).collect()] == [("a", 2)]


def test_all_pairs_of_releases(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-03-01", 2.0), ("a", "2024-04-01", 2.0)], "k string, rel string, value double").withColumn("rel", F.to_date("rel"))
    got = {(r["months_apart"], r["kind"]) for r in pub.all_pairs(rows, ["k"]).collect()}
    assert got == {(2, "KNOWN_CONFLICT"), (3, "KNOWN_CONFLICT"), (1, "IDENTICAL")}
