"""Operators on small frames with gaps, ties, nulls and empty input."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import labels
from ledgerline.operators import change, constraints, publication, ranking
from ledgerline.sources import tables


def one(spark, column, schema="x string", rows=((None,),)):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_latest_takes_the_greatest_version_and_keeps_columns(spark):
    df = spark.createDataFrame([("a", 1, 10, "x"), ("a", 3, 30, None), ("a", 2, 99, "z"), ("b", 1, 5, "q")], "k string, rel int, v int, note string")
    assert sorted(map(tuple, publication.latest(df, ["k"], ["rel"]).collect())) == [("a", 3, 30, None), ("b", 1, 5, "q")]
    assert publication.latest(df.limit(0), ["k"], ["rel"]).collect() == []


def test_gaps_are_named(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2024, 1, 1)), ("a", d(2024, 3, 1)), ("b", d(2024, 2, 1))], "k string, month date")
    assert sorted(map(tuple, publication.gaps(df, ["k"], "month").collect())) == [("a", d(2024, 2, 1)), ("b", d(2024, 1, 1)), ("b", d(2024, 3, 1))]


def test_ranks_equal_pandas_with_ties_and_nulls(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 60), "v": rng.integers(0, 6, 60).astype(float), "id": range(60)})
    got = spark.createDataFrame(pdf).select("id", ranking.average_rank(["g"], "v").alias("r"), ranking.share_rank(["g"], "v").alias("p")).toPandas().set_index("id").sort_index()
    assert np.allclose(got["r"], pdf.groupby("g")["v"].rank())
    assert np.allclose(got["p"], pdf.groupby("g")["v"].rank(pct=True))


def test_spearman_equals_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": [0] * 40, "a": rng.integers(0, 9, 40).astype(float), "b": rng.normal(size=40)})
    assert np.isclose(ranking.spearman(spark.createDataFrame(pdf), "a", "b", ["g"]).first()["rho"], pdf["a"].rank().corr(pdf["b"].rank()))


def test_longest_run(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate("1101110")] + [("b", 0, "0")], "k string, i int, x string")
    assert dict(map(tuple, ranking.longest_run(df, ["k"], "i", F.col("x") == "1").collect())) == {"a": 3, "b": 0}


def test_eta_squared(spark):
    df = spark.createDataFrame([("m", 1, 1.0), ("m", 1, 1.0), ("m", 2, 5.0), ("m", 2, 5.0), ("n", 1, 1.0), ("n", 2, 1.0)], "m string, f int, v double")
    assert dict(map(tuple, ranking.eta_squared(df, "m", "f", "v").collect())) == {"m": 1.0, "n": None}


def test_year_on_year_is_by_date_not_by_row(spark):
    months = [dt.date(2023, 1, 1), dt.date(2023, 3, 1), dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    df = spark.createDataFrame([("a", m, float(i + 1)) for i, m in enumerate(months)], "k string, month date, v double")
    assert [(r["month"], r["yoy_pct"]) for r in change.year_on_year(df, ["k"], "month", "v").collect()] == [(dt.date(2024, 1, 1), 200.0)]


def test_ratio_of_zero_or_null_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(change.ratio_pct(F.col("a"), F.col("b"))).collect()] == [None, None, 50.0]


def test_difference_kinds(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0 + 1e-14, 1.0), (2.0, 1.0), (1.1, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(publication.difference_kind(F.col("a"), F.col("b"))).collect()] == ["IDENTICAL", "PRECISION_ONLY", "KNOWN_CONFLICT", "SUBSTANTIVE"]


def test_checks_pass_on_null_and_count_false(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert tuple(constraints.violations(df, {"positive": F.col("x") > 0}).first()) == ("positive", 3, 1)
    assert tuple(constraints.violations(df.limit(0), {"positive": F.col("x") > 0}).first()) == ("positive", 0, 0)


def test_duplicate_keys_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a int, b int")
    assert [tuple(r) for r in constraints.duplicates(df, ["a", "b"]).collect()] == [(None, 1, 2)]


def test_orphans_skip_null_keys(spark):
    child, parent = spark.createDataFrame([(1,), (9,), (None,)], "k int"), spark.createDataFrame([(1,)], "p int")
    assert [tuple(r) for r in constraints.orphans(child, "k", parent, "p").collect()] == [(9,)]


@pytest.mark.parametrize(("text", "ok"), [("1166.00", True), ("12.5", True), ("0.10", True), ("1e3", False), ("abc", None), ("", None)])
def test_number_text_survives(spark, text, ok):
    assert one(spark, constraints.text_survives(F.col("x")), rows=[(text,)]) == [ok]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Lagos (1,234.5)", ("Lagos", 1234.5)), ("  Cross River (12) ", ("Cross River", 12.0)), ("Lagos", (None, None)), ("Lagos (x)", (None, None)), ("", (None, None)), (None, (None, None))],
)
def test_callouts(spark, text, want):
    name, number = labels.callout(F.col("x"))
    assert tuple(spark.createDataFrame([(text,)], "x string").select(name, number).first()) == want


def test_labels(spark):
    assert one(spark, labels.normalise(F.col("x")), rows=[("  A\t b \n C ",), (None,)]) == ["a b c", None]
    assert one(spark, labels.month_of_label(F.col("x")), rows=[("Average of Mar-24",), ("Jan-25",), ("total",), (None,)]) == [dt.date(2024, 3, 1), dt.date(2025, 1, 1), None, None]
    assert one(spark, labels.column_letter(F.col("x")), "x int", [(1,), (26,), (27,), (52,), (53,), (702,)]) == ["A", "Z", "AA", "AZ", "BA", "ZZ"]
    assert one(spark, labels.flags(F.col("x")), rows=[("A|B;C",), ("",), (None,)]) == [["A", "B", "C"], [], None]
    assert one(spark, labels.safe_number(F.col("x"), "decimal(10,2)").cast("string"), rows=[("",), ("0",), ("1.5",)]) == [None, "0.00", "1.50"]


def test_csv_round_trip_keeps_text(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("﻿a,b\n007,\n\"x\ny\",1.50\n".encode())
    df = tables.scan_text(spark, str(tmp_path / "in.csv"), ["a", "b"])
    assert sorted(map(tuple, df.collect())) == [("007", ""), ("x\ny", "1.50")]
    tables.write_text(df, str(tmp_path / "out"), ["a"])
    assert sorted(map(tuple, tables.scan_text(spark, str(tmp_path / "out"), ["a", "b"]).collect())) == [("007", ""), ("x\ny", "1.50")]


def test_digests_and_manifest(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    found = tables.digests(spark, str(tmp_path / "f"))
    row = found.first()
    assert row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert tables.manifest_differences(found, found).collect() == []
    other = spark.createDataFrame([(row["path"], "0"), ("gone", "1")], "path string, sha256 string")
    assert len(tables.manifest_differences(found, other).collect()) == 2


def test_unregistered_table_is_refused(spark):
    with pytest.raises(KeyError):
        tables.table(spark, "/nowhere", "secrets")


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_only_listed_relationships_may_be_joined(spark):
    from ledgerline.plans.extracts import related

    assert related(spark, "/root/testdata/sf0.001", "orders", "customer", "nation").count() == 1500
    with pytest.raises(ValueError, match="no relationship"):
        related(spark, "/root/testdata/sf0.001", "orders", "part")


def test_class_labels(spark):
    band, kind = labels.split_class(labels.canonical_class(F.col("x")))
    rows = spark.createDataFrame([(" a  non - md  1 ",), ("MD2",), (None,)], "x string")
    assert [tuple(r) for r in rows.select(band, kind).collect()] == [("A", "NON-MD1"), (None, "MD2"), (None, None)]
    assert one(spark, labels.segments(F.col("x"), "/"), rows=[("/a 10/ /b/",), ("",), (None,)]) == [["a 10", "b"], [], None]
