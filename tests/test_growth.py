"""What a task holds or computes doesn't grow with every row where it need not."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline import catalogue
from ledgerline.operators import constraints, coverage
from ledgerline.plans import loads

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


@pytest.mark.parametrize("name", ["month_label_parse", "period_forms"])
def test_labels_are_read_after_they_are_counted(spark, name):
    lines = plan(catalogue.queries()[name](spark, SF))
    counted = max(i for i, line in enumerate(lines) if "Aggregate" in line)
    assert any("regexp_extract" in line for line in lines[: counted + 1])
    assert not any("regexp_extract" in line for line in lines[counted + 1 :])  # below the count, where rows are


@pytest.mark.parametrize("keys", [["a"], ["a", "b"]])
def test_keys_are_counted_as_bits(spark, keys):
    rng = random.Random(3)
    some = lambda near: rng.choice([None, rng.randint(-near, near), rng.randint(-near, near), rng.choice([2**63 - 1, -(2**63), 64, -64])])
    rows = [(rng.choice("xy"), some(70), some(9)) for _ in range(2000)] + [("z", None, None)]
    df, text = spark.createDataFrame(rows, "g string, a long, b long"), F.concat_ws(":", *keys)
    want = df.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct(text).alias("d"))
    assert sorted(coverage.counted(df, ["g"], keys, "d", text).collect()) == sorted(want.collect())
    want = df.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct(*keys).alias("d"))
    assert sorted(coverage.counted(df, ["g"], keys, "d").collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["anomaly_register", "union_anomaly_register"])
def test_registers_hold_words_and_not_keys(spark, name):
    grouped = [line for line in plan(catalogue.queries()[name](spark, SF)) if "Aggregate [" in line]
    assert any("bit_or" in line for line in grouped) and not any("Aggregate [" in line and ("l_orderkey#" in line.split("],")[0] or "key#" in line.split("],")[0]) for line in grouped)


def test_a_key_is_held_once_with_a_count_for_each_check(spark):
    rows = spark.createDataFrame([(1, 9), (1, 9), (1, 2), (2, 1), (3, None), (None, 7)], "id int, v int")
    bad = constraints.offending(rows, ["id"], {"small": F.col("v") < 6, "odd": F.col("v") % 2 == 1})
    assert sorted(map(str, bad.collect())) == sorted(map(str, spark.createDataFrame([("small", 1, 2), ("odd", 1, 1), ("small", None, 1)], "check_name string, id int, n_rows long").collect()))
    lines = plan(bad)
    counted = max(i for i, line in enumerate(lines) if "Aggregate" in line)
    assert not any("Generate" in line for line in lines[counted:])


def test_extracts_that_are_read_back_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(loads, "folder", lambda spark: f"file://{tmp_path}")
    assert {r["survive"] == r["cells"] for r in catalogue.queries()["preserved_fields"](spark, SF).collect()} == {True}
    assert list(tmp_path.rglob("part-*.csv.gz")) and not list(tmp_path.rglob("part-*.csv"))
