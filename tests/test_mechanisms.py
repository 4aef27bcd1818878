"""Loads, versions, fingerprints, numbering, coverage, prefixes, a database source and the relationship model."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from ledgerline import catalogue
from ledgerline.functions import labels
from ledgerline.operators import coverage, fingerprints, numbering, prefixes, skew
from ledgerline.operators.model import Edge, Model, RelationshipError
from ledgerline.sources import database, extracts, tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_line_numbers_follow_the_files_without_gaps(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("k"))
    df.where("k < 900 OR k > 1500").write.parquet(str(tmp_path / "t"))
    got = sorted((r["line_number"], r["k"]) for r in numbering.line_numbers(spark.read.parquet(str(tmp_path / "t"))).collect())
    assert [n for n, _ in got] == list(range(1, len(got) + 1)) and [k for _, k in got] == sorted(k for _, k in got)


def test_a_load_that_failed_is_done_again(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="broken row"):
        extracts.load(bad, path, "l1")
    good = spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("v"))
    assert extracts.load(good, path, "l1") == 100 and extracts.load(good, path, "l1") == 0
    rows = spark.read.parquet(path).orderBy("line_number").collect()
    assert [(r["line_number"], r["v"], r["load_id"]) for r in rows] == [(i + 1, str(i), "l1") for i in range(100)]
    (tmp_path / "t" / "load_id=l2").mkdir()  # a move that did not end
    assert extracts.load(good, path, "l2") == 100
    assert extracts.load(good, path, "l2") == 0 and spark.read.parquet(path).count() == 200


def test_lines_of_a_text_file_keep_their_order(spark, tmp_path):
    (tmp_path / "in.csv").write_text("﻿a,b\n" + "".join(f"{i},{'x' if i % 3 else ''}\n" for i in range(500)))
    extracts.load(tables.scan_text(spark, str(tmp_path / "in.csv"), ["a", "b"]), str(tmp_path / "t"), "one")
    assert [(r["line_number"], r["a"]) for r in spark.read.parquet(str(tmp_path / "t")).orderBy("line_number").collect()] == [(i + 1, str(i)) for i in range(500)]


def test_readers_see_one_version_during_a_refresh_and_after_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    rows = lambda f: spark.createDataFrame([(m, k, f(m, k)) for m in ("a b", "c/d", "e=1", None) for k in range(3)], "m string, k int, v int")
    old, new = rows(lambda m, k: k), rows(lambda m, k: k + 100 * (m == "c/d"))
    read = lambda: {(r["m"], r["k"]): r["v"] for r in extracts.view(spark, path).collect()}
    whole = lambda df: {(r["m"], r["k"]): r["v"] for r in df.collect()}
    extracts.refresh(spark, path, "m", old, lambda parts: old, ["m", "k"])
    assert read() == whole(old)
    held, seen = extracts.view(spark, path), []

    def build(parts):
        seen.append(parts)
        assert read() == whole(old)
        return new.where(F.col("m").isin(parts))

    files = lambda: {p for p in (tmp_path / "v" / "data").rglob("*.parquet")}
    before, real = files(), extracts.write_new
    monkeypatch.setattr(extracts, "write_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        extracts.refresh(spark, path, "m", new.where("m = 'c/d'"), build, ["m", "k"])
    assert read() == whole(old)
    monkeypatch.setattr(extracts, "write_new", real)
    before = files()
    extracts.refresh(spark, path, "m", new.where("m = 'c/d'"), build, ["m", "k"])
    assert read() == whole(new) and whole(held) == whole(old) and seen == [["c/d"], ["c/d"]]
    assert {p.parent.name for p in files() - before} == {"__part=c%2Fd"}  # one part is written
    gone = extracts.refresh(spark, path, "m", new.where("m = 'e=1'"), lambda parts: new.limit(0), ["m", "k"])
    assert {r["m"] for r in gone.collect()} == {"a b", "c/d", None}
    assert whole(extracts.roll_back(spark, path, 1)) == whole(old)
    extracts.write_new(spark, f"{path}/_versions/{extracts._version(spark, path)[0] + 1:010d}", '{"parts": {"=a')  # a writer that was lost
    assert read() == whole(old)
    extracts.refresh(spark, path, "m", new.where("m = 'c/d'"), lambda parts: new.where(F.col("m").isin(parts)), ["m", "k"])
    assert read() == whole(new)
    with pytest.raises(ValueError, match="did not change"):
        extracts.refresh(spark, path, "m", new.where("m = 'c/d'"), lambda parts: new, ["m", "k"])
    with pytest.raises(Exception):  # noqa: B017, PT011  two writers of one version: the second fails
        extracts._publish(spark, path, 1, {})


def test_equal_tables_are_told_without_a_join(spark):
    df = spark.range(100_000).select("id", (F.col("id") % 17).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("b"))
    assert fingerprints.differing(df, df.repartition(7), ["id"]) == {}
    same = fingerprints.changed_cells(df, df.repartition(7), ["id"])
    assert same.count() == 0
    changed = df.withColumn("b", F.when(F.col("id") == 500, None).otherwise(F.col("b"))).withColumn("a", F.when(F.col("id") == 501, -1).otherwise(F.col("a")))
    bad = fingerprints.differing(df, changed, ["id"])
    assert [cells for cells in bad.values()] == [{"a"}]  # 500's text was null before
    got = {(r["id"], r["column_name"], r["old_value"], r["new_value"], r["kind"]) for r in fingerprints.changed_cells(df, changed, ["id"]).collect()}
    assert got == {(501, "a", str(501 % 17), "-1", "CHANGED")}


def test_fingerprints_see_moved_values_nulls_and_repeated_rows(spark):
    f = lambda rows: {r["column_name"]: (r["n"], r["total"]) for r in fingerprints.table_fingerprint(spark.createDataFrame(rows, "k int, a int, b int"), ["k"]).collect()}
    one = f([(1, 5, None), (2, 6, 7)])
    assert one == f([(2, 6, 7), (1, 5, None)])
    for other in ([(1, 6, None), (2, 5, 7)], [(1, 5, 0), (2, 6, 7)], [(1, 5, None), (2, 6, 7), (2, 6, 7)], [(1, None, 5), (2, 6, 7)], [(None, 5, None), (2, 6, 7)]):
        assert one != f(other)


@pytest.mark.parametrize("big", [10_000, 3])
def test_ranks_and_runs_of_a_hot_series(spark, monkeypatch, big):
    monkeypatch.setattr(skew, "BIG", big)
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("ab") if rng.random() < 0.9 else None, i, rng.choice([None, 1.0, 1.0, 2.5, 3.0, float(rng.randint(4, 60))])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(6)
    got = {r["i"]: (r["average_rank"], r["share_rank"]) for r in numbering.with_ranks(df, ["g"], "v").collect()}
    for g in ("hot", "a", "b", None):
        own = sorted(v for k, _, v in rows if k == g and v is not None)
        for k, i, v in rows:
            if k == g:
                mean = None if v is None else sum(j + 1 for j, x in enumerate(own) if x == v) / own.count(v)
                assert got[i] == (mean, None if v is None else mean / len(own))
    runs = {r["g"]: r["longest_run"] for r in numbering.longest_runs(df, ["g"], ["i"], F.col("v") < 3).collect()}
    for g in ("hot", "a", "b", None):
        flags = [v is not None and v < 3 for k, _, v in sorted(rows, key=lambda r: r[1]) if k == g]
        assert runs[g] == max((len(list(x)) for on, x in groupby(flags) if on), default=0)
    assert numbering.longest_runs(df.limit(0), ["g"], ["i"], F.col("v") < 3).count() == 0


def test_numbers_in_order_and_prefix_sums(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 4).alias("n"))
    assert sorted((r["number"], r["k"]) for r in numbering.numbered(df, ["k"]).collect()) == [(i + 1, i) for i in range(500)]
    n = {r["k"]: r["n"] for r in df.collect()}
    assert all(r["before"] == sum(n[j] for j in range(r["k"])) for r in numbering.prefix_sums(df, ["k"], "n").collect())


def test_bitmaps_of_periods(spark):
    has = {"a": {-70, -64, -1, 0, 63, 64, 130}, "b": set(range(-70, 131)), "c": {5}}
    df = spark.createDataFrame([(s, i) for s, own in has.items() for i in own] + [("a", 0), ("a", None), ("d", None)], "s string, i int")
    covered = coverage.bitmaps(df, ["s"], F.col("i"))
    assert {r["s"]: r["n"] for r in covered.select("s", coverage.present(F.col("words")).alias("n")).collect()} == {s: len(x) for s, x in has.items()}
    lacks = {(r["s"], r["index"]) for r in coverage.missing(covered, F.lit(-70), F.lit(130)).collect()}
    assert lacks == {(s, i) for s, own in has.items() for i in range(-70, 131) if i not in own}
    runs = sorted((r["s"], r["first"], r["last"], r["length"]) for r in coverage.gap_runs(covered, F.lit(-70), F.lit(130)).collect())
    assert runs == [("a", -69, -65, 5), ("a", -63, -2, 62), ("a", 1, 62, 62), ("a", 65, 129, 65), ("c", -70, 4, 75), ("c", 6, 130, 125)]


def test_gaps_move_no_series_times_days(spark):
    for name in ("weekday_gaps", "gap_runs"):
        text = plan(catalogue.queries()[name](spark, SF))
        assert "LeftAnti" not in text and "bit_or" in text


def test_page_folds_need_no_exchange(spark):
    for name in ("carry_forward_group", "block_termination"):
        assert "Exchange" not in plan(catalogue.queries()[name](spark, SF))


def test_longest_prefix_by_equality(spark):
    rng = random.Random(6)
    rules = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(4000)} | {"", "日本", "日"}
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(600)] + ["日本語", "本", None]
    table = spark.createDataFrame([(p, i) for i, p in enumerate(sorted(rules))], "prefix string, rule int")
    df = prefixes.longest_prefix(spark.createDataFrame([(t,) for t in texts], "t string"), "t", table, "prefix")
    assert sorted(str((r["t"], r["prefix"])) for r in df.collect()) == sorted(str((t, None if t is None else max((p for p in rules if t.startswith(p)), key=len))) for t in texts)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_class_domain_and_number_texts(spark):
    band, kind = labels.tariff_class(F.col("t"))
    forms = {"a - Non-MD": ("A", "NON_MD"), "E–MD 2 SPECIAL": ("E", "MD2_SPECIAL"), "Life Line": ("LIFELINE", "NON_MD"), "lifestyle": (None, None), "F - MD1": (None, None), "A - MD3": (None, None), "A MD1": (None, None), "": (None, None), "b  —  md1": ("B", "MD1")}
    got = spark.createDataFrame([(t,) for t in forms], "t string").select("t", band.alias("b"), kind.alias("k")).collect()
    assert {r["t"]: (r["b"], r["k"]) for r in got} == forms
    texts = {"12.50": "12.50", "-7": "-7.00", "true": None, "1e5": None, "": None, " 5": None, "1.234": None, "+5": None, ".5": None, "NaN": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", labels.number_text(F.col("t"), "decimal(18,2)").cast("string").alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == texts
    with pytest.raises(ValueError, match="unknown columns: c; lacking: d"):
        labels.known_columns(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), ["a", "d"], ["b"])


def test_writes_are_not_sent_to_a_database():
    for sql in ("SELECT 1", "with x as (select 'drop table a; insert' as t) select * from x", " VALUES 1 ;", "select * from t -- update\n"):
        assert database.read_only(sql) == sql
    for sql in ("DELETE FROM t", "select 1; drop table t", "with x as (delete from t returning *) select * from x", "", "create table t(a int)", "SELECT 1 INTO t; x"):
        with pytest.raises(database.ReadOnlyError):
            database.read_only(sql)


def test_a_database_is_read_in_parts_and_falls_back(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    jvm = spark._jvm
    jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    con = jvm.java.sql.DriverManager.getConnection(url + ";create=true")
    st = con.createStatement()
    st.executeUpdate("CREATE TABLE fact (id INT, name VARCHAR(10), amount DOUBLE)")
    st.executeUpdate("INSERT INTO fact VALUES " + ",".join(f"({i}, 'n{i % 3}', {i}.5)" for i in range(200)))
    con.close()
    df = database.database_table(spark, url, "fact", by="ID", tasks=5)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 200
    some = df.where("ID >= 150 AND NAME = 'n1'").select("ID")
    assert "PushedFilters" in plan(some) and "GreaterThanOrEqual(ID,150)" in plan(some) and some.count() == len([i for i in range(150, 200) if i % 3 == 1])
    assert database.database_query(spark, url, "SELECT name, sum(amount) AS s FROM fact GROUP BY name").count() == 3
    assert database.database_table(spark, url, "(SELECT * FROM fact WHERE id < 0) AS few", by="ID").count() == 0
    extracts.write_extracts({"fact": df}, str(tmp_path / "x"))
    got, how = extracts.with_fallback(spark, lambda: database.database_table(spark, url, "fact"), str(tmp_path / "x"), "fact")
    assert how == "live" and got.count() == 200
    lost = lambda: database.database_table(spark, f"jdbc:derby:{tmp_path}/nowhere", "fact")
    got, how = extracts.with_fallback(spark, lost, str(tmp_path / "x"), "fact")
    assert how == "extract" and got.count() == 200
    df.limit(3).write.mode("overwrite").parquet(str(tmp_path / "x" / "fact"))
    with pytest.raises(extracts.RowCountError):
        extracts.with_fallback(spark, lost, str(tmp_path / "x"), "fact")


@pytest.fixture(scope="module")
def star(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "fact": make([(1, 10, "x", 5), (2, 10, "y", 6), (3, 20, "x", 7), (4, None, "z", 8), (5, 99, "x", 9)], "id int, d int, m string, v int"),
        "day": make([(10, "jan"), (20, "feb"), (30, "mar")], "d int, month string"), "month": make([("jan", 1), ("feb", 1), ("mar", 1)], "month string, q int"),
        "metric": make([("x", "fuel"), ("y", "food"), ("z", "fuel")], "m string, family string"), "other": make([(1, 10)], "k int, d int"),
    }
    return tables, [Edge("fact", "d", "day", "d"), Edge("day", "month", "month", "month"), Edge("fact", "m", "metric", "m"), Edge("other", "d", "day", "d")]


def test_measures_follow_relationships(spark, star):
    tables, edges = star
    model = Model(tables, edges, {("other", "metric"): "another grain"})
    rows = model.filtered("fact", {"month": F.col("month") != "feb", "metric": F.col("family") == "fuel", "fact": F.col("v") < 9})
    assert [r["id"] for r in rows.collect()] == [1] and "LeftSemi" in plan(rows)
    got = {(r["q"], r["family"]): (r["n"], r["s"]) for r in model.measures("fact", {"month": ["q"], "metric": ["family"]}, {}, {"n": F.count("*"), "s": F.sum("v")}).collect()}
    assert got == {(1, "fuel"): (2, 12), (1, "food"): (1, 6), (None, "fuel"): (2, 17)}
    broken = {(r["many"], r["one"]): (r["duplicate_keys"], r["orphan_rows"]) for r in model.broken().collect()}
    assert broken == {("fact", "day"): (0, 1), ("day", "month"): (0, 0), ("fact", "metric"): (0, 0), ("other", "day"): (0, 0)}


def test_wrong_relationships_are_refused(spark, star):
    tables, edges = star
    model = Model(tables, edges, {("other", "metric"): "another grain"})
    for many, one, why in (("other", "metric", "another grain"), ("day", "fact", "0 paths"), ("other", "fact", "0 paths")):
        with pytest.raises(RelationshipError, match=why):
            model.path(many, one)
    with pytest.raises(RelationshipError, match="2 paths"):
        Model(tables, [*edges, Edge("fact", "m", "month", "month")]).path("fact", "month")
    with pytest.raises(RelationshipError, match="go round"):
        Model(tables, [*edges, Edge("month", "q", "fact", "id")])
    with pytest.raises(RelationshipError, match="no such column"):
        Model(tables, [Edge("fact", "nothing", "day", "d")])


def test_pairs_left_out_of_the_model_are_refused(spark):
    from ledgerline.plans.series import ABSENT, model

    found = model(spark, SF)
    assert len(ABSENT) == 7
    for many, one in ABSENT:
        with pytest.raises(RelationshipError, match="not related"):
            found.path(many, one)


def test_ten_measures_from_one_scan(spark):
    text = plan(catalogue.queries()["model_measures"](spark, SF))
    assert text.count("lineitem.parquet") == 1
