"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import decontaminate, dialogues, language, licenses, line_chunks, packing, pieces, quality, rules, simhash, token_counts, toxicity

LONG = "word and another " * 20_000
EXTRA = ["score", "h", "gone", "chunk", "fp", "key", "block", "first", "component_id", "a", "__kept", "tokens"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [
    (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "   \n\t", None, None, 5), (4, LONG, "en", "s", len(LONG)), (5, "x" * 50_000, "de", "s", 50_000),
    (6, "one two three four five", "en", "s", 23), (6, "one two three four five", "en", "s", 23), (7, "one two three four five", "en", "s", 23),
    (None, "no id at all\nbut two lines", "en", "s", 5), (8, "123 456 !!! ###", "fr", "s", 15), (9, "ein\nzwei\ndrei\nvier\n", "de", "s", 19),
    (10, "ein\nzwei\ndrei\nvier\n", "de", "s", 19), (-5, "emoji 😀 ퟿ ▁ tab\tnul\x00end", "en", "s", 12), (2**62, "big id", "en", "s", 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i == 6)) for i in range(1, 9)] + [(None, None, None), (3, 0, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five and some more"), (2, None), (3, ""), (None, "x"), (4, "word and another word and another")], "item_id bigint, text string")


QUERIES = {
    "op2": lambda d, lab, b: pieces.query(d),
    "op3": lambda d, lab, b: language.query(d),
    "op4": lambda d, lab, b: licenses.query(d),
    "op5": lambda d, lab, b: toxicity.query(d, lab),
    "op6": lambda d, lab, b: quality.query(d, lab),
    "op7": lambda d, lab, b: token_counts.count_tokens(d),
    "op8": lambda d, lab, b: line_chunks.query(d),
    "op9": lambda d, lab, b: rules.cascade(d),
    "op10": lambda d, lab, b: simhash.query(d),
}


@pytest.mark.parametrize("name", QUERIES)
def test_one_row_for_each_document(docs, labels, benchmark, name):
    got = QUERIES[name](docs, labels, benchmark).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    assert sorted((r["doc_id"] for r in got), key=lambda x: (x is None, x)) == sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))
    assert [r for r in sorted(got, key=key) if r["doc_id"] == 6][0] == [r for r in sorted(got, key=key) if r["doc_id"] == 6][1]


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table(docs, labels, benchmark, name):
    assert QUERIES[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).collect() == []


def test_decontamination_edges(docs, benchmark):
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.hits(docs, benchmark).collect()} == {(4, 4)}
    assert decontaminate.hits(docs, benchmark.limit(0)).collect() == []
    assert decontaminate.hits(docs.limit(0), benchmark).collect() == []
    assert decontaminate.keep_clean(docs, benchmark).count() == len(ROWS) - 1


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_keep_columns_and_survive(spark, docs, labels, benchmark, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage[1](spark, docs, str(tmp_path))
    out.collect()
    if stage is not corpus_pipeline.STAGES[-1]:
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    assert stage[1](spark, docs.limit(0), str(tmp_path)).collect() == []


def test_defined_results(docs, labels):
    und = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.query(docs).collect()}
    assert all(und[i] == ("und", 0.0) for i in (1, 2, 3, 8))
    zero = {r["doc_id"]: r for r in simhash.query(docs).collect()}
    assert {zero[i]["fingerprint"] for i in (1, 2, 3)} == {"0" * 16} and {zero[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert {zero[i]["component_id"] for i in (6, 7)} == {6}
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}
    assert tokens[1] == tokens[2] == 0
    base = {r["doc_id"]: r for r in rules.cascade(docs).collect()}
    assert base[1]["n_words"] == 0 and base[1]["base_failed"] and not base[1]["kept"]
    lines = {r["doc_id"]: r for r in line_chunks.query(docs).collect()}
    assert lines[1]["kept_md5"] is None and lines[9]["n_removed_lines"] == 0 and lines[10]["n_removed_lines"] > 0
    assert line_chunks.dedup(docs).where("text IS NULL").count() == 1
    trip = {r["doc_id"]: r["round_trip"] for r in pieces.query(docs).collect()}
    assert trip.pop(-5) is False and all(trip.values())  # U+2581 decodes to a blank


def test_without_anything_to_learn_from(docs, labels):
    assert {r["lang_pred"] for r in language.query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["score"] for r in quality.query(docs, labels.limit(0)).collect()} == {0.5}
    assert len(toxicity.query(docs, labels.limit(0)).collect()) == len(ROWS)


def test_packing_edges(docs):
    rows = packing.query(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert [by[i] for i in (1, 2, 3)] == [[(0, 0, 1)]] * 3  # the end id alone
    assert by[6][0] == by[6][1] == (0, 0, 6) and sorted(by[4])[0] == (0, 0, 4096) and sum(n for _, _, n in by[4]) == 60_001
    assert None in by and packing.query(docs.limit(0)).collect() == []


def test_very_long_texts_in_the_newer_operators(spark):
    long = "word and another, " * 200_000  # 3.6 million characters
    rows = packing.query(spark.createDataFrame([(1, long), (2, "x" * 1_500_000), (3, " " * 2_000_000)], "doc_id long, text string")).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 800_001 and [r["length"] for r in rows if r["doc_id"] == 3] == [1]
    talk = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 2, "user", " " * 1_500_000)], "conv_id long, turn long, role string, text string")
    (r,) = dialogues.summaries(talk).collect()
    assert (r["audit"], r["cost"], r["blank"], r["truncated"]) == ("KKD", 7, 1, 1)
