"""Very long runs in token counts; Unicode white space, numbers and marks in quality rules against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import rules, token_counts

RANKS = open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab1. \t\n\xa0\x85 \x1c'"), max_size=40), st.integers(2, 4))
def test_runs_of_white_space_are_the_pieces_that_the_pattern_makes(text, least):
    import regex

    old = token_counts.LONG_BLANK
    token_counts.LONG_BLANK = regex.compile(rf"\p{{White_Space}}{{{least},}}")
    try:
        assert token_counts.token_ids(RANKS, text).tolist() == token_counts._encoding(RANKS).encode_ordinary(text)
    finally:
        token_counts.LONG_BLANK = old


@pytest.mark.parametrize("unit", [" ", "\n", "\t \n", " ", "a", ".", "7"])
def test_a_million_of_a_kind(unit):
    text = "start " + unit * (10**6 // len(unit)) + "end"
    assert len(token_counts.token_ids(RANKS, text)) > 3


@pytest.mark.parametrize("unit", [" ", "\n", "a"])
def test_ten_million_of_a_kind(unit):
    ids = token_counts.token_ids(RANKS, unit * 10**7 + "x")
    assert b"".join(token_counts._encoding(RANKS).decode_single_token_bytes(i) for i in np.unique(ids)).strip(unit.encode() + b"x") == b""


def test_long_white_space_in_a_table(spark):
    docs = spark.createDataFrame([(1, " " * 10**6 + "x"), (2, "\n" * 10**6), (3, "one two")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()} == {i: len(token_counts.token_ids(RANKS, t)) for i, t in ((1, " " * 10**6 + "x"), (2, "\n" * 10**6), (3, "one two"))}


WORDS = ["½²", "no\xa0break", "word", "two", "٣٤", "á", "́", "Ⅷ", "ª", "漢", "---", "ǅ", "x y", " ", "٠a", "!", "#", "line\x85end", "\x1c"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", "\n", "\t", "\v", " \f"])), min_size=40, max_size=75), st.integers(0, 10**6)), min_size=5, max_size=20))
def test_quality_rules_and_sql_agree_on_odd_words(made):
    texts = ["".join(w + (str(n + i) if i % 3 else "") + b for i, (w, b) in enumerate(row)) for row, n in made] + [None, "", "½² word " * 30]
    duck = duckdb.connect()
    table = pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    duck.register("documents", table)
    want = {r[0]: r[1:] for r in duck.execute(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({rules.ORACLE})").fetchall()}
    for i, text in enumerate(texts):
        f = rules.Facts(text)
        failed = any(r.rejects(f) for r in rules.RULES if r.name in rules.BASE)
        assert want[i] == (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, not failed and rules.first_rejection(f, rules.RULES) is None)
