"""Packing: ids as the tokenizer gives them, places without gaps, as few sequences as best-fit over all pieces."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import packing

MODEL = open("/opt/tokenizers/word_bpe_49k.json", "rb").read()
WHOLE = Tokenizer.from_str(MODEL.decode())
ODD = ["", None, " ", "a", "<|endoftext|> x<|startoftext|>", "It's we'll THEY'D, don't... ÉTÉ Σίσυφος ΌΣΟΣ.", "é ≮ ́x", "a b c\x1cd\x85e", "12,345.67!?", "Wait...what?!'s", "İstanbul ǅ ß", "x" * 5000, "漢字かな 한국어", "\n\n\t" * 400]


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return len(by)


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    assert packing.token_ids(MODEL, text).tolist() == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbÉéσΣς's,.!?<|>endoftx \t\ń \u0085\x1c09漢"), max_size=60))
def test_ids_word_by_word_are_those_of_the_text(text):
    assert packing.token_ids(MODEL, text).tolist() == whole(text)


def test_stretches_of_a_long_text_join_without_a_seam(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 50)
    text = " ".join(f"Word{i}, it's {'y' * (i % 70)}!" for i in range(300))
    assert packing.token_ids(MODEL, text).tolist() == whole(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_takes_the_fullest_bin_that_has_room(sizes):
    bins, offsets, fills = packing.best_fit(np.array(sizes, dtype=np.int64), 40)
    plain, at = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [b for b, f in enumerate(plain) if f + sizes[i] <= 40]
        full = max(fit, key=lambda b: plain[b], default=None)
        if full is None:
            plain.append(0)
            full = len(plain) - 1
        at[i] = plain[full]
        plain[full] += sizes[i]
    assert sorted(fills.tolist()) == sorted(plain)
    assert all(fills[b] >= o + s for b, o, s in zip(bins, offsets, sizes, strict=True))


def test_every_piece_has_its_place_and_its_ids(spark):
    texts = [*ODD, "word " * 9000, "the same words here", "the same words here"]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id int")
    rows = packing.query(docs).collect()
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*whole(t), 1], dtype="<u4")
        want += [(i if i != 5 else None, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    assert sorted(map(str, [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows])) == sorted(map(str, want))
    check(rows, 4096)
    assert packing.query(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", ["1 + id * 7919 % 4096", "2049 + id * 31 % 300", "if(id < 2500, 2100 + id % 900, 1 + id % 90)", "4096", "1", "if(id % 2 = 0, 2049, 2047)"])
def test_a_tree_of_many_leaves_packs_nearly_as_well_as_one(spark, sizes):
    items = spark.range(5000).select("id", F.expr(sizes).cast("long").alias("length"), F.lit(0).alias("offset_"))
    rows = packing.pack(items, leaf=400, fan=3).collect()
    assert sorted(r["id"] for r in rows) == list(range(5000))
    n, all_at_once = check(rows, 4096), len(packing.best_fit(np.array([r["length"] for r in rows]))[2])
    assert math.ceil(sum(r["length"] for r in rows) / 4096) <= n <= all_at_once * 1.03 + 1


def test_nodes_send_up_a_bounded_number_of_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "KEEP", 4)
    items = spark.range(3000).select("id", F.lit(2100).alias("length"))
    assert check(packing.pack(items, leaf=50, fan=4).collect(), 4096) == 3000


def test_sequences_hold_the_ids_of_their_documents(spark):
    docs = spark.createDataFrame([(i, f"document number {i} " * (i + 1)) for i in range(40)], "doc_id long, text string")
    out = packing.sequences(packing.pack(packing.pieces(docs), capacity=4096)).collect()
    got = {}
    for r in out:
        at = 0
        for d in r["doc_ids"]:
            n = len(whole(f"document number {d} " * (d + 1))) + 1
            got[d] = r["ids"][at : at + n]
            at += n
        assert at == len(r["ids"])
    assert got == {i: [*whole(f"document number {i} " * (i + 1)), 1] for i in range(40)}
