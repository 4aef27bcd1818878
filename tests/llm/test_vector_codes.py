"""Vector codes against plain loops over all distances, whatever the numbers; bounds are bounds."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def plain(rows, rounds=4, entries=256):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**40 else int(x) * 1024 for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((i, e) for i, e, _ in kept if i is not None)
    width = len(first[0][1])
    usable = [(i, e, label) for i, e, label in kept if len(e) == width]
    step = width // 4
    part = lambda e, p: e[p * step : (p + 1) * step]
    books = [[part(e, p) for i, e in first if len(e) == width][:entries] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((dist(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        fresh = []
        for p, book in enumerate(books):
            of = {}
            for _, e, _ in usable:
                of.setdefault(near(part(e, p), book)[1], []).append(part(e, p))
            fresh.append([[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else entry for k, entry in enumerate(book)])
        books = fresh
    out, sums = [], {}
    for i, e, label in kept:
        if len(e) != width:
            out.append((i, None, None, label))
            continue
        found = [near(part(e, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(map(str, [(i, c, e, sums.get(label), digest) for i, c, e, label in out]))


def rows_of(df):
    return sorted(map(str, [tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(1, 30), st.sampled_from([3, 50, 4_000_000]), st.integers(0, 10**6))
def test_nearest_is_the_first_of_the_least_distances(width, n, k, size, seed):
    r = np.random.default_rng(seed)
    x, c = r.integers(-size, size + 1, (n, width)), r.integers(-size, size + 1, (k, width))
    all_ = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    best, error, _ = v.nearest(x, c)
    assert best.tolist() == all_.argmin(axis=1).tolist() and error.tolist() == all_.min(axis=1).tolist()
    for s in v.LEVELS:
        a, b = v.segment_sketch(x, s), v.segment_sketch(c, s)
        assert ((((a[:, None] - b[None]) ** 2).sum(axis=2)) <= all_ + 1e-6 * (1 + size) ** 2).all()


def test_bounds_leave_few_exact_distances():
    r = np.random.default_rng(0)
    centres = r.integers(-5000, 5000, (256, 16))
    x = centres[r.integers(0, 256, 4000)] + r.integers(-200, 200, (4000, 16))
    assert v.nearest(x, centres)[2] < 0.02 * 4000 * 256


@pytest.mark.parametrize("big", [0.0, 1e7, 1e30, 1e200])
def test_codes_of_odd_vectors(spark, big):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=8).round(3).tolist(), int(i % 3) if i % 5 else None) for i in range(330)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[9][1], 2), (900, None, 1), (901, [NAN] * 8, 1), (902, [None] + [0.5] * 7, 1), (903, [INF] * 8, 1), (904, [-INF] + [0.0] * 7, 1)]
    rows += [(905, [], 7), (906, [1.0] * 4, 7), (907, [-0.0005, 0.0] * 4, None), (-1, [big, -big] * 4, 9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("error", F.lit("clash")).withColumn("salt", F.lit(0))
    assert rows_of(v.query(df)) == plain(rows)


def test_few_vectors_odd_widths_and_empty_tables(spark):
    rows = [(3, [1.0, 2.0, 3.0, 4.0], 1), (1, [0.5, 0.25, -3.0, 9.0], None), (2, [0.5, 0.25, -3.0, 9.0], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(v.query(df)) == plain(rows)
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SCHEMA)
    assert [(r["code"], r["error"]) for r in v.query(odd).collect()] == [(None, None)]
    assert v.query(df.limit(0)).count() == 0


def test_decoded_vectors_lie_at_the_error(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist(), 0) for i in range(300)], SCHEMA)
    kept = v.usable(df)
    books, width = v.fit(kept)
    out = v.decode(v.encode(kept, books, width), books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    for row in out:
        assert row["error"] == sum((math.floor(1024 * x) - round(1024 * y)) ** 2 for x, y in zip(row["embedding"], row["vector"], strict=True))
