"""Quality by logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of letters, digits or other signs; a token equal to the one before it becomes a
repeat mark, so that the model sees repetition. One- and two-grams of the tokens are hashed into 2^18
columns; a document is a sparse vector of damped counts with unit length. Training makes
follow-the-regularised-leader updates over a bounded sample of labelled rows; scoring is a sparse dot
product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, labelled, map_batches, map_slices, remainder

#: Labelled rows that the model is trained on, at most.
TRAIN_ROWS = 6000
BITS = 18
BIAS = 1 << BITS
PASSES = 8
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.01
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
REPEAT = 0x9E3779B1


class Columns(dict):
    """Token -> hash, kept for the task, bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = found = crc32(token.encode("utf-8", "surrogatepass"))
        return found


def vector(known: Columns, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers, ascending, and values with unit length; column 2^BITS is the bias's own."""
    tokens = TOKEN.findall(text.lower()) if text else []
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    h[1:][h[1:] == h[:-1]] = REPEAT
    grams = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9))])
    at, n = np.unique((grams >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
    x = np.log1p(n)
    return at, (x / np.sqrt((x * x).sum())).astype(np.float32)


def train(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """FTRL-proximal, one update a document and pass; per-column rates; weights by the closed form. Both labels weigh alike in sum."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    rows = [(np.append(at, BIAS).astype(np.int64), np.append(x, 1.0), y) for at, x, y in rows]
    share = [len(rows) / (2 * max(1, sum(y == label for _, _, y in rows))) for label in (0, 1)]

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(passes):
        for at, x, y in rows:
            w = weights(at)
            g = share[y] * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(BIAS + 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Train in one task on at most `rows` labelled documents outside the held-out remainder; 2^18 + 1 weights reach the driver."""
    sample = cut(labelled(docs, labels, "quality", FOLDS, HELD_OUT, rows), "quality-sample")

    def sparse(known: Columns, batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [vector(known, t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in both], pa.list_(pa.int32())), pa.array([x for _, x in both], pa.list_(pa.float32())), batch.column(2)], names=["doc_id", "at", "x", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((np.asarray(a.values), np.asarray(x.values), y) for b in batches for a, x, y in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()], pa.binary())], names=["w"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    vectors = map_slices(sample, sparse, f"doc_id {kind}, at array<int>, x array<float>, y int", Columns)
    got = map_batches(vectors.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id"), learn, "w binary").collect()
    return np.frombuffer(bytes(got[0]["w"]), dtype=np.float32) if got else np.zeros(BIAS + 1, np.float32)


def with_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of docs; null, empty and tokenless texts get the bias alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(known: Columns, batch: pa.RecordBatch) -> pa.RecordBatch:
        w, dots = shared.value, []
        for text in batch.column(1).to_pylist():
            at, x = vector(known, text)
            dots.append(float(w[BIAS]) + float(w[at] @ x))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(dots, -30, 30))))], names=["doc_id", "score"])

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double", Columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op6: doc_id, held_out, score, predicted of every document.

    Defined results: null and empty texts get the score of the bias; repeated rows give repeated rows;
    without labels every score is 0.5; columns besides doc_id and text are ignored.
    """
    scored = with_scores(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
