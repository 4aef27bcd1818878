"""Language identification by string kernels.

The kernel is a blended spectrum over presence: for p = 1, 2, 3 the number of p-grams that two texts
share, divided by the root of the product of their numbers of distinct p-grams, summed over p. A p-gram
is kept whole, as 21 bits a character, so every script counts. A bounded set of landmark texts gives a
Nystroem map; one-versus-rest kernel ridge regression is solved in that map on a bounded sample of
labelled rows, the same number from each language. Scoring looks the p-grams of a batch up among those of
the landmarks, in sorted order, and multiplies blocks of presence with blocks of landmarks and the result
with the coefficients.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, map_batches, map_slices, remainder

#: Labelled rows of the sample, and landmarks among them: so many, or one a language if that is more.
TRAIN_ROWS, LANDMARKS = 1500, 96
#: Distinct p-grams of a landmark, at most, where its language has such a text; else its shortest text.
LANDMARK_GRAMS = 50_000
ORDERS = (1, 2, 3)
RIDGE, SHARPNESS = 0.05, 4.0
FOLDS, HELD_OUT = 3, 1
#: Characters whose p-grams are made at once, and landmark p-grams in one block of the matrix product.
WINDOW, BLOCK = 1 << 20, 1 << 15
UNKNOWN = "und"
Grams = list[np.ndarray]  # for each order, the distinct p-grams of a text, ascending


@lru_cache(maxsize=None)
def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(text: str | None) -> Grams:
    """The distinct p-grams of a text; runs of non-letters count as one blank, which also stands at both ends."""
    points, found, tail = _points(text), [[] for _ in ORDERS], np.zeros(1, np.int64)
    for at in range(0, len(points), WINDOW):
        part = points[at : at + WINDOW]
        ids = np.concatenate([tail, np.where(_letters()[part], part, 0).astype(np.int64)])
        if at + WINDOW >= len(points):
            ids = np.append(ids, 0)
        ids = ids[np.append(True, (ids[1:] > 0) | (ids[:-1] > 0))]
        if ids.any():
            code = ids
            for k, p in enumerate(ORDERS):
                if p > 1:
                    code = (code[:-1] << 21) | ids[p - 1 :]
                found[k].append(np.unique(code))
        tail = ids[-(ORDERS[-1] - 1) :]
    return [np.unique(np.concatenate(x)) if len(x) > 1 else x[0] if x else np.zeros(0, np.int64) for x in found]


class Landmarks(NamedTuple):
    """For one order: the landmarks' p-grams, ascending, and for each the landmarks that hold it."""

    codes: np.ndarray
    starts: np.ndarray
    who: np.ndarray
    scale: np.ndarray  # of each landmark, 1 / root of its number of p-grams

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Landmarks:
        flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        codes, starts = np.unique(flat[order], return_index=True)
        return cls(codes, np.append(starts, len(flat)), who[order].astype(np.int32), _scale([len(x) for x in sets]))

    def shared(self, sets: list[np.ndarray]) -> np.ndarray:
        """texts x landmarks: p-grams in common over the root of the product of their numbers, in products of dense blocks."""
        flat, row = np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(self.codes, flat), max(len(self.codes) - 1, 0))
        hit = self.codes[at] == flat if len(self.codes) else np.zeros(len(flat), bool)
        used, column = np.unique(at[hit], return_inverse=True)
        row, out = row[hit], np.zeros((len(sets), len(self.scale)), np.float32)
        for lo in range(0, len(used), BLOCK):
            own = used[lo : lo + BLOCK]
            n = self.starts[own + 1] - self.starts[own]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[own], n)
            marks = np.zeros((len(own), len(self.scale)), np.float32)
            marks[np.repeat(np.arange(len(own)), n), self.who[inside]] = 1
            presence, here = np.zeros((len(sets), len(own)), np.float32), (column >= lo) & (column < lo + BLOCK)
            presence[row[here], column[here] - lo] = 1
            out += presence @ marks
        return out * _scale([len(x) for x in sets])[:, None] * self.scale[None, :]


def _scale(sizes: list[int]) -> np.ndarray:
    return (1 / np.sqrt(np.maximum(np.array(sizes, dtype=float), 1))).astype(np.float32)


class Model(NamedTuple):
    landmarks: list[Landmarks]  # one for each order
    coefficients: np.ndarray  # landmarks x languages
    languages: list[str]

    def kernel(self, texts: list[Grams]) -> np.ndarray:
        return sum(marks.shared([t[k] for t in texts]) for k, marks in enumerate(self.landmarks)) / len(ORDERS)


def learn(texts: list[Grams], langs: list[str], landmarks: int = LANDMARKS) -> Model:
    """Landmarks taken in turn from each language, at least one; ridge regression of +1/-1 targets in the Nystroem map."""
    languages = sorted(set(langs))
    queue: dict[str, list[int]] = {c: [] for c in languages}
    for i, c in enumerate(langs):
        queue[c].append(i)
    size = [sum(map(len, t)) for t in texts]
    fit_for = {c: [i for i in own if size[i] <= LANDMARK_GRAMS] or [min(own, key=size.__getitem__)] for c, own in queue.items()}
    chosen = [fit_for[c][k] for k in range(max(map(len, fit_for.values()))) for c in languages if k < len(fit_for[c])][: max(landmarks, len(languages))]
    marks = [texts[i] for i in chosen]
    model = Model([Landmarks.of([m[k] for m in marks]) for k in range(len(ORDERS))], np.zeros((1, 1)), languages)
    k_nm = np.concatenate([model.kernel(texts[i : i + 256]) for i in range(0, len(texts), 256)]).astype(float)
    k_mm = model.kernel(marks).astype(float)
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = (1 / np.array([len(queue[c]) for c in langs]))[:, None] * len(texts) / len(languages)  # each language counts alike
    left = k_nm.T @ (k_nm * weight) + RIDGE * k_mm + 1e-6 * np.eye(len(marks))
    return model._replace(coefficients=np.linalg.solve(left, k_nm.T @ (target * weight)).astype(np.float32))


def sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, lang): about `rows` documents with a lang outside the held-out remainder, an equal share from each language.

    A language with fewer gives all, and each gives one at least. The ids of a language are estimated
    first; only those under a bound on their hash meet in a task. Of several rows under one id and
    language the smallest text counts; an id with two languages gives a row for each.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    there = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("total"))
    there = F.broadcast(cut(there, "languages"))
    share = F.greatest(F.lit(1.0), F.floor(F.lit(float(rows)) / F.count("*").over(Window.partitionBy())))
    bound = F.lit(-(2.0**63)) + F.least(F.lit(1.0), (F.col("share") * 1.25 + 64) / F.greatest(F.lit(1), F.col("total"))) * F.lit(2.0**64)
    there = there.withColumn("share", share)
    near = usable.join(F.broadcast(there), "lang").where(F.xxhash64("doc_id") <= bound).select("lang", "doc_id", "share").distinct()
    of = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.withColumn("k", F.row_number().over(of)).where("k <= share").select("lang", "doc_id")
    found = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return cut(found.select("doc_id", "text", "lang"), "language-sample")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """P-grams are made where the sampled texts are; one task solves for the model, which reaches the driver."""
    chosen = sample(docs, rows)
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grams(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(len(ORDERS)))], names=["doc_id", "lang", *GRAM_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[Grams] = []
        langs: list[str] = []
        for b in batches:
            texts += [[np.asarray(x.values) for x in of] for of in zip(*(b.column(2 + k) for k in range(len(ORDERS))), strict=True)]
            langs += b.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(texts, langs, landmarks))], pa.binary())], names=["model"])

    made = map_slices(chosen, make, f"doc_id {kind}, lang string, " + ", ".join(f"{n} array<bigint>" for n in GRAM_NAMES))
    got = map_batches(made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "lang"), run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


GRAM_NAMES = tuple(f"p{p}" for p in ORDERS)


def classify(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; UNKNOWN and 0 for texts without a letter or without a model."""
    own = [grams(t) for t in texts] if model else []
    lettered = [i for i, g in enumerate(own) if len(g[0])]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if lettered:
        value = model.kernel([own[i] for i in lettered]) @ model.coefficients
        likely = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
        for i, best, share in zip(lettered, value.argmax(axis=1), 1 / likely.sum(axis=1), strict=True):
            langs[i], scores[i] = model.languages[best], float(share)
    return langs, scores


def query(docs: DataFrame) -> DataFrame:
    """op3: doc_id, held_out, lang_pred, score of every document.

    Defined results: null texts and texts without a letter get `und` and score 0; equal scores go to the
    first language by name; repeated rows give repeated rows; without a row to learn from all are `und`;
    columns besides doc_id, text and (for learning) lang are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = classify(shared.value, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
