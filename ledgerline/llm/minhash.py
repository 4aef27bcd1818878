"""Near duplicates by Jaccard similarity of five-word shingles: MinHash buckets propose, the texts decide.

Words are simhash's. A text's signature is BANDS x ROWS minima of its shingles' 64-bit hashes under
multiply-add permutations; the texts that agree in all rows of a band share a bucket. A pair of
similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS, which is 0.9996 at 0.8. Keys are
64-bit hashes of texts, so exact copies are one node. In each bucket the text with most company is compared
with the others, by the exact similarity of shingle sets; what is similar is then one component. After that, all
texts of a bucket that are in different components are compared. So pairs grow with the rows where a bucket's
texts belong together, no pair of a bucket that could join two components is left out, and sizes of shingle
sets, and sketches of the sets themselves, exclude pairs before texts move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, map_slices, parted
from ledgerline.llm.simhash import components, version, without

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
SEED = 42
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
#: Tasks that share the pairs of one text, or the texts of a bucket of over BIG; tasks that share the members of a group.
SALTS, BIG, MEMBER_SALTS = 64, 4096, 16
#: Texts of a bucket that one task pairs with as many; hashes of a sketch, and what a sample of half as many may lack.
TILE, SKETCH, MARGIN = 512, 512, 0.11
#: Shingles that are permuted at once.
STEP = 2048


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles; fewer than k words make one, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    of = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):  # order counts: each step mixes before the next word is added
        out = (out ^ of[i : len(of) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def buckets(text: str | None) -> tuple[int, list[int]]:
    """The number of shingles, and a bucket for each band; none without words."""
    own = shingles(text)
    if not len(own):
        return 0, []
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(own), STEP):
        np.minimum(least, (own[None, at : at + STEP] * FACTORS[:, None] + TERMS[:, None]).min(axis=1), out=least)
    return len(own), [xxhash.xxh64_intdigest(band.tobytes(), seed=i) - 2**63 for i, band in enumerate(least.reshape(BANDS, ROWS))]


def _worded(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(text, k) of the rows with a word; the key is a hash of the text, so exact copies are one node."""
    return _worded(docs).select("text", F.xxhash64(version(F.col("text"))).alias("k"))


def _at_buckets(docs: DataFrame) -> DataFrame:
    """(k, bucket, size) of every text, once; size is the number of its shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [buckets(t) for t in batch.column(0).to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(f[1]) for f in found]))
        sizes = pa.array([n for n, f in found for _ in f], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(1).take(rows), pa.array([b for _, f in found for b in f], pa.int64()), sizes], names=["k", "bucket", "size"])

    rows = map_slices(_keyed(docs), run, "k long, bucket long, size long").groupBy("bucket", "k").agg(F.first("size").alias("size"))
    rows = cut(rows, "minhash-buckets")
    return cut(_at(rows, rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")), "minhash-shared")


def _at(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows joined with of, one row a bucket with its number n of rows; the rows of a bucket of over BIG are dealt over SALTS tasks."""
    big = of.where(F.col("n") > BIG).select("bucket")
    (hot, cold), (hot_of, cold_of) = parted(rows, ["bucket"], big, ["bucket"]), parted(of, ["bucket"], big, ["bucket"])
    salted = hot_of.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = hot.withColumn("__salt", F.pmod(F.xxhash64("k"), F.lit(SALTS))).join(salted.hint("merge"), ["bucket", "__salt"]).drop("__salt")
    return cold.join(cold_of.hint("merge"), "bucket").unionByName(dealt)


def _ordered(one: str, other: str, *more: Column) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b"), *more]


def _alike(one: str, other: str) -> Column:
    """Sets of such sizes can have the similarity."""
    return F.least(one, other) >= SIMILARITY * F.greatest(one, other) - 1e-6


def head_pairs(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: each bucket's head and every other text in it. The head has most company in all of its buckets, as the original of many copies does."""
    company = shared.groupBy("k").agg(F.sum("n").alias("company"))
    ranked = shared.join(company.hint("merge"), "k").groupBy("bucket").agg(F.max(F.struct("company", "k", "size")).alias("top"), F.count("*").alias("n"))
    met = _at(shared.drop("n"), ranked.select("bucket", "n", F.col("top.k").alias("head"), F.col("top.size").alias("its")))
    return met.where((F.col("head") != F.col("k")) & _alike("size", "its")).select(*_ordered("head", "k")).distinct()


def sketch(text: str | None) -> tuple[int, list[int]]:
    """A level, and the shingles' hashes, 31 bits each, below 2^(31 - level): all of them where the level is 0, at most about SKETCH."""
    own = np.unique(shingles(text) >> np.uint64(33)).astype(np.int64)
    level = max(0, int(len(own) - 1).bit_length() - SKETCH.bit_length() + 1) if len(own) > SKETCH else 0
    return level, own[own < 1 << (31 - level)].tolist()


def _sketches(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(k, level, sketch) of the texts of some keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sketch(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["k", "level", "sketch"])

    likely, _ = parted(_keyed(docs), ["k"], needed, ["k"])
    made = map_slices(likely.select("k", "text"), run, "k long, level int, sketch array<int>").groupBy("k").agg(F.first("level").alias("level"), F.first("sketch").alias("sketch"))
    return made.join(needed.hint("merge"), "k")


def left_pairs(docs: DataFrame, shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a < b: texts of a bucket that are in different components so far and whose sketches allow the similarity; none where a bucket is in one component.

    A bucket's texts are dealt over tiles of TILE, and each pair of tiles is a group of its own. Sketches are
    compared inside the join, so a pair that can't be similar is no row. A sketch of level 0 holds all shingles; one
    of a higher level is a sample, and a pair has to be under the similarity by MARGIN to be left out.
    """
    of = roots.select(F.col("node").alias("k"), "root")
    marked = cut(shared.join(of.hint("merge"), "k", "left").withColumn("root", F.coalesce("root", "k")), "minhash-marked")
    mixed = marked.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("bucket", "n")
    rows = cut(_at(marked.drop("n"), mixed), "minhash-mixed")
    sketches = _sketches(docs, cut(rows.select("k").distinct(), "minhash-mixed-keys"))
    rows = rows.join(sketches.hint("merge"), "k").withColumn("tiles", F.ceil(F.col("n") / TILE)).withColumn("tile", F.pmod(F.xxhash64("k"), F.col("tiles")))
    rows = cut(rows, "minhash-tiles")
    mine = lambda x, y, end: rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("__o"), "tile", *[F.col(c).alias(f"{c}_{end}") for c in ("k", "size", "root", "level", "sketch")]).select("bucket", F.col(x).alias("__x"), F.col(y).alias("__y"), *[f"{c}_{end}" for c in ("k", "size", "root", "level", "sketch")])
    both = mine("tile", "__o", "p").join(mine("__o", "tile", "q").hint("merge"), ["bucket", "__x", "__y"])
    top = F.greatest("level_p", "level_q")
    below = lambda end: F.when(F.col(f"level_{end}") == top, F.col(f"sketch_{end}")).otherwise(F.filter(f"sketch_{end}", lambda h: h < F.pow(F.lit(2.0), 31 - top)))
    common = F.size(F.array_intersect(below("p"), below("q")))
    least = F.when(top == 0, SIMILARITY - 0.01).otherwise(SIMILARITY - MARGIN)
    near = F.when((F.col("root_p") != F.col("root_q")) & _alike("size_p", "size_q"), common >= least * (F.size(below("p")) + F.size(below("q")) - common)).otherwise(False)
    return both.where((F.col("k_p") < F.col("k_q")) & near).select(*_ordered("k_p", "k_q")).distinct()


def similar(docs: DataFrame, proposed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (a, b) proposed whose texts are similar.

    Texts meet in shuffled joins at every size; those that no pair needs don't move. The pairs of one text
    are dealt over SALTS tasks, and the text goes to those that have any.
    """
    salt = lambda other: F.pmod(F.xxhash64(other), F.lit(SALTS))
    found = cut(proposed.select("a", "b", salt("b").alias("at_a"), salt("a").alias("at_b")), "minhash-pairs")
    needed = cut(found.select(F.col("a").alias("k")).union(found.select("b")).distinct(), "minhash-keys")
    likely, _ = parted(_keyed(docs), ["k"], needed, ["k"])
    texts = cut(likely.join(needed.hint("merge"), "k").dropDuplicates(["k"]), "minhash-texts")
    ends = lambda end, text: found.select(end, f"at_{end}").distinct().join(texts.select(F.col("k").alias(end), F.col("text").alias(text)).hint("merge"), end).hint("merge")
    both = found.join(ends("a", "x"), ["a", "at_a"]).join(ends("b", "y"), ["b", "at_b"]).select("a", "b", "x", "y")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = [jaccard(shingles(x), shingles(y)) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return map_slices(both, run, "a long, b long")


def links(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b, keys of texts: links by which all texts of a bucket that are similar are in one component.

    First each bucket's head is compared with the others. Then all pairs of a bucket that are still in different
    components are, so no pair in a common bucket is left out; pairs inside a component are not needed.
    """
    shared = _at_buckets(docs)
    first = cut(similar(docs, head_pairs(shared), similarity), "minhash-links")
    return first.union(similar(docs, left_pairs(docs, shared, cut(components(first), "minhash-roots")), similarity))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of docs without the later texts of each group of linked ones: the smallest by (doc_id, md5 of the text) stays.

    Defined results: null doc_ids, and null and wordless texts, take no part and stay; exact copies are linked;
    repeated rows stay or go together; of several texts under one doc_id each goes only with its own group; groups
    are the links' components.
    """
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    roots = cut(components(links(named, similarity)), "minhash-roots")
    rows = _worded(named).select("doc_id", version(F.col("text")).alias("v")).withColumn("k", F.xxhash64("v"))
    rows = rows.join(roots.hint("merge"), F.col("k") == F.col("node"), "left").select("doc_id", "v", F.coalesce("root", "k").alias("root"))
    rows = cut(rows, "minhash-members")
    best = rows.groupBy("root").agg(F.min(F.struct("doc_id", "v")).alias("best"), F.count("*").alias("n")).where("n > 1")
    salted = best.select("root", "best", F.explode(F.sequence(F.lit(0), F.lit(MEMBER_SALTS - 1))).alias("s"))
    met = rows.withColumn("s", F.pmod(F.xxhash64("doc_id", "v"), F.lit(MEMBER_SALTS))).join(salted.hint("merge"), ["root", "s"])
    return without(docs, met.where("doc_id <> best.doc_id OR v <> best.v").select("doc_id", "v"))
