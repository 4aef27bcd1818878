"""SimHash near-duplicate groups by anchor-point covering.

A 64-bit fingerprint is projected on fields of bits, each with a perfect binary code: the Golay code on
23 bits (covering radius 3), the Hamming code on 15 (radius 1). Anchors are the tuples of code words.
Every fingerprint x has one home anchor, within the covering radius in each field. If y differs from x
in at most t = 2 bits, the home of x lies within radius + e of y in each field, where the excesses e add
up to t or less. So y is replicated to each anchor within the covering radius plus the threshold, homes
and replicas meet in an equi-join on the anchor, and bit_count(x XOR y) decides. No pair within the
threshold can be missed.

Only distinct fingerprints are replicated, so exact copies cost one row whatever their number. Two Golay
fields make 61 replicas and 2^24 anchors; a third, Hamming field makes 153 and 2^35. Both find
the same pairs; the number of distinct fingerprints decides which compares and moves fewer rows. A
fingerprint has at most 64 + 2016 others within two bits, which bounds the links by the input. Groups
come from alternating large-star and small-star rounds over the links.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, map_slices, parted
from ledgerline.operators.skew import dealt_join

SEED = 42
SHINGLE = 3
MAX_BITS = 2


class Field(NamedTuple):
    """A run of bits of the fingerprint and the perfect cyclic code on it."""

    shift: int
    width: int
    generator: int
    radius: int


GOLAY_LOW = Field(0, 23, 0b110001110101, 3)
GOLAY_HIGH = Field(23, 23, 0b110001110101, 3)
HAMMING = Field(46, 15, 0b10011, 1)
TWO, THREE = (GOLAY_LOW, GOLAY_HIGH), (GOLAY_LOW, GOLAY_HIGH, HAMMING)
#: Distinct fingerprints from which the third field pays: 61 n (1 + n / 2^24) rows against 153 n (1 + n / 2^35).
MANY = 25_000_000
#: Tasks that share the links of one node in a star round.
SALTS = 64


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles; repeats count, a bit is set if over half the hashes have it.

    Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r, with A-Z lower-cased. Fewer
    than k words make one shingle; no words give zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[i:] for i in range(k)), strict=False) if len(words) > k else [words]
    hashes = np.fromiter((digest(join(run), SEED) for run in runs), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory on very long texts
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, k: int = SHINGLE, *carried: str) -> DataFrame:
    """(doc_id, fp long) and the string columns carried along of every row of docs; null text has fingerprint zero."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, k) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *carried])

    return map_slices(docs.select("doc_id", "text", *carried), run, ", ".join([f"doc_id {kind}, fp long", *(f"{c} string" for c in carried)]))


def _syndrome(words: np.ndarray, field: Field) -> np.ndarray:
    """Remainder of the words as polynomials modulo the generator."""
    left, degree = words.astype(np.int64), field.generator.bit_length() - 1
    for bit in range(field.width - 1, degree - 1, -1):
        left = left ^ np.where((left >> bit) & 1, field.generator << (bit - degree), 0)
    return left


@lru_cache(maxsize=None)
def _patterns(field: Field, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the error patterns that lead to code words at the excess over the radius: offsets and patterns."""
    weights = range(field.radius + 1) if excess == 0 else [field.radius + excess]
    errors = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(field.width), w)], dtype=np.int64)
    of = _syndrome(errors, field)
    counts = np.bincount(of, minlength=1 << (field.generator.bit_length() - 1))
    return np.concatenate([[0], np.cumsum(counts)]), errors[np.argsort(of, kind="stable")]


def _near(bits: np.ndarray, field: Field, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and code words at the given excess from each value of bits."""
    offsets, errors = _patterns(field, excess)
    s = _syndrome(bits, field)
    n = offsets[s + 1] - offsets[s]
    row = np.repeat(np.arange(len(bits)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, bits[row] ^ errors[np.repeat(offsets[s], n) + inside]


def anchors(fps: np.ndarray, spare: int, fields: tuple[Field, ...] = TWO) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors whose excesses over the covering radius add up to spare or less."""
    if not fields:
        return np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
    field, rows, found = fields[0], [], []
    bits = (fps >> field.shift) & ((1 << field.width) - 1)
    for excess in range(spare + 1):
        row, word = _near(bits, field, excess)
        more, rest = anchors(fps[row], spare - excess, fields[1:])
        rows.append(row[more])
        found.append((word[more] << field.shift) | rest)
    return np.concatenate(rows), np.concatenate(found)


def _at_anchors(nodes: DataFrame, spare: int, fields: tuple[Field, ...]) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        row, anchor = anchors(fps, spare, fields)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row])], names=["anchor", "fp"])

    return map_slices(nodes.select("fp"), run, "anchor long, fp long")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, fields: tuple[Field, ...] = TWO) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in max_bits bits or fewer.

    A pair comes once: from a's only home anchor, among the replicas of b. Replicas grow fast with
    max_bits, so it is meant for two or less. Spark sizes both sides by the file of nodes, 61 times too low
    for the replicas, so neither is ever broadcast.
    """
    home = _at_anchors(nodes, 0, fields).withColumnRenamed("fp", "a")
    copies = _at_anchors(nodes, max_bits, fields).withColumnRenamed("fp", "b")
    return home.join(copies.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. A node's links are dealt over SALTS tasks, so a hub, which a root becomes, is no group in one task.

    Minima are taken by node and salt, then by node, and go back the same way to the links.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    near = (both if large else both.where("v < u")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).repartition("u", "salt")
    parts = near.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.select("u", "salt", F.least("u", F.min("m").over(Window.partitionBy("u"))).alias("m"))  # SALTS rows a node at most
    met = near.join(least.hint("merge"), ["u", "salt"])
    moved = met.where("v > u").select("m", "v") if large else met.select("m", "v").union(least.select("m", F.col("u").alias("v")))
    return moved.where("m <> v").select(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).distinct()


def _unsettled(edges: DataFrame) -> int:
    """Nodes that are the larger end of several links, or the larger end of one and the smaller of another."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")).union(edges.select("a", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller")).where("larger > 1 OR larger + smaller > 1").count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges, which come as a < b; root is the smallest node of its component.

    The rounds end when each component is a star around its smallest node, which one aggregate tells.
    """
    edges = cut(edges, "simhash-links")
    while _unsettled(edges):
        edges = cut(_star(_star(edges, True), False), "simhash-star")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a"), F.col("a")).distinct())


def _grouped(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint in prints."""
    nodes = cut(prints.select("fp").distinct(), "simhash-nodes")
    fields = THREE if nodes.count() > MANY else TWO
    roots = cut(components(links(nodes, max_bits, fields)), "simhash-roots")
    return nodes.join(roots.hint("merge"), nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    Args: docs with doc_id and text; other columns are ignored. max_bits: links join fingerprints with
    so many differing bits at most. k: words in a shingle.
    Defined results: null, empty and blank texts have fingerprint zero and are linked like any other;
    repeated rows give repeated result rows; component_id is the smallest non-null doc_id reachable
    (null if there is none); an empty table gives no rows.
    """
    prints = cut(with_fingerprints(docs, k), "simhash-prints")
    of = _grouped(prints, max_bits)
    member = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(of.hint("merge"), "fp")
    ids = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")).hint("merge"), "root").select("fp", "component_id", "n")
    return dealt_join(prints, ids, ["fp"], "n", merge=True).select("doc_id", "fp", "component_id")  # a fingerprint of very many documents, as empty ones have, is dealt over tasks


def version(text: Column) -> Column:
    """Tells the texts under one doc_id apart."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, version of the text) are not in gone. Only texts that may be in gone are shuffled, at every size alike."""
    gone = cut(gone.select(F.col("doc_id").alias("__id"), F.col("v").alias("__v")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), version(F.col("row.text")).alias("v"))
    likely, stay = parted(rows, ["id", "v"], gone, ["__id", "__v"])
    checked = likely.join(gone.hint("merge"), (F.col("id") == F.col("__id")) & (F.col("v") == F.col("__v")), "left_anti")
    return stay.union(checked).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, k: int = SHINGLE) -> DataFrame:
    """Rows of docs without the later texts of each group: the smallest by (doc_id, md5 of the text) stays.

    Defined results: a text goes only with its own group, so others under the same doc_id stay; rows that
    repeat a doc_id and its text are one document and stay or go together; rows with a null doc_id can't
    be told apart and stay; null and empty texts form one group; an empty table gives no rows.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", version(F.col("text")).alias("v"))
    prints = cut(with_fingerprints(rows, k, "v"), "simhash-prints")
    of = _grouped(prints, max_bits)
    best = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "v")).alias("best")).join(of.hint("merge"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = of.join(best.hint("merge"), "root").select("fp", "best")
    return without(docs, prints.join(kept.hint("merge"), "fp").where("doc_id <> best.doc_id OR v <> best.v"))


def query(docs: DataFrame) -> DataFrame:
    """op10: fingerprint as 16 lower-case hex digits and component_id of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
