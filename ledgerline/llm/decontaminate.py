"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and runs of white space become one blank. An item of m characters may be
found with k = floor(ERROR_RATE * m) edits. Cut into k + 1 pieces, it keeps at least one piece exact
under k edits, so an automaton over all pieces finds every place where it can stand. Each place is then
verified with Myers' bit-parallel edit distance on the stretch that the piece's place allows.

Every item with a character is searched for. One below SHORT characters would be met by chance in
running text, so it must stand exactly, and between word boundaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.llm.common import cut, map_slices

#: Edits allowed, as a share of an item's characters, and the characters below which an item has none.
ERROR_RATE, SHORT = 0.08, 24
#: Characters of items that one automaton holds, about; more items are searched for in further passes.
BLOCK_CHARS = 2_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """(offset, length) of k + 1 pieces of near-equal length that cover m characters."""
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern_bits: dict[str, int], m: int, text: str) -> int:
    """The least edit distance between the pattern and any stretch of text; columns of the matrix are bits of one integer."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = pattern_bits.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return best


def bits_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Item(NamedTuple):
    item_id: Any
    m: int
    k: int
    bits: dict[str, int]


def stands_alone(text: str, lo: int, hi: int) -> bool:
    """No word of text goes on across lo or hi."""
    inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not inside(lo) and not inside(hi)


class Finder:
    """An automaton over the pieces of a block of items."""

    def __init__(self, block: tuple[tuple[Any, str], ...], rate: float) -> None:
        self.items: list[Item] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in block:
            m, k = len(text), int(rate * len(text)) if len(text) >= SHORT else 0
            for at, n in pieces(m, k):
                places.setdefault(text[at : at + n], []).append((len(self.items), at + n))
            self.items.append(Item(item_id, m, k, bits_of(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def spans(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item hit, the stretches of text in which it can stand, merged where they overlap; short items as they stand."""
        found: dict[int, set[int]] = {}
        out: dict[int, list[tuple[int, int]]] = {}
        for end, where in self.automaton.iter(text):
            for i, offset in where:
                start = end + 1 - offset
                if self.items[i].m >= SHORT:
                    found.setdefault(i, set()).add(start)
                elif i not in out and stands_alone(text, start, start + self.items[i].m):
                    out[i] = [(start, start + self.items[i].m)]
        return out | {i: self._merged(self.items[i], sorted(starts)) for i, starts in found.items()}

    @staticmethod
    def _merged(item: Item, starts: list[int]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for start in starts:
            lo, hi = max(0, start - item.k), max(0, start + item.m + item.k)
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, least distance, distance allowed) of each item that the text holds within its budget."""
        low, out = normalised(text), []
        if not low or not self.items:
            return out
        for i, spans in self.spans(low).items():
            item = self.items[i]
            best = min(myers(item.bits, item.m, low[lo:hi]) for lo, hi in spans)
            if best <= item.k:
                out.append((item.item_id, best, item.k))
        return out


@lru_cache(maxsize=1)
def _finder(block: tuple[tuple[Any, str], ...], rate: float) -> Finder:
    """A worker that is used again keeps its automaton."""
    return Finder(block, rate)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[Any, str], ...]]:
    """The distinct normalised items in blocks of about block_chars characters, one at a time.

    The benchmark is the stated query set. Items are normalised and dealt to blocks by hash on Spark and
    written; the driver holds one block.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([normalised(t) for t in batch.column(1).to_pylist()], pa.string())], names=["item_id", "text"])

    items = map_slices(benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text"), run, f"item_id {kind}, text string")
    items = cut(items.where("text <> ''").distinct(), "benchmark-items")
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    if not n:
        return
    dealt = cut(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).sort("block"), "benchmark-blocks")  # sorted: a block's rows lie together
    for i in range(n):
        yield tuple(sorted((r["item_id"], r["text"]) for r in dealt.where(F.col("block") == i).select("item_id", "text").collect()))


def hits(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, allowed) for each document and item found in it.

    Each block of items is one pass over docs; a benchmark of several blocks is met block by block, the
    result of each written, so that one block is broadcast at a time.
    Defined results: null and empty texts hold nothing; null and blank items are not searched for; items
    below SHORT characters must stand exactly, as whole words; repeated rows give repeated rows; repeated
    items with one id give their least distance; no items or no documents give no rows. Whole texts are searched.
    """
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, distance int, allowed int"

    def run(finder: Finder, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            best: dict[Any, tuple[int, int]] = {}
            for item_id, distance, allowed in finder.matches(text):
                best[item_id] = min(best.get(item_id, (distance, allowed)), (distance, allowed))
            rows += [(doc_id, item_id, *b) for item_id, b in best.items()]
        ids, items, far, most = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(items, item_type), pa.array(far, pa.int32()), pa.array(most, pa.int32())], names=["doc_id", "item_id", "distance", "allowed"])

    return _by_block(docs.select("doc_id", "text"), benchmark, rate, block_chars, lambda rows, once: map_slices(rows, run, schema, once), schema)


def _by_block(rows: DataFrame, benchmark: DataFrame, rate: float, block_chars: int, search: Callable[[DataFrame, Callable], DataFrame], schema: str) -> DataFrame:
    """The union of search over the blocks; with several, the result of each is written before the next is read."""
    spark, out, last = rows.sparkSession, None, None
    for block in blocks(benchmark, block_chars):
        if last is not None:
            found = cut(last[0], "benchmark-hits")
            last[1].destroy()
            out = found if out is None else out.unionByName(found)
        shared = spark.sparkContext.broadcast(block)
        last = search(rows, lambda shared=shared: _finder(shared.value, rate)), shared
    if last is None:
        return spark.createDataFrame([], schema)
    return last[0] if out is None else out.unionByName(last[0])


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of docs in which no item is found, all columns. Without a shuffle; after each block but the last, what is left is written.

    Defined results: rows with null or empty texts stay; repeated rows stay or go together; without items
    all stay; columns that clash with the operator's own are no trouble. Items as in hits.
    """
    at = docs.columns.index("text")
    schema, shared = docs.schema, None

    def run(finder: Finder, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not finder.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    for block in blocks(benchmark, block_chars):
        if shared is not None:
            docs = cut(docs, "benchmark-clean")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = map_slices(docs, run, schema, lambda shared=shared: _finder(shared.value, rate))
    return docs
