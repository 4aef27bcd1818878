"""Best-fit packing of token pieces into sequences: hierarchical residual packing.

A document is its token ids and an end id; only one that is longer than a sequence is cut. Pieces are dealt
to leaves of about LEAF pieces by a hash, so each leaf sees the same mix of lengths whatever the order of the
table, and are packed there best-fit, longest first. Bins with at most capacity / SPARE free places are
emitted. The others go up a tree as items, FAN nodes at a time, and are packed best-fit again.

What goes up is bounded. After best-fit any two bins of a node hold more than one sequence together, so at
most one bin of a node is half full or less, and only such a bin can move into another. A parent thus moves
FAN bins at most, and its ancestors FAN each; a node sends up its KEEP = 8 FAN emptiest bins, enough hosts for
all moves of eight levels above it, and emits the rest. No task holds more than LEAF pieces or FAN x KEEP bins.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import cut, map_batches, ship

#: Vocabulary with word ends; on a cluster, any path that Spark reads.
TOKENIZER_PATH = "file:///opt/tokenizers/word_bpe_49k.json"
#: Id that ends a document, and tokens of a sequence.
END, CAPACITY = 1, 4096
#: Pieces of a leaf, nodes that a parent merges, bins that a node sends up, and the share of a bin that counts as full.
LEAF, FAN, KEEP, SPARE = 8192, 64, 512, 128
#: Words that a worker remembers, and bytes up to which it does; bytes that are split into words at once.
WORDS, WORD_BYTES, STRETCH = 400_000, 48, 1 << 20
#: Tokens after which a batch is handed on.
BATCH_TOKENS = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
#: The last letter up to which a lower-case letter is composed and has no other form.
LATIN = "\u017f"
#: The vocabulary's letters for bytes that don't print: the n-th is character 256 + n.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}



class _Words(dict):
    """Ids, as bytes, of runs of bytes without white space, which no token spans."""

    def __init__(self, tokenizer) -> None:  # noqa: ANN001
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # plain letters: nothing to normalise or split
            ids = self._letters(word.decode())
        else:
            text = word.decode("utf-8", "surrogatepass")
            stem, low = text.rstrip(",.;:!?"), text.lower()
            if stem != text and stem[-1:].isalpha():  # a letter before a mark ends a token
                ids = self[stem.encode()] + self[text[len(stem) :].encode()]
            elif low.isalpha() and max(low) <= LATIN:  # one run of composed letters
                form = low.encode()
                ids = self[form] if form != word else self._letters(form.decode("latin-1").translate(BYTE_LETTERS))
            else:
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= WORD_BYTES:
            self[word] = ids
        return ids

    def _letters(self, form: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(form)]).tobytes()


@lru_cache(maxsize=1)
def _words(model: bytes) -> _Words:
    from tokenizers import Tokenizer

    return _Words(Tokenizer.from_str(model.decode()))


def token_ids(model: bytes, text: str | None) -> np.ndarray:
    """The tokenizer's ids of a text, without an end id. Null and empty texts have none.

    The vocabulary's pattern drops white space and no token spans it, so a text is tokenized word by word,
    with the words seen before remembered, and a long text a stretch at a time.
    """
    words, raw, at, found = _words(model), (text or "").encode("utf-8", "surrogatepass"), 0, []
    if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:  # no special token, no mark that composes with a letter
        raw = raw.lower()
    if len(words) > WORDS:
        words.clear()
    while at < len(raw):
        space = _SPACE.search(raw, at + STRETCH)
        end = space.start() if space else len(raw)
        found.append(b"".join(map(words.__getitem__, raw[at:end].split())))
        at = end
    return np.frombuffer(b"".join(found), dtype="<u4")


def pieces(docs: DataFrame, path: str = TOKENIZER_PATH, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids binary) of every row of docs; ids are unsigned 32-bit, little-endian.

    Each document is its ids and END; a longer one than capacity is cut every capacity ids, the last piece may be
    shorter. Null and empty texts are one piece of END alone; repeated rows give repeated pieces.
    """
    model = bytes(docs.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, parts, n = batch.column(1), [], [], 0

            def flush() -> pa.RecordBatch:
                names = ["doc_id", "piece", "start", "length", "ids"]
                at = pa.array([r for r, _, _ in parts], pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([s // capacity for _, s, _ in parts], pa.int32()), pa.array([s for _, s, _ in parts], pa.int64()), pa.array([len(x) for _, _, x in parts], pa.int64()), pa.array([x.tobytes() for _, _, x in parts], pa.binary())], names=names)  # noqa: B023

            for row in range(batch.num_rows):
                ids = np.append(token_ids(shared.value, texts[row].as_py()), np.array([END], dtype="<u4"))
                for start in range(0, len(ids), capacity):
                    parts.append((row, start, ids[start : start + capacity]))
                    n += len(parts[-1][2])
                    if n >= BATCH_TOKENS:
                        yield flush()
                        parts, n = [], 0
            if parts:
                yield flush()

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill: longest first, each into the bin that it leaves least room in."""
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with r places free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := some >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            free[room - size].append(b)
            some |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def _packed(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """items, of which each node is packed, with bin, at, fill of the bin, and open: the bin goes up the tree."""
    ship(items.sparkSession)
    schema = T.StructType([*items.schema.fields, *T._parse_datatype_string("__bin long, __at long, __fill long, __open boolean").fields])

    def run(node: pa.Table) -> pa.Table:
        bins, at, fills = best_fit(node.column("__size").to_numpy(), capacity)
        emptiest = np.argsort(fills, kind="stable")[:KEEP]
        opened = np.zeros(len(fills), dtype=bool)
        opened[emptiest] = fills[emptiest] < capacity - capacity // SPARE
        first = (level << 56) + (node.column("__node")[0].as_py() << 20)
        for name, values in (("__bin", first + bins), ("__at", at), ("__fill", fills[bins]), ("__open", opened[bins])):
            node = node.append_column(name, pa.array(values))
        return node

    return items.groupBy("__node").applyInArrow(run, schema)


def pack(items: DataFrame, size: str = "length", capacity: int = CAPACITY, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """items with sequence_id and offset, gapless from 0 in each sequence; sizes are 1 to capacity. All columns are carried along.

    items are numbered and written once, so that a task that runs again finds the same ones. Leaves have about
    leaf items each; the tree's tables hold the open bins only.
    """
    spark = items.sparkSession
    rows = cut(items.withColumns({"__uid": F.monotonically_increasing_id(), "__size": F.col(f"`{size}`").cast("long")}), "packing-items")
    nodes, level = max(1, -(-rows.count() // leaf)), 0
    packed = cut(_packed(rows.withColumn("__node", F.pmod(F.xxhash64("__uid"), F.lit(nodes))), level, capacity), "packing-leaves")
    tree, last = [], packed
    while nodes > 1:
        nodes, level = -(-nodes // fan), level + 1
        opened = last.where("__open AND __at = 0").select(F.col("__bin").alias("__item"), F.col("__fill").alias("__size"), F.floor(F.col("__node") / fan).alias("__node"))
        last = cut(_packed(opened, level, capacity), "packing-merged")
        tree.append(last)
    into = spark.createDataFrame([], "__bin long, __to long, __by long")
    for moved in reversed(tree):  # from the root down: where each open bin has gone in the end
        into = moved.join(into, "__bin", "left").select(F.col("__item").alias("__bin"), F.coalesce("__to", "__bin").alias("__to"), (F.col("__at") + F.coalesce("__by", F.lit(0))).alias("__by"))
    own = [F.col(f"`{c}`") for c in items.columns]
    settled = packed.where("NOT __open").select(*own, F.col("__bin").alias("sequence_id"), F.col("__at").alias("offset"))
    moved = packed.where("__open").join(into, "__bin", "left").select(*own, F.coalesce("__to", "__bin").alias("sequence_id"), (F.col("__at") + F.coalesce("__by", F.lit(0))).alias("offset"))
    return settled.union(moved)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<long>, doc_ids): the token ids of each sequence, of packed pieces with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))  # capacity pieces at most
    ids = F.expr("transform(sequence(1, length(hex_ids) div 8), i -> conv(concat(substr(hex_ids, 8 * i - 1, 2), substr(hex_ids, 8 * i - 3, 2), substr(hex_ids, 8 * i - 5, 2), substr(hex_ids, 8 * i - 7, 2)), 16, 10)::long)")
    joined = parts.select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("hex_ids"))
    return joined.select("sequence_id", ids.alias("ids"), "doc_ids")


def query(docs: DataFrame, path: str = TOKENIZER_PATH) -> DataFrame:
    """op11: every piece of every document, its place, and the CRC-32 of its ids.

    Defined results: null and empty texts are a piece of the end id; repeated rows are documents of their own; null
    doc_ids are packed like others; an empty table gives no rows; other columns are ignored.
    """
    found = pieces(docs, path).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
