"""Token counts by a separator scan over flat token files.

A flat token file is a run of 16-bit ids without an index; each document's ids end with the
end-of-document id. It is held as blocks of a fixed number of ids. A block is searched for the
separator in one vector operation, which gives the lengths between separators and at both rims. An
exclusive prefix sum of separators over the blocks of a file (in two levels, so that no task orders all
blocks of a long file) numbers the documents; lengths that a block boundary cuts are added up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, map_batches, map_slices

#: Rank file of a byte-level vocabulary; on a cluster, any path that Spark reads. Its first free id ends a document.
RANKS_PATH = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256
#: Ids in a block, and blocks that one task puts in order.
BLOCK_IDS, LEVEL = 1 << 19, 1024

# Fixed value: the pre-tokenising pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space that is encoded by itself.
LONG_BLANK = regex.compile(r"\p{White_Space}{5000,}")


@lru_cache(maxsize=1)
def _encoding(ranks: bytes):  # noqa: ANN202
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_ids(ranks: bytes, text: str | None) -> np.ndarray:
    """Ids of a text; strings of special tokens are ordinary text. Null and empty texts have none.

    The pattern takes a run of white space but for its last character as one piece. Long runs are encoded as
    such pieces, since the tokenizer's own search for them fails on a million characters.
    """
    encoding, found, at = _encoding(ranks), [], 0
    for run in LONG_BLANK.finditer(text or ""):
        end = run.end() if run.end() == len(text) else run.end() - 1
        found += [encoding.encode_ordinary(text[at : run.start()]), encoding._encode_single_piece(text[run.start() : end])]
        at = end
    found.append(encoding.encode_ordinary(text[at:]) if text else [])
    return np.concatenate([np.array(f, dtype="<u2") for f in found])


def write_flat(docs: DataFrame, path: str = RANKS_PATH, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Encode docs into flat token files, one a task: (file, block, data) and the order (file, ordinal, doc_id)."""
    ranks = bytes(docs.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, ordinal, held, n = TaskContext.get().partitionId(), 0, 0, [], 0
        id_type = None

        def row(block: int | None, data: bytes | None, first: int | None, ids: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(id_type))], names=["file", "block", "data", "first", "ids"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text in part.column(1).to_pylist():
                    held += [token_ids(shared.value, text), np.array([END], dtype="<u2")]
                    n += len(held[-2]) + 1
                    if n >= block_ids:
                        flat = np.concatenate(held)
                        for k in range(0, n - n % block_ids, block_ids):
                            yield row(block, flat[k : k + block_ids].tobytes(), None, None)
                            block += 1
                        held, n = [flat[n - n % block_ids :]], n % block_ids
                yield row(None, None, ordinal, part.column(0).to_pylist())
                ordinal += part.num_rows
        if n:
            yield row(block, np.concatenate(held).tobytes(), None, None)

    both = cut(map_batches(docs.select("doc_id", "text"), run, f"file int, block long, data binary, first long, ids array<{kind.simpleString()}>"), "token-files")
    order = both.where("block IS NULL").select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return both.where("block IS NOT NULL").select("file", "block", "data"), order


def read_flat(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, data) from stored files of 16-bit little-endian ids, of any length.

    Only names and lengths are listed by Spark; each block is a range of bytes that a task reads by itself,
    so a long file is dealt over many tasks. path is on a store that pyarrow.fs knows (file, hdfs, s3, gs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                with store.open_input_file(at) as file:
                    data = file.read_at(min(2 * block_ids, length - 2 * block_ids * block), 2 * block_ids * block) if length else b""
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / (2 * block_ids)) - 1, F.lit(0)))).alias("block"))
    return map_batches(ranges.repartition("path", "block"), run, "file string, block long, data binary")


def separator_scan(blocks: DataFrame, end: int = END, level: int = LEVEL) -> DataFrame:
    """(file, ordinal, n_tokens long) of every document in (file, block, data); separators don't count.

    A file's last document may lack its separator. Blocks number from 0 without gaps and may be of any
    size; empty ones are fine. An empty file has no document.
    """
    kind = blocks.schema["file"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = []
        for data in batch.column(2):
            ids = np.frombuffer(data.as_buffer(), dtype="<u2")
            at = np.flatnonzero(ids == end)
            lengths.append(np.diff(at, prepend=-1, append=len(ids)) - 1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) - 1 for x in lengths], pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["file", "block", "ends", "lengths"])

    found = cut(map_slices(blocks.select("file", "block", "data"), run, f"file {kind}, block long, ends long, lengths array<long>"), "separators")
    found = found.withColumn("upper", F.floor(F.col("block") / level))
    before = Window.partitionBy("file", "upper").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("file").orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("file", "upper").agg(F.sum("ends").alias("ends")).select("file", "upper", F.coalesce(F.sum("ends").over(above), F.lit(0)).alias("base"))
    inner = found.select("file", "upper", "lengths", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("within"), "ends")
    parts = inner.join(base, ["file", "upper"]).select("file", (F.col("base") + F.col("within")).alias("base"), "ends", F.posexplode("lengths").alias("k", "n"))
    parts = parts.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n", ((F.col("k") > 0) & (F.col("k") < F.col("ends"))).alias("whole"), (F.col("k") < F.col("ends")).alias("ended"))
    rims = parts.where("NOT whole").groupBy("file", "ordinal").agg(F.sum("n").alias("n"), F.max("ended").alias("ended")).where("ended OR n > 0")
    return parts.where("whole").select("file", "ordinal", F.col("n").alias("n_tokens")).unionByName(rims.select("file", "ordinal", F.col("n").alias("n_tokens")))


def count_tokens(docs: DataFrame, path: str = RANKS_PATH, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs, from its flat token files.

    The flat files are written as rows of a table, a block of ids each, so that they lie in the shared
    folder whatever its store; read_flat makes the same rows of files that are stored as such.
    Defined results: null and empty texts have 0 tokens; repeated rows give repeated rows; an empty
    table gives no rows; columns besides doc_id and text are ignored.
    """
    blocks, order = write_flat(docs, path, block_ids)
    return order.join(separator_scan(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
