"""SentencePiece encoding and decoding: Viterbi over an Aho-Corasick automaton.

The model file's pieces and scores make a unigram model (the file is never changed or trained). One
pass over a text reads, at each position, the pieces that end there (the automaton's output links) and
relaxes the best score at their ends; ties go to the longer piece. A character without a piece of
its own costs the least score less 10 and becomes the bytes of its UTF-8 form, if the model has these.

No piece has a blank mark after another character, so texts fall into stretches that can be encoded
apart; the task keeps the ids of stretches it has met, within a bound.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import map_slices

#: Where the model file is; on a cluster, any path that Spark reads.
MODEL_PATH = "file:///opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Encoded stretches that a task keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 300_000, 48
NORMAL, UNK, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Vocabulary(NamedTuple):
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool


def vocabulary(spark: SparkSession, path: str = MODEL_PATH) -> Vocabulary:
    """Read a model file; only the identity normaliser with escaped blanks is handled, others raise."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with the identity normaliser and escaped blanks are handled")
    return Vocabulary([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], norm.add_dummy_prefix)


class Codec:
    def __init__(self, voc: Vocabulary) -> None:
        self.prefix = MARK if voc.dummy_prefix else ""
        self.automaton = ahocorasick.Automaton()
        usable = [(i, p, s) for i, (p, s, k) in enumerate(zip(*voc[:3], strict=True)) if k in (NORMAL, USER) and p]
        for i, piece, score in usable:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.unk_score = min(s for _, _, s in usable) - UNKNOWN_PENALTY
        self.unk = voc.kinds.index(UNK)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(voc.pieces, voc.kinds, strict=True)) if k == BYTE}
        self.single = {p for _, p, _ in usable if len(p) == 1}
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNK else p.replace(MARK, " ").encode() for p, k in zip(voc.pieces, voc.kinds, strict=True)]
        self.is_byte = np.array([k == BYTE for k in voc.kinds])
        inside = {c for _, p, _ in usable for c in p}
        whole = any(MARK in p[1:] and p.strip(MARK) for _, p, _ in usable)
        lone = "" if "\n" in inside else "\n"  # in no piece: always encoded by itself
        self.stretch = re.compile("(?s).+") if whole else re.compile(f"{lone}|{MARK}*[^{MARK}{lone}]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.kept: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        n = len(text)
        best, back, piece = [0.0] + [float("-inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        unknown = not self.single.issuperset(text)
        done = 0  # positions up to here are settled
        for end, (length, gain, i) in self.automaton.iter(text):
            if unknown and done < end:
                self._settle(text, best, back, piece, done, end)
                done = end
            end += 1
            score = best[end - length] + gain
            if score > best[end]:
                best[end], back[end], piece[end] = score, length, i
        if unknown:
            self._settle(text, best, back, piece, done, n)
        out: list[int] = []
        while n:
            out += [piece[n]] if piece[n] >= 0 else self._unknown(text[n - 1])
            n -= back[n]
        return out[::-1]

    def _settle(self, text: str, best: list[float], back: list[int], piece: list[int], start: int, stop: int) -> None:
        """Between start and stop, a character that is no piece by itself ends as unknown if no piece ends there better."""
        for at in range(start, stop):
            if text[at] not in self.single and best[at] + self.unk_score > best[at + 1]:
                best[at + 1], back[at + 1], piece[at + 1] = best[at] + self.unk_score, 1, -1

    def _unknown(self, char: str) -> list[int]:
        """Ids of an unknown character, last first."""
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")][::-1] if self.byte else [self.unk]

    def _of(self, stretch: str) -> bytes:
        found = array("i", self.viterbi(stretch)).tobytes()
        if len(stretch) <= KEPT_CHARS:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[stretch] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = (self.prefix + text).replace(" ", MARK)
        get, of = self.kept.get, self._of
        return np.frombuffer(b"".join([get(s) or of(s) for s in self.stretch.findall(marked)]), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _codec(voc_key: tuple) -> Codec:
    return Codec(Vocabulary(*(list(x) if isinstance(x, tuple) else x for x in voc_key)))


def _once(shared):  # noqa: ANN001, ANN202  a worker that is used again keeps its codec and what it has met
    return lambda: _codec(tuple(tuple(x) if isinstance(x, list) else x for x in shared.value))


def encode(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, tokens array<int>, n_tokens int, n_byte_tokens int, round_trip boolean) of every row of docs.

    round_trip: decoding the ids gives the text back. It is false only where the text itself holds the
    blank mark U+2581, which decodes to a blank, or characters unknown to a model without byte pieces.
    Defined results: null and empty texts have no tokens (and a true round trip); repeated rows give
    repeated rows; an empty table gives no rows; columns besides doc_id and text are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(docs.sparkSession, path))

    def run(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, same = [], []
        for text in batch.column(1).to_pylist():
            ids.append(codec.encode(text))
            same.append(codec.decode(ids[-1]) == (text or ""))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        fallen = np.concatenate([[0], np.cumsum(codec.is_byte[flat])])[ends]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends)), pa.array(np.diff(fallen).astype(np.int32)), pa.array(same, pa.bool_())],
            names=["doc_id", "tokens", "n_tokens", "n_byte_tokens", "round_trip"],
        )

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, tokens array<int>, n_tokens int, n_byte_tokens int, round_trip boolean", _once(shared))


def decode(tokens: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens array<int>); null tokens give null."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary(tokens.sparkSession, path))

    def run(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if x is None else codec.decode(np.array(x, dtype=np.int32)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_slices(tokens.select("doc_id", "tokens"), run, f"doc_id {kind}, text string", _once(shared))


def query(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """op2: doc_id, n_tokens, n_byte_tokens, tokens_hash (of the ids), round_trip of every document."""
    return encode(docs, path).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_byte_tokens").cast("long").alias("n_byte_tokens"), F.xxhash64("tokens").alias("tokens_hash"), "round_trip")
