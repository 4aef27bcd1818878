"""Quality rules as a short-circuit cascade.

Each rule rejects a document from facts that are computed on first use. The cost of a rule (seconds a
document) and its selectivity (share rejected) are measured on a bounded sample; the cascade tries the
rules by rejection per cost, highest first, and stops at the first that rejects. The verdict, "no rule
rejects", does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_slices, sample_texts

#: Rows of the sample that orders the rules.
SAMPLE_ROWS = 512
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


class Facts:
    """What the rules look at, computed on first use. Words are runs of bytes other than BLANKS."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), dtype=np.int64, count=n)
        k = len(number)
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        _, at, times = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        hit = np.zeros(n, dtype=bool)
        for shift in range(3):
            hit[shift : n - 2 + shift] |= twice
        return int(hit.sum())

    @cached_property
    def n_letter_words(self) -> int:
        """Words with a letter (Unicode category L)."""
        return sum(1 for w in self.words if w.isalpha() or any(map(str.isalpha, w.decode("utf-8", "surrogatepass"))))

    @cached_property
    def n_shouted(self) -> int:
        return self.text.count("!")


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Facts], bool]


#: Bounds lie well outside what running prose in the corpus' languages shows.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 12 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: f.n_dup_lines > 2 and 10 * f.n_dup_lines > 3 * len(f.lines)),
    Rule("shouting", lambda f: 10 * f.n_shouted > 3 * f.n_words),
    Rule("letterless_words", lambda f: 10 * f.n_letter_words < 7 * f.n_words),
)
BASE = ("few_words", "repeated_windows")


def measure(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, float]]:
    """(name, seconds a document, share rejected) of each rule, each on facts of its own. One row per slice comes back."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = batch.column(0).to_pylist(), []
        for rule in rules:
            began = time.perf_counter()
            hits = sum(rule.rejects(Facts(t)) for t in texts)
            out.append((rule.name, len(texts), time.perf_counter() - began, hits))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["name", "n", "s", "hits"])

    rows = map_slices(sample.select("text"), run, "name string, n long, s double, hits long").groupBy("name").agg(*[F.sum(c).alias(c) for c in ("n", "s", "hits")]).collect()
    return [(r["name"], r["s"] / r["n"], r["hits"] / r["n"]) for r in rows]


def ordered(figures: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first; unmeasured ones last; ties keep their places."""
    gain = {name: rate / max(cost, 1e-9) for name, cost, rate in figures}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, -1.0)))


def first_rejection(facts: Facts, rules: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in rules if r.rejects(facts)), None)


def cascade(docs: DataFrame, sample_n: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Defined results: null and empty texts have no words, fail the base and are not kept; repeated rows
    give repeated rows; an empty table gives no rows; columns besides doc_id and text are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = tuple(r for r in RULES if r.name in BASE)
    order = ordered(measure(sample_texts(docs, sample_n)))
    rest = tuple(r.name for r in order if r.name not in BASE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_name = {r.name: r for r in RULES}
        later = tuple(by_name[n] for n in rest)
        rows = []
        for text in batch.column(1).to_pylist():
            f = Facts(text)
            failed = first_rejection(f, base) is not None
            rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, not failed and first_rejection(f, later) is None))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*rows, strict=True))], names=["doc_id", *NAMES])

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, sample_n: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of docs that no rule rejects, in full short circuit: nothing is computed past the first rejection.

    Defined results: all columns stay, whatever their names; null and empty texts have too few words and
    go; repeated rows stay or go together; an empty table gives no rows.
    """
    order = tuple(r.name for r in ordered(measure(sample_texts(docs, sample_n))))
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_name = {r.name: r for r in RULES}
        rules = tuple(by_name[n] for n in order)
        return batch.filter(pa.array([first_rejection(Facts(t), rules) is None for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_slices(docs, run, docs.schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (
  SELECT doc_id, t, ws, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_shouted,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w),
g AS (SELECT doc_id, unnest(generate_series(1, n_words - 2)) AS i, ws FROM b WHERE n_words > 2),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS times FROM g),
r AS (SELECT doc_id, count(DISTINCT i + s) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) v(s) WHERE times > 1 GROUP BY doc_id),
f AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
    n_shouted, n_letter_words, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM b LEFT JOIN r ON b.doc_id = r.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars BETWEEN 2 * n_words AND 12 * n_words
    AND 10 * n_symbols <= n_words AND (n_dup_lines <= 2 OR 10 * n_dup_lines <= 3 * n_lines) AND 10 * n_shouted <= 3 * n_words
    AND 10 * n_letter_words >= 7 * n_words AS kept
FROM f
"""
