"""Line dedup by content-defined line chunks, in DataFrame functions only.

Lines with words are hashed; a rolling hash over each line and the one before it chooses boundaries: a
chunk begins where the rolling hash falls, and between two lines of over LONG_WORDS words in sum. Whether
a place is a boundary depends on three lines and not on where a chunk began, so an insertion moves no
boundary beyond its own neighbours.

Copies of a passage meet at the boundaries they share: the two lines around a boundary, or a line of
over LONG_WORDS words, are its key. From a key that occurs again, the chunks at its first occurrence and here are compared line
by line, backwards over two chunks and forwards over one, and the run of equal lines goes, unless it has
fewer than two lines and no long one. Each line that goes has an equal one at an earlier place by
(doc_id, text version, line), and the earliest stays.

Keys are grouped as 64-bit hashes first, which combines on the map side, and only repeated ones go on.
Runs are compared as hashes of lines; then the bytes of all lines that go, and of those that they repeat,
are compared, grouped by hash. If two texts share a hash, all is done again with another seed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut

#: A line of more words is a key by itself, and a chunk begins between two lines of more words in sum.
LONG_WORDS = 50
#: Weight of a line against the one before it in the rolling hash.
FACTOR = 31
#: Occurrences from which a key is dealt over SALTS tasks.
HOT, SALTS = 256, 64
#: Seeds that are tried; a second is needed only if two lines of the table share a 64-bit hash.
SEEDS = 8
WORD = r"[^\x20\x09-\x0D]+"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where use refers to it for every element of an array."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _identity(line: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), line)


def _lines(text: Column, seed: int) -> Column:
    """The lines with words: at (number of the line), h (identity), r (rolling hash), n (words)."""
    each = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("x")))
    worded = F.filter(each, lambda x: x["x"].rlike(WORD))
    hashed = F.transform(worded, lambda x: F.struct(
        x["at"].alias("at"), _identity(x["x"], seed).alias("h"), F.conv(F.substring(F.md5(x["x"].cast("binary")), 1, 8), 16, 10).cast("long").alias("m"),
        F.regexp_count(x["x"], F.lit(WORD)).alias("n")))
    rolling = lambda all_, x, i: x["m"] * FACTOR + F.coalesce(F.get(all_, i - 1)["m"], F.lit(0))
    return _bind(hashed, lambda all_: F.transform(all_, lambda x, i: F.struct(x["at"].alias("at"), x["h"].alias("h"), rolling(all_, x, i).alias("r"), x["n"].alias("n"))))


def _starts(lines: Column) -> Column:
    """Numbers, among the lines with words, at which a chunk begins, but for the first chunk."""
    begins = lambda i: (F.get(lines, i)["r"] < F.get(lines, i - 1)["r"]) | (F.get(lines, i)["n"] + F.get(lines, i - 1)["n"] > LONG_WORDS)
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1))), lambda i: (i < F.size(lines)) & F.coalesce(begins(i), F.lit(False)))


def _keys(lines: Column, starts: Column) -> Column:
    """(i, key, before, after, at, last): a key at line i, hashes of up to two chunks before it and of the chunk from it on, and the first and last line that these cover.

    A boundary's key is of the two lines around it; a long line has a key of itself too, from which it is compared alone.
    """
    slice_ = lambda a, b: F.transform(F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))), lambda x: x["h"])
    begin = lambda k: F.coalesce(F.get(starts, k), F.lit(0))
    pairs = F.transform(starts, lambda i, k: F.struct(
        i.alias("i"), F.xxhash64(F.get(lines, i - 1)["h"], F.get(lines, i)["h"]).alias("key"), slice_(begin(k - 2), i).alias("before"),
        slice_(i, F.coalesce(F.get(starts, k + 1), F.size(lines))).alias("after")))
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["h"].alias("h"), (x["n"] > LONG_WORDS).alias("long")))
    alone = F.transform(F.filter(numbered, lambda x: x["long"]), lambda x: F.struct(
        x["i"].alias("i"), x["h"].alias("key"), F.array().cast("array<bigint>").alias("before"), F.array(x["h"]).alias("after")))
    return F.concat(pairs, alone)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, v, text): rows that can take part; v tells texts under one doc_id apart."""
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("v"), "text")


def _boundaries(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, v, i, key, before, after) of every key in docs."""
    found = _bind(_lines(F.col("text"), seed), lambda lines: _bind(_starts(lines), lambda starts: _keys(lines, starts)))
    return _texts(docs).select("doc_id", "v", F.inline(found))


def _agreeing(a: Column, b: Column) -> Column:
    """How many elements a and b share from the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_contains(same, False), F.array_position(same, False).cast("int") - 1).otherwise(F.size(same))


def repeats(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, v, gone, needed): the numbers, among lines with words, of those that a text loses and of those that others lose for it."""
    keys = _boundaries(docs, seed).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # counts of longs: hashed, not sorted
    again = cut(keys, "line-keys")
    place = F.struct("doc_id", "v", "i").alias("place")
    marked = cut(_boundaries(docs, seed).join(again.hint("merge"), "key").select("key", place, "before", "after", "n"), "line-marks")
    first = marked.groupBy("key").agg(F.min(F.struct("place", "before", "after")).alias("x"), F.max("n").alias("n"))
    # a key that very many texts share is dealt over SALTS tasks; its first occurrence goes to each
    last = F.when(F.col("n") > HOT, SALTS - 1).otherwise(0)
    first = first.select("key", F.col("x.place").alias("first"), F.col("x.before").alias("before0"), F.col("x.after").alias("after0"), F.explode(F.sequence(F.lit(0), last)).alias("salt"))
    met = marked.withColumn("salt", F.when(F.col("n") > HOT, F.pmod(F.xxhash64("place"), F.lit(SALTS))).otherwise(0).cast("int"))
    met = met.join(first.hint("merge"), ["key", "salt"]).where("place <> first")
    met = met.select("place", "first", "before", "after", _agreeing(F.reverse("before"), F.reverse("before0")).alias("back"), _agreeing(F.col("after"), F.col("after0")).alias("on"))
    ahead = lambda at: F.when(F.col("on") > 0, F.sequence(at - F.col("back"), at + F.col("on") - 1))
    both = met.where("back + on >= 2 OR size(before) = 0").select(
        F.explode(F.array(F.struct("place.doc_id", "place.v", ahead(F.col("place.i")).alias("gone"), F.lit(None).cast("array<int>").alias("needed")),
                          F.struct("first.doc_id", "first.v", F.lit(None).cast("array<int>").alias("gone"), ahead(F.col("first.i")).alias("needed")))).alias("x")).select("x.*")
    lines = both.select("doc_id", "v", F.explode(F.coalesce("gone", "needed")).alias("line"), F.col("gone").isNotNull().alias("goes"))
    return lines.groupBy("doc_id", "v").agg(F.collect_set(F.when(F.col("goes"), F.col("line"))).alias("gone"), F.collect_set(F.when(~F.col("goes"), F.col("line"))).alias("needed"))


def _in_lines(text: Column, worded: Column) -> Column:
    """Numbers of lines, in the text, of stretches of lines with words, the wordless ones between two of them included."""
    at = F.transform(_numbers(text), lambda x: x)
    return _bind(at, lambda at: _bind(F.array_sort(worded), lambda w: F.flatten(F.transform(w, lambda k, n: F.when(
        F.get(w, n + 1) == k + 1, F.sequence(F.get(at, k), F.get(at, k + 1) - 1)).otherwise(F.array(F.get(at, k)))))))


def _numbers(text: Column) -> Column:
    """Line numbers of the lines with words."""
    each = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), x.rlike(WORD).alias("own")))
    return F.transform(F.filter(each, lambda x: x["own"]), lambda x: x["at"])


def _clash(held: DataFrame, seed: int) -> bool:
    """Do two different lines, among those that go and those that they repeat, share a hash?"""
    own = F.split(F.col("row.text"), "\n", -1)
    lines = held.where("gone IS NOT NULL").select(F.explode(_bind(own, lambda own: _bind(_numbers(F.col("row.text")), lambda at: F.transform(
        F.array_union("gone", "needed"), lambda k: F.get(own, F.get(at, k)))))).alias("line"))
    bytes_ = lines.groupBy(_identity(F.col("line"), seed).alias("h")).agg(F.min("line").alias("a"), F.max("line").alias("b"))
    return bool(bytes_.where("a <> b").limit(1).count())


def held(docs: DataFrame) -> DataFrame:
    """(row, gone) of every row of docs, written: the row as a struct, so that no column can clash, and the lines that it loses, null where none."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for seed in range(SEEDS):
        gone = cut(repeats(docs, seed), "line-repeats")
        known = (F.col("row.doc_id") == F.col("doc_id")) & (F.xxhash64(F.col("row.text")) == F.col("v"))
        # what a text loses grows with the texts, so at no size is it broadcast
        found = cut(rows.join(gone.hint("merge"), known, "left").select("row", "gone", "needed"), "line-chunks")
        if not _clash(found, seed):
            return found
    raise ValueError(f"two lines share their hash under each of {SEEDS} seeds")


def _left(row_text: Column, gone: Column) -> Column:
    """The lines of the text that stay."""
    return F.when(F.coalesce(F.size(gone), F.lit(0)) <= 0, F.split(row_text, "\n", -1)).otherwise(
        _bind(F.split(row_text, "\n", -1), lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), _in_lines(row_text, gone)), lambda i: F.get(own, i))))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs with repeated chunks removed; n_chars, where present, follows the text.

    Defined results: rows with a null doc_id or text are returned as they are and take no part; an empty
    text is one empty line; rows that repeat a doc_id and text lose the same lines, so neither loses what
    the other keeps; a document may end up with an empty text but no row is dropped; doc_id may be of any
    type that has an order; an empty table gives no rows.
    """
    found = held(docs)
    text = F.when(F.size("gone") > 0, F.array_join(_left(F.col("row.text"), F.col("gone")), "\n")).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("row.text").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """op8: doc_id, n_lines, n_chunks, n_removed_lines, kept_md5 (of the text that is left) of every document."""
    text, size = F.col("row.text"), lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    chunks = _bind(_lines(text, 0), lambda lines: F.when(F.size(lines) > 0, F.size(_starts(lines)) + 1).otherwise(0))
    rows = held(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), text.alias("text"), _left(text, F.col("gone")).alias("left"), chunks.alias("n"))
    return rows.select(
        "doc_id", size(F.split("text", "\n", -1)).alias("n_lines"), F.coalesce(F.greatest("n", F.lit(0)), F.lit(0)).cast("long").alias("n_chunks"),
        (size(F.split("text", "\n", -1)) - size(F.col("left"))).alias("n_removed_lines"),
        F.when(F.col("text").isNotNull(), F.md5(F.array_join("left", "\n").cast("binary"))).alias("kept_md5"))


ORACLE = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
u AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS ln, unnest(ls) AS line FROM a),
w AS (
  SELECT doc_id, ln, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS m, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS i
  FROM u WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (SELECT *, m * 31 + lag(m, 1, 0) OVER o AS r, lag(line) OVER o AS prior, lag(n) OVER o AS prior_n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, i > 0 AND (r < lag(r) OVER (PARTITION BY doc_id ORDER BY i) OR n + prior_n > 50) AS begins FROM r),
s AS (SELECT doc_id, i, prior, line, lag(i, 2, 0) OVER o AS lo, lead(i) OVER o AS hi FROM b WHERE begins WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, list(line ORDER BY i) AS ws, list(ln ORDER BY i) AS ats FROM w GROUP BY doc_id),
k AS (
  SELECT s.doc_id, i, {'p': prior, 'l': line} AS key, false AS alone, ws[lo + 1:i] AS before, ws[i + 1:coalesce(hi, len(ws))] AS after FROM s JOIN d ON s.doc_id = d.doc_id
  UNION ALL SELECT doc_id, i, {'p': NULL, 'l': line}, true, []::VARCHAR[], [line] FROM w WHERE n > 50),
f AS (SELECT *, first_value(doc_id) OVER o AS doc0, first_value(i) OVER o AS i0, first_value(before) OVER o AS before0, first_value(after) OVER o AS after0
  FROM k WINDOW o AS (PARTITION BY key ORDER BY doc_id, i)),
e AS (SELECT doc_id, i, alone,
    coalesce(list_position(list_transform(generate_series(1, greatest(len(before), len(before0))), lambda j: coalesce(before[len(before) + 1 - j] = before0[len(before0) + 1 - j], false)), false) - 1, len(before))::BIGINT AS back,
    coalesce(list_position(list_transform(generate_series(1, greatest(len(after), len(after0))), lambda j: coalesce(after[j] = after0[j], false)), false) - 1, len(after))::BIGINT AS ahead
  FROM f WHERE (doc_id, i) <> (doc0, i0)),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i - back, i + ahead - 1)) AS i FROM e WHERE alone OR back + ahead >= 2),
x AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g),
y AS (SELECT x.doc_id, unnest(CASE WHEN nxt = i + 1 THEN generate_series(ats[i + 1], ats[i + 2] - 1) ELSE [ats[i + 1]] END) AS ln FROM x JOIN d ON x.doc_id = d.doc_id),
c AS (SELECT doc_id, count(*) + 1 AS n FROM s GROUP BY doc_id),
z AS (SELECT u.doc_id, u.ln, u.line, y.ln IS NOT NULL AS gone FROM u LEFT JOIN y ON u.doc_id = y.doc_id AND u.ln = y.ln)
SELECT z.doc_id, count(*)::BIGINT AS n_lines, coalesce(any_value(c.n), (any_value(d.doc_id) IS NOT NULL)::INT)::BIGINT AS n_chunks,
  (count(*) FILTER (WHERE gone))::BIGINT AS n_removed_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY z.ln) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM z LEFT JOIN c ON z.doc_id = c.doc_id LEFT JOIN d ON z.doc_id = d.doc_id GROUP BY z.doc_id
"""
