"""Codes of vectors: each of PARTS consecutive parts is replaced by its nearest codebook entry, in whole numbers.

Codebooks are refined by rounds of assignment and means. In each, a part's nearest entry is found by lower
bounds from segment means: if a part x and an entry c are cut into the same segments, of s numbers with means m and
residual norms r, then sum(s (m_x - m_c)^2 + (r_x - r_c)^2) over the segments is at most |x - c|^2. One segment
comes first, then finer ones for the pairs that are left; a pair goes once its bound, less a margin for rounding,
is over the least exact distance known, which each level takes from the entry of its least bound. The pairs that no level excludes get exact integer
distances, and the smallest decides, the lower index on a tie.

A round is one pass over the vectors: a task adds its parts up by entry, so no more than PARTS x ENTRIES sums leave
it, and the driver holds the codebooks, whose size is fixed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, map_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Segments of a part at each level of the bounds.
LEVELS = (1, 2, 4)
#: Relative margin for rounding in bounds; squares of numbers below EXACT add up exactly in 64 bits for parts of up to 2^17.
MARGIN, EXACT = 1e-9, 1 << 22
#: Vectors that are compared at once, tasks among which the rows of one label are dealt.
BLOCK, SALTS = 2048, 32
#: The largest error, and bits of the limbs that sums are added up in.
LONGEST, LIMB = 2**63 - 1, 62


def segment_sketch(rows: np.ndarray, segments: int) -> np.ndarray:
    """Points whose squared distances are lower bounds of the rows': scaled means and residual norms of the segments."""
    out = []
    for of in np.array_split(rows.astype(np.float64), min(segments, max(1, rows.shape[1])), axis=1):
        mean = of.mean(axis=1) if of.shape[1] else np.zeros(len(of))
        out += [mean * np.sqrt(of.shape[1]), np.sqrt(((of - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=1)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry, the squared distance, and how many exact distances that took; integers, or objects for those of any size."""
    n, k = len(rows), len(entries)
    best, error, spent = np.zeros(n, np.int64), np.zeros(n, rows.dtype), 0
    if rows.dtype == object:  # beyond the range in which bounds are safe: all distances
        for at in range(n):
            each = _exact(rows[at][None, :], entries)
            best[at] = min(range(k), key=lambda j: (each[j], j))  # noqa: B023
            error[at] = each[best[at]]
        return best, error, n * k
    theirs = [segment_sketch(entries, s) for s in LEVELS]
    for at in range(0, n, BLOCK):
        x = rows[at : at + BLOCK]
        own = [segment_sketch(x, s) for s in LEVELS]
        slack = MARGIN * ((own[0] ** 2).sum(axis=1) + (theirs[0] ** 2).sum(axis=1).max())  # sums of squares don't depend on the level
        bound = (own[0] ** 2).sum(axis=1)[:, None] + (theirs[0] ** 2).sum(axis=1)[None, :] - 2 * own[0] @ theirs[0].T
        limit = _exact(x, entries[np.argmin(bound, axis=1)]).astype(np.float64) + slack
        i, j = np.nonzero(bound <= limit[:, None])
        for mine, other in zip(own[1:], theirs[1:], strict=True):
            of = ((mine[i] - other[j]) ** 2).sum(axis=1)
            start = np.searchsorted(i, np.arange(len(x)))  # pairs come row by row, and a row's nearest entry always stays
            likely = np.maximum.reduceat(np.where(of == np.minimum.reduceat(of, start)[i], j, -1), start)
            limit = np.minimum(limit, _exact(x, entries[likely]) + slack)
            left = of <= limit[i]
            i, j, spent = i[left], j[left], spent + len(x)
        found = np.empty(len(i), rows.dtype)
        for part in range(0, len(i), 1 << 16):
            found[part : part + (1 << 16)] = _exact(x[i[part : part + (1 << 16)]], entries[j[part : part + (1 << 16)]])
        first = np.searchsorted(i, np.arange(len(x)))
        least = np.minimum.reduceat(found, first)
        places = np.where(found == least[i], j, k)
        best[at : at + BLOCK], error[at : at + BLOCK] = np.minimum.reduceat(places, first), least
        spent += len(i) + len(x)
    return best, error, spent


def _matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the given width as floored multiples of 1 / SCALE, and which rows they are. Python integers beyond EXACT."""
    fit = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(0)) == width) if width else np.zeros(0, np.int64)
    values = np.asarray(lists.take(pa.array(fit)).flatten(), dtype=np.float64).reshape(len(fit), width)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if np.abs(scaled).max(initial=0) < EXACT:
        return scaled.astype(np.int64), fit
    return np.array([[int(v) * SCALE if abs(v) > 2**53 else int(np.floor(v * SCALE)) for v in row] for row in values.tolist()], dtype=object).reshape(values.shape), fit


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _assigned(x: np.ndarray, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for part, own in enumerate(np.split(x, PARTS, axis=1)):
        book = books[part]
        kind = object if object in (own.dtype, book.dtype) else np.int64
        out.append(nearest(own.astype(kind), book.astype(kind))[:2])
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    lacks = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & ~lacks)


def _books(rows: list, width: int) -> list[np.ndarray]:
    x, _ = _matrix(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), width)
    return np.split(x, PARTS, axis=1)


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebooks, one array of entries a part, and the vectors' width; vectors are usable ones.

    Entries start as the parts of the ENTRIES smallest vec_ids (then smallest vectors) and become the floored means
    of their parts in each round; unused ones stay. The width is the first one's, and has to be a multiple of PARTS.
    """
    first = vectors.where("vec_id IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>")).orderBy("vec_id", "embedding").limit(1).collect()
    width = len(first[0]["embedding"]) if first else 0
    if not width or width % PARTS:
        return [np.zeros((0, 0), np.int64)] * PARTS, 0
    own = vectors.where(F.size("embedding") == width).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    books = _books(own.where("vec_id IS NOT NULL").orderBy("vec_id", "embedding").limit(ENTRIES).collect(), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, dtype=object) for b in books]  # noqa: B023
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]  # noqa: B023
        for batch in sliced(batches):
            x, _ = _matrix(batch.column(0), width)
            for part, (index, _) in enumerate(_assigned(x, books)):  # noqa: B023
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                if len(used):
                    sums[part][used] += np.add.reduceat(np.split(x, PARTS, axis=1)[part][order], first, axis=0)
                counts[part] += np.bincount(index, minlength=len(counts[part]))
        for part in range(PARTS):
            used = np.flatnonzero(counts[part])
            values = sums[part][used].tolist()
            for limb in range(max((abs(v).bit_length() for row in values for v in row), default=0) // LIMB + 1):
                held = [[(abs(v) >> LIMB * limb & (1 << LIMB) - 1) * (-1 if v < 0 else 1) for v in row] for row in values]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([limb] * len(used), pa.int32()), pa.array(counts[part][used], pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["part", "entry", "limb", "n", "sums"])

    for _ in range(rounds):
        added = map_batches(own.select("embedding"), run, "part int, entry int, limb int, n long, sums array<long>")
        totals = added.select("part", "entry", "limb", "n", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at", "limb").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(19,0)")).alias("v"))
        sums: dict[tuple[int, int, int], int] = defaultdict(int)
        counts = {}
        for row in totals.collect():  # one number of each entry's at most, by limbs
            sums[row["part"], row["entry"], row["at"]] += int(row["v"]) << LIMB * row["limb"]
            if not row["limb"]:
                counts[row["part"], row["entry"], row["at"]] = row["n"]
        fresh = [b.astype(object) for b in books]
        for (part, entry, at), total in sums.items():
            fresh[part][entry, at] = total // counts[part, entry, at]
        books = [b.astype(np.int64) if max(map(abs, b.flat), default=0) < EXACT else b for b in fresh]
    return books, width


def encode(vectors: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """vec_id, label, code (hex, two digits a part) and error (squared distance) of each vector; null where its width is another."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x, fit_rows = _matrix(batch.column(2), width)
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if len(fit_rows):
                found = _assigned(x, books)
                index = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                total = sum(e for _, e in found)
                for row, code, error in zip(fit_rows.tolist(), index, total.tolist(), strict=True):
                    codes[row], errors[row] = code.tobytes().hex(), min(error, LONGEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(rows, run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """codes with vector array<double>: the entries that a code names, put together and scaled back."""
    entry = F.expr(f"transform(sequence(0, {PARTS - 1}), p -> conv(substr(code, 2 * p + 1, 2), 16, 10)::int)")
    table = F.array(*[F.array(*[F.array(*[F.lit(float(v) / SCALE) for v in row]) for row in book]) for book in books])
    return codes.withColumn("vector", F.flatten(F.transform(entry, lambda e, p: F.get(F.get(table, p), e))))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' numbers by part, entry and place, as decimals with commas."""
    return hashlib.sha256(",".join(str(v) for book in books for row in book.tolist() for v in row).encode()).hexdigest()


def oracle(rounds: int = ROUNDS) -> str:
    """The same in SQL, on long tables of numbers and all distances."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(d := d, k := k)) AS best FROM (
    SELECT e.r, e.part, b.k, CAST(sum((e.x - b.x) * (e.x - b.x)) AS BIGINT) AS d FROM e JOIN b{t} b ON e.part = b.part AND e.pos = b.pos GROUP BY e.r, e.part, b.k) GROUP BY r, part)""")
        steps.append(f"""b{t + 1} AS MATERIALIZED (
  SELECT b.part, b.k, b.pos, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), b.x) AS x FROM b{t} b LEFT JOIN (
    SELECT e.part, a.best.k AS k, e.pos, CAST(sum(e.x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{t} a ON e.r = a.r AND e.part = a.part GROUP BY ALL) m
  ON b.part = m.part AND b.k = m.k AND b.pos = m.pos)""")
    return f"""
WITH num AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL),
cells AS MATERIALIZED (SELECT r, CAST(i AS BIGINT) - 1 AS i, width // {PARTS} AS step, CAST(x AS DOUBLE) AS x FROM (
  SELECT r, len(embedding) AS width, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM num)),
kept AS MATERIALIZED (SELECT * FROM num WHERE r NOT IN (SELECT r FROM cells WHERE x IS NULL OR NOT isfinite(x))),
e AS MATERIALIZED (SELECT r, i // step AS part, i % step AS pos, CAST(floor({SCALE} * x) AS BIGINT) AS x FROM cells WHERE r IN (SELECT r FROM kept)),
b0 AS MATERIALIZED (SELECT e.part, f.k, e.pos, e.x FROM e JOIN (
  SELECT r, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS k FROM kept WHERE vec_id IS NOT NULL QUALIFY k < {ENTRIES}) f ON e.r = f.r),
{", ".join(steps[:-1])},
coded AS (SELECT r, string_agg(format('{{:02x}}', best.k), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, k, pos)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN coded ON kept.r = coded.r"""


def query(vectors: DataFrame) -> DataFrame:
    """op13: code and error of every usable vector, the sum of errors of its label, and the codebooks' digest.

    Defined results: rows whose vector is null or holds null or non-finite numbers are left out; vectors of another
    width than the first one's (or all, if that is no multiple of PARTS) have null code and error; null vec_ids are
    encoded but start no entry; repeated rows count each; errors end at the largest long, label sums beyond it are
    null; an empty table gives no rows; other columns are ignored.
    """
    kept = cut(usable(vectors).select("vec_id", "label", "embedding"), "vectors")
    books, width = fit(kept)
    rows = cut(encode(kept, books, width), "vector-codes")
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    spread = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = dealt.join(spread, (F.col("label").eqNullSafe(F.col("of"))) & (dealt["salt"] == spread["salt"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
