"""Repair of conversation structure: the cheapest edits that make roles alternate, by A* on the edit lattice.

A conversation's rows, in order of turn, are letters: the role's initial and whether the row must go (blank or
duplicate), ends early (truncated) or is sound. A node of the lattice is a number of letters read and a state of the
role grammar `(s?(ua)+)?`. Edits are K keep, R rerole, D delete and I insert. The heuristic is a suffix sum: each row
that must go costs a deletion, and each truncated row its charge, which is less than a deletion. It is admissible and
consistent, so with keys (cost + heuristic, audit) the first visit of a node is by its cheapest, then least, edits:
two audits that reach one node at one cost are never a proper prefix of each other, so the order of audits outlasts
what follows.

Rows are put in order by a range sort of narrow facts, without texts, and cut into segments of RUN rows at most, so
one conversation may lie in many tasks. A segment that is a whole conversation is searched for its cheapest repair.
Other segments are searched from each state to each state, and the routes of adjoining segments are put together, in the
parts of the sort first, then in the conversation. Texts move once: each conversation's audit comes first, its rows
follow in order, and a task edits them as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, map_batches

DELETE, REROLE, INSERT, CHARGE = 4, 3, 3, 3
#: Rows of a segment, as a power of two; tasks among which the copies of one row are dealt.
RUN_BITS, SALTS = 10, 16
#: Position of a row in the range sort: partition above, row below.
PART_BITS = 33
BLANKS = " \t\n\v\f\r"
#: Letters: sound rows, truncated ones, and ones that must go, by initial.
SOUND, CUT_OFF, OUT = "suax", "SUAX", "1234"
#: States: nothing yet, after s, after u, after a. The role that comes next, and the state after it.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ACCEPTED = (START, AFTER_A)
LAWFUL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32(conv_id:turn) mod 20; a null role, text or key part counts as one space.

    0 drops the row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats the row, 4 makes its role user.
    """
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(put("conv_id"), F.lit(":"), put("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", put("role").alias("role"), put("text").alias("text"), key.alias("key")).where("key <> 0")
    text = F.when(F.col("key") == 1, "").when(F.col("key") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("key") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("key") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _initials(codes: str) -> str:
    return codes.translate(str.maketrans(CUT_OFF + OUT, SOUND + SOUND))


def unlawful(initials: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    return sum(a + b not in LAWFUL for a, b in zip(initials, initials[1:], strict=False))


def search(codes: str, entry: int = START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """(cost, audit) by exit state of the cheapest edits of the letters, the ASCII-least of equal cost; whole: of the best accepted exit only."""
    rest = [0]
    for c in reversed(codes):
        rest.append(rest[-1] + (DELETE if c in OUT else CHARGE if c in CUT_OFF else 0))
    rest.reverse()
    heap, seen, found = [(rest[0], "", 0, entry)], set(), {}
    while heap:
        key, audit, i, state = heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        cost = key - rest[i]
        if i == len(codes):
            if not whole:
                found[state] = cost, audit
            elif state in ACCEPTED:
                return {state: (cost, audit)}
        else:
            c, ahead = codes[i], cost + rest[i + 1]
            heappush(heap, (ahead + DELETE, audit + "D", i + 1, state))
            if c not in OUT:
                charged = ahead + (CHARGE if c in CUT_OFF else 0)
                initial, after = c.lower(), NEXT_STATE[state]
                if initial == NEXT_ROLE[state][0]:
                    heappush(heap, (charged, audit + "K", i + 1, after))
                elif initial == "s" and state == START:
                    heappush(heap, (charged, audit + "K", i + 1, AFTER_S))
                heappush(heap, (charged + REROLE, audit + "R", i + 1, after))
        heappush(heap, (key + INSERT, audit + "I", i, NEXT_STATE[state]))
    return found


@lru_cache(maxsize=1 << 14)
def routes(codes: str, whole: bool) -> tuple[tuple[int, str] | None, ...]:
    """search from each state to each state, 16 routes; of a whole conversation, the best one from the start."""
    out: list[tuple[int, str] | None] = [None] * 16
    for entry in (START,) if whole else range(4):
        for state, found in search(codes, entry, whole).items():
            out[4 * entry + state] = found
    return tuple(out)


def joined(left: list, right: list) -> list:
    """Routes over two adjoining segments: the cheapest by way of any state, then the least audit."""
    out = []
    for k in range(16):
        ways = [(a[0] + b[0], a[1] + b[1]) for m in range(4) if (a := left[k // 4 * 4 + m]) and (b := right[4 * m + k % 4])]
        out.append(min(ways, default=None))
    return out


#: A segment's routes and counts, as fields of its table.
FIELDS = "costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]


def _solved(segments: DataFrame) -> DataFrame:
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.to_pydict()
            ways = [routes(c, w) for c, w in zip(of["codes"], of["whole"], strict=True)]
            initials = [_initials(c) for c in of["codes"]]
            columns = [
                batch.column("conv_id"), batch.column("part"), batch.column("segment"),
                pa.array([[x and x[0] for x in w] for w in ways], pa.list_(pa.int64())), pa.array([[x and x[1] for x in w] for w in ways], pa.list_(pa.string())),
                batch.column("blank"), batch.column("duplicate"), batch.column("truncated"), pa.array([unlawful(x) for x in initials], pa.int64()),
                pa.array([x[:1] for x in initials], pa.string()), pa.array([x[-1:] for x in initials], pa.string()), batch.column("low"), batch.column("high"), batch.column("turns"),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "segment", *NAMES])

    return map_batches(segments, run, f"conv_id {kind}, part long, segment long, {FIELDS}")


def _merge(a: dict, b: dict) -> dict:
    ways = joined(a["ways"], b["ways"])
    out = {n: a[n] + b[n] for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in LAWFUL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    first = lambda x, y: y if x is None else x
    return out | {"ways": ways, "first": a["first"], "last": b["last"], "low": first(a["low"], b["low"]), "high": first(b["high"], a["high"])}


def _folded(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each value of the keys: its rows put together in order, as a stream."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}

    def row(at: tuple, held: dict) -> dict:
        held = held | {"costs": [w and w[0] for w in held["ways"]], "audits": [w and w[1] for w in held["ways"]]}
        return dict(zip(keys, at, strict=True)) | {n: held[n] for n in NAMES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out, schema = None, None, [], None
        for batch in batches:
            schema = pa.schema([batch.schema.field(n) for n in [*keys, *NAMES]])
            for start in range(0, batch.num_rows, 256):
                for item in batch.slice(start, 256).to_pylist():
                    item["ways"] = [c is not None and (c, a) or None for c, a in zip(item["costs"], item["audits"], strict=True)]
                    key = tuple(item[k] for k in keys)
                    if key == at and held:
                        held = _merge(held, item)
                    else:
                        if held:
                            out.append(row(at, held))
                        at, held = key, item
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if held:
            yield pa.RecordBatch.from_pylist([row(at, held)], schema=schema)

    dealt = table.repartition(*keys).sortWithinPartitions(*keys, order)
    return map_batches(dealt.select(*keys, *NAMES), run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), FIELDS]))


def _facts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, blank, truncated) of rows, without their texts."""
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    return rows.select(
        "conv_id", "turn", "role", digest(F.col("text")).alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))


def digest(text: Column) -> Column:
    """Tells texts apart, and orders those of one turn and role."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, blank, duplicate, truncated, illegal, gaps) of each conversation in rows, whose texts and roles aren't null."""
    order = ["conv_id", "turn", "role", "digest"]
    sorted_rows = _facts(rows).withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order, "uid").sortWithinPartitions(*order, "uid")
    placed = cut(sorted_rows.drop("uid").withColumn("pos", F.monotonically_increasing_id()), "dialogue-facts")
    again = placed.where("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("least"), F.count("*").alias("n")).where("n > 1")
    spread = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("g"), "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("g")) & (F.pmod(F.xxhash64("pos"), F.lit(SALTS)) == F.col("s"))
    marked = placed.join(spread, same, "left").withColumn("duplicate", ~F.col("blank") & (F.col("pos") > F.coalesce("least", "pos")))
    marked = marked.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("truncated"))
    letter = F.when(F.col("blank") | F.col("duplicate"), F.translate("initial", SOUND, OUT)).when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    segments = marked.groupBy("conv_id", F.shiftright("pos", RUN_BITS).alias("segment")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter")))), lambda x: x["letter"]), "").alias("codes"),
        count("blank"), count("duplicate"), count("truncated"), F.min("turn").cast("long").alias("low"), F.max("turn").cast("long").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"))
    alone = F.count("*").over(Window.partitionBy("conv_id")) == 1
    solved = _solved(segments.withColumns({"whole": alone, "part": F.shiftright("segment", PART_BITS - RUN_BITS)}))
    whole = _folded(_folded(solved, ["conv_id", "part"], "segment"), ["conv_id"], "part")
    way = lambda q: F.struct(F.get("costs", F.lit(q)).alias("cost"), F.get("audits", F.lit(q)).alias("audit"))
    best = F.array_min(F.filter(F.array(*[way(q) for q in ACCEPTED]), lambda w: w["cost"].isNotNull()))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return whole.select("conv_id", best.alias("best"), "blank", "duplicate", "truncated", "illegal", gaps.alias("gaps")).select("conv_id", "best.cost", "best.audit", "blank", "duplicate", "truncated", "illegal", "gaps")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _stream(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation of ids: a row of its own, then its plan, whose text is the audit, then its rows in order; a conversation lies in one partition."""
    kind = rows.schema["turn"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    head = ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), none(kind).alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), none("array<long>").alias("counts"))
    plan = plans(rows).select("conv_id", F.lit(1), none(kind), none("string"), none("binary"), "audit", F.array(*COUNTS))
    texts = rows.select("conv_id", F.lit(2), "turn", "role", digest(F.col("text")), "text", none("array<long>"))
    return head.union(plan).union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, counts, audit, rows) by conversation, rows as a stream of (turn, role, text)."""

    def items() -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)

    for conv, found in groupby(items(), itemgetter(0)):
        counts, audit, first = [0] * len(COUNTS), "", None
        for item in found:
            if item[1] == 2:
                first = item
                break
            if item[1] == 1:
                audit, counts = item[5], item[6]
        more = (x for part in ([first] if first else [], found) for x in part)  # noqa: B023
        yield conv, counts, audit, ((x[2], x[3], x[5]) for x in more)


def edited(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(edit, turn, role, text) of the rows that an audit leaves or puts in, in order."""
    state = START
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit in "IR":
            role = NEXT_ROLE[state]
        state = AFTER_S if state == START and role[:1] == "s" else NEXT_STATE[state]
        yield edit, turn, role, text


def repaired(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, place from 0, edit, turn, role, text) of every row that the cheapest repair leaves or puts in."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        names = ["conv_id", "place", "edit", "turn", "role", "text"]
        schema = pa.schema([(n, {"conv_id": first.schema.field(0).type, "turn": first.schema.field(2).type, "place": pa.int64()}.get(n, pa.string())) for n in names])
        out = []
        for conv, _, audit, own in _conversations(b for part in ([first], batches) for b in part):
            for place, row in enumerate(edited(audit, own)):
                out.append(dict(zip(names, (conv, place, *row), strict=True)))
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return map_batches(_stream(rows, rows if ids is None else ids), run, f"conv_id {kinds['conv_id']}, place long, edit string, turn {kinds['turn']}, role string, text string")


def summaries(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in ids.

    The digest is of the repaired rows as role:text, one a line. It is one stream, so a conversation's texts pass one
    task, a batch at a time.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field(0).type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out = []
        for conv, counts, audit, own in _conversations(b for part in ([first], batches) for b in part):
            sha = hashlib.sha256()
            for place, (_, _, role, text) in enumerate(edited(audit, own)):
                sha.update(f"{chr(10) * (place > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
            out.append((conv, *counts, audit, sha.hexdigest()))
            if len(out) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return map_batches(_stream(rows, rows if ids is None else ids), run, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def query(conversations: DataFrame) -> DataFrame:
    """op12: damage, faults, gaps, the cheapest repair and its digest, of every conversation.

    Defined results: null conv_ids are one conversation; null turns come first; rows of one turn go by role, then by
    the SHA-256 of their text; null roles and texts are one space; an initial other than s, u, a fits no place;
    a conversation without rows has zeros, an empty audit and the hash of nothing; an empty table gives no rows; other
    columns are ignored.
    """
    return summaries(damaged(conversations), conversations)


#: The same by dynamic programming, row by row, over the states of the role grammar.
ORACLE = f"""
WITH RECURSIVE named AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
bits AS (SELECT b, b AS v, 0 AS n FROM range(256) t(b) UNION ALL SELECT b, xor(v >> 1, (v & 1) * 3988292384), n + 1 FROM bits WHERE n < 8),
bytes AS MATERIALIZED (SELECT b, v FROM bits WHERE n = 8),
crc AS (
  SELECT DISTINCT name, 0 AS n, CAST(4294967295 AS BIGINT) AS v FROM named
  UNION ALL SELECT name, n + 1, xor(crc.v >> 8, bytes.v) FROM crc JOIN bytes ON bytes.b = xor(crc.v, ascii(substr(name, n + 1, 1))) & 255 WHERE n < length(name)),
src AS MATERIALIZED (SELECT named.*, xor(crc.v, 4294967295) % 20 AS key FROM named JOIN crc ON crc.name = named.name AND crc.n = length(named.name)),
rows_ AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN key = 4 THEN 'user' ELSE role END AS role,
    CASE key WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM src, range(2) c(copy) WHERE key <> 0 AND (copy = 0 OR key = 3)),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM rows_),
faults AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'c' END AS fault, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
gap AS (VALUES (0, 0, 0, ''), (0, 2, {INSERT}, 'I'), (0, 3, {2 * INSERT}, 'II'), (1, 1, 0, ''), (1, 2, {INSERT}, 'I'), (1, 3, {2 * INSERT}, 'II'),
  (2, 2, 0, ''), (2, 3, {INSERT}, 'I'), (3, 3, 0, ''), (3, 2, {INSERT}, 'I')),
put AS (SELECT col0 AS q, col1 AS p, col2 AS cost, col3 AS audit FROM gap),
after AS (SELECT * FROM (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(q, role, p)),
moves AS MATERIALIZED (
  SELECT q, p, initial, fault, CASE fault WHEN 't' THEN {CHARGE} ELSE 0 END AS cost, 'K' AS edit FROM (SELECT q, role AS initial, p FROM after UNION ALL SELECT 0, 's', 1) k, (VALUES ('c'), ('t')) f(fault)
  UNION ALL SELECT q, p, initial, fault, {REROLE} + CASE fault WHEN 't' THEN {CHARGE} ELSE 0 END, 'R' FROM after, (VALUES ('s'), ('u'), ('a'), ('x')) t(initial), (VALUES ('c'), ('t')) f(fault)
  UNION ALL SELECT q, q, initial, fault, {DELETE}, 'D' FROM after, (VALUES ('s'), ('u'), ('a'), ('x')) t(initial), (VALUES ('b'), ('d'), ('c'), ('t')) f(fault)),
steps AS MATERIALIZED (SELECT put.q, moves.p, initial, fault, put.cost + moves.cost AS cost, put.audit || edit AS audit FROM put JOIN moves ON put.p = moves.q),
walk AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS q, struct_pack(cost := 0, audit := '') AS best FROM faults
  UNION ALL
  SELECT c, i, q, best FROM (
    SELECT w.c, w.i + 1 AS i, s.p AS q, min(struct_pack(cost := w.best.cost + s.cost, audit := w.best.audit || s.audit)) AS best
    FROM walk w JOIN faults f ON f.c = w.c AND f.i = w.i + 1 JOIN steps s ON s.q = w.q AND s.initial = f.initial AND s.fault = f.fault GROUP BY 1, 2, 3)),
counts AS (
  SELECT c, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c),
ends AS MATERIALIZED (
  SELECT k.c, min(struct_pack(cost := w.best.cost + put.cost, audit := w.best.audit || put.audit)) AS best
  FROM counts k JOIN walk w ON w.c = k.c AND w.i = k.n JOIN put ON put.q = w.q WHERE put.p IN (0, 3) GROUP BY k.c),
letters AS (SELECT c, k, substr(audit, k, 1) AS edit FROM (SELECT c, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS k FROM ends)),
read AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY c ORDER BY k) AS i FROM letters),
stay AS (
  SELECT r.c, k, edit, f.role, f.text, edit = 'K' AND f.initial = 's' AS lead FROM read r LEFT JOIN faults f ON edit <> 'I' AND f.c = r.c AND f.i = r.i WHERE edit <> 'D'),
said AS (
  SELECT c, k, CASE WHEN edit = 'K' THEN role WHEN count(*) FILTER (NOT coalesce(lead, false)) OVER (PARTITION BY c ORDER BY k) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line FROM stay),
hashes AS (SELECT c, sha256(string_agg(line, chr(10) ORDER BY k)) AS repaired_sha256 FROM said GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends ON ends.c = counts.c LEFT JOIN hashes ON hashes.c = counts.c"""
