"""Conversation repair against dynamic programming over all edits, and rows that the SQL's tables lack."""

import hashlib
import re
import zlib
from functools import cache
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import dialogues as d

SHAPE = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Best (cost, audit, roles) of rows (initial, fault), by trying every edit with up to two insertions between rows."""

    @cache
    def best(i, state):  # state: initials so far, folded to what the shape can tell apart
        out = []
        for n in range(3):
            put = state
            for _ in range(n):
                put = {"": "u", "s": "u", "u": "a", "a": "u"}[put]
            ins = ("I" * n, 3 * n)
            if i == len(rows):
                if put in ("", "a"):
                    out.append((ins[1], ins[0]))
                continue
            initial, fault = rows[i]
            moves = [("D", 4, put)]
            if fault in "ct":
                fee = 3 * (fault == "t")
                after = {"": "u", "s": "u", "u": "a", "a": "u"}[put]
                if initial == after:
                    moves.append(("K", fee, after))
                if initial == "s" and put == "":
                    moves.append(("K", fee, "s"))
                moves.append(("R", fee + 3, after))
            for edit, cost, after in moves:
                more = best(i + 1, after)
                if more:
                    out.append((ins[1] + cost + more[0], ins[0] + edit + more[1]))
        return min(out, default=None)

    return best(0, "")


def codes(rows):
    return "".join({"c": d.SOUND, "t": d.CUT_OFF, "b": d.OUT, "d": d.OUT}[f][d.SOUND.index(i)] for i, f in rows)


ROW = st.tuples(st.sampled_from("suax"), st.sampled_from("cctbd"))


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=12))
def test_search_finds_the_cheapest_and_least_audit(rows):
    assert min(d.search(codes(rows)).values()) == cheapest(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(ROW, min_size=2, max_size=12), st.integers(1, 11))
def test_routes_over_segments_are_those_over_the_whole(rows, at):
    text = codes(rows)
    both = d.joined(list(d.routes(text[:at], False)), list(d.routes(text[at:], False)))
    assert min(w for q in d.ACCEPTED if (w := both[q])) == cheapest(rows)


def test_every_short_conversation():
    for n in range(4):
        for rows in product(product("sux", "ctd"), repeat=n):
            assert min(d.search(codes(rows)).values()) == cheapest(rows)


def expected(rows):
    """The contract by hand, for rows (conv_id, turn, role, text) as damaged."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0), r[2], hashlib.sha256(r[3].encode()).digest()))
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        own, seen, marked = [r for r in rows if r[0] == conv], set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "c"
            seen.add((role, text))
            marked.append((role[0] if role and role[0] in "sua" else "x", fault))
        cost, audit = cheapest(tuple(marked))
        lines, k, initials = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[k][2:]
            k += edit != "I"
            if edit == "D":
                continue
            if edit in "IR":
                role = "assistant" if initials[-1:] == "u" else "user"
            initials += role[0]
            lines.append(f"{role}:{text}")
        assert SHAPE.match(initials)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [f for _, f in marked]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


ODD = [
    (1, None, "user", "first?"), (1, None, "assistant", "answer."), (1, 5, "user", " "), (1, 5, "user", "twice."), (1, 5, "user", "twice."), (1, 9, "assistant", "cut off"),
    (2, 3, "system", "s."), (2, 1, "tool", "t."), (2, 2, "", "no role."), (2, 7, "Assistant", "upper!"), (None, 1, "user", "no id."), (None, None, "assistant", "no turn."),
    (3, None, "user", "\t\n"), (4, 1, "user", "no-break space "), (4, 2, "assistant", "next line\u0085"), (4, 3, "user", "done. \n\v"), (5, 1, "user", "x" * 300_000 + "."),
    (6, 1, "assistant", ""), (6, 2, "assistant", "."), (6, 2, "assistant", "."), (7, -3, "system", "a"), (7, 4, "system", "b"),
]


@pytest.mark.parametrize("bits", [10, 1])
def test_odd_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(d, "RUN_BITS", bits)
    rows = spark.createDataFrame(ODD, SCHEMA).withColumn("audit", F.lit("clash")).withColumn("pos", F.lit(1))
    assert got(d.summaries(rows)) == expected(ODD)
    assert d.summaries(rows.limit(0)).count() == 0


def test_one_long_conversation_over_many_segments_and_parts(spark, monkeypatch):
    monkeypatch.setattr(d, "RUN_BITS", 4)
    rows = [(8, i // 2 * (1 + i % 3 // 2), ["user", "assistant", "system", "tool", "user"][i * 7 % 5], ["fine.", "cut", "", "again?"][i * 5 % 4] if i % 6 else f"own {i}.") for i in range(700)] + [(9, 1, "user", "hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(d.summaries(df)) == expected(rows)


def test_a_conversation_of_one_row_repeated(spark):
    rows = [(1, 4, "user", "same.")] * 3000
    out = got(d.summaries(spark.createDataFrame(rows, SCHEMA)))
    assert out[1][:7] == (0, 0, 2999, 0, 2999, 11999 - 4 + 4, "K" + "D" * 2999 + "I") or out[1][5] == 2999 * 4 + 3


def test_query_with_nulls_matches_the_contract_by_hand(spark):
    rows = [(i % 40 if i % 41 else None, i // 40 if i % 37 else None, [None, "user", "assistant", "system"][i * 11 % 4], [None, "a. b!", "question?", "cut"][i * 7 % 4] if i % 3 else f"n {i}.") for i in range(900)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", key int")
    hurt = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        hurt += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    want = dict.fromkeys({r[0] for r in rows}, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) | expected(hurt)
    assert got(d.query(df)) == want


def test_repaired_rows_are_lawful_and_keep_their_texts(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    plans = {r["conv_id"]: r["audit"] for r in d.plans(rows).collect()}
    found = {}
    for r in sorted(d.repaired(rows).collect(), key=lambda r: r["place"]):
        found.setdefault(r["conv_id"], []).append(r)
    texts = {(c, t) for c, _, _, t in ODD}
    for conv, own in found.items():
        assert SHAPE.match("".join(r["role"][0] for r in own)) and [r["place"] for r in own] == list(range(len(own)))
        assert "".join(r["edit"] for r in own) == plans[conv].replace("D", "")
        assert all((conv, r["text"]) in texts for r in own if r["edit"] != "I")
