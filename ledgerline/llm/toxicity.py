"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into classes (insult, threat, target, negation, report, link) with weights. Small
transducers read the classes of a clause: one tracks a target in reach, one the scope of a negation, one reported
speech. They are composed into one deterministic machine, and a second one, of target and report, reads its
output from right to left, so that a target or a report may also follow. Two more read the whole text with its breaks
between clauses: they find insults that a copula or an indefinite article predicates ("is a moron", "what a clown"),
that make up a short clause ("idiot", "away idiot"), and that are heaped, with another insult in
the same clause or one near by. What comes out for an insult or threat is a pattern: addressed, threat, softened
(negated or reported), named (predicated, in a short clause, or heaped), or none. Each matched clause adds its patterns'
weights to the document; an insult that no pattern holds adds nothing. A logistic layer turns the sums into a
probability.

Learned, from a bounded sample of labelled rows: further insult words and stems (a word beginning) by
log-odds, and the logistic layer.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, labelled, map_slices, remainder

#: Labelled rows that the lexicon and the logistic layer are fitted on, at most.
TRAIN_ROWS = 6000
STEMS = (4, 5, 6)
#: Toxic texts that must hold a learned word or stem: LEAST, and one in SHARE. So at most SHARE times the mean number of distinct words and stems of a toxic text are learned.
LEAST, SHARE = 6, 60
FOLDS, HELD_OUT = 5, 0

# The seed word lists.
INSULTS = "idiot idiots moron morons stupid trash scum loser losers pathetic worthless clown clowns disgusting imbecile dumbass bastard bastards vermin filth freak dimwit halfwit cretin".split()
THREATS = "kill murder destroy hurt hang shoot stab burn beat strangle exterminate".split()
TARGETS = "you your yours u ur he she they them him her his their this those these du dich dein ihr euch tu te vous ton vos usted ustedes".split()
NEGATIONS = "not no never isn aren wasn don doesn nicht kein keine nie pas jamais ne nunca ni".split()
LINKS = "is are was were be been am a an what such ist sind war bist ein eine est sont un une una eres son".split()
REPORTS = "said says say claimed claims called calls wrote reported quoted quote allegedly sagte sagt disait dit dijo dice".split()

SEED_WEIGHT, THREAT_WEIGHT = 3.0, 2.0
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+|\b(?:but|aber|sondern|mais|pero|sino)\b")
Arc = tuple[str, str, float]  # next state, output class, factor


class Machine(NamedTuple):
    """A deterministic weighted transducer over word classes; a class without an arc is copied and ends in `rest`."""

    start: str
    arcs: dict[tuple[str, str], Arc]
    rest: dict[str, str]

    def step(self, state: str, symbol: str) -> Arc:
        return self.arcs.get((state, symbol)) or (self.rest[state], symbol, 1.0)

    def run(self, symbols: list[str]) -> tuple[list[str], list[float]]:
        """Output classes and factors, one a symbol."""
        state, out, factors = self.start, [], []
        for symbol in symbols:
            state, symbol, factor = self.step(state, symbol)
            out.append(symbol)
            factors.append(factor)
        return out, factors


SIGNS = ("", "+", "-", "+-")


def _countdown(name: str, opener: str, reach: int, factor: float, mark: str) -> Machine:
    """Opens a scope of `reach` words at `opener`; insults and threats inside get the mark, and the factor if they lack the mark."""
    states = ["0", *(f"{name}{i}" for i in range(reach, 0, -1))]
    after = dict(zip(states[1:], [*states[2:], "0"], strict=True)) | {"0": "0"}
    arcs: dict[tuple[str, str], Arc] = {(s, opener): (states[1], opener, 1.0) for s in states}
    for s in states[1:]:
        for kind in ("insult", "threat"):
            for old in SIGNS:
                arcs[s, kind + old] = (after[s], kind + "".join(x for x in "+-" if x in old + mark), 1.0 if mark in old else factor)
    return Machine("0", arcs, after)


def compose(first: Machine, second: Machine, symbols: list[str]) -> Machine:
    """The machine that feeds first's output to second, over the states that can be reached."""
    start, arcs, open_states, seen = f"{first.start}/{second.start}", {}, [(first.start, second.start)], set()
    while open_states:
        a, b = open_states.pop()
        if (a, b) in seen:
            continue
        seen.add((a, b))
        for symbol in symbols:
            a2, middle, x = first.step(a, symbol)
            b2, out, y = second.step(b, middle)
            arcs[f"{a}/{b}", symbol] = (f"{a2}/{b2}", out, x * y)
            open_states.append((a2, b2))
    return Machine(start, arcs, {f"{a}/{b}": f"{a}/{b}" for a, b in seen})


CLASSES = ["other", "insult", "threat", "target", "negation", "report", "link"]
MARKED = [*CLASSES, *(kind + sign for kind in ("insult", "threat") for sign in SIGNS[1:])]
#: What stands between clauses, an insult that a pattern of the whole text holds, and one whose clause is short up to it.
BREAK, HELD, SHORT_SO_FAR = "break", "insult^", "insult?"
BAD = ("insult", HELD, SHORT_SO_FAR)
#: The pattern of an output; a threat without a target is none, and an insult without one may be named.
PATTERNS = {"insult": "lone", "insult+": "addressed", "insult-": "softened", "insult+-": "softened", "threat+": "threat", "threat+-": "softened"}
#: Sums over the matched clauses, and the best clause (softened patterns apart).
FEATURES = ("addressed", "threat", "softened", "named", "best")
#: Words that a link reaches, breaks over which insults are heaped, and words on either side of an insult in a short clause.
LINK_REACH, HEAP_REACH, SHORT = 3, 6, 1


def _linked() -> Machine:
    """Insults within reach after a link, in the same clause."""
    states = ["0", *(f"l{i}" for i in range(LINK_REACH, 0, -1))]
    after = dict(zip(states[1:], [*states[2:], "0"], strict=True)) | {"0": "0"}
    arcs: dict[tuple[str, str], Arc] = {(s, "link"): (states[1], "link", 1.0) for s in states} | {(s, BREAK): ("0", BREAK, 1.0) for s in states}
    return Machine("0", arcs | {(s, kind): (after[s], HELD, 1.0) for s in states[1:] for kind in BAD}, after)


def _short(there: str, kept: str, given: str) -> Machine:
    """Insults of class `there` with at most SHORT words between them and the break before come out as `kept`, others as `given`."""
    states = [f"c{i}" for i in range(SHORT + 2)]
    after = dict(zip(states, [*states[1:], states[-1]], strict=True))
    arcs: dict[tuple[str, str], Arc] = {(s, BREAK): (states[0], BREAK, 1.0) for s in states}
    return Machine(states[0], arcs | {(s, there): (after[s], kept if s != states[-1] else given, 1.0) for s in states}, after)


def _heaped() -> Machine:
    """Insults after another one, over fewer than HEAP_REACH breaks."""
    states = ["0", *(f"h{i}" for i in range(1, HEAP_REACH + 1))]
    arcs: dict[tuple[str, str], Arc] = {(s, BREAK): (states[max(0, i - 1)], BREAK, 1.0) for i, s in enumerate(states)}
    for s in states:
        arcs |= {(s, kind): (states[-1], kind if s == "0" else HELD, 1.0) for kind in BAD}
    return Machine("0", arcs, {s: s for s in states})


@lru_cache(maxsize=1)
def grammar() -> tuple[Machine, Machine]:
    """The machine that reads a clause from left to right, and the one that reads its output from right to left."""
    target, report = _countdown("t", "target", 5, 1.5, "+"), _countdown("r", "report", 8, 0.5, "-")
    forward = compose(compose(target, _countdown("n", "negation", 3, 0.5, "-"), CLASSES), report, CLASSES)
    return forward, compose(target, report, MARKED)


@lru_cache(maxsize=1)
def syntax() -> tuple[Machine, Machine]:
    """The machines that read the classes of a whole text with its breaks, from left to right and back."""
    symbols = [*CLASSES, BREAK, HELD, SHORT_SO_FAR]
    ahead = compose(_linked(), compose(_short("insult", SHORT_SO_FAR, "insult"), _heaped(), symbols), symbols)
    return ahead, compose(_short(SHORT_SO_FAR, HELD, "insult"), _heaped(), symbols)


class Scorer:
    """Clause scores of texts under a lexicon of words and stems (a stem ends in '*')."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.classes: dict[str, tuple[str, float]] = {}
        for kind, words, weight in (("link", LINKS, 0.0), ("report", REPORTS, 0.0), ("negation", NEGATIONS, 0.0), ("target", TARGETS, 0.0), ("threat", THREATS, THREAT_WEIGHT), ("insult", INSULTS, SEED_WEIGHT)):
            self.classes |= dict.fromkeys(words, (kind, weight))
        self.classes |= {w: ("insult", max(x, self.classes.get(w, ("", 0.0))[1])) for w, x in learned.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in learned.items() if w.endswith("*")}
        self.known: dict[str, tuple[str, float]] = {}
        self.forward, self.backward = grammar()
        self.ahead, self.back = syntax()

    def of(self, word: str) -> tuple[str, float]:
        found = self.known.get(word)
        if found is None:
            found = self.classes.get(word)
            if found is None:
                weight = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n), default=0.0)
                found = ("insult", weight) if weight else ("other", 0.0)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def patterns(self, text: str) -> list[list[tuple[str, float]]]:
        """(pattern, weight) of each insult or threat that has one, by clause."""
        clauses = [[self.of(w) for w in WORD.findall(c)] for c in CLAUSE.split(text)]
        stream = [kind for c in clauses for kind in [*(k for k, _ in c), BREAK]]
        out, _ = self.ahead.run(stream)
        out, _ = self.back.run(out[::-1])
        held, at, found = out[::-1], 0, []
        for of in clauses:
            here, at = held[at : at + len(of)], at + len(of) + 1
            found.append(self._clause(of, here) if any(weight for _, weight in of) else [])
        return found

    def _clause(self, of: list[tuple[str, float]], held: list[str]) -> list[tuple[str, float]]:
        out, there = self.forward.run([kind for kind, _ in of])
        out, back = self.backward.run(out[::-1])
        found = [(PATTERNS.get(o), weight * x * y, h) for o, (_, weight), x, y, h in zip(out[::-1], of, there, back[::-1], held, strict=True) if weight]
        return [("named" if p == "lone" else p, w) for p, w, h in found if p and (p != "lone" or h == HELD)]

    def features(self, text: str | None) -> np.ndarray:
        """FEATURES of a document, log1p of sums of weights."""
        low = (text or "").lower()
        if not any(self.of(w)[1] for w in set(WORD.findall(low))):
            return np.zeros(len(FEATURES))
        sums, best = dict.fromkeys(FEATURES[:-1], 0.0), 0.0
        for matched in self.patterns(low):
            for pattern, weight in matched:
                sums[pattern] += weight
            best = max(best, sum(w for p, w in matched if p != "softened"))
        return np.log1p([*sums.values(), best])


class Model(NamedTuple):
    lexicon: dict[str, float]
    weights: list[float]  # bias first

    def probability(self, features: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.weights[0] + features @ np.array(self.weights[1:]), -30, 30))))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and stems that mark toxic rows, with log-odds as weights. Equal texts count once; LEAST and SHARE bound how many there can be."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            for key in words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}:
                counts.setdefault(key, [0, 0])[y] += 1
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k][1] for k in keys], pa.int64()), pa.array([counts[k][0] for k in keys], pa.int64())], names=["key", "toxic", "clean"])

    once = sample.groupBy("text").agg(F.max("y").alias("y"))
    n = once.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).first()
    if not n["toxic"] or not n["clean"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (n["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (n["clean"] + 1.0))
    found = (
        map_slices(once, run, "key string, toxic long, clean long")
        .groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(f"toxic >= {max(LEAST, n['toxic'] // SHARE)}")
        .withColumn("odds", odds).where("odds >= 3.0").orderBy("key").collect()
    )
    return {r["key"]: round(min(r["odds"], 6.0), 6) for r in found}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents outside the held-out remainder; only the lexicon and the features of these reach the driver."""
    sample = cut(labelled(docs, labels, "toxic", FOLDS, HELD_OUT, rows).select("text", "y"), "toxicity-sample")
    lexicon = learn_lexicon(sample)

    def run(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([scorer.features(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = map_slices(sample, run, "x array<double>, y int", lambda: Scorer(lexicon)).collect()
    return Model(lexicon, logistic(np.array([r["x"] for r in got], dtype=float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], dtype=float)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton steps, halved until they gain, for a ridge-penalised logistic fit around prior weights (bias first); the prior alone if there are no rows."""
    prior = np.array([-4.0, 2.0, 2.0, 0.5, 1.0, 1.5])
    if not len(y):
        return prior.tolist()
    z, w = np.column_stack([np.ones(len(y)), x]), prior.copy()

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, z @ w).sum() - y @ (z @ w) + ridge / 2 * ((w - prior) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * (w - prior))
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() <= 1e-9:
            break
    return w.tolist()


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs; null, empty and matchless texts get the score of no clause."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [shared.value.probability(scorer.features(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double", lambda: Scorer(shared.value.lexicon))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of docs that score below the threshold, all columns, without a shuffle.

    Defined results: null and empty texts hold no clause and stay; repeated rows stay or go together; an
    empty table gives no rows; columns that clash with the operator's own are no trouble.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([shared.value.probability(scorer.features(t)) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_slices(docs, run, docs.schema, lambda: Scorer(shared.value.lexicon))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op5: doc_id, held_out, score, predicted of every document.

    Defined results: null and empty texts get the score of a text without any clause; repeated rows
    give repeated rows; without labels the prior weights score; columns besides doc_id and text are ignored.
    """
    scored = with_scores(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
