"""The operators against brute force, published libraries, exact round trips and held-out rows."""

import random
from collections import Counter
from hashlib import md5
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, language, licenses, line_chunks, minhash, pieces, quality, rules, simhash, token_counts, toxicity
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# Decontamination


def substring_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", min_size=1, max_size=70), st.text("ab c", max_size=90))
def test_myers_equals_dynamic_programming(pattern, text):
    assert decontaminate.myers(decontaminate.bits_of(pattern), len(pattern), text) == substring_distance(pattern, text)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        chars[i : i + 1] = rng.choice([[], ["q"], [chars[i], "z"]])
    return "".join(chars)


def test_every_passage_within_budget_is_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(25)]
    rows = [(i, " ".join([word() for _ in range(30)] + [edited(rng, items[i % 25][1], rng.randint(0, 8)).upper()] + [word() for _ in range(30)])) for i in range(100)]
    rows += [(i, " ".join(word() for _ in range(80))) for i in range(100, 130)]
    want = set()
    for d, text in rows:
        for k, item in items:
            m = len(decontaminate.normalised(item))
            if d % 25 == k and substring_distance(decontaminate.normalised(item), decontaminate.normalised(text)) <= int(decontaminate.ERROR_RATE * m):
                want.add((d, k))
    got = decontaminate.hits(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 50


def test_degenerate_items_and_texts_stay_linear():
    import time

    finder = decontaminate.Finder([(1, "a" * 300), (2, "ab" * 100)], decontaminate.ERROR_RATE)
    began = time.process_time()
    assert finder.matches("a" * 100_000) == [(1, 0, 24)]
    assert finder.matches("b" + "a" * 285 + "b") == [(1, 15, 24)]
    assert finder.matches("ab" * 5000)[0] == (2, 0, 16)
    assert time.process_time() - began < 20


def test_blocks_of_items_give_the_same(docs):
    bench = table(docs.sparkSession, SF, "benchmark")
    whole = sorted(map(tuple, decontaminate.hits(docs, bench).collect()))
    assert len(list(decontaminate.blocks(bench, 1500))) > 3
    assert sorted(map(tuple, decontaminate.hits(docs, bench, block_chars=1500).collect())) == whole and whole
    left = {r["doc_id"] for r in decontaminate.keep_clean(docs, bench, block_chars=1500).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {w[0] for w in whole}


def test_short_items_stand_exactly_as_whole_words(spark):
    items = spark.createDataFrame([(1, "what is two plus two?"), (2, "seven"), (3, "Twelve chars"), (4, " "), (5, "a+b")], "item_id int, text string")
    texts = ["so: What is  two plus two? four", "seventh heaven", "it is (seven)", "twelve chars.", "twelve charts", "xa+b", "a+b=c", "whatis two plus two?"]
    got = decontaminate.hits(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 1), (2, 2), (3, 3), (6, 5)} and {r["distance"] for r in got} == {0}


def test_repeated_rows_that_hit(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, item)] * 3 + [(2, "no"), (1, "other text")], "doc_id int, text string")
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id int, text string")
    assert [tuple(r) for r in decontaminate.hits(docs, bench).collect()] == [(1, 7, 0, 3)] * 3
    assert sorted(map(tuple, decontaminate.keep_clean(docs, bench).collect())) == [(1, "other text"), (2, "no")]


# SentencePiece


def test_viterbi_equals_the_library_in_unigram_mode(spark, texts):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(open(pieces.MODEL_PATH.removeprefix("file://"), "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:  # the library sums in single precision; smaller scores keep its sums exact
        p.score = max(p.score, -40_000.0) / 4096
    voc = pieces.Vocabulary([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.normalizer_spec.add_dummy_prefix)
    codec, library = pieces.Codec(voc), sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = lambda ids: sum(codec.unk_score if voc.kinds[i] == pieces.BYTE else voc.scores[i] for i in ids)
    samples = [t[:200] for t in texts.values()] + ["a  b   c", "Ünïcödé ☃ 😀", "\n\n x\ty", "trailing ", " lead", "Zz" * 40]
    for text in samples:
        own, other = codec.encode(text).tolist(), library.encode(text)
        assert own == other or abs(score(own) - score(other)) < 1e-2, text
        assert codec.decode(np.array(own, dtype=np.int32)) == text
    assert sum(codec.encode(t).tolist() == library.encode(t) for t in samples) > 0.9 * len(samples)


def test_viterbi_equals_brute_force():
    voc = pieces.Vocabulary(["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a"], [0, -2.0, -2.5, -3.0, -3.1, -4.9, -1.0, -2.8], [2, 1, 1, 1, 1, 1, 1, 1], True)
    codec = pieces.Codec(voc)
    gain = dict(zip(voc.pieces, voc.scores, strict=True))

    def best(text):
        if not text:
            return 0.0
        found = [gain[text[:n]] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in gain]
        return max(found + ([codec.unk_score + best(text[1:])] if text[0] not in gain else []))

    for text in ["abab", "aabba", "xaby", "ab ba", " a", "b"]:
        ids = codec.encode(text).tolist()
        assert abs(sum(codec.unk_score if i == 0 else voc.scores[i] for i in ids) - best("▁" + text.replace(" ", "▁"))) < 1e-9


def test_tokens_decode_to_the_texts(spark, docs, texts):
    got = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs).select("doc_id", "tokens")).collect()}
    assert got == texts


# Language, toxicity, quality


def test_language_on_held_out_rows(spark):
    docs = table(spark, BIG, "documents")
    held = [r for r in language.query(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect() if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held) and len(held) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_kernel_equals_counting():
    texts = ["Der Hund, der Hund!", "the dog 12 the cat", "é è 中文 한국어", "", "中文字 漢字 𠀀𠀁"]
    model = language.learn([language.grams(t) for t in texts[:3]], ["de", "en", "fr"], 3)

    def grams(text, p):
        ids = "".join(c if c.isalpha() else " " for c in text.lower())
        ids = " " + " ".join(ids.split()) + " " if ids.split() else ""
        return {ids[i : i + p] for i in range(len(ids) - p + 1)} if ids else set()

    for i, text in enumerate(texts):
        for j in range(3):
            want = 0.0
            for p in language.ORDERS:
                a, b = grams(text, p), grams(texts[j], p)
                want += len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) / 3
            assert abs(model.kernel([language.grams(t) for t in texts])[i, j] - want) < 1e-5, (text, texts[j])


def test_long_texts_and_many_columns_are_taken_in_parts(monkeypatch):
    model = language.learn([language.grams("ab ba abba"), language.grams("xy yx xyxy")], ["l", "r"], 2)
    text = "ab ba xy " * 50 + "zz" + " " * 70 + "a"
    want = model.kernel([language.grams(t) for t in (text, "x")])
    monkeypatch.setattr(language, "WINDOW", 16)
    monkeypatch.setattr(language, "BLOCK", 3)
    assert np.allclose(model.kernel([language.grams(t) for t in (text, "x")]), want)


def test_many_languages_and_scripts(spark):
    """120 made-up languages, one with a single row, and two pairs that only whole characters tell apart."""
    rng, rows = random.Random(3), []
    letters = [chr(c) for c in range(0x4E00, 0x9000)] + [chr(c) for c in range(0xAC00, 0xD000)]
    for k in range(120):
        own = [chr(c) for c in range(0xAC00 + 300 * k, 0xAC00 + 300 * k + 40)] if k < 20 else rng.sample(letters, 60)
        for _ in range(1 if k == 119 else 8):
            rows.append((len(rows), " ".join("".join(rng.choice(own) for _ in range(rng.randint(2, 5))) for _ in range(30)), f"x{k:03d}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    seen = {r[2] for r in rows if crc32(str(r[0]).encode()) % 3 != 1}
    got = [r for r in got if r["lang"] in seen]
    assert len(seen) > 110 and sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)


def test_sample_is_bounded_and_takes_from_each_language(spark):
    rows = [(i, f"t{i}", "en") for i in range(3000)] + [(7, "t7", "en")] * 2000 + [(9001 + i, "r", "rare") for i in range(3)]
    got = language.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 200).groupBy("lang").count().collect()
    n = {r["lang"]: r["count"] for r in got}
    assert 90 <= n["en"] <= 100 and 1 <= n["rare"] <= 3


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    held = [r for r in toxicity.query(docs, labels).join(labels, "doc_id").collect() if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)
    assert all(r["predicted"] == 0 for r in held if r["toxic"] == 0)


def test_patterns_of_clauses():
    scorer = toxicity.Scorer({"foul*": 4.0})
    score = lambda t: [x for c in scorer.patterns(t) for x in c]
    assert score("what an idiot") == [("named", 3.0)]
    assert score("you are an idiot") == [("addressed", 4.5)] == score("idiot, that is what you are")
    assert score("he is not an idiot") == [("softened", 2.25)]
    assert score("it was not idiot") == [("softened", 1.5)]
    assert score("she said that was an idiot thing")[0][0] == "softened"
    assert score("idiot, he wrote")[0][0] == "softened"
    assert score("i will hurt you") == [("threat", 3.0)] == score("you i will hurt")
    assert score("i hurt my knee") == []  # a threat with no target is no pattern
    assert score("a foulness of words") == [("named", 4.0)]
    assert score("deep into the trash with it") == [] == score("the trash, collected on monday, is full")  # no pattern holds the word
    assert score("soon the trash goes out. two weeks later. the scum comes in here") == [("named", 3.0)] * 2  # heaped over clauses
    assert score("soon the trash goes out. one. two. three. four. five. six. the scum comes in here") == []
    assert score("idiot") == score("away idiot") == score("idiot go") == [("named", 3.0)]  # short clauses


def test_documents_score_by_clauses():
    f = lambda t: dict(zip(toxicity.FEATURES, np.expm1(toxicity.Scorer({}).features(t)).round(6).tolist(), strict=True))
    assert not any(f("a clean text").values()) and not any(f(None).values()) and not any(f("we took the trash out on monday").values())
    assert f("an idiot. a moron")["named"] == 6.0 and f("an idiot. a moron")["best"] == 3.0
    assert f("not here. you trash")["addressed"] == 4.5  # a break ends the scope


def test_words_alone_do_not_decide(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(model.lexicon)
    p = lambda t: model.probability(scorer.features(t))
    for text in ("we took the trash out on monday", "into the filth with it", "he is not an idiot", "into the bin goes the trash of monday", "in the loser bracket of the cup"):
        assert p(text) < 0.5, text
    assert p("we took the trash out on monday") == p("")
    assert p("you are trash") > 0.5 and p("trash, that is what you are") > 0.5 and p("idiot. moron. what a clown") > 0.5
    rows = docs.join(labels.where("toxic IS NOT NULL"), "doc_id").select("doc_id", "text", "toxic").collect()
    scored = [(p(r["text"]), r["toxic"], sum(map(len, scorer.patterns((r["text"] or "").lower())))) for r in rows]
    assert all(n for s, _, n in scored if s >= 0.5)  # no verdict without a matched clause
    held = [(s, y) for (s, y, _), r in zip(scored, rows, strict=True) if crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.93 and sum(s >= 0.5 for s in good) >= 0.85 * len(good) and sum(s >= 0.5 for s in bad) <= 0.01 * len(bad)


def test_scores_by_plain_loops():
    """Windows and distances instead of machines, on texts of all classes."""
    rng = random.Random(21)
    scorer = toxicity.Scorer({})
    words = {"insult": ["idiot", "trash"], "threat": ["hurt"], "target": ["you"], "negation": ["not"], "report": ["said"], "link": ["is", "a"], "other": ["tree", "walks", "blue", "sky"]}
    kind_of = {w: k for k, ws in words.items() for w in ws}

    def plain(clauses):
        sums, best = dict.fromkeys(toxicity.FEATURES[:-1], 0.0), 0.0
        bad = [[i for i, w in enumerate(c) if kind_of[w] == "insult"] for c in clauses]
        for k, clause in enumerate(clauses):
            kinds, total = [kind_of[w] for w in clause], 0.0
            last = lambda name, i: next((i - j for j in range(i - 1, -1, -1) if kinds[j] == name), 99)  # noqa: B023, E731
            following = lambda name, i: next((j - i for j in range(i + 1, len(kinds)) if kinds[j] == name), 99)  # noqa: B023, E731
            for i, kind in enumerate(kinds):
                if kind not in ("insult", "threat"):
                    continue
                weight = 3.0 if kind == "insult" else 2.0
                aimed = last("target", i) <= 5 or following("target", i) <= 5
                negated = last("negation", i) <= 3
                reported = last("report", i) <= 8 or following("report", i) <= 8
                weight *= 1.5 if aimed else 1.0
                weight *= 0.5 if negated or reported else 1.0
                if kind == "threat":
                    name = None if not aimed else "softened" if negated or reported else "threat"
                elif negated or reported:
                    name = "softened"
                elif aimed:
                    name = "addressed"
                else:
                    near = any(bad[j] and (j != k or len(bad[k]) > 1) for j in range(max(0, k - 5), min(len(clauses), k + 6)))
                    name = "named" if last("link", i) <= 3 or max(i, len(kinds) - 1 - i) <= 1 or near else None
                if name:
                    sums[name] += weight
                    total += weight if name != "softened" else 0.0
            best = max(best, total)
        return [*sums.values(), best]

    for _ in range(1500):
        clauses = [[rng.choice(words[rng.choice([*words, "other", "other", "other", "other"])]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 14))]
        text = ". ".join(" ".join(c) for c in clauses)
        assert np.allclose(np.expm1(scorer.features(text)), plain(clauses)), text


def test_composition_runs_both_machines():
    for whole, symbols in zip(toxicity.grammar(), (toxicity.CLASSES, toxicity.MARKED), strict=True):
        assert {s for s, _ in whole.arcs} == set(whole.rest)
        assert all((s, c) in whole.arcs for s in whole.rest for c in symbols)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    held = [r for r in quality.query(docs, labels).join(labels, "doc_id").collect() if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)


def test_ftrl_separates():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.integers(0, 2))
        at = np.sort(rng.choice(np.arange(1, 50), 5, replace=False)) if y else np.sort(rng.choice(np.arange(51, 100), 5, replace=False))
        rows.append((at, np.ones(5) / 5, y))
    w = quality.train(iter(rows))
    assert all((w[quality.BIAS] + w[at] @ x > 0) == bool(y) for at, x, y in rows) and not w[200 : quality.BIAS].any()


def test_ftrl_equals_a_plain_loop():
    import math

    rng = random.Random(4)
    rows = [(sorted(rng.sample(range(30), 4)), [rng.random() for _ in range(4)], rng.randint(0, 1)) for _ in range(40)]
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(ni)) / quality.ALPHA + quality.L2)

    ones = sum(y for _, _, y in rows)
    for _ in range(3):
        for at, x, y in rows:
            pairs = [*zip(at, x, strict=True), (quality.BIAS, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v * len(rows) / (2 * (ones if y else len(rows) - ones))
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality.train(((np.array(at), np.array(x), y) for at, x, y in rows), 3)
    assert all(abs(got[i] - weight(i)) < 1e-5 for i in [*range(30), quality.BIAS])


def test_samples_are_bounded_in_rows(spark):
    from ledgerline.llm.common import labelled, sample_texts

    docs = spark.createDataFrame([(1, "hot")] * 20_000 + [(1, "another")] + [(i, f"t{i}") for i in range(2, 3000)], "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 3000)] + [(1, 1)] * 50 + [(5, 0), (5, 1)], "doc_id bigint, quality int")
    got = labelled(docs, labels, "quality", 4, 2, 10_000).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == sum(crc32(str(i).encode()) % 4 != 2 for i in range(1, 3000) if i != 5)
    assert 450 <= labelled(docs, labels, "quality", 4, 2, 500).count() <= 500
    assert sample_texts(docs, 100).count() == 100


# Licences, token counts


def licences_by_hand(text):
    """All runs of words against all templates."""
    grams, out = licenses.bigrams(text), {}
    for name, all_texts in licenses.TEMPLATES.items():
        for b in map(set, map(licenses.bigrams, all_texts)):
            for i in range(len(grams)):
                seen = set()
                for j in range(i, len(grams)):
                    seen.add(grams[j])
                    if len(seen) > 1.6 * len(b):
                        break
                    dice = 2 * len(seen & b) / (len(seen) + len(b)) if grams[i] in b and grams[j] in b else 0
                    if dice >= licenses.THRESHOLD:
                        out[name] = max(out.get(name, 0), dice)
    return out


def test_bounds_and_starts_lose_no_match(texts):
    rng = random.Random(1)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    isc = licenses.TEMPLATES["ISC"][0].split()
    samples = [" ".join(t.split(" ")[:60]) for t in list(texts.values())[:60]]
    samples += [" ".join(w for w in isc if rng.random() > p) for p in (0.0, 0.03, 0.1, 0.3)] + ["All rights reserved. " * 30, "licensed under cc by 4.0 under cc by nc 4.0 licensed"]
    for text in samples:
        assert scanner.matches(text) == licences_by_hand(text)
    assert "ISC" in scanner.matches(samples[60])


def test_recall_on_notices_inside_long_files():
    """Each template, its words changed here and there, broken into lines and paragraphs and set between functions."""
    rng = random.Random(6)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    code = "\n".join(f"def f{i}(x):\n    return x * {i}\n" for i in range(100))
    found = total = 0
    for name, all_texts in licenses.TEMPLATES.items():
        for words in (t.split() for t in all_texts if len(t.split()) >= 20):
            for _ in range(3):
                own = [w if rng.random() > 0.03 else "changed" for w in words]
                notice = "".join(w + rng.choice([" "] * 8 + ["\n", "\n# ", "\n\n"]) for w in own)
                found += name in scanner.matches(f"{code}\n{notice}\n{code}")
                total += 1
    assert total > 50 and found >= 0.95 * total
    assert scanner.matches(code) == {}


def test_counts_equal_encoding(docs, texts):
    ranks = open(token_counts.RANKS_PATH.removeprefix("file://"), "rb").read()
    want = {d: len(token_counts.token_ids(ranks, t)) for d, t in texts.items()}
    for block_ids in (64, 1000, token_counts.BLOCK_IDS):
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs.repartition(3), block_ids=block_ids).collect()} == want


def test_scan_of_stored_files(spark, tmp_path):
    rng, want = np.random.default_rng(0), {}
    for f in range(3):
        lengths = [int(x) for x in rng.integers(0, 40, 30)] + [5]
        ids = np.concatenate([np.append(rng.integers(0, 1000, n), token_counts.END) for n in lengths])[:-1].astype("<u2")
        ids.tofile(tmp_path / f"f{f}.bin")
        want[f"f{f}.bin"] = lengths
    (tmp_path / "f9.bin").write_bytes(b"")
    for block_ids, level in ((7, 2), (64, 3), (100_000, 1024)):
        got = token_counts.separator_scan(token_counts.read_flat(spark, str(tmp_path), block_ids), level=level).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r["file"], r["ordinal"])):
            by.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["n_tokens"])
        assert by == want


# Line chunks


def lines_by_hand(rows):
    """(doc_id, text) with distinct ids -> what each text keeps."""
    import hashlib

    docs, first, keys = {}, {}, []
    for d, text in sorted(rows):
        own = [(at, x) for at, x in enumerate(text.split("\n")) if x.strip(rules.BLANKS)]
        m = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for _, x in own]
        n = [len(x.encode().split()) for _, x in own]
        r = [m[i] * 31 + (m[i - 1] if i else 0) for i in range(len(own))]
        starts = [i for i in range(1, len(own)) if r[i] < r[i - 1] or n[i] + n[i - 1] > 50]
        docs[d] = (text.split("\n"), own, starts)
        for k, i in enumerate(starts):
            lo, hi = starts[k - 2] if k > 1 else 0, starts[k + 1] if k + 1 < len(starts) else len(own)
            keys.append((d, i, (own[i - 1][1], own[i][1]), lo, hi))
        keys += [(d, i, own[i][1], i, i + 1) for i in range(len(own)) if n[i] > 50]
    gone = {d: set() for d in docs}
    for d, i, key, lo, hi in sorted(keys, key=lambda k: k[:2]):
        d0, i0, lo0, hi0 = first.setdefault(key, (d, i, lo, hi))
        if (d0, i0) == (d, i):
            continue
        a, b, back, on = docs[d][1], docs[d0][1], 0, 0
        while i - back > lo and i0 - back > lo0 and a[i - back - 1][1] == b[i0 - back - 1][1]:
            back += 1
        while i + on < hi and i0 + on < hi0 and a[i + on][1] == b[i0 + on][1]:
            on += 1
        if back + on >= 2 or isinstance(key, str):
            gone[d] |= set(range(i - back, i + on))
    out = {}
    for d, (lines, own, _) in docs.items():
        drop = {own[k][0] for k in gone[d]} | {at for k in gone[d] if k + 1 in gone[d] for at in range(own[k][0], own[k + 1][0])}
        out[d] = "\n".join(x for at, x in enumerate(lines) if at not in drop)
    return out


def kept_lines(spark, rows):
    return {r["doc_id"]: r["text"] for r in line_chunks.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}


def test_repeated_runs_go_but_for_the_first(spark):
    rng = random.Random(5)
    line = lambda: rng.choice(["", "x", "xx y", "z\\1", "a b c", "é", "$1", " \t", "w " * 30]) + str(rng.randint(0, 3))
    shared = [[line() + "!" for _ in range(8)] for _ in range(3)]
    rows = []
    for d in range(60):
        body = [line() for _ in range(rng.randint(0, 6))] + rng.choice(shared) * rng.randint(0, 2) + [rng.choice(["", line(), " "]) for _ in range(rng.randint(0, 6))]
        rows.append((d, "\n".join(body)))
    rng.shuffle(rows)
    want = lines_by_hand(rows)
    assert kept_lines(spark, rows) == want and any(want[d] != t for d, t in rows)


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_recall_on_planted_passages(spark):
    """Passages of k lines between other lines: the later copy's lines go, nothing else does."""
    rng, rows, planted = random.Random(8), [], []
    for k in (2, 3, 4, 5, 6, 8, 12):
        for _ in range(40):
            passage = [words_of(rng, rng.randint(3, 12)) for _ in range(k)]
            for copy in range(2):
                sides = [[words_of(rng, rng.randint(3, 12)) for _ in range(rng.randint(2, 9))] for _ in range(2)]
                planted.append((len(rows), k, copy, sides, passage))
                rows.append((len(rows), "\n".join([*sides[0], *passage, *sides[1]])))
    got, gone, there = kept_lines(spark, rows), Counter(), Counter()
    for d, k, copy, (a, b), passage in planted:
        left = got[d].split("\n")
        assert left[: len(a)] == a and left[-len(b) :] == b and (copy or left == [*a, *passage, *b])
        if copy:
            gone[k], there[k] = gone[k] + k - sum(x in set(left) for x in passage), there[k] + k
    assert all(gone[k] >= (0.97 if k >= 5 else 0.75 if k >= 3 else 0.2) * there[k] for k in there), {k: gone[k] / there[k] for k in there}


def test_passages_of_over_fifty_words_go_but_for_the_first(spark):
    rng = random.Random(11)
    w = lambda n: words_of(rng, n)
    shared = [[w(52 + rng.randint(0, 20)) for _ in range(n)] for n in (1, 2, 3, 4, 5)] + [[w(40), "", w(11)], [w(60), w(3)], [w(3), w(60)], [w(30), w(30), " ", w(30)]]
    rows, want = [], {}
    for d in range(60):
        before, after = [w(rng.randint(3, 30)) for _ in range(rng.randint(1, 4))], [w(rng.randint(3, 30)) for _ in range(rng.randint(1, 4))]
        rows.append((d, "\n".join([*before, *shared[d % len(shared)], *after])))
        want[d] = "\n".join([*before, *(shared[d % len(shared)] if d < len(shared) else []), *after])
    assert kept_lines(spark, rows) == want


def test_insertions_move_no_other_boundary(spark):
    rng = random.Random(2)
    lines = [words_of(rng, 4) for _ in range(300)]
    got = kept_lines(spark, [(1, "\n".join(lines)), (2, "\n".join(["new line here", *lines[:150], "another new one", *lines[150:]]))])
    assert got[2] == "new line here\nanother new one"


def test_texts_of_very_many_lines_stay_linear(spark):
    import time

    n = 100_000
    rows = [(1, "\n".join(f"line {i}" for i in range(n))), (2, "\n".join(f"line {i}" for i in range(5, n))), (3, "same\n" * n)]
    began = time.time()
    got = {r["doc_id"]: r for r in line_chunks.query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["n_removed_lines"] == 0 and got[2]["n_removed_lines"] > n - 20 and time.time() - began < 120


def test_clashing_hashes_are_decided_on_bytes(spark, monkeypatch):
    rng = random.Random(3)
    shared = [words_of(rng, 3) for _ in range(6)]
    rows = [(d, "\n".join([words_of(rng, 3), *shared, *(words_of(rng, 3) for _ in range(3))])) for d in range(6)]
    df, own, seeds = spark.createDataFrame(rows, "doc_id bigint, text string"), line_chunks._identity, []
    want = sorted(map(tuple, line_chunks.dedup(df).collect()))

    def clash(line, seed):
        seeds.append(seed)
        return F.lit(7).cast("long") if seed == 0 else own(line, seed)

    monkeypatch.setattr(line_chunks, "_identity", clash)
    assert sorted(map(tuple, line_chunks.dedup(df).collect())) == want and set(seeds) == {0, 1} and want != sorted(rows)


def test_string_ids_and_several_texts_under_one(spark):
    rng = random.Random(4)
    a, b = "\n".join(words_of(rng, 5) for _ in range(8)), "\n".join(words_of(rng, 5) for _ in range(8))
    rows = [("x", a), ("x", a), ("x", b), ("y", a + "\nmore words"), (None, a), ("z", None)]
    got = sorted(map(str, map(tuple, line_chunks.dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect())))
    assert got == sorted(map(str, [("x", a), ("x", a), ("x", b), ("y", "more words"), (None, a), ("z", None)]))


# Quality rules


def repeat_words_by_hand(words):
    times = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if times[g] > 1 for k in range(3)})


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t\x0b é#|!", max_size=120))
def test_facts_equal_counting(text):
    import re

    f, words = rules.Facts(text), re.findall(r"[^\x20\x09-\x0D]+", text)
    assert f.n_words == len(words) and f.word_chars == sum(map(len, words))
    assert f.n_symbols == sum(c in "#*$%&|<>" for c in text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert f.n_dup_lines == len(lines) - len(set(lines))
    assert f.n_repeat_words == repeat_words_by_hand(words)


def test_order_follows_rejection_per_cost_and_spares_the_verdict(spark, docs):
    figures = [("few_words", 1.0, 0.5), ("symbols", 0.1, 0.2), ("shouting", 0.1, 0.0)]
    assert [r.name for r in rules.ordered(figures)[:3]] == ["symbols", "few_words", "shouting"]
    kept = {r["doc_id"] for r in rules.keep(docs).collect()}
    assert kept == {r["doc_id"] for r in rules.cascade(docs).collect() if r["kept"]}
    assert {n for n, _, _ in rules.measure(docs.limit(50))} == {r.name for r in rules.RULES}


# SimHash


def fingerprint_by_hand(text, k=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=100, deadline=None)
@given(st.text("abcAÀé \n ", max_size=60))
def test_fingerprints_equal_counting(text):
    assert simhash.fingerprint(text) % 2**64 == fingerprint_by_hand(text)


def groups_by_hand(prints):
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    return {f: root(f) for f in parent}


def test_links_and_components_equal_all_pairs(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for f in list(prints):
        for _ in range(rng.randint(0, 12)):  # chains and clusters
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            prints.add(f)
    signed = lambda f: f - 2**64 if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in prints], "fp bigint")
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2}
    for fields in (simhash.THREE, simhash.TWO):
        edges = simhash.links(nodes, fields=fields)
        got = [tuple(r) for r in edges.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    by_hand = groups_by_hand(prints)
    least = {}
    for f, r in by_hand.items():
        least[r] = min(least.get(r, 2**63), signed(f))
    assert all(roots.get(signed(f), signed(f)) == least[r] for f, r in by_hand.items())


def test_documents_get_the_smallest_id_they_reach(spark, docs, texts):
    prints = {d: fingerprint_by_hand(t) for d, t in texts.items()}
    roots, least = groups_by_hand(set(prints.values())), {}
    for d, f in prints.items():
        least[roots[f]] = min(least.get(roots[f], d), d)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(docs).collect()}
    assert got == {d: (f"{f:016x}", least[roots[f]]) for d, f in prints.items()}


def test_very_many_fingerprints_give_the_same(docs, monkeypatch):
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "MANY", 0)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_a_hub_is_dealt_over_tasks(spark):
    """A star: no task of a round may read a share of the links that grows with the hub."""
    n = 100_000
    edges = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(simhash.SALTS)))
    dealt = both.repartition(64, "u", "salt").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt < n / 8
    got = simhash.components(edges)
    assert got.where("root <> 0").count() == 0 and got.count() == n + 1


def test_one_of_each_group_stays_and_no_other_text_goes(spark):
    t, other = "some words that make one text of their own", "a wholly different text under the same id, not like it"
    docs = spark.createDataFrame([(1, t), (5, t), (5, other), (1, t), (1, t.upper()), (None, t), (7, None), (8, "")], "doc_id bigint, text string")
    for stay in (simhash.keep_one(docs), minhash.keep_one(simhash.keep_one(docs))):
        got = sorted(map(str, map(tuple, stay.collect())))
        # of the two spellings under id 1 the smaller md5 stays, with its repeated rows
        kept = min((t, t.upper()), key=lambda x: md5(x.encode()).hexdigest())
        assert got == sorted(map(str, [(1, kept)] * (2 if kept == t else 1) + [(5, other), (None, t), (7, None)]))


@pytest.mark.parametrize("fields", [simhash.TWO, simhash.THREE])
def test_covering_radius_and_reach(fields):
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**63), 2**63 - 1, size=300)
    row, home = simhash.anchors(x, 0, fields)
    assert sorted(row) == list(range(300))
    for bits in (1, 2):
        y = x.copy()
        for i in range(300):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.array(1 << int(b), dtype=np.uint64).view(np.int64)
        r, a = simhash.anchors(y, 2, fields)
        reached = set(zip(r.tolist(), a.tolist(), strict=True))
        assert all((i, h) in reached for i, h in zip(row.tolist(), home.tolist(), strict=True))


# Pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents")
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    scores = {r["doc_id"]: r["score"] for r in toxicity.query(docs, labels).collect()}
    kept = cp.toxic_out(spark, docs, SF)
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(rows) == {d for d, s in scores.items() if s < 0.5}

    want = lines_by_hand(rows.items())
    lined = cp.repeated_lines_out(spark, kept, SF)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in lined.collect()} == {d: (t, len(t)) for d, t in want.items()}

    prints = {d: fingerprint_by_hand(t) for d, t in want.items()}
    roots, least = groups_by_hand(set(prints.values())), {}
    for d, f in prints.items():
        least[roots[f]] = min(least.get(roots[f], d), d)
    single = cp.near_duplicates_out(spark, lined, SF)
    assert {r["doc_id"] for r in single.collect()} == set(least.values())

    clean = cp.benchmark_out(spark, single, SF)
    items = [decontaminate.normalised(r["text"]) for r in bench.collect()]
    dirty = {d for d in least.values() if any(i in decontaminate.normalised(want[d]) for i in items)}
    got = {r["doc_id"] for r in clean.collect()}
    assert not got & dirty and got | {r["doc_id"] for r in decontaminate.hits(single, bench).collect()} == set(least.values())

    tokens = cp.encoded(spark, clean, SF).collect()
    assert {r["doc_id"] for r in tokens} == got and all(r["round_trip"] and len(r["tokens"]) == r["n_tokens"] for r in tokens)


def test_run_is_the_stages_in_order(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert cp.run(spark, SF).count() > 100


def test_sql_of_the_operators_that_have_it(spark):
    import duckdb

    from ledgerline.llm import registry

    c = duckdb.connect()
    for name in ("documents", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df, want = registry.queries()[name](spark, SF), c.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        key = lambda rows, names: sorted(tuple(map(str, (r[names.index(x)] for x in cols))) for r in rows)
        assert key([tuple(r) for r in df.collect()], df.columns) == key(want.fetchall(), want.columns), name


def test_scratch_tables_can_be_cleared(spark, docs):
    from pathlib import Path

    from ledgerline.llm import common

    with common.cleared(spark):
        kept = common.cut(docs.limit(3), "some-table")
        path = Path(common._written[-1].removeprefix("file://").removeprefix("file:"))
        assert kept.count() == 3 and path.is_dir()
    assert not path.exists()


def test_a_fingerprint_of_very_many_documents_is_dealt_over_tasks(spark, monkeypatch):
    from ledgerline.operators import skew

    rows = [(i, "") for i in range(50)] + [(100 + i, f"text number {i} of its own kind {i}") for i in range(20)] + [(7, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(str, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(skew, "BIG", 10)
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == want and len(want) == len(rows)
