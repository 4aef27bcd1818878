"""Near copies of five-word Jaccard 0.8 or more on the pipeline's near-dedup stage."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from ledgerline.llm import minhash

STAGE = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]


def jaccard_by_hand(x, y):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split(), y.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_planted_near_copies_go_and_others_stay(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near, far = [], [], []
    for d in range(60):
        own = [word() for _ in range(rng.randint(60, 400))]
        copy = list(own)
        for i in rng.sample(range(len(copy)), len(copy) // (100 if d % 2 else 12)):
            copy[i] = word()
        rows += [(d, " ".join(own)), (1000 + d, " ".join(copy).upper())]
        (near if jaccard_by_hand(rows[-2][1], rows[-1][1]) >= 0.8 else far).append(1000 + d)
    got = {r["doc_id"] for r in STAGE(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()}
    assert len(near) > 20 and len(far) > 20
    assert got == set(range(60)) | set(far)


def test_jaccard_of_hashes_is_that_of_shingles():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for x, y in combinations(texts, 2):
        assert minhash.jaccard(minhash.shingles(x), minhash.shingles(y)) == jaccard_by_hand(x, y) or min(len(x.split()), len(y.split())) < 5
    assert minhash.buckets("") == minhash.buckets(" \n") == minhash.buckets(None) == (0, [])


def test_large_groups_and_missing_values(spark):
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(200)]
    rows = [(d, " ".join([*base[:50], str(rng.random()), *base[51:]])) for d in range(100)] + [(500, None), (501, ""), (502, " "), (None, " ".join(base)), (503, "two words"), (504, "two words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    shared = minhash._at_buckets(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"))
    heads = minhash.head_pairs(shared)
    assert 99 <= heads.count() <= 20 * 100  # a pair for each bucket of a text at most, not all 4950
    assert minhash.left_pairs(docs, shared, minhash.components(heads)).count() == 0  # they are in one component
    assert sorted(map(str, (r[0] for r in minhash.keep_one(docs).collect()))) == sorted(["0", "500", "501", "502", "503", "None"])


def test_copies_of_one_text_that_are_too_far_from_each_other_go(spark):
    """Each copy is within 0.8 of the original, which is not the smallest, and not of the other copies."""
    rng = random.Random(10)
    rows, originals = [], set()
    for g in range(30):
        base = [str(rng.random()) for _ in range(100)]
        own = [(10 * g + i, list(base)) for i in range(4)]
        for _, words in own[:3]:
            for at in rng.sample(range(0, 100, 10), 2):
                words[at] = str(rng.random())
        assert all(jaccard_by_hand(" ".join(own[3][1]), " ".join(w)) >= 0.8 for _, w in own[:3])
        rows += [(d, " ".join(w)) for d, w in own]
        originals.add(10 * g)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r[0] for r in minhash.keep_one(docs).collect()} == originals


def test_a_text_with_very_many_pairs_is_dealt_over_tasks(spark):
    """Pairs of a hub keep their texts on either side, and none is lost or doubled."""
    rng = random.Random(11)
    base = [str(rng.random()) for _ in range(100)]
    docs = spark.createDataFrame([(d, " ".join([*base[:50], str(d), *base[51:]])) for d in range(300)] + [(0, " ".join([*base[:50], "0", *base[51:]]))], "doc_id bigint, text string")
    found = minhash.links(docs)
    assert found.count() == found.distinct().count() <= 20 * 300
    assert len({r[0] for r in found.select("a").union(found.select("b")).collect()}) == 300
    assert [r[0] for r in minhash.keep_one(docs).collect()] == [0, 0]


@pytest.mark.parametrize("n", [10, 50, 200, 400])
def test_one_of_many_copies_that_only_the_original_is_near_to_stays(spark, n):
    """Copies have a Jaccard of 0.815 with the original, and less than 0.8 with each other."""
    rng = random.Random(n)
    base = [str(rng.random()) for _ in range(200)]
    rows = [(n + 5, " ".join(base))]
    for d in range(n):
        copy = list(base)
        for at in rng.sample(range(4, 196, 8), 4):
            copy[at] = str(rng.random())
        rows.append((d, " ".join(copy)))
    assert all(0.8 <= jaccard_by_hand(rows[0][1], t) < 0.83 for _, t in rows[1:])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert [r[0] for r in minhash.keep_one(docs).collect()] == [0]


def test_no_pair_of_a_bucket_that_joins_components_is_left_out(spark, monkeypatch):
    """Chains, stars and strangers of one vocabulary: classes are those of all pairs that share a bucket, whatever the tiles and salts."""
    rng = random.Random(12)
    rows = []
    for g in range(12):
        words = [str(rng.random()) for _ in range(80)]
        for i in range(25):
            rows.append((100 * g + i, " ".join(words)))
            words = list(words if i % 3 else [*words[:40], *(str(rng.random()) for _ in range(40))])
            words[rng.randrange(80)] = str(rng.random())
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "BIG", 6)
    sets, at = [set(minhash.shingles(t).tolist()) for _, t in rows], [set(minhash.buckets(t)[1]) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if at[i] & at[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and find(i) != find(j):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(r[0] for r in minhash.keep_one(docs).collect()) == [rows[i][0] for i in range(len(rows)) if parent[i] == i]


def test_sketches_of_long_texts_bound_their_similarity():
    rng = random.Random(13)
    base = [str(rng.random()) for _ in range(6000)]
    copy = list(base)
    for at in rng.sample(range(6000), 100):
        copy[at] = str(rng.random())
    (n, a), (m, b) = minhash.sketch(" ".join(base)), minhash.sketch(" ".join(copy))
    assert n == m == 4 and 256 <= len(a) <= 512
    low, high = len(set(a) & set(b)) / len(set(a) | set(b)), jaccard_by_hand(" ".join(base), " ".join(copy))
    assert abs(low - high) < minhash.MARGIN
    assert minhash.sketch("one two three four five six")[0] == 0 and len(minhash.sketch("one two three four five six")[1]) == 2
