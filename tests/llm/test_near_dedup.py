from itertools import combinations

import numpy as np
import pytest

from covergraph.llm import near_dedup as N


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    parent = {k: k for k, _ in rows}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for (a, s), (b, t) in combinations([(k, t) for k, t in rows], 2):
        x, y = shingles(s), shingles(t)
        if s == t or x and y and len(x & y) >= 0.8 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {k: find(k) for k, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_classes_equal_brute_force(spark, plain, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(8):
        base = rng.choice(vocabulary, int(rng.integers(3, 150))).tolist()
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for k in rng.integers(0, len(copy), int(rng.integers(0, 5))):
                copy[k] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], plain)
    got = {r.doc_id: r.class_id for r in N.near_classes(docs).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in N.keep_first(docs).collect()}
    assert kept == set(got.values())


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 2**60, 60).astype(np.uint64), rng.integers(1, 2**60, 20).astype(np.uint64)
    x, y = np.concatenate([a, b[:10]]), np.concatenate([a, b[10:]])
    wx, wy = rng.integers(1, 4, len(x)).astype(float), rng.integers(1, 4, len(y)).astype(float)
    s = N.prob_minhash(np.concatenate([x, y]), np.concatenate([wx, wy]), np.repeat([0, 1], [len(x), len(y)]), 2, 4096)
    u, v = dict(zip(x.tolist(), wx)), dict(zip(y.tolist(), wy))
    every = set(u) | set(v)
    want = sum(1 / sum(max(u.get(e, 0) / u[d], v.get(e, 0) / v[d]) for e in every) for d in set(u) & set(v))
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_odd_rows(spark, odd, plain):
    got = [(r.doc_id, r.copy_of, r.class_id) for r in N.near_classes(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1), (2, 2, 2), (3, 3, 3), (3, 3, 3), (4, 4, 4), (None, None, None), (5, 5, 5), (6, 6, 6), (7, 4, 4)], key=str)
    kept = N.keep_first(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 5, 6], key=str)
    assert N.near_classes(spark.createDataFrame([], plain)).count() == 0
    assert N.keep_first(spark.createDataFrame([], plain)).count() == 0


def test_large_group_of_copies(spark, plain):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text if i % 2 else f"{text} tail{i % 7}", "en", "a", 1) for i in range(400)]
    got = N.near_classes(spark.createDataFrame(rows, plain)).collect()
    assert {r.class_id for r in got} == {0}


def test_sketches_keep_short_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, (n, own) in enumerate([(4, (0, 1)), (8, (0, 2)), (8, (1, 1)), (16, (2, 2))] * 250):
        # The second text has the n shingles of the first, some of them exchanged: Jaccard 0.8.
        words = rng.integers(-(2**31), 2**31, n + sum(own)).tolist()
        rows += [(2 * i, words[: n + own[0]]), (2 * i + 1, words[:n] + words[n + own[0] :])]
    got = {r.id: np.array(r.sketch, dtype=np.int64) for r in N._sketches(spark.createDataFrame(rows, "id long, set array<int>")).collect()}
    differ = [int(np.bitwise_count((got[2 * i] ^ got[2 * i + 1]).view(np.uint64)).sum()) for i in range(1000)]
    assert max(differ) <= N.most_different_bits(0.8)


def test_short_texts_in_buckets_of_another_leader(spark, plain):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(60):
        word = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
        base = word(int(rng.integers(8, 31)))
        # Three alike lead the buckets; a text with another end is not similar to them but has a near copy of its own.
        texts += [base, [*base, *word(1)], [*base, *word(1)]]
        other = [*base[: len(base) * 5 // 6], *word(3)]
        texts += [other, [*other, *word(1)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], plain)
    assert {r.doc_id: r.class_id for r in N.near_classes(docs).collect()} == brute(rows)


def test_copies_that_repeat_a_line_more_often(spark, plain):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(12):
        body, line = ([f"u{x}" for x in rng.integers(0, 10**6, n)] for n in (200, 12))
        rows += [(2 * i, " ".join(body + line * 100)), (2 * i + 1, " ".join(body + line * (5 if i % 2 else 1)))]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], plain)
    got = {r.doc_id: r.class_id for r in N.near_classes(docs).collect()}
    assert got == brute(rows) and len(set(got.values())) < 24


def test_texts_under_one_id_stay_apart(spark, plain):
    base = [f"w{i}" for i in range(60)]
    join = " ".join
    rows = [(1, join(base)), (1, "quite another text than the first one"), (2, join([*base, "x"])), (2, "quite another text than the first one"), (3, join(base[:58])), (3, join(base[:58])), (3, join([*base[:58], "y"]))]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], plain)
    assert sorted((r.doc_id, r.copy_of, r.class_id) for r in N.near_classes(docs).collect()) == sorted([(1, 1, 1), (1, 1, 1), (2, 2, 1), (2, 1, 1), (3, 3, 1), (3, 3, 1), (3, 3, 1)])
    assert sorted((r.doc_id, r.text) for r in N.keep_first(docs).collect()) == sorted(rows[:2])
    alone = spark.createDataFrame([(4, join(base), "en", "a", 1), (4, join([*base, "z"]), "en", "a", 1)], plain)
    assert N.keep_first(alone).count() == 1
