import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from covergraph.llm import induced_sort as I
from covergraph.llm import suffix_dedup as D


def brute_order(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


def shared(t, a, b, depth):
    k = 0
    while k < depth and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
        k += 1
    return k


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 5).flatmap(lambda a: st.lists(st.integers(1, a), max_size=60)), st.sampled_from([2, 8, 1024]), st.sampled_from([100, 1 << 26]))
def test_suffix_order_equals_brute_force(chars, wide, limit):
    t = [*chars, 0]
    before, I.WIDE = I.WIDE, wide
    scratch = I.Scratch(limit)
    try:
        order, common = I.suffix_order(np.array(t), 200, scratch)
    finally:
        scratch.close()
        I.WIDE = before
    assert order.tolist() == brute_order(t)
    assert common.tolist() == [0, *[shared(t, a, b, 200) for a, b in zip(order, order[1:])]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 2), max_size=50), st.integers(1, 5))
def test_order_to_a_depth(chars, depth):
    t = [*chars, 0]
    order, common = I.suffix_order(np.array(t), depth)
    assert sorted(order.tolist()) == list(range(len(t)))
    assert all(t[a : a + depth] <= t[b : b + depth] for a, b in zip(order, order[1:]))
    assert common.tolist()[1:] == [shared(t, a, b, depth) for a, b in zip(order, order[1:])]


def brute(rows, length):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (text or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                mark[i] += 1
                mark[i + length] -= 1
            seen.add(w)
        gone = np.cumsum(mark)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,letters,segment,shard,hot,large", [
    (0, "ab", 1 << 16, 1 << 20, 2000, 8 << 20), (1, "abcdefgh", 200, 300, 2000, 60), (2, "a", 128, 100, 2000, 30), (3, "xyzé", 1 << 16, 500, 3, 100),
])
def test_dedup_equals_brute_force(spark, plain, monkeypatch, seed, letters, segment, shard, hot, large):
    monkeypatch.setattr(D, "LARGE_BYTES", large)
    monkeypatch.setattr(D, "_SEGMENT", segment)
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    monkeypatch.setattr(D, "HOT_SHARE", hot)
    rng = np.random.default_rng(seed)
    passages = ["".join(rng.choice(list(letters), int(rng.integers(10, 120)))) for _ in range(6)]
    rows = []
    for i in range(25):
        parts = [passages[int(rng.integers(6))] if rng.random() < 0.5 else "".join(rng.choice(list(letters), int(rng.integers(0, 60)))) for _ in range(int(rng.integers(0, 6)))]
        rows.append((i, "".join(parts)))
    rows += [(30, rows[3][1]), (31, None), (32, rows[4][1] * 2)]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], plain).repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.digest(docs, length=24).collect()), key=str)
    assert got == brute(rows, 24)


def test_hot_minimizers_are_put_behind(spark, plain):
    line = "a common line of some length"
    rng = np.random.default_rng(0)
    rows = [(i, "".join(rng.choice(list("qwertzuiop"), 60)) + line + "".join(rng.choice(list("qwertzuiop"), 60)), "en", "a", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, plain)
    hot = D._hot(D._named(docs, "doc_id", "text"), 60)
    assert 0 < len(hot) <= D.HOT_SHARE
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.digest(docs, length=60).collect()), key=str)
    assert got == brute([r[:2] for r in rows], 60)


def test_odd_rows_and_removal(spark, odd, plain):
    got = D.digest(odd).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[2].n_bytes == 0 and by[7].n_removed == by[7].n_bytes and by[3].n_removed == 0 and by[4].n_removed > 200_000
    out = D.remove(odd)
    assert out.columns == odd.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[7] == "" and texts[2] is None and texts[3] == "one two three" and hashlib.sha256(texts[4].encode()).hexdigest() == by[4].kept_sha256
    assert D.digest(spark.createDataFrame([], plain)).count() == 0 and D.remove(spark.createDataFrame([], plain)).count() == 0


def test_every_queue_spills(monkeypatch):
    spilled = []
    spill = I.BucketQueue._spill
    monkeypatch.setattr(I.BucketQueue, "_spill", lambda self: (spilled.append(1), spill(self)))
    t = np.append(np.random.default_rng(0).integers(1, 5, 3000), 0)
    scratch = I.Scratch(0)
    try:
        order, common = I.suffix_order(t, 30, scratch)
    finally:
        scratch.close()
    assert spilled and scratch.folder is not None
    plain, same = I.suffix_order(t, 30)
    assert order.tolist() == plain.tolist() and common.tolist() == same.tolist()
