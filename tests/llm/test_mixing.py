from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from covergraph.llm import mixing


def reshared(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by resharing the excess by weight, again and again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free and left > 1e-9:
        total = sum(w[i] for i in free)
        share = {i: target[i] + left * w[i] / total for i in free}
        left = 0.0
        for i, v in share.items():
            cap = most * sizes[i]
            target[i] = min(v, cap)
            left += max(0.0, v - cap)
        free = [i for i in free if target[i] < most * sizes[i] - 1e-9]
    return target


@pytest.mark.parametrize("seed", range(5))
def test_targets_equal_resharing(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.choice([0, 1, 5, 40, 1000, 30_000], int(rng.integers(1, 9)))]
    rows = spark.createDataFrame([(f"0s{i}", s) for i, s in enumerate(sizes)], "key string, size long")
    got = [r.target for r in mixing.source_targets(rows).orderBy("key").collect()]
    assert np.allclose(got, reshared(sizes), atol=1e-6)


def test_taken_words_come_near_targets(spark, plain):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", ["b", "a", None, "é"][i % 4] if i % 3 else "a", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, plain)
    got = mixing.mix(docs).collect()
    assert len(got) == 3000
    for s in ("a", "b", "é", None):
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) < 200
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in own)
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_odd_rows_and_empty_tables(spark, odd, plain):
    got = mixing.mix(odd).collect()
    assert len(got) == 9 and {r.doc_id: r.size for r in got}[2] == 0 and {r.doc_id: r.size for r in got}[3] == 3
    assert mixing.mix(spark.createDataFrame([], plain)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, None, None, None)], plain)).collect()] == [0]


def test_emitted_rows_are_the_copies(spark, odd, plain):
    rows = [(i if i % 9 else None, "w " * (i % 7), "en", ["b", "a", None][i % 3] if i % 2 else "a", i) for i in range(300)] + [(1, "w", "en", "b", 1)] * 4
    docs = spark.createDataFrame(rows, plain)
    for table in (docs, odd):
        want, got = Counter(), Counter()
        for r in mixing.mix(table).collect():
            want[r.doc_id, r.source, r.size] += r.copies
        out = mixing.emit(table)
        for r in out.collect():
            got[r.doc_id, r.source, len((r.text or "").replace("\x0b", " ").replace("\x0c", " ").encode().split())] += 1
        assert out.columns == table.columns and got == +want
    assert mixing.emit(spark.createDataFrame([], plain)).count() == 0
