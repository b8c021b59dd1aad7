import random
import re

import pytest

from covergraph.llm import decontaminate as D

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(doc, items, window):
    hit, found = set(), set()
    for key, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            for j in range(len(doc) - m + 1):
                if doc[j : j + m] == w[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(str(key))
    return sorted(hit), found


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_brute_force(seed):
    rng = random.Random(seed)
    letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
    text = lambda n: " ".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    items = [(i, text(12)) for i in range(rng.randrange(1, 6))]
    window = rng.choice([2, 3, 5])
    machine = D.SuffixAutomaton([(str(k), D.words_of(t.encode())) for k, t in items], window)
    for _ in range(10):
        doc = text(40)
        hit, found = machine.match(D.words_of(doc.encode()))
        assert ([i for i, h in enumerate(hit) if h], found) == brute(words(doc), items, window)


def test_words():
    for t in ("Ab-cDÉ x1_2 y", "\x7f{|}~A", "中文 Z", ""):
        assert [w.decode() for w in D.words_of(t.encode())] == words(t)


def test_shards_give_the_same(spark, odd):
    items = spark.createDataFrame([(1, "one two three"), (2, "many words many words many words many words many words"), (None, "no id"), (3, None), (4, ""), (4, "two three")], "item_id long, text string")
    whole = D.find(odd, items)
    parts = D.find(odd, items, shard_words=1)
    key = lambda df: sorted(str((r.doc_id, r.n_words, list(r.starts), list(r.ends), list(r["items"]))) for r in df.collect())
    assert key(whole) == key(parts) and whole.count() == 9
    assert {r.doc_id: sorted(r["items"]) for r in whole.collect()}[3] == ["1", "4"]


def test_clean(spark, plain):
    item = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{other}. {item.upper()}! {other}", "en", "a", 1), (2, item, "en", "a", 1), (3, other, "en", "a", 1), (4, None, None, None, None)], plain)
    got = {r.doc_id: r.text for r in D.clean(docs, items).collect()}
    assert got == {1: f"{other}. ! {other}", 3: other, 4: None}


def test_empty_tables(spark, odd, plain):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["items"] for r in D.find(odd, none).collect())
    assert D.clean(odd, none).columns == odd.columns and D.clean(odd, none).count() == 9
    assert D.find(spark.createDataFrame([], plain), none).count() == 0


def test_clean_does_not_depend_on_shards(spark, plain):
    w, x = [f"w{i}" for i in range(40)], [f"x{i}" for i in range(60)]
    join = " ".join
    items = [(1, join(w[:15])), (2, join(w[7:22])), (3, join(w[22:34])), (4, join(x[5:10] + x[10:15])), (5, join(x[:5] + x[20:25]))]
    rows = [
        (1, join(x + w[:22] + x)), (2, join(w[:15] + x[30:48] + w[22:34])), (3, join(x[:5] + w[22:34] + x[20:40])),
        (4, join(x[:15] + x[30:60])), (5, join(x[30:60])), (6, None), (7, ""), (1, join(w[22:34] + x[30:60])),
    ]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], plain)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(((r.doc_id, r.text) for r in D.clean(docs, benchmark, shard_words=n).collect()), key=str) for n in (200_000, 40))
    assert parts == whole and 2 not in dict(whole) and len(whole) == 7
    assert not any("w7 " in (t or "") for _, t in parts)


def test_rows_of_one_id_stay_apart(spark, plain):
    items = spark.createDataFrame([(1, "one"), (2, "two"), (3, "red green blue")], "item_id long, text string")
    rows = [(None, "one"), (None, "two"), (None, "six"), (7, "a one"), (7, "two b"), (7, "two b"), (8, "red green red green blue green"), (8, "blue green red two blue one")]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], plain)
    for n in (200_000, 1):
        got = sorted(((r.doc_id, r.n_words, list(zip(r.starts, r.ends)), list(r["items"])) for r in D.find(docs, items, shard_words=n).collect()), key=str)
        want = [
            (None, 1, [(0, 1)], ["1"]), (None, 1, [(0, 1)], ["2"]), (None, 1, [], []), (7, 2, [(1, 2)], ["1"]), (7, 2, [(0, 1)], ["2"]), (7, 2, [(0, 1)], ["2"]),
            (8, 6, [(2, 5)], ["3"]), (8, 6, [(3, 4), (5, 6)], ["1", "2"]),
        ]
        assert got == sorted(want, key=str)


def test_many_runs_and_a_full_filter(spark, plain, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)]
    rows = [(i, text(rng.randrange(40)) if i % 3 else items[0][1]) for i in range(60)]
    docs, benchmark = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], plain), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "_RUNS_A_TASK", 3)
    init = D.KeyFilter.__init__
    monkeypatch.setattr(D.KeyFilter, "__init__", lambda self, keys, column: init(self, keys, column, most_bits=64))
    got = {r.doc_id: ([i for s, e in zip(r.starts, r.ends) for i in range(s, e)], set(r["items"])) for r in D.find(docs, benchmark, window=4, shard_words=5).collect()}
    assert got == {k: brute(words(t), items, 4) for k, t in rows}
