import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from covergraph.llm import language_id as L
from covergraph.llm import queries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, odd):
    model = L.fit(odd)
    rows = odd.withColumn("p", L.predict(model, odd, F.col("text"))).select("doc_id", "text", "p.*").collect()
    for r in rows:
        letter = r.text is not None and any(c.isalpha() for c in r.text)
        assert r.lang_pred in (("en", "fr") if letter else ("und",)) and (letter or r.score == 0 and r.rejected)
    assert len(rows) == 9


def test_strange_text_is_rejected(spark, plain):
    docs = spark.createDataFrame([(i, "the cat and the dog went to the house number " * 3, "en", "a", 1) for i in range(20)], plain)
    p = L.fit(docs).predict(["Жщю Эфы", "the dog went to the house and the cat"])
    assert p["rejected"].tolist() == [True, False]


def test_nothing_to_learn_from(spark, plain):
    empty = spark.createDataFrame([], plain)
    assert L.fit(empty).predict(["some text", None])["lang_pred"].tolist() == ["und", "und"]
    assert empty.withColumn("p", L.predict(L.fit(empty), empty, F.col("text"))).count() == 0


def plain_counts(text):
    """Places of the two and three character pieces of a text, one at a time."""
    code = [0, 0] + [(ord(c.lower()[0]) if c.isalpha() else 0) for c in text or ""] + [0, 0]
    out, full = Counter(), (1 << 64) - 1
    place = lambda key: ((key * 0x9E3779B97F4A7C15) & full) >> (64 - L.DIM.bit_length() + 1)
    for a, b, c in zip(code, code[1:], code[2:]):
        if a or b:
            out[place((a * 0x1F123BB5 + b * 0x9E3779B1 + 7) & full)] += 1
        if b and (a or c):
            out[place((a * 0x85EBCA77 + b * 0xC2B2AE3D + c * 0x27D4EB2F) & full)] += 1
    return out


def test_counts_and_nearest_centroid_by_definition():
    texts = ["The cat, the CAT", None, "", "\u00c9t\u00e9 42 \u4e2d\u6587", "a", "!!", "x\u0000y zz"]
    got = L.counts(texts)
    for i, t in enumerate(texts):
        want = plain_counts(t)
        assert {k: v for k, v in enumerate(got[i]) if v} == {k: v for k, v in want.items() if v}, t
    rng = np.random.default_rng(0)
    idf = rng.random(L.DIM).astype(np.float32) + 1
    centroids = np.abs(rng.standard_normal((5, L.DIM))).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    owner = np.array([0, 0, 1, 2, 2])
    model = L.Centroids(idf, ["a", "b", "c"], centroids, owner, np.full(5, 0.9))
    found = model.predict(texts)
    for i, t in enumerate(texts):
        if not L.has_letter(t):
            assert found["lang_pred"][i] == "und"
            continue
        v = np.zeros(L.DIM)
        for k, n in plain_counts(t).items():
            v[k] = (1 + np.log(n)) * idf[k]
        near = centroids @ (v / np.linalg.norm(v))
        assert found["lang_pred"][i] == "abc"[owner[near.argmax()]] and np.isclose(found["distance"][i], 1 - near.max(), atol=1e-5)
