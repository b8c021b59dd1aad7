"""Language identification by the nearest of several centroids per language.

A text is a vector of its letter n-grams (two and three code points, lower case, words padded) in
``DIM`` hashed places, weighted with 1 + log tf times idf and scaled to length 1. The document
frequencies of idf come from all learning rows. Per language, spherical k-means on at most
``sample`` learning rows gives ``clusters`` centroids. A text gets the language of the centroid
with the greatest cosine; it is rejected if it is further from that centroid than nearly all texts
of its language in the sample are, and further than ``least_reach``.

Nulls and ties: rows without a language teach nothing. A null text or one without a letter gets
``und``, score 0 and is rejected. Equal cosines go to the language that is first in code point order.
If there is nothing to learn from, every text gets ``und``. Repeated rows count each time. Texts of any
length are read whole; of learning texts the driver holds about ``sample`` a language. Only the
named columns are read, so others may have any name; the model is DIM numbers per centroid, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covergraph.llm._common import released, small_batches

DIM = 1 << 13
_PIECE_CHARS = 500_000
#: Letters as a lookup over the Basic Multilingual Plane, and lower case of the same.
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0xD800)), dtype=bool, count=0xD800)
_LOWER = np.fromiter((ord(chr(c).lower()[0]) for c in range(0xD800)), dtype=np.uint32, count=0xD800)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        # A piece also has a bounded number of texts, as each has a dense row.
        if size >= _PIECE_CHARS or i - start >= 500:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def counts(texts: list[str | None]) -> np.ndarray:
    """(len(texts), DIM) n-gram counts."""
    # Each text has a pad on both sides of its own.
    cp = np.frombuffer(("\0" + "\0\0".join(t or "" for t in texts) + "\0\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t or "") + 2 for t in texts])
    doc = np.append(doc, len(texts) - 1)
    low = np.minimum(cp, 0xD7FF)
    letter = _LETTER[low] | (cp >= 0x10000)
    code = np.where(letter, np.where(cp < 0xD800, _LOWER[low], cp), 0).astype(np.uint64)
    out = np.zeros(len(texts) * DIM)
    a, b, c = code[:-2], code[1:-1], code[2:]
    here = doc[1:-1]
    for key, real in (((a * np.uint64(0x1F123BB5) + b * np.uint64(0x9E3779B1)) + np.uint64(7), (a != 0) | (b != 0)), ((a * np.uint64(0x85EBCA77) + b * np.uint64(0xC2B2AE3D) + c * np.uint64(0x27D4EB2F)), (b != 0) & ((a != 0) | (c != 0)))):
        key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIM.bit_length() + 1)
        at = np.flatnonzero(real)
        out += np.bincount(here[at] * DIM + key[at].astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), DIM)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    n = counts(texts)
    v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0).astype(np.float32) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


class Centroids:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, owner: np.ndarray, reach: np.ndarray):
        self.idf, self.langs, self.centroids, self.owner, self.reach = idf, langs, centroids, owner, reach

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        lang, score, distance = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.ones(len(texts))
        rejected = np.ones(len(texts), dtype=bool)
        for s, e in _pieces(texts) if self.langs else ():
            near = vectors(texts[s:e], self.idf) @ self.centroids.T
            best = np.full((e - s, len(self.langs)), -1.0)
            for k in range(len(self.langs)):
                best[:, k] = near[:, self.owner == k].max(axis=1)
            top = best.argmax(axis=1)
            nearest = np.where(self.owner[None, :] == top[:, None], near, -1).argmax(axis=1)
            odds = np.exp(20 * (best - best.max(axis=1, keepdims=True)))
            for i in range(e - s):
                if has_letter(texts[s + i]):
                    lang[s + i] = self.langs[top[i]]
                    score[s + i] = odds[i, top[i]] / odds[i].sum()
                    distance[s + i] = min(1.0, max(0.0, 1.0 - float(best[i, top[i]])))
                    rejected[s + i] = distance[s + i] > self.reach[nearest[i]]
        return pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1), "distance": distance, "rejected": rejected})


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in released(batches):
            texts = batch["text"].tolist()
            for s, e in _pieces(texts):
                total += (counts(texts[s:e]) > 0).sum(axis=0)
            n += len(texts)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": np.append(at, -1), "c": np.append(total[at], n)})

    got = rows.select("text").mapInPandas(count, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(DIM)
    places = got[got.k >= 0]
    out[places.k.to_numpy()] = places.c.to_numpy()
    return out, int(got.c[got.k < 0].sum())


def _cluster(v: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; the start spreads out by distance."""
    centre = v[[int(rng.integers(len(v)))]]
    while len(centre) < min(k, len(v)):
        far = np.maximum(1 - (v @ centre.T).max(axis=1), 0) ** 2
        if not far.sum() > 1e-9:
            break
        centre = np.vstack([centre, v[rng.choice(len(v), p=far / far.sum())]])
    for _ in range(rounds):
        own = (v @ centre.T).argmax(axis=1)
        sums = np.stack([v[own == j].sum(axis=0) if (own == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


def fit(
    learning: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", clusters: int = 4, sample: int = 400,
    rounds: int = 10, seed: int = 7, quantile: float = 0.999, slack: float = 1.25, least_reach: float = 0.5,
) -> Centroids:
    """Learns from all rows for idf, and from about ``sample`` rows a language for the centroids."""
    rows = small_batches(learning).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).where("lang IS NOT NULL AND text IS NOT NULL")
    df, n = _frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    # A row is in the sample if the hash of its id is below its language's share.
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))]), F.col("lang")) if langs else F.lit(0.0)
    unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = rows.where(unit < share).select("lang", "text").toPandas() if langs else pd.DataFrame({"lang": [], "text": []})
    rng = np.random.default_rng(seed)
    centres, owner, reach = [], [], []
    for i, lang in enumerate(langs):
        own = [t for t in taken.text[taken.lang == lang].sort_values() if has_letter(t)][: 2 * sample]
        if not own:
            continue
        v = np.vstack([vectors(own[s:e], idf) for s, e in _pieces(own)])
        c = _cluster(v, clusters, rounds, rng)
        distance = 1 - (v @ c.T).max(axis=1)
        centres.append(c)
        owner += [i] * len(c)
        reach += [min(1.0, max(least_reach, slack * float(np.quantile(distance, quantile))))] * len(c)
    if not centres:
        return Centroids(idf, [], np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    known = sorted(set(owner))
    return Centroids(idf, [langs[i] for i in known], np.vstack(centres).astype(np.float32), np.searchsorted(known, owner), np.array(reach))


def predict(model: Centroids, docs: DataFrame, text: Column) -> Column:
    """A struct column (lang_pred, score, distance, rejected) of a text column."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, distance double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in released(batches):
            yield shared.value.predict(texts.tolist())

    return nearest(text)
