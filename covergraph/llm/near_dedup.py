"""Near-duplicate detection with ProbMinHash signatures, banding and exact verification.

Exact copies are collapsed first by a digest of the text. Each distinct text becomes a weighted set
of shingles of ``SHINGLE`` words (weight: how often it occurs). Every shingle is a Poisson process
whose rate is its weight; arrivals hit random registers, a register keeps the shingle of its first
arrival, and a shingle stops as soon as its next arrival is later than all registers of its text.
Two texts agree in a register with the probability Jaccard of their weighted sets. Registers are
banded; texts that share a band are candidates. Texts with repeated shingles also have the bands of
a signature with weights of 1, so that every pair meets by its distinct shingles too. A pair is a link if the Jaccard similarity of its
distinct shingles is at least ``threshold``. Classes are the connected components of links.

A bucket of n texts is not turned into n * n pairs. Each bucket has a leader, the member that shares
the most bucket places with others, which is compared with all members; components are formed. Of
further pairs only those are verified that lie in different components (others change no class),
whose sizes and distances from the leader allow the threshold (the Jaccard distance is a metric)
and whose signature sketches do not differ far more than chance explains at the threshold.

Nulls and empties: a null text and a text without words have no shingles; equal ones are exact
copies (null texts are copies of each other). A text with fewer words than a shingle is one shingle.
Null ids are left as classes of their own. Different texts under one id are different documents, which
may have different classes; equal rows are one document. Texts of any length are read whole. Ids are whole
numbers (or text that reads as such). An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covergraph.llm._common import KeyFilter, materialize, released, small_batches
from covergraph.operators.components import connected_components

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Longs in a sketch of texts that are left after the leaders.
SKETCH = 32
_PIECE_CHARS = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hashes of words, each calculated once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, in order, and the index of the text of each."""
    docs = [t.split() if t else [] for t in texts]
    counts = np.array([len(d) for d in docs], dtype=np.int64)
    hashes = _Hashes()
    words = np.fromiter(map(hashes.__getitem__, chain.from_iterable(docs)), dtype=np.uint64, count=int(counts.sum()))
    doc = np.repeat(np.arange(len(docs)), counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Position i starts a shingle if SHINGLE words of its text follow, or if it is the first of a shorter text.
    left = np.repeat(first + counts, counts) - np.arange(len(words))
    short = (np.repeat(counts, counts) < SHINGLE) & (np.arange(len(words)) == np.repeat(first, counts))
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(SHINGLE):
        there = left > k
        step = np.zeros(len(words), dtype=np.uint64)
        step[: len(words) - k] = words[k:] + np.uint64(1)
        out = np.where(there, mix64(out * _GOLD + step), out)
    at = np.flatnonzero((left >= SHINGLE) | short)
    return out[at], doc[at]


def distinct_shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text index, times), sorted by text."""
    elem, doc = shingles(texts)
    key = mix64(elem ^ mix64(doc.astype(np.uint64) * _GOLD + np.uint64(1)))
    _, index, times = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(index)
    index, times = index[order], times[order]
    return elem[index], doc[index], times


def prob_minhash(elem: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs, m) of weighted sets; rows of empty sets are 0."""
    first = np.full(n_docs * m, np.inf)
    signature = np.zeros(n_docs * m, dtype=np.uint64)
    time, step = np.zeros(len(elem)), 0
    while len(elem):
        step += 1
        draw = mix64(elem + np.uint64(step * int(_GOLD) % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / weight
        flat = doc * m + (mix64(draw + _GOLD) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(time < first[flat])
        np.minimum.at(first, flat[better], time[better])
        won = better[time[better] == first[flat[better]]]
        signature[flat[won]] = elem[won]
        live = time < first.reshape(n_docs, m).max(axis=1)[doc]
        elem, weight, doc, time = elem[live], weight[live], doc[live], time[live]
    return signature.reshape(n_docs, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, grouped.shape[:2])
    for r in range(rows):
        key = mix64(key + grouped[:, :, r])
    return key.view(np.int64) if key.flags["C_CONTIGUOUS"] else np.ascontiguousarray(key).view(np.int64)


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= _PIECE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, digest, n, keys): band keys of every text, n distinct shingles."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            texts = batch["text"].tolist()
            for s, e in _pieces(texts):
                elem, doc, times = distinct_shingles(texts[s:e])
                n = np.bincount(doc, minlength=e - s)
                signature = prob_minhash(elem, times.astype(np.float64), doc, e - s, bands * rows)
                keys = [k if c else [] for k, c in zip(band_keys(signature, bands, rows), n)]
                # Links count distinct shingles: a text that repeats some has the bands of its distinct ones as well.
                again = np.unique(doc[times > 1])
                if len(again):
                    some = np.isin(doc, again)
                    flat = prob_minhash(elem[some], np.ones(int(some.sum())), np.searchsorted(again, doc[some]), len(again), bands * rows)
                    for i, k in zip(again.tolist(), band_keys(flat, bands, rows)):
                        keys[i] = np.unique(np.concatenate([keys[i], k]))
                yield pd.DataFrame({"id": batch["id"].iloc[s:e].to_numpy(), "digest": batch["digest"].iloc[s:e].to_numpy(), "n": n, "keys": keys})

    return docs.mapInPandas(sign, "id long, digest string, n long, keys array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, set): the sorted distinct 32-bit shingle hashes of each text."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            texts = batch["text"].tolist()
            for s, e in _pieces(texts):
                elem, doc, _ = distinct_shingles(texts[s:e])
                cut = np.searchsorted(doc, np.arange(e - s + 1))
                low = (elem >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pd.DataFrame({"id": batch["id"].iloc[s:e].to_numpy(), "set": [low[a:b] for a, b in zip(cut, cut[1:])]})

    return docs.select("id", "text").mapInPandas(build, "id long, set array<int>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with the Jaccard similarity of their sets."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))


def _sketches(sets: DataFrame) -> DataFrame:
    """(id, sketch): SKETCH longs with two bits of each of SKETCH * 32 registers of an unweighted signature."""
    m = SKETCH * 32

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            for s in range(0, len(batch), 256):
                part = batch.iloc[s : s + 256]
                size = part["set"].map(len).to_numpy()
                elem = mix64(np.concatenate(part["set"].tolist()).astype(np.uint32).astype(np.uint64) + _GOLD)
                signature = prob_minhash(elem, np.ones(len(elem)), np.repeat(np.arange(len(part)), size), len(part), m)
                # A shingle wins many registers of a short text: its bits are drawn anew in each, so that registers differ independently.
                drawn = mix64(signature ^ mix64(np.arange(1, m + 1, dtype=np.uint64) * _GOLD))
                bits = np.concatenate([(drawn >> np.uint64(17)) & np.uint64(1), (drawn >> np.uint64(41)) & np.uint64(1)], axis=1)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "sketch": list(np.packbits(bits.astype(bool), axis=1).view(np.int64))})

    return sets.mapInPandas(build, "id long, sketch array<long>")


def most_different_bits(threshold: float, sigmas: float = 4.5) -> int:
    """How many sketch bits may differ for a pair at the threshold, with room for chance."""
    m, miss = SKETCH * 32, 1 - threshold
    return int(np.ceil(m * miss + sigmas * np.sqrt(m * (1.5 * miss - miss * miss))))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document row: id, copy_of (smallest id of its exact copies), class_id (smallest id of its class)."""
    return _classes(docs, id_col=id_col, **options).select(F.col("id").alias(id_col), "copy_of", F.col("first.copy_of").alias("class_id"))


def _digest(text: Column) -> Column:
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null"))


def _classes(
    docs: DataFrame, *, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, digest, copy_of, first: the smallest (copy_of, digest) of the class) of every row."""
    text = F.col(text_col)
    named = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), _digest(text).alias("digest"), text.cast("binary").alias("text"))
    known = named.where("id IS NOT NULL")
    signed = materialize(_signed(known, bands, rows), "near-signed")
    # Only the smallest id of a text stands for it in the buckets.
    first = signed.groupBy("digest").agg(F.min_by(F.struct("n", "keys"), "id").alias("f"), F.min("id").alias("copy_of")).select("digest", "copy_of", "f.*")
    # Texts have numbers of their own, as an id may have several texts; from here on these are the ids.
    first = materialize(first.withColumn("node", F.monotonically_increasing_id()), "near-first")
    entries = first.select(F.col("node").alias("id"), F.explode("keys").alias("bucket")).distinct()
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(entries.join(sizes, "bucket"), "near-members")
    # A text in many large buckets is in the middle of its group; it leads those buckets.
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    about = materialize(first.select(F.col("node").alias("id"), "copy_of", "digest", "n", "keys").join(weight, "id"), "near-about")
    row = F.xxhash64("id", "digest")
    holders = about.select(F.col("copy_of").alias("id"), "digest", F.col("id").alias("node"))
    needed = KeyFilter(holders.select(row.alias("row")), "row")
    held = known.withColumn("row", row).where(needed.test("row")).join(holders, ["id", "digest"]).dropDuplicates(["node"])
    sets = materialize(_sets(held.select(F.col("node").alias("id"), "text")), "near-sets")
    sized = lambda a, b: F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)

    weighed = members.select("bucket", "id").join(about.select("id", "n", "weight"), "id")
    lead = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), F.col("n").alias("ln"))).alias("l")).select("bucket", (-F.col("l.minus")).alias("leader"), F.col("l.ln").alias("ln"))
    led = materialize(weighed.join(lead, "bucket").select("bucket", "id", "leader", "n", "ln"), "near-led")
    star = led.where((F.col("id") != F.col("leader")) & sized(F.col("n"), F.col("ln"))).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    stars = materialize(_similar(star, sets), "near-stars")
    links = stars.where(F.col("similarity") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    components = connected_components(links)

    # What is left: members of a bucket in other components than its leader, against all members in other components.
    part = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    placed = led.join(part("id"), "id", "left").join(stars.select(F.col("a").alias("leader"), F.col("b").alias("id"), "similarity"), ["leader", "id"], "left")
    placed = placed.join(part("leader"), "leader", "left").select(
        "bucket", "id", "n", F.coalesce("id_part", "id").alias("part"), F.coalesce("leader_part", "leader").alias("lead_part"),
        F.when(F.col("id") == F.col("leader"), 0.0).otherwise(1 - F.col("similarity")).alias("far"))
    placed = materialize(placed, "near-placed")
    apart = placed.where("part != lead_part").select("bucket").distinct()
    open_ = materialize(placed.join(apart, "bucket").join(about.select("id", "keys"), "id"), "near-open")
    sketches = materialize(_sketches(sets.join(open_.select("id").distinct(), "id", "left_semi")).dropDuplicates(["id"]), "near-sketches")
    open_ = open_.join(sketches, "id")
    y = open_.select(*[F.col(c).alias(f"{c}_y") for c in open_.columns])
    x = open_.where("part != lead_part")
    bits = reduce(Column.__add__, [F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("sketch_y")[k])) for k in range(SKETCH)])
    # Distances to the same leader differ by no more than two texts do. A pair is taken in the first band that it shares.
    close = (
        (F.col("bucket") == F.col("bucket_y")) & (F.col("part") != F.col("part_y")) & ((F.col("part_y") == F.col("lead_part_y")) | (F.col("id") < F.col("id_y")))
        & sized(F.col("n"), F.col("n_y")) & F.coalesce(F.abs(F.col("far") - F.col("far_y")) <= 1 - threshold + 1e-9, F.lit(True))
        & (bits <= most_different_bits(threshold)) & (F.array_intersect("keys", "keys_y")[0] == F.col("bucket"))
    )
    pairs = x.join(y, close).select(F.least("id", "id_y").alias("a"), F.greatest("id", "id_y").alias("b")).distinct()
    found = _similar(pairs, sets).where(F.col("similarity") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    more = materialize(found, "near-more")
    if not more.isEmpty():
        # Components so far are stars of their smallest member.
        components = connected_components(more.unionByName(components.where("node != component").select(F.col("node").alias("src"), F.col("component").alias("dst"))))
    name = F.struct("copy_of", "digest")
    joined = components.select("node", "component").join(first.select("node", "copy_of", "digest"), "node")
    label = joined.groupBy("component").agg(F.min(name).alias("label"))
    labelled = components.select("node", "component").join(label, "component").select("node", "label")
    classes = first.select("node", "digest", "copy_of").join(labelled, "node", "left").select("digest", "copy_of", F.coalesce("label", name).alias("first"))
    out = signed.select("id", "digest").join(classes, "digest").select("id", "digest", "copy_of", "first")
    nulls = named.where("id IS NULL").select("id", "digest", F.lit(None).cast("long").alias("copy_of"), F.lit(None).cast("struct<copy_of:bigint,digest:string>").alias("first"))
    return out.unionByName(nulls)


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, of several texts under it that
    with the smallest digest, in one row. Rows without an id stay."""
    classes = materialize(_classes(docs, id_col=id_col, text_col=text_col, **options).where("id IS NOT NULL"), "near-classes")
    gone = materialize(classes.where(F.struct(F.col("id").alias("copy_of"), "digest") != F.col("first")).select("id", "digest").distinct(), "near-gone")
    twice = classes.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("id", "digest")
    # Only rows that may have to go are shuffled; the others pass as they are.
    key, digest, flag = "_id", "_digest", "_flag"
    while {key, digest, flag} & set(docs.columns):
        key, digest, flag = f"_{key}", f"_{digest}", f"_{flag}"
    known = KeyFilter(gone.unionByName(twice).select(F.xxhash64("id", "digest").alias("row")).distinct(), "row")
    flagged = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(digest, _digest(F.col(text_col)))
    flagged = flagged.withColumn(flag, F.col(key).isNotNull() & known.test(F.xxhash64(key, digest)))
    some = flagged.where(F.col(flag)).join(gone.select(F.col("id").alias(key), F.col("digest").alias(digest)), [key, digest], "left_anti")
    return flagged.where(~F.col(flag)).select(*docs.columns).unionByName(some.dropDuplicates([key, digest]).select(*docs.columns))
