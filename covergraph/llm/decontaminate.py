"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised to word ids and put into one suffix automaton. Document words are streamed
through it while the longest match that ends at each word is tracked. A match of at least
``window`` words is an occurrence of an item window; an item shorter than that is one window itself
and occurs where the whole of it is matched. Before streaming, a NumPy pass leaves out the words
that no run of item bigrams reaches, where no window can end; this changes no match.

Size: one automaton of at most about ``shard_words`` words is broadcast. A larger benchmark is dealt
into shards by the hash of its items, and read once, as are the documents: a filter of window hashes,
of bounded size, tells which runs of a document's words may hold a window; each different run goes to the
shards that have one of its windows, where the shard's automaton decides. Rows carry a key until their
hits of all shards are put together, so the result is the same. Runs of a shard are dealt over
several tasks where there are many, and equal runs are matched once, however many documents hold them.

Nulls and empties: a null or empty text has no words; items without words have no window; null item
ids count as an item named ``null``. Repeated documents and repeated ids are separate rows, repeated
items share their windows. Texts of any length are streamed whole. Ids are whole
numbers (or text that reads as such), item ids are anything. Empty tables give no rows or no hits.
Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergraph.llm._common import KeyFilter, materialize, released, small_batches
from covergraph.llm.near_dedup import mix64

#: Bytes that are no part of a word become spaces, A-Z are lower-cased; bytes of other characters stay.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Different runs of a shard that one task matches.
_RUNS_A_TASK = 50_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.full: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        self.single: dict[int, list] = {}
        for item, seq in coded:
            if len(seq) == 1:
                self.single.setdefault(seq[0], []).append(item)
                continue
            state = 0
            for n, c in enumerate(seq, 1):
                state = self.next[state][c]
                if n >= window:
                    self.full.setdefault(self._cut(state, window), set()).add(item)
            if len(seq) < window:
                self.short.setdefault(self._cut(state, len(seq)), []).append((len(seq), item))
        size = len(self.ids)
        self.bigrams = np.unique(np.array([a * size + b for _, s in coded for a, b in zip(s, s[1:])], dtype=np.int64))
        lengths = [min(window, len(s)) for _, s in coded if len(s) > 1]
        self.least = min(lengths, default=0)

    def _extend(self, last: int, c: int) -> int:
        there = self.next[last].get(c)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._clone(last, c, there)
        new = self._state(self.length[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _cut(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items that have an occurring window."""
        hit, found = np.zeros(len(words), dtype=bool), set()
        if not words or not self.ids:
            return hit, found
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        for c in np.intersect1d(ids, np.fromiter(self.single, dtype=np.int64, count=len(self.single))):
            hit |= ids == c
            found.update(self.single[int(c)])
        if not self.least or len(ids) < self.least:
            return hit, found
        a, b = ids[:-1], ids[1:]
        pair = np.where((a >= 0) & (b >= 0), a * len(self.ids) + b, -1)
        at = np.minimum(np.searchsorted(self.bigrams, pair), len(self.bigrams) - 1)
        edge = np.diff(np.concatenate(([0], (self.bigrams[at] == pair).astype(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = ends - starts + 1 >= self.least
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
            self._stream(ids[s : e + 1].tolist(), s, hit, found)
        return hit, found

    def _stream(self, ids: list[int], base: int, hit: np.ndarray, found: set) -> None:
        state = matched = 0
        for k, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(c, 0)
            matched = matched + 1 if state else 0
            end = base + k + 1
            if matched >= self.window:
                hit[end - self.window : end] = True
                found |= self.full[self._cut(state, self.window)]
            if self.short:
                up, most = state, matched
                while up > 0:
                    for m, item in self.short.get(up, ()):
                        if m <= most:
                            hit[end - m : end] = True
                            found.add(item)
                    up = self.link[up]
                    most = self.length[up]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _items(benchmark: DataFrame, item_col: str, text_col: str, shard_words: int) -> tuple[DataFrame, int]:
    """(item, text, shard) and how many shards there are."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = 1 + int(chars // 2 // shard_words)
    return items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def _automaton(items: DataFrame, window: int) -> SuffixAutomaton:
    return SuffixAutomaton([(r.item, words_of(bytes(r.text))) for r in items.toLocalIterator()], window)


def find(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shard_words: int = 200_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per document: id, n_words, spans (start and end of maximal hit runs, in words), items (ids as strings, sorted)."""
    items, n = _items(benchmark, item_col, item_text_col, shard_words)
    source = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    if n > 1:
        return _routed(source, items, n, window).withColumnRenamed("id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(_automaton(items, window))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = shared.value
        for batch in released(batches):
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                words = words_of(text) if text is not None else []
                hit, found = machine.match(words)
                runs = _runs(hit) if found else []
                rows.append((key, len(words), [a for a, _ in runs], [b for _, b in runs], sorted(found)))
            frame = pd.DataFrame(rows, columns=["id", "n_words", "starts", "ends", "items"])
            frame["id"] = frame["id"].astype("Int64")
            yield frame

    return source.mapInPandas(scan, "id long, n_words long, starts array<int>, ends array<int>, items array<string>").withColumnRenamed("id", id_col)


def _window_hashes(words: list[bytes], sizes: set[int]) -> dict[int, np.ndarray]:
    """Per size, the hash of the window that starts at each word."""
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    out, h = {}, np.zeros(len(words), np.uint64)
    for k in range(max(sizes, default=0)):
        h = mix64(h[: len(words) - k] * np.uint64(0x9E3779B97F4A7C15) + own[k:] + np.uint64(k + 1))
        if k + 1 in sizes:
            out[k + 1] = h
    return out


def _routed(source: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """``find`` for many shards, in one pass over documents and benchmark."""
    spark = source.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            for shard, text in zip(batch["shard"], batch["text"]):
                words = words_of(text)
                size = min(window, len(words))
                if size:
                    h = np.unique(_window_hashes(words, {size})[size]).view(np.int64)
                    yield pd.DataFrame({"h": h, "size": size, "shard": shard})

    windows = materialize(items.mapInPandas(cut, "h long, size int, shard int").distinct(), "leak-windows")
    # There are at most ``window`` sizes.
    sizes = {r.size for r in windows.select("size").distinct().collect()}
    maybe = spark.sparkContext.broadcast(KeyFilter(windows.select("h").distinct(), "h"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = TaskContext.get().partitionId() << 36
        for batch in released(batches):
            rows = []
            for doc, text in zip(batch["id"], batch["text"]):
                words, runs = words_of(text) if text is not None else [], []
                edge, found = np.zeros(len(words) + 1, np.int64), []
                for size, h in _window_hashes(words, sizes).items():
                    at = np.flatnonzero(maybe.value.holds(h.view(np.int64)))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    found.append((at, h[at]))
                if found:
                    at, h = (np.concatenate(x) for x in zip(*found))
                    for s, e in _runs(np.cumsum(edge)[:-1] > 0):
                        runs.append((s, b" ".join(words[s:e]), np.unique(h[(at >= s) & (at < e)]).view(np.int64).tolist()))
                rows.append((key, doc, len(words), runs))
                key += 1
            frame = pd.DataFrame(rows, columns=["key", "id", "n_words", "runs"])
            frame["id"] = frame["id"].astype("Int64")
            frame["runs"] = [[{"s": s, "words": w, "h": h} for s, w, h in r] for r in frame["runs"]]
            yield frame

    scanned = materialize(source.mapInPandas(scan, "key long, id long, n_words long, runs array<struct<s:int,words:binary,h:array<long>>>"), "leak-scanned")
    runs = scanned.select("key", F.explode("runs").alias("r")).select("key", "r.s", F.sha2("r.words", 256).alias("run"), "r.words", "r.h")
    # Equal runs are matched once, by the shards that have one of their windows.
    different = materialize(runs.groupBy("run").agg(F.first("words").alias("words"), F.first("h").alias("h")), "leak-runs")
    sent = different.select("run", F.explode("h").alias("h")).join(windows.select("h", "shard"), "h").select("run", "shard").distinct()
    sent = materialize(sent.join(different.select("run", "words"), "run"), "leak-sent")
    salts = sent.groupBy("shard").agg(F.ceil(F.count("*") / _RUNS_A_TASK).cast("int").alias("salts"))
    dealt = sent.join(salts, "shard").select("shard", F.pmod(F.xxhash64("run"), F.col("salts")).cast("int").alias("salt"), "run", "words")
    copies = items.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "item", "text")

    def match(own: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        machine, rows = SuffixAutomaton([(i, words_of(t)) for i, t in zip(own["item"], own["text"])], window), []
        for run, words in zip(some["run"], some["words"]):
            hit, found = machine.match(words.split(b" "))
            if found:
                rows.append((run, [{"s": a, "e": b} for a, b in _runs(hit)], sorted(found)))
        return pd.DataFrame(rows, columns=["run", "spans", "items"])

    hits = materialize(copies.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInPandas(match, "run string, spans array<struct<s:int,e:int>>, items array<string>"), "leak-hits")
    placed = runs.select("key", "s", "run").join(hits, "run").select("key", "items", F.transform("spans", lambda x: F.struct((x["s"] + F.col("s")).alias("s"), (x["e"] + F.col("s")).alias("e"))).alias("spans"))
    merged = placed.groupBy("key").agg(_merged(F.array_sort(F.flatten(F.collect_list("spans")))).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = lambda c, t: F.coalesce(F.col(c), F.expr(f"CAST(array() AS array<{t}>)"))
    return scanned.select("key", "id", "n_words").join(merged.select("key", F.col("m")["s"].alias("starts"), F.col("m")["e"].alias("ends"), "items"), "key", "left").select(
        "id", "n_words", none("starts", "int").alias("starts"), none("ends", "int").alias("ends"), none("items", "string").alias("items"))


def _merged(pairs):
    """Sorted spans, those that overlap or touch as one."""
    step = lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["e"] < x["s"]), F.concat(acc, F.array(x))).otherwise(
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))))
    return F.aggregate(pairs, F.expr("CAST(array() AS array<struct<s:int,e:int>>)"), step)


def clean(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_coverage: float = 0.5, shard_words: int = 200_000,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of the texts, together with what
    stands between their words; a document with more than ``max_coverage`` of its words hit is left out.
    Hits are judged on the input, all shards together. Other documents, null texts among them, stay as they
    are. All columns are kept.
    """
    schema = docs.schema
    items, n = _items(benchmark, item_col, item_text_col, shard_words)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_automaton(items, window))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in released(batches):
                texts = batch[text_col].tolist()
                yield _cut(batch, text_col, [_runs(shared.value.match(words_of(t.encode()))[0]) if t else [] for t in texts], max_coverage)

        return small_batches(docs).mapInPandas(scan, schema)
    key, starts, ends = (_unused(docs, c) for c in ("_row", "_starts", "_ends"))
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "leak-keyed")
    found = find(keyed, benchmark, window=window, shard_words=shard_words, id_col=key, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    hit = found.where(F.size("starts") > 0).select(key, F.col("starts").alias(starts), F.col("ends").alias(ends))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            runs = [list(zip(a, b)) if a is not None else [] for a, b in zip(batch[starts], batch[ends])]
            yield _cut(batch, text_col, runs, max_coverage)[[f.name for f in schema]]

    return small_batches(keyed).join(hit, key, "left").mapInPandas(cut, schema)


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name


def _cut(batch: pd.DataFrame, text_col: str, runs: list[list[tuple[int, int]]], max_coverage: float) -> pd.DataFrame:
    """The batch with hit runs of words cut out of its texts, without rows that are mostly hit."""
    keep, texts = np.ones(len(batch), dtype=bool), batch[text_col].tolist()
    for i, (text, own) in enumerate(zip(texts, runs)):
        if not own:
            continue
        raw = text.encode()
        places = [m.span() for m in _WORD.finditer(raw)]
        if sum(e - s for s, e in own) > max_coverage * len(places):
            keep[i] = False
            continue
        out, at = [], 0
        for s, e in own:
            out.append(raw[at : places[s][0]])
            at = places[e - 1][1]
        texts[i] = b"".join([*out, raw[at:]]).decode()
    batch[text_col] = pd.Series(texts, index=batch.index, dtype=object)
    return batch[keep]


_NOT_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_NOT_WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_NOT_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS key FROM
    (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
hits AS (SELECT d.doc_id, d.i, d.m, win.item_id FROM
    (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS key FROM
        (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win))) d JOIN win USING (m, key)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
