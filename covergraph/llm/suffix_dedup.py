"""Removal of byte passages that occur earlier, by external induced suffix sorting in shards.

Every ``length``-byte string that also starts earlier (smaller id, or same document, earlier start)
is removed; the strings are judged on the input.

Dealing. Each window of ``length`` bytes belongs to its minimizer, the ``KMER``-byte string in it
with the least hash (the first of equals), so equal windows meet under one minimizer. Neighbouring
windows of one minimizer are one piece of text. Pieces of equal content are aggregated to their
first holder; in all other holders the piece is a repeat. Pieces of different contents can only share
a window if they share their minimizer and, as a window has at least ``length - KMER`` bytes beside it, half
of those bytes before it or after it. Pieces that do go to shards by minimizer, and each shard's
suffixes are sorted with their common prefixes; of suffixes that share ``length`` bytes, all but
the earliest are repeats. Shards are kept small (about ``SHARD_BYTES``, more only where one minimizer's
contents are), so a shard is joined and sorted in memory as a rule and scratch files are seldom used.

Skew. A k-mer that would be the minimizer of more than about a two-thousandth of all pieces is put
behind the others (at most 2,000 are, found by counting over all documents), so no common phrase draws
its many contexts into one shard. The contents of a minimizer that come to more than ``LARGE_BYTES`` are
dealt again by the minimizers of another hash. Contents are aggregated before they are shuffled.

Nulls and ties: a null text is empty and nothing is removed from it; null ids come first. Rows that
share an id are ordered by a digest of their text; equal rows are one document and are treated alike.
Ids are whole numbers (or text that reads as such). Empty tables give no rows. Texts shorter than ``length`` stay. Documents have no common windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covergraph.llm._common import KeyFilter, materialize, released, small_batches, xxhash64
from covergraph.llm.induced_sort import Scratch, suffix_order
from covergraph.llm.near_dedup import mix64

KMER = 32
HOT_SHARE = 2000
#: Pieces of a minimizer stay together; shards are cut at minimizers after about this many bytes.
SHARD_BYTES = 1 << 20
#: A minimizer whose contents are larger is dealt again.
LARGE_BYTES = 8 << 20
#: Bytes taken at a time; small enough for the temporaries to stay in the processor cache.
_SEGMENT = 1 << 16
_ROWS = 100_000
_POS_BITS = 24
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def kmer_size(length: int) -> int:
    """Bytes of a minimizer for windows of ``length``: a third of them, in eights, at most KMER."""
    if length < 8:
        raise ValueError("length is at least 8")
    return min(KMER, max(8, length // 24 * 8))


def _kmer_hashes(data: np.ndarray, kmer: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the kmer bytes from each place on."""
    words = np.empty(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        words[k::8] = data[k : k + (len(data) - k) // 8 * 8].view(np.uint64)
    n = len(data) - kmer + 1
    h = words[:n] * _ODD[0]
    for k in range(8, kmer, 8):
        h += words[k : k + n] * _ODD[k // 8]
    return mix64(h ^ np.uint64(seed))


def pieces_of(data: np.ndarray, length: int, hot: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, its place, start, size) of the pieces of one run of at most 2**_POS_BITS bytes."""
    kmer = kmer_size(length)
    w = length - kmer + 1
    h = _kmer_hashes(data, kmer, seed)
    key = (h >> np.uint64(_POS_BITS + 1)) << np.uint64(_POS_BITS) | np.arange(len(h), dtype=np.uint64)
    if len(hot):
        table = np.zeros(1 << 16, dtype=bool)
        table[(hot & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(hot, h[maybe]), len(hot) - 1)
        key[maybe[hot[at] == h[maybe]]] |= np.uint64(1 << 63)
    # Sliding minimum over w keys from two windows of a power of two.
    width, least = 1, key
    while width * 2 <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(h) - w + 1
    least = np.minimum(least[:n], least[w - width : w - width + n])
    place = (least & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    size = np.diff(np.append(start, n)) + length - 1
    return h[place[start]], place[start], start, size


def _batch_pieces(texts: list[bytes], length: int, hot: np.ndarray):
    """(text index, start, size, minimizer, its place in the piece) of all pieces of some texts; short texts are taken together."""
    held, places, total = [], [], 0

    def flush():
        if not held:
            return
        data = np.frombuffer(b"".join(held), dtype=np.uint8)
        m, place, start, size = pieces_of(data, length, hot)
        # Cut pieces at the ends of texts and leave out what crosses them.
        begin = np.array([p[2] for p in places])
        owner = np.searchsorted(begin, start, side="right") - 1
        last = np.searchsorted(begin, start + size - length, side="right") - 1
        for o in (np.flatnonzero(owner == last), np.flatnonzero(owner != last)):
            split = not len(o) or owner[o[0]] != last[o[0]]
            if not len(o):
                continue
            if split:
                span = last[o] - owner[o] + 1
                o = np.repeat(o, span)
                own = owner[o] + (np.arange(len(o)) - np.repeat(np.cumsum(span) - span, span))
            else:
                own = owner[o]
            lo, end = begin[own], begin[own] + np.array([p[3] for p in places])[own]
            s = np.maximum(start[o], lo)
            e = np.minimum(start[o] + size[o], end)
            good = e - s >= length
            own, s, e = own[good], s[good], e[good]
            yield np.array([p[0] for p in places])[own], s - lo[good] + np.array([p[1] for p in places])[own], e - s, m[o[good]], place[o[good]] - s

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), _SEGMENT):
            part = text[at : at + _SEGMENT + length - 1]
            if len(part) < length:
                continue
            if total + len(part) > _SEGMENT and held:
                yield from flush()
                held, places, total = [], [], 0
            places.append((i, at, total, len(part)))
            held.append(part)
            total += len(part)
    yield from flush()


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), text.alias("text")).withColumn("dk", F.xxhash64("text"))


def _hot(named: DataFrame, length: int) -> np.ndarray:
    """Minimizers of more than a share of all pieces. Each batch names its own frequent ones, which
    holds every one that is frequent in all; the counts are lower bounds, so at most HOT_SHARE remain."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            parts = [m for *_, m, _ in _batch_pieces(batch["text"].tolist(), length, np.zeros(0, np.uint64))]
            keys, times = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            often = times > times.sum() / HOT_SHARE
            yield pd.DataFrame({"m": np.append(keys[often].view(np.int64), 0), "c": np.append(times[often], 0), "total": np.append(np.zeros(int(often.sum()), np.int64), times.sum())})

    counted = named.select("text").mapInPandas(count, "m long, c long, total long").groupBy("m").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))
    total = counted.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    rows = counted.where(F.col("c") > max(200, total / HOT_SHARE)).select("m").collect()
    return np.sort(np.array([r.m for r in rows], dtype=np.int64).view(np.uint64))


def _scan(named: DataFrame, length: int, hot, *, firsts: bool, only=None) -> DataFrame:
    """Pieces (m, p, doc, dk, start, size); with ``firsts`` one row per content and batch: its first holder, n, and
    hashes of the minimizer with the bytes before it and after it that a shared window may need.

    ``only`` is a broadcast filter of xxhash64(m, p).
    """
    columns = "m long, p long, doc long, dk long, start int, size int" + (", before long, after long, n long" if firsts else "")
    kmer = kmer_size(length)
    beside = -(-(length - kmer) // 2)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            texts, doc, dk = batch["text"].tolist(), batch["doc"].to_numpy(), batch["dk"].to_numpy()
            held, rows = [], 0
            for owner, start, size, m, at in _batch_pieces(texts, length, hot.value):
                digest_ = xxhash.xxh3_64_intdigest
                own, ends = owner.tolist(), (start + size).tolist()
                p = np.fromiter((digest_(texts[o][s:e]) for o, s, e in zip(own, start.tolist(), ends)), dtype=np.uint64, count=len(owner))
                sides = []
                if firsts:
                    places = (start + at).tolist()
                    # 0 where the piece has fewer bytes on that side.
                    before = (digest_(texts[o][k - beside : k + kmer], 1) if k - s >= beside else 0 for o, k, s in zip(own, places, start.tolist()))
                    after = (digest_(texts[o][k : k + kmer + beside], 2) if e - k - kmer >= beside else 0 for o, k, e in zip(own, places, ends))
                    sides = [np.fromiter(x, dtype=np.uint64, count=len(owner)).view(np.int64) for x in (before, after)]
                held.append((m.view(np.int64), p.view(np.int64), doc[owner], dk[owner], start.astype(np.int32), size.astype(np.int32), *sides))
                rows += len(owner)
                if rows > _ROWS:
                    yield _frame(held, firsts, only)
                    held, rows = [], 0
            if held:
                yield _frame(held, firsts, only)

    return named.select("doc", "dk", "text").mapInPandas(scan, columns)


def _frame(held: list[tuple], firsts: bool, only) -> pd.DataFrame:
    frame = pd.DataFrame(dict(zip(("m", "p", "doc", "dk", "start", "size", "before", "after"), map(np.concatenate, zip(*held)))))
    if only is not None:
        frame = frame[only.value.holds(xxhash64(frame["m"].to_numpy(), frame["p"].to_numpy()).view(np.int64))]
    if firsts:
        key = mix64(frame["m"].to_numpy().view(np.uint64) * _ODD[0] + frame["p"].to_numpy().view(np.uint64))
        by = np.lexsort((frame["start"], frame["dk"], frame["doc"]))
        _, at, n = np.unique(key[by], return_index=True, return_counts=True)
        frame = frame.iloc[by[at]].assign(n=n)
    return frame


def _sort_shards(rows: DataFrame, length: int) -> DataFrame:
    """Repeats (doc, dk, s, e) among pieces (m, doc, dk, start, data) of different contents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in released(batches):
            cuts = np.append(np.flatnonzero(np.diff(batch["m"].to_numpy())) + 1, len(batch))
            at = 0
            for cut in cuts.tolist():
                part = batch.iloc[at:cut]
                if size >= SHARD_BYTES and part["m"].iloc[0] != held[-1]["m"].iloc[-1]:
                    yield _shard_repeats(pd.concat(held), length)
                    held, size = [], 0
                held.append(part)
                size += int(part["data"].map(len).sum())
                at = cut
        if held:
            yield _shard_repeats(pd.concat(held), length)

    parts = rows.repartition("m").sortWithinPartitions("m")
    return parts.mapInPandas(run, "doc long, dk long, s int, e int")


def _shard_repeats(shard: pd.DataFrame, length: int) -> pd.DataFrame:
    shard = shard.sort_values(["doc", "dk", "start"], kind="stable")
    sizes = shard["data"].map(len).to_numpy()
    joined = np.frombuffer(b"".join(x + b"\0" for x in shard["data"]), dtype=np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    scratch = Scratch()
    try:
        text = scratch.array(len(joined) + 1, np.int64)
        text[:-1] = joined
        text[:-1] += 2
        text[begin + sizes] = 1
        text[-1] = 0
        order, shared = suffix_order(text, length, scratch)
    finally:
        scratch.close()
    owner = np.searchsorted(begin, order, side="right") - 1
    inside = (order - begin[owner] + length <= sizes[owner]) & (order < len(joined))
    group = np.cumsum(shared < length)
    order, owner, group = order[inside], owner[inside], group[inside]
    starts = shard["start"].to_numpy().astype(np.int64)[owner] + order - begin[owner]
    # Documents in order of (doc, dk); a shard's pieces are sorted so.
    key = shard[["doc", "dk"]].ne(shard[["doc", "dk"]].shift()).any(axis=1).to_numpy().cumsum()[owner]
    by = np.lexsort((starts, key, group))
    key, starts, group, owner = key[by], starts[by], group[by], owner[by]
    again = np.append(False, group[1:] == group[:-1])
    key, starts, owner = key[again], starts[again], owner[again]
    by = np.lexsort((starts, key))
    key, starts, owner = key[by], starts[by], owner[by]
    if not len(key):
        return pd.DataFrame({"doc": [], "dk": [], "s": [], "e": []})
    new = np.append(True, (key[1:] != key[:-1]) | (starts[1:] > starts[:-1] + length))
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(key) - 1)
    first = np.flatnonzero(new)
    return pd.DataFrame({"doc": shard["doc"].to_numpy()[owner[first]], "dk": shard["dk"].to_numpy()[owner[first]], "s": starts[first], "e": starts[ends] + length})


def repeats(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, dk, s, e): byte ranges to remove, which may overlap; dk is a digest of the text."""
    spark = docs.sparkSession
    named = _named(docs, id_col, text_col)
    hot = spark.sparkContext.broadcast(_hot(named, length))
    holder = F.struct("doc", "dk", "start")
    others = lambda side: (F.col(side) != 0) & (F.count("*").over(Window.partitionBy("m", side)) > 1)
    contents = (
        _scan(named, length, hot, firsts=True).repartition("m").groupBy("m", "p")
        .agg(F.min(holder).alias("first"), F.first("size").alias("size"), F.first("before").alias("before"), F.first("after").alias("after"), F.sum("n").alias("n"))
        .withColumn("beside", others("before")).withColumn("beside", F.col("beside") | others("after"))
        .where("n > 1 OR beside").drop("before", "after")
    )
    contents = materialize(contents, "suffix-contents")
    # Later holders of equal contents.
    twice = contents.where("n > 1").select("m", "p", "first")
    seen = KeyFilter(twice.select(F.xxhash64("m", "p").alias("k")), "k")
    held = _scan(named, length, hot, firsts=False, only=spark.sparkContext.broadcast(seen))
    copies = held.join(twice, ["m", "p"]).where(F.struct("doc", "dk", "start") != F.col("first")).select("doc", "dk", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"))
    # First holders of contents that may share windows with another one, with their bytes.
    kinds = contents.where("beside")
    large = materialize(kinds.groupBy("m").agg(F.sum(F.col("size").cast("long")).alias("bytes")).where(F.col("bytes") > LARGE_BYTES).select("m", F.lit(True).alias("large")), "suffix-large")
    many = not large.isEmpty()
    kinds = kinds.join(large, "m", "left") if many else kinds.withColumn("large", F.lit(None).cast("boolean"))
    wanted = kinds.select("first.doc", "first.dk", F.struct("m", "first.start", "size", "large").alias("w")).groupBy("doc", "dk").agg(F.collect_list("w").alias("w"))
    wanted = materialize(wanted, "suffix-wanted")
    holds = KeyFilter(wanted.select("dk"), "dk")
    texts = named.where(holds.test("dk")).join(wanted, ["doc", "dk"]).dropDuplicates(["doc", "dk"])
    data = texts.select("doc", "dk", "text", F.explode("w").alias("w")).select("doc", "dk", "w.m", "w.start", F.substring("text", F.col("w.start") + 1, F.col("w.size")).alias("data"), "w.large")
    return copies.unionByName(_sort_shards(_dealt_again(data, length) if many else data.drop("large"), length))


def _dealt_again(data: DataFrame, length: int) -> DataFrame:
    """Pieces (m, doc, dk, start, data); those that are ``large`` are cut into pieces by the minimizers of another hash."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            rows = []
            for m, doc, dk, start, piece, large in zip(*(batch[c].tolist() for c in ("m", "doc", "dk", "start", "data", "large"))):
                if not large:
                    rows.append((m, doc, dk, start, piece))
                    continue
                again, _, s, size = pieces_of(np.frombuffer(piece, dtype=np.uint8), length, np.zeros(0, np.uint64), int(_ODD[1]))
                both = mix64(again * _ODD[2] + np.int64(m).astype(np.uint64)).view(np.int64)
                rows += [(k, doc, dk, start + a, piece[a : a + n]) for k, a, n in zip(both.tolist(), s.tolist(), size.tolist())]
            yield pd.DataFrame(rows, columns=["m", "doc", "dk", "start", "data"])

    return data.mapInPandas(deal, "m long, doc long, dk long, start int, data binary")


def _merge(pairs: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _marked(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, KeyFilter]:
    """Byte ranges per document (doc, dk, at: array of s and e), and which digests may have some."""
    spans = repeats(docs, length=length, id_col=id_col, text_col=text_col)
    marks = materialize(spans.groupBy("doc", "dk").agg(F.collect_set(F.struct("s", "e")).alias("at")), "suffix-marks")
    return marks, KeyFilter(marks.select("dk"), "dk")


def digest(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    marks, known = _marked(docs, length, id_col, text_col)
    # The flag is calculated once, before the rows part.
    named = _named(docs, id_col, text_col).withColumn("flag", known.test("dk"))
    clean = named.where("NOT flag").select("doc", F.length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, at in released(batches):
            rows = []
            for t, spans in zip(text, at):
                merged = _merge([(x["s"], x["e"]) for x in spans]) if spans is not None else []
                sha, last = hashlib.sha256(), 0
                for s, e in merged:
                    sha.update(t[last:s])
                    last = e
                sha.update(t[last:])
                rows.append((len(t), sum(e - s for s, e in merged), len(merged), sha.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = named.where("flag").join(marks, ["doc", "dk"], "left").select("doc", cut("text", "at").alias("r")).select("doc", "r.*")
    both = clean.unionByName(marked)
    return both.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the texts; a character that is cut in part goes as a whole. All columns are kept."""
    marks, known = _marked(docs, length, id_col, text_col)
    key, order, flag = [_unused(docs, n) for n in ("_dk", "_doc", "_flag")]
    text = F.col(text_col)
    source = docs.withColumn(key, F.xxhash64(F.coalesce(text, F.lit("")).cast("binary"))).withColumn(flag, known.test(key))
    source = source.withColumn(order, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, at in released(batches):
            out = []
            for t, spans in zip(texts, at):
                if spans is None or t is None:
                    out.append(t)
                    continue
                raw, parts, last = t.encode(), [], 0
                for s, e in _merge([(x["s"], x["e"]) for x in spans]):
                    parts.append(raw[last:s].decode("utf-8", "ignore"))
                    last = e
                parts.append(raw[last:].decode("utf-8", "ignore"))
                out.append("".join(parts))
            yield pd.Series(out, dtype=object)

    at = _unused(docs, "_at")
    named = marks.select(F.col("doc").alias(order), F.col("dk").alias(key), F.col("at").alias(at))
    marked = source.where(F.col(flag)).join(named, [order, key], "left").withColumn(text_col, cut(text, F.col(at)))
    return source.where(~F.col(flag)).select(*docs.columns).unionByName(marked.select(*docs.columns))


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name
