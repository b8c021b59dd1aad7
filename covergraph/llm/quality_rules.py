"""Quality rules: base counts of a text and the perplexity of a modified Kneser-Ney n-gram model.

Base rule. A document fails with fewer than ``min_words`` words, or with more than ``max_repeat``
of its words inside 8-word windows that occur twice or more in it.

Perplexity. The units are code points (12 bits each, rarer ones folded), so the number of distinct
n-grams follows the alphabets rather than the corpus. Python emits (language, n-gram, count) per batch,
Spark adds them up and derives discounts, probabilities and back-off weights of all orders. The
model is one pair of sorted hash arrays (packed n-grams) and values per language, order and kind.
Counts come from all documents that pass the base rule and have few symbols, the reference side of
the corpus. No n-gram is left out: a model of more than ``shard_entries`` entries is dealt into shards
by the two code points before the last, so that all a code point needs lies in one, and texts pass
over one shard at a time; what the shards give is added up.

A document is kept if it passes the base rule and its log perplexity lies in its language's band:
the median of the reference documents plus or minus a width. The width has a part that shrinks with
the length of the text, as short texts scatter more. The spreads of a language with few reference documents
are drawn towards those of all languages, as if ``prior`` documents more had them.

Nulls: a null text has no words and fails the base rule; a null language is a language of its own.
An empty table gives an empty model and no rows; a language without reference documents has no band
and rejects nothing beyond the base rule, and one with a single document keeps it. Texts of any
length are read whole, in pieces. Repeated rows count each time. All columns are kept, none but the
named ones is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covergraph.llm._common import materialize, released, small_batches, xxhash64

ORDER, BITS = 5, 12
#: White space between words, and the symbols that are counted.
SPACE, SYMBOLS = "\t\n\x0b\x0c\r ", "#*$%&|<>"
REPEAT_WINDOW = 8
_PIECE_CHARS = 400_000
#: A table of one row a language is broadcast up to this many rows.
MOST_BROADCAST = 10_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about _PIECE_CHARS characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _PIECE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def repeat_words(docs: list[list[str]]) -> np.ndarray:
    """Per document, its words inside windows of REPEAT_WINDOW words that it has twice or more.

    Windows get exact ids by doubling: a pair of ids of n words is renumbered to an id of 2n words.
    """
    counts = np.array([len(d) for d in docs], dtype=np.int64)
    n, k = int(counts.sum()), REPEAT_WINDOW
    if n < k:
        return np.zeros(len(docs), dtype=np.int64)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(docs)), dtype=np.int64, count=n)
    doc = np.repeat(np.arange(len(docs)), counts)
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    width = 1
    while width < k and len(at):
        ids = ids[: len(ids) - width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(ids, return_inverse=True)[1]
        width *= 2
    if not len(at):
        return np.zeros(len(docs), dtype=np.int64)
    _, inverse, times = np.unique(doc[at] * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
    twice = at[times[inverse] > 1]
    edge = np.bincount(twice, minlength=n + k) - np.bincount(twice + k, minlength=n + k)
    return np.bincount(doc, weights=np.cumsum(edge)[:n] > 0, minlength=len(docs)).astype(np.int64)


def base_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in BASE}
    for s, e in pieces(texts):
        docs = []
        for i in range(s, e):
            t = texts[i] or ""
            docs.append(t.encode("utf-8", "surrogatepass").split())
            out["n_words"][i] = len(docs[-1])
            out["word_chars"][i] = len(t) - sum(map(t.count, SPACE))
            out["n_symbols"][i] = sum(map(t.count, SYMBOLS))
            lines = [x for x in t.split("\n") if x.strip(SPACE)]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_repeat_words"][s:e] = repeat_words(docs)
    return out


def base_failed(c: dict[str, np.ndarray], min_words: int, max_repeat: int) -> np.ndarray:
    return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat * c["n_words"])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end at each code point of the texts, and the text of each. Texts start with padding."""
    pad = "\0" * (ORDER - 1)
    cp = np.frombuffer((pad + pad.join(t.replace("\0", "\1") for t in texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    cp = np.where(cp < 3072, cp, 3072 + cp % 1024)
    packed = np.zeros(len(cp) - ORDER + 1, dtype=np.int64)
    for k in range(ORDER):
        packed = (packed << BITS) | cp[k : k + len(packed)]
    real = cp[ORDER - 1 :] != 0
    return packed[real], np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def count_grams(docs: DataFrame, *, text_col: str, lang_col: str, min_words: int, max_repeat: int, max_symbols: float) -> DataFrame:
    """(lang, gram, c) of the reference documents."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for batch in released(batches):
            texts, langs = batch["text"].tolist(), batch["lang"].tolist()
            c = base_counts(texts)
            good = ~base_failed(c, min_words, max_repeat) & (c["n_symbols"] <= max_symbols * c["word_chars"])
            for s, e in pieces(texts):
                for lang in set(langs[s:e]):
                    own = [texts[i] for i in range(s, e) if good[i] and langs[i] == lang]
                    if own:
                        held.setdefault(lang, []).append(np.unique(grams(own)[0], return_counts=True))
            for lang in [k for k, v in held.items() if sum(len(x[0]) for x in v) > 200_000]:
                held[lang] = [_add(held[lang])]
                if len(held[lang][0][0]) > 150_000:
                    yield _counted(lang, held.pop(lang)[0])
        for lang, parts in held.items():
            yield _counted(lang, _add(parts))

    source = small_batches(docs).select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"))
    return source.mapInPandas(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _add(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def _counted(lang: str, pair) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "gram": pair[0], "c": pair[1]})


class KneserNey:
    """Sorted hash arrays: (language, order) -> packed n-grams and probabilities, contexts and back-off weights."""

    def __init__(self, tables: dict[tuple[str, int, str], tuple[np.ndarray, np.ndarray]]):
        self.tables = tables

    def _get(self, lang: str, order: int, kind: str, keys: np.ndarray, default: float) -> np.ndarray:
        known, values = self.tables.get((lang, order, kind), (None, None))
        if known is None or not len(known):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], default)

    def log2(self, lang: str, packed: np.ndarray) -> np.ndarray:
        """log2 probability of the last code point of each packed n-gram, given those before it."""
        p = np.full(len(packed), 1.0 / (1 << BITS))
        for order in range(1, ORDER + 1):
            g = packed & ((1 << BITS * order) - 1)
            p = self._get(lang, order, "u", g, 0.0) + self._get(lang, order, "b", g >> BITS, 1.0) * p
        return np.log2(np.maximum(p, 1e-12))

    def totals(self, texts: list[str | None], langs: list[str], part: tuple[int, int] = (0, 1)) -> np.ndarray:
        """Bits of each text, over those of its code points that belong to shard ``part``."""
        out = np.zeros(len(texts))
        for s, e in pieces(texts):
            for lang in set(langs[s:e]):
                own = [i for i in range(s, e) if langs[i] == lang and texts[i]]
                if not own:
                    continue
                packed, doc = grams([texts[i] for i in own])
                if part[1] > 1:
                    here = np.flatnonzero(_shard_of(packed >> BITS, part[1]) == part[0])
                    packed, doc = packed[here], doc[here]
                keys, inverse = np.unique(packed, return_inverse=True)
                out[own] = -np.bincount(doc, weights=self.log2(lang, keys)[inverse], minlength=len(own))
        return out

    def bits(self, texts: list[str | None], langs: list[str]) -> np.ndarray:
        """Mean bits per code point of each text, which is its log2 perplexity; 0 for empty texts."""
        return self.totals(texts, langs) / np.maximum([len(t or "") for t in texts], 1)


#: The two code points before the last decide the shard.
_PAIR = (1 << 2 * BITS) - 1


def _shard_of(contexts: np.ndarray, n: int) -> np.ndarray:
    """The shard of n-grams by their context; equal to ``_shard_column``."""
    return (xxhash64(contexts & _PAIR).view(np.int64) % n).astype(np.int64)


def _shard_column(context, n: int):
    return F.pmod(F.xxhash64(context.bitwiseAND(_PAIR)), F.lit(n))


class Model:
    """The fitted tables: per order (lang, gram, u) and (lang, context, b), in shards of bounded size."""

    def __init__(self, orders: dict[int, tuple[DataFrame, DataFrame]], shards: int):
        self.orders, self.shards = orders, shards

    def shard(self, k: int) -> KneserNey:
        """Sorted hash arrays of one shard; orders whose contexts are shorter than two code points are in all of them."""
        tables: dict[tuple[str, int, str], tuple] = {}
        for order, (u, back) in self.orders.items():
            for kind, frame, key, value, context in (("u", u, "gram", "u", F.shiftright("gram", BITS)), ("b", back, "context", "b", F.col("context"))):
                if self.shards > 1 and order > 2:
                    frame = frame.where(_shard_column(context, self.shards) == k)
                got = frame.select("lang", F.col(key).alias("k"), F.col(value).cast("float").alias("v")).toArrow()
                langs = got.column("lang").combine_chunks().dictionary_encode()
                code, keys, values = langs.indices.to_numpy(zero_copy_only=False), got.column("k").to_numpy(), got.column("v").to_numpy()
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    own = code == i
                    by = np.argsort(keys[own])
                    tables[lang, order, kind] = keys[own][by], values[own][by]
        return KneserNey(tables)


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts by language from the counts of counts."""
    n = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    d = [
        F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1)), F.lit(k - 0.1)))
        .otherwise(F.lit(0.5)).alias(f"d{k}") for k in (1, 2, 3)
    ]
    return counts.groupBy("lang").agg(*n).select("lang", *d)


def fit(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_words: int = 20, max_repeat: int = 30,
    max_symbols: float = 0.02, shard_entries: int = 4_000_000,
) -> Model:
    """The model of all reference documents, in shards of about ``shard_entries`` n-grams and contexts."""
    counts = materialize(count_grams(docs, text_col=text_col, lang_col=lang_col, min_words=min_words, max_repeat=max_repeat, max_symbols=max_symbols), "kn-counts")
    orders, entries = {}, 0
    for order in range(ORDER, 0, -1):
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        u = (
            few_rows(counts, _discounts(counts), "lang").withColumn("context", F.shiftright("gram", BITS))
            .withColumn("u", (F.col("c") - d) / F.sum("c").over(Window.partitionBy("lang", "context"))).select("lang", "gram", "context", "u")
        )
        u = materialize(u, f"kn-u{order}")
        back = materialize(u.groupBy("lang", "context").agg((1 - F.sum("u")).alias("b")), f"kn-b{order}")
        orders[order] = u, back
        entries += u.count() + back.count()
        if order > 1:
            # Lower orders count the distinct code points to the left.
            counts = materialize(counts.groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1).alias("gram")).agg(F.count("*").alias("c")), f"kn-counts{order - 1}")
    return Model(orders, 1 + entries // shard_entries)


def few_rows(rows: DataFrame, by_lang: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row a language; it is broadcast as long as there are few languages."""
    by_lang = materialize(by_lang, "by-language")
    return rows.join(F.broadcast(by_lang) if by_lang.count() <= MOST_BROADCAST else by_lang, key, how)


def score(
    docs: DataFrame, model: Model, *, out: str = "quality", text_col: str = "text", lang_col: str = "lang", min_words: int = 20, max_repeat: int = 30,
) -> DataFrame:
    """``docs`` with a struct column ``out``: the base counts, base_failed, and bits (log2 perplexity)."""
    share = docs.sparkSession.sparkContext.broadcast
    lang = F.coalesce(F.col(lang_col), F.lit(""))
    shared = share(model.shard(0)) if model.shards == 1 else None
    kinds = ", ".join([*(f"{k}: bigint" for k in BASE), "base_failed: boolean", "bits: double"])

    @F.pandas_udf(f"struct<{kinds}>")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang in released(batches):
            texts = text.tolist()
            c = base_counts(texts)
            bits = shared.value.bits(texts, lang.tolist()) if shared else np.zeros(len(texts))
            yield pd.DataFrame({**c, "base_failed": base_failed(c, min_words, max_repeat), "bits": bits})

    docs = small_batches(docs)
    if shared:
        return docs.withColumn(out, measure(F.col(text_col), lang))
    # Rows get a key that is written down, and pass over each shard.
    key, total = (_unused(docs, n) for n in ("_row", "_total"))
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "quality-keyed")
    sums = None
    for k in range(model.shards):
        some = _totals(share(model.shard(k)), k, model.shards)
        part = materialize(keyed.select(key, some(F.col(text_col), lang).alias(total)), "quality-part")
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy(key).agg(F.sum(total).alias(total))
    mean = F.col(total) / F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1))
    return keyed.withColumn(out, measure(F.col(text_col), lang)).join(sums, key).withColumn(out, F.col(out).withField("bits", mean)).drop(key, total)


def _totals(shared, k: int, n: int):
    """The bits of texts that one of n shards gives."""
    @F.pandas_udf("double")
    def some(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, lang in released(batches):
            yield pd.Series(shared.value.totals(text.tolist(), lang.tolist(), (k, n)))

    return some


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name


def bands(scored: DataFrame, *, out: str = "quality", lang_col: str = "lang", max_symbols: float = 0.02, spread: float = 6.0, prior: int = 50, least_width: float = 0.1) -> DataFrame:
    """Per language (band_lang) the middle and the half widths of its band, from its reference documents.

    The half width at n code points is wide + narrow / sqrt(n): ``spread`` robust standard deviations
    of the log perplexity of long texts, and of the scatter of short ones; wide is at least ``least_width``.
    Both deviations are means of the language's own, weighted by its documents, and that of all languages, by ``prior``.
    """
    q = F.col(out)
    reference = scored.where(~q["base_failed"] & (q["n_symbols"] <= max_symbols * q["word_chars"])).select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("band_lang"), q["bits"].alias("bits"), q["word_chars"].alias("n"))
    middle = reference.groupBy("band_lang").agg(F.percentile_approx("bits", 0.5, 10000).alias("middle"), F.count("*").alias("documents"))
    off = few_rows(reference, middle, "band_lang").withColumn("off", F.abs(F.col("bits") - F.col("middle")))
    width = off.groupBy("band_lang").agg(
        F.first("middle").alias("middle"), F.first("documents").alias("documents"),
        F.percentile_approx("off", 0.5, 10000).alias("mad"), F.percentile_approx(F.col("off") * F.sqrt("n"), 0.5, 10000).alias("scatter"))
    every, factor = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), spread * 1.4826

    def drawn(c):
        # One row a language meets in this window.
        pooled = F.sum(F.col(c) * F.col("documents")).over(every) / F.sum("documents").over(every)
        return (F.col(c) * F.col("documents") + pooled * prior) / (F.col("documents") + prior) * factor

    return width.select("band_lang", "middle", F.greatest(drawn("mad"), F.lit(least_width)).alias("wide"), drawn("scatter").alias("narrow"))


def verdict(scored: DataFrame, band: DataFrame, *, out: str = "quality", lang_col: str = "lang") -> DataFrame:
    """``scored`` with the boolean ``kept`` added inside the struct column ``out``."""
    q, key = F.col(out), _unused(scored, "_band_lang")
    names = {c: _unused(scored, f"_{c}") for c in ("middle", "wide", "narrow")}
    band = band.select(F.col("band_lang").alias(key), *[F.col(c).alias(n) for c, n in names.items()])
    width = F.col(names["wide"]) + F.col(names["narrow"]) / F.sqrt(F.greatest(q["word_chars"], F.lit(1)))
    inside = F.coalesce(F.abs(q["bits"] - F.col(names["middle"])) <= width, F.lit(True))
    joined = few_rows(scored.withColumn(key, F.coalesce(F.col(lang_col), F.lit(""))), band, key, "left")
    return joined.withColumn(out, q.withField("kept", ~q["base_failed"] & inside)).drop(key, *names.values())


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    out = _unused(docs, "quality")
    # Scored rows are written once, texts included: the model runs once, and the band is broadcast to them.
    scored = materialize(score(docs, fit(docs), out=out, **options), "quality-scored")
    return verdict(scored, bands(scored, out=out), out=out).where(F.col(f"{out}.kept")).select(*docs.columns)
