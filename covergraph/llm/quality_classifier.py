"""Quality classifier: a sparse ensemble of rules read off trees, compiled to Spark expressions.

Statistics of the whole text (shares of kinds of characters, repetition, lengths) are the only
inputs. Small trees are grown in NumPy on random rows and statistics; every path from a root is a
rule, a conjunction of comparisons. A lasso logistic regression over the rules, and over the
statistics clipped to their usual range, leaves few with a weight. The result is one arithmetic
expression of WHEN terms, evaluated inside Spark's generated code.

Learning uses a sample of at most about ``sample`` labelled rows, chosen by a hash of the id.

Nulls and empties: a null text is an empty one; all its shares are 0 and it is scored like any
other. Null labels teach nothing; a document with several label rows teaches each of them. With
labels of one kind only, or none, the score is their share (0.5 without any). Repeated rows are scored
each. Texts of any length are read whole. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covergraph.llm._common import released, small_batches
from covergraph.llm.quality_rules import SPACE, pieces, repeat_words

_KINDS = ["upper", "lower", "digit", "space", "newline", "bang", "stop", "symbol", "other"]
STATISTICS = [
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "space_share", "newline_share", "bang_share", "stop_share", "symbol_share",
    "distinct_share", "top_word_share", "same_next_share", "repeat_share", "dup_line_share", "line_words",
]


def _kind(c: str) -> str:
    if c in SPACE:
        return "newline" if c == "\n" else "space"
    if c == "!":
        return "bang"
    if c in ".,;:?'\"()-":
        return "stop"
    if c in string.punctuation:
        return "symbol"
    return "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else "other"


_KIND = np.fromiter((_KINDS.index(_kind(chr(c))) for c in range(0xD800)), dtype=np.int8, count=0xD800)


def statistics_of(texts: list[str | None]) -> pd.DataFrame:
    out = np.zeros((len(texts), len(STATISTICS)))
    for s, e in pieces(texts):
        own = [t or "" for t in texts[s:e]]
        cp = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = np.array([len(t) for t in own])
        doc = np.repeat(np.arange(len(own)), n)
        kind = np.bincount(doc * len(_KINDS) + _KIND[np.minimum(cp, 0xD7FF)], minlength=len(own) * len(_KINDS)).reshape(len(own), -1)
        words = [t.encode("utf-8", "surrogatepass").split() for t in own]
        m = np.array([len(w) for w in words])
        number: dict = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)), dtype=np.int64, count=int(m.sum()))
        owner = np.repeat(np.arange(len(own)), m)
        pair, times = np.unique(owner * (len(number) + 1) + ids, return_counts=True)
        holder = pair // (len(number) + 1)
        top = np.zeros(len(own))
        np.maximum.at(top, holder, times)
        same = np.bincount(owner[1:][(ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])], minlength=len(own))
        lines = [[x for x in t.split("\n") if x.strip(SPACE)] for t in own]
        n_lines = np.array([len(x) for x in lines])
        dup = n_lines - np.array([len(set(x)) for x in lines])
        one, some, line = np.maximum(n, 1), np.maximum(m, 1), np.maximum(n_lines, 1)
        column = dict(zip(_KINDS, kind.T))
        letters = np.maximum(column["upper"] + column["lower"], 1)
        ink = np.maximum(n - column["space"] - column["newline"], 1)
        out[s:e] = np.stack([
            np.log1p(n), np.log1p(m), ink / some, column["upper"] / letters, column["digit"] / ink, column["space"] / one, column["newline"] / one,
            column["bang"] / ink, column["stop"] / ink, column["symbol"] / ink, np.bincount(holder, minlength=len(own)) / some, top / some, same / some,
            repeat_words(words) / some, dup / line, np.log1p(m / line),
        ], axis=1)
    return pd.DataFrame(out, columns=STATISTICS)


def statistics(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in released(batches):
            yield statistics_of(texts.tolist())

    return measure(text)


Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, path: Rule, rules: set[Rule], least: int) -> None:
    """Collects the paths of a tree of least Gini impurity over a random part of the statistics."""
    if path:
        rules.add(path)
    if not depth or len(y) < 2 * least or y.min() == y.max():
        return
    best = None
    for f in rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(v))
        good = (v[1:] > v[:-1]) & (k >= least) & (len(v) - k >= least)
        if not good.any():
            continue
        left, right = c[:-1] / k, (c[-1] - c[:-1]) / (len(v) - k)
        impurity = np.where(good, k * left * (1 - left) + (len(v) - k) * right * (1 - right), np.inf)
        at = int(impurity.argmin())
        if best is None or impurity[at] < best[0]:
            best = (impurity[at], int(f), float((v[at] + v[at + 1]) / 2))
    if best is None:
        return
    _, f, cut = best
    low = x[:, f] <= cut
    _grow(x[low], y[low], depth - 1, rng, _narrow(path, f, True, cut), rules, least)
    _grow(x[~low], y[~low], depth - 1, rng, _narrow(path, f, False, cut), rules, least)


def _narrow(path: Rule, f: int, low: bool, cut: float) -> Rule:
    """A rule with one more comparison; of two on the same side of a statistic the narrower stays."""
    return tuple(sorted([t for t in path if t[:2] != (f, low)] + [(f, low, cut)]))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= c) if low else (x[:, f] > c) for f, low, c in rule])


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the bias is free."""
    n, p = x.shape
    step = 4.0 / (np.linalg.norm(x, 2) ** 2 / n + 1)
    w, b = np.zeros(p), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    u, c, t = w, b, 1.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(x @ u + c, -30, 30))) - y
        new = u - step * (x.T @ off) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias = c - step * off.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / nt * (new - w), bias + (t - 1) / nt * (bias - b)
        w, b, t = new, bias, nt
    return w, b


class RuleEnsemble:
    """weights of rules, and of clipped statistics (low, high, scale), and a bias: log odds of label 1."""

    def __init__(self, rules: list[tuple[Rule, float]], linear: list[tuple[int, float, float, float]], bias: float):
        self.rules, self.linear, self.bias = rules, linear, bias

    @classmethod
    def learn(cls, x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, penalty: float = 0.0005, rounds: int = 600, seed: int = 5) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            share = 0.5 if not len(y) else float(y[0])
            return cls([], [], float(np.log((share + 1e-6) / (1 - share + 1e-6))))
        rng, rules = np.random.default_rng(seed), set()
        for _ in range(trees):
            rows = rng.choice(len(y), size=max(min(len(y), 20), len(y) // 2), replace=False)
            _grow(x[rows], y[rows], depth, rng, (), rules, max(1, len(rows) // 200))
        ordered = sorted(rules)
        on = np.stack([_holds(r, x) for r in ordered], axis=1).astype(float) if ordered else np.zeros((len(y), 0))
        # Rules that hold for the same rows are one.
        _, first = np.unique(np.packbits(on.astype(bool), axis=0), axis=1, return_index=True)
        first = [i for i in np.sort(first) if 0 < on[:, i].mean() < 1]
        low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
        clipped = np.clip(x, low, high)
        spread = np.maximum(clipped.std(axis=0), 1e-9)
        wide = np.flatnonzero(high > low)
        design = np.hstack([on[:, first], 0.4 * (clipped[:, wide] - low[wide]) / spread[wide]])
        w, b = _lasso(design, y, penalty, rounds)
        r = len(first)
        return cls(
            [(ordered[i], float(w[k])) for k, i in enumerate(first) if w[k]],
            [(int(f), float(low[f]), float(high[f]), float(0.4 * w[r + k] / spread[f])) for k, f in enumerate(wide) if w[r + k]], b)

    def column(self, stats: Column) -> Column:
        """The score as an expression over a struct of statistics."""
        value = lambda f: stats[STATISTICS[f]]
        terms = [F.lit(self.bias)]
        for rule, w in self.rules:
            tests = [value(f) <= c if low else value(f) > c for f, low, c in rule]
            terms.append(F.when(reduce(Column.__and__, tests), w).otherwise(0.0))
        for f, low, high, w in self.linear:
            terms.append((F.least(F.greatest(value(f), F.lit(low)), F.lit(high)) - low) * w)
        return 1.0 / (1.0 + F.exp(-reduce(Column.__add__, terms)))


def fit(
    docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 5,
) -> RuleEnsemble:
    """Learns from about ``sample`` of the labelled documents, all if there are no more."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL")
    n = known.count()
    unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(unit < min(1.0, sample / max(n, 1)))
    # At most about ``sample`` rows: small enough for every executor.
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", statistics(F.col("text")).alias("s")).select("id", "y", "s.*").toPandas()
    rows = rows.sort_values(["id", "y", *STATISTICS])
    return RuleEnsemble.learn(rows[STATISTICS].to_numpy(), rows["y"].to_numpy().astype(float), seed=seed)
