"""Language-model scoring with a causal self-attention model trained in NumPy on subword ids.

A text is its words, A-Z in lower case, and one end mark. A word with a space before it is cut into
subword ids by a public byte-level vocabulary, whose path is a parameter. The attention model sees the
ids before a place in its window (embeddings, one head of masked attention with a bias per distance, a
hidden layer) and predicts whether the next id starts a word, its class given that, and by the id's
share of the class the id itself. Windows of ``WINDOW`` ids overlap by half: the first half of a window
is context, each id of the second half is scored, once; batches of windows are scored together.

A word's probability is that of its class times the mixture of two ways to say it, interpolated as in
modified Kneser-Ney smoothing: by its discounted count among the words of the class, or, with the mass that
the discounts leave, spelled id by id until the model expects the next word. Both are learned and the
whole is a distribution over texts. Beside this score stands a base score, add-one word frequencies.

What comes from the corpus: word counts over all learning rows, and from them the discounts and the
frequencies of all ids. All ids of all learning rows, numbered once, give the neighbours that put ids into
classes, and each window of them trains the weights, which start from about ``sample_chars`` characters of
learning rows, chosen by a hash: partitions train apart and are averaged, in ``SLICES`` turns.
Counts of the ``head_words`` most frequent words are broadcast as sorted hash arrays; other words of a
text meet their counts in a join, so the count table may be of any size. Words are joined by 64-bit hash.

Nulls: a null text is an empty one, which has the end mark alone. Repeated rows and ids are scored
each. Without learning rows all counts are 0 and the model is an untrained one. Texts of any length
are scored whole, some megabytes at a time. Ids are whole numbers (or text that reads as such). Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergraph.llm._common import materialize, released, small_batches

WINDOW, STRIDE = 32, 16
WIDTH, HIDDEN = 16, 32
#: Classes of ids that start a word (the end mark has one of its own), of other ids, and how many of each kind are single ids.
STARTS, INNER, SINGLES = 48, 80, 24
#: Ids of the model are kept in 16 bits.
VOCABULARY = 8192
#: Ids whose neighbourhood tells the classes of others; turns after which weights are averaged; words in a span of training; windows trained on at a time.
NEAR, SLICES, SPAN, CHUNK = 200, 4, 64, 1 << 15
#: Ids inside the model: what is not in its vocabulary, inside a word or at its start, the end mark, the start mark.
OTHER, OTHER_START, END, START = 0, 1, 2, 3
_MARKS = 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end mark among words; no word is empty.
END_WORD = b""
_LOG2E = 1.4426950408889634
#: Splits text as byte-level vocabularies do; a single word with a space before it is rarely cut by it.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Subwords:
    """Ids of words from a file of ranks."""

    _known: dict[str, Subwords] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        #: Ids that begin with a space stand at the start of a word and nowhere else; the place after the last id is the end mark's.
        self.starts = np.zeros(self.size + 1, bool)
        self.starts[[v for k, v in ranks.items() if k[:1] == b" "] + [self.size]] = True
        self._encode = tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str) -> Subwords:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, each with a space before it, and how many each has; the end mark has one."""
        text = b"".join(b" " + w if w else b"" for w in words).decode("utf-8", "replace")
        plain = len(text.split()) == sum(map(bool, words))
        if plain and all(words):
            # Words are cut together: white space inside none of them joins it to its neighbour.
            ids = np.array(self._encode(text), np.int64)
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(words):
                return ids, np.diff(np.append(at, len(ids)))
        single = [self._encode(" " + w.decode("utf-8", "replace")) if w else [self.size] for w in words]
        return np.fromiter(chain.from_iterable(single), np.int64), np.array([len(x) for x in single], np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def _all_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of binary texts in turn, those of ``words_of``, and how many each text has."""
    # The view is not checked for being UTF-8, and what is done to it regards ASCII alone.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    words, edges = lists.flatten().view(pa.binary()), lists.offsets.to_numpy().astype(np.int64)
    # White space at the ends of a text leaves empty words.
    full = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64))
    return words.filter(full) if before[-1] < len(words) else words, np.diff(before[edges])


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _context_mask() -> np.ndarray:
    """(STRIDE, WINDOW): which places of a window each scored place may see."""
    return np.tril(np.ones((WINDOW, WINDOW), bool))[WINDOW - STRIDE :]


class Attention:
    """The model: weights, and per id of its vocabulary its kind (starts a word), class and share of the class."""

    def __init__(self, vocabulary: int, rng: np.random.Generator):
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        classes = STARTS + INNER
        self.w = {
            "emb": (0.3 * rng.standard_normal((vocabulary, WIDTH))).astype(np.float32), "bias": np.zeros((STRIDE, WINDOW), np.float32),
            "q": f(WIDTH, WIDTH), "k": f(WIDTH, WIDTH), "v": f(WIDTH, WIDTH), "w1": f(2 * WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            # The last column tells whether a word starts.
            "w2": f(HIDDEN, classes + 1), "b2": np.zeros(classes + 1, np.float32),
        }
        self.starts = np.zeros(vocabulary, bool)
        self.class_of = np.zeros(vocabulary, np.int64)
        self.log_share = np.zeros(vocabulary)
        self.raw_to_own = np.zeros(1, np.int32)

    def train(self, windows: tuple[np.ndarray, np.ndarray, np.ndarray], order: np.ndarray, batch: int, rate: float) -> None:
        """Adam over ``order`` of windows (input ids (n, WINDOW), next ids of the second halves or -1, whether the first half is void)."""
        x_all, y_all, first_all = windows
        # Weights other than embeddings and what belongs to each lie in one array, of which parts are seen by name.
        emb, names = self.w["emb"].copy(), [n for n in self.w if n != "emb"]
        cut = np.cumsum([self.w[n].size for n in names])[:-1]
        named = lambda a: {n: part.reshape(self.w[n].shape) for n, part in zip(names, np.split(a, cut))}
        weights = np.concatenate([self.w[n].ravel() for n in names])
        mean, square, grad = (np.zeros_like(weights) for _ in range(3))
        w, g, seen = named(weights), named(grad), _context_mask().astype(np.float32)
        scale, half, ones = np.float32(WIDTH**-0.5), WINDOW - STRIDE, np.ones(max(WINDOW, STRIDE * batch), np.float32)
        rounds = -(-len(order) // batch)
        # Embeddings of ids outside a batch go on by their mean alone; that is made up when they come again: they lag behind by some
        # steps, over which mean and square shrink by powers and the weights go by a sum of shrinking steps.
        lag, e_mean, e_square, there, place = np.zeros(len(emb), np.int64), np.zeros_like(emb), np.zeros_like(emb), np.zeros(len(emb), bool), np.zeros(len(emb), np.int64)
        t = np.arange(1, rounds + 1)
        steps = rate * np.minimum(1.0, t / min(100, 1 + rounds // 10)) * (1 - 0.9 * t / rounds) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        ratio, ahead = 0.9 / np.sqrt(0.99), np.zeros(rounds + 1)
        for t in range(rounds - 1, -1, -1):
            ahead[t] = ratio * (steps[t] + ahead[t + 1])
        shrink = [r ** np.arange(rounds + 1) for r in (0.9, 0.99, ratio)]

        def caught_up(ids: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Embeddings after step ``t`` without a gradient since they came last, their means and squares."""
            late = t - lag[ids]
            by_mean, by_square, by_ratio = (s.take(late) for s in shrink)
            way = (ahead.take(t - late) - by_ratio * ahead[t]).astype(np.float32)[:, None]
            m, s = e_mean.take(ids, axis=0), e_square.take(ids, axis=0)
            out = _ratio(m, s)
            out *= way
            np.subtract(emb.take(ids, axis=0), out, out=out)
            m *= by_mean.astype(np.float32)[:, None]
            s *= by_square.astype(np.float32)[:, None]
            return out, m, s

        # Per id, and last where there is none: which softmax tells it (2: none) and its place there; places of an embedding's weights.
        head = np.append(np.where(self.starts, 0, 1), 2).astype(np.int8)
        column = np.append(self.class_of - np.where(self.starts, 0, STARTS), 0)
        cells, firsts = np.arange(emb.size).reshape(emb.shape), np.arange(STRIDE * batch)
        heads = slice(0, STARTS), slice(STARTS, STARTS + INNER)
        for t in range(1, rounds + 1):
            at = order[(t - 1) * batch : t * batch]
            x, y, n = x_all.take(at, axis=0).astype(np.int64), y_all.take(at, axis=0).reshape(-1), len(at)
            # Places in order of their softmax; those without a next id come last and stay 0.
            heads_of = head.take(y, mode="wrap")
            rows = heads_of.argsort(kind="stable")
            ends = np.append(0, np.bincount(heads_of, minlength=3).cumsum())
            target, share = column.take(y.take(rows), mode="wrap"), np.float32(1 / max(1, ends[2]))
            there[x] = True
            ids = np.flatnonzero(there)
            there[ids] = False
            place[ids] = np.arange(len(ids))
            x = place.take(x)
            some, some_mean, some_square = caught_up(ids, t - 1)
            e = some.take(x, axis=0)
            own = np.ascontiguousarray(e[:, half:])
            flat, flat_own = e.reshape(-1, WIDTH), own.reshape(-1, WIDTH)
            query, key_value = w["q"] * scale, np.concatenate([w["k"], w["v"]], axis=1)
            q = (flat_own @ query).reshape(own.shape)
            kv = (flat @ key_value).reshape(n, WINDOW, 2 * WIDTH)
            k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
            # Shares of attention are left unscaled; the sums divide what comes of them.
            a = _exp(q @ k.transpose(0, 2, 1).copy())
            a *= np.exp(np.clip(w["bias"], -20, 20)) * seen
            a[first_all[at], :, :half] = 0
            per = 1 / (a.reshape(-1, WINDOW) @ ones[:WINDOW])[:, None]
            both = np.empty((n * STRIDE, 2 * WIDTH), np.float32)
            both[:, :WIDTH] = flat_own
            z = np.multiply((a @ v).reshape(-1, WIDTH), per, out=both[:, WIDTH:])
            h = both @ w["w1"]
            h += w["b1"]
            alive = h > 0
            h *= alive
            h_of = h.take(rows, axis=0)
            # Odds of the kind that came, then of its classes.
            to_kind = np.ascontiguousarray(w["w2"][:, -1])
            d_kind = 1 / (1 + np.exp(-np.clip(h_of @ to_kind + w["b2"][-1], -30, 30)))
            d_kind[: ends[1]] -= 1
            d_kind *= share
            d_kind[ends[2] :] = 0
            g["w2"][:, -1], g["b2"][-1] = d_kind @ h_of, d_kind.sum()
            dh_of = d_kind[:, None] * to_kind
            for low, high, of in zip(ends, ends[1:], heads):
                w_of, more = w["w2"][:, of], np.exp(np.clip(w["b2"][of], -20, 20))
                h_in = h_of[low:high]
                p = _exp(h_in @ w_of)
                total = p @ more
                p.reshape(-1)[firsts[: high - low] * p.shape[1] + target[low:high]] -= total / more.take(target[low:high])
                total = share / total
                g["b2"][of] = (total @ p) * more
                h_in *= total[:, None]
                g["w2"][:, of] = _cross(h_in, p) * more
                d = p @ (w_of * more).T
                d *= total[:, None]
                dh_of[low:high] += d
            dh = np.empty_like(h)
            dh[rows] = dh_of
            dh *= alive
            g["w1"][:], g["b1"][:] = _cross(both, dh), ones[: len(dh)] @ dh
            dz = dh @ w["w1"][WIDTH:].T
            dz *= per
            fall = np.einsum("ij,ij->i", dz, z)
            dz = dz.reshape(own.shape)
            da = dz @ v.transpose(0, 2, 1).copy()
            da -= fall.reshape(n, STRIDE, 1)
            da *= a
            g["bias"][:] = da.sum(axis=0)
            dq = (da @ k).reshape(-1, WIDTH)
            d_kv = np.empty_like(kv)
            np.matmul(da.transpose(0, 2, 1), q, out=d_kv[:, :, :WIDTH])
            np.matmul(a.transpose(0, 2, 1), dz, out=d_kv[:, :, WIDTH:])
            d_kv = d_kv.reshape(-1, 2 * WIDTH)
            both_kv = _cross(flat, d_kv)
            g["q"][:], g["k"][:], g["v"][:] = _cross(flat_own, dq) * scale, both_kv[:, :WIDTH], both_kv[:, WIDTH:]
            de = (d_kv @ key_value.T).reshape(e.shape)
            d_own = dq @ query.T
            d_own += dh @ w["w1"][:WIDTH].T
            de[:, half:] += d_own.reshape(own.shape)
            d = np.zeros_like(some)
            np.add.at(d.reshape(-1), cells.take(x.reshape(-1), axis=0).reshape(-1), de.reshape(-1))
            step = np.float32(steps[t - 1])
            _adam(some, some_mean, some_square, d, step)
            _adam(weights, mean, square, grad, step)
            emb[ids], e_mean[ids], e_square[ids], lag[ids] = some, some_mean, some_square, t
        emb = caught_up(np.arange(len(emb)), rounds)[0]
        self.w = {"emb": emb, **w}

    def ready(self) -> Forward:
        return Forward(self)

    def logs(self, own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each id, log2 of its class's probability given its kind and the ids before it, and log2 of its kind's.

        ``own`` holds the ids of all texts in turn, counts how many each has.
        """
        return self.ready()(own, counts)


def _exp(x: np.ndarray) -> np.ndarray:
    """In place; what would leave floats in a sum is drawn to its bounds."""
    return np.exp(np.clip(x, np.float32(-40), np.float32(40), out=x), out=x)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of tall matrices, a block of rows at a time."""
    m = len(a) // 128 * 128
    out = (a[:m].reshape(-1, 128, a.shape[1]).transpose(0, 2, 1) @ b[:m].reshape(-1, 128, b.shape[1])).sum(axis=0)
    if m < len(a):
        out += a[m:].T @ b[m:]
    return out


def _ratio(mean: np.ndarray, square: np.ndarray) -> np.ndarray:
    out = np.sqrt(square)
    out += np.float32(1e-8)
    return np.divide(mean, out, out=out)


def _adam(weights: np.ndarray, mean: np.ndarray, square: np.ndarray, grad: np.ndarray, step: np.float32) -> None:
    """In place: mean and square follow the gradient, weights go by their ratio."""
    some = grad - mean
    some *= np.float32(0.1)
    mean += some
    np.multiply(grad, grad, out=some)
    some -= square
    some *= np.float32(0.01)
    square += some
    some = _ratio(mean, square)
    some *= step
    weights -= some


#: Exponents of two between which ratios and sums stay inside floats.
_LEAST, _MOST = (np.float32((127 + e) * (1 << 23)) for e in (-55, 55))


def _powers(x: np.ndarray) -> np.ndarray:
    """The bits of powers of two, linear between whole exponents: those of (exponent + 127) * 2**23 as a whole number."""
    if x.size and (x.max() > _MOST or x.min() < _LEAST):
        x = np.clip(x, _LEAST, _MOST)
    return x.astype(np.int32)


class Forward:
    """The model laid out for scoring: tables per id, weights in units of 2**-23 of an exponent of two."""

    BATCH = 128

    def __init__(self, model: Attention):
        w, unit = {n: p.astype(np.float64) for n, p in model.w.items()}, float(1 << 23)
        self.starts, self.class_of = model.starts, model.class_of
        query, key = w["emb"] @ w["q"] * (WIDTH**-0.5 * _LOG2E), w["emb"] @ w["k"]
        bias = w["bias"] * _LOG2E
        self.query = (query * unit).astype(np.float32)
        self.key_value = np.concatenate([key, w["emb"] @ w["v"]], axis=1).astype(np.float32)
        self.bias = ((bias + 127) * unit).astype(np.float32)
        self.seen = np.where(_context_mask(), -1, 0).astype(np.int32)
        # Hidden values end with a one, which adds the bias of the heads.
        one = np.ones((len(w["emb"]), 1))
        self.own = np.concatenate([w["emb"] @ w["w1"][:WIDTH] + w["b1"], one], axis=1).astype(np.float32)
        self.w1 = np.append(w["w1"][WIDTH:], np.zeros((WIDTH, 1)), axis=1).astype(np.float32)
        w2, b2 = w["w2"] * _LOG2E, w["b2"] * _LOG2E
        cut = [slice(0, STARTS), slice(STARTS, STARTS + INNER)]
        self.heads = [(np.vstack([w2[:, c], b2[c] + 127]) * unit).astype(np.float32) for c in cut]
        self.kind = np.append(w2[:, -1], b2[-1]).astype(np.float32)

    def __call__(self, own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blocks = -(-counts // STRIDE)
        begin = (np.cumsum(blocks) - blocks) * STRIDE
        place = np.arange(len(own)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
        n = int(blocks.sum())
        # Inputs with a block before all; what a text predicts at its start follows a start mark.
        x = np.full((n + 1) * STRIDE, END, np.int32)
        x[STRIDE + 1 + place[:-1]] = own[:-1]
        x[STRIDE + begin] = START
        y = np.full(n * STRIDE, -1, np.int32)
        y[place] = own
        first = np.zeros(n, bool)
        first[begin // STRIDE] = True
        cls, kind = np.zeros(n * STRIDE, np.float32), np.zeros(n * STRIDE, np.float32)
        for s in range(0, n, self.BATCH):
            e = min(n, s + self.BATCH)
            at = slice(s * STRIDE, e * STRIDE)
            cls[at], kind[at] = self._some(x[s * STRIDE : (e + 1) * STRIDE], y[at], first[s:e])
        return cls[place], kind[place]

    def hidden(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hidden layer at the places of all blocks of x but the first; a block is seen by itself and the next one."""
        n, half = len(first), WINDOW - STRIDE
        kv = self.key_value.take(x, axis=0)
        rows, cell = kv.strides
        shape, strides = (n, WINDOW, WIDTH), (STRIDE * rows, rows, cell)
        key = np.lib.stride_tricks.as_strided(kv, shape, strides)
        value = np.lib.stride_tricks.as_strided(kv[:, WIDTH:], shape, strides)
        a = self.query.take(x[STRIDE:], axis=0).reshape(n, STRIDE, WIDTH) @ key.transpose(0, 2, 1).copy()
        a += self.bias
        bits = _powers(a)
        bits &= self.seen
        if first.any():
            bits[first, :, :half] = 0
        a = bits.view(np.float32)
        z = a @ value
        z /= (a.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), np.float32)).reshape(n, STRIDE, 1)
        h = z.reshape(-1, WIDTH) @ self.w1
        h += self.own.take(x[STRIDE:], axis=0)
        h *= h > 0
        return h

    def _some(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.hidden(x, first)
        starts = self.starts[y]
        cls = np.zeros(len(y), np.float32)
        for inner, w in enumerate(self.heads):
            at = np.flatnonzero((starts != bool(inner)) & (y >= 0))
            p = _powers(h.take(at, axis=0) @ w).view(np.float32)
            hit = p.reshape(-1).take(np.arange(len(at)) * p.shape[1] + self.class_of.take(y.take(at)) - STARTS * inner)
            cls[at] = np.log2(hit / (p @ np.ones(p.shape[1], np.float32)))
        # log2 of a logistic function, for the kind that came.
        z = h @ self.kind
        z *= np.where(starts, np.float32(1), np.float32(-1))
        return cls, np.minimum(z, 0) - np.log2(1 + np.exp2(-np.abs(z)))


def _classes(keys: np.ndarray, times: np.ndarray, frequency: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A class per id: the end mark and the most frequent ids of each kind have their own, the rest are clustered by their neighbours."""
    n = len(frequency)
    v = np.bincount(keys, weights=times, minlength=n * 2 * NEAR).astype(np.float32).reshape(n, 2 * NEAR)
    out = np.zeros(n, np.int64)
    order = np.argsort(-frequency[_MARKS:], kind="stable") + _MARKS
    for kind, at, end in ((True, 1, STARTS), (False, STARTS, STARTS + INNER)):
        own = order[starts[order] == kind]
        out[own[:SINGLES]] = at + np.arange(len(own[:SINGLES]))
        out[OTHER_START if kind else OTHER] = end - 1
        rest, at = own[SINGLES:], at + SINGLES
        if not len(rest):
            continue
        u = np.sqrt(v[rest] / np.maximum(v[rest].sum(axis=1, keepdims=True), 1))
        centre, weight = u[: end - at].copy(), np.sqrt(frequency[rest] + 1)
        for _ in range(12):
            near = (u @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
            for j in range(len(centre)):
                if (near == j).any():
                    centre[j] = np.average(u[near == j], axis=0, weights=weight[near == j])
        out[rest] = at + near
    return out


class Scorer:
    """What the scan of the texts needs: the model, the head of the word counts, discounts and masses by class, N and V."""

    def __init__(self, model: Attention, hashes: np.ndarray, counts: np.ndarray, discount: np.ndarray, size: np.ndarray, left: np.ndarray, n: int, v: int, path: str):
        self.model, self.hashes, self.counts, self.discount, self.size, self.left = model, hashes, counts, discount, size, left
        self.n, self.v, self.path = n, v, path


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a megabyte, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= 1 << 20:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _count_words(rows: DataFrame) -> DataFrame:
    """(word, c) of all words and end marks."""
    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for batch in released(batches):
            some = _all_words(batch.column(0))[0].value_counts()
            held.append(pa.table({"word": some.field(0), "c": some.field(1)}))
            size, ends = size + len(some), ends + len(batch)
            if size > 400_000:
                held = [merged(held)]
                size = len(held[0])
                if size > 200_000:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if ends:
            held.append(pa.table({"word": pa.array([END_WORD], pa.binary()), "c": pa.array([ends], pa.int64())}))
            yield from merged(held).to_batches()

    return rows.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _id_counts(words: DataFrame, path: str) -> np.ndarray:
    """How often each raw id occurs in all learning words; the last place is the end mark's."""
    size = Subwords.of(path).size

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subwords, total = Subwords.of(path), np.zeros(size + 1, np.int64)
        for batch in released(batches):
            ids, length = subwords.cut(batch["word"].tolist())
            total += np.bincount(ids, weights=np.repeat(batch["c"].to_numpy(), length), minlength=size + 1).astype(np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": at, "c": total[at]})

    out = np.zeros(size + 1, np.int64)
    got = words.select("word", "c").mapInPandas(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toPandas()
    out[got["k"].to_numpy(dtype=np.int64)] = got["c"].to_numpy(dtype=np.int64)
    return out


def _numbered(rows: DataFrame, path: str, model: Attention, every: int, seed: int) -> DataFrame:
    """(slice, ids, counts, begins, ends): as bytes, the model's ids of what trains and of its pieces how many each has and whether it begins and ends its text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _WordIds(Subwords.of(path), shared.value)
        for batch in released(batches):
            texts, turn = batch["text"].tolist(), batch["slice"].to_numpy()
            if every == 1:
                place, sizes = numbers.number(texts)
                edge = np.append(0, np.cumsum(sizes))
            for a, b in _parts(texts):
                if every == 1:
                    own, begins, ends = turn[a:b], np.ones(b - a, bool), np.ones(b - a, bool)
                    _, ids, counts, _ = numbers.ids(place[edge[a] : edge[b]], sizes[a:b])
                else:
                    pieces, begins, ends, own = [], [], [], []
                    for text, k in zip(texts[a:b], turn[a:b]):
                        for words, first, last in _pieces(text, every):
                            pieces.append(words), begins.append(first), ends.append(last), own.append(k)
                    _, ids, counts, _ = numbers(pieces)
                ids, counts, own, begins, ends = ids.astype(np.int16), counts.astype(np.int32), np.array(own), np.array(begins, bool), np.array(ends, bool)
                for k in np.unique(own):
                    there = own == k
                    yield pd.DataFrame({"slice": [k], "ids": [ids[np.repeat(there, counts)].tobytes()], **{n: [x[there].tobytes()] for n, x in (("counts", counts), ("begins", begins), ("ends", ends))}})

    turn = F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(SLICES)).cast("int")
    return rows.select("text", turn.alias("slice")).mapInPandas(run, "slice int, ids binary, counts binary, begins binary, ends binary")


def _neighbours(numbered: DataFrame, model: Attention, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often ids stand before and after the most frequent ones: keys id * 2 * NEAR + column, and counts; the vocabulary bounds their number."""
    column = np.full(len(model.starts), -1)
    column[near] = np.arange(len(near))
    shared = numbered.sparkSession.sparkContext.broadcast(column)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        col = shared.value
        total = np.zeros(len(col) * 2 * NEAR, np.int64)
        for batch in released(batches):
            for ids, counts in zip(batch["ids"], batch["counts"]):
                ids, end = np.frombuffer(ids, np.int16).astype(np.int64), np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)
                inside = np.ones(len(ids), bool)
                inside[np.append(0, end[:-1])] = inside[end - 1] = False
                b = np.flatnonzero(inside)
                for one, other, shift in ((ids[b], ids[b - 1], 0), (ids[b - 1], ids[b], NEAR)):
                    ok = col[other] >= 0
                    np.add.at(total, one[ok] * 2 * NEAR + col[other[ok]] + shift, 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": at, "c": total[at]})

    got = numbered.select("ids", "counts").mapInPandas(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    return got.column("k").to_numpy().astype(np.int64), got.column("c").to_numpy()


def fit(
    learning: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, head_words: int = 1 << 19,
    sample_chars: int = 4_000_000, rounds: int = 2500, epochs: int = 4, every: int = 1, batch: int = 64, rate: float = 0.01, seed: int = 11,
) -> tuple[Scorer, DataFrame]:
    """The scorer, and the table (h, c, p: discounted share of its class) of words whose counts it does not hold.

    The start takes ``epochs`` passes over the sample, ``rounds`` batches at most; then all learning rows train, whatever it took.
    A caller's ``every`` above 1 leaves only one span of ``SPAN`` words in so many to neighbours and training.
    """
    path = vocabulary or default_vocabulary()
    subwords = Subwords.of(path)
    rows = small_batches(learning).select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.col(id_col).alias("id"))
    words = materialize(_count_words(rows), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    raw = _id_counts(words, path)
    rng = np.random.default_rng(seed)

    known = np.argsort(-raw[:-1], kind="stable")[: VOCABULARY - _MARKS]
    known = known[raw[known] > 0]
    model = Attention(len(known) + _MARKS, rng)
    model.raw_to_own = np.where(subwords.starts, OTHER_START, OTHER).astype(np.int32)
    model.raw_to_own[known] = _MARKS + np.arange(len(known))
    model.raw_to_own[-1] = END
    model.starts[_MARKS:] = subwords.starts[known]
    model.starts[[OTHER_START, END]] = True
    frequency = np.zeros(len(known) + _MARKS)
    frequency[_MARKS:], frequency[END] = raw[known], raw[-1]
    rare = raw.copy()
    rare[known] = rare[-1] = 0
    frequency[OTHER], frequency[OTHER_START] = rare[~subwords.starts].sum(), rare[subwords.starts].sum()
    near = (np.argsort(-frequency[_MARKS:], kind="stable") + _MARKS)[:NEAR]
    numbered = materialize(_numbered(rows, path, model, every, seed + 1), "lm-ids")
    model.class_of = _classes(*_neighbours(numbered, model, near), frequency, model.starts)
    # An id's share of its class, add-one; ids outside the vocabulary share theirs evenly.
    per_class = np.bincount(model.class_of, weights=frequency + 1, minlength=STARTS + INNER)
    model.log_share = np.log2((frequency + 1) / per_class[model.class_of])
    model.log_share[[OTHER, OTHER_START]] -= np.log2(len(raw))
    model.w["b2"][:-1] = np.log(per_class + 1) - np.log(per_class.sum() + 1)

    # The sample gives a start; every window of every learning row then trains in one of the slices.
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    unit = F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(unit < min(1.0, sample_chars / max(chars, 1))).select("text").toPandas()["text"].sort_values().tolist()
    start = _windows(sample, 1, subwords, model)
    if len(start[0]):
        model.train(start, np.concatenate([rng.permutation(len(start[0])) for _ in range(epochs)])[: rounds * batch], batch, rate)
    for k in range(SLICES):
        _train_parts(numbered.where(F.col("slice") == k), model, batch, rate / 4 * (1 - k / SLICES), seed + k)

    classed = materialize(_classed(words, path, model), "lm-classed")
    discount, size, left = _masses(classed)
    d = F.element_at(F.array(*[F.lit(float(x)) for x in discount[1:]]), F.least(F.col("c"), F.lit(3)).cast("int"))
    share = F.greatest(F.col("c") - d, F.lit(0.0)) / F.element_at(F.array(*[F.lit(float(max(x, 1))) for x in size]), F.col("k") + 1)
    cut = _cutoff(words, head_words)
    head = classed.where(F.col("c") >= cut).select("h", "c").toArrow()
    h, c = head.column("h").to_numpy().astype(np.int64), head.column("c").to_numpy()
    by = np.argsort(h)
    return Scorer(model, h[by], c[by], discount, size, left, int(n), int(v), path), classed.where(F.col("c") < cut).select("h", "c", share.alias("p"))


def _classed(words: DataFrame, path: str, model: Attention) -> DataFrame:
    """(h, c, k): hash and class of each counted word."""
    shared = words.sparkSession.sparkContext.broadcast((model.raw_to_own, model.class_of))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, cls = shared.value
        subwords = Subwords.of(path)
        for batch in released(batches):
            ids, length = subwords.cut(batch["word"].tolist())
            first = ids[np.cumsum(length) - length]
            h = np.fromiter(map(word_hash, batch["word"]), np.uint64, len(batch)).view(np.int64)
            yield pd.DataFrame({"h": h, "c": batch["c"].to_numpy(), "k": cls[own[first]].astype(np.int32)})

    return words.mapInPandas(run, "h long, c long, k int")


def _masses(classed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, and by class of words the sum of counts and the share that the discounts leave."""
    n = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    got = classed.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v"), *n).toPandas()
    m = [0, *(int(got[f"n{k}"].sum()) for k in (1, 2, 3, 4))]
    y = m[1] / max(1, m[1] + 2 * m[2])
    d = np.array([0.0, *(min(max(k - (k + 1) * y * m[k + 1] / m[k], 0.1), k - 0.1) if m[k] and m[k + 1] else 0.5 for k in (1, 2, 3))])
    size, left = np.zeros(STARTS), np.ones(STARTS)
    at = got["k"].to_numpy(dtype=np.int64)
    size[at] = got["c"]
    more = got["v"] - got["n1"] - got["n2"]
    left[at] = (d[1] * got["n1"] + d[2] * got["n2"] + d[3] * more) / got["c"]
    return d, size, left


def _spans(texts: list[bytes], every: int) -> tuple[list[list[bytes]], list[bool], list[bool]]:
    """One span of words in ``every``, whether it begins its text and whether it ends it; which spans of a text is told by its hash."""
    spans, begins, ends = [], [], []
    for text in texts:
        words = words_of(text)
        for s in range(xxhash.xxh64_intdigest(text) % every * SPAN, len(words) + 1, every * SPAN):
            # Words before it are context; each has an id at least.
            spans.append(words[max(0, s - STRIDE) : s + SPAN])
            begins.append(s == 0)
            ends.append(s + SPAN > len(words))
    return spans, begins, ends


def _pieces(text: bytes, every: int) -> list[tuple[list[bytes], bool, bool]]:
    """Words that train, whether they begin their text and whether they end it: the whole text, or one span in ``every``."""
    return [(words_of(text), True, True)] if every == 1 else list(zip(*_spans([text], every)))


def _windows(texts: list[bytes], every: int, subwords: Subwords, model: Attention) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows to train on, of some texts."""
    pieces = [p for t in texts for p in _pieces(t, every)]
    ids, counts, _ = _own_ids([p[0] for p in pieces], subwords, model)
    return _cut_windows(ids, counts, np.array([p[1] for p in pieces], bool), np.array([p[2] for p in pieces], bool))


def _cut_windows(ids: np.ndarray, counts: np.ndarray, begins: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over the ids of pieces in turn, as scored ones lie; the inputs of neighbours share memory."""
    if not len(counts):
        return np.zeros((0, WINDOW), np.int16), np.zeros((0, STRIDE), np.int16), np.zeros(0, bool)
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    # A piece that does not begin its text has no start mark before it; its first block is context only.
    blocks = -(-counts // STRIDE)
    begin = (np.cumsum(blocks) - blocks) * STRIDE
    place = np.arange(len(ids)) + np.repeat(begin - (ends - counts), counts)
    n = int(blocks.sum())
    x, y = np.full((n + 1) * STRIDE + 1, END, np.int16), np.full(n * STRIDE, -1, np.int16)
    x[STRIDE + 1 + place[:-1]] = ids[:-1]
    x[STRIDE + begin] = START
    y[place] = ids
    y[place[ends - 1][~last]] = -1
    first = np.zeros(n, bool)
    first[begin // STRIDE] = True
    out = np.lib.stride_tricks.sliding_window_view(x[:-1], WINDOW)[::STRIDE], y.reshape(-1, STRIDE), first
    if begins.all():
        return out
    inside = ~first
    inside[begin[begins] // STRIDE] = True
    return tuple(o[inside] for o in out)


def _train_parts(numbered: DataFrame, model: Attention, batch: int, rate: float, seed: int) -> None:
    """One turn over ``numbered``: each partition trains from the same weights, then they are averaged by windows."""
    shared = numbered.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, number, seen = shared.value, TaskContext.get().partitionId(), 0
        # The broadcast copy may serve further tasks of this worker.
        local, rng = Attention(len(own.class_of), np.random.default_rng(0)), np.random.default_rng([seed, number])
        local.w, local.starts, local.class_of, local.raw_to_own = {n: p.copy() for n, p in own.w.items()}, own.starts, own.class_of, own.raw_to_own
        held: list[tuple] = []

        def step() -> int:
            some = tuple(map(np.concatenate, zip(*held)))
            held.clear()
            if len(some[0]):
                local.train(some, rng.permutation(len(some[0])), batch, rate)
            return len(some[0])

        for batch_ in released(batches):
            for row in zip(*(batch_[n] for n in ("ids", "counts", "begins", "ends"))):
                x, y, first = _cut_windows(*map(np.frombuffer, row, (np.int16, np.int32, bool, bool)))
                for a in range(0, len(x), CHUNK):
                    held.append((x[a : a + CHUNK], y[a : a + CHUNK], first[a : a + CHUNK]))
                    if sum(len(h[0]) for h in held) >= CHUNK:
                        seen += step()
        if held:
            seen += step()
        if seen:
            flat = np.concatenate([p.ravel() for p in local.w.values()])
            yield pd.DataFrame({"part": [number], "seen": [seen], "w": [flat.tobytes()]})

    total, mean = 0, np.zeros(sum(p.size for p in model.w.values()))
    for r in materialize(numbered.drop("slice").mapInPandas(learn, "part int, seen long, w binary"), "lm-weights").orderBy("part").toLocalIterator():
        total += r.seen
        mean += (np.frombuffer(r.w, np.float32) - mean) * (r.seen / total)
    if total:
        cut = np.cumsum([p.size for p in model.w.values()])[:-1]
        model.w = {n: m.reshape(p.shape).astype(np.float32) for (n, p), m in zip(model.w.items(), np.split(mean, cut))}


def _cutoff(words: DataFrame, bound: int) -> int:
    """The least count so that at most ``bound`` words have it or more."""
    step = F.when(F.col("c") < 256, F.col("c")).otherwise(F.pow(F.lit(2), F.floor(F.log2("c"))).cast("long"))
    total, cut = 0, 1 << 62
    for r in sorted(words.groupBy(step.alias("c")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r.n
        if total > bound:
            break
        cut = r.c
    return cut


def _own_ids(docs: list[list[bytes]], subwords: Subwords, model: Attention) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's ids of texts in turn, each with its end mark, how many each has, and how many each word has."""
    return _WordIds(subwords, model)(docs)[1:]


class _WordIds:
    """Ids of texts one lot after another: a word is cut when it is first met and held for later lots, until more than ``MOST`` are held."""

    MOST = 1 << 18

    def __init__(self, subwords: Subwords, model: Attention, about: Callable[[list[bytes]], tuple[np.ndarray, ...]] = lambda words: ()):
        self.subwords, self.own, self._about = subwords, model.raw_to_own, about
        self._clear()

    def _clear(self) -> None:
        # Number 0 is the end mark's.
        self._words = pa.array([END_WORD], pa.binary())
        self._ids, self._length = np.array([END], np.int32), np.ones(1, np.int64)
        #: What ``about`` tells of each word, by number.
        self.about = self._about([END_WORD])

    def __call__(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``ids`` gives, of texts that are lists of words."""
        return self.ids(self._numbers(pa.array(chain.from_iterable(docs), pa.binary())), np.array([len(d) for d in docs], np.int64))

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of texts in turn, valid until the next lot, and how many words each text has."""
        words, sizes = _all_words(pa.array(texts, pa.binary()))
        return self._numbers(words), sizes

    def _numbers(self, words: pa.Array) -> np.ndarray:
        if len(self._words) > self.MOST:
            self._clear()
        lot = words.dictionary_encode()
        found, held = pc.index_in(lot.dictionary, value_set=self._words), len(self._words)
        fresh = found.is_null().to_numpy(zero_copy_only=False)
        number = found.fill_null(0).to_numpy().astype(np.int64)
        number[fresh] = held + np.arange(np.count_nonzero(fresh))
        if fresh.any():
            new = lot.dictionary.filter(pa.array(fresh))
            self._words, new = pa.concat_arrays([self._words, new]), new.to_numpy(zero_copy_only=False).tolist()
            flat, length = self.subwords.cut(new)
            self._ids, self._length = np.append(self._ids, self.own[flat]), np.append(self._length, length)
            self.about = tuple(map(np.append, self.about, self._about(new)))
        return number[lot.indices.to_numpy()]

    def ids(self, place: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words of texts in turn, each with its end mark, the model's ids of them, how many ids each text has, and how many each word has."""
        # The end mark follows the words of each text.
        order = np.insert(place, np.cumsum(sizes), 0) if len(sizes) else place
        each = self._length[order]
        at = np.repeat((np.cumsum(self._length) - self._length)[order] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        return order, self._ids[at], np.bincount(doc, weights=each, minlength=len(sizes)).astype(np.int64), each


def word_logs(forward: Forward, model: Attention, left: np.ndarray, ids: np.ndarray, counts: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its class, log2 of the class's probability, and log2 of being spelled given the class (with the mass left to that)."""
    cls, kind = forward(ids, counts)
    at = np.cumsum(each) - each
    k = model.class_of[ids[at]]
    # A word ends where the next one starts; nothing follows the end mark.
    ends = np.where(ids[at] == END, 0.0, np.append(kind[at[1:]], 0))
    inner = cls.astype(np.float64) + kind
    inner[at] = 0
    spelled = np.add.reduceat(inner + model.log_share[ids], at) + ends + np.log2(left[k])
    return k, cls[at].astype(np.float64), spelled


def score(docs: DataFrame, scorer: Scorer, tail: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_tokens, n_known, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s: Scorer = shared.value
        floor, forward = np.log10(s.n + s.v + 1), s.model.ready()
        ten = np.log10(2)

        def about(words: list[bytes]) -> tuple[np.ndarray, ...]:
            """Hashes, whether the head has them, log10 of the count and one, and log2 of the discounted count."""
            hashes = np.fromiter(map(word_hash, words), dtype=np.uint64, count=len(words)).view(np.int64)
            at = np.minimum(np.searchsorted(s.hashes, hashes), max(0, len(s.hashes) - 1))
            there = s.hashes[at] == hashes if len(s.hashes) else np.zeros(len(hashes), bool)
            count = np.where(there, s.counts[at] if len(s.counts) else 0, 0)
            with np.errstate(divide="ignore"):
                return hashes, there, np.log10(count + 1.0), np.log2(np.maximum(count - s.discount[np.minimum(count, 3)], 0))

        numbers = _WordIds(Subwords.of(s.path), s.model, about)
        total = np.log2(np.maximum(s.size, 1))
        key = TaskContext.get().partitionId() << 36
        for batch in released(batches):
            texts = batch["text"].tolist()
            place, all_sizes = numbers.number(texts)
            edge = np.append(0, np.cumsum(all_sizes))
            hashes, there, value, discounted = numbers.about
            for a, b in _parts(texts):
                sizes, rows = all_sizes[a:b], b - a
                order, ids, counts, each = numbers.ids(place[edge[a] : edge[b]], sizes)
                doc = np.repeat(np.arange(rows), sizes + 1)
                base = np.bincount(doc, weights=value[order], minlength=rows) - (sizes + 1) * floor
                n_known = np.bincount(doc, weights=there[order], minlength=rows).astype(np.int64)
                k, cls, spelled = word_logs(forward, s.model, s.left, ids, counts, each)
                counted = discounted[order] - total[k]
                logs = cls + np.logaddexp2(counted, spelled)
                # Words outside the head go on with what spelling gives them.
                left = np.flatnonzero(~there[order])
                cuts = np.searchsorted(doc[left], np.arange(1, rows))
                yield pd.DataFrame({
                    "key": key + np.arange(rows), "id": batch["id"].iloc[a:b].to_numpy(), "n_tokens": sizes + 1, "n_known": n_known,
                    "base_score": base, "score": np.bincount(doc, weights=logs, minlength=rows) * ten,
                    "rest": np.split(hashes[order[left]], cuts), "rest_log": np.split(spelled[left], cuts),
                })
                key += rows

    source = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    scanned = materialize(source.mapInPandas(scan, "key long, id long, n_tokens long, n_known long, base_score double, score double, rest array<long>, rest_log array<double>"), "lm-scanned")
    # A word of the tail gets its count here: log(p + q) is log(q) + log(1 + p / q) for its share p and q, what spelling gives.
    rest = scanned.select("key", F.explode(F.arrays_zip("rest", "rest_log")).alias("r")).select("key", F.col("r.rest").alias("h"), F.col("r.rest_log").alias("log"))
    more = F.log(F.col("p")) - F.col("log") * np.log(2)
    gain = F.when(F.col("p") > 0, F.greatest(more, F.lit(0.0)) + F.log1p(F.exp(-F.abs(more)))).otherwise(0.0)
    added = (
        rest.join(tail, "h").groupBy("key")
        .agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_base"), F.sum(gain / np.log(10)).alias("more_score"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scanned.drop("rest", "rest_log").join(added, "key", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"),
        (F.col("base_score") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"))
