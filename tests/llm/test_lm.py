import math
import zlib
from collections import Counter

import numpy as np

from covergraph.llm import lm_scoring as M
from covergraph.llm import queries


def words(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in (text or "").encode().decode().replace("\x0b", " ").replace("\x0c", " ").translate(dict.fromkeys(map(ord, "\t\n\r"), " ")).split(" ") if w] + ["</end>"]


def test_base_score_equals_counts(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    count = Counter()
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update(words(r.text))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.op7_lm_scoring(spark, sf).collect()}
    for r in docs:
        w, g = words(r.text), got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(g.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert g.score < 0 and math.isfinite(g.score)


def test_a_small_head_gives_the_same(spark, plain):
    rows = [(i, "the cat " * (i % 5) + f"rare{i}", "en", "a", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, plain)
    one = M.score(docs, *M.fit(docs, rounds=5)).orderBy("doc_id").collect()
    two = M.score(docs, *M.fit(docs, rounds=5, head_words=2)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_known) for r in one] == [(r.doc_id, r.n_known) for r in two]
    assert np.allclose([r.base_score for r in one], [r.base_score for r in two])


def tiny(seed=0):
    rng = np.random.default_rng(seed)
    m = M.Attention(20, rng)
    m.starts = rng.random(20) < 0.4
    m.starts[[M.END, M.OTHER_START]], m.starts[M.OTHER] = True, False
    m.class_of = np.where(m.starts, rng.integers(0, M.STARTS, 20), rng.integers(M.STARTS, M.STARTS + M.INNER, 20))
    for n in ("bias", "b1", "b2"):
        m.w[n] = rng.standard_normal(m.w[n].shape).astype(np.float32)
    return m


def power(x):
    """2**x, linear between whole exponents."""
    return 2.0 ** np.floor(x) * (1 + x - np.floor(x))


def plain(m, text):
    """log2 of class given kind and of kind, id by id."""
    w, out = {n: p.astype(float) for n, p in m.w.items()}, []
    fed = np.concatenate([[M.START], text[:-1]])
    for i, target in enumerate(text):
        block = i // M.STRIDE * M.STRIDE
        low = max(0, block - (M.WINDOW - M.STRIDE))
        e = w["emb"][fed[low : i + 1]]
        place = low - block + M.WINDOW - M.STRIDE
        s = (e @ w["k"]) @ (e[-1] @ w["q"]) * M.WIDTH**-0.5 + w["bias"][i - block, place : place + len(e)]
        a = power(s / np.log(2))
        h = np.maximum(np.concatenate([e[-1], (a / a.sum()) @ (e @ w["v"])]) @ w["w1"] + w["b1"], 0)
        o = h @ w["w2"] + w["b2"]
        start = bool(m.starts[target])
        p = power((o[: M.STARTS] if start else o[M.STARTS : -1]) / np.log(2))
        kind = 1 / (1 + np.exp(-o[-1]))
        out.append((np.log2(p[m.class_of[target] - (0 if start else M.STARTS)] / p.sum()), np.log2(kind if start else 1 - kind)))
    return np.array(out).T


def test_each_id_is_scored_once_in_its_window():
    m, rng = tiny(), np.random.default_rng(1)
    counts = np.array([1, 5, M.STRIDE, M.STRIDE + 1, M.WINDOW, M.WINDOW + 1, 200])
    own = rng.integers(0, 20, counts.sum()).astype(np.int32)
    for batch in (128, 2):
        forward = m.ready()
        forward.BATCH = batch
        got = forward(own, counts)
        want = np.concatenate([plain(m, t) for t in np.split(own, np.cumsum(counts)[:-1])], axis=1)
        assert np.allclose(got, want, atol=1e-3)


def test_exponents_are_kept_inside_floats():
    m = tiny()
    m.w["q"] *= 1000
    m.w["w2"] *= 1000
    own = np.random.default_rng(4).integers(0, 20, 100).astype(np.int32)
    assert all(np.isfinite(x).all() and (x <= 1e-6).all() for x in m.logs(own, np.array([100])))


def test_later_ids_do_not_matter():
    m = tiny()
    x = np.random.default_rng(2).integers(4, 20, 60).astype(np.int32)
    y = x.copy()
    y[40:] = 5
    assert np.allclose(np.array(m.logs(x, np.array([60])))[:, :40], np.array(m.logs(y, np.array([60])))[:, :40], atol=1e-5)


def test_training_lowers_the_loss(spark):
    m = tiny()
    m.raw_to_own = (np.arange(8) + 4).astype(np.int32)
    m.raw_to_own[-1] = M.END
    m.log_share = np.zeros(20)
    own = np.tile([4, 5, 6, 7, 8, 9], 300).astype(np.int32)
    x = np.stack([own[i : i + M.WINDOW] for i in range(0, 1600, 7)])
    y = np.stack([own[i + M.WINDOW - M.STRIDE + 1 :][: M.STRIDE] for i in range(0, 1600, 7)])
    before = sum(a.mean() for a in m.logs(own[:120], np.array([120])))
    m.train((x, y, np.zeros(len(x), bool)), np.random.default_rng(3).integers(0, len(x), 150 * 16), 16, 0.01)
    assert sum(a.mean() for a in m.logs(own[:120], np.array([120]))) > before + 1


def test_windows_of_training():
    m = tiny()
    path = M.default_vocabulary()
    sub = M.Subwords.of(path)
    m.raw_to_own = np.full(sub.size + 1, 7, np.int32)
    m.raw_to_own[-1] = M.END
    texts = [b" ".join(b"a" for _ in range(n)) for n in (0, 5, M.SPAN, 200)]
    x, y, first = M._windows(texts, 1, sub, m)
    # Every id of a text is a target once, where each word is one id; the first block of a later span is context.
    assert (y == M.END).sum() == 4 and (y == 7).sum() == 5 + M.SPAN + 200
    assert (x[first, M.STRIDE] == M.START).all() and first.sum() == 4
    some = [M._spans([bytes([65 + i % 26]) * (i + 1) + b" x" * 3000 for i in range(200)], n)[0] for n in (1, 4)]
    assert abs(len(some[1]) / len(some[0]) - 0.25) < 0.02


def test_words_are_a_distribution():
    """Spelled and counted words of a start add up to what the classes of words have."""
    m = tiny()
    m.log_share = np.log2(1 / np.bincount(m.class_of, minlength=M.STARTS + M.INNER)[m.class_of])
    # From a start mark: all chains of one or two ids and an end.
    total = 0.0
    starts, inner = [i for i in range(20) if m.starts[i] and i != M.END], [i for i in range(20) if not m.starts[i]]
    left = np.full(M.STARTS, 1.0)
    forward = m.ready()
    known = {m.class_of[i] for i in [*starts, M.END]}
    for a in starts:
        for chain in [[a], *([a, b] for b in inner)]:
            ids = np.array([*chain, M.END], np.int32)
            k, cls, spelled = M.word_logs(forward, m, left, ids, np.array([len(ids)]), np.array([len(chain), 1]))
            assert k[0] in known and spelled[1] == m.log_share[M.END]
            total += 2.0 ** (cls[0] + spelled[0])
    assert 0 < total < 1


def test_odd_rows_and_empty_tables(spark, odd, plain):
    got = M.score(odd, *M.fit(odd, rounds=3)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and by[2].n_tokens == 1 and by[1].n_tokens == 1 and by[3].n_tokens == 4 and by[4].n_tokens == 40_002
    empty = spark.createDataFrame([], plain)
    scorer, tail = M.fit(empty, rounds=2)
    assert M.score(empty, scorer, tail).count() == 0
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in M.score(odd, scorer, tail).collect())


def test_tail_words_have_their_frequency_in_the_score(spark, plain):
    docs = spark.createDataFrame([(i, "the cat " * (i % 5) + f"rare{i}", "en", "a", 1) for i in range(40)], plain)
    one, two = ([r.score for r in M.score(docs, *M.fit(docs, rounds=5, head_words=n)).orderBy("doc_id").collect()] for n in (1 << 19, 2))
    assert np.allclose(one, two)


def test_what_trains_the_model_grows_with_the_rows(spark, plain):
    docs = spark.createDataFrame([(i, f"red{i % 7} green blue " * 400, "en", "a", 1) for i in range(60)], plain).coalesce(1)
    held = [M.fit(docs, rounds=1, sample_chars=n, batch=1, every=1)[0] for n in (1, 1_000_000)]
    for scorer in held:
        m, sub = scorer.model, M.Subwords.of(scorer.path)
        ids, counts, _ = M._own_ids([b"red1 green blue".split() * 100], sub, m)
        cls, kind = m.logs(ids, counts)
        assert (cls + kind + m.log_share[ids]).mean() > -3.5
    assert (held[0].model.class_of == held[1].model.class_of).all()


def test_counted_words_have_discounted_shares(spark, plain):
    docs = spark.createDataFrame([(i, "the cat " * (i % 5) + f"rare{i}", "en", "a", 1) for i in range(40)], plain)
    scorer, tail = M.fit(docs, rounds=2, head_words=2)
    total = np.zeros(M.STARTS)
    classed = M._classed(M._count_words(docs.selectExpr("CAST(text AS binary) text")), scorer.path, scorer.model).collect()
    for r in classed:
        total[r.k] += max(0, r.c - scorer.discount[min(r.c, 3)]) / scorer.size[r.k]
    used = scorer.size > 0
    assert np.allclose(total[used] + scorer.left[used], 1) and (scorer.left[~used] == 1).all()
    assert tail.count() == 41 and all(0 <= r.p < 1 for r in tail.collect())


def test_windows_overlap_by_half():
    assert 2 * M.STRIDE <= M.WINDOW


def test_words_are_cut_one_like_all():
    sub = M.Subwords.of(M.default_vocabulary())
    plain = ["the", "blorvex", "don't", "'s", "x1_2", "\u00e9\u00e9", "\u4e2d\u6587", "\U0001f600!", "1,000", "a" * 300, "--", "\x00"]
    odd = ["a\u00a0b", "\u00a0", "x\u2003", "\u2003y", "z\x85"]
    for words in (plain, odd, plain + odd, odd + plain, ["", "end"], []):
        raw = [w.encode() for w in words]
        ids, length = sub.cut(raw)
        one = [sub.cut([w]) for w in raw]
        assert length.tolist() == [len(i) for i, _ in one] and ids.tolist() == [k for i, _ in one for k in i]
        assert len(ids) == length.sum()


def test_every_window_of_learning_rows_trains(spark, plain):
    # Texts whose hashes would leave them out where one span in 16 trains.
    texts = [t for t in ("red green blue " * 15 + f"x{i}" for i in range(400)) if M.xxhash.xxh64_intdigest(t) % 16]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], plain).coalesce(1)
    scorer = M.fit(docs, rounds=1, sample_chars=1, batch=1)[0]
    m, sub = scorer.model, M.Subwords.of(scorer.path)
    ids, counts, _ = M._own_ids([b"red green blue".split() * 15], sub, m)
    cls, kind = m.logs(ids, counts)
    assert (cls + kind)[:-1].mean() > -1


def test_each_row_is_numbered_once_and_whole(spark, odd):
    scorer = M.fit(odd, rounds=1)[0]
    m, sub = scorer.model, M.Subwords.of(scorer.path)
    rows = odd.selectExpr("CAST(coalesce(text, '') AS binary) text", "doc_id id")
    got = M._numbered(rows, scorer.path, m, 1, 5).collect()
    windows = [M._cut_windows(*map(np.frombuffer, r[1:], (np.int16, np.int32, bool, bool))) for r in got]
    targets = np.concatenate([y[y >= 0] for _, y, _ in windows])
    ids, _, _ = M._own_ids([M.words_of(r.text) for r in rows.collect()], sub, m)
    assert sum(first.sum() for _, _, first in windows) == 9 and (np.bincount(targets, minlength=9) == np.bincount(ids, minlength=9)).all()


def test_words_are_cut_once_for_texts_in_turn(monkeypatch):
    m, sub, seen = tiny(), M.Subwords.of(M.default_vocabulary()), Counter()
    m.raw_to_own = (np.arange(sub.size + 1) % 16 + 4).astype(np.int32)
    m.raw_to_own[-1] = M.END
    cut = M.Subwords.cut
    monkeypatch.setattr(M.Subwords, "cut", lambda self, words: seen.update(words) or cut(self, words))
    lots = [[b"the cat sat".split(), []], [b"a cat sat there".split()], [], [[]], [b"caterpillars and the cat".split(), b"blorvex".split()]]
    numbers = M._WordIds(sub, m, lambda words: (np.array([len(w) for w in words]),))
    for most in (1 << 18, 3):
        numbers.MOST = most
        for docs in lots:
            order, ids, counts, each = numbers(docs)
            one = [np.append(m.raw_to_own[cut(sub, d)[0]], M.END) if d else [M.END] for d in docs]
            assert counts.tolist() == [len(i) for i in one] and ids.tolist() == [k for i in one for k in i] and each.sum() == len(ids)
            assert numbers.about[0][order].tolist() == [len(w) for d in docs for w in [*d, b""]]
        if most > 3:
            assert set(seen.values()) == {1}


def some_windows(rng, n):
    x, y = rng.integers(4, 20, (n, M.WINDOW)).astype(np.int16), rng.integers(4, 20, (n, M.STRIDE)).astype(np.int16)
    y[::3, 5:] = -1
    return x, y, rng.random(n) < 0.3


def loss(m, w, windows):
    """Mean loss of the places with a next id, in double precision."""
    x, y, first = windows
    e, half = w["emb"][x], M.WINDOW - M.STRIDE
    s = (e[:, half:] @ w["q"]) @ (e @ w["k"]).transpose(0, 2, 1) * M.WIDTH**-0.5 + w["bias"]
    s = np.where(M._context_mask() & ~(first[:, None, None] & (np.arange(M.WINDOW) < half)), s, -np.inf)
    a = np.exp(s) / np.exp(s).sum(axis=2, keepdims=True)
    o = np.maximum(np.concatenate([e[:, half:], a @ (e @ w["v"])], axis=2) @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]
    starts, inner = (np.log(np.exp(o[:, :, c]).sum(axis=2)) for c in (slice(0, M.STARTS), slice(M.STARTS, -1)))
    start = m.starts[y]
    lost = np.where(start, starts, inner) - np.take_along_axis(o, m.class_of[y][:, :, None], axis=2)[:, :, 0] + np.log1p(np.exp(np.where(start, -1, 1) * o[:, :, -1]))
    return lost[y >= 0].mean()


def test_a_step_follows_the_loss(monkeypatch):
    m, rng, got = tiny(), np.random.default_rng(7), []
    windows, adam = some_windows(rng, 40), M._adam
    w = {n: p.astype(float) for n, p in m.w.items()}
    monkeypatch.setattr(M, "_adam", lambda *of: got.append(of[3].copy()) or adam(*of))
    m.train(windows, np.arange(40), 40, 0.01)
    rest = np.split(got[1], np.cumsum([w[n].size for n in w if n != "emb"])[:-1])
    grad = {"emb": np.zeros_like(w["emb"]), **{n: g.reshape(w[n].shape) for n, g in zip([n for n in w if n != "emb"], rest)}}
    grad["emb"][np.unique(windows[0])] = got[0]
    for n, p in w.items():
        for _ in range(3):
            way = rng.standard_normal(p.shape)
            there, back = (loss(m, {**w, n: p + d * way}, windows) for d in (1e-5, -1e-5))
            assert math.isclose((there - back) / 2e-5, (way * grad[n]).sum(), rel_tol=1e-3, abs_tol=1e-4), n


def test_embeddings_go_on_between_their_batches(monkeypatch):
    m, rng, got = tiny(), np.random.default_rng(8), []
    x, y, first = some_windows(rng, 240)
    # Some ids come in few batches only.
    x[20:200] = np.where(x[20:200] > 9, 4, x[20:200])
    emb, adam = m.w["emb"].astype(float), M._adam
    monkeypatch.setattr(M, "_adam", lambda *of: got.append(of[3].astype(float)) or adam(*of))
    m.train((x, y, first), np.arange(240), 4, 0.01)
    mean, square = np.zeros_like(emb), np.zeros_like(emb)
    for t in range(1, 61):
        grad = np.zeros_like(emb)
        grad[np.unique(x[4 * t - 4 : 4 * t])] = got[2 * t - 2]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        emb -= 0.01 * min(1, t / 7) * (1 - 0.9 * t / 60) * math.sqrt(1 - 0.99**t) / (1 - 0.9**t) * mean / (np.sqrt(square) + 1e-8)
    assert np.allclose(m.w["emb"], emb, atol=1e-4) and list(m.w) == list(tiny().w)


def test_words_of_texts_are_those_of_lists():
    m, sub, rng = tiny(), M.Subwords.of(M.default_vocabulary()), np.random.default_rng(9)
    m.raw_to_own = (np.arange(sub.size + 1) % 16 + 4).astype(np.int32)
    m.raw_to_own[-1] = M.END
    signs = [b"a", b"B", b"\xc3\x89", b"\xff", b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x85", b"\xc2\xa0", b"\x00"]
    texts = [b"".join(signs[i] for i in rng.integers(0, len(signs), n)) for n in rng.integers(0, 12, 300)] + [b"", b" ", b"\n\n"]
    one, two = M._WordIds(sub, m), M._WordIds(sub, m)
    for lot in (texts[:100], [], texts[100:], [b""]):
        for a, b in zip(one.ids(*one.number(lot)), two([M.words_of(t) for t in lot])):
            assert a.tolist() == b.tolist()
