import re
import string
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from covergraph.llm import quality_classifier as C
from covergraph.llm import quality_rules as Q
from covergraph.llm import queries

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n#\t\r|é", max_size=120)), max_size=6)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_base_counts_equal_brute_force(texts):
    got = Q.base_counts(texts)
    assert [[int(got[k][i]) for k in Q.BASE] for i in range(len(texts))] == [brute(t) for t in texts]


def test_pieces_do_not_matter(monkeypatch):
    texts = ["a b c d e f g h " * 3, "", None, "x " * 50, "a b c d e f g h"]
    whole = Q.base_counts(texts)
    monkeypatch.setattr(Q, "_PIECE_CHARS", 10)
    assert all((Q.base_counts(texts)[k] == whole[k]).all() for k in Q.BASE)


def model(spark, plain, **options):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    rows = [(i, " ".join(rng.choice(words, 40)), "en", "a", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, plain)
    return docs, Q.fit(docs, max_repeat=100, **options)


def test_kneser_ney_is_a_distribution(spark, plain):
    _, fitted = model(spark, plain)
    kn = fitted.shard(0)
    every = np.arange(1 << Q.BITS, dtype=np.int64)
    for context in ("alph", " bet", "qqqq", "a ga"):
        head = 0
        for c in context:
            head = head << Q.BITS | ord(c)
        assert abs((2 ** kn.log2("en", head << Q.BITS | every)).sum() - 1) < 1e-3


def plain_kneser_ney(texts):
    """The model by its definition: probability of the last of five characters."""
    grams = Counter(("\0\0\0\0" + t)[i : i + 5] for t in texts for i in range(len(t)))
    tables = {}
    for order in range(5, 0, -1):
        n = [sum(c == k for c in grams.values()) for k in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.1) if n[k] and n[k + 1] else 0.5 for k in (1, 2, 3))]
        total = Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
        u = {g: (c - d[min(c, 3)]) / total[g[:-1]] for g, c in grams.items()}
        left = Counter({k: 1.0 for k in total})
        for g, x in u.items():
            left[g[:-1]] -= x
        tables[order] = u, dict(left)
        grams = Counter(g[1:] for g in grams)

    def p(g, order=5):
        if not order:
            return 1 / 4096
        u, left = tables[order]
        own = g[5 - order :]
        return u.get(own, 0.0) + left.get(own[:-1], 1.0) * p(g, order - 1)

    return p


def packed(g):
    out = 0
    for c in g:
        out = out << Q.BITS | ord(c)
    return out


def test_model_equals_definition_in_two_languages(spark, plain):
    rng = np.random.default_rng(4)
    own = {"en": ["alpha", "beta", "gama"], "fr": ["chat", "noir", "été", "x"]}
    rows = [(i, " ".join(rng.choice(own[lang], 25)), lang, "a", 1) for i, lang in enumerate(["en", "fr", "fr", "en"] * 6)]
    kn = Q.fit(spark.createDataFrame(rows, plain), max_repeat=100).shard(0)
    for lang in own:
        p = plain_kneser_ney([r[1] for r in rows if r[2] == lang])
        for g in ["alpha", "\0\0\0\0a", "\0\0\0\0c", "a bet", "chat ", " été ", "zzzzz", "aalph", "x noi", "qrst\x7f"]:
            assert np.isclose(kn.log2(lang, np.array([packed(g)]))[0], np.log2(p(g)), atol=1e-4), (lang, g)


def test_shards_add_up_to_the_whole(spark, plain):
    docs, whole = model(spark, plain)
    _, dealt = model(spark, plain, shard_entries=60)
    assert whole.shards == 1 and dealt.shards > 2
    rest = spark.createDataFrame([(70, None, "en", "a", 1), (71, "", None, "a", 1), (72, "zz \u4e2d\u6587 alpha", "en", "a", 1), (72, "zz", None, None, None)], plain)
    both = docs.unionByName(rest).withColumn("_row", F.lit("x"))
    got, want = (sorted((r.doc_id, r.quality.bits, r.quality.n_words, r._row) for r in Q.score(both, m, max_repeat=100).collect()) for m in (dealt, whole))
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want]) and [x[2:] for x in got] == [x[2:] for x in want]


def test_a_small_language_rejects_junk(spark, plain):
    rng = np.random.default_rng(6)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(80)] for lang, letters in (("en", "abcdefgh"), ("fr", "ijklmnop"))}
    rows = [(i, " ".join(rng.choice(words["en"], 120)), "en", "a", 1) for i in range(80)] + [(100 + i, " ".join(rng.choice(words["fr"], 120)), "fr", "a", 1) for i in range(10)]
    rows += [(200 + k, " ".join("".join(rng.choice(list(letters), 5)) for _ in range(120)), lang, "a", 1) for k, (lang, letters) in enumerate((("en", "abcdefgh"), ("fr", "ijklmnop")))]
    kept = {r.doc_id for r in Q.keep_good(spark.createDataFrame(rows, plain)).collect()}
    assert not kept & {200, 201} and len([i for i in kept if i >= 100]) == 10 and len(kept) >= 88


def test_bands_reject_strange_texts(spark, plain):
    docs, kn = model(spark, plain)
    strange = spark.createDataFrame([(100, " ".join(["zq$x", "xw%z", "qqvv"] * 20), "en", "a", 1), (101, "alpha beta " * 4, "en", "a", 1), (102, None, None, None, None)], plain)
    both = docs.unionByName(strange)
    scored = Q.score(both, kn, max_repeat=100)
    kept = {r.doc_id: r.quality.kept for r in Q.verdict(scored, Q.bands(scored)).collect()}
    assert not kept[100] and not kept[101] and not kept[102] and sum(kept[i] for i in range(60)) >= 58


def test_odd_rows_and_empty_tables(spark, odd, plain):
    out = Q.keep_good(odd)
    assert out.columns == odd.columns and out.count() <= odd.count()
    empty = spark.createDataFrame([], plain)
    assert Q.keep_good(empty).count() == 0
    scored = Q.score(odd, Q.fit(odd), out="q1").select("doc_id", "text", "q1").collect()
    assert [[getattr(r.q1, k) for k in Q.BASE] for r in scored] == [brute(r.text) for r in scored]


def test_query_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op4_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) / len(good) > 0.97


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(C.STATISTICS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] <= 0.5) | (x[:, 8] > 0.9)).astype(float)
    e = C.RuleEnsemble.learn(x, y, trees=20)
    logit = e.bias + sum(w * C._holds(r, x) for r, w in e.rules) + sum((np.clip(x[:, f], low, high) - low) * w for f, low, high, w in e.linear)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *C.STATISTICS])
    got = [r.p for r in rows.select("i", e.column(F.struct(*C.STATISTICS)).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-logit))) and np.mean((np.array(got) > 0.5) == y) > 0.95
    assert 0 < len(e.rules) < 200


def test_classifier_edges(spark, odd, plain):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    e = C.fit(odd, none)
    p = odd.withColumn("st", C.statistics(F.col("text"))).select(e.column(F.col("st")).alias("p")).collect()
    assert len(p) == 9 and all(abs(r.p - 0.5) < 1e-6 for r in p)
    some = spark.createDataFrame([(1, 1, 0), (3, 0, None), (3, 1, 0), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    e = C.fit(odd, some)
    p = odd.withColumn("st", C.statistics(F.col("text"))).select(e.column(F.col("st")).alias("p")).collect()
    assert all(0 <= r.p <= 1 for r in p)
    assert C.fit(spark.createDataFrame([], plain), none).rules == []


def test_text_of_one_language_leaves_another_alone(spark, plain):
    rng = np.random.default_rng(2)
    few, many = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"], ["".join(rng.choice(list("ijklmnop"), 6)) for _ in range(400)]
    small = [(i, " ".join(rng.choice(few, 40)), "en", "a", 1) for i in range(60)]
    more = [(100 + i, " ".join(rng.choice(many, 40)), "fr", "a", 1) for i in range(200)]
    alone, both = (Q.fit(spark.createDataFrame(rows, plain), max_repeat=100).shard(0) for rows in (small, small + more))
    texts = [r[1] for r in small] + ["omega alpha zz"]
    assert np.array_equal(alone.bits(texts, ["en"] * 61), both.bits(texts, ["en"] * 61))


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    kinds = Counter("newline" if c == "\n" else "space" if c in "\t\x0b\x0c\r " else "bang" if c == "!" else "stop" if c in ".,;:?'\"()-" else "symbol" if c in string.punctuation
                    else "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else "other" for c in text)
    n, m = max(len(text), 1), max(len(words), 1)
    ink, letters = max(len(text) - kinds["space"] - kinds["newline"], 1), max(kinds["upper"] + kinds["lower"], 1)
    true_ink = len(text) - kinds["space"] - kinds["newline"]
    return [
        np.log1p(len(text)), np.log1p(len(words)), max(true_ink, 1) / m, kinds["upper"] / letters, kinds["digit"] / ink, kinds["space"] / n, kinds["newline"] / n, kinds["bang"] / ink,
        kinds["stop"] / ink, kinds["symbol"] / ink, len(set(words)) / m, max(Counter(words).values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        brute(text)[4] / m, (len(lines) - len(set(lines))) / max(len(lines), 1), np.log1p(len(words) / max(len(lines), 1)),
    ]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb1! .\n#\t\u00e9\u4e2d|", max_size=150)), max_size=6))
def test_statistics_equal_their_definition(texts):
    got = C.statistics_of(texts)
    assert list(got.columns) == C.STATISTICS
    for i, t in enumerate(texts):
        assert np.allclose(got.iloc[i].to_numpy(), plain_statistics(t)), t
