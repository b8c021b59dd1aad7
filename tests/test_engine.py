from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from covergraph import api
from covergraph.functions.distance import distance
from covergraph.operators import range_join as rj
from covergraph.operators.components import connected_components
from covergraph.operators.landmarks import greedy_from_relation


def points(spark, x):
    return api.from_array(spark, np.asarray(x, dtype=float).reshape(len(x), -1))


def balls(cover, landmarks):
    held = {r.ball_id: [] for r in landmarks.collect()}
    for r in cover.collect():
        held[r.ball_id].append(r.point_id)
    return [sorted(v) for _, v in sorted(held.items())]


def ids(landmarks):
    return [r.landmark_id for r in landmarks.orderBy("ball_id").collect()]


def covered(spark, *rows):
    return api.from_arrays(spark, rows)


def test_greedy_and_fixed_cover(spark):
    p = points(spark, [0, 0.1, 1, 1.1])
    landmarks, cover = api.compute_landmarks(p, 0.11)
    assert ids(landmarks) == [0, 2] and balls(cover, landmarks) == [[0, 1], [2, 3]]
    table = spark.createDataFrame([(0, 2), (1, 0)], "ball_id int, landmark_id long")
    assert balls(api.build_cover(p, [2, 0], 0.11), table) == [[2, 3], [0, 1]]


def test_closed_balls(spark):
    p = points(spark, [0, 1, np.nextafter(1, 2)])
    for method in ("brute_force", "ball_tree", "ckdtree"):
        assert sorted(r.point_id for r in api.build_cover(p, [0], 1.0, method).collect()) == [0, 1]


def test_uncovered_owners_and_localized(spark):
    p = points(spark, [0, 1, 2, 3])
    chosen = api.select_landmarks_uncovered(p, 1.0)
    assert ids(chosen.landmarks) == [0, 2]
    assert {r.point_id: r.ball_id for r in chosen.owners.collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    cover, stats = api.build_cover_localized(p, chosen.landmarks, 1.0, chosen.owners, strategy="localized", return_stats=True)
    assert balls(cover, chosen.landmarks) == [[0, 1], [1, 2, 3]] and stats.strategy == "localized"
    bad = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "point_id long, ball_id int")
    with pytest.raises(ValueError, match="verified"):
        api.build_cover_localized(points(spark, [0, 2, 4]), [0, 2], 0.1, bad)


@pytest.mark.parametrize("seed", range(3))
def test_prefixes_of_any_size_give_the_same_landmarks(spark, seed):
    x = np.random.default_rng(seed).standard_normal((90, 2))
    p = points(spark, x)
    small = api.select_landmarks_uncovered(p, 0.5, first=3, most=12)
    whole = api.select_landmarks_uncovered(p, 0.5)
    assert ids(small.landmarks) == ids(whole.landmarks)
    assert small.owners.exceptAll(whole.owners).isEmpty()


def test_greedy_from_a_directed_relation(spark):
    rng = np.random.default_rng(5)
    n = 40
    relation = {(int(a), int(b)) for a, b in rng.integers(0, n, (120, 2))}
    left, out = set(range(n)), []
    for i in range(n):
        if i in left:
            out.append(i)
            left -= {b for a, b in relation if a == i} | {i}
    found = greedy_from_relation(spark.range(n).withColumnRenamed("id", "point_id"), spark.createDataFrame(sorted(relation), "landmark_id long, point_id long"))
    assert ids(found) == out


def test_farthest_points(spark):
    assert ids(api.compute_landmarks_fps(points(spark, [1, 0, 0.4, 0.8]), 0.41)[0]) == [1, 0]
    x = np.random.default_rng(3).standard_normal((120, 3))
    chosen, best = [], np.full(len(x), np.inf)
    k = min(range(len(x)), key=lambda i: tuple(x[i]))
    while True:
        chosen.append(k)
        best = np.minimum(best, np.linalg.norm(x - x[k], axis=1))
        k = int(best.argmax())
        if best[k] <= 0.9:
            break
    for c in (1, 7, 1024):
        assert ids(api.compute_landmarks_fps(points(spark, x), 0.9, candidates=c, checkpoint_every=5)[0]) == chosen


def test_empty_cloud(spark):
    empty = spark.createDataFrame([], "point_id long, vec array<double>")
    for landmarks, cover in (api.compute_landmarks(empty, 1.0), api.compute_landmarks_fps(empty, 1.0)):
        assert landmarks.isEmpty() and cover.isEmpty()


def test_verified_selection(spark):
    x = [0, 1, np.nextafter(1, 2), 0]
    for candidates in (None, lambda i, eps: [], lambda i, eps: range(4)):
        found = api.compute_landmarks_verified(points(spark, x), 1.0, candidates, complete=True)
        assert ids(found.landmarks) == [0, 2] and balls(found.cover, found.landmarks)[0] == [0, 1, 3]
    part = api.compute_landmarks_verified(points(spark, x), 1.0)
    assert part.rescued_points == 2 and balls(part.cover, part.landmarks) == [[0, 1, 3], [2]]
    with pytest.raises(IndexError):
        api.compute_landmarks_verified(points(spark, x), 1.0, lambda i, eps: [99])


def test_all_exact_engines_agree(spark):
    x = np.random.default_rng(2).random((80, 2))
    p = points(spark, x)
    landmarks, cover = api.compute_landmarks(p, 0.2, "brute_force")
    for method in ("ball_tree", "ckdtree"):
        other = api.compute_landmarks(p, 0.2, method)
        assert ids(other[0]) == ids(landmarks) and api.covers_equal(other[1], cover)
    assert api.covers_equal(rj.column_join(p, landmarks, 0.2), cover)
    full = api.FaissConfig(query_mode="knn", candidate_k=80, exact_verify=True)
    assert api.covers_equal(api.build_cover(p, landmarks, 0.2, "faiss", faiss_config=full), cover)
    ivf = api.FaissIVFBackend(p, nlist=5, nprobe=5, exact_verify=True)
    assert api.covers_equal(ivf.query_radius(landmarks, 0.2), cover)
    assert ids(api.compute_landmarks(p, 0.2, backend=ivf)[0]) == ids(landmarks)


def test_knn_cap(spark):
    p = points(spark, [0, 0.5, 1, 2])
    got = api.build_cover(p, [0], 1.0, "hnswlib", hnswlib_config=api.HnswlibConfig(candidate_k=4))
    assert sorted(r.point_id for r in got.collect()) == [0, 1, 2]
    got = api.build_cover(p, [0], 1.0, "cuvs", cuvs_config=api.CuVSConfig(candidate_k=2))
    assert sorted(r.point_id for r in got.collect()) == [0, 1]


def test_methods_and_arguments(spark):
    p = points(spark, [0, 1])
    for bad in (dict(method="nope"), dict(method="ckdtree", metric="cosine"), dict(method="brute_force", faiss_config=api.FaissConfig()), dict(method="brute_force", metric_kwargs={"p": 1})):
        with pytest.raises(ValueError):
            api.make_backend(p, **bad)
    with pytest.raises(ValueError):
        api.build_cover(p, [0, 0], 1.0)
    with pytest.raises(IndexError):
        api.build_cover(p, [7], 1.0)
    with pytest.raises(TypeError):
        api.build_cover(p, [True], 1.0)
    for eps in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            api.build_cover(p, [0], eps)
    assert isinstance(api.make_backend(p, "kd_tree"), api.RangeQueryBackend)
    with pytest.raises(ValueError):
        api.validate(spark.createDataFrame([(0, [1.0]), (1, [float("nan")])], "point_id long, vec array<double>"))


@pytest.mark.parametrize("d", [1, 3, 7, 8, 13, 50, 64, 129, 200])
def test_column_distance_is_bitwise(spark, d):
    x = np.random.default_rng(d).standard_normal((40, d))
    p = points(spark, x)
    got = p.join(p.where("point_id < 3").select(F.col("point_id").alias("q"), F.col("vec").alias("c"))).select("point_id", "q", distance(F.col("vec"), F.col("c"), d).alias("d")).collect()
    for r in got:
        assert r.d == np.linalg.norm(x - x[r.q], axis=1)[r.point_id]


def test_graph(spark):
    b, c = covered(spark, [0, 1], [1, 2], [3])
    assert [tuple(r) for r in api.build_mapper(c).collect()] == [(0, 1, 1)]
    b, c = covered(spark, range(300), range(300), range(299, 310), [])
    assert {(r.src, r.dst): r.witness_count for r in api.build_mapper(c).collect()}[0, 1] == 300
    s = api.cover_statistics(c, b).first()
    assert (s.m, s.S, s.T) == (4, 611, 302)
    b, c = covered(spark, [0, 0], [0])
    assert api.build_mapper_csr(c).count() == 2
    asked = spark.createDataFrame([(1, 0), (0, 1)], "src int, dst int")
    assert [r.overlap for r in api.compute_edge_overlaps(c, asked).collect()] == [1, 1]
    with pytest.raises(ValueError, match="smaller"):
        api.build_mapper_streaming(spark, iter([[0], [1]]), n_balls=1)
    with pytest.raises(ValueError, match="larger"):
        api.build_mapper_streaming(spark, iter([[0]]), n_balls=2)


def test_dispatch(spark):
    assert api.select_mapper_algorithm(*covered(spark, [0], [0])[::-1]) == "streaming"
    assert api.select_mapper_algorithm(*covered(spark, *[range(20)] * 30)[::-1]) == "csr"
    assert api.select_mapper_algorithm(*covered(spark, *[[i] for i in range(129)])[::-1]) == "csr"


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2))]
    parent = list(range(60))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    for one_task in (0, 1000):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), one_task=one_task).collect()}
        assert all(got.get(i, i) == find(i) for i in range(60))


def test_colours(spark):
    b, c = covered(spark, [0, 1], [2], [])
    v = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 9.0)], "point_id long, value double")
    lab = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "point_id long, label int")
    col = lambda df: [r[1] for r in df.orderBy("ball_id").collect()]
    mean = col(api.color_by_function(v, c, b))
    assert mean[:2] == [2, 9] and np.isnan(mean[2])
    assert col(api.color_by_function(v, c, b, np.max))[:2] == [3, 9]
    assert col(api.color_by_mode(lab, c, b)) == [0, 1, -1]
    assert np.allclose(col(api.color_by_entropy(lab, c, b)), 0, atol=1e-9)
    assert col(api.color_by_size(c, b)) == [2, 1, 0] and col(api.color_by_density(c, b)) == [1, 0.5, 0]
    tie = spark.createDataFrame([(0, 5), (1, 2)], "point_id long, label int")
    assert col(api.color_by_mode(tie, c, b))[0] == 5


def test_boundary(spark):
    p = points(spark, [0, 0.8, 1, 1.3, 2])
    r = api.compute_boundary_diagnostics(p, [0], 1.0, deltas=[0, 0.25, 0.5]).first()
    assert (r.min_abs_margin, r.inside_margin) == (0, 0) and np.isclose(r.outside_margin, 0.3)
    assert [r.band_counts[d] for d in (0.0, 0.25, 0.5)] == [1, 2, 3]
    assert api.compute_boundary_diagnostics(points(spark, [0, 0.5, 1]), [1], 10.0).first().outside_margin == float("inf")


def test_audit(spark):
    b, ref = covered(spark, [0, 1, 2], [2, 3], [])
    _, app = covered(spark, [0, 1], [2, 3, 1], [])
    rows = {r.ball_id: r for r in api.audit_balls(ref, app, b).collect()}
    assert (rows[0].precision, rows[1].recall, rows[2].jaccard) == (1, 1, 1) and np.isclose(rows[0].recall, 2 / 3)
    w = api.audit_witness(ref, app).first()
    assert (w.reference_count, w.approximate_count, w.lost_witnesses, w.added_witnesses) == (1, 1, 1, 1)
    v = spark.createDataFrame([(i, float(i * i)) for i in range(4)], "point_id long, value double")
    audit = api.compare_covers(ref, app, b, values=v)
    assert all(r.absolute_error <= r.error_bound + 1e-12 for r in audit.colors.where("ball_id < 2").collect())
    assert audit.color_summary.first().max_error > 0
    with pytest.raises(ValueError):
        api.compare_covers(ref, app, b, eps=1.0)


def test_filtration_counts(spark):
    x = np.random.default_rng(0).random((120, 3))
    lm, radii = list(range(0, 100, 10)), [0.6, 0, 0.18, 0.3, 0.18, 0.45]
    p = points(spark, x)
    got = api.fixed_landmark_h0(p, lm, radii)
    for r, n in zip(radii, got.component_counts):
        inside = np.stack([np.linalg.norm(x - x[i], axis=1) <= r for i in lm])
        parent = list(range(len(lm)))

        def find(i):
            return i if parent[i] == i else find(parent[i])

        for a, b in combinations(range(len(lm)), 2):
            if (inside[a] & inside[b]).any():
                parent[find(b)] = find(a)
        assert n == len({find(i) for i in range(len(lm))})
    again = api.fixed_landmark_h0_from_cover(p, lm, radii, api.build_cover_blocked(p, lm, 0.6))
    assert again.component_counts == got.component_counts and again.merges == got.merges


def brute(cover, budgets):
    """Whether some deletions within the budgets raise the number of components."""
    def count(rows):
        parent = list(range(len(rows)))

        def find(i):
            return i if parent[i] == i else find(parent[i])

        for a, b in combinations(range(len(rows)), 2):
            if set(rows[a]) & set(rows[b]):
                parent[find(b)] = find(a)
        return len({find(i) for i in range(len(rows))})

    def rest(i, rows):
        if i == len(cover):
            return count(rows) > count(cover)
        return any(rest(i + 1, [*rows, [x for x in cover[i] if x not in gone]]) for k in range(budgets[i] + 1) for gone in combinations(cover[i], k))

    return not rest(0, [])


def test_exact_certificates_equal_enumeration(spark):
    from covergraph.operators.certify import certify_local

    rng = np.random.default_rng(0)
    for trial in range(120):
        m, n = int(rng.integers(2, 5)), 5
        cover = [sorted(set(rng.integers(0, n, int(rng.integers(1, 5))).tolist())) for _ in range(m)]
        budgets = rng.integers(0, 2, m).tolist()
        table = {}
        for x in range(n):
            pat = tuple(i for i in range(m) if x in cover[i])
            if len(pat) > 1:
                table.setdefault(pat, []).append(x)
        for method, cutoff in (("auto", 3), ("auto", 0), ("milp", 3)):
            robust, left = True, dict(table)
            while left:
                # One connected part at a time.
                part, grown = set(next(iter(left))), True
                while grown:
                    grown = False
                    for pat in left:
                        if set(pat) & part and not set(pat) <= part:
                            part |= set(pat)
                            grown = True
                own = {k: v for k, v in left.items() if set(k) & part}
                left = {k: v for k, v in left.items() if k not in own}
                robust &= certify_local({k: len(v) for k, v in own.items()}, dict(enumerate(budgets)), method, cutoff, 10**5, 10.0)["robust"]
            assert robust == brute(cover, budgets), (cover, budgets, method, cutoff)


def test_certificates(spark):
    b, c = covered(spark, [0, 1, 2, 3], [0, 1, 2, 3], [2, 3, 4], [5])
    bud = lambda *x: spark.createDataFrame(list(enumerate(x)), "ball_id int, budget long")
    got = api.certify_component_preservation(c, b, bud(1, 1, 0, 0))
    assert got.certified and got.exact_components == 2
    b2, c2 = covered(spark, [0], [0])
    assert not api.certify_component_preservation(c2, b2, bud(1, 1)).certified
    cut = api.certify_connectivity(c2, b2, bud(1, 0))
    assert cut.robust is False and api.check_disconnection_witness(c2, b2, bud(1, 0), cut.deletions)
    b3, c3 = covered(spark, [0, 1, 4], [1, 2, 5], [0, 2, 3])
    for k in range(3):
        a = [api.certify_connectivity(c3, b3, bud(k, k, k), method=m).robust for m in ("auto", "dp", "milp")]
        assert len(set(a)) == 1 and a[0] == brute([[0, 1, 4], [1, 2, 5], [0, 2, 3]], [k] * 3)
    b4, c4 = covered(spark, [0, 2], [0, 1], [1, 2])
    assert api.certify_connectivity(c4, b4, bud(1, 1, 1), max_states=1).robust is None
    assert api.certify_connectivity(*covered(spark, [], [])[::-1], bud(0, 0)).robust is True
    with pytest.raises(ValueError):
        api.certify_connectivity(c, b, bud(1, 1, 0, 0), method="dp")
    assert api.robust_atoms(c2, b2, bud(0, 0)) == [(0, 1)] and api.robust_atoms(c2, b2, bud(1, 0)) == [(0,), (1,)]


def test_plots(spark, tmp_path):
    b, c = covered(spark, [0, 1], [1, 2], [2, 3])
    e = api.build_mapper(c)
    for kind in ("spring", "spectral", "kamada_kawai"):
        nodes = api.plot_nodes(c, b, e, {"size": api.color_by_size(c, b)}, kind=kind)
        assert np.isfinite(nodes[["x", "y"]].to_numpy()).all()
    api.export_html(str(tmp_path / "g.html"), nodes, e, ["size"])
    assert "svg" in (tmp_path / "g.html").read_text()


def test_synthetic(spark):
    for kind in ("gaussian", "uniform", "mixture", "curve"):
        assert api.cloud(spark, kind, 20, 3).toPandas()["vec"].map(len).tolist() == [3] * 20
    assert api.lattice(spark, (2, 3)).count() == 6


def test_separator_search_with_both_orders(spark):
    from covergraph.operators.certify import elimination_bags, elimination_order, geometric_order, neighbours

    points, marks = api.lattice_cover(spark, (2, 4), witnesses=2)
    points = api.validate(points).cache()
    cover = api.build_cover(points, marks, 1.0).cache()
    coords = points.where("point_id < 8").selectExpr("CAST(point_id AS INT) AS ball_id", "vec")
    bud = lambda k: marks.selectExpr("ball_id", f"CAST({k} AS BIGINT) AS budget")
    for k in (0, 1, 2):
        want = api.certify_connectivity(cover, marks, bud(k)).robust
        for order in ({"ordering": "min_fill"}, {"ordering": "geometric", "coords": coords, "eps": 1.0}):
            got = api.certify_separator_dp(cover, marks, bud(k), **order)
            assert got.robust == want
            assert got.robust or api.check_disconnection_witness(cover, marks, bud(k), got.deletions)
    assert api.certify_separator_dp(cover, marks, bud(1), max_states=1).robust is None
    weights = {tuple(r.pattern): r.weight for r in api.patterns(cover).collect()}
    adjacent = neighbours(weights)
    at = {r.ball_id: tuple(r.vec) for r in coords.collect()}
    order = geometric_order(list(range(8)), at, 1.0, leaf=2)
    assert sorted(order) == list(range(8))
    for o in (order, elimination_order(list(range(8)), adjacent)[0]):
        bags = elimination_bags(o, adjacent)
        assert all(any(set(p) <= set(b) for b in bags) for p in weights)
    with pytest.raises(ValueError):
        api.certify_connectivity(cover, marks, bud(500), n_samples=10)


def test_calibration_equals_numpy(spark):
    x = np.random.default_rng(2).standard_normal((70, 3))
    points = api.from_array(spark, x)
    d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)
    assert np.isclose(api.calibrate_epsilon(points, 5), np.median(d[:, 5]))
    assert np.isclose(api.choose_radius(points, 4, queries=70), np.median(d[:, 4])) and api.choose_radius(points, 4, queries=9) > 0
    with pytest.raises(ValueError):
        api.calibrate_epsilon(points, 70)


def test_capped_cells_and_candidates(spark):
    x = np.random.default_rng(3).standard_normal((200, 4))
    points, marks = api.from_array(spark, x), spark.createDataFrame([(0, 5), (1, 60)], "ball_id int, landmark_id long")
    eps = 2.0
    for k in (3, 17):
        got = {(r.ball_id, r.point_id) for r in api.FaissIVFBackend(points, nlist=4, nprobe=4, candidate_k=k, exact_verify=True).query_radius(marks, eps).collect()}
        want = {(b, int(i)) for b, q in ((0, 5), (1, 60)) for d in [np.linalg.norm(x - x[q], axis=1)] for i in np.argsort(d, kind="stable")[:k] if d[i] <= eps}
        assert got == want
        few = api.FaissIVFBackend(points, nlist=4, nprobe=1, candidate_k=k, exact_verify=True).query_radius(marks, eps)
        assert few.count() <= 2 * k
    asked = spark.createDataFrame([(i,) for i in range(0, 200, 3)] * 2, "point_id long")
    for engine in ("scalar", "batch", "numba", "auto"):
        got = sorted(r.point_id for r in api.filter_candidates(points, 5, asked, eps, engine=engine, block_size=7).collect())
        assert got == [i for i in range(0, 200, 3) if np.linalg.norm(x[i] - x[5]) <= eps]
    for bad in ({"engine": "gpu"}, {"block_size": 0}, {"block_size": True}):
        with pytest.raises(ValueError):
            api.filter_candidates(points, 5, asked, eps, **bad)


def test_localized_cover_is_the_blocked_one(spark):
    x = np.random.default_rng(4).random((400, 2))
    points = api.from_array(spark, x)
    chosen = api.select_landmarks_uncovered(points, 0.1)
    want = {(r.ball_id, r.point_id) for r in api.build_cover_blocked(points, chosen.landmarks, 0.1).collect()}
    for strategy in ("localized", "auto", "blocked"):
        got, stats = api.build_cover_localized(points, chosen.landmarks, 0.1, chosen.owners, strategy=strategy, return_stats=True)
        assert {(r.ball_id, r.point_id) for r in got.collect()} == want
        assert stats.strategy == ("blocked" if strategy == "blocked" else "localized")
    unknown = spark.createDataFrame([(0, 3), (1, 4000)], "ball_id int, landmark_id long")
    with pytest.raises(IndexError):
        api.build_cover_blocked(points, unknown, 0.1)
    landmarks, cover = api.compute_landmarks_uncovered(points, 0.1)
    assert {(r.ball_id, r.point_id) for r in cover.collect()} == want
    assert [list(b) for b in api.iter_cover_blocked(points, landmarks, 0.1)] == [sorted(i for b, i in want if b == k) for k in range(landmarks.count())]


def test_streamed_graphs(spark, monkeypatch):
    from covergraph.operators import graph

    monkeypatch.setattr(graph, "HELD_ROWS", 3)
    balls = [[0, 1, 2], [2, 3], [], [3, 2, 2], [5]]
    edges = {(r.src, r.dst): r.witness_count for r in api.build_mapper_streaming(spark, iter(balls), n_balls=5, output="networkx").collect()}
    assert edges == {(0, 1): 1, (0, 3): 1, (1, 3): 2}
    for n in (4, 6):
        with pytest.raises(ValueError):
            api.build_mapper_streaming(spark, iter(balls), n_balls=n)
    x = np.random.default_rng(5).random((120, 2))
    points = api.from_array(spark, x)
    landmarks, both = api.compute_mapper_streaming(points, 0.2)
    want = {(r.src, r.dst, r.witness_count) for r in api.symmetric(api.build_mapper(api.build_cover_blocked(points, landmarks, 0.2))).collect()}
    assert {(r.src, r.dst, r.witness_count) for r in both.collect()} == want


def test_reports_gates_and_files(spark, tmp_path):
    a = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "ball_id int, point_id long")
    b = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "ball_id int, point_id long")
    balls = spark.createDataFrame([(0,), (1,)], "ball_id int")
    got = list(api.records(api.audit_balls(a, b, balls), api.BallMembershipAudit))
    assert [(r.ball_id, r.false_positives, r.false_negatives) for r in got] == [(0, 0, 1), (1, 1, 0)]
    assert [(r.src, r.dst, r.status) for r in api.records(api.audit_witness(a, b), api.EdgeWitnessChange)] == [(0, 1, "missing")]
    values = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0)], "point_id long, value double")
    assert [round(r.absolute_error, 6) for r in api.records(api.audit_colors(a, b, balls, values), api.ColorAudit)] == [1.0, 1.0]
    points = api.from_array(spark, np.random.default_rng(6).random((60, 2)))
    near = next(api.records(api.compute_boundary_diagnostics(points, [0, 1], 0.3, deltas=[0.1]), api.BoundaryDiagnostics))
    assert near.ball_id == 0 and set(near.band_counts) == {0.1}
    assert api.exactness_gate(points, 0.2) == {"ball_tree": True, "brute_force": True, "ckdtree": True}
    fine = {"landmarks_equal": True, "cover_equal": True, "graph_equal": True, "false_positives": 0}
    assert api.gate_failures("ckdtree", **fine) == [] and len(api.gate_failures("ckdtree", **{**fine, "landmarks_equal": False, "graph_equal": False})) == 2
    assert api.gate_failures("ivf", **{**fine, "cover_equal": False}) == [] and len(api.gate_failures("hnsw", **{**fine, "false_positives": 2})) == 1
    for kind in ("parquet", "json", "csv"):
        api.write_results(api.patterns(a), str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() >= 1


def test_old_call_forms(spark):
    assert api.normalize_backend_options("BallTree", "Euclidean") == ("ball_tree", "euclidean", {}) and api.normalize_backend_options("brute", "cosine")[0] == "brute_force"
    for bad in (("hnsw", "euclidean"), ("faiss", "manhattan")):
        with pytest.raises(ValueError):
            api.normalize_backend_options(*bad)
    with pytest.raises(TypeError):
        api.normalize_backend_options(3, "euclidean")
    points = api.from_array(spark, np.random.default_rng(7).random((50, 2)))
    covers = [api.compute_landmarks_brute_force(points, 0.3)[1], api.compute_landmarks_ball_tree(points, 0.3)[1], api.compute_landmarks_faiss(points, 0.3)[1]]
    rows = [sorted((r.ball_id, r.point_id) for r in c.collect()) for c in covers]
    assert rows[0] == rows[1] == rows[2]
    covers = [f(points, [0, 7], 0.3) for f in (api.build_cover_brute_force, api.build_cover_ball_tree, api.build_cover_faiss)]
    marks = spark.createDataFrame([(0, 0), (1, 7)], "ball_id int, landmark_id long")
    covers += [api.query_brute_force_range(points, marks, 0.3), api.create_ball_tree(points, "minkowski", p=2).query_radius(marks, 0.3), api.create_euclidean_index(points).query_radius(marks, 0.3)]
    rows = [sorted((r.ball_id, r.point_id) for r in c.collect()) for c in covers]
    assert all(r == rows[0] for r in rows)
    assert api.create_cosine_index(points).metadata.metric == "cosine"
