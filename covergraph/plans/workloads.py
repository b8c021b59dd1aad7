"""The registered queries of the cover engine and their DuckDB SQL.

The cloud is ``embeddings`` (64 dimensions) unless a query says otherwise; EPS lies well off every distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergraph import api
from covergraph.operators import range_join as rj
from covergraph.operators.graph import ball_mapper_components
from covergraph.sources.shared import materialize

EPS, COSINE_EPS, L1_EPS, LATTICE_EPS = 1.2, 0.72, 7.5, 5.0
STEP, K, PROBES, CENTERS = 25, 12, 2, 8
RADII = [1.0, 1.2, 1.1, 1.2, 0.0]
DELTAS = [0.0, 0.05, 0.1]


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    return api.from_table(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("point_id"), F.col("label").cast("int").alias("label"))


def values(spark: SparkSession, sf: str) -> DataFrame:
    return labels(spark, sf).select("point_id", F.col("label").cast("double").alias("value"))


def lattice_points(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", (F.col("p_partkey") % 100).alias("y"))
    return api.from_columns(part, "p_partkey", ["p_size", "y"])


def fixed(points: DataFrame) -> DataFrame:
    """Every STEP-th point is a landmark; ordinals follow the ids."""
    return points.where(F.col("point_id") % STEP == 0).select(F.expr(f"CAST(point_id div {STEP} AS int)").alias("ball_id"), F.col("point_id").alias("landmark_id"))


def greedy(spark, sf):
    points = cloud(spark, sf)
    landmarks, cover = api.compute_landmarks(points, EPS)
    return points, landmarks, materialize(cover, "cover")


def greedy_landmarks(spark, sf):
    return api.select_landmarks_uncovered(cloud(spark, sf), EPS).landmarks


def greedy_owners(spark, sf):
    return api.select_landmarks_uncovered(cloud(spark, sf), EPS).owners.select("point_id", "ball_id", F.round("dist", 6).alias("dist"))


def verified_landmarks(spark, sf):
    """Verified selection from candidates of the neighbouring ids, with whole balls."""
    points = cloud(spark, sf)
    near = points.select("point_id", F.explode(F.sequence(F.col("point_id") - 3, F.col("point_id") + 3)).alias("landmark_id"))
    candidates = near.join(points.select(F.col("point_id").alias("landmark_id")), "landmark_id").select("landmark_id", "point_id")
    return api.compute_landmarks_verified(points, EPS, candidates, complete=True).cover.select("ball_id", "point_id")


def fps_landmarks(spark, sf):
    return api.compute_landmarks_fps(cloud(spark, sf), EPS)[0]


def cover_members(spark, sf):
    return greedy(spark, sf)[2]


def cover_localized(spark, sf):
    points = cloud(spark, sf)
    chosen = api.select_landmarks_uncovered(points, EPS)
    return api.build_cover_localized(points, chosen.landmarks, EPS, chosen.owners, strategy="localized")


def cover_fixed_landmarks(spark, sf):
    points = cloud(spark, sf)
    return api.build_cover(points, fixed(points), EPS, "brute_force")


def cover_columns(spark, sf):
    """The nested loop over column expressions."""
    points = cloud(spark, sf)
    return rj.column_join(points, fixed(points), EPS)


def cover_cosine(spark, sf):
    points = cloud(spark, sf)
    return api.build_cover(points, fixed(points), COSINE_EPS, "brute_force", "cosine")


def cover_manhattan(spark, sf):
    points = cloud(spark, sf)
    return api.build_cover(points, fixed(points), L1_EPS, "ball_tree", "minkowski", metric_kwargs={"p": 1})


def cover_flat(spark, sf):
    points = cloud(spark, sf)
    return api.build_cover(points, fixed(points), EPS, "faiss")


def knn(points, landmarks):
    return api.build_cover(points, landmarks, EPS, "faiss", faiss_config=api.FaissConfig(query_mode="knn", candidate_k=K, exact_verify=True))


def knn_capped_cover(spark, sf):
    points = cloud(spark, sf)
    return knn(points, fixed(points))


def ivf_cover(spark, sf):
    """Inverted lists over the cells of the first points."""
    points = cloud(spark, sf)
    first = points.where(F.col("point_id") < CENTERS).orderBy("point_id").toPandas()["vec"].tolist()
    return rj.with_self(rj.cell_join(points, fixed(points), EPS, first, PROBES, exact=True), fixed(points))


def _lattice(spark, sf):
    points = lattice_points(spark, sf)
    return points, points.where(F.col("point_id") % 97 == 1).select(F.col("point_id").cast("int").alias("ball_id"), F.col("point_id").alias("landmark_id"))


def lattice_cover(spark, sf):
    return api.build_cover(*_lattice(spark, sf), LATTICE_EPS, "ckdtree")


def lattice_edges(spark, sf):
    """The graph of the lattice's cover; coincident points and landmarks are counted together."""
    return api.mapper_of_places(*_lattice(spark, sf), LATTICE_EPS)


def mapper_edges(spark, sf):
    return api.build_mapper(greedy(spark, sf)[2])


def mapper_edges_symmetric(spark, sf):
    return api.build_mapper_csr(greedy(spark, sf)[2])


def cover_statistics(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    return api.cover_statistics(cover, landmarks)


def edge_overlaps_given(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    asked = landmarks.select((F.col("ball_id") + 1).alias("src"), F.col("ball_id").alias("dst")).where(f"src < {10**6}")
    return api.compute_edge_overlaps(cover, asked)


def patterns(spark, sf):
    found = api.patterns(greedy(spark, sf)[2])
    return found.select(F.array_join("pattern", ",").alias("pattern"), "weight", F.array_join("observations", ",").alias("observations"))


def components(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    return ball_mapper_components(cover, landmarks)


def color_mean(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    return api.color_by_function(values(spark, sf), cover, landmarks).select("ball_id", F.round("value", 6).alias("value"))


def color_mode(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    return api.color_by_mode(labels(spark, sf), cover, landmarks)


def color_entropy(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    return api.color_by_entropy(labels(spark, sf), cover, landmarks).select("ball_id", (F.round("value", 6) + 0.0).alias("value"))


def color_size(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    return api.color_by_size(cover, landmarks)


def color_density(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    return api.color_by_density(cover, landmarks).select("ball_id", F.round("value", 6).alias("value"))


def node_sizes(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    return api.scale_node_sizes(api.color_by_size(cover, landmarks)).select("ball_id", F.round("value", 6).alias("value"))


def plot_edges(spark, sf):
    return api.plot_edges(mapper_edges(spark, sf)).select("src", "dst", "witness_count", F.round("edge_width", 6).alias("edge_width"))


def _audited(spark, sf):
    points = cloud(spark, sf)
    landmarks = fixed(points)
    return points, landmarks, materialize(api.build_cover(points, landmarks, EPS, "brute_force"), "exact"), materialize(knn(points, landmarks), "capped")


def audit_balls(spark, sf):
    _, balls, a, b = _audited(spark, sf)
    return _rounded(api.audit_balls(a, b, balls), "precision", "recall", "jaccard")


def audit_edges(spark, sf):
    _, _, a, b = _audited(spark, sf)
    return api.audit_edges(a, b)


def audit_witness(spark, sf):
    _, _, a, b = _audited(spark, sf)
    return _rounded(api.audit_witness(a, b).drop("status"), "retained_fraction")


def audit_colors(spark, sf):
    _, balls, a, b = _audited(spark, sf)
    return _rounded(api.audit_colors(a, b, balls, values(spark, sf)), "reference_mean", "approximate_mean", "absolute_error", "error_bound")


def audit_summary(spark, sf):
    _, balls, a, b = _audited(spark, sf)
    found = api.audit_summary(a, b, balls)
    return _rounded(found, *[c for c, t in found.dtypes if t == "double"])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


def boundary_diagnostics(spark, sf):
    points = cloud(spark, sf)
    found = api.compute_boundary_diagnostics(points, fixed(points), EPS, deltas=DELTAS)
    bands = [F.col("band_counts")[F.lit(d)].alias(f"band{i}") for i, d in enumerate(DELTAS)]
    return _rounded(found, "min_abs_margin", "inside_margin", "outside_margin").select("ball_id", "landmark_id", "min_abs_margin", "inside_margin", "outside_margin", *bands)


def _h0(spark, sf):
    points = cloud(spark, sf)
    return api.fixed_landmark_h0(points, fixed(points), RADII)


def h0_counts(spark, sf):
    found = _h0(spark, sf)
    return spark.createDataFrame(list(enumerate(found.component_counts)), "pos int, n_components long")


def h0_merges(spark, sf):
    return spark.createDataFrame([(i, round(w, 6), u, v) for i, (w, u, v) in enumerate(_h0(spark, sf).merges)], "seq int, radius double, src int, dst int")


def _budgets(landmarks):
    return landmarks.select("ball_id", (F.col("ball_id") % 2).cast("long").alias("budget"))


def component_certificate(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    c = api.certify_component_preservation(cover, landmarks, _budgets(landmarks))
    return spark.createDataFrame([(c.certified, c.exact_components, c.protected_components, c.protected_edges)], "certified boolean, exact_components long, protected_components long, protected_edges long")


def connectivity_certificate(spark, sf):
    points = lattice_points(spark, sf)
    landmarks, cover = api.compute_landmarks(points, 12.0, "ckdtree")
    c = api.certify_connectivity(materialize(cover, "cover"), landmarks, landmarks.select("ball_id", F.lit(1).cast("long").alias("budget")))
    return spark.createDataFrame([(c.robust, c.status, c.blocks, len(c.deletions))], "robust boolean, status string, blocks long, n_deletions long")


def stream_sizes(spark, sf):
    """Ball sizes over a stream of the cloud with fixed landmarks, run to its end."""
    points = cloud(spark, sf)
    path = materialize(points, "stream").inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(points.schema).parquet(path)
    name = f"sizes_{abs(hash(path))}"
    query = api.stream_sizes(api.stream_cover(stream, points, fixed(points), EPS)).writeStream.outputMode("complete").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).select("ball_id", F.col("value").cast("long").alias("value"))


def hnswlib_cover(spark, sf):
    points = cloud(spark, sf)
    return api.build_cover(points, fixed(points), EPS, "hnswlib", hnswlib_config=api.HnswlibConfig(candidate_k=K))


def cuvs_cover(spark, sf):
    points = cloud(spark, sf)
    return api.build_cover(points, fixed(points), EPS, "cuvs_cagra", cuvs_config=api.CuVSConfig(candidate_k=K))


def blocked_balls(spark, sf):
    """Balls taken one at a time."""
    points = cloud(spark, sf)
    rows = [(j, len(ids), sum(ids)) for j, ids in enumerate(api.iter_cover_blocked(points, fixed(points), EPS))]
    return spark.createDataFrame(rows, "ball_id int, size long, id_sum long")


def cover_uncovered(spark, sf):
    return api.compute_landmarks_uncovered(cloud(spark, sf), EPS)[1]


def streaming_graph(spark, sf):
    """The graph of an iterable of balls."""
    points = cloud(spark, sf)
    marks = materialize(fixed(points), "marks")
    return api.build_mapper_streaming(spark, api.iter_cover_blocked(points, marks, EPS), n_balls=marks.count(), output="networkx")


def auto_graph(spark, sf):
    _, landmarks, cover = greedy(spark, sf)
    return api.build_mapper_auto(cover, landmarks)


def fused_graph(spark, sf):
    return api.compute_mapper_streaming(cloud(spark, sf), EPS)[1]


def h0_from_cover(spark, sf):
    points = cloud(spark, sf)
    cover = materialize(api.build_cover_blocked(points, fixed(points), max(RADII)), "cover")
    found = api.fixed_landmark_h0_from_cover(points, fixed(points), RADII, cover)
    return spark.createDataFrame(list(enumerate(found.component_counts)), "pos int, n_components long")


def witness_check(spark, sf):
    """Ball 0 gives up all observations that it shares: a disconnection if it has an edge, unless the budget is too small."""
    points = cloud(spark, sf)
    balls = fixed(points)
    cover = materialize(api.build_cover_blocked(points, balls, EPS), "cover")
    shared = cover.where("ball_id <> 0").select("point_id").distinct()
    gone = [(0, r.point_id) for r in cover.where("ball_id = 0").join(shared, "point_id", "left_semi").orderBy("point_id").toLocalIterator()]
    rows = []
    for name, budget in (("enough", len(gone)), ("short", len(gone) - 1)):
        budgets = balls.select("ball_id", F.lit(budget).cast("long").alias("budget"))
        rows.append((name, api.check_disconnection_witness(cover, balls, budgets, gone)))
    return spark.createDataFrame(rows, "budget string, valid boolean")


def witness_survival(spark, sf):
    _, _, a, b = _audited(spark, sf)
    return api.witness_survival(api.audit_witness(a, b))


def color_errors(spark, sf):
    from covergraph.operators.audit import color_errors as errors

    _, balls, a, b = _audited(spark, sf)
    return _rounded(errors(api.audit_colors(a, b, balls, values(spark, sf))), "mae", "rmse", "max_error")


def distances_to_all(spark, sf):
    return api.BruteForceBackend(cloud(spark, sf)).distances_to_all(0).select("point_id", F.round("dist", 6).alias("dist"))


def filtered_candidates(spark, sf):
    points = cloud(spark, sf)
    return api.filter_candidates(points, 0, points.where(F.col("point_id") % 3 == 0), EPS)


def calibrated_radius(spark, sf):
    return spark.createDataFrame([(K, round(api.calibrate_epsilon(cloud(spark, sf), K), 6))], "k int, eps double")


def exactness_gate(spark, sf):
    """Whether the exact engines agree on landmarks, memberships and edges."""
    return spark.createDataFrame(sorted(api.exactness_gate(lattice_points(spark, sf), 2 * LATTICE_EPS).items()), "method string, equal boolean")


NAMES = [
    greedy_landmarks, greedy_owners, verified_landmarks, fps_landmarks, cover_members, cover_localized, cover_fixed_landmarks, cover_columns, cover_cosine, cover_manhattan, cover_flat,
    knn_capped_cover, ivf_cover, lattice_cover, lattice_edges, mapper_edges, mapper_edges_symmetric, cover_statistics, edge_overlaps_given, patterns, components, color_mean, color_mode,
    color_entropy, color_size, color_density, node_sizes, plot_edges, audit_balls, audit_edges, audit_witness, audit_colors, audit_summary, boundary_diagnostics, h0_counts, h0_merges,
    component_certificate, connectivity_certificate, stream_sizes, hnswlib_cover, cuvs_cover, blocked_balls, cover_uncovered, streaming_graph, auto_graph, fused_graph, h0_from_cover,
    witness_check, witness_survival, color_errors, distances_to_all, filtered_candidates, calibrated_radius, exactness_gate,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


# ---------------------------------------------------------------- SQL

_D = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_GREEDY = f"""
adj AS MATERIALIZED (SELECT a.vec_id l, b.vec_id p, {_D} AS d FROM embeddings a JOIN embeddings b ON {_D} <= {EPS}),
g(k, lm, covered) AS (
  SELECT 0, (SELECT min(vec_id) FROM embeddings), (SELECT list(p) FROM adj WHERE l = (SELECT min(vec_id) FROM embeddings))
  UNION ALL
  SELECT k + 1, nx, list_concat(covered, (SELECT list(p) FROM adj WHERE l = nx))
  FROM (SELECT k, covered, (SELECT min(vec_id) FROM embeddings e WHERE NOT list_contains(g.covered, e.vec_id)) nx FROM g) s WHERE nx IS NOT NULL),
balls AS MATERIALIZED (SELECT k::INT AS ball_id, lm AS landmark_id FROM g),
cover AS MATERIALIZED (SELECT DISTINCT ball_id, p AS point_id FROM balls JOIN adj ON l = landmark_id),
edges AS MATERIALIZED (SELECT a.ball_id AS src, b.ball_id AS dst, count(*)::BIGINT AS witness_count FROM cover a JOIN cover b ON a.point_id = b.point_id AND a.ball_id < b.ball_id GROUP BY 1, 2)
"""
_FIXED = f"balls AS MATERIALIZED (SELECT (vec_id // {STEP})::INT AS ball_id, vec_id AS landmark_id, embedding FROM embeddings WHERE vec_id % {STEP} = 0)"
_ALL = f"dist AS MATERIALIZED (SELECT a.ball_id, a.landmark_id, b.vec_id AS point_id, {_D} AS d FROM balls a, embeddings b)"
_EXACT = f"exact AS MATERIALIZED (SELECT ball_id, point_id FROM dist WHERE d <= {EPS})"
_KNN = f"""capped AS MATERIALIZED (SELECT ball_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY ball_id ORDER BY d, point_id) AS r FROM dist) WHERE r <= {K} AND d <= {EPS}
  UNION SELECT ball_id, landmark_id FROM balls)"""
_TWO = f"""{_FIXED}, {_ALL}, {_EXACT}, {_KNN},
both_ AS MATERIALIZED (SELECT ball_id, point_id, e.ball_id IS NOT NULL AS r, c.ball_id IS NOT NULL AS a FROM (SELECT *, 1 AS x FROM exact) e FULL JOIN (SELECT *, 1 AS y FROM capped) c USING (ball_id, point_id)),
both2 AS MATERIALIZED (SELECT ball_id, point_id, (ball_id, point_id) IN (SELECT (ball_id, point_id) FROM exact) AS r, (ball_id, point_id) IN (SELECT (ball_id, point_id) FROM capped) AS a
  FROM (SELECT * FROM exact UNION SELECT * FROM capped)),
per AS MATERIALIZED (SELECT b.ball_id, count(*) FILTER (r) AS reference_size, count(*) FILTER (a) AS approximate_size, count(*) FILTER (r AND a) AS tp, count(*) FILTER (a AND NOT r) AS fp, count(*) FILTER (r AND NOT a) AS fn
  FROM balls b LEFT JOIN both2 USING (ball_id) GROUP BY 1),
scored AS MATERIALIZED (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END::DOUBLE AS recall,
  CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / (tp + fp + fn) END::DOUBLE AS jaccard FROM per),
wit AS MATERIALIZED (SELECT x.ball_id AS src, y.ball_id AS dst, count(*) FILTER (x.r AND y.r) AS reference_count, count(*) FILTER (x.a AND y.a) AS approximate_count,
  count(*) FILTER (x.r AND y.r AND x.a AND y.a) AS retained_witnesses, count(*) FILTER (x.r AND y.r AND NOT (x.a AND y.a)) AS lost_witnesses, count(*) FILTER (x.a AND y.a AND NOT (x.r AND y.r)) AS added_witnesses
  FROM both2 x JOIN both2 y ON x.point_id = y.point_id AND x.ball_id < y.ball_id WHERE (x.r AND y.r) OR (x.a AND y.a) GROUP BY 1, 2)""".replace(
    "both_ AS MATERIALIZED (SELECT ball_id, point_id, e.ball_id IS NOT NULL AS r, c.ball_id IS NOT NULL AS a FROM (SELECT *, 1 AS x FROM exact) e FULL JOIN (SELECT *, 1 AS y FROM capped) c USING (ball_id, point_id)),\n", "")


def _g(tail: str) -> str:
    return f"WITH RECURSIVE {_GREEDY} {tail}"


def _f(tail: str) -> str:
    return f"WITH {_FIXED}, {_ALL} {tail}"


def _t(tail: str) -> str:
    return f"WITH {_TWO} {tail}"


_REACH = "reach(a, b) AS (SELECT ball_id, ball_id FROM balls UNION SELECT r.a, e.dst FROM reach r JOIN (SELECT src, dst FROM {e} UNION ALL SELECT dst, src FROM {e}) e ON e.src = r.b)"
_LATTICE = f"""l AS MATERIALIZED (SELECT p_partkey AS id, p_size::DOUBLE AS x, (p_partkey % 100)::DOUBLE AS y FROM part),
cover AS MATERIALIZED (SELECT a.id::INT AS ball_id, b.id AS point_id FROM l a JOIN l b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {LATTICE_EPS * LATTICE_EPS} WHERE a.id % 97 = 1)"""
_CELL = f"list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings c WHERE c.vec_id = cell))"


_STAR = f"""mem AS MATERIALIZED (SELECT * FROM dist WHERE d <= {max(RADII)}),
            own AS MATERIALIZED (SELECT point_id, first(ball_id ORDER BY d, ball_id) AS o FROM mem GROUP BY 1),
            star AS MATERIALIZED (SELECT least(ball_id, o) AS src, greatest(ball_id, o) AS dst, min(d) AS w FROM mem JOIN own USING (point_id) WHERE ball_id <> o GROUP BY 1, 2)"""


def _counts() -> str:
    """Component counts of fixed landmarks at RADII."""
    return f"""WITH RECURSIVE {_FIXED}, {_ALL}, {_STAR},
            radii AS (SELECT * FROM (VALUES {', '.join(f'({i}, {r}::DOUBLE)' for i, r in enumerate(RADII))}) t(pos, r)),
            reach(pos, a, b) AS (SELECT pos, ball_id, ball_id FROM radii, balls UNION SELECT c.pos, c.a, s.dst FROM reach c JOIN radii USING (pos) JOIN (SELECT src, dst, w FROM star UNION ALL SELECT dst, src, w FROM star) s ON s.src = c.b AND s.w <= r)
            SELECT pos::INT AS pos, count(DISTINCT m)::BIGINT AS n_components FROM (SELECT pos, a, min(b) AS m FROM reach GROUP BY 1, 2) GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    r6 = lambda c: f"round({c}, 6) AS {c}"
    label = "JOIN embeddings e ON e.vec_id = point_id"
    return {
        "greedy_landmarks": _g("SELECT * FROM balls"),
        "greedy_owners": _g("SELECT p AS point_id, min(ball_id) AS ball_id, round(arg_min(d, ball_id), 6) AS dist FROM balls JOIN adj ON l = landmark_id GROUP BY p"),
        "verified_landmarks": _g("SELECT * FROM cover"),
        "cover_members": _g("SELECT * FROM cover"),
        "cover_localized": _g("SELECT * FROM cover"),
        "fps_landmarks": f"""WITH RECURSIVE dist AS MATERIALIZED (SELECT a.vec_id AS l, b.vec_id AS p, {_D} AS d FROM embeddings a, embeddings b),
            f(k, lm, chosen) AS (SELECT 0, vec_id, [vec_id] FROM (SELECT vec_id FROM embeddings ORDER BY embedding, vec_id LIMIT 1)
            UNION ALL SELECT k + 1, nx.p, list_append(chosen, nx.p) FROM (SELECT k, chosen, (SELECT {{'p': p, 'd': m}} FROM (SELECT p, min(d) AS m FROM dist WHERE list_contains(f.chosen, l) GROUP BY p)
              ORDER BY m DESC, p LIMIT 1) AS nx FROM f) WHERE nx.d > {EPS}) SELECT k::INT AS ball_id, lm AS landmark_id FROM f""",
        "cover_fixed_landmarks": _f(f"SELECT ball_id, point_id FROM dist WHERE d <= {EPS}"),
        "cover_columns": _f(f"SELECT ball_id, point_id FROM dist WHERE d <= {EPS}"),
        "cover_flat": _f(f"SELECT ball_id, point_id FROM dist WHERE d <= {EPS}"),
        "cover_cosine": f"WITH {_FIXED} SELECT ball_id, b.vec_id AS point_id FROM balls a, embeddings b WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {COSINE_EPS}",
        "cover_manhattan": f"WITH {_FIXED} SELECT ball_id, b.vec_id AS point_id FROM balls a, embeddings b WHERE list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: abs(z[1] - z[2]))) <= {L1_EPS}",
        "knn_capped_cover": _f(f", {_KNN} SELECT * FROM capped"),
        "ivf_cover": _f(f""", cells AS MATERIALIZED (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) AS r FROM
            (SELECT b.vec_id, a.vec_id AS cell, {_D} AS d FROM embeddings a, embeddings b WHERE a.vec_id < {CENTERS}))
            SELECT ball_id, point_id FROM dist JOIN cells c ON c.vec_id = point_id AND c.r = 1 JOIN cells q ON q.vec_id = landmark_id AND q.r <= {PROBES} AND q.cell = c.cell WHERE d <= {EPS}
            UNION SELECT ball_id, landmark_id FROM balls"""),
        "lattice_cover": f"WITH {_LATTICE} SELECT * FROM cover",
        "lattice_edges": f"WITH {_LATTICE} SELECT a.ball_id AS src, b.ball_id AS dst, count(*)::BIGINT AS witness_count FROM cover a JOIN cover b ON a.point_id = b.point_id AND a.ball_id < b.ball_id GROUP BY 1, 2",
        "mapper_edges": _g("SELECT * FROM edges"),
        "mapper_edges_symmetric": _g("SELECT * FROM edges UNION ALL SELECT dst, src, witness_count FROM edges"),
        "cover_statistics": _g("SELECT (SELECT count(*) FROM balls) AS m, sum(c)::BIGINT AS S, sum(c * (c - 1) // 2)::BIGINT AS T FROM (SELECT count(*) AS c FROM cover GROUP BY point_id)"),
        "edge_overlaps_given": _g("SELECT ball_id + 1 AS src, ball_id AS dst, coalesce(witness_count, 0)::BIGINT AS overlap FROM balls LEFT JOIN edges e ON e.src = ball_id AND e.dst = ball_id + 1"),
        "patterns": _g("""SELECT pattern, count(*)::BIGINT AS weight, string_agg(point_id::VARCHAR, ',' ORDER BY point_id) AS observations FROM
            (SELECT point_id, string_agg(ball_id::VARCHAR, ',' ORDER BY ball_id) AS pattern, count(*) AS n FROM cover GROUP BY point_id) WHERE n > 1 GROUP BY pattern"""),
        "components": _g(f", {_REACH.format(e='edges')} SELECT a AS ball_id, min(b) AS component FROM reach GROUP BY a"),
        "color_mean": _g(f"SELECT ball_id, round(avg(label::DOUBLE), 6) AS value FROM cover {label} GROUP BY 1"),
        "color_mode": _g(f"""SELECT ball_id, label FROM (SELECT *, row_number() OVER (PARTITION BY ball_id ORDER BY n DESC, f) AS r FROM
            (SELECT ball_id, label, count(*) AS n, min(point_id) AS f FROM cover {label} GROUP BY 1, 2)) WHERE r = 1"""),
        "color_entropy": _g(f"""SELECT ball_id, round(-sum(p * log2(p + 1e-12)), 6) + 0.0 AS value FROM (SELECT ball_id, n::DOUBLE / sum(n) OVER (PARTITION BY ball_id) AS p FROM
            (SELECT ball_id, label, count(*) AS n FROM cover {label} GROUP BY 1, 2)) GROUP BY 1"""),
        "color_size": _g("SELECT ball_id, count(*)::BIGINT AS value FROM cover GROUP BY 1"),
        "color_density": _g("SELECT ball_id, round(n / max(n) OVER (), 6) AS value FROM (SELECT ball_id, count(*)::DOUBLE AS n FROM cover GROUP BY 1)"),
        "node_sizes": _g("SELECT ball_id, round(300.0::DOUBLE * n / max(n) OVER (), 6) AS value FROM (SELECT ball_id, count(*)::DOUBLE AS n FROM cover GROUP BY 1)"),
        "plot_edges": _g("SELECT src, dst, witness_count, round(1 + 4.0::DOUBLE * witness_count / max(witness_count) OVER (), 6) AS edge_width FROM edges"),
        "audit_balls": _t(f"SELECT ball_id, reference_size, approximate_size, tp AS intersection_size, fp AS false_positives, fn AS false_negatives, {r6('precision')}, {r6('recall')}, {r6('jaccard')} FROM scored"),
        "audit_edges": _t("SELECT src, dst, CASE WHEN reference_count > 0 AND approximate_count > 0 THEN 'preserved' WHEN reference_count > 0 THEN 'missing' ELSE 'added' END AS status FROM wit"),
        "audit_witness": _t("SELECT *, approximate_count - reference_count AS change, CASE WHEN reference_count > 0 THEN round(retained_witnesses / reference_count, 6) ELSE 'nan'::DOUBLE END AS retained_fraction FROM wit"),
        "audit_colors": _t(f"""SELECT ball_id, round(coalesce(rm, 'nan'), 6) AS reference_mean, round(coalesce(am, 'nan'), 6) AS approximate_mean, round(abs(coalesce(rm, 'nan') - coalesce(am, 'nan')), 6) AS absolute_error, osc AS oscillation,
            round(osc * (1 - least(precision, recall)), 6) AS error_bound FROM scored JOIN (SELECT ball_id, avg(label::DOUBLE) FILTER (r) AS rm, avg(label::DOUBLE) FILTER (a) AS am, (max(label) - min(label))::DOUBLE AS osc
            FROM both2 {label} GROUP BY 1) USING (ball_id)"""),
        "audit_summary": _t("""SELECT tp, fp, fn, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mj, 6) AS macro_jaccard, edge_tp, edge_fp, edge_fn,
            round(tp / (tp + fp), 6) AS membership_precision, round(tp / (tp + fn), 6) AS membership_recall, round(tp / (tp + fp + fn), 6) AS membership_jaccard,
            round(CASE WHEN edge_tp + edge_fp = 0 THEN 1 ELSE edge_tp / (edge_tp + edge_fp) END, 6)::DOUBLE AS edge_precision, round(CASE WHEN edge_tp + edge_fn = 0 THEN 1 ELSE edge_tp / (edge_tp + edge_fn) END, 6)::DOUBLE AS edge_recall,
            round(CASE WHEN edge_tp + edge_fp + edge_fn = 0 THEN 1 ELSE edge_tp / (edge_tp + edge_fp + edge_fn) END, 6)::DOUBLE AS edge_jaccard
            FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(precision) AS mp, avg(recall) AS mr, avg(jaccard) AS mj FROM scored),
            (SELECT count(*) FILTER (reference_count > 0 AND approximate_count > 0) AS edge_tp, count(*) FILTER (reference_count = 0) AS edge_fp, count(*) FILTER (approximate_count = 0) AS edge_fn FROM wit)"""),
        "boundary_diagnostics": _f(f"""SELECT ball_id, landmark_id, round(min(abs(d - {EPS})), 6) AS min_abs_margin, round({EPS} - max(d) FILTER (d <= {EPS}), 6) AS inside_margin,
            round(coalesce(min(d) FILTER (d > {EPS}), 'inf'::DOUBLE) - {EPS}, 6) AS outside_margin, {', '.join(f'count(*) FILTER (abs(d - {EPS}) <= {w}) AS band{i}' for i, w in enumerate(DELTAS))} FROM dist GROUP BY 1, 2"""),
        "h0_counts": _counts(),
        "h0_from_cover": _counts(),
        "h0_merges": f"""WITH RECURSIVE {_FIXED}, {_ALL}, {_STAR},
            reach(w, src, dst, x) AS (SELECT w, src, dst, src FROM star UNION
              SELECT r.w, r.src, r.dst, s.dst FROM reach r JOIN (SELECT src AS a, dst AS b, src, dst, w FROM star UNION ALL SELECT src, dst, dst, src, w FROM star) s
              ON s.src = r.x AND (s.w, s.a, s.b) < (r.w, r.src, r.dst)),
            tree AS (SELECT w, src, dst FROM star EXCEPT SELECT w, src, dst FROM reach WHERE x = dst)
            SELECT (row_number() OVER (ORDER BY w, src, dst) - 1)::INT AS seq, round(w, 6) AS radius, src, dst FROM tree""",
        "component_certificate": _g(f""", guarded AS MATERIALIZED (SELECT src, dst FROM edges WHERE witness_count > src % 2 + dst % 2),
            {_REACH.format(e='edges')}, reach2(a, b) AS (SELECT ball_id, ball_id FROM balls UNION SELECT r.a, e.dst FROM reach2 r JOIN (SELECT src, dst FROM guarded UNION ALL SELECT dst, src FROM guarded) e ON e.src = r.b)
            SELECT x = y AS certified, x AS exact_components, y AS protected_components, (SELECT count(*) FROM guarded) AS protected_edges FROM
            (SELECT count(DISTINCT m) AS x FROM (SELECT a, min(b) AS m FROM reach GROUP BY a)), (SELECT count(DISTINCT m) AS y FROM (SELECT a, min(b) AS m FROM reach2 GROUP BY a))"""),
        "hnswlib_cover": _f(f", {_KNN} SELECT * FROM capped"),
        "cuvs_cover": _f(f", {_KNN} SELECT * FROM capped"),
        "blocked_balls": _f(f"SELECT ball_id, count(*)::BIGINT AS size, sum(point_id)::BIGINT AS id_sum FROM dist WHERE d <= {EPS} GROUP BY 1"),
        "cover_uncovered": _g("SELECT * FROM cover"),
        "streaming_graph": _f(f", {_EXACT} SELECT a.ball_id AS src, b.ball_id AS dst, count(*)::BIGINT AS witness_count FROM exact a JOIN exact b ON a.point_id = b.point_id AND a.ball_id < b.ball_id GROUP BY 1, 2"),
        "auto_graph": _g("SELECT * FROM edges UNION ALL SELECT dst, src, witness_count FROM edges"),
        "fused_graph": _g("SELECT * FROM edges UNION ALL SELECT dst, src, witness_count FROM edges"),
        "witness_check": _f(f""", {_EXACT}, n AS (SELECT count(*) > 0 AS hit FROM exact a JOIN exact b ON a.point_id = b.point_id AND a.ball_id = 0 AND b.ball_id <> 0)
            SELECT 'enough' AS budget, hit AS valid FROM n UNION ALL SELECT 'short', false"""),
        "witness_survival": _t("""SELECT pow(2, floor(log2(reference_count)))::BIGINT AS bin, count(*)::BIGINT AS edges, count(*) FILTER (approximate_count > 0)::BIGINT AS survived
            FROM wit WHERE reference_count > 0 GROUP BY 1"""),
        "color_errors": _t(f"""SELECT round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(max(e), 6) AS max_error FROM (SELECT abs(rm - am) AS e FROM
            (SELECT ball_id, avg(label::DOUBLE) FILTER (r) AS rm, avg(label::DOUBLE) FILTER (a) AS am FROM both2 {label} GROUP BY 1) WHERE rm IS NOT NULL AND am IS NOT NULL)"""),
        "distances_to_all": f"SELECT b.vec_id AS point_id, round({_D}, 6) AS dist FROM embeddings a, embeddings b WHERE a.vec_id = 0",
        "filtered_candidates": f"SELECT b.vec_id AS point_id FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id % 3 = 0 AND {_D} <= {EPS}",
        "calibrated_radius": f"""SELECT {K}::INT AS k, round(quantile_cont(d, 0.5), 6) AS eps FROM (SELECT {_D} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D}, b.vec_id) AS r
            FROM embeddings a, embeddings b) WHERE r = {K + 1}""",
        "exactness_gate": "SELECT method, true AS equal FROM (VALUES ('ball_tree'), ('brute_force'), ('ckdtree')) t(method)",
        "stream_sizes": _f(f"SELECT ball_id, count(*)::BIGINT AS value FROM dist WHERE d <= {EPS} GROUP BY 1"),
    }
