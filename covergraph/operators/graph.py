"""The overlap graph of a cover: balls are vertices, shared observations are witnesses.

Witness pairs are counted from patterns: observations in the same balls are one pattern with a
weight, so a pair of balls is emitted once per pattern and not once per observation.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergraph.operators import range_join as rj
from covergraph.operators.components import connected_components
from covergraph.operators.witness import counted_pairs
from covergraph.sources.points import check_radius, dimension
from covergraph.sources.shared import materialize

EDGES = "src int, dst int, witness_count long"
#: Memberships of an iterable that the driver holds before they are written.
HELD_ROWS = 1_000_000
#: Edges of a ball graph whose components are settled in one task.
SMALL_GRAPH = 200_000
#: Fixed values of the choice between plain and matrix counting.
STREAM_BALLS, STREAM_MEMBERSHIPS, STREAM_WITNESSES, STREAM_RATIO = 128, 2048, 512, 4.0


def from_arrays(spark: SparkSession, cover: Iterable[Iterable[int]], n_balls: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(balls, cover) of an iterable of balls, which is read once, one ball at a time; its length has to be n_balls if that is given.

    Memberships are written to the shared folder whenever HELD_ROWS of them are waiting.
    """
    schema, parts, waiting, seen = "ball_id int, point_id long", [], 0, 0
    held: list[pa.Table] = []

    def flush() -> DataFrame:
        # One chunk each: Spark takes only the first of several.
        frame = pa.concat_tables([pa.table({"ball_id": pa.array([], pa.int32()), "point_id": pa.array([], pa.int64())}), *held])
        held.clear()
        return spark.createDataFrame(frame.combine_chunks(), schema)

    for ids in cover:
        if seen == n_balls:
            raise ValueError("n_balls is smaller than the cover")
        own = np.asarray(ids if isinstance(ids, (list, np.ndarray)) else list(ids))
        own = own.astype(np.int64) if np.issubdtype(own.dtype, np.integer) else np.fromiter((int(i) for i in own.tolist()), np.int64)
        held.append(pa.table({"ball_id": np.full(len(own), seen, np.int32), "point_id": own}))
        seen, waiting = seen + 1, waiting + len(own)
        if waiting >= HELD_ROWS:
            parts.append(materialize(flush(), "balls"))
            waiting = 0
    if n_balls is not None and seen != n_balls:
        raise ValueError("n_balls is larger than the cover")
    table = flush()
    for part in parts:
        table = table.unionByName(part)
    return spark.range(seen).select(F.col("id").cast("int").alias("ball_id")), table


def patterns(cover: DataFrame, *, least: int = 2) -> DataFrame:
    """(pattern: sorted balls, weight, observations) of observations in ``least`` balls or more."""
    held = cover.groupBy("point_id").agg(F.sort_array(F.collect_set("ball_id")).alias("pattern")).where(F.size("pattern") >= least)
    return held.groupBy("pattern").agg(F.count("*").alias("weight"), F.sort_array(F.collect_list("point_id")).alias("observations"))


def build_mapper(cover: DataFrame) -> DataFrame:
    """Edges (src < dst, witness_count); memberships that are repeated count once."""
    held = cover.groupBy("point_id").agg(F.sort_array(F.collect_set("ball_id")).alias("b")).where(F.size("b") > 1)
    return _pairs(held.groupBy("b").agg(F.count("*").alias("w")))


def _pairs(weighted: DataFrame) -> DataFrame:
    """Edges of patterns (b: sorted balls, w: weight)."""
    coded = weighted.select(F.transform("b", lambda x: x.cast("long") * 4 + 1).alias("b"), "w")
    return counted_pairs(coded).select("src", "dst", F.col("n1").alias("witness_count"))


def mapper_of_places(points: DataFrame, landmarks: DataFrame, eps: float) -> DataFrame:
    """Edges of the exact Euclidean balls of landmarks, without their cover, in few dimensions.

    Points in one place are one witness with a weight, and landmarks in one place are one ball, whose edges all of them take.
    """
    eps = check_radius(eps)
    dim = dimension(points)
    if not rj.on_grid(dim, eps):
        return build_mapper(rj.block_join(points, landmarks, eps))
    centers, near = rj.near_places(points, landmarks, eps, dim)
    near = materialize(near, "near-places")
    held = near.groupBy("vec").agg(F.first("k").alias("w"), F.sort_array(F.collect_set("center")).alias("b")).where(F.size("b") > 1)
    found = _pairs(held.groupBy("b").agg(F.sum("w").alias("w")))
    side = lambda name, to: centers.select(F.col("center").alias(name), F.col("balls").alias(to))
    found = materialize(found.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("a", "b", "witness_count"), "edges-of-places")
    rows = found.agg(F.sum(F.size("a").cast("long") * F.size("b"))).first()[0] or 0
    apart = rj.dealt(found, rows).select("witness_count", F.explode("a").alias("x"), "b").select("witness_count", "x", F.explode("b").alias("y"))
    apart = apart.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "witness_count")
    # Landmarks in one place share all their points.
    inside = near.groupBy("center").agg(F.sum("k").cast("long").alias("witness_count")).join(centers.where(F.size("balls") > 1), "center").select("witness_count", F.sort_array("balls").alias("b"))
    rows = centers.agg(F.sum(F.size("balls").cast("long") * F.size("balls"))).first()[0] or 0
    inside = rj.dealt(inside, rows).select("witness_count", "b", F.posexplode("b").alias("i", "src"))
    inside = inside.select("src", F.explode(F.slice("b", F.col("i") + 2, F.size("b"))).alias("dst"), "witness_count")
    return apart.unionByName(inside)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: the coordinate form of the symmetric matrix."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "witness_count"))


def compute_edge_overlaps(cover: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, overlap) of given pairs in their own direction; pairs without a common observation have 0."""
    asked = edges.select(F.explode(F.array("src", "dst")).alias("ball_id")).distinct()
    known = build_mapper(cover.join(asked, "ball_id", "left_semi"))
    wanted = edges.select("src", "dst", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return wanted.join(known.select(F.col("src").alias("a"), F.col("dst").alias("b"), "witness_count"), ["a", "b"], "left").select(
        "src", "dst", F.coalesce("witness_count", F.lit(0)).cast("long").alias("overlap"))


def cover_statistics(cover: DataFrame, balls: DataFrame) -> DataFrame:
    """One row: m balls, S distinct memberships, T witness pairs."""
    degree = cover.distinct().groupBy("point_id").agg(F.count("*").alias("k"))
    sums = degree.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("S"), F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).cast("long").alias("T"))
    return balls.agg(F.count("*").cast("long").alias("m")).crossJoin(F.broadcast(sums))


def select_mapper_algorithm(cover: DataFrame, balls: DataFrame, *, stream_max_balls: int = STREAM_BALLS, stream_max_memberships: int = STREAM_MEMBERSHIPS,
                            stream_max_witnesses: int = STREAM_WITNESSES, stream_witness_ratio: float = STREAM_RATIO) -> str:
    """'streaming' for tiny sparse covers, else 'csr'. Both name the same plan here; the engine adapts at run time."""
    if balls.count() > stream_max_balls:
        return "csr"
    s = cover_statistics(cover, balls).first()
    if s.S > stream_max_memberships:
        return "csr"
    return "streaming" if s.T <= min(stream_max_witnesses, stream_witness_ratio * max(s.S, 1)) else "csr"


def build_mapper_auto(cover: DataFrame, balls: DataFrame, *, output: str = "csr", algorithm: str = "auto", stream_witness_ratio: float = STREAM_RATIO) -> DataFrame:
    """output 'csr': both directions of each edge; 'networkx': each edge once."""
    if algorithm not in ("auto", "csr", "streaming"):
        raise ValueError("algorithm must be 'auto', 'csr' or 'streaming'")
    if output not in ("csr", "networkx"):
        raise ValueError("output must be 'csr' or 'networkx'")
    if not 0 <= stream_witness_ratio < float("inf"):
        raise ValueError("stream_witness_ratio must be finite and nonnegative")
    edges = build_mapper(cover)
    return symmetric(edges) if output == "csr" else edges


def ball_mapper_components(cover: DataFrame, balls: DataFrame) -> DataFrame:
    """(ball_id, component: its smallest ball) without building edges: each observation links its balls to its smallest one."""
    least = cover.groupBy("point_id").agg(F.min("ball_id").alias("least"))
    stars = cover.join(least, "point_id").where("ball_id != least").select(F.col("least").alias("src"), F.col("ball_id").alias("dst")).distinct()
    # Balls are the small side; graphs of very many go through the rounds.
    found = connected_components(stars, one_task=SMALL_GRAPH)
    return balls.select("ball_id").join(found.select(F.col("node").cast("int").alias("ball_id"), F.col("component").cast("int").alias("component")), "ball_id", "left").select(
        "ball_id", F.coalesce("component", "ball_id").alias("component"))


def compute_mapper_streaming(points: DataFrame, eps: float, *, output: str = "csr") -> tuple[DataFrame, DataFrame]:
    """Landmarks and graph in one plan, without keeping the cover."""
    from covergraph.operators.cover import build_cover_blocked
    from covergraph.operators.landmarks import select_landmarks_uncovered

    landmarks = select_landmarks_uncovered(points, eps).landmarks
    return landmarks, build_mapper_auto(build_cover_blocked(points, landmarks, eps), landmarks, output=output)
