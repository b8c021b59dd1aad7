"""Radii for a wanted number of points in a ball, from distances to the k-th nearest point."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covergraph.functions import kernels
from covergraph.operators import range_join as rj
from covergraph.operators.landmarks import numbered
from covergraph.sources.points import dimension
from covergraph.sources.shared import materialize

#: Points in a task where all pairs are compared.
QUERIES = 4096


def order_distances(points: DataFrame, queries: DataFrame, order: int, metric: str = "euclidean") -> DataFrame:
    """(ball_id, dist): the distance of the ``order``-th nearest other point of each query; a query is its own nearest point."""
    if type(order) is not int or order < 0:
        raise ValueError("order is a whole number from 0 on")
    nearest = rj.nearest_distances(points, queries, order + 1, metric)
    rank = F.row_number().over(Window.partitionBy("ball_id").orderBy("dist", "point_id"))
    return nearest.withColumn("rank", rank).where(F.col("rank") == order + 1).select("ball_id", "dist")


def choose_radius(points: DataFrame, target: int, queries: int = 100, seed: int = 0, metric: str = "euclidean") -> float:
    """Median of the distances from ``queries`` points, those of least hash, to their ``target``-th nearest other point."""
    if type(queries) is not int or queries < 1:
        raise ValueError("at least one query is needed")
    chosen = points.orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(queries).select(F.col("point_id").alias("landmark_id"))
    return _median(order_distances(points, numbered(chosen), target, metric))


def calibrate_epsilon(points: DataFrame, k: int, metric: str = "euclidean") -> float:
    """Median over all points of the distance to the k-th nearest other point."""
    return _median(every_order_distance(points, k, metric))


def every_order_distance(points: DataFrame, order: int, metric: str = "euclidean") -> DataFrame:
    """(dist) of every point to its ``order``-th nearest other point.

    All pairs are compared: a block of at most ``BLOCK_BYTES`` of points is broadcast to tasks of ``QUERIES`` points each, which
    keep their nearest distances and hand them to the next block. So memory is bounded, nothing but the points is
    shuffled, and what grows with the square is products of matrices.
    """
    if type(order) is not int or order < 0:
        raise ValueError("order is a whole number from 0 on")
    dim, n, k, context = dimension(points), points.count(), order + 1, points.sparkSession.sparkContext
    groups = max(1, -(-8 * max(dim, 1) * n // rj.BLOCK_BYTES))
    rows = points.select("point_id", "vec", F.pmod(F.xxhash64("point_id"), F.lit(groups)).alias("part"))
    rows = materialize(rows.repartition(max(1, -(-n // QUERIES))), "calibrate")
    step = max(1, min(rj.TILE, (1 << 22) // k))

    def meet(frame: DataFrame, block) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            x = block.value
            for batch in batches:
                for s in range(0, batch.num_rows, step):
                    own = batch.slice(s, step)
                    vec, best = rj.arrow_matrix(own.column(0), dim), own.column(1)
                    dist = best.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), k).copy() if len(best.flatten()) else np.full((len(vec), k), np.inf)
                    ids = np.zeros(dist.shape, np.int64)
                    for t in range(0, len(x), rj.TILE):
                        tile = x[t : t + rj.TILE]
                        kernels.nearer(dist, ids, vec, tile, np.zeros(len(tile), np.int64), metric, t if not len(best.flatten()) else len(x) + t)
                    kept = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1, dtype=np.int32) * k), pa.array(dist.ravel()))
                    yield pa.RecordBatch.from_arrays([own.column(0), kept], ["vec", "best"])

        return frame.mapInArrow(run, "vec array<double>, best array<double>")

    state = rows.select("vec", F.expr("CAST(array() AS array<double>)").alias("best"))
    for g in range(groups):
        block = context.broadcast(rj.collected(rows.where(F.col("part") == g), dim)[1])
        state = meet(state, block)
        if g < groups - 1:
            state = materialize(state, "nearest")
            block.destroy()
    return state.select(F.element_at("best", k).alias("dist")).where(F.col("dist") < float("inf"))


def _median(distances: DataFrame) -> float:
    found = distances.agg(F.expr("percentile(dist, 0.5)").alias("m")).first().m
    if found is None:
        raise ValueError("there are fewer points than the order asks for")
    return float(found)
