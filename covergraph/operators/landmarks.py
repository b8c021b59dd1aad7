"""Landmark selection: greedy in order of observation, verified greedy, farthest point.

Greedy selection is the unique kernel of a graph: a point is a landmark unless an earlier landmark's
ball holds it. Metric engines settle growing prefixes of the uncovered points and remove what the new
landmarks cover by a range anti-join, so every pass shrinks the rest. Engines with directed or
approximate balls settle the same recursion on the relation of their balls, in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covergraph.functions import kernels
from covergraph.operators import range_join as rj
from covergraph.sources.points import check_radius, dimension
from covergraph.sources.shared import materialize

#: First number of uncovered points that is settled at once; it doubles up to the bound, within BLOCK_BYTES of vectors.
FIRST, MOST = 32768, 65536


#: Metrics in which the distance of a point to itself is exactly 0, so that an exact ball holds its center.
SELF_HELD = ("euclidean", "manhattan", "chebyshev", "minkowski")


@dataclass(frozen=True)
class Selection:
    """landmarks (ball_id, landmark_id), owners (point_id, ball_id, dist: first ball that holds the point).

    ``blocks`` has the landmarks' vectors, as long as they come to one block.
    """

    landmarks: DataFrame
    owners: DataFrame
    blocks: list[rj.Block] | None = None


def _empty(points: DataFrame, schema: str) -> DataFrame:
    return points.sparkSession.createDataFrame([], schema)


def select_landmarks_uncovered(points: DataFrame, eps: float, *, metric="euclidean", p: float = 2.0, first: int = FIRST, most: int = MOST) -> Selection:
    """Exact greedy landmarks with the first ball that holds each point."""
    eps, dim, spark = check_radius(eps), dimension(points), points.sparkSession
    most = max(1, min(most, rj.BLOCK_BYTES // (8 * max(dim, 1))))
    rest, size = points.select("point_id", "vec"), min(first, most)
    owned, blocks, held, ball = [], [], [], 0

    def sort_out(frame: DataFrame, block: rj.Block) -> DataFrame:
        """Owners of what the block's balls hold; what they do not hold keeps its vector."""
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            import pyarrow as pa

            own = shared.value
            step = max(1, min(8192, (1 << 22) // max(1, len(own.ball))))
            for batch in batches:
                for s in range(0, batch.num_rows, step):
                    part = batch.slice(s, step)
                    x = rj.arrow_matrix(part.column(1), dim)
                    near = kernels.within(x, own.vec, eps, metric, p)
                    hit, first_ = near.any(axis=1), near.argmax(axis=1)
                    d, at = np.zeros(len(x)), np.flatnonzero(hit)
                    if len(at):
                        d[at] = rj._pair_distances(x[at], own.vec, np.arange(len(at)), first_[at], metric, p)
                    held = pa.array(np.where(hit, own.ball[first_], -1).astype(np.int32))
                    kept = pa.compute.if_else(pa.array(hit), pa.scalar(None, part.column(1).type), part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0), held, pa.array(d), kept], ["point_id", "ball_id", "dist", "vec"])

        return frame.mapInArrow(run, "point_id long, ball_id int, dist double, vec array<double>")

    while True:
        ids, x = rj.collected(rest.orderBy("point_id").limit(size), dim)
        if not len(ids):
            break
        new = kernels.greedy(x, eps, metric, p)
        block = rj.Block(ball + np.arange(len(new)), ids[new], x[new])
        blocks.append(pd.DataFrame({"ball_id": block.ball, "landmark_id": block.landmark}))
        ball += len(new)
        held = [*held, block] if ball * 8 * dim <= rj.BLOCK_BYTES else []
        if len(ids) < size:
            # All that was left is settled; its owners are calculated where they are asked for.
            owned.append(sort_out(rest, block).select("point_id", "ball_id", "dist"))
            break
        state = materialize(sort_out(rest, block), "uncovered")
        owned.append(state.where("ball_id >= 0").select("point_id", "ball_id", "dist"))
        rest = state.where("ball_id < 0").select("point_id", "vec")
        size = min(most, 2 * size)
    if not blocks:
        return Selection(_empty(points, "ball_id int, landmark_id long"), _empty(points, "point_id long, ball_id int, dist double"))
    landmarks = spark.createDataFrame(pd.concat(blocks).astype({"ball_id": "int32", "landmark_id": "int64"}), "ball_id int, landmark_id long")
    owners = owned[0]
    for o in owned[1:]:
        owners = owners.unionByName(o)
    whole = held and sum(len(b.ball) for b in held) == ball
    return Selection(landmarks, owners, [rj.Block(*(np.concatenate([getattr(b, n) for b in held]) for n in ("ball", "landmark", "vec")))] if whole else None)


def greedy_from_relation(ids: DataFrame, balls: DataFrame, *, max_rounds: int = 10_000) -> DataFrame:
    """(ball_id, landmark_id) by rounds over a relation (landmark_id, point_id) of directed balls.

    A point without an undecided or chosen earlier neighbour whose ball holds it is chosen; points that
    a chosen one's ball holds are covered.
    """
    before = materialize(balls.where("landmark_id < point_id").select(F.col("landmark_id").alias("i"), F.col("point_id").alias("j")).distinct(), "relation")
    open_, chosen = materialize(ids.select("point_id"), "open"), []
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        live = before.join(open_.withColumnRenamed("point_id", "i"), "i", "left_semi")
        free = materialize(open_.join(live.select(F.col("j").alias("point_id")), "point_id", "left_anti"), "chosen")
        chosen.append(free)
        gone = before.join(free.withColumnRenamed("point_id", "i"), "i", "left_semi").select(F.col("j").alias("point_id")).unionByName(free)
        open_ = materialize(open_.join(gone, "point_id", "left_anti"), "open")
    else:
        raise RuntimeError("greedy rounds did not end")
    if not chosen:
        return ids.sparkSession.createDataFrame([], "ball_id int, landmark_id long")
    every = chosen[0]
    for c in chosen[1:]:
        every = every.unionByName(c)
    return numbered(every.withColumnRenamed("point_id", "landmark_id"))


def numbered(landmarks: DataFrame) -> DataFrame:
    """Ordinals of landmarks in order of their ids: ranges of ids are numbered apart, from where the range before ends."""
    rows = landmarks.select(F.col("landmark_id").cast("long").alias("landmark_id")).repartitionByRange("landmark_id").withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "numbered")
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    if total > (1 << 31) - 1:
        raise ValueError("ball ids are 32-bit integers")
    begin = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part")) if before else F.lit(0)
    number = F.row_number().over(Window.partitionBy("part").orderBy("landmark_id")) - 1
    return rows.select((number + begin).cast("int").alias("ball_id"), "landmark_id")


def compute_landmarks(
    points: DataFrame, eps: float, method: str = "ball_tree", metric="euclidean", leaf_size: int = 40, metric_kwargs=None,
    faiss_config=None, hnswlib_config=None, cuvs_config=None, *, backend=None,
) -> tuple[DataFrame, DataFrame]:
    """Greedy landmarks and their balls: (ball_id, landmark_id), (ball_id, point_id); a landmark is in its ball."""
    check_radius(eps)
    engine = resolve_backend(points, method, metric, leaf_size, metric_kwargs, faiss_config, hnswlib_config, cuvs_config, backend)
    if isinstance(engine, (rj.BruteForceBackend, rj.BallTreeBackend, rj.CKDTreeBackend)):
        chosen = select_landmarks_uncovered(points, eps, metric=engine.metric, p=engine.p)
        landmarks = chosen.landmarks
        cover = engine.query_radius(landmarks, eps) if isinstance(engine, rj.CKDTreeBackend) else engine.query_radius(landmarks, eps, held=chosen.blocks)
        if engine.metric in SELF_HELD:
            return landmarks, cover
        return landmarks, rj.with_self(cover, landmarks)
    else:
        if points.isEmpty():
            return _empty(points, "ball_id int, landmark_id long"), _empty(points, rj.COVER)
        every = numbered(points.select(F.col("point_id").alias("landmark_id")))
        balls = engine.query_radius(every, eps).join(every, "ball_id").select("landmark_id", "point_id")
        landmarks = greedy_from_relation(points.select("point_id"), balls)
    return landmarks, rj.with_self(engine.query_radius(landmarks, eps), landmarks)


def resolve_backend(points, method="ball_tree", metric="euclidean", leaf_size=40, metric_kwargs=None, faiss_config=None, hnswlib_config=None, cuvs_config=None, backend=None):
    if backend is None:
        return rj.make_backend(points, method, metric, leaf_size, metric_kwargs, faiss_config, hnswlib_config, cuvs_config)
    if any(c is not None for c in (metric_kwargs, faiss_config, hnswlib_config, cuvs_config)):
        raise ValueError("a ready backend takes no configuration")
    if backend.n_samples != points.count():
        raise ValueError("the backend holds another number of points")
    return backend


@dataclass(frozen=True)
class VerifiedSelection:
    """Landmarks and balls of the verified selection with its work: tests of coverage, candidates, rescues, completion."""

    landmarks: DataFrame
    cover: DataFrame
    memberships_complete: bool
    coverage_distance_evaluations: int
    candidate_distance_evaluations: int
    rescued_points: int
    completion_distance_evaluations: int


def compute_landmarks_verified(points: DataFrame, eps: float, candidates: Callable[[int, float], object] | DataFrame | None = None, *, complete: bool = False) -> VerifiedSelection:
    """The exact greedy sequence with any candidate provider: a relation (landmark_id, point_id), or a function of id and eps.

    Candidates are tested and only then belong to a ball; points without one join the first ball that
    holds them. ``complete`` gives the whole balls.
    """
    eps = check_radius(eps)
    n = points.count()
    chosen = select_landmarks_uncovered(points, eps)
    landmarks = chosen.landmarks
    m = landmarks.count()
    given = None
    if isinstance(candidates, DataFrame):
        given = candidates.join(landmarks, "landmark_id").select("ball_id", "point_id").distinct()
    elif candidates is not None:
        rows = [(r.ball_id, int(i)) for r in landmarks.orderBy("ball_id").toLocalIterator() for i in set(map(int, candidates(r.landmark_id, eps)))]
        given = points.sparkSession.createDataFrame(rows, rj.COVER)
    own = landmarks.select("ball_id", F.col("landmark_id").alias("point_id"))
    inside, tested = own, 0
    if given is not None:
        tested = given.count()
        known = given.join(points, "point_id").select("ball_id", "point_id", "vec")
        if known.count() < tested:
            raise IndexError("a candidate id is out of range")
        inside = own.unionByName(_inside(known, landmarks, points, eps)).distinct()
    inside = materialize(inside, "verified")
    # A candidate of a later landmark may be marked before: it counts as rescued if it came first.
    mark = inside.groupBy("point_id").agg(F.min("ball_id").alias("mark"))
    late = chosen.owners.join(mark, "point_id", "left").join(landmarks.select(F.col("ball_id").alias("mark"), F.col("landmark_id").alias("mark_id")), "mark", "left")
    rescued = late.where(F.col("mark_id").isNull() | (F.col("mark_id") > F.col("point_id"))).select("ball_id", "point_id")
    rescued = materialize(rescued, "rescued")
    cover = rj.block_join(points, landmarks, eps) if complete else inside.unionByName(rescued).distinct()
    work = chosen.owners.agg(F.coalesce(F.sum(F.col("ball_id") + 1), F.lit(0))).first()[0]
    return VerifiedSelection(landmarks, cover, complete, int(work), tested, rescued.count(), m * n if complete else 0)


def _inside(known: DataFrame, landmarks: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """Those (ball_id, point_id, vec) that lie in the ball."""
    centers = rj.query_vectors(points, landmarks).select("ball_id", F.col("vec").alias("center"))

    def test(batches):
        for b in batches:
            x, c = np.array(b["vec"].tolist()).reshape(len(b), -1), np.array(b["center"].tolist()).reshape(len(b), -1)
            yield b.loc[np.linalg.norm(x - c, axis=1) <= eps, ["ball_id", "point_id"]]

    return known.join(centers, "ball_id").mapInPandas(test, rj.COVER)


def compute_landmarks_fps(
    points: DataFrame, eps: float, start_index: int | None = None, method: str = "ball_tree", metric="euclidean", leaf_size: int = 40, *,
    backend=None, checkpoint_every: int = 256, candidates: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """Farthest-point landmarks until every point lies within eps of one, and their balls.

    Starts at the lexicographically least vector; of equally far points the smallest id comes next.
    """
    eps = check_radius(eps)
    if points.isEmpty():
        if start_index is not None:
            raise ValueError("an empty cloud has no start")
        return _empty(points, "ball_id int, landmark_id long"), _empty(points, rj.COVER)
    if method == "faiss" and backend is None:
        engine = rj.FaissFlatBackend(points, metric)
    else:
        engine = resolve_backend(points, method, metric, leaf_size, backend=backend)
    if not engine.metadata.supports_distances_to_all:
        raise ValueError(f"{engine.metadata.name} gives no distances to all points")
    dim, metric_, p = dimension(points), getattr(engine, "metric", metric), getattr(engine, "p", 2.0)
    if start_index is None:
        current = points.agg(F.min(F.struct("vec", "point_id")).alias("m")).first().m
    else:
        if isinstance(start_index, bool) or not isinstance(start_index, int):
            raise TypeError("start_index is an integer")
        current = points.where(F.col("point_id") == start_index).select("vec", "point_id").first()
        if current is None:
            raise IndexError("start_index is out of range")
    chosen, since = [], []
    state = points.select("point_id", "vec", F.lit(float("inf")).alias("best"))

    def nearer(frame: DataFrame, centers: list) -> DataFrame:
        shared = points.sparkSession.sparkContext.broadcast(np.array(centers, dtype=np.float64).reshape(len(centers), dim))

        def run(batches):
            for b in batches:
                x, best = rj.matrix(b["vec"], dim), b["best"].to_numpy().copy()
                for c in shared.value:
                    np.minimum(best, kernels.distances(x, c, metric_, p), out=best)
                yield b.assign(best=best)

        return frame.mapInPandas(run, "point_id long, vec array<double>, best double")

    new = [(int(current.point_id), np.array(current.vec, dtype=np.float64))]
    while new:
        chosen += [k for k, _ in new]
        since += [v for _, v in new]
        now = nearer(state, since)
        if len(since) >= checkpoint_every:
            state, since = materialize(now, "fps"), []
            now = state
        # Distances only shrink. So the farthest of these candidates is the farthest of all as long as it
        # is farther than the first point that is no candidate, and one pass yields many landmarks.
        top = now.orderBy(F.col("best").desc(), "point_id").limit(candidates + 1).toArrow()
        bound = top.column("best")[candidates].as_py() if top.num_rows > candidates else -np.inf
        top = top.slice(0, candidates)
        ids, x, best = top.column("point_id").to_numpy(), rj.arrow_matrix(top.column("vec"), dim), top.column("best").to_numpy().copy()
        new = []
        while len(ids):
            far = best.max()
            if not far > eps or new and not far > bound:
                break
            at = np.flatnonzero(best == far)
            k = at[ids[at].argmin()]
            new.append((int(ids[k]), x[k]))
            np.minimum(best, kernels.distances(x, x[k], metric_, p), out=best)
    landmarks = points.sparkSession.createDataFrame([(i, k) for i, k in enumerate(chosen)], "ball_id int, landmark_id long")
    return landmarks, rj.with_self(engine.query_radius(landmarks, eps), landmarks)
