"""Call forms that callers of earlier interfaces know: options by name, constructors of single engines, candidate lists."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergraph.functions import kernels
from covergraph.operators import range_join as rj
from covergraph.operators.cover import build_cover
from covergraph.operators.landmarks import compute_landmarks
from covergraph.sources.points import check_radius, dimension

#: Names of engines of the candidate filter; all run the same Arrow kernel.
ENGINES = ("scalar", "batch", "numba", "auto")


def engine_name(engine: str) -> str:
    """The engine that a name stands for: 'auto' is 'batch'."""
    if engine not in ENGINES:
        raise ValueError(f"there is no engine {engine!r}, only {', '.join(ENGINES)}")
    return {"auto": "batch"}.get(engine, engine)


def block_rows(block_size: int) -> int:
    """A number of rows taken at a time."""
    if isinstance(block_size, (bool, np.bool_)) or not isinstance(block_size, (int, np.integer)) or block_size < 1:
        raise ValueError("block_size is a whole number from 1 on")
    return int(block_size)


def normalize_backend_options(method: str, metric: str = "euclidean", leaf_size: int = 40, metric_kwargs: Mapping[str, Any] | None = None) -> tuple[str, str, dict]:
    """(method, metric, metric options) under their usual names; what does not go together is an error."""
    for what in (method, metric):
        if not isinstance(what, str):
            raise TypeError(f"a name is expected, not {what!r}")
    name = rj.backend_name(method)
    options, metric = dict(metric_kwargs or {}), metric.lower()
    if name == "ball_tree":
        rj.check_leaf_size(leaf_size)
    elif name not in ("brute_force", "faiss"):
        raise ValueError(f"{method!r} takes no such options")
    elif metric not in ("euclidean", "cosine") or options:
        raise ValueError(f"{name} takes the metrics euclidean and cosine, without options")
    return name, metric, options


def filter_candidates(points: DataFrame, center: int, candidates: DataFrame, eps: float, *, engine: str = "batch", block_size: int = 16384) -> DataFrame:
    """(point_id) of the candidates (point_id) that lie in the closed ball of a point; every engine decides by the direct norm."""
    engine_name(engine)
    eps, dim, step = check_radius(eps), dimension(points), block_rows(block_size)
    row = points.where(F.col("point_id") == center).first()
    if row is None:
        raise IndexError(f"no point {center}")
    own = np.array(row.vec, dtype=np.float64)

    def test(batches):
        for b in batches:
            for s in range(0, len(b), step):
                part = b.iloc[s : s + step]
                yield part.loc[kernels.distances(rj.matrix(part["vec"], dim), own) <= eps, ["point_id"]]

    return points.join(candidates.select("point_id").distinct(), "point_id", "left_semi").select("point_id", "vec").mapInPandas(test, "point_id long")


def create_ball_tree(points: DataFrame, metric="euclidean", leaf_size: int = 40, **metric_kwargs) -> rj.BallTreeBackend:
    return rj.BallTreeBackend(points, metric, leaf_size, metric_kwargs)


def create_euclidean_index(points: DataFrame, config: rj.FaissConfig | None = None) -> rj.FaissRangeBackend:
    return rj.FaissRangeBackend(points, "euclidean", config)


def create_cosine_index(points: DataFrame, config: rj.FaissConfig | None = None) -> rj.FaissRangeBackend:
    return rj.FaissRangeBackend(points, "cosine", config)


def query_brute_force_range(points: DataFrame, queries: DataFrame, eps: float, metric: str = "euclidean") -> DataFrame:
    return rj.BruteForceBackend(points, metric).query_radius(queries, eps)


def compute_landmarks_brute_force(points: DataFrame, eps: float, metric: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    return compute_landmarks(points, eps, "brute_force", metric)


def build_cover_brute_force(points: DataFrame, landmarks, eps: float, metric: str = "euclidean") -> DataFrame:
    return build_cover(points, landmarks, eps, "brute_force", metric)


def compute_landmarks_ball_tree(points: DataFrame, eps: float, metric="euclidean", leaf_size: int = 40, metric_kwargs=None) -> tuple[DataFrame, DataFrame]:
    return compute_landmarks(points, eps, "ball_tree", metric, leaf_size, metric_kwargs)


def build_cover_ball_tree(points: DataFrame, landmarks, eps: float, metric="euclidean", leaf_size: int = 40, metric_kwargs=None) -> DataFrame:
    return build_cover(points, landmarks, eps, "ball_tree", metric, leaf_size, metric_kwargs)


def compute_landmarks_faiss(points: DataFrame, eps: float, metric: str = "euclidean", config: rj.FaissConfig | None = None) -> tuple[DataFrame, DataFrame]:
    return compute_landmarks(points, eps, "faiss", metric, faiss_config=config)


def build_cover_faiss(points: DataFrame, landmarks, eps: float, metric: str = "euclidean", config: rj.FaissConfig | None = None) -> DataFrame:
    return build_cover(points, landmarks, eps, "faiss", metric, faiss_config=config)
