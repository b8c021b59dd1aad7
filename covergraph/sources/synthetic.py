"""Generated point clouds for benchmarks: the values follow from the seed and the row number."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def cloud(spark: SparkSession, kind: str, n: int, dim: int, seed: int = 0, partitions: int | None = None, *, single: bool = True, spread: float = 0.35) -> DataFrame:
    """``gaussian``, ``uniform``, ``mixture`` (six centers, ``spread`` wide) or ``curve`` (a noisy closed curve), in single or double precision."""
    if kind not in ("gaussian", "uniform", "mixture", "curve"):
        raise ValueError(f"unknown kind {kind!r}")
    centers = np.random.default_rng(seed).standard_normal((6, dim)) * 2.0
    waves = np.random.default_rng(seed + 1).standard_normal((4, dim))

    def make(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            rows = []
            for i in ids.tolist():
                g = np.random.default_rng([seed, i])
                if kind == "gaussian":
                    v = g.standard_normal(dim)
                elif kind == "uniform":
                    v = g.random(dim)
                elif kind == "mixture":
                    v = centers[int(g.integers(6))] + spread * g.standard_normal(dim)
                else:
                    t = 2 * np.pi * g.random()
                    v = np.array([np.cos(t), np.sin(t), np.cos(2 * t), np.sin(2 * t)]) @ waves + 0.03 * g.standard_normal(dim)
                rows.append(v.astype(np.float32).astype(np.float64) if single else v)
            yield pd.DataFrame({"point_id": ids, "vec": rows})

    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).mapInPandas(make, "point_id long, vec array<double>")


def lattice(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """All points of an integer lattice."""
    size = int(np.prod(shape))

    def make(batches):
        for batch in batches:
            grid = np.stack(np.unravel_index(batch["id"].to_numpy(), shape), axis=1).astype(np.float64)
            yield pd.DataFrame({"point_id": batch["id"], "vec": list(grid)})

    return spark.range(size).mapInPandas(make, "point_id long, vec array<double>")


def lattice_cover(spark: SparkSession, shape: tuple[int, ...], *, eps: float = 1.0, spacing: float = 1.4, seed: int = 0, witnesses: int = 1) -> tuple[DataFrame, DataFrame]:
    """Points around a lattice of balls, and its centers as landmarks (ball_id, landmark_id).

    The points are the centers, slightly moved, then ``witnesses`` points near the middle of every pair of
    balls that overlap clearly, then a second point near each center. Neighbours are looked up by
    offsets, so every center has a bounded number of pairs.
    """
    size, dim = int(np.prod(shape)), len(shape)
    reach = int(2 * eps // spacing) + 1
    offsets = [o for o in np.ndindex(*[2 * reach + 1] * dim) if tuple(o) > (reach,) * dim]

    def center(i: int) -> np.ndarray:
        return np.array(np.unravel_index(i, shape), dtype=float) * spacing + 0.005 * np.random.default_rng([seed, i, 0]).standard_normal(dim)

    def make(batches):
        for batch in batches:
            rows = []
            for i in batch["id"].tolist():
                own, at = center(i), np.array(np.unravel_index(i, shape))
                rows += [(i, own), (size + i, own + 0.08 * np.random.default_rng([seed, i, 1]).standard_normal(dim))]
                for n, o in enumerate(offsets):
                    other = at + np.array(o) - reach
                    if (other < 0).any() or (other >= np.array(shape)).any():
                        continue
                    far = center(int(np.ravel_multi_index(tuple(other), shape)))
                    if np.linalg.norm(own - far) <= 2 * eps * 0.97:
                        g = np.random.default_rng([seed, i, 2 + n])
                        rows += [(size * (2 + n * witnesses + w) + i, (own + far) / 2 + 0.003 * g.standard_normal(dim)) for w in range(witnesses)]
            yield pd.DataFrame(rows, columns=["point_id", "vec"])

    points = spark.range(size).mapInPandas(make, "point_id long, vec array<double>")
    return points, spark.range(size).selectExpr("CAST(id AS INT) AS ball_id", "id AS landmark_id")
