"""How close the distances of fixed landmarks come to the radius."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergraph.functions import kernels
from covergraph.operators import range_join as rj
from covergraph.operators.cover import landmark_table
from covergraph.sources.points import check_radius, dimension


def compute_boundary_diagnostics(points: DataFrame, landmarks, eps: float, *, metric: str = "euclidean", deltas=None) -> DataFrame:
    """Per landmark: ball_id, landmark_id, min_abs_margin, inside_margin, outside_margin (inf if all points are inside),
    band_counts (map from delta to the number of points with abs(d - eps) <= delta).

    Every block of points hands on one partial row per landmark.
    """
    eps = check_radius(eps)
    if metric not in ("euclidean", "cosine"):
        raise ValueError("metric must be 'euclidean' or 'cosine'")
    widths = list(dict.fromkeys(float(d) for d in (deltas if deltas is not None else ())))
    if any(not math.isfinite(d) or d < 0 for d in widths):
        raise ValueError("deltas must be finite and nonnegative")
    table, dim = landmark_table(points, landmarks), dimension(points)
    names = [f"band{i}" for i in range(len(widths))]

    def kernel(ids, x, block):
        rows = []
        for b, l, c in zip(block.ball, block.landmark, block.vec):
            d = kernels.distances(x, c, metric)
            gap, inside = np.abs(d - eps), d <= eps
            rows.append((b, l, gap.min(initial=np.inf), d[inside].max(initial=-np.inf), d[~inside].min(initial=np.inf), *[int((gap <= w).sum()) for w in widths]))
        return pd.DataFrame(rows, columns=["ball_id", "landmark_id", "gap", "most", "least", *names])

    schema = "ball_id int, landmark_id long, gap double, most double, least double" + "".join(f", {n} long" for n in names)
    parts = rj._union([rj.scan(points, b, kernel, schema, dim) for b in rj.blocks(points, table, dim)], points.sparkSession, schema)
    whole = parts.groupBy("ball_id", "landmark_id").agg(F.min("gap").alias("gap"), F.max("most").alias("most"), F.min("least").alias("least"), *[F.sum(n).alias(n) for n in names])
    bands = F.create_map(*[c for w, n in zip(widths, names) for c in (F.lit(w), F.col(n))]) if widths else F.expr("CAST(map() AS map<double,long>)")
    return whole.select("ball_id", "landmark_id", F.col("gap").alias("min_abs_margin"), (F.lit(eps) - F.col("most")).alias("inside_margin"), (F.col("least") - F.lit(eps)).alias("outside_margin"), bands.alias("band_counts"))
