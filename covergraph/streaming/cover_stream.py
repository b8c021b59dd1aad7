"""Covers of a stream of points by fixed landmarks. An extension: selection depends on order and stays a batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergraph.operators import range_join as rj
from covergraph.operators.cover import landmark_table
from covergraph.sources.points import check_radius, dimension


def stream_cover(stream: DataFrame, reference: DataFrame, landmarks, eps: float, metric: str = "euclidean") -> DataFrame:
    """(ball_id, point_id) of a streaming frame (point_id, vec); the landmarks' vectors come from a static cloud."""
    eps, dim = check_radius(eps), dimension(reference)
    table = landmark_table(reference, landmarks)
    block = list(rj.blocks(reference, table, dim))
    if len(block) != 1:
        raise ValueError("a stream takes the landmarks of one block")

    def kernel(ids, x, b):
        from covergraph.functions import kernels
        import numpy as np
        import pandas as pd

        i, j = np.nonzero(kernels.within(x, b.vec, eps, metric))
        return pd.DataFrame({"ball_id": b.ball[j], "point_id": ids[i]})

    return rj.scan(stream, block[0], kernel, rj.COVER, dim)


def stream_sizes(cover: DataFrame) -> DataFrame:
    """(ball_id, value): memberships so far, for update or complete mode."""
    return cover.groupBy("ball_id").agg(F.count("*").alias("value"))
