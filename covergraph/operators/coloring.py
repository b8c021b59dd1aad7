"""Colours of balls: aggregates over their observations. Empty balls keep a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Aggregates by name that stay in SQL; any other callable on an array becomes a grouped pandas function.
NAMED = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop, "median": F.median}


def color_by_function(values: DataFrame, cover: DataFrame, balls: DataFrame, func: str | Callable = "mean") -> DataFrame:
    """(ball_id, value) of func over values (point_id, value) in the order of ids; empty balls: NaN."""
    held = cover.join(values.select("point_id", F.col("value").cast("double").alias("value")), "point_id")
    if callable(func):
        def apply(key, frame):
            return pd.DataFrame({"ball_id": [key[0]], "value": [float(func(frame.sort_values("point_id")["value"].to_numpy()))]})

        colored = held.select("ball_id", "point_id", "value").groupBy("ball_id").applyInPandas(apply, "ball_id int, value double")
    else:
        colored = held.groupBy("ball_id").agg(NAMED[func]("value").cast("double").alias("value"))
    return balls.select("ball_id").join(colored, "ball_id", "left").select("ball_id", F.coalesce("value", F.lit(float("nan"))).alias("value"))


def color_by_mode(labels: DataFrame, cover: DataFrame, balls: DataFrame) -> DataFrame:
    """(ball_id, label): the most frequent label (point_id, label); of equals the one of the smallest id; empty balls: -1."""
    counted = cover.join(labels, "point_id").groupBy("ball_id", "label").agg(F.count("*").alias("n"), F.min("point_id").alias("first"))
    top = counted.groupBy("ball_id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))
    return balls.select("ball_id").join(top, "ball_id", "left").select("ball_id", F.coalesce("label", F.lit(-1)).alias("label"))


def color_by_entropy(labels: DataFrame, cover: DataFrame, balls: DataFrame) -> DataFrame:
    """(ball_id, value): entropy of the labels in bits; empty balls: 0."""
    counted = cover.join(labels, "point_id").groupBy("ball_id", "label").agg(F.count("*").alias("n"))
    total = cover.join(labels, "point_id").groupBy("ball_id").agg(F.count("*").alias("total"))
    p = F.col("n") / F.col("total")
    entropy = counted.join(total, "ball_id").groupBy("ball_id").agg((-F.sum(p * F.log2(p + F.lit(1e-12)))).alias("value"))
    return balls.select("ball_id").join(entropy, "ball_id", "left").select("ball_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def color_by_size(cover: DataFrame, balls: DataFrame) -> DataFrame:
    """(ball_id, value): number of memberships, repeated ones included."""
    size = cover.groupBy("ball_id").agg(F.count("*").alias("value"))
    return balls.select("ball_id").join(size, "ball_id", "left").select("ball_id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def color_by_density(cover: DataFrame, balls: DataFrame) -> DataFrame:
    """(ball_id, value): size over the largest size; 0 if all are empty."""
    sized = color_by_size(cover, balls)
    most = sized.agg(F.max("value").alias("most"))
    return sized.crossJoin(F.broadcast(most)).select("ball_id", F.when(F.col("most") > 0, F.col("value") / F.col("most")).otherwise(0.0).alias("value"))


def scale_node_sizes(sizes: DataFrame, node_scale: float = 300.0) -> DataFrame:
    """(ball_id, value): sizes (ball_id, value) scaled so that the largest is node_scale."""
    if sizes.where(F.isnan(F.col("value").cast("double")) | (F.col("value") < 0) | (F.col("value") == float("inf"))).limit(1).count():
        raise ValueError("sizes must be finite and nonnegative")
    most = sizes.agg(F.max("value").cast("double").alias("most"))
    return sizes.crossJoin(F.broadcast(most)).select("ball_id", F.when(F.col("most") > 0, F.lit(float(node_scale)) * F.col("value") / F.col("most")).otherwise(0.0).alias("value"))


def values_from_array(spark, values) -> DataFrame:
    """(point_id, value) of a small array, in float64."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.asarray(values, dtype=np.float64))], "point_id long, value double")
