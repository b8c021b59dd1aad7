"""Point clouds as DataFrames: (point_id long, vec array<double>)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "point_id long, vec array<double>"


def from_table(df: DataFrame, id_col: str = "point_id", vec_col: str = "vec") -> DataFrame:
    """Projection of any table with an id and an array of numbers; the id gives the order of observation."""
    return df.select(F.col(id_col).cast("long").alias("point_id"), F.col(vec_col).cast("array<double>").alias("vec"))


def from_columns(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Projection of scalar columns to vectors."""
    return df.select(F.col(id_col).cast("long").alias("point_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))


def from_array(spark: SparkSession, x) -> DataFrame:
    """A small cloud that is in the driver's memory; row numbers are the ids."""
    x = np.asarray(x)
    if x.ndim != 2:
        raise ValueError("a point cloud is two-dimensional")
    if np.iscomplexobj(x) or not np.issubdtype(x.dtype, np.number) and len(x):
        raise ValueError("a point cloud holds real numbers")
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return validate(spark.createDataFrame(rows, SCHEMA))


def check_radius(eps: float) -> float:
    if isinstance(eps, bool) or not math.isfinite(eps) or eps < 0:
        raise ValueError("eps must be a finite nonnegative number")
    return float(eps)


def dimension(points: DataFrame) -> int:
    """The dimension of the cloud; 0 for an empty one."""
    row = points.select(F.size("vec").alias("d")).first()
    return 0 if row is None else row.d


def validate(points: DataFrame) -> DataFrame:
    """Raises if ids are missing or repeated, dimensions differ, or a coordinate is not finite."""
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    row = points.agg(
        F.count("*").alias("n"), F.count("point_id").alias("ids"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"), F.max(bad).alias("bad")
    ).first()
    if row.n and (row.least != row.most or row.least < 0):
        raise ValueError("all vectors need the same dimension")
    if row.n and row.bad:
        raise ValueError("coordinates must be finite")
    if row.ids < row.n or points.groupBy("point_id").count().where("count > 1").limit(1).count():
        raise ValueError("point ids must be present and unique")
    return points
