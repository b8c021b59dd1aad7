"""Rows of audits and diagnostics as records, gates over them, and files of results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from covergraph.operators.audit import covers_equal
from covergraph.operators.graph import build_mapper
from covergraph.operators.landmarks import compute_landmarks
from covergraph.sources.shared import materialize


@dataclass(frozen=True)
class BallMembershipAudit:
    """A row of ``audit_balls``."""

    ball_id: int
    reference_size: int
    approximate_size: int
    intersection_size: int
    false_positives: int
    false_negatives: int
    precision: float
    recall: float
    jaccard: float


@dataclass(frozen=True)
class EdgeWitnessChange:
    """A row of ``audit_witness``."""

    src: int
    dst: int
    reference_count: int
    approximate_count: int
    retained_witnesses: int
    lost_witnesses: int
    added_witnesses: int
    change: int
    retained_fraction: float
    status: str


@dataclass(frozen=True)
class ColorAudit:
    """A row of ``audit_colors``."""

    ball_id: int
    reference_mean: float
    approximate_mean: float
    absolute_error: float
    oscillation: float
    error_bound: float


@dataclass(frozen=True)
class BoundaryDiagnostics:
    """A row of ``compute_boundary_diagnostics``."""

    ball_id: int
    landmark_id: int
    min_abs_margin: float
    inside_margin: float
    outside_margin: float
    band_counts: dict[float, int]


def records(table: DataFrame, kind: type) -> Iterator:
    """The rows of a table as records of a kind, in order of its first column, one at a time."""
    names = [f.name for f in fields(kind)]
    for row in table.select(*names).orderBy(names[0]).toLocalIterator():
        yield kind(*row)


#: Methods whose memberships may be too few, but never wrong.
CONSERVATIVE = ("ivf", "hnsw")


def gate_failures(method: str, *, landmarks_equal: bool, cover_equal: bool, graph_equal: bool, false_positives: int, color_bound_violations: int = 0, covers_all: bool = True) -> list[str]:
    """What an engine's run breaks of its promise; an exact one has to equal the reference in everything."""
    partial = method in CONSERVATIVE or method.endswith("partial")
    rules = [
        ("the graph's witness counts differ", graph_equal), (f"{color_bound_violations} colours lie beyond their bound", not color_bound_violations),
        ("the landmarks differ", landmarks_equal or partial), ("the memberships differ", cover_equal or partial),
        (f"{false_positives} memberships are wrong", not false_positives or not partial), ("some points are in no ball", covers_all or not method.startswith("verified")),
    ]
    return [what for what, held in rules if not held]


def exactness_gate(points: DataFrame, eps: float, methods: tuple[str, ...] = ("ball_tree", "brute_force", "ckdtree")) -> dict[str, bool]:
    """Per method whether its landmarks, memberships and edges are those of the first one."""
    def run(method: str) -> tuple[DataFrame, ...]:
        landmarks, cover = compute_landmarks(points, eps, method)
        return landmarks, materialize(cover, "gate"), materialize(build_mapper(cover), "gate")

    first = run(methods[0])
    return {m: True if m == methods[0] else all(covers_equal(a, b) for a, b in zip(first, run(m))) for m in methods}


def write_results(table: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table of results as files of one kind: parquet, json, or csv (arrays and maps as JSON text)."""
    if kind not in ("parquet", "json", "csv"):
        raise ValueError("results are written as parquet, json or csv")
    if kind == "csv":
        nested = [f.name for f in table.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        table = table.selectExpr(*[f"to_json(`{c}`) AS `{c}`" if c in nested else f"`{c}`" for c in table.columns])
        table.write.option("header", True).csv(path)
    else:
        getattr(table.write, kind)(path)
