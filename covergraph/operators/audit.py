"""What an approximate cover of the same landmarks gets wrong: memberships, edges, witnesses, colours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covergraph.operators.diagnostics import compute_boundary_diagnostics
from covergraph.operators.graph import build_mapper
from covergraph.operators.witness import counted_pairs


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 1 for nothing out of nothing."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / b)


def _both(reference: DataFrame, approximate: DataFrame) -> DataFrame:
    """(ball_id, point_id, r, a): memberships with the sides that have them."""
    marked = reference.select("ball_id", "point_id", F.lit(1).alias("r"), F.lit(0).alias("a")).unionByName(approximate.select("ball_id", "point_id", F.lit(0).alias("r"), F.lit(1).alias("a")))
    return marked.groupBy("ball_id", "point_id").agg(F.max("r").alias("r"), F.max("a").alias("a"))


def audit_balls(reference: DataFrame, approximate: DataFrame, balls: DataFrame) -> DataFrame:
    """Per ball: sizes, intersection, false positives and negatives, precision, recall, jaccard."""
    r, a = F.col("r") == 1, F.col("a") == 1
    counted = _both(reference, approximate).groupBy("ball_id").agg(
        F.count_if(r).alias("reference_size"), F.count_if(a).alias("approximate_size"), F.count_if(r & a).alias("intersection_size"),
        F.count_if(a & ~r).alias("false_positives"), F.count_if(r & ~a).alias("false_negatives"))
    sizes = ["reference_size", "approximate_size", "intersection_size", "false_positives", "false_negatives"]
    whole = balls.select("ball_id").join(counted, "ball_id", "left").select("ball_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sizes])
    tp, fp, fn = F.col("intersection_size"), F.col("false_positives"), F.col("false_negatives")
    return whole.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp + fn).alias("jaccard"))


def audit_witness(reference: DataFrame, approximate: DataFrame) -> DataFrame:
    """Per edge of either graph: counts, retained, lost and added witnesses, change, retained_fraction (NaN for new edges), status."""
    # Points that lie in the same balls on the same sides are one pattern with a weight; a code is 4 * ball + r + 2 * a.
    code = F.col("ball_id").cast("long") * 4 + F.col("r") + 2 * F.col("a")
    held = _both(reference, approximate).groupBy("point_id").agg(F.sort_array(F.collect_list(code)).alias("b")).where(F.size("b") > 1)
    pairs = counted_pairs(held.groupBy("b").agg(F.count("*").alias("w")))
    counted = pairs.select(
        "src", "dst", (F.col("n1") + F.col("n3")).alias("reference_count"), (F.col("n2") + F.col("n3")).alias("approximate_count"), F.col("n3").alias("retained_witnesses"),
        F.col("n1").alias("lost_witnesses"), F.col("n2").alias("added_witnesses"))
    n = F.col("reference_count")
    return counted.select(
        "*", (F.col("approximate_count") - n).alias("change"), F.when(n > 0, F.col("retained_witnesses") / n).otherwise(F.lit(float("nan"))).alias("retained_fraction"),
        F.when((n > 0) & (F.col("approximate_count") > 0), "preserved").when(n > 0, "missing").otherwise("added").alias("status"))


def audit_edges(reference: DataFrame, approximate: DataFrame) -> DataFrame:
    """(src, dst, status): preserved, missing or added."""
    a, b = build_mapper(reference).select("src", "dst", F.lit(True).alias("r")), build_mapper(approximate).select("src", "dst", F.lit(True).alias("a"))
    status = F.when(F.col("r") & F.col("a"), "preserved").when(F.col("r"), "missing").otherwise("added")
    return a.join(b, ["src", "dst"], "full").select("src", "dst", status.alias("status"))


def audit_colors(reference: DataFrame, approximate: DataFrame, balls: DataFrame, values: DataFrame) -> DataFrame:
    """Per ball: means on both covers, absolute error (NaN if either is empty), oscillation over the union, and its bound
    oscillation * (1 - min(precision, recall))."""
    v, r, a = F.col("value").cast("double"), F.col("r") == 1, F.col("a") == 1
    agg = _both(reference, approximate).join(values, "point_id").groupBy("ball_id").agg(
        F.avg(F.when(r, v)).alias("reference_mean"), F.avg(F.when(a, v)).alias("approximate_mean"), (F.max(v) - F.min(v)).alias("oscillation"))
    nan = F.lit(float("nan"))
    joined = audit_balls(reference, approximate, balls).select("ball_id", "precision", "recall").join(agg, "ball_id", "left").select(
        "ball_id", F.coalesce("reference_mean", nan).alias("reference_mean"), F.coalesce("approximate_mean", nan).alias("approximate_mean"),
        F.coalesce("oscillation", F.lit(0.0)).alias("oscillation"), "precision", "recall")
    return joined.select(
        "ball_id", "reference_mean", "approximate_mean", F.abs(F.col("reference_mean") - F.col("approximate_mean")).alias("absolute_error"), "oscillation",
        (F.col("oscillation") * (1 - F.least("precision", "recall"))).alias("error_bound"))


def audit_summary(reference: DataFrame, approximate: DataFrame, balls: DataFrame) -> DataFrame:
    """One row: micro and macro scores of memberships, counts and scores of edges."""
    per = audit_balls(reference, approximate, balls)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = lambda c: F.coalesce(F.avg(c), F.lit(1.0))
    totals = per.agg(
        zero("intersection_size").alias("tp"), zero("false_positives").alias("fp"), zero("false_negatives").alias("fn"),
        one("precision").alias("macro_precision"), one("recall").alias("macro_recall"), one("jaccard").alias("macro_jaccard"))
    s = F.col("status")
    edges = audit_edges(reference, approximate).agg(F.count_if(s == "preserved").alias("edge_tp"), F.count_if(s == "added").alias("edge_fp"), F.count_if(s == "missing").alias("edge_fn"))
    row = totals.crossJoin(F.broadcast(edges))
    scores = [ratio(F.col(f"{p}tp"), total).alias(f"{name}_{kind}") for p, name in (("", "membership"), ("edge_", "edge")) for kind, total in (
        ("precision", F.col(f"{p}tp") + F.col(f"{p}fp")), ("recall", F.col(f"{p}tp") + F.col(f"{p}fn")), ("jaccard", F.col(f"{p}tp") + F.col(f"{p}fp") + F.col(f"{p}fn")))]
    return row.select("*", *scores)


def color_errors(colors: DataFrame) -> DataFrame:
    """One row: mean, root mean square and largest absolute error of the balls that have one."""
    e = F.col("absolute_error")
    return colors.where(~F.isnan(e)).agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("max_error"))


def witness_survival(witness: DataFrame) -> DataFrame:
    """(bin, edges, survived): edges of the reference by the power of two below their witness count."""
    n = F.col("reference_count")
    return witness.where(n > 0).groupBy(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("long").alias("bin")).agg(F.count("*").alias("edges"), F.count_if(F.col("approximate_count") > 0).alias("survived"))


@dataclass(frozen=True)
class ApproximationAudit:
    """The tables of an audit; colors, color_summary and boundary if they were asked for."""

    balls: DataFrame
    summary: DataFrame
    edges: DataFrame
    witness_changes: DataFrame
    colors: DataFrame | None
    color_summary: DataFrame | None
    boundary: DataFrame | None


def compare_covers(reference: DataFrame, approximate: DataFrame, balls: DataFrame, *, points: DataFrame | None = None, landmarks=None, eps: float | None = None,
                   metric: str = "euclidean", deltas=None, values: DataFrame | None = None) -> ApproximationAudit:
    """All comparisons of two covers of the same landmarks; points, landmarks and eps together add boundary diagnostics."""
    if balls.count() != balls.select("ball_id").distinct().count() or not reference.select("ball_id").unionByName(approximate.select("ball_id")).join(balls, "ball_id", "left_anti").isEmpty():
        raise ValueError("both covers need the same balls")
    given = [x is not None for x in (points, landmarks, eps)]
    if any(given) and not all(given):
        raise ValueError("points, landmarks and eps go together")
    colors = audit_colors(reference, approximate, balls, values) if values is not None else None
    return ApproximationAudit(
        audit_balls(reference, approximate, balls), audit_summary(reference, approximate, balls), audit_edges(reference, approximate), audit_witness(reference, approximate),
        colors, color_errors(colors) if colors is not None else None,
        compute_boundary_diagnostics(points, landmarks, eps, metric=metric, deltas=deltas) if all(given) else None)


def covers_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same distinct rows."""
    return a.select(*b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty() if a.count() == b.count() else False
