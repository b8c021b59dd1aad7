"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covergraph.sources.shared import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", *, max_rounds: int = 60, one_task: int = 0) -> DataFrame:
    """(node, component) of every node that has an edge to another; a component is its smallest node.

    At most ``one_task`` edges are settled in one task instead of rounds, for graphs known to be small.

    Every round writes its edges, at most as many as came in, to the shared folder. A node with very
    many neighbours meets its minimum by a partial aggregate and a join that can be split, never in a window.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    e = materialize(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct(), "cc")
    before = None
    if one_task and e.count() <= one_task:
        return e.coalesce(1).mapInPandas(_settle, "node long, component long")
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).distinct()
        parent = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(parent, "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(parent.select("v", F.col("m").alias("u")))
        e = materialize(small.distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _settle(batches):
    """Union-find over all edges of one task."""
    import pandas as pd

    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for batch in batches:
        for a, b in zip(batch["u"].tolist(), batch["v"].tolist()):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    yield pd.DataFrame({"node": list(parent), "component": [find(i) for i in parent]}, dtype="int64")
