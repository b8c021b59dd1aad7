"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size. Within
its source a document's copies are the integers crossed between the prefix sums of expected copies
before and after it, counted from one random offset of the source. Documents are ordered by size
class, so that a source's sample has its sizes in proportion and its words come near the target.

The prefix sum is taken in two levels. Rows are ranked inside cells (source, size class, hash
bucket) that hold a bounded share of the rows whatever one source holds, and the much smaller table
of cells is summed up by source. The number of hash buckets follows the row count.

Nulls: a null text has size 0, a null source is a source of its own (the last), a null id is
ordered first. Repeated rows are separate documents. An empty table gives an empty result. Columns
other than the three named ones are never read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covergraph.llm._common import WORD, materialize

#: Rows in a cell stay below about this times the share of its size class.
ROWS_PER_BUCKET = 500_000
LEAST_BUCKETS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class() -> Column:
    """An integer that grows with the column size: its bits, each power of two in eight parts."""
    return F.expr("length(bin(size)) * 8 + CAST(shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7 AS INT)")


def unit_from_md5(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3.0) -> DataFrame:
    """Per source key: source_size and target. ``sizes`` has key, size.

    Weights repeat over the keys in order. A target is level * weight, at most max_repeat times the
    source's size; the level is the one at which the targets add up to all sizes, which is where
    resharing any excess by weight ends. Sources sorted by cap / weight are capped from the front.
    """
    by_key = Window.orderBy("key")
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "key")
    upto, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wts = F.array(*[F.lit(float(w)) for w in weights])
    per = (
        sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
        .withColumn("w", F.element_at(wts, (F.row_number().over(by_key) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    )
    level = per.select(
        "*",
        F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(upto), F.lit(0.0)).alias("w_before"),
        F.sum("w").over(every).alias("w_all"),
        F.sum("source_size").over(every).alias("all_size"),
    ).withColumn("level", (F.col("all_size") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    # The first source whose cap is not below its level starts the uncapped ones, which share its level.
    free = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("key"), F.col("level")))).over(every)
    return level.withColumn("free", free).select(
        "key", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("free.level") * F.col("w"), F.col("cap"))).alias("target"),
    )


def mix(
    docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: id, source, size (words), source_size, target (of its source), copies, taken.

    ``copies`` says how often the mix emits the document, ``taken`` is copies * size. The result
    depends on nothing but the rows and ``seed``.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    sizes = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size")),
        "mix-sizes",
    )
    buckets = LEAST_BUCKETS + sizes.count() // ROWS_PER_BUCKET
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null|"), F.col("size").cast("string")))), 1, 8), 16, 10).cast("long")
    rows = sizes.withColumn("class", size_class()).withColumn("bucket", hashed % buckets)
    cell = ["key", "class", "bucket"]
    running = Window.partitionBy("key").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy(*cell).agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
        .join(source_targets(sizes, weights, max_repeat), "key")
        .select(*cell, "before", "source_size", "target")
    )
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*cell).orderBy("size", "id")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = unit_from_md5(F.concat(F.lit(f"{seed}|"), F.col("key")))
    return (
        ranked.join(cells, cell)
        .withColumn("ratio", ratio).withColumn("u", u).withColumn("pos", F.col("before") + F.col("rn"))
        .withColumn("copies", (F.floor(F.col("u") + F.col("ratio") * F.col("pos")) - F.floor(F.col("u") + F.col("ratio") * (F.col("pos") - 1))).cast("long"))
        .select(
            F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def emit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` has copies of it, none for 0, with all its columns."""
    own = "_mix"
    while any(c.startswith(own) for c in docs.columns):
        own = f"_{own}"
    size, number, copies, at = (f"{own}_{k}" for k in ("size", "number", "copies", "at"))
    # Rows of one id, source and size are numbered on both sides.
    rows = docs.withColumn(size, word_count(F.col(text_col)))
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(id_col, source_col, size).orderBy(F.xxhash64(text_col))))
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    mixed = mixed.select(
        F.col(id_col).alias(f"{own}_a"), F.col(source_col).alias(f"{own}_b"), F.col("size").alias(f"{own}_c"), F.col("copies").alias(copies),
        F.row_number().over(Window.partitionBy(id_col, source_col, "size").orderBy("copies")).alias(f"{own}_d"),
    ).where(F.col(copies) > 0)
    same = (
        F.col(id_col).eqNullSafe(F.col(f"{own}_a")) & F.col(source_col).eqNullSafe(F.col(f"{own}_b"))
        & (F.col(size) == F.col(f"{own}_c")) & (F.col(number) == F.col(f"{own}_d"))
    )
    return rows.join(mixed, same).withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER q, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER q, 0)) AS level
    FROM w WINDOW q AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (cap / w, k)) AS level FROM l WHERE cap >= level * w),
t AS (SELECT k, source_size, least(cap, coalesce((SELECT level FROM f) * w, cap)) AS target FROM l),
b AS (SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)::INT) & 7) AS class,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null|' || size::VARCHAR)), 1, 8))::BIGINT % (16 + (SELECT count(*) FROM d) // 500000) AS bucket FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY class, bucket, size, doc_id NULLS FIRST) AS pos FROM b),
c AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
    ('0x' || substr(md5('mix|' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM p JOIN t USING (k))
SELECT doc_id, size, source_size, target, (floor(u + ratio * pos) - floor(u + ratio * (pos - 1)))::BIGINT * size AS taken FROM c
"""
