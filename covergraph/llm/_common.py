"""Helpers shared by the training-data operators: table access, shared storage, null handling."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergraph.sources.shared import fresh_path, materialize, shared_dir  # noqa: F401

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes in an Arrow batch of texts, where the session's own configuration names no bound: two workers of an executor hold little.
BATCH_BYTES = 4 << 20
#: Fixed value: what Spark has where nothing is named.
DEFAULT_BYTES = 64 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches by bytes, where neither its start nor the caller named a bound.

    The bound is a setting of the session, which the planner reads when the result is used; it stays set.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if not df.sparkSession.sparkContext.getConf().contains(key) and int(conf.get(key).rstrip("bB")) == DEFAULT_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def released(batches: Iterator) -> Iterator:
    """The batches; after each, freed memory goes back to the system, as workers are kept between tasks."""
    for batch in batches:
        yield batch
        del batch
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Only some C libraries have it.
        pass


def crc_mod(column: str, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``: the fixed folds of the queries. A null id is in no fold: -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(-1))


class KeyFilter:
    """A Bloom filter of long keys, built in SQL; its size is bounded, and it only saves shuffling."""

    def __init__(self, keys: DataFrame, column: str, most_bits: int = 1 << 27):
        self.context, n = keys.sparkSession.sparkContext, keys.count()
        self.bits = 1 << min(most_bits.bit_length() - 1, max(10, (8 * n).bit_length()))
        probe = F.explode(F.array(*[F.pmod(F.xxhash64(column, F.lit(k).cast("long")), F.lit(self.bits)) for k in (1, 2)]))
        words = keys.select(probe.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("v")).toArrow()
        self.words = np.zeros(self.bits // 64, dtype=np.int64)
        self.words[words.column("w").to_numpy()] = words.column("v").to_numpy()

    def test(self, column: str):
        """A column: whether the key may be there."""
        shared = self.context.broadcast(self.words)

        @F.pandas_udf("boolean")
        def there(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for a, b in batches:
                yield pd.Series(_set(shared.value, a.to_numpy()) & _set(shared.value, b.to_numpy()))

        return there(*[F.pmod(F.xxhash64(column, F.lit(k).cast("long")), F.lit(self.bits)) for k in (1, 2)])


    def holds(self, keys: np.ndarray) -> np.ndarray:
        """The same test on an array of keys, inside Python code that has them anyway."""
        places = [(xxhash64(keys, np.full(len(keys), k)) & np.uint64(self.bits - 1)).astype(np.int64) for k in (1, 2)]
        return _set(self.words, places[0]) & _set(self.words, places[1])

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "words": self.words}


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of long columns."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(columns[0]), 42, dtype=np.uint64)
    for c in columns:
        h = (h + p5 + np.uint64(8)) ^ (turn(np.asarray(c).astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h


def _set(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (words[bits >> 6] >> (bits & 63)) & 1 == 1
