"""Storage that driver and executors share: where iterative operators cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests, local mode) a temporary folder of this process is used; on a
    cluster an unset folder is an error, as executors would not see each other's files.
    """
    global _OWN_DIR
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="covergraph-")
        atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
    return f"file://{_OWN_DIR}"


def fresh_path(spark: SparkSession, label: str, *, keep: bool = False) -> str:
    """A new path in the shared folder. Those of intermediate tables lie in a folder of the application, which
    goes when the driver's process ends; what is to be kept lies outside it."""
    base = f"{shared_dir(spark)}/covergraph"
    if not keep:
        base = f"{base}/{spark.sparkContext.applicationId}"
        if base not in _INTERMEDIATE:
            _INTERMEDIATE.add(base)
            atexit.register(_remove, base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


_INTERMEDIATE: set[str] = set()


def _remove(uri: str) -> None:
    """Removes a folder where this process can reach its file system; elsewhere the folder stays."""
    import pyarrow as pa
    from pyarrow.fs import FileSystem

    try:
        fs, path = FileSystem.from_uri(uri)
        fs.delete_dir(path)
    except (OSError, ValueError, pa.ArrowException):
        return


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
