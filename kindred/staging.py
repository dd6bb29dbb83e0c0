"""Intermediate tables: written once, read many times, kept off the lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    global _own_dir
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="kindred-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are dropped at the end, so read results before that."""
    path = f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}"
    token = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(folder, True)


def stage(df: DataFrame, name: str, run_dir: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` and return a scan of what was written.

    Cuts lineage: the table survives lost executors, its scan prunes columns and
    its size is known to the planner. With ``run_dir`` the table is kept there
    under ``name`` and replaces what an earlier attempt left. ``compression`` is for large ones, if not the usual.
    """
    spark = df.sparkSession
    if run_dir is None:
        path = f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    else:
        path = f"{run_dir}/{name}"
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, which is ``df`` if none was there yet.

    What a write left that did not come to its end is no table: it is written again.
    """
    if not is_finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
