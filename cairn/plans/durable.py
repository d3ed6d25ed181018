"""Cutting lineage through the folder that all nodes share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own: in the warehouse, which all nodes share, or for a
    session on one machine a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        one = spark.sparkContext.master.startswith("local")
        folder = tempfile.gettempdir() if one else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """``shared_dir`` as a path that Python opens on every node; raises ``ValueError`` where it is none."""
    root = shared_dir(spark)
    if not root.startswith(("/", "file:")):
        raise ValueError(f"files are opened by path, and {root} is none")
    path = "/" + root.removeprefix("file:").lstrip("/") + "/cairn"
    os.makedirs(path, exist_ok=True)
    return path


#: Paths of the tables written inside each open ``scratch``.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``durable`` writes inside are deleted at the end, but for those it is asked to let stay."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame, name: str, small: bool = False, stay: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written; ``small`` results of many tasks in few files.

    A lost executor then costs the reading tasks only, and the scan has true size statistics, where the estimates of a
    plan that grows round by round would run away.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"
    if _OPEN and not stay:
        _OPEN[-1].append(path)
    (df.hint("rebalance") if small else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete what ``durable`` wrote for ``df``; only for tables that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cairn/" in folder:
            _delete(df.sparkSession, folder)


def scan_parts(df: DataFrame) -> int:
    """Number of tasks that read ``df``: it grows with the input, and so do shuffles that are sized by it."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
