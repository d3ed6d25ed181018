"""Run reports as text and CSV: timing tables, metrics, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "n_procs int, n_points bigint, wall_s double, compute_s double, comm_s double"
_ROW = r"^\s*(\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s*$"


def read_runs(spark: SparkSession, path: str, schema: str = RUNS) -> DataFrame:
    """Result CSV with a header; rows that do not fit are left out."""
    return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").csv(path, header=True)


def timing_table(lines: DataFrame) -> DataFrame:
    """(rank, compute_s, comm_s) from lines ``value`` of a log: rows of an integer and two decimals."""
    hit = lines.filter(F.col("value").rlike(_ROW))
    return hit.select(F.regexp_extract("value", _ROW, 1).cast("int").alias("rank"), F.regexp_extract("value", _ROW, 2).cast("double").alias("compute_s"), F.regexp_extract("value", _ROW, 3).cast("double").alias("comm_s"))


def metric(lines: DataFrame, name: str) -> DataFrame:
    """(value) of lines ``<name> ... : <number>``; the number has to follow the colon, so notes in brackets do not match."""
    pattern = rf"^\s*{name}[^:=(]*[:=]\s*(-?\d+(?:\.\d+)?)"
    return lines.filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).cast("double").alias("metric"))
