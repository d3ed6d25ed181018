"""Summaries of labellings and of run timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import choose2


def summary(labels: DataFrame) -> DataFrame:
    """(n_points, n_clusters, n_noise): clusters are the greatest label plus one, 0 if there is none."""
    return labels.agg(F.count("*").alias("n_points"), (F.coalesce(F.max("label"), F.lit(-1).cast("long")) + 1).alias("n_clusters"), F.count_if(F.col("label") < 0).alias("n_noise"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.filter("label >= 0").groupBy("label").agg(F.count("*").alias("size"))


def noise_points(labels: DataFrame) -> DataFrame:
    return labels.filter("label < 0").select("id")


def adjusted_rand_index(a: DataFrame, b: DataFrame, include_noise: bool = False) -> DataFrame:
    """One row (ari) for two labellings (id, label); points that are noise in either are left out unless asked for.

    1 where the index is undefined (both labellings trivial). Only the contingency table is gathered.
    """
    both = a.select("id", F.col("label").alias("a")).join(b.select("id", F.col("label").alias("b")), "id")
    if not include_noise:
        both = both.filter("a >= 0 and b >= 0")
    cells = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    part = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(choose2(F.col("n"))), F.lit(0.0)).alias(f"sum_{c}"))
    total = cells.agg(F.coalesce(F.sum(choose2(F.col("n"))), F.lit(0.0)).alias("both"), choose2(F.coalesce(F.sum("n"), F.lit(0))).alias("pairs"))
    one = total.join(part("a")).join(part("b"))  # one row each
    expected = F.col("sum_a") * F.col("sum_b") / F.greatest("pairs", F.lit(1.0))
    spread = 0.5 * (F.col("sum_a") + F.col("sum_b")) - expected
    return one.select(F.when(F.abs(spread) < 1e-12, F.lit(1.0)).otherwise((F.col("both") - expected) / F.when(F.abs(spread) < 1e-12, F.lit(1.0)).otherwise(spread)).alias("ari"))


def imbalance(timing: DataFrame, group: list[str], value: str) -> DataFrame:
    """(max - min) / max * 100 by group; 0 where the maximum is not positive."""
    low, high = F.min(value), F.max(value)
    return timing.groupBy(*group).agg(F.when(high > 0, (high - low) / high * 100).otherwise(F.lit(0.0)).alias("imbalance_pct"))


def speedup(timing: DataFrame, procs: str, wall: str) -> DataFrame:
    """``timing`` with speedup against one process, or against the fewest processes where there is no such row."""
    base = F.first(wall).over(Window.orderBy((F.col(procs) != 1).cast("int"), procs).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return timing.withColumn("speedup", base / F.col(wall))


def slowest(timing: DataFrame) -> DataFrame:
    """(max_compute_s, max_comm_s) over tasks."""
    return timing.agg(F.max("compute_s").alias("max_compute_s"), F.max("comm_s").alias("max_comm_s"))


def in_window(timing: DataFrame, low: float = 120.0, high: float = 180.0) -> DataFrame:
    """Runs whose wall time lies between two bounds."""
    return timing.filter(F.col("wall_s").between(low, high))


def distinct_labels(labels: DataFrame) -> DataFrame:
    """(label) of the clusters, each once."""
    return labels.filter("label >= 0").select("label").distinct()


def report(labels: DataFrame, timing: DataFrame) -> DataFrame:
    """(section, name, value) of a run: points, clusters and noise, the greatest compute and communication time over tasks,
    and each task's (rank, compute_s, comm_s)."""
    flat = lambda df, section, names: df.select(F.explode(F.array(*(F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("r")).select("r.*")
    ranks = timing.select(F.explode(F.array(*(F.struct(F.lit("rank").alias("section"), F.concat_ws(" ", F.col("rank").cast("string"), F.lit(n)).alias("name"), F.col(n).alias("value")) for n in ("compute_s", "comm_s")))).alias("r")).select("r.*")
    return flat(summary(labels), "summary", ["n_points", "n_clusters", "n_noise"]).unionByName(flat(slowest(timing), "time", ["max_compute_s", "max_comm_s"])).unionByName(ranks)
