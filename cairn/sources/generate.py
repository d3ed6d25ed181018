"""Synthetic blobs: Gaussian clusters around uniform centres, with uniform noise.

Every draw is a function of the seed, the point and the axis: the first 52 bits of an MD5, so that the rows are the same
on any number of tasks and in SQL.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.partition import rank_by

#: Fixed values of the workload: centres in [1, 9], deviation 0.35, noise in [0, 10].
LOW, HIGH, SIGMA, SPAN = 1.0, 9.0, 0.35, 10.0
#: Hexadecimal digits of a draw, and the number of their values.
DIGITS, VALUES = 13, float(1 << 52)


def centres(clusters: int, d: int, seed: int) -> list[list[float]]:
    draw = lambda k, j: (int(hashlib.md5(f"{seed}/c/{k}/{j}".encode()).hexdigest()[:DIGITS], 16) + 0.5) / VALUES
    return [[LOW + (HIGH - LOW) * draw(k, j) for j in range(d)] for k in range(clusters)]


def _md5(seed: int, kind: str, *rest: Column | int) -> Column:
    return F.md5(F.encode(F.concat_ws("/", F.lit(f"{seed}/{kind}"), F.col("id").cast("string"), *(F.lit(str(r)) for r in rest)), "UTF-8"))


def uniform(seed: int, kind: str, j: int) -> Column:
    """Uniform draw in (0, 1) for the point ``id`` and the axis j."""
    return (F.conv(F.substring(_md5(seed, kind, j), 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(VALUES)


def _points(spark: SparkSession, n: int, d: int, clusters: int, noise: float, seed: int, cluster: Column) -> DataFrame:
    """(id, coords, true_label): point ``id`` of ``cluster``, the last ``noise`` share of all is noise (-1)."""
    table = F.array(*(F.array(*(F.lit(v) for v in c)) for c in centres(clusters, d, seed)))
    gauss = lambda j: F.sqrt(F.lit(-2.0) * F.log(uniform(seed, "r", j))) * F.cos(F.lit(2 * math.pi) * uniform(seed, "a", j))
    blob = F.array(*(F.get(F.get(table, F.col("k")), F.lit(j)) + F.lit(SIGMA) * gauss(j) for j in range(d)))
    far = F.array(*(uniform(seed, "n", j) * F.lit(SPAN) for j in range(d)))
    is_noise = F.col("id") >= n - int(n * noise)
    rows = spark.range(n).withColumn("k", cluster.cast("int"))
    return rows.select("id", F.when(is_noise, far).otherwise(blob).alias("coords"), F.when(is_noise, -1).otherwise(F.col("k")).cast("long").alias("true_label"))


def permuted(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``id`` renumbered from 0 in a random order that the seed fixes."""
    ranked = rank_by(rows.withColumn("__order", _md5(seed, "o")), ["__order", "id"], "__new")
    return ranked.withColumn("id", F.col("__new").cast("long")).drop("__order", "__new")


def blobs(spark: SparkSession, n: int, d: int = 2, clusters: int = 10, noise: float = 0.05, seed: int = 2, shuffle: bool = True) -> DataFrame:
    """(id, coords, true_label): points go round-robin to the clusters; in a random order if ``shuffle``."""
    out = _points(spark, n, d, clusters, noise, seed, F.col("id") % clusters)
    return permuted(out, seed) if shuffle else out


def labelled_blocks(spark: SparkSession, n: int, clusters: int = 10, noise: float = 0.05, d: int = 2, seed: int = 42) -> DataFrame:
    """The same with one block of points a cluster, the first ones taking the remainder, in a random order."""
    size, rest = divmod(n - int(n * noise), clusters)
    big = rest * (size + 1)
    block = F.when(F.col("id") < big, F.floor(F.col("id") / (size + 1))).otherwise(rest + F.floor((F.col("id") - big) / max(size, 1)))
    return permuted(_points(spark, n, d, clusters, noise, seed, F.least(block, F.lit(clusters - 1))), seed)


def _sql(n: int, d: int, clusters: int, noise: float, seed: int, cluster: str, shuffle: bool) -> str:
    """The same rows in DuckDB's SQL, with coordinates x0, x1, ... rounded to six digits."""
    draw = lambda kind, j: f"(('0x' || substr(md5('{seed}/{kind}/' || id || '/{j}'), 1, {DIGITS}))::BIGINT + 0.5::DOUBLE) / {VALUES!r}::DOUBLE"
    table = ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in c) + "]" for c in centres(clusters, d, seed))
    quiet = n - int(n * noise)
    axis = lambda j: f"round(CASE WHEN id >= {quiet} THEN {draw('n', j)} * {SPAN}::DOUBLE ELSE ([{table}])[k + 1][{j + 1}] + {SIGMA}::DOUBLE * (sqrt(-2.0::DOUBLE * ln({draw('r', j)})) * cos({2 * math.pi!r}::DOUBLE * {draw('a', j)})) END, 6) AS x{j}"
    number = f"row_number() OVER (ORDER BY md5('{seed}/o/' || id), id) - 1" if shuffle else "id"
    return f"SELECT {number} AS id, {', '.join(map(axis, range(d)))}, (CASE WHEN id >= {quiet} THEN -1 ELSE k END)::BIGINT AS true_label FROM (SELECT id, ({cluster})::INTEGER AS k FROM range({n}) r(id))"


def blobs_sql(n: int, d: int = 2, clusters: int = 10, noise: float = 0.05, seed: int = 2, shuffle: bool = True) -> str:
    return _sql(n, d, clusters, noise, seed, f"id % {clusters}", shuffle)


def labelled_blocks_sql(n: int, clusters: int = 10, noise: float = 0.05, d: int = 2, seed: int = 42) -> str:
    size, rest = divmod(n - int(n * noise), clusters)
    big = rest * (size + 1)
    return _sql(n, d, clusters, noise, seed, f"least(CASE WHEN id < {big} THEN id // {size + 1} ELSE {rest} + (id - {big}) // {max(size, 1)} END, {clusters - 1})", True)
