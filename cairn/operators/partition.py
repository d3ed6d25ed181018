"""Spatial partitioning as queries: blocks, slabs, medians, median bisection, boxes and halos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import boxes_overlap, in_box, widest
from cairn.operators.points import axes
from cairn.plans.durable import durable


def rank_by(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """0-based global rank without a single-task window: range partitions are ranked inside and shifted by their sizes."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    dealt = durable(dealt, "ranged")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    bases = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__in", inner).join(bases, F.col("__part") == F.col("__p")).withColumn(out, F.col("__base") + F.col("__in")).drop("__part", "__p", "__base", "__in")


def block_partition(df: DataFrame, parts: int, order: list[str]) -> DataFrame:
    """``block``: contiguous blocks of near equal size, the first ones take the remainder."""
    n = df.count()
    size, rest = divmod(n, parts)
    r = F.col("__r")
    big = rest * (size + 1)
    block = F.when(r < big, F.floor(r / F.lit(size + 1))).otherwise(F.lit(rest) + F.floor((r - F.lit(big)) / F.lit(max(size, 1))))
    return rank_by(df, order, "__r").withColumn("block", block.cast("int")).drop("__r")


def x_slabs(pts: DataFrame, parts: int) -> DataFrame:
    """Slabs of near equal size along the first coordinate, ties by id."""
    return block_partition(pts, parts, [axes(pts)[0], "id"]).withColumnRenamed("block", "slab")


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The value at 0-based place n // 2 of each group: of an even number of values the upper middle one. NaN is left out.

    From counts by value: equal values are one row, and no group is gathered."""
    kept = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    freq = kept.groupBy(*group, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group)
    runs = freq.select(*group, value, "__n", F.sum("__n").over(w.orderBy(value)).alias("__upto"), F.sum("__n").over(w).alias("__all"))
    return runs.filter("__upto > floor(__all / 2) and __upto - __n <= floor(__all / 2)").select(*group, F.col(value).alias("median"))


def median_of_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(median): the upper median of the groups' upper medians, NaN left out; where no group has one, the middle between
    the least and the greatest finite value, or null."""
    medians = upper_median(df, [group], value).groupBy().agg(F.sort_array(F.collect_list("median")).alias("m"))
    middle = df.filter(~F.isnan(value)).agg(((F.min(value) + F.max(value)) / 2).alias("middle"))
    # one row each: the medians of partitions, as many as there are partitions
    return medians.join(middle).select(F.coalesce(F.get("m", F.floor(F.size("m") / 2).cast("int")), "middle").alias("median"))


def bounding_boxes(pts: DataFrame, group: list[str]) -> DataFrame:
    return pts.groupBy(*group).agg(*(f(c).alias(f"{n}_{c}") for c in axes(pts) for n, f in (("min", F.min), ("max", F.max))))


def halo_points(pts: DataFrame, part: str, eps: float) -> DataFrame:
    """(part, id): for every partition the points of others within its bounding box widened by eps.

    Boxes and points meet in the cells of a grid as wide as the widest box, of which a widened box touches few, and then
    exactly."""
    names = axes(pts)
    boxes = bounding_boxes(pts, [part]).withColumnRenamed(part, "box")
    low, high = ([F.col(f"{t}_{c}") + F.lit(s * eps) for c in names] for t, s in (("min", -1), ("max", 1)))
    widths = boxes.agg(*(F.max(hi - lo).alias(c) for c, lo, hi in zip(names, low, high))).first()
    wide = [max(widths[c] or 0.0, 1e-300) for c in names]
    cells = lambda x, w: F.floor(x / F.lit(w))
    for c, lo, hi, w in zip(names, low, high, wide):
        boxes = boxes.withColumn(f"b_{c}", F.explode(F.sequence(cells(lo, w), cells(hi, w))))
    keyed = pts.select(F.col(part).alias("own"), "id", *names, *(cells(F.col(c), w).alias(f"c_{c}") for c, w in zip(names, wide)))
    on = [F.col(f"c_{c}") == F.col(f"b_{c}") for c in names]
    met = keyed.join(boxes, on).filter((F.col("own") != F.col("box")) & in_box([F.col(c) for c in names], low, high))
    return met.select(F.col("box").alias(part), "id")


def local_and_halo(pts: DataFrame, part: str, eps: float) -> DataFrame:
    """(part, id, is_local): the points that a partition works on, its own and those around it."""
    return pts.select(part, "id", F.lit(True).alias("is_local")).unionByName(halo_points(pts, part, eps).select(part, "id", F.lit(False).alias("is_local")))


def overlapping(boxes: DataFrame, part: str, names: list[str]) -> DataFrame:
    """(a, b): pairs a < b of boxes that share a point. Of two such boxes one reaches over the other's low corner on each
    axis; boxes are one row a partition."""
    side = lambda n: boxes.select(F.col(part).alias(n), *(F.col(f"{t}_{c}").alias(f"{n}_{t}_{c}") for c in names for t in ("min", "max")))
    cols = lambda n, t: [F.col(f"{n}_{t}_{c}") for c in names]
    return side("a").join(side("b"), (F.col("a") < F.col("b")) & boxes_overlap(cols("a", "min"), cols("a", "max"), cols("b", "min"), cols("b", "max"))).select("a", "b")


def median_bisection(pts: DataFrame, levels: int) -> DataFrame:
    """``part``: recursive halving; each level splits every part at the upper median of its widest dimension (ties to the
    lowest), ``<=`` to the left. A part is a row of the box table; medians come from counts by value, not from sorted parts."""
    names = axes(pts)
    now = pts.withColumn("part", F.lit(0))
    for _ in range(levels):
        boxes = bounding_boxes(now, ["part"]).select("part", widest([F.col(f"min_{c}") for c in names], [F.col(f"max_{c}") for c in names]).alias("dim"))
        value = F.element_at(F.array(*names), F.col("dim") + 1)
        keyed = now.join(F.broadcast(boxes), "part").withColumn("v", value)
        freq = keyed.groupBy("part", "v").agg(F.count("*").alias("n"))
        up = Window.partitionBy("part").orderBy("v")
        runs = freq.select("part", "v", "n", F.sum("n").over(up).alias("upto"), F.sum("n").over(Window.partitionBy("part")).alias("all"))
        medians = runs.filter("upto > floor(all / 2) and upto - n <= floor(all / 2)").select("part", F.col("v").alias("median"))
        now = durable(keyed.join(F.broadcast(medians), "part").select(*pts.columns, (F.col("part") * 2 + F.when(F.col("v") <= F.col("median"), 0).otherwise(1)).alias("part")), "bisected")
    return now


def displacements(counts: DataFrame, order: str, value: str) -> DataFrame:
    """Exclusive running sums over a table of one row a partition."""
    return counts.withColumn("displ", F.coalesce(F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
