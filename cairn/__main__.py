"""Command line: generate or read points, cluster them, report, write labels. ``python -m cairn --help``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description="Density clustering on Spark")
    p.add_argument("--n", type=int, default=10_000, help="points to generate")
    p.add_argument("--d", type=int, default=2, help="dimensions of generated points")
    p.add_argument("--eps", type=float, default=0.5, help="radius of a neighbourhood")
    p.add_argument("--min-pts", type=int, default=5, help="neighbours of a core point, itself included")
    p.add_argument("--clusters", type=int, default=10, help="clusters to generate")
    p.add_argument("--seed", type=int, default=2, help="seed of the generator")
    p.add_argument("--input", help="point file to read instead, in a folder that all nodes share")
    p.add_argument("--output", help="label file to write, in a folder that all nodes share")
    p.add_argument("--verify", action="store_true", help="cluster a second way and compare")
    p.add_argument("--timing", action="store_true", help="seconds of each task")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 2 where executors run other code than the driver."""
    args = options().parse_args(argv)
    from cairn.operators.dbscan import breakdown, dbscan, verify
    from cairn.operators.metrics import slowest, summary
    from cairn.operators.points import points
    from cairn.plans.durable import durable
    from cairn.plans.guard import builds
    from cairn.sources import generate, points_bin

    spark = spark or SparkSession.builder.appName("cairn").getOrCreate()
    if not builds(spark).first().same:
        print("executors run other code than the driver", file=sys.stderr)
        return 2
    rows = points_bin.read_points(spark, args.input) if args.input else generate.blobs(spark, args.n, args.d, args.clusters, seed=args.seed)
    rows = durable(rows, "points")
    d = rows.select(F.size("coords").alias("d")).head(1)
    d = d[0].d if d else args.d
    pts = points(rows, "id", [f"coords[{k}]" for k in range(d)] if d <= 3 else "coords")
    start = time.perf_counter()
    labels = durable(dbscan(pts, args.eps, args.min_pts).select("id", "label"), "labels")
    wall = time.perf_counter() - start
    s = summary(labels).first()
    print(f"points: {s.n_points}\nclusters: {s.n_clusters}\nnoise: {s.n_noise}\nwall time: {wall:.4f} s")
    if args.timing:
        times = breakdown(pts, args.eps, args.min_pts).orderBy("rank").collect()
        print("rank  compute  comm")
        for r in times:
            print(f"  {r.rank}  {r.compute_s:.4f}  {r.comm_s:.4f}")
        if times:
            worst = slowest(spark.createDataFrame(times)).first()
            print(f"max compute: {worst.max_compute_s:.4f} s\nmax comm: {worst.max_comm_s:.4f} s")
    if args.verify:
        table, speedup = verify(pts, args.eps, args.min_pts)
        v = table.first()
        print(f"ARI: {v.ari:.6f}\nclusters by joins: {v.n_clusters_check}\nnoise by joins: {v.n_noise_check}\nspeedup: {speedup:.2f}")
    if args.output:
        points_bin.write_labels(labels, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
