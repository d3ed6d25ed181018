"""The engine's registered queries and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.geometry import is_power_of_two
from cairn.operators import metrics, partition
from cairn.operators.components import SMALL
from cairn.operators.dbscan import TILE, breakdown, core_components, dbscan, dense_relabel, remap_apply, verify
from cairn.operators.neighbors import border_lowest, border_pairs, core_pairs, core_points, eps_neighbors, neighbor_counts
from cairn.operators.points import points
from cairn.plans.durable import durable, shared_dir, shared_path
from cairn.plans.guard import builds
from cairn.sources import generate, points_bin, reports

#: Point sets: table, id, coordinates in Spark and in DuckDB.
SETS = {
    "customer": ("customer", "c_custkey", ["c_acctbal / 1000D", "c_nationkey"], ["c_acctbal / 1000.0::DOUBLE", "c_nationkey::DOUBLE"]),
    "part": ("part", "p_partkey", ["p_retailprice / 10D", "p_size"], ["p_retailprice / 10.0::DOUBLE", "p_size::DOUBLE"]),
    "events": ("events", "event_id", ["value", "user_id"], ["value::DOUBLE", "user_id::DOUBLE"]),
    "orders": ("orders", "o_orderkey", ["o_totalprice / 1000D", "datediff(o_orderdate, date'1992-01-01') / 30D"], ["o_totalprice / 1000.0::DOUBLE", "date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 30.0::DOUBLE"]),
    "supplier": ("supplier", "s_suppkey", ["s_acctbal / 1000D", "s_nationkey"], ["s_acctbal / 1000.0::DOUBLE", "s_nationkey::DOUBLE"]),
    "embeddings": ("embeddings", "vec_id", ["double(embedding[0]) * 10D", "double(embedding[1]) * 10D"], ["embedding[1]::DOUBLE * 10.0::DOUBLE", "embedding[2]::DOUBLE * 10.0::DOUBLE"]),
}
#: eps of each set; min_pts is 5. A table of another size has another density, so eps follows it where it matters.
EPS = {"customer": 0.5, "part": 0.5, "events": 2.0, "orders": 1.5, "supplier": 2.0, "embeddings": 0.2}
EPS_SMALL, EPS_64 = 1.5, 1.16
MIN_PTS = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, ident, coords, _ = SETS[name]
    return points(spark.read.parquet(f"{sf_dir}/{table}.parquet"), ident, coords)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def q_dbscan(spark, sf_dir, name, eps=None, tile=TILE, small=SMALL):
    return dbscan(read(spark, sf_dir, name), eps or EPS[name], MIN_PTS, tile, small)


def q_components(spark, sf_dir, tile=TILE, small=SMALL):
    return core_components(read(spark, sf_dir, "customer"), EPS["customer"], MIN_PTS, tile, small)


def _labels(spark, sf_dir, eps=None):
    return durable(q_dbscan(spark, sf_dir, "customer", eps).select("id", "label"), "labels")


def q_ari_truth(spark, sf_dir):
    found = q_dbscan(spark, sf_dir, "embeddings").select("id", "label")
    truth = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    return metrics.adjusted_rand_index(found, truth).select(F.round("ari", 6).alias("ari"))


def q_ari_two(spark, sf_dir, include_noise=False):
    return metrics.adjusted_rand_index(_labels(spark, sf_dir), _labels(spark, sf_dir, 0.4), include_noise).select(F.round("ari", 6).alias("ari"))


def q_profile(spark, sf_dir):
    pts = read(spark, sf_dir, "customer")
    return pts.join(_labels(spark, sf_dir).filter("label >= 0"), "id").groupBy("label").agg(F.count("*").alias("size"), F.min("x0").alias("min_x0"), F.max("x0").alias("max_x0"), F.min("x1").alias("min_x1"), F.max("x1").alias("max_x1"))


def q_blocks(spark, sf_dir, parts=7):
    return partition.block_partition(read(spark, sf_dir, "customer"), parts, ["id"]).select("id", "block")


def _boxed(spark, sf_dir, parts=8):
    return partition.block_partition(read(spark, sf_dir, "customer"), parts, ["id"])


def q_remap(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    remap = labels.filter("label >= 0 and label % 3 = 0").select(F.col("label").alias("lbl"), F.floor(F.col("label") / 6).alias("root")).distinct()
    return remap_apply(labels, remap)


def _file(spark, suffix: str) -> str:
    """A new file's path in the folder that all nodes share."""
    return f"{shared_path(spark)}/{uuid.uuid4().hex}{suffix}"


def q_points_file(spark, sf_dir):
    """Writes a point file, reads it in ranges of rows, clusters what was read."""
    path = _file(spark, ".bin")
    customers = read(spark, sf_dir, "customer").select("id", F.array("x0", "x1").alias("coords"))
    points_bin.write_points(customers, path)
    back = points_bin.read_points(spark, path, 400)
    return dbscan(back.select("id", F.col("coords")[0].alias("x0"), F.col("coords")[1].alias("x1")), EPS["customer"], MIN_PTS)


def q_labels_file(spark, sf_dir):
    path = _file(spark, ".bin")
    points_bin.write_labels(_labels(spark, sf_dir), path)
    return points_bin.read_labels(spark, path, 300)


def q_truth_file(spark, sf_dir):
    path = _file(spark, ".npy")
    points_bin.write_npy(generate.labelled_blocks(spark, 3000).select("id", F.col("true_label").alias("label")), path)
    return points_bin.read_npy(spark, path, 700)


def _flat(blobs):
    """Coordinates as columns, to six digits."""
    return blobs.select("id", *(F.round(F.col("coords")[k], 6).alias(f"x{k}") for k in range(2)), "true_label")


def _runs(spark, sf_dir):
    """A table of runs: one a nation."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy((F.col("c_nationkey") + 1).cast("int").alias("n_procs")).agg(F.count("*").alias("n_points"), (F.max("c_acctbal").cast("double") / 50).alias("wall_s"), F.max("c_custkey").cast("double").alias("compute_s"), F.min("c_custkey").cast("double").alias("comm_s"))


def q_csv(spark, sf_dir):
    """Appends runs to a CSV folder in two writes and reads them back."""
    path, runs = f"{shared_dir(spark)}/cairn/runs-{uuid.uuid4().hex}", _runs(spark, sf_dir)
    reports.append_runs(runs.filter("n_procs <= 10"), path)
    reports.append_runs(runs.filter("n_procs > 10"), path)
    return reports.read_runs(spark, path)


def _log(spark, sf_dir):
    """Lines of a run's log, through a text file: a table of tasks and a metric with a note that is none."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    table = rows.select(F.format_string("  %d   %.4f  %.4f", F.col("s_suppkey").cast("int"), F.abs(F.col("s_acctbal").cast("double")), F.col("s_nationkey").cast("double") + 0.5).alias("value"))
    notes = rows.select(F.format_string("  wall time : %.2f s (%d = most)", F.abs(F.col("s_acctbal").cast("double")), F.col("s_nationkey").cast("int")).alias("value"))
    path = f"{shared_dir(spark)}/cairn/log-{uuid.uuid4().hex}"
    table.unionByName(notes).write.text(path)
    return spark.read.text(path)


def q_report(spark, sf_dir):
    return metrics.report(_labels(spark, sf_dir), reports.timing_table(_log(spark, sf_dir)))


def q_verify(spark, sf_dir):
    return verify(read(spark, sf_dir, "customer"), EPS["customer"], MIN_PTS)[0]


def q_breakdown(spark, sf_dir):
    """Whether every task has a time of work and one of waiting; the seconds themselves change from run to run."""
    times = breakdown(read(spark, sf_dir, "customer"), EPS["customer"], MIN_PTS, tile=200)
    return times.agg((F.count("*") > 0).alias("some"), F.bool_and((F.col("compute_s") >= 0) & (F.col("comm_s") >= 0)).alias("complete"))


def q_cross_edges(spark, sf_dir, parts=8):
    """Core edges whose ends lie in different blocks, with both ends' blocks. Blocks are ranges of ids, told by their ends."""
    pts = read(spark, sf_dir, "customer")
    ends = partition.block_partition(pts, parts, ["id"]).groupBy("block").agg(F.max("id").alias("last")).orderBy("block").collect()

    def block(end: str):
        return F.expr(f"CASE {' '.join(f'WHEN {end} <= {r.last}L THEN {r.block}' for r in ends)} END") if ends else F.lit(None).cast("int")

    edges = core_pairs(pts, EPS["customer"], MIN_PTS).select("src", "dst", block("src").alias("src_block"), block("dst").alias("dst_block"))
    return edges.filter("src_block < dst_block")


def q_components_distributed(spark, sf_dir):
    """By many tiles, and rounds of stars to the end, whatever the size."""
    return q_components(spark, sf_dir, 200, 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    customer = lambda f: lambda spark, d: f(read(spark, d, "customer"))
    eps = EPS["customer"]
    lineitem = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet")
    return {
        "eps_neighbors": customer(lambda p: eps_neighbors(p, eps)),
        "eps_neighbors_zero": lambda s, d: eps_neighbors(points(s.read.parquet(f"{d}/customer.parquet"), "c_custkey", ["c_nationkey"]), 0.0),
        "neighbor_counts": customer(lambda p: neighbor_counts(p, eps)),
        "core_points": customer(lambda p: core_points(p, eps, MIN_PTS)),
        "core_edges": customer(lambda p: core_pairs(p, eps, MIN_PTS)),
        "border_edges": customer(lambda p: border_pairs(p, eps, MIN_PTS)),
        "border_assignment": customer(lambda p: border_lowest(p, eps, MIN_PTS)),
        "components": q_components,
        **{f"dbscan_{n}": partial(q_dbscan, name=n) for n in ("customer", "part", "events", "orders", "supplier")},
        # many tiles and rounds of stars at any size, and the form by joins
        **{f"dbscan_{n}_distributed": partial(q_dbscan, name=n, tile=200, small=0) for n in ("customer", "part", "events", "orders")},
        **{f"dbscan_{n}_joined": partial(q_dbscan, name=n, tile=0, small=0) for n in ("customer", "orders")},
        "dbscan_embeddings_2d": partial(q_dbscan, name="embeddings"),
        "dbscan_embeddings_64d": lambda s, d: dbscan(vectors(s, d), EPS_64, MIN_PTS),
        "cluster_summary": lambda s, d: metrics.summary(_labels(s, d)),
        "cluster_sizes": lambda s, d: metrics.cluster_sizes(_labels(s, d)),
        "cluster_profile": q_profile,
        "noise_points": lambda s, d: metrics.noise_points(_labels(s, d)),
        "ari_vs_truth": q_ari_truth,
        "ari_two_eps": q_ari_two,
        "ari_two_eps_noise": partial(q_ari_two, include_noise=True),
        "bbox_global": customer(lambda p: partition.bounding_boxes(p, [])),
        "bbox_by_block": lambda s, d: partition.bounding_boxes(_boxed(s, d), ["block"]),
        "halo_points": lambda s, d: partition.halo_points(_boxed(s, d), "block", 0.1),
        "block_partition": q_blocks,
        "x_slabs": customer(lambda p: partition.x_slabs(p, 5).select("id", "slab")),
        "upper_median": lambda s, d: partition.upper_median(s.read.parquet(f"{d}/customer.parquet"), ["c_nationkey"], "c_acctbal"),
        "median_bisection": customer(lambda p: partition.median_bisection(p, 2).select("id", "part")),
        "displacements": lambda s, d: partition.displacements(s.read.parquet(f"{d}/customer.parquet").groupBy("c_nationkey").agg(F.count("*").alias("n")), "c_nationkey", "n"),
        "remap_apply": q_remap,
        "dense_relabel": lambda s, d: dense_relabel(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("component"))),
        "imbalance": lambda s, d: metrics.imbalance(lineitem(s, d), ["l_returnflag"], "l_quantity").select("l_returnflag", F.round("imbalance_pct", 6).alias("imbalance_pct")),
        "speedup": lambda s, d: metrics.speedup(s.read.parquet(f"{d}/customer.parquet").groupBy((F.col("c_nationkey") + 1).alias("procs")).agg(F.count("*").cast("double").alias("wall_s")), "procs", "wall_s").select("procs", F.round("speedup", 6).alias("speedup")),
        "components_distributed": q_components_distributed,
        "cross_edges": q_cross_edges,
        "median_of_medians": lambda s, d: partition.median_of_medians(_boxed(s, d), "block", "x0"),
        "local_and_halo": lambda s, d: partition.local_and_halo(_boxed(s, d), "block", 0.1),
        "boxes_overlap": lambda s, d: partition.overlapping(partition.bounding_boxes(_boxed(s, d), ["block"]), "block", ["x0", "x1"]),
        "power_of_two": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", is_power_of_two(F.col("c_custkey")).alias("flag")),
        "distinct_labels": lambda s, d: metrics.distinct_labels(_labels(s, d)),
        "report": q_report,
        "slowest": lambda s, d: metrics.slowest(_runs(s, d)),
        "in_window": lambda s, d: metrics.in_window(_runs(s, d), 195.0, 199.0).select("n_procs", F.round("wall_s", 6).alias("wall_s")),
        "argsort": lambda s, d: partition.rank_by(s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"]).select("s_suppkey", F.col("rank").cast("long").alias("rank")),
        "permutation": lambda s, d: generate.permuted(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), "s_suppkey"), 11),
        "csv_append_read": lambda s, d: q_csv(s, d).select("n_procs", "n_points", F.round("wall_s", 6).alias("wall_s"), "compute_s", "comm_s"),
        "timing_log": lambda s, d: reports.timing_table(_log(s, d)),
        "log_metric": lambda s, d: reports.metric(_log(s, d), "wall time").groupBy("metric").agg(F.count("*").alias("n")),
        "labels_bin_roundtrip": q_labels_file,
        "labels_npy_roundtrip": q_truth_file,
        "verify": q_verify,
        "timing_breakdown": q_breakdown,
        "build_guard": lambda s, d: builds(s),
        "dedupe_first": lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("gid")).agg(F.min("o_orderkey").alias("first")),
        "exclusive_ntile": lambda s, d: partition.block_partition(s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey"), 4, ["s_suppkey"]).select("s_suppkey", F.col("block").cast("long").alias("block")),
        "blob_generate": lambda s, d: _flat(generate.blobs(s, 5000)),
        "blob_generate_in_order": lambda s, d: _flat(generate.blobs(s, 4000, seed=3, shuffle=False)),
        "blob_generate_blocks": lambda s, d: _flat(generate.labelled_blocks(s, 3003, 7)),
        "points_bin_roundtrip": q_points_file,
    }


def _points_sql(name: str) -> str:
    table, ident, _, coords = SETS[name]
    return f"SELECT {ident}::BIGINT AS id, {coords[0]} AS x0, {coords[1]} AS x1 FROM {table}"


def chain(pts: str, near: str, min_pts: int = MIN_PTS) -> str:
    """CTEs pts, nb, core, ce, cc, lab for a clustering."""
    return f"""WITH RECURSIVE pts AS MATERIALIZED ({pts}),
nb AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM pts a JOIN pts b ON {near}),
core AS MATERIALIZED (SELECT src AS id FROM nb GROUP BY src HAVING count(*) >= {min_pts}),
ce AS MATERIALIZED (SELECT src, dst FROM nb WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
cc(id, lbl) USING KEY (id) AS (
  SELECT id, id FROM core
  UNION
  SELECT ce.dst, min(cc.lbl) FROM cc JOIN ce ON ce.src = cc.id JOIN recurring.cc AS r ON r.id = ce.dst WHERE cc.lbl < r.lbl GROUP BY ce.dst),
bord AS (SELECT dst AS id, min(src) AS c FROM nb WHERE src IN (SELECT id FROM core) AND dst NOT IN (SELECT id FROM core) GROUP BY dst),
memb AS (SELECT id, lbl, true AS is_core FROM cc UNION ALL SELECT bord.id, cc.lbl, false FROM bord JOIN cc ON cc.id = bord.c),
firsts AS (SELECT lbl, min(id) AS f FROM memb GROUP BY lbl),
ranks AS (SELECT lbl, row_number() OVER (ORDER BY f) - 1 AS label FROM firsts),
lab AS (SELECT pts.id, coalesce(ranks.label, -1)::BIGINT AS label, coalesce(memb.is_core, false) AS is_core
  FROM pts LEFT JOIN memb ON memb.id = pts.id LEFT JOIN ranks ON ranks.lbl = memb.lbl)
"""


def _near(eps: float) -> str:
    return f"b.x0 BETWEEN a.x0 - {eps * 1.01}::DOUBLE AND a.x0 + {eps * 1.01}::DOUBLE AND (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) <= {eps}::DOUBLE * {eps}::DOUBLE"


def _clusters(name: str, eps: float | None = None) -> str:
    return chain(_points_sql(name), _near(eps or EPS[name]))


_ARI = """cells AS (SELECT a, b, count(*) AS n FROM both_ GROUP BY a, b),
t AS (SELECT coalesce(sum(n::DOUBLE * (n - 1) / 2), 0) AS both_n, coalesce(sum(n), 0)::DOUBLE * (coalesce(sum(n), 0) - 1) / 2 AS pairs FROM cells),
sa AS (SELECT coalesce(sum(n::DOUBLE * (n - 1) / 2), 0) AS s FROM (SELECT a, sum(n) AS n FROM cells GROUP BY a)),
sb AS (SELECT coalesce(sum(n::DOUBLE * (n - 1) / 2), 0) AS s FROM (SELECT b, sum(n) AS n FROM cells GROUP BY b)),
e AS (SELECT both_n, sa.s * sb.s / greatest(pairs, 1.0) AS x, 0.5 * (sa.s + sb.s) - sa.s * sb.s / greatest(pairs, 1.0) AS den FROM t, sa, sb)
SELECT round(CASE WHEN abs(den) < 1e-12 THEN 1.0 ELSE (both_n - x) / den END, 6)::DOUBLE AS ari FROM e"""


def _two_labels(where: str) -> str:
    a, b = _clusters("customer"), _clusters("customer", 0.4)
    return f"WITH la AS ({a} SELECT id, label FROM lab), lb AS ({b} SELECT id, label FROM lab), both_ AS (SELECT la.label AS a, lb.label AS b FROM la JOIN lb USING (id) {where}), {_ARI}"


def oracle_sql() -> dict[str, str]:
    c = _clusters("customer")
    dist64 = "list_sum(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k])))"
    e64 = chain("SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings", f"{dist64} <= {EPS_64}::DOUBLE * {EPS_64}::DOUBLE")
    blocks = f"WITH pts AS ({_points_sql('customer')}), p AS (SELECT *, (ntile(8) OVER (ORDER BY id) - 1)::INTEGER AS block FROM pts), bx AS (SELECT block, min(x0) AS min_x0, max(x0) AS max_x0, min(x1) AS min_x1, max(x1) AS max_x1 FROM p GROUP BY block)"
    runs = "SELECT (c_nationkey + 1)::INTEGER AS n_procs, count(*) AS n_points, max(c_acctbal)::DOUBLE / 50 AS wall_s, max(c_custkey)::DOUBLE AS compute_s, min(c_custkey)::DOUBLE AS comm_s FROM customer GROUP BY c_nationkey"
    split = lambda src, out: f"{out}_b AS (SELECT part, CASE WHEN max(x0) - min(x0) >= max(x1) - min(x1) THEN 0 ELSE 1 END AS dim FROM {src} GROUP BY part), {out}_v AS (SELECT {src}.id, {src}.x0, {src}.x1, {src}.part, CASE WHEN dim = 0 THEN {src}.x0 ELSE {src}.x1 END AS v FROM {src} JOIN {out}_b ON {out}_b.part = {src}.part), {out}_m AS (SELECT part, v AS m FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY v) AS r, count(*) OVER (PARTITION BY part) AS n FROM {out}_v) WHERE r = n // 2 + 1), {out} AS (SELECT {out}_v.id, {out}_v.x0, {out}_v.x1, ({out}_v.part * 2 + CASE WHEN v <= m THEN 0 ELSE 1 END)::INTEGER AS part FROM {out}_v JOIN {out}_m ON {out}_m.part = {out}_v.part)"
    return {
        "eps_neighbors": f"{c} SELECT src, dst FROM nb",
        "eps_neighbors_zero": "SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey",
        "neighbor_counts": f"{c} SELECT src AS id, count(*) AS n FROM nb GROUP BY src",
        "core_points": f"{c} SELECT id FROM core",
        "core_edges": f"{c} SELECT src, dst FROM ce",
        "border_edges": f"{c} SELECT src, dst FROM nb WHERE src IN (SELECT id FROM core) AND dst NOT IN (SELECT id FROM core)",
        "border_assignment": f"{c} SELECT id, c AS core_id FROM bord",
        "components": f"{c} SELECT id, lbl AS component FROM cc",
        **{f"dbscan_{n}": f"{_clusters(n)} SELECT id, label, is_core FROM lab" for n in ("customer", "part", "events", "orders", "supplier")},
        **{f"dbscan_{n}_distributed": f"{_clusters(n)} SELECT id, label, is_core FROM lab" for n in ("customer", "part", "events", "orders")},
        **{f"dbscan_{n}_joined": f"{_clusters(n)} SELECT id, label, is_core FROM lab" for n in ("customer", "orders")},
        "dbscan_embeddings_2d": f"{_clusters('embeddings')} SELECT id, label, is_core FROM lab",
        "dbscan_embeddings_64d": f"{e64} SELECT id, label, is_core FROM lab",
        "cluster_summary": f"{c} SELECT count(*) AS n_points, coalesce(max(label), -1) + 1 AS n_clusters, count(*) FILTER (WHERE label < 0) AS n_noise FROM lab",
        "cluster_sizes": f"{c} SELECT label, count(*) AS size FROM lab WHERE label >= 0 GROUP BY label",
        "cluster_profile": f"{c} SELECT label, count(*) AS size, min(x0) AS min_x0, max(x0) AS max_x0, min(x1) AS min_x1, max(x1) AS max_x1 FROM lab JOIN pts USING (id) WHERE label >= 0 GROUP BY label",
        "noise_points": f"{c} SELECT id FROM lab WHERE label < 0",
        "ari_vs_truth": f"WITH la AS ({_clusters('embeddings')} SELECT id, label FROM lab), both_ AS (SELECT la.label AS a, e.label AS b FROM la JOIN embeddings e ON e.vec_id = la.id WHERE la.label >= 0 AND e.label >= 0), {_ARI}",
        "ari_two_eps": _two_labels("WHERE la.label >= 0 AND lb.label >= 0"),
        "ari_two_eps_noise": _two_labels(""),
        "bbox_global": f"WITH pts AS ({_points_sql('customer')}) SELECT min(x0) AS min_x0, max(x0) AS max_x0, min(x1) AS min_x1, max(x1) AS max_x1 FROM pts",
        "bbox_by_block": f"{blocks} SELECT * FROM bx",
        "halo_points": f"{blocks} SELECT bx.block, p.id FROM p JOIN bx ON p.block <> bx.block AND p.x0 BETWEEN bx.min_x0 - 0.1::DOUBLE AND bx.max_x0 + 0.1::DOUBLE AND p.x1 BETWEEN bx.min_x1 - 0.1::DOUBLE AND bx.max_x1 + 0.1::DOUBLE",
        "block_partition": "SELECT c_custkey AS id, (ntile(7) OVER (ORDER BY c_custkey) - 1)::INTEGER AS block FROM customer",
        "x_slabs": "SELECT c_custkey AS id, (ntile(5) OVER (ORDER BY c_acctbal / 1000.0::DOUBLE, c_custkey) - 1)::INTEGER AS slab FROM customer",
        "upper_median": "SELECT c_nationkey, c_acctbal AS median FROM (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE r = n // 2 + 1",
        "median_bisection": f"WITH p0 AS (SELECT *, 0 AS part FROM ({_points_sql('customer')})), {split('p0', 'p1')}, {split('p1', 'p2')} SELECT id, part FROM p2",
        "displacements": "SELECT c_nationkey, n, coalesce(sum(n) OVER (ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS displ FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey)",
        "remap_apply": f"{c} SELECT id, CASE WHEN label >= 0 AND label % 3 = 0 THEN label // 6 ELSE label END AS label FROM lab",
        "dense_relabel": "SELECT c_custkey AS id, r AS label FROM customer JOIN (SELECT c_nationkey AS k, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS r FROM customer GROUP BY c_nationkey) ON k = c_nationkey",
        "imbalance": "SELECT l_returnflag, round((max(l_quantity) - min(l_quantity)) / max(l_quantity) * 100, 6) AS imbalance_pct FROM lineitem GROUP BY l_returnflag",
        "speedup": "SELECT procs, round(first_value(w) OVER (ORDER BY (procs <> 1)::INTEGER, procs ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / w, 6) AS speedup FROM (SELECT c_nationkey + 1 AS procs, count(*)::DOUBLE AS w FROM customer GROUP BY 1)",
        "components_distributed": q_components_distributed,
        "cross_edges": q_cross_edges,
        "median_of_medians": lambda s, d: partition.median_of_medians(_boxed(s, d), "block", "x0"),
        "local_and_halo": lambda s, d: partition.local_and_halo(_boxed(s, d), "block", 0.1),
        "boxes_overlap": lambda s, d: partition.overlapping(partition.bounding_boxes(_boxed(s, d), ["block"]), "block", ["x0", "x1"]),
        "power_of_two": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", is_power_of_two(F.col("c_custkey")).alias("flag")),
        "distinct_labels": lambda s, d: metrics.distinct_labels(_labels(s, d)),
        "report": q_report,
        "slowest": lambda s, d: metrics.slowest(_runs(s, d)),
        "in_window": lambda s, d: metrics.in_window(_runs(s, d), 195.0, 199.0).select("n_procs", F.round("wall_s", 6).alias("wall_s")),
        "argsort": lambda s, d: partition.rank_by(s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"]).select("s_suppkey", F.col("rank").cast("long").alias("rank")),
        "permutation": lambda s, d: generate.permuted(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), "s_suppkey"), 11),
        "csv_append_read": lambda s, d: q_csv(s, d).select("n_procs", "n_points", F.round("wall_s", 6).alias("wall_s"), "compute_s", "comm_s"),
        "timing_log": lambda s, d: reports.timing_table(_log(s, d)),
        "log_metric": lambda s, d: reports.metric(_log(s, d), "wall time").groupBy("metric").agg(F.count("*").alias("n")),
        "labels_bin_roundtrip": q_labels_file,
        "labels_npy_roundtrip": q_truth_file,
        "verify": q_verify,
        "timing_breakdown": q_breakdown,
        "build_guard": lambda s, d: builds(s),
        "components_distributed": f"{c} SELECT id, lbl AS component FROM cc",
        "cross_edges": f"{c}, blk AS (SELECT id, (ntile(8) OVER (ORDER BY id) - 1)::INTEGER AS block FROM pts) SELECT src, dst, a.block AS src_block, b.block AS dst_block FROM ce JOIN blk a ON a.id = src JOIN blk b ON b.id = dst WHERE a.block < b.block",
        "median_of_medians": f"{blocks}, m AS (SELECT block, x0 FROM (SELECT block, x0, row_number() OVER (PARTITION BY block ORDER BY x0) AS r, count(*) OVER (PARTITION BY block) AS n FROM p) WHERE r = n // 2 + 1) SELECT x0 AS median FROM (SELECT x0, row_number() OVER (ORDER BY x0) AS r, count(*) OVER () AS n FROM m) WHERE r = n // 2 + 1",
        "local_and_halo": f"{blocks} SELECT block, id, true AS is_local FROM p UNION ALL SELECT bx.block, p.id, false FROM p JOIN bx ON p.block <> bx.block AND p.x0 BETWEEN bx.min_x0 - 0.1::DOUBLE AND bx.max_x0 + 0.1::DOUBLE AND p.x1 BETWEEN bx.min_x1 - 0.1::DOUBLE AND bx.max_x1 + 0.1::DOUBLE",
        "boxes_overlap": f"{blocks} SELECT a.block AS a, b.block AS b FROM bx a JOIN bx b ON a.block < b.block AND a.min_x0 <= b.max_x0 AND b.min_x0 <= a.max_x0 AND a.min_x1 <= b.max_x1 AND b.min_x1 <= a.max_x1",
        "power_of_two": "SELECT c_custkey, c_custkey > 0 AND (c_custkey & (c_custkey - 1)) = 0 AS flag FROM customer",
        "distinct_labels": f"{c} SELECT DISTINCT label FROM lab WHERE label >= 0",
        "report": f"{c}, s AS (SELECT count(*) AS n_points, coalesce(max(label), -1) + 1 AS n_clusters, count(*) FILTER (WHERE label < 0) AS n_noise FROM lab), t AS (SELECT s_suppkey AS rank, round(abs(s_acctbal::DOUBLE), 4) AS compute_s, s_nationkey + 0.5::DOUBLE AS comm_s FROM supplier) SELECT 'summary' AS section, 'n_points' AS name, n_points::DOUBLE AS value FROM s UNION ALL SELECT 'summary', 'n_clusters', n_clusters FROM s UNION ALL SELECT 'summary', 'n_noise', n_noise FROM s UNION ALL SELECT 'time', 'max_compute_s', max(compute_s) FROM t UNION ALL SELECT 'time', 'max_comm_s', max(comm_s) FROM t UNION ALL SELECT 'rank', rank || ' compute_s', compute_s FROM t UNION ALL SELECT 'rank', rank || ' comm_s', comm_s FROM t",
        "slowest": f"SELECT max(compute_s) AS max_compute_s, max(comm_s) AS max_comm_s FROM ({runs})",
        "in_window": f"SELECT n_procs, round(wall_s, 6) AS wall_s FROM ({runs}) WHERE wall_s BETWEEN 195.0::DOUBLE AND 199.0::DOUBLE",
        "argsort": "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS rank FROM supplier",
        "permutation": "SELECT row_number() OVER (ORDER BY md5('11/o/' || s_suppkey), s_suppkey) - 1 AS id, s_suppkey FROM supplier",
        "csv_append_read": f"SELECT n_procs, n_points, round(wall_s, 6) AS wall_s, compute_s, comm_s FROM ({runs})",
        "timing_log": "SELECT s_suppkey::INTEGER AS rank, round(abs(s_acctbal::DOUBLE), 4) AS compute_s, s_nationkey + 0.5::DOUBLE AS comm_s FROM supplier",
        "log_metric": "SELECT round(abs(s_acctbal::DOUBLE), 2) AS metric, count(*) AS n FROM supplier GROUP BY 1",
        "labels_bin_roundtrip": f"{c} SELECT row_number() OVER (ORDER BY id) - 1 AS id, label FROM lab",
        "labels_npy_roundtrip": f"SELECT id, true_label AS label FROM ({generate.labelled_blocks_sql(3000)})",
        "verify": f"{c} SELECT 1.0::DOUBLE AS ari, coalesce(max(label), -1) + 1 AS n_clusters, coalesce(max(label), -1) + 1 AS n_clusters_check, count(*) FILTER (WHERE label < 0) AS n_noise, count(*) FILTER (WHERE label < 0) AS n_noise_check FROM lab",
        "timing_breakdown": "SELECT true AS some, true AS complete",
        "build_guard": "SELECT 1::BIGINT AS n_builds, true AS same",
        "blob_generate": generate.blobs_sql(5000),
        "blob_generate_in_order": generate.blobs_sql(4000, seed=3, shuffle=False),
        "blob_generate_blocks": generate.labelled_blocks_sql(3003, 7),
        "dedupe_first": "SELECT o_custkey AS gid, min(o_orderkey) AS first FROM orders GROUP BY o_custkey",
        "exclusive_ntile": "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_suppkey) - 1 AS block FROM supplier",
        "points_bin_roundtrip": f"{c} SELECT id, label, is_core FROM lab",
    }
