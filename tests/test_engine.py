"""Partitioning, metrics, generators, files, command line and registry by themselves."""

import os
import random

import numpy as np
import pytest

from cairn import __main__ as command
from cairn import registry
from cairn.operators import metrics, partition
from cairn.operators.dbscan import breakdown, dense_relabel, verify
from cairn.plans import guard
from cairn.plans.durable import drop_durable, durable, scratch, shared_path
from cairn.sources import generate, points_bin, reports

NAN = float("nan")


def points(spark, n=60, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.uniform(-5, 5), rng.uniform(0, 3), i * 7 // n) for i in range(n)], "id long, x0 double, x1 double, block int").repartition(4)


def test_ranks_and_blocks(spark):
    rows = spark.createDataFrame([(i % 5, i) for i in range(83)], "k int, id long").repartition(5)
    got = sorted(partition.rank_by(rows, ["k", "id"]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(83)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    blocks = sorted((r.id, r.block) for r in partition.block_partition(rows, 4, ["id"]).collect())
    assert [b for _, b in blocks] == [0] * 21 + [1] * 21 + [2] * 21 + [3] * 20
    assert partition.block_partition(rows.limit(0), 3, ["id"]).count() == 0


def test_medians(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", NAN), ("b", 7.0), ("c", NAN), ("d", 3.0), ("d", None)], "g string, v double")
    assert sorted(map(tuple, partition.upper_median(rows, ["g"], "v").collect())) == [("a", 2.0), ("b", 7.0), ("d", 3.0)]
    # 2, 3, 7
    assert partition.median_of_medians(rows, "g", "v").first().median == 3.0
    assert partition.median_of_medians(rows.filter("g in ('a', 'd')"), "g", "v").first().median == 3.0
    assert partition.median_of_medians(rows.filter("g = 'c'"), "g", "v").first().median is None


@pytest.mark.parametrize("eps", [0.0, 0.3, 4.0])
def test_halo_and_boxes(spark, eps):
    pts = points(spark)
    rows = pts.collect()
    boxes = {b: [(min(v), max(v)) for v in zip(*((r.x0, r.x1) for r in rows if r.block == b))] for b in {r.block for r in rows}}
    want = sorted((b, r.id) for b, box in boxes.items() for r in rows if r.block != b and all(lo - eps <= v <= hi + eps for v, (lo, hi) in zip((r.x0, r.x1), box)))
    assert sorted(map(tuple, partition.halo_points(pts, "block", eps).collect())) == want
    both = partition.local_and_halo(pts, "block", eps).collect()
    assert sorted((r.block, r.id) for r in both if not r.is_local) == want and sum(r.is_local for r in both) == 60
    meet = sorted((a, b) for a in boxes for b in boxes if a < b and all(p[0] <= q[1] and q[0] <= p[1] for p, q in zip(boxes[a], boxes[b])))
    assert sorted(map(tuple, partition.overlapping(partition.bounding_boxes(pts, ["block"]), "block", ["x0", "x1"]).collect())) == meet
    assert partition.halo_points(pts.limit(0), "block", eps).count() == 0


def test_bisection(spark):
    got = partition.median_bisection(points(spark, 64).drop("block"), 3).groupBy("part").count().collect()
    assert len(got) == 8 and all(7 <= r["count"] <= 9 for r in got)


def test_labels_and_runs(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, -1), (4, 2)], "id long, label long")
    assert tuple(metrics.summary(labels).first()) == (4, 3, 1)
    assert sorted(r.label for r in metrics.distinct_labels(labels).collect()) == [0, 2]
    timing = spark.createDataFrame([(0, 1.0, 0.5), (1, 2.0, 0.25)], "rank int, compute_s double, comm_s double")
    got = {(r.section, r.name): r.value for r in metrics.report(labels, timing).collect()}
    assert got[("summary", "n_clusters")] == 3 and got[("time", "max_compute_s")] == 2.0 and got[("rank", "1 comm_s")] == 0.25 and len(got) == 9
    runs = spark.createDataFrame([(1, 10, 100.0, 1.0, 1.0), (2, 10, 150.0, 1.0, 1.0)], reports.RUNS)
    assert [r.n_procs for r in metrics.in_window(runs).collect()] == [2]
    assert metrics.imbalance(spark.createDataFrame([(1, 0.0), (1, 0.0)], "g int, v double"), ["g"], "v").first().imbalance_pct == 0.0
    members = spark.createDataFrame([(5, 9), (2, 7), (8, 7)], "id long, component long")
    assert sorted(map(tuple, dense_relabel(members).collect())) == [(2, 0), (5, 1), (8, 0)]


def test_csv(spark, tmp_path):
    runs = spark.createDataFrame([(1, 10, 1.5, 1.0, 0.5)], reports.RUNS)
    path = str(tmp_path / "runs")
    reports.append_runs(runs, path)
    reports.append_runs(runs.selectExpr("n_procs + 1 as n_procs", "n_points", "wall_s", "compute_s", "comm_s"), path)
    assert sorted(map(tuple, reports.read_runs(spark, path).collect())) == [(1, 10, 1.5, 1.0, 0.5), (2, 10, 1.5, 1.0, 0.5)]


def test_generators(spark):
    for rows in (generate.blobs(spark, 1000, 3, 4), generate.blobs(spark, 1000, 3, 4, shuffle=False), generate.labelled_blocks(spark, 1000, 4, d=3)):
        got = sorted(rows.collect())
        assert [r.id for r in got] == list(range(1000)) and sum(r.true_label == -1 for r in got) == 50
        sizes = np.bincount([r.true_label for r in got if r.true_label >= 0])
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 50
        for k in range(4):
            x = np.array([r.coords for r in got if r.true_label == k])
            assert np.abs(x.std(axis=0) - generate.SIGMA).max() < 0.08 and (np.abs(x.mean(axis=0) - 5) < 4.2).all()
    assert sorted(generate.blobs(spark, 300).repartition(7).collect()) == sorted(generate.blobs(spark, 300).collect())


def test_bin_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(i) * 3, [float(v) for v in rng.normal(size=4)], int(rng.integers(-5, 2**40))) for i in rng.permutation(500)]
    pts = spark.createDataFrame(rows, "id long, coords array<double>, label long").repartition(6)
    points_bin.write_points(pts, str(tmp_path / "p.bin"))
    want = [r[1] for r in sorted(rows)]
    assert np.array_equal(np.fromfile(tmp_path / "p.bin", offset=8).reshape(-1, 4), want)
    assert [r.coords for r in sorted(points_bin.read_points(spark, str(tmp_path / "p.bin"), 70).collect())] == want
    points_bin.write_npy(pts, str(tmp_path / "l.npy"))
    assert np.load(tmp_path / "l.npy").tolist() == [r[2] for r in sorted(rows)]
    assert [r.label for r in sorted(points_bin.read_npy(spark, str(tmp_path / "l.npy"), 99).collect())] == [r[2] for r in sorted(rows)]
    points_bin.write_labels(pts, str(tmp_path / "l.bin"))
    assert np.fromfile(tmp_path / "l.bin", np.int64, offset=4).tolist() == [r[2] for r in sorted(rows)]
    points_bin.write_points(pts.limit(0), str(tmp_path / "e.bin"))
    assert points_bin.read_points(spark, str(tmp_path / "e.bin")).count() == 0
    with pytest.raises(ValueError):
        points_bin.write_points(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, coords array<double>"), str(tmp_path / "x.bin"))
    (tmp_path / "bad.bin").write_bytes(b"\x05\0\0\0abc")
    with pytest.raises(ValueError):
        points_bin.labels_header(str(tmp_path / "bad.bin"))


def test_verify_and_breakdown(spark):
    pts = generate.blobs(spark, 1500).selectExpr("id", "coords[0] x0", "coords[1] x1")
    table, speedup = verify(pts, 0.5)
    r = table.first()
    assert r.ari == 1.0 and r.n_clusters == r.n_clusters_check > 1 and r.n_noise == r.n_noise_check and speedup > 0
    times = breakdown(pts, 0.5, tile=100).collect()
    assert len(times) > 1 and all(t.compute_s >= 0 and t.comm_s >= 0 for t in times)


def test_builds(spark, monkeypatch):
    assert tuple(guard.builds(spark, 3).first()) == (1, True)
    guard.check_builds(spark)
    monkeypatch.setattr(guard, "digest", lambda: "other")
    with pytest.raises(RuntimeError):
        guard.check_builds(spark)
    assert command.main(["--n", "10"], spark) == 2


def test_command_line(spark, tmp_path, capsys):
    out = tmp_path / "labels.bin"
    assert command.main(["--n", "800", "--clusters", "4", "--seed", "3", "--output", str(out), "--timing", "--verify"], spark) == 0
    said = capsys.readouterr().out
    assert "points: 800" in said and "ARI: 1.000000" in said and "max compute:" in said
    labels = np.fromfile(out, np.int64, offset=4)
    assert len(labels) == 800 and f"noise: {(labels < 0).sum()}\n" in said and f"clusters: {labels.max() + 1}\n" in said
    lines = spark.createDataFrame([(x,) for x in said.split("\n")], "value string")
    assert reports.timing_table(lines).count() >= 1 and reports.metric(lines, "ARI").first().metric == 1.0
    points_bin.write_points(generate.blobs(spark, 50, 5), str(tmp_path / "p.bin"))
    assert command.main(["--input", str(tmp_path / "p.bin"), "--eps", "0.8", "--min-pts", "3"], spark) == 0
    assert "points: 50" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        command.main(["--nothing"], spark)


def test_durable_tables(spark):
    table = durable(spark.range(100).repartition(20), "t", small=True)
    files = table.inputFiles()
    assert len(files) < 20 and table.count() == 100
    drop_durable(table)
    assert shared_path(spark).startswith("/")


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_scratch(spark):
    with scratch(spark):
        stays, goes = durable(spark.range(3), "a", stay=True), durable(spark.range(3), "b")
        paths = [t.inputFiles()[0].removeprefix("file:") for t in (stays, goes)]
    assert os.path.exists(paths[0]) and not os.path.exists(paths[1]) and stays.count() == 3
