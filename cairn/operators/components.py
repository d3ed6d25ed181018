"""Connected components of an undirected edge table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected components in MapReduce and beyond"): every
round points neighbours at the least node nearby, first among all neighbours, then among the smaller ones. Minima are
pre-aggregated before they shuffle and come back by join, so that a node with very many neighbours is no single task's
group. Before the first round every task replaces its own edges, some at a time, by stars of what they connect, so that
no more edges than nodes are shuffled. Each round is written out, which keeps plans short and lets a lost executor be
replaced. Once the edges number at most ``small``, counted as they are written, one task finishes them; nothing passes
through the driver but counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cairn.plans.durable import drop_durable, durable
from cairn.plans.ship import ship

#: Edges that one task may finish alone (16 bytes each), and edges that become stars at once.
SMALL, CHUNK = 1 << 18, 1 << 18


def solve(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) and the least node of each one's component."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _finish(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, least = solve(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])


def _stars(batches):
    """Edges (u, v) of stars that connect what the given ones connect, v the least; loops of nodes that have no others."""

    def close():
        u, v = (np.concatenate(x) for x in zip(*held))
        nodes, least = solve(u, v)
        keep = (nodes != least) | ~np.isin(nodes, least[nodes != least])
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(least[keep])], ["u", "v"])

    held, size = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= CHUNK:
            yield close()
            held, size = [], 0
    if held:
        yield close()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """A durable table of ``edges`` (u, v) with their number and a hash of them all."""
    seen = Observation()
    out = durable(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")), "edges")
    return out, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of ``edges`` (first two columns, integers); component is the least node reached.

    Loops and repeated edges do no harm; rows with a null end are no edges. A node with loops only is its own component.
    """
    ship(edges.sparkSession)
    a, b = (F.col(f"`{c}`").cast("long") for c in edges.columns[:2])
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a.isNotNull() & b.isNotNull()).alias("ok")).filter("ok").select("u", "v")
    # first dealt anew: a task that finds edges in Python then needs no second worker beside the first
    now, size = _written(pairs.hint("rebalance").mapInArrow(_stars, "u long, v long"))
    loops, keep, seen = now.filter("u = v"), [now], None
    while size[0] > small and size != seen:
        seen, linked = size, now.filter("u <> v")
        both = linked.union(linked.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u")
        after = small_star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).union(loops)
        now, size = _written(after.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if len(keep) > 1:
            drop_durable(keep.pop())
        keep.append(now)
    if size[0] <= small:
        return now.coalesce(1).mapInArrow(_finish, "node long, component long")
    # stars: each larger node hangs on the least of its component
    linked = now.filter("u <> v")
    ends = linked.select(F.col("u").alias("node"), F.col("v").alias("component")).union(linked.select("v", "v")).union(loops.select("u", "v"))
    return ends.groupBy("node").agg(F.min("component").alias("component"))
