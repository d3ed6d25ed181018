"""Density clustering of tiles in numpy, by the same cells as the form by joins."""

from __future__ import annotations

import time
from itertools import product

import numpy as np
import pyarrow as pa

from cairn.operators.components import solve

#: Point-cell rows, and pairs of points, that one vectorised step holds.
ROWS, PAIRS = 1 << 19, 1 << 21


def _runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run, its number and the positions in it, run after run."""
    number = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return number, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _pieces(counts: np.ndarray, most: int):
    """Slices of ``counts`` that sum to at most ``most`` (or hold one entry)."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop


class _Cells:
    """Some of the points by cell, with the box around each cell's points."""

    def __init__(self, x: np.ndarray, code: np.ndarray, n_cells: int, chosen: np.ndarray):
        self.x = x
        picked = np.flatnonzero(chosen)
        self.members = picked[np.argsort(code[picked], kind="stable")]
        self.counts = np.bincount(code[picked], minlength=n_cells)
        self.starts = np.cumsum(self.counts) - self.counts
        full = self.counts > 0
        self.low, self.high = np.full((len(x), n_cells), np.inf), np.full((len(x), n_cells), -np.inf)
        if len(picked):
            self.low[:, full] = np.minimum.reduceat(x[:, self.members], self.starts[full], axis=1)
            self.high[:, full] = np.maximum.reduceat(x[:, self.members], self.starts[full], axis=1)

    def close(self, a: np.ndarray, other: _Cells, b: np.ndarray, most: float) -> np.ndarray:
        """Whether the boxes of the cells a and of the other's cells b may be near enough; never for empty cells."""
        total = np.zeros(len(a))
        for k in range(len(self.x)):
            gap = np.maximum(np.maximum(other.low[k, b] - self.high[k, a], self.low[k, a] - other.high[k, b]), 0)
            total += gap * gap
        return total <= most

    def tips(self) -> np.ndarray:
        """An outermost point of each cell on each side of each axis; rows are sides."""
        out = []
        for row in self.x:
            sorted_ = self.members[np.lexsort((row[self.members], np.repeat(np.arange(len(self.counts)), self.counts)))]
            sorted_ = np.append(sorted_, 0)
            out += [sorted_[self.starts], sorted_[self.starts + np.maximum(self.counts, 1) - 1]]
        return np.array(out)


def _hits(left: _Cells, a: np.ndarray, right: _Cells, b: np.ndarray, eps: float, most: float):
    """Points of left cells a and right cells b at most eps apart: (pair number, left point, right point), in steps."""
    x = left.x
    for piece in _pieces(left.counts[a], ROWS):
        number, at = _runs(left.starts[a[piece]], left.counts[a[piece]])
        p, c, number = left.members[at], b[piece][number], number + piece.start
        total = np.zeros(len(p))
        for k in range(len(x)):
            gap = np.maximum(np.maximum(right.low[k, c] - x[k, p], x[k, p] - right.high[k, c]), 0)
            total += gap * gap
        keep = total <= most
        p, c, number = p[keep], c[keep], number[keep]
        for step in _pieces(right.counts[c], PAIRS):
            row, at = _runs(right.starts[c[step]], right.counts[c[step]])
            q, own = right.members[at], p[step][row]
            total = np.zeros(len(q))
            for k in range(len(x)):
                total += (x[k, own] - x[k, q]) ** 2
            near = total <= eps * eps
            yield number[step][row[near]], own[near], q[near]


def _adjacent(grid: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of every point, and all pairs of cells of a group within two steps on every axis, each with itself included."""
    levels = [np.unique(g) for g in grid]

    def keys(own: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = own
        for g, level in zip(at, levels):
            rank = np.minimum(np.searchsorted(level, g), len(level) - 1)
            key = np.where((key < 0) | (level[rank] != g), -1, key * len(level) + rank)
        return key

    cells, first, code = np.unique(keys(group, grid), return_index=True, return_inverse=True)
    a, b = [], []
    for step in product((-2, -1, 0, 1, 2), repeat=len(grid)):
        want = keys(group[first], grid[:, first] + np.array(step)[:, None])
        at = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
        found = np.flatnonzero(cells[at] == want)
        a.append(found)
        b.append(at[found])
    return code, np.concatenate(a), np.concatenate(b)


def components(x: np.ndarray, eps: float, min_pts: int, slack: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Component of each point (-1: noise) and whether it is core. Points are in the order of their ids; those of
    different groups are no neighbours."""
    n, most = x.shape[1], eps * eps * (1 + slack)
    if eps == 0:
        _, code = np.unique(x + 0.0, axis=1, return_inverse=True)  # -0.0 is 0.0
        core = np.bincount(code.ravel())[code.ravel()] >= min_pts
        return np.where(core, code.ravel(), -1), core
    code, a, b = _adjacent(np.floor(x / (eps / len(x) ** 0.5 * (1 - slack))).astype(np.int64), np.zeros(n, np.int64) if group is None else group)
    m = int(code.max()) + 1
    dense = np.bincount(code) >= min_pts
    every = _Cells(x, code, m, np.ones(n, bool))
    near = every.close(a, every, b, most)
    a, b = a[near], b[near]
    counts = np.zeros(n, np.int64)
    for _, p, _ in _hits(every, a[~dense[a]], every, b[~dense[a]], eps, most):
        counts += np.bincount(p, minlength=n)
    core = dense[code] | (counts >= min_pts)
    cores, others = _Cells(x, code, m, core), _Cells(x, code, m, ~core)
    up = a < b
    u, v = a[up], b[up]
    near = cores.close(u, cores, v, most)
    u, v = u[near], v[near]
    tips, linked = cores.tips(), np.zeros(len(u), bool)
    for s, t in product(tips, tips):
        total = np.zeros(len(u))
        for row in x:
            total += (row[s[u]] - row[t[v]]) ** 2
        linked |= total <= eps * eps
    root = np.arange(m)
    nodes, least = solve(u[linked], v[linked])
    root[nodes] = least
    open_ = ~linked & (root[u] != root[v])
    u, v = u[open_], v[open_]
    more = np.zeros(len(u), bool)
    for number, _, _ in _hits(cores, u, cores, v, eps, most):
        more[number] = True
    nodes, least = solve(root[u[more]], root[v[more]])
    final = np.arange(m)
    final[nodes] = least
    lowest = np.full(n, n)
    for _, p, q in _hits(others, a, cores, b, eps, most):
        np.minimum.at(lowest, p, q)
    lowest[core] = np.flatnonzero(core)
    taken = lowest < n
    return np.where(taken, final[root[code[np.where(taken, lowest, 0)]]], -1), core


def cluster(ids: np.ndarray, x: np.ndarray, eps: float, min_pts: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Label and core flag of each point; ``x`` has a row for each axis."""
    order = np.argsort(ids, kind="stable")
    x = x[:, order]
    good = np.isfinite(x).all(axis=0)
    comp, core = np.full(len(ids), -1), np.full(len(ids), min_pts <= 0)
    if min_pts <= 0:
        comp = len(ids) + np.arange(len(ids))
    if good.any():
        comp[good], core[good] = components(x[:, good], eps, min_pts, slack)
    taken = comp >= 0
    _, first, which = np.unique(comp[taken], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    label, flag = np.full(len(ids), -1, np.int64), np.empty(len(ids), bool)
    label[order[taken]] = rank[which]
    flag[order] = core
    return label, flag


#: Points that are clustered at once, in one tile or several.
BATCH = 1 << 16
TILED = "kind int, id long, is_core boolean, name long"


def _timed(batches, waited: list[int]):
    """The batches; the time that they took to come is added to ``waited``."""
    it = iter(batches)
    while True:
        start = time.perf_counter_ns()
        batch = next(it, None)
        waited[0] += time.perf_counter_ns() - start
        if batch is None:
            return
        yield batch


def by_batch(work, d: int):
    """For ``mapInArrow`` over (home, flag, id, x0, ..., t0, ...) in the order of the tiles t0, ...: what ``work`` yields of
    whole tiles, some at once. It gets a list of parts (home, flag, ids, x, number of the tile)."""

    def tiles(batches):
        held, size, last, number = [], 0, None, -1
        for b in batches:
            home, shared, ids, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(ids):
                continue
            x, tile = np.array(rest[:d], float), np.array(rest[d:], np.int64)
            edges = [0, *(np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
            for start, stop in zip(edges, edges[1:]):
                if last is None or start or (tile[:, 0] != last).any():
                    # another tile: those before it are whole
                    if size >= BATCH:
                        yield from work(held)
                        held, size, number = [], 0, -1
                    number += 1
                held.append((home[start:stop], shared[start:stop], ids[start:stop], x[:, start:stop], np.full(stop - start, number)))
                size += stop - start
            last = tile[:, -1]
        if held:
            yield from work(held)

    return tiles


def by_tile(eps: float, min_pts: int, slack: float, d: int):
    """For ``mapInArrow`` over (home, shared, id, x0, ..., t0, ...) in the order of the tiles t0, ...: rows of ``TILED``.

    Kind 0 is a home point with its cluster's name, the least id of a core point that the tile links to it (null: noise).
    Kind 1 says that the shared core point ``id`` belongs to the cluster ``name``. Kinds 2 and 3 are the nanoseconds
    (``name``) that the task ``id`` computed and waited for rows.
    """

    def clustered(parts):
        home, shared, ids, group = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 4))
        x = np.concatenate([p[3] for p in parts], axis=1)
        # tiles without points of their own have nothing to say
        own = np.zeros(int(group.max()) + 1, bool)
        own[group[home]] = True
        keep = np.flatnonzero(own[group])
        keep = keep[np.argsort(ids[keep], kind="stable")]
        home, shared, ids, group, x = home[keep], shared[keep], ids[keep], group[keep], x[:, keep]
        if not len(ids):
            return
        comp, core = components(x, eps, min_pts, slack, group)
        # the first core point of a component names it; only cores have components of their own
        some = np.flatnonzero(core)
        names, first = np.unique(comp[some], return_index=True)
        name = ids[some][first][np.minimum(np.searchsorted(names, comp), len(names) - 1)] if len(names) else np.zeros(len(ids), np.int64)
        link = shared & core & (name != ids)
        column = lambda f: pa.array(np.concatenate([f[home], f[link]]))
        kind = np.concatenate([np.zeros(int(home.sum()), np.int32), np.ones(int(link.sum()), np.int32)])
        mask = np.concatenate([comp[home] < 0, np.zeros(int(link.sum()), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), column(ids), column(core), pa.array(np.concatenate([name[home], name[link]]), mask=mask)], ["kind", "id", "is_core", "name"])

    tiles = by_batch(clustered, d)

    def run(batches):
        from pyspark import TaskContext

        waited, start = [0], time.perf_counter_ns()
        yield from tiles(_timed(batches, waited))
        spent = [time.perf_counter_ns() - start - waited[0], waited[0]]
        yield pa.RecordBatch.from_arrays([pa.array([2, 3], pa.int32()), pa.array([TaskContext.get().partitionId()] * 2, pa.int64()), pa.nulls(2, pa.bool_()), pa.array(spent)], ["kind", "id", "is_core", "name"])

    return run
