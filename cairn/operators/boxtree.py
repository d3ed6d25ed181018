"""Points at most eps apart, from a balanced tree of boxes in numpy.

Two boxes whose farthest corners are at most eps apart hold neighbours only, and two that are further apart than eps hold
none. Only pairs of boxes between the two are opened, down to ``LEAF`` points, which are compared one by one. Differences,
squares and sums round monotonically, so what the corners say holds for the points to the last bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cairn.operators.small import _pieces, _runs

#: Points of a leaf at most; pairs of boxes and of points that one vectorised step holds.
LEAF, BOXES, PAIRS = 16, 1 << 16, 1 << 20


class Tree:
    """Points (columns of ``x``) in the order of a tree whose nodes are halved along their widest axis."""

    def __init__(self, x: np.ndarray):
        order, self.levels = np.arange(x.shape[1]), []
        starts, sizes = np.array([0]), np.array([x.shape[1]])
        while True:
            now = x[:, order]
            low, high = np.minimum.reduceat(now, starts, axis=1), np.maximum.reduceat(now, starts, axis=1)
            self.levels.append((starts, sizes, low, high))
            if sizes[-1] <= LEAF:
                break
            with np.errstate(over="ignore"):
                widest = np.argmax(high - low, axis=0)
            node = np.repeat(np.arange(len(starts)), sizes)
            order = order[np.lexsort((now[widest[node], np.arange(len(order))], node))]
            half = sizes // 2
            starts, sizes = np.stack([starts, starts + half], 1).ravel(), np.stack([half, sizes - half], 1).ravel()
        self.order, self.x = order, now

    def near(self, eps: float, left: np.ndarray, right: np.ndarray):
        """The pairs of points at most eps apart, each once, as places in ``order``: products of ranges (a, a's end, b,
        b's end), or pairs (p, q) in runs of one p. Only boxes with points of ``left`` and ``right`` are looked at."""
        most, stack = eps * eps, [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        some = [[np.add.reduceat(flag[self.order].astype(np.int64), level[0]) > 0 for level in self.levels] for flag in (left, right)]
        wanted = left[self.order]
        while stack:
            level, a, b = stack.pop()
            if len(a) > BOXES:
                stack.append((level, a[BOXES:], b[BOXES:]))
                a, b = a[:BOXES], b[:BOXES]
            starts, sizes, low, high = self.levels[level]
            keep = some[0][level][a] & some[1][level][b]
            a, b = a[keep], b[keep]
            gap, far = np.zeros(len(a)), np.zeros(len(a))
            with np.errstate(over="ignore"):
                for lo, hi in zip(low, high):
                    p, q = lo[b] - hi[a], lo[a] - hi[b]
                    gap += np.maximum(np.maximum(p, q), 0) ** 2
                    far += np.minimum(p, q) ** 2
            full, open_ = far <= most, (far > most) & (gap <= most)
            if full.any():
                i, j = a[full], b[full]
                yield True, (starts[i], starts[i] + sizes[i], starts[j], starts[j] + sizes[j])
            a, b = a[open_], b[open_]
            if not len(a):
                continue
            if level + 1 < len(self.levels):
                stack.append((level + 1, (2 * a[:, None] + np.array([0, 0, 1, 1])).ravel(), (2 * b[:, None] + np.array([0, 1, 0, 1])).ravel()))
                continue
            for piece in _pieces(sizes[a] * sizes[b], PAIRS):
                number, p = _runs(starts[a[piece]], sizes[a[piece]])
                number, p = number[wanted[p]], p[wanted[p]]
                row, q = _runs(starts[b[piece]][number], sizes[b[piece]][number])
                p, total = p[row], np.zeros(len(q))
                with np.errstate(over="ignore"):
                    for x in self.x:
                        total += (x[p] - x[q]) ** 2
                close = total <= most
                yield False, (p[close], q[close])


def apart(x: np.ndarray, group: np.ndarray, eps: float) -> np.ndarray:
    """``x`` with one more axis, on which points of different groups are no neighbours and those of one are at one place."""
    return np.concatenate([x, group[None].astype(float) * max(4 * eps, 1.0)])


def counts(x: np.ndarray, eps: float, left: np.ndarray) -> np.ndarray:
    """How many points lie at most eps from each point of ``left``."""
    tree, n = Tree(x), x.shape[1]
    steps, single = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    for whole, found in tree.near(eps, left, np.ones(n, bool)):
        if whole:
            a, a_end, b, b_end = found
            np.add.at(steps, a, b_end - b)
            np.add.at(steps, a_end, b - b_end)
        else:
            single += np.bincount(found[0], minlength=n)
    out = np.empty(n, np.int64)
    out[tree.order] = np.cumsum(steps[:-1]) + single
    return out[left]


def products(ids: np.ndarray, x: np.ndarray, eps: float, left: np.ndarray, right: np.ndarray):
    """Lists (a, b) of ids whose products are the pairs of points of ``left`` and ``right`` at most eps apart, each once."""
    tree = Tree(x)
    sides, upto = [], []
    for flag in (left, right):
        flag = flag[tree.order]
        sides.append(ids[tree.order][flag])
        upto.append(np.append(0, np.cumsum(flag)))

    def lists(side: int, starts: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(sides[side][_runs(starts, counts)[1]]))

    for whole, found in tree.near(eps, left, right):
        if whole:
            a, a_end, b, b_end = found
            a, n, b, m = upto[0][a], upto[0][a_end] - upto[0][a], upto[1][b], upto[1][b_end] - upto[1][b]
        else:
            p, q = found
            kept = upto[1][q + 1] > upto[1][q]
            p, q = p[kept], q[kept]
            if not len(p):
                continue
            # of a run of one p the stretches of successive q
            heads = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (upto[1][q[1:]] != upto[1][q[:-1]] + 1)))
            a, b, m = upto[0][p[heads]], upto[1][q[heads]], np.diff(np.append(heads, len(p)))
            n = np.ones(len(a), np.int64)
        for piece in _pieces(n + m, PAIRS):
            yield pa.RecordBatch.from_arrays([lists(0, a[piece], n[piece]), lists(1, b[piece], m[piece])], ["a", "b"])
