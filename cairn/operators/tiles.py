"""Dealing points in few dimensions to square tiles, each with the points around it."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.geometry import finite
from cairn.operators.points import axes
from cairn.plans.durable import scan_parts

#: Cells are wider than eps by so much that rounding in x / width cannot part neighbours by two cells.
SLACK = 1e-3
#: Coordinates of so many cells and more share the outermost cell; below, x / width is off by far less than SLACK.
FAR = float(1 << 40)
#: Points that a tile has at most, but for the smallest tiles, of two eps; these may have up to ``HOT``.
TILE, HOT = 1 << 15, 1 << 18


def valid(pts: DataFrame) -> DataFrame:
    """Points whose coordinates are all finite; the others have no neighbours, not even themselves."""
    names = axes(pts)
    if names:
        ok = F.lit(True)
        for c in names:
            ok = ok & finite(F.col(c))
        return pts.filter(ok)
    return pts.filter(F.forall("coords", finite))


def invalid(pts: DataFrame) -> DataFrame:
    """The other points of a table in few dimensions."""
    return pts.filter(~reduce(lambda s, t: s & t, (F.coalesce(finite(F.col(c)), F.lit(False)) for c in axes(pts))))


def cell(x: Column, width: float) -> Column:
    """Grid cell; coordinates beyond ``FAR`` cells share the outermost ones."""
    return F.floor(F.least(F.greatest(x / F.lit(width), F.lit(-FAR)), F.lit(FAR)))


def fine_side(eps: float, d: int) -> float:
    """Side of a fine cell: its points are neighbours."""
    return eps / d**0.5 * (1 - SLACK)


def plan_tiles(pts: DataFrame, eps: float, tile: int) -> tuple[list[float], list[int], float] | None:
    """Origin, greatest tile numbers and side of the tiles: the largest of sides ``base(eps)``, twice, four times it and
    so on whose tiles hold at most ``tile`` points, else the smallest. None where even these hold over ``HOT``, or beyond
    the range in which cells are sure."""
    names = axes(pts)
    good = valid(pts)
    d, smallest = len(names), base(eps)
    size = good.agg(F.count("*").alias("n"), *(f(c).alias(f"{t}_{c}") for c in names for t, f in (("min", F.min), ("max", F.max)))).first()
    if not size.n:
        return [0.0] * d, [0] * d, smallest
    low, high = [size[f"min_{c}"] for c in names], [size[f"max_{c}"] for c in names]
    if max(map(abs, low + high)) >= fine_side(eps, d) * FAR:
        return None
    top = max(1, *(int((h - lo) / smallest) + 1 for lo, h in zip(low, high))).bit_length()
    found = top if size.n <= tile else None
    while found is None:
        # eight levels at a time, from counts by cells of the finest of them
        least = max(0, top - 8)
        grid = [F.floor((F.col(c) - F.lit(lo)) / F.lit(smallest * 2**least)) for c, lo in zip(names, low)]
        cells = good.groupBy(*(g.alias(f"g{k}") for k, g in enumerate(grid))).agg(F.count("*").alias("n"))
        levels = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top - least - 1))))
        up = levels.groupBy("level", *(F.expr(f"shiftright(g{k}, level)").alias(f"g{k}") for k in range(d))).agg(F.sum("n").alias("n"))
        most = {r.level + least: r.n for r in up.groupBy("level").agg(F.max("n").alias("n")).collect()}
        fits = [k for k, n in most.items() if n <= tile]
        if fits:
            found = max(fits)
        elif least == 0:
            if most[0] > HOT:
                return None
            found = 0
        top = least
    side = smallest * 2**found
    return low, [int((h - lo) // side) for lo, h in zip(low, high)], side


def base(eps: float) -> float:
    """The side of the smallest tiles: a point within 2 eps of a tile is in it or in one beside it."""
    return 2 * eps * (1 + 8 * SLACK)


def deal(pts: DataFrame, eps: float, reach: float, low: list[float], last: list[int], side: float, flag: str | None = None) -> DataFrame:
    """(home, flag, id, x0, ..., t0, ...) by tile t0, ... in order: its own points (home) and those within ``reach`` of it.

    ``flag`` is a column of ``pts``, else whether a point lies within eps of a border of its tile or of the tile."""
    names = axes(pts)
    d = len(names)
    reach, edge = reach * (1 + 2 * SLACK) / side, eps * (1 + 2 * SLACK) / side
    kept = ["id", *names] if flag is None else ["id", *names, flag]
    good = valid(pts).select(*kept, *(((F.col(c) - F.lit(lo)) / F.lit(side)).alias(f"v{k}") for k, (c, lo) in enumerate(zip(names, low))))
    good = good.select(*kept, *(F.floor(f"v{k}").alias(f"t{k}") for k in range(d)), *((F.col(f"v{k}") - F.floor(f"v{k}")).alias(f"v{k}") for k in range(d)))
    within_ = lambda by: lambda k, s: {-1: f"v{k} <= {by!r}D", 0: "true", 1: f"1 - v{k} <= {by!r}D"}[s]
    on_edge = " OR ".join(f"v{k} <= {edge!r}D OR 1 - v{k} <= {edge!r}D" for k in range(d))
    moves = []
    for step in product((-1, 0, 1), repeat=d):
        place = ", ".join(f"t{k} + {s}L AS t{k}" for k, s in enumerate(step))
        near, close = (" AND ".join(within_(by)(k, s) for k, s in enumerate(step)) for by in (reach, edge))
        exists = " AND ".join(f"t{k} + {s}L BETWEEN 0 AND {n}L" for k, (s, n) in enumerate(zip(step, last)))
        moves.append(f"IF({near} AND {exists}, struct({not any(step)} AS home, {close if any(step) else on_edge} AS shared, {place}), null)")
    tiles = [f"t{k}" for k in range(d)]
    dealt = good.withColumn("at", F.explode(F.expr(f"filter(array({', '.join(moves)}), m -> m is not null)"))).select("at.home", F.col(flag or "at.shared").alias("flag"), "id", *names, *(f"at.{t}" for t in tiles))
    return dealt.repartition(scan_parts(pts), *tiles).sortWithinPartitions(*tiles)
