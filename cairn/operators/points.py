"""Point tables: ``id BIGINT`` with coordinates as columns x0, x1, ... (few dimensions) or one array ``coords``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.ship import ship

#: Dimensions up to which coordinates are columns of their own.
FEW = 3


def points(df: DataFrame, id_col: str | Column, coords: list[Column | str] | str) -> DataFrame:
    """Normalise a table. ``coords``: expressions, or the name of an array column. Ids must be unique and not null."""
    ident = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("long").alias("id")
    if isinstance(coords, str):
        return df.select(ident, F.col(coords).cast("array<double>").alias("coords"))
    if not coords:
        raise ValueError("points need at least one dimension")
    cols = [(F.expr(c) if isinstance(c, str) else c).cast("double") for c in coords]
    if len(cols) <= FEW:
        return df.select(ident, *(c.alias(f"x{k}") for k, c in enumerate(cols)))
    return df.select(ident, F.array(*cols).alias("coords"))


def axes(pts: DataFrame) -> list[str]:
    """Names of the coordinate columns; empty for an array."""
    return sorted((c for c in pts.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def check(pts: DataFrame, eps: float) -> None:
    """Raise ``ValueError`` for no point table or no radius; ship the package to the executors."""
    ship(pts.sparkSession)
    if not eps >= 0 or eps == float("inf"):
        raise ValueError("eps has to be a finite number, zero or more")
    if "id" not in pts.columns or not (axes(pts) or "coords" in pts.columns):
        raise ValueError("a point table has id and x0, x1, ... or coords")
