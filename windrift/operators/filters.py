"""Predicates and crops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tight_window(grid: DataFrame, inside: Column, x: str, y: str) -> DataFrame:
    """The smallest index rectangle that holds all cells that are inside."""
    b = grid.where(inside).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    return grid.join(F.broadcast(b), F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))).drop("x0", "x1", "y0", "y1")


def top_level(top: float, origin: float, spacing: float) -> int:
    """The last level not above a height, with a little tolerance."""
    return math.floor((top - origin) / spacing + 1e-9)


def contains(domain: tuple[float, float, float, float], x0: str, x1: str, y0: str, y1: str) -> Column:
    a, b, c, d = domain
    return (F.col(x0) >= a) & (F.col(x1) <= b) & (F.col(y0) >= c) & (F.col(y1) <= d)


def miss_percent(low: float, high: float, x0: Column, x1: Column) -> Column:
    """By how many percent of the domain a range stands out of it on its worse side."""
    return F.greatest(F.lit(0.0), low - x0, x1 - high) / (high - low) * 100


def above_ground(cells: DataFrame, ground: DataFrame, height: Column, level: str) -> DataFrame:
    """Cells whose height is at or above the ground at (x, y)."""
    return cells.join(ground, ["x", "y"]).where(height >= F.col(level))


def signed_distance(x: str, y: str, a: float, b: float, c: float) -> Column:
    """Side of the vertical plane a x + b y = c; not normed."""
    return a * F.col(x) + b * F.col(y) - c


def same_grids(meta: DataFrame, *columns: str) -> None:
    """Raise unless all rows of a catalogue agree in the columns (dimensions, origin, spacing)."""
    n = meta.select(*columns).distinct().limit(2).count()
    if n > 1:
        raise ValueError(f"inputs differ in {', '.join(columns)}")
