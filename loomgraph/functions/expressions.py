"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEURISTICS = ("euclidean", "manhattan", "chebyshev")


def heuristic(kind: str, x: Column, y: Column, goal_x: float, goal_y: float) -> Column:
    """An estimate of the distance to a goal from coordinates."""
    dx, dy = F.abs(x - F.lit(goal_x)), F.abs(y - F.lit(goal_y))
    if kind == "euclidean":
        return F.sqrt(dx * dx + dy * dy)
    if kind == "manhattan":
        return dx + dy
    if kind == "chebyshev":
        return F.greatest(dx, dy)
    raise ValueError(f"heuristic must be one of {', '.join(HEURISTICS)}")


def lowest_one(x: Column) -> Column:
    """The lowest bit of ``x`` that is set."""
    return x.bitwiseAND(-x)


def lowest_zero_index(x: Column) -> Column:
    """The position of the lowest bit of ``x`` that isn't set."""
    zero = F.bitwise_not(x).bitwiseAND(x + F.lit(1))
    return F.bit_count(zero - F.lit(1))
