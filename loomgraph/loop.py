"""One driver for everything iterative.

Each round's state is checkpointed into the shared folder, so plans don't
grow and a lost executor costs a re-read of one state; one small aggregate
tells whether to go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import checkpoint


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], moved: Column | None, max_rounds: int, on_limit: Exception | None = None) -> DataFrame:
    """Apply ``step`` until no row of its result satisfies ``moved``, or ``max_rounds`` times.

    Without ``moved`` all rounds run.  ``on_limit`` is raised where rows still
    move after the last round.
    """
    state = checkpoint(state)
    for _ in range(max_rounds):
        state = checkpoint(step(state))
        if moved is not None and state.filter(moved).isEmpty():
            return state
    if moved is not None and on_limit is not None:
        raise on_limit
    return state


def power_iteration(state: DataFrame, step: Callable[[DataFrame], DataFrame], change: Column, tolerance: float, max_rounds: int) -> DataFrame:
    """Apply ``step`` until the aggregate ``change`` of its result falls below ``tolerance``, or ``max_rounds`` times."""
    state = checkpoint(state)
    for _ in range(max_rounds):
        state = checkpoint(step(state))
        if tolerance > 0:
            value = state.agg(change.alias("change")).first()[0]
            if value is None or value < tolerance:
                break
    return state


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
