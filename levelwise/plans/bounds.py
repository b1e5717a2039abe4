"""Size proofs.

Two decisions depend on how large something can get: whether one task may hold
all rows of a group, and whether a table may be broadcast. Both are taken from
a bound known before the query runs (a row count or a level dictionary). With
no bound, or one past the limit, the plan that scales is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.functions.rounding import col

# Rows of one group that a single task may be given to sort.
ONE_TASK_ROWS = 1_000_000
# Groups that a task's hash aggregation gathers at a time before it sorts and holds one
# (Spark's ``spark.sql.objectHashAggregate.sortBased.fallbackThreshold``).
GROUPS_HELD = 128
# Rows of a group past which its ranks are sought in bins, where sizes are counted.
HEAVY_ROWS = 100_000
# Rows that one task is given where all rows are sorted by group; a task of them takes some hundred megabytes at most.
SORTED_ROWS = 250_000
# Buckets of groups that are counted to find heavy ones; a task holds no more counts than these.
SIZE_BUCKETS = 1 << 16
# Groups so few that some hundred bins for each are a small table.
FEW_GROUPS = 10_000
# Rows of a side table that may be sent to every executor: a few labels and
# numbers each, so some tens of megabytes.
BROADCAST_ROWS = 500_000


def fits_one_task(rows: int | None) -> bool:
    return rows is not None and rows <= ONE_TASK_ROWS


def groups_fit_one_task(largest: int | None) -> bool:
    """Whether one task may gather groups of at most ``largest`` rows, many at a time."""
    return largest is not None and fits_one_task(largest * GROUPS_HELD)


def attach(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    small_rows: int | None,
    how: str = "inner",
    extra: Column | None = None,
) -> DataFrame:
    """Join on ``keys``, null matching null, keeping one copy of the keys.

    ``small_rows`` is the proven bound of ``small``; it is broadcast only when
    that bound is within ``BROADCAST_ROWS``. Otherwise Spark joins by shuffle,
    where adaptive execution splits hot keys.
    """
    side = small.withColumnsRenamed({k: f"_rhs_{k}" for k in keys})
    if small_rows is not None and small_rows <= BROADCAST_ROWS:
        side = F.broadcast(side)
    on = [col(k).eqNullSafe(col(f"_rhs_{k}")) for k in keys]
    if extra is not None:
        on.append(extra)
    joined = big.join(side, reduce(Column.__and__, on), how)
    return joined.drop(*[f"_rhs_{k}" for k in keys])
