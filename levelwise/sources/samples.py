"""Stored samples that answer a scatter sample of any cohort without reading the dataset.

Each row has a draw, a hash of its key. For every label combination of some columns the rows of smallest draw are
stored. Below the least draw at which any of these lists was cut off, all rows of the dataset are known. So a
filter is right if it leaves enough known rows; where it does not, the dataset itself is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelwise.cohort import Cohort
from levelwise.functions.predicates import complete_cases
from levelwise.functions.rounding import col
from levelwise.operators.shapes import SAMPLE_ROWS, draw_of, scatter_sample

_DRAW, _PLACE = "_draw", "_place"


def write_sample(cohort: Cohort, path: str, key: str, cells: Sequence[str], depth: int, seed: int = 42) -> None:
    """Store the ``depth`` rows of smallest draw of each combination of ``cells``, and one more where there is one.

    Each task passes on no more rows of a combination than that.
    """
    if cohort.filtered:
        raise ValueError("samples belong to the whole dataset, not to a filtered cohort")
    by_draw = W.partitionBy(*map(col, cells)).orderBy(_DRAW, col(key))
    drawn = cohort.df.withColumn(_DRAW, draw_of(key, seed)).withColumn(_PLACE, F.row_number().over(by_draw))
    kept = drawn.where(F.col(_PLACE) <= depth + 1)
    kept.withColumn("_depth", F.lit(depth)).write.mode("error").parquet(path)


def stored_sample(
    cohort: Cohort,
    stored: DataFrame,
    group: str,
    x: str,
    y: str,
    key: str,
    seed: int = 42,
    size: int = SAMPLE_ROWS,
) -> DataFrame:
    """The rows that ``scatter_sample`` gives for the same key and seed."""
    cohort.roles.require(group, "group")
    cut = stored.where(F.col(_PLACE) > F.col("_depth")).agg(F.min(_DRAW)).first()[0]
    rows = stored if cut is None else stored.where(F.col(_DRAW) < cut)
    for name, levels in cohort.filters:
        rows = rows.where(col(name).isin(*levels))
    columns = dict.fromkeys([key, group, x, y])
    known = complete_cases(rows.select(*map(col, columns), _DRAW), [group, x, y])
    explained = not cohort.filtered or bool(cohort.filters)
    if not explained or (cut is not None and known.limit(size).count() < size):
        return scatter_sample(cohort, group, x, y, key, seed, size)
    return known.orderBy(_DRAW, col(key)).limit(size).drop(_DRAW)
