"""Stored quantile sketches: approximate medians and quantiles of any filtered part, without its rows.

A KLL sketch of each measure is stored for every label combination of some columns. Sketches merge: those of the
cells that a filter leaves give the quantiles of their union. A sketch keeps some thousand values whatever
it has seen; up to that many are kept all, so small groups are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelwise.cohort import Cohort
from levelwise.functions.predicates import apply_measure_rule
from levelwise.functions.rounding import col

#: Size of a sketch; more is finer.
FINENESS = 1024


def rank_error(fineness: int = FINENESS) -> float:
    """Bound on the distance of a returned value's rank from the rank asked for, as a share of the values.

    Twice the error that the sketch keeps with 99 % confidence, so a larger one is not to be expected.
    """
    # The error law of the sketch for a single rank.
    return 2 * 2.296 / fineness**0.9021


def write_sketches(
    cohort: Cohort,
    path: str,
    columns: Sequence[str],
    measures: Sequence[str],
    rule: str = "none",
    fineness: int = FINENESS,
) -> None:
    """Sketch ``measures`` of an unfiltered cohort for every combination of ``columns``.

    ``rule`` leaves out values as in summaries (``none``, ``nonzero`` or ``positive``); missing values and
    not-a-number are no values. Partial sketches of every task merge, so no group is gathered.
    """
    if cohort.filtered:
        raise ValueError("sketches belong to the whole dataset, not to a filtered cohort")
    for c in columns:
        cohort.roles.require(c, "categorical")
    for i, m in enumerate(measures):
        cohort.roles.require(m, "measure")
        value = F.nanvl(col(m).cast("double"), F.lit(None).cast("double")).alias("v")
        rows = apply_measure_rule(cohort.df, m, rule).select(
            *[col(c).alias(f"c{j}") for j, c in enumerate(columns)], value
        )
        rows = rows.where("v is not null").groupBy(*[f"c{j}" for j in range(len(columns))])
        sketched = rows.agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", fineness).alias("sketch"))
        sketched.withColumns({"measure": F.lit(m), "place": F.lit(i)}).write.mode("append").partitionBy(
            "place"
        ).parquet(path)


def approximate_quantiles(
    sketches: DataFrame,
    columns: Sequence[str],
    measure: str,
    keys: Sequence[str],
    shares: Sequence[float] = (0.5,),
    filters: Sequence[tuple[str, Sequence[str]]] = (),
) -> DataFrame:
    """``keys``, ``p``, ``value`` and ``n``: the quantiles ``shares`` of a measure by ``keys``.

    ``sketches`` is what ``write_sketches`` stored for ``columns``. A filter (column, levels) must be on one of
    these. Groups without a value have no row. For the error see ``rank_error``.
    """
    names = {c: f"c{j}" for j, c in enumerate(columns)}
    unknown = [c for c in (*keys, *(f for f, _ in filters)) if c not in names]
    if unknown:
        raise ValueError(f"no sketches by {unknown}")
    cells = sketches.where(F.col("measure") == measure)
    for name, levels in filters:
        cells = cells.where(F.col(names[name]).isin(*levels))
    merged = cells.groupBy(*[F.col(names[k]) for k in keys]).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    read = [
        F.struct(p.alias("p"), F.kll_sketch_get_quantile_double("sketch", p).alias("value"))
        for p in (F.lit(float(share)) for share in shares)
    ]
    listed = merged.where("n > 0").select(*[names[k] for k in keys], F.inline(F.array(*read)), "n")
    return listed.toDF(*keys, "p", "value", "n")


def checked_quantiles(
    quantiles: DataFrame, cohort: Cohort, measure: str, keys: Sequence[str], rule: str = "none", error: float = rank_error()
) -> DataFrame:
    """``keys``, ``p``, ``n`` and whether each value's true rank among the cohort's rows is within ``error``.

    Counts the rows below and at each value: one pass with a join on the keys.
    """
    rows = apply_measure_rule(cohort.df, measure, rule).select(
        *[col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.nanvl(col(measure).cast("double"), F.lit(None).cast("double")).alias("v"),
    )
    asked = quantiles.toDF(*[f"q{i}" for i in range(len(keys))], "p", "value", "_n")
    lists = asked.groupBy(*[f"q{i}" for i in range(len(keys))]).agg(
        F.collect_list(F.struct("p", "value")).alias("asked")
    )
    on = [F.col(f"k{i}").eqNullSafe(F.col(f"q{i}")) for i in range(len(keys))]
    met = rows.where("v is not null").join(lists, on).select(
        *[f"k{i}" for i in range(len(keys))], "v", F.inline("asked")
    )
    ranks = met.groupBy(*[f"k{i}" for i in range(len(keys))], "p").agg(
        F.count(F.lit(1)).alias("n"), F.expr("count_if(v < value)").alias("below"), F.expr("count_if(v <= value)").alias("upto")
    )
    within = (F.col("below") <= (F.col("p") + error) * F.col("n")) & (F.col("upto") >= (F.col("p") - error) * F.col("n"))
    return ranks.select(*[F.col(f"k{i}") for i in range(len(keys))], "p", "n", within.alias("within")).toDF(
        *keys, "p", "n", "within"
    )
