"""Line, bar and area queries over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelwise.cohort import Cohort, joint_plan
from levelwise.functions.predicates import apply_measure_rule, visible_label
from levelwise.functions.ranks import MEAN, MEDIAN, ROWS, Stat, describe
from levelwise.functions.rounding import col, quoted, round_measures, rounded_sql
from levelwise.levels import MAX_LEVELS, level_index
from levelwise.operators.tables import _unique_r_names, _zero_rule, measure_stats
from levelwise.sources.scratch import checkpointed

# Line charts show the trimmed mean under the plain name.
LINE_MEAN = Stat("trimmed", "mean", 0.2)
LINE_STATS = [LINE_MEAN, MEDIAN, ROWS]
PLAIN_STATS = [MEAN, MEDIAN, ROWS]
# Labels of the comparison series.
OVERALL = "All"
FILTERED_SUFFIX = ": Filtered"
ALL_SUFFIX = ": All"


def trend(
    cohort: Cohort,
    time: str,
    measure: str,
    baseline: Cohort | None = None,
    compare: bool | None = None,
    signed: bool | None = None,
    method: str = "auto",
) -> DataFrame:
    """Trimmed mean, median and count per time, of one cohort or two.

    With a baseline both series are returned, told apart by ``category``.
    ``compare=None`` includes the baseline only if its row count differs from
    the cohort's, which costs a count of each. Where both are cut from one dataset, its rows are
    read once for both series, and once for both counts.
    """
    rule = _zero_rule(measure, signed, "positive")
    if baseline is not None and compare is None:
        compare = _differ(cohort, baseline)
    if baseline is None or not compare:
        return measure_stats(cohort, [time], measure, LINE_STATS, rule, method)
    cohort.roles.require(time, "time")
    cohort.roles.require(measure, "measure")
    # One aggregation over both series; a series is part of the group key.
    if cohort.shares_base(baseline):
        both = _tagged([(cohort, FILTERED_SUFFIX), (baseline, ALL_SUFFIX)], time, measure, rule)
    else:
        both = _series(cohort, time, measure, rule, FILTERED_SUFFIX).unionByName(
            _series(baseline, time, measure, rule, ALL_SUFFIX), allowMissingColumns=True
        )
    plan = joint_plan([cohort, baseline], [time], method)
    return round_measures(describe(both, ["category", time], measure, LINE_STATS, plan=plan))


def _differ(cohort: Cohort, other: Cohort) -> bool:
    """Whether the row counts of two cohorts differ."""
    if not cohort.shares_base(other):
        return cohort.df.count() != other.df.count()
    a, b = cohort.base.agg(F.count_if(cohort.kept), F.count_if(other.kept)).first()
    return a != b


def _tagged(cohorts: list[tuple[Cohort, str]], time: str, measure: str, rule: str) -> DataFrame:
    """Rows of cohorts of one dataset from one pass: a row for each series that it belongs to."""
    series = [
        F.struct(F.lit(measure + suffix).alias("category"), cohort.kept.alias("_in"))
        for cohort, suffix in cohorts
    ]
    kept = apply_measure_rule(cohorts[0][0].base, measure, rule)
    return kept.select(F.inline(F.array(*series)), col(time), col(measure)).where("_in").drop("_in")


def _series(cohort: Cohort, time: str, measure: str, rule: str, suffix: str) -> DataFrame:
    kept = apply_measure_rule(cohort.df, measure, rule)
    return kept.select(F.lit(measure + suffix).alias("category"), col(time), col(measure))


def trend_by_group(
    cohort: Cohort,
    time: str,
    group: str,
    measure: str,
    signed: bool | None = None,
    strict_labels: bool = False,
    method: str = "auto",
) -> DataFrame:
    """One series per visible group and one for everybody, labelled ``All``.

    The overall series includes rows whose group is hidden. Each row feeds its
    group and the overall series in the same pass.
    """
    cohort.roles.require(time, "time")
    cohort.roles.require(group, "group")
    cohort.roles.require(measure, "measure")
    kept = apply_measure_rule(cohort.df, measure, _zero_rule(measure, signed, "positive"))
    series = F.inline(
        F.array(
            F.struct(col(group).alias(group), F.lit(False).alias("_overall")),
            F.struct(F.lit(OVERALL).alias(group), F.lit(True).alias("_overall")),
        )
    )
    rows = kept.select(col(time), col(measure), series).where(
        F.col("_overall") | visible_label(group, strict_labels)
    )
    # The overall group of a time holds all of that time's rows.
    plan = cohort.plan([time], method)
    keys = [time, group, "_overall"]
    stats = describe(rows, keys, measure, LINE_STATS, plan=plan)
    return round_measures(stats.drop("_overall"))


def grouping_medians(
    cohort: Cohort, time: str, group: str, measure: str, method: str = "auto"
) -> DataFrame:
    """Median and count by (time, group) and by time, told apart by ``level``.

    ``level`` is 0 for (time, group) rows and 1 for the per-time total.
    """
    kept = apply_measure_rule(cohort.df, measure, "positive")
    series = F.inline(
        F.array(
            F.struct(col(group).alias(group), F.lit(0).alias("level")),
            F.struct(F.lit(None).cast("string").alias(group), F.lit(1).alias("level")),
        )
    )
    rows = kept.select(col(time), col(measure), series)
    plan = cohort.plan([time], method)
    return round_measures(
        describe(rows, [time, group, "level"], measure, [MEDIAN, ROWS], plan=plan)
    )


def latest_bar(
    cohort: Cohort,
    time: str,
    groups: list[str],
    measure: str,
    signed: bool | None = None,
    strict_labels: bool = False,
    method: str = "auto",
) -> DataFrame:
    """Mean, median and count by group in the last time level.

    The last level is that of the column, so the result is empty if the cohort
    has no row there. Time and labels are filtered before aggregating.
    """
    cohort.roles.require(time, "time")
    kept = cohort.df.where(col(time) == cohort.book.last(time))
    for g in groups:
        kept = kept.where(visible_label(g, strict_labels))
    rule = _zero_rule(measure, signed, "positive")
    latest = Cohort(kept, cohort.roles, cohort.book, filtered=True)
    return measure_stats(latest, [time, *groups], measure, PLAIN_STATS, rule, method)


def area_mean(
    cohort: Cohort,
    group: str,
    measure: str,
    time: str = "Year_Quarter",
    measure_rule: str = "none",
    strict_labels: bool = False,
    method: str = "auto",
) -> DataFrame:
    """Mean, median and count per (time, visible group).

    By default no measure value is left out, so zeros count and one missing
    value empties the median; ``measure_rule="positive"`` drops both.
    """
    cohort.roles.require(group, "group")
    kept = cohort.df.where(visible_label(group, strict_labels))
    shown = Cohort(kept, cohort.roles, cohort.book, filtered=True)
    return measure_stats(shown, [time, group], measure, PLAIN_STATS, measure_rule, method)


def share_area(
    cohort: Cohort,
    group: str,
    time: str = "Year_Quarter",
    fill: bool = False,
    strict_labels: bool = False,
    r_names: bool = False,
) -> DataFrame:
    """Percent share of each visible group in its time, in long form.

    Every time is paired with every group present. If a time lacks one of them,
    all its percentages and its total are null; with ``fill`` a missing cell is
    a zero instead. A group with more than ``MAX_LEVELS`` visible labels is refused at every size.
    """
    cohort.roles.require(group, "group")
    counted = (
        cohort.counts([time, group])
        .where(visible_label(group, strict_labels))
        .groupBy(col(time).alias("Time"), col(group).alias("Condition"))
        .agg(F.sum("n").alias("cell"))
    )
    # One row per cell of the result; kept, so that the data are read once.
    cells = checkpointed(counted)
    found = cells.select("Condition").distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{group} has more than {MAX_LEVELS} levels")
    present = sorted(row.Condition for row in found)
    times = cells.groupBy("Time").agg(
        F.map_from_entries(F.collect_list(F.struct("Condition", "cell"))).alias("cells"),
        F.sum("cell").alias("total"),
    )
    total, cell = "total", "element_at(cells, shown.label)"
    if fill:
        cell = f"coalesce({cell}, 0L)"
    else:
        total = f"if(size(cells) = {len(present)}, total, null)"
    names = _unique_r_names(present) if r_names else present
    groups = F.array(
        *[F.struct(F.lit(p).alias("label"), F.lit(n).alias("name")) for p, n in zip(present, names)]
    ).cast("array<struct<label:string,name:string>>")
    long = times.select("Time", "cells", F.expr(f"{total} as n"), F.explode(groups).alias("shown"))
    percent = rounded_sql(f"100 * try_divide({cell}, n)")
    return long.selectExpr("Time", "shown.name as Condition", f"{percent} as Percentage", "n")


def melt(
    df: DataFrame,
    ids: list[str],
    values: list[str],
    name: str = "Condition",
    value: str = "Percentage",
) -> DataFrame:
    """Wide to long: a row per value column."""
    return df.unpivot([*map(quoted, ids)], [*map(quoted, values)], name, value)


def stack(
    result: DataFrame,
    cohort: Cohort,
    x: str,
    series: str,
    y: str = "mean",
    group: str | None = None,
) -> DataFrame:
    """Where each bar or area segment starts and ends when stacked.

    The first level of ``series`` ends on top. ``group`` names the column whose levels
    ``series`` holds where the result gives it another name, as a share area does.
    """
    # A result has at most one row per (x, series) label, so this is small.
    order = level_index(series, cohort.book.levels(group or series))
    upto = (
        W.partitionBy(col(x))
        .orderBy(order.desc_nulls_first(), col(series).desc())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    top = F.sum(col(y)).over(upto)
    stacked = result.withColumn("ymax", top)
    return round_measures(stacked.withColumn("ymin", F.col("ymax") - F.coalesce(col(y), F.lit(0.0))))
