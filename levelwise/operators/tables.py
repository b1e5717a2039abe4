"""Counts, crosstabs and summary statistics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from levelwise.cohort import Cohort
from levelwise.functions.predicates import apply_measure_rule
from levelwise.functions.ranks import MEAN, MEDIAN, ROWS, TRIMMED, Stat, describe
from levelwise.functions.rounding import col, quoted, round_half_even, round_measures, rounded_sql
from levelwise.levels import level_grid, level_index
from levelwise.roles import is_signed

NULL_LEVEL = "null"
# Words that cannot be a plain column name in R.
R_RESERVED = (
    "if", "else", "repeat", "while", "function", "for", "next", "break", "TRUE", "FALSE",
    "NULL", "Inf", "NaN", "NA", "NA_integer_", "NA_real_", "NA_character_", "in",
)


def group_count(cohort: Cohort, keys: list[str]) -> DataFrame:
    """Rows per key combination that occurs; null is a label like any other."""
    for k in keys:
        cohort.roles.require(k, "categorical")
    return cohort.counts(keys).groupBy(*map(col, keys)).agg(F.sum("n").alias("n"))


def _counts_on_grid(counts: DataFrame, labels: dict[str, list[str | None]]) -> DataFrame:
    """Sum ``n`` of ``counts`` by the grid's columns, with a row for every grid cell.

    The grid enters the same aggregation as zero-weight rows, so empty cells
    need no join and a null label no special case.
    """
    keys = list(labels)
    zeros = level_grid(counts.sparkSession, labels).withColumn("n", F.lit(0).cast("bigint"))
    return counts.select(*map(col, keys), "n").unionByName(zeros).groupBy(*map(col, keys)).agg(F.sum("n").alias("n"))


def complete_counts(cohort: Cohort, keys: list[str]) -> DataFrame:
    """Counts for every combination of labels, zeros included.

    Null counts as a label of a column in which it occurs.
    """
    cohort.book.load(*keys)
    return _counts_on_grid(cohort.counts(keys), {k: cohort.labels(k) for k in keys})


def freq_table(cohort: Cohort, time: str, group: str) -> DataFrame:
    """Counts of every time and group level, without missing labels."""
    cohort.roles.require(time, "time")
    cohort.roles.require(group, "group")
    known = cohort.counts([time, group]).where(col(time).isNotNull() & col(group).isNotNull())
    levels = {k: list(cohort.book.levels(k)) for k in (time, group)}
    return _counts_on_grid(known, levels).withColumnRenamed("n", "freq")


def row_percent(cohort: Cohort, time: str, group: str) -> DataFrame:
    """Each cell's share of its row total, in long form."""
    row = W.partitionBy(col(time))
    share = 100 * F.try_divide(F.col("n"), F.sum("n").over(row))
    return complete_counts(cohort, [time, group]).withColumn("percent", round_half_even(share))


def _missing_name(labels: list[str | None]) -> str:
    """The column name of the missing label: one that no label has."""
    name = NULL_LEVEL
    while name in labels:
        name += "_"
    return name


def pivot_counts(cohort: Cohort, rows: list[str], column: str) -> DataFrame:
    """Counts with a column per label of ``column``; absent cells are zero.

    Rows are counted before they are pivoted, so the pivot only sees one row
    per cell, and labels are given, so finding them costs no job. A label that the
    dictionary lacks fails the query.
    """
    wide, labels = _pivoted(cohort, rows, column)
    return wide.toDF(*rows, *[_missing_name(labels) if v is None else v for v in labels])


def _pivoted(
    cohort: Cohort, rows: list[str], column: str
) -> tuple[DataFrame, list[str | None]]:
    """Row keys ``_r0``.. and counts ``_c0``.., one for each of the labels returned.

    Columns go by position, as labels may differ in case only or be any text.
    """
    cohort.book.load(*rows, column)
    labels = cohort.labels(column)
    # Column labels are all named by the pivot; the grid only supplies rows.
    grid = {**{r: cohort.labels(r) for r in rows}, column: labels[:1]}
    label = col(column)
    listed = label.isin(*[v for v in labels if v is not None])
    known = F.coalesce(listed, F.lit(None in labels))
    lost = F.concat(F.lit(f"{column} has a label its dictionary lacks: "), F.coalesce(label, F.lit("null")))
    checked = F.when(known, label).otherwise(F.raise_error(lost).cast("string"))
    cells = _counts_on_grid(cohort.counts([*rows, column]).withColumn(column, checked), grid)
    wide = cells.groupBy(*map(col, rows)).pivot(quoted(column), labels).agg(F.sum("n"))
    keys = [f"_r{i}" for i in range(len(rows))]
    counts = [f"_c{i}" for i in range(len(labels))]
    filled = [f"coalesce({c}, 0L) as {c}" for c in counts]
    return wide.toDF(*keys, *counts).selectExpr(*keys, *filled), labels


def _unique_r_names(labels: list[str | None]) -> list[str]:
    """R's column names for labels: a name that has come before gets ``.1``, ``.2`` and so on."""
    taken: set[str] = set()
    out = []
    for base in map(r_name, labels):
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}.{n}"
        taken.add(name)
        out.append(name)
    return out


def r_name(label: str | None) -> str:
    """The column name R's data frames give to a single label."""
    if label is None or label == NULL_LEVEL:
        return "X.NA."
    name = re.sub(r"[^\w.]", ".", label)
    if not re.match(r"([^\W\d_]|\.(?!\d))", name):
        name = f"X{name}"
    return f"{name}." if name in R_RESERVED else name


def crosstab(
    cohort: Cohort, time: str, group: str, second: str | None = None, r_names: bool = False
) -> DataFrame:
    """Row-percent crosstab with counts.

    One group: a row per time, a column per group level. Two groups: a row per
    (time, group), a column per level of ``second``. Percent columns come
    first, then counts.
    """
    if second == group:
        raise ValueError("the two grouping columns must differ")
    cohort.roles.require(time, "time")
    rows, column = ([time], group) if second is None else ([time, group], second)
    for c in (*rows[1:], column):
        cohort.roles.require(c, "group")
    wide, labels = _pivoted(cohort, rows, column)
    keys, counts = wide.columns[: len(rows)], wide.columns[len(rows) :]
    total = " + ".join(counts)
    if r_names:
        names = _unique_r_names(labels)
    else:
        names = [_missing_name(labels) if v is None else v for v in labels]
    suffix = ".Percent" if r_names else "_percent"
    percents = [rounded_sql(f"100 * try_divide({c}, {total})") for c in counts]
    shown = wide.selectExpr(*keys, *[f"{p} as _p{i}" for i, p in enumerate(percents)], *counts)
    return shown.toDF(*rows, *[n + suffix for n in names], *names)


def _zero_rule(measure: str, signed: bool | None, rule: str) -> str:
    return "none" if (is_signed(measure) if signed is None else signed) else rule


def measure_stats(
    cohort: Cohort,
    keys: list[str],
    measure: str,
    stats: list[Stat],
    rule: str = "none",
    method: str = "auto",
) -> DataFrame:
    """Rounded statistics of a measure by key columns of the dataset."""
    cohort.roles.require(measure, "measure")
    for k in keys:
        cohort.roles.require(k, "categorical")
    kept = apply_measure_rule(cohort.df, measure, rule)
    plan = cohort.plan(keys, method) if any(s.ranks() for s in stats) else "direct"
    total = cohort.book.rows if plan == "sorted" else None
    return round_measures(describe(kept, keys, measure, stats, plan=plan, total=total))


def summary(
    cohort: Cohort,
    time: str,
    measure: str,
    group: str | None = None,
    signed: bool | None = None,
    method: str = "auto",
) -> DataFrame:
    """Mean, median, 20% trimmed mean and row count by time, or time and group.

    Zeros and missing values are left out unless the measure is signed.
    Missing group labels form a group; no label is hidden.
    """
    cohort.roles.require(time, "time")
    keys = [time] if group is None else [time, cohort.roles.require(group, "group")]
    rule = _zero_rule(measure, signed, "nonzero")
    return measure_stats(cohort, keys, measure, [MEAN, MEDIAN, TRIMMED, ROWS], rule, method)


def in_level_order(result: DataFrame, cohort: Cohort, keys: list[str]) -> DataFrame:
    """Sort a result by the level order of its keys, missing labels last."""
    return result.orderBy(
        *[level_index(k, cohort.book.levels(k)).asc_nulls_last() for k in keys]
    )


def recode_year(cohort: Cohort, column: str = "Financial_Year", base: int = 2018) -> Cohort:
    """Add ``Year``: the position of a year label among its levels, plus ``base``."""
    year = level_index(column, cohort.book.levels(column)) + base
    return Cohort(cohort.df.withColumn("Year", year), cohort.roles, cohort.book, cohort.filtered)
