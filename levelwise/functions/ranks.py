"""Exact rank statistics per group: median, trimmed mean, quantiles.

Spark's own exact percentile keeps a group's whole value map in one task, and a
ranking window sorts a whole group in one task. A report has few groups and
each may hold a third of all rows, so both stop working at size. Four plans give
the same answers here.

``direct``
    For data, or groups, proven so small that no task gathers more than
    ``ONE_TASK_ROWS`` rows at a time: a group's values are gathered, sorted, and
    read at the ranks wanted. One shuffle.

``sorted``
    For many groups, none of them large: rows are sorted by group and value in one shuffle and
    numbered, and a group is read at the ranks wanted. No group is held as an array. There are as many tasks
    as the rows call for (``SORTED_ROWS`` each), so that none grows with the data.

``split``
    For many groups of any size: rows are counted by buckets of groups first, with map-side combine, and by
    group in the buckets alone that have more than ``HEAVY_ROWS`` rows. Groups of more than that
    go by ``ranked``, all others by ``sorted``.

``ranked``
    For everything else. Values are cut into bins by a monotone function of
    the value, so bins are in rank order. Counts and sums per bin combine
    before the shuffle, and tell which few bins hold a wanted rank. Only
    those are cut again, until each is small enough for one task to list its
    values. Every other bin enters the result as one row (count, sum). Rows
    are never shuffled unless they lie next to a wanted rank, and no group has
    to fit anywhere.

    The passes build one *rank table*, a row per value or whole bin: ``c``
    rows, their sum ``s``, the value ``v`` when there is only one, ``cum``, the
    group's row count up to and including this row, and the group's ``n`` rows
    and ``nn`` values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.functions.rounding import col, quoted, settle
from levelwise.plans import bounds
from levelwise.plans.bounds import attach, fits_one_task
from levelwise.sources.scratch import checkpointed

# Bins per e-fold of the first, logarithmic cut, and per interval of later ones.
LOG_BINS = 128
BINS = 1024
# Bins that a filter on the rows may list.
LISTED_BINS = 1000

_MEDIAN_RANKS = ("floor((nn + 1) / 2)", "floor((nn + 2) / 2)")


@dataclass(frozen=True)
class Stat:
    """A statistic of one measure within a group.

    ``kind`` is ``rows`` (all rows), ``valid`` (rows with a value), ``mean``,
    ``median`` (missing values ignored), ``strict_median`` (null as soon as one
    value is missing), ``trimmed`` (mean after dropping the fraction ``p`` at
    each end) or ``quantile`` (linear interpolation at ``p``).
    """

    kind: str
    name: str
    p: float = 0.0

    @property
    def _is_median(self) -> bool:
        return "median" in self.kind or (self.kind == "trimmed" and self.p >= 0.5)

    @property
    def _cut(self) -> str:
        """Values dropped at each end; a double, as decimals would floor apart."""
        return f"floor(nn * {float(self.p)!r}D)"

    @property
    def _position(self) -> str:
        return f"((nn - 1) * {float(self.p)!r}D)"

    def ranks(self) -> tuple[str, ...]:
        """One-based ranks whose neighbourhood must be known value by value."""
        if self._is_median:
            return _MEDIAN_RANKS
        if self.kind == "trimmed":
            return (f"{self._cut} + 1", f"nn - {self._cut}")
        if self.kind == "quantile":
            return (f"floor({self._position}) + 1", f"ceil({self._position}) + 1")
        return ()

    def _between_ranks(self, low: str, high: str, n: str, nn: str) -> str:
        """The statistic from the values at its two ranks."""
        if self.kind == "quantile":
            h = self._position.replace("nn", nn)
            return f"{low} + ({h} - floor({h})) * ({high} - {low})"
        middle = f"({low} + {high}) / 2"
        return f"if({n} = {nn}, {middle}, null)" if self.kind == "strict_median" else middle

    def of_sorted(self) -> str:
        """SQL over a group's ``n``, ``nn``, ``total`` and sorted ``a``."""
        if self.kind in ("rows", "valid"):
            return "n" if self.kind == "rows" else "nn"
        if self.kind == "mean":
            return "try_divide(total, nn)"
        if self.kind == "trimmed" and not self._is_median:
            k = f"cast({self._cut} as int)"
            kept = f"slice(a, {k} + 1, greatest(0, cast(nn as int) - 2 * {k}))"
            return f"try_divide(aggregate({kept}, 0D, (x, y) -> x + y), nn - 2 * {k})"
        low, high = (f"get(a, cast({r} - 1 as int))" for r in self.ranks())
        return self._between_ranks(low, high, "n", "nn")

    def of_ranks(self) -> str:
        """SQL aggregate over a group's rank table."""
        if self.kind in ("rows", "valid"):
            return "max(n)" if self.kind == "rows" else "max(nn)"
        if self.kind == "mean":
            return "try_divide(sum(s), max(nn))"
        if self.kind == "trimmed" and not self._is_median:
            kept = f"greatest(0, least(cum, nn - {self._cut}) - greatest(cum - c, {self._cut}))"
            value = f"case when {kept} = c then s else {kept} * v end"
            return f"try_divide(sum(if({kept} > 0, {value}, null)), sum({kept}))"
        low, high = (f"min(if(cum >= {r}, v, null))" for r in self.ranks())
        return self._between_ranks(low, high, "max(n)", "max(nn)")

    def plain(self) -> str:
        """SQL aggregate over the rows themselves, where no rank is needed."""
        return {"rows": "count(*)", "valid": "count(v)", "mean": "avg(v)"}[self.kind]


ROWS = Stat("rows", "n")
MEAN = Stat("mean", "mean")
MEDIAN = Stat("strict_median", "median")
TRIMMED = Stat("trimmed", "trimmed_mean_20", 0.2)


def _measure_rows(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    # Not-a-number counts as missing, as everywhere else.
    value = f"nanvl(cast({quoted(measure)} as double), cast(null as double)) as v"
    return df.selectExpr(*map(quoted, keys), value)


def _gathered(rows: DataFrame, keys: list[str], spread: bool) -> DataFrame:
    """A group's values in one sorted array; only for groups proven small."""
    return rows.groupBy(*map(col, keys)).agg(
        F.expr("count(*) as n"),
        F.expr("count(v) as nn"),
        F.expr("sum(v) as total"),
        F.expr("sort_array(collect_list(v)) as a"),
        *map(F.expr, _SPREAD if spread else ()),
    )


_SPREAD = ("stddev_samp(v) as sd", "min(v) as lo", "max(v) as hi")
_SORTED_SPREAD = (
    "if(max(nn) > 1, sqrt(sum((v - mid) * (v - mid)) / (max(nn) - 1)), null) as sd",
    *_SPREAD[1:],
)
_BIN_SUMS = ("count(*) as c", "sum(v) as s", "min(v) as lo", "max(v) as hi")


def _running(path: list[str], order: str) -> str:
    by = ", ".join(map(quoted, path))
    return f"sum(c) over (partition by {by} order by {order} rows unbounded preceding)"


def _log_bin(value: str) -> str:
    return f"floor(signum({value}) * log1p(abs({value})) * {LOG_BINS})"


def _coarse_bins(rows: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    """One row per non-empty bin of a fixed logarithmic scale, lowest first.

    Bin numbers need nothing but the value, so one scan yields the group totals
    and the first histogram. A group without any value keeps its null bin.
    With ``spread`` a bin also has its variance.
    """
    by = ", ".join(map(quoted, keys))
    sums = [*_BIN_SUMS, *(["var_pop(v) as within"] if spread else [])]
    bins = rows.groupBy(*map(col, keys), F.expr(f"{_log_bin('v')} as _bin")).agg(*map(F.expr, sums))
    return (
        bins.selectExpr("*", f"sum(c) over (partition by {by}) as n")
        .withColumn("c", F.expr("if(_bin is null, 0L, c)"))
        .selectExpr(
            "*",
            f"sum(c) over (partition by {by}) as nn",
            f"{_running(keys, '_bin')} as cum",
        )
    )


def _rows_inside(rows: DataFrame, opened: DataFrame, keys: list[str], size: int) -> DataFrame:
    edges = opened.select(*map(col, keys), "lo", "hi", "base", "n", "nn")
    return attach(rows, edges, keys, size, extra=F.expr("v >= lo and v <= hi"))


def _finer_bins(rows: DataFrame, opened: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Cut each open interval into equal bins and count the rows of each.

    The bin is a monotone function of the value however it rounds, so ranks
    stay exact; the smallest and largest value never share a bin.
    """
    cell = f"cast(least({BINS - 1}, floor(try_divide(v - lo, hi - lo) * {BINS})) as int) as _bin"
    bins = (
        _rows_inside(rows, opened, keys, size)
        .groupBy(*map(col, keys), F.expr("lo as _from"), F.expr(cell))
        .agg(*map(F.expr, _BIN_SUMS), *[F.max(c).alias(c) for c in ("base", "n", "nn")])
    )
    return bins.selectExpr("*", f"base + {_running([*keys, '_from'], '_bin')} as cum")


def _spread_rows(bins: DataFrame, keys: list[str]) -> DataFrame:
    """A weightless rank table row per group with its sd, smallest and largest value."""
    by = ", ".join(map(quoted, keys))
    moved = bins.selectExpr("*", f"s / c - sum(s) over (partition by {by}) / nn as moved")
    square = "sum(c * (within + moved * moved))"
    return (
        moved.where("c > 0")
        .groupBy(*map(col, keys), "n", "nn")
        .agg(
            F.expr(f"sqrt(try_divide({square}, nn - 1)) as sd"),
            F.expr("min(lo) as lo"),
            F.expr("max(hi) as hi"),
        )
        .selectExpr("*", "0L as c", "0L as cum")
    )


def _rank_table(
    rows: DataFrame, keys: list[str], stats: list[Stat], spread: bool
) -> DataFrame:
    ranks = dict.fromkeys(r for s in stats for r in s.ranks())
    holds = " or ".join(f"(cum - c < {r} and {r} <= cum)" for r in ranks)
    is_open = F.expr(f"coalesce(lo < hi and ({holds}), false) as _open")
    out = [*map(quoted, keys), "v", "c", "s", "cum", "n", "nn"]

    parts, bins = [], _coarse_bins(rows, keys, spread)
    while True:
        # A few bins per group: written once, so later passes start from them
        # and a lost executor cannot make two passes see different bins.
        bins = checkpointed(bins.select("*", is_open))
        if spread and not parts:
            spread_rows = _spread_rows(bins, keys)
        closed = bins.where("not _open").withColumn("v", F.expr("if(lo = hi, lo, null)"))
        parts.append(closed.select(*out))
        opened = bins.where("_open").withColumn("base", F.expr("cum - c"))
        intervals, largest, log_bins = opened.agg(
            F.expr("count(*)"), F.expr("max(c)"), F.expr(f"collect_set({_log_bin('lo')})")
        ).first()
        if not intervals:
            break
        # An interval lies within one coarse bin; most rows are in none of
        # these and are passed over before the join.
        near = rows
        if len(log_bins) <= LISTED_BINS:
            near = rows.where(f"{_log_bin('v')} in ({', '.join(map(str, log_bins))})")
        if fits_one_task(largest):
            break
        bins = _finer_bins(near, opened, keys, intervals)
    if intervals:
        listed = (
            _rows_inside(near, opened, keys, intervals)
            .groupBy(*map(col, keys), F.expr("lo as _from"), "v", "base", "n", "nn")
            .agg(F.expr("count(*) as c"))
        )
        upto = f"base + {_running([*keys, '_from'], 'v')} as cum"
        parts.append(listed.selectExpr("*", upto, "v * c as s").select(*out))
    table = reduce(DataFrame.unionByName, parts)
    return table.unionByName(spread_rows, allowMissingColumns=True) if spread else table


def _sorted_table(rows: DataFrame, keys: list[str], spread: bool, total: int) -> DataFrame:
    """A rank table with a row for each row of the data; missing values come last and weigh nothing.

    ``total`` bounds the rows; by it they are dealt, as neither the session's number of partitions
    nor the bytes that adaptive execution merges bound the rows of a task.
    """
    by = ", ".join(map(quoted, keys))
    if total > bounds.SORTED_ROWS:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        rows = rows.repartition(max(-(-total // bounds.SORTED_ROWS), cores), *map(col, keys))
    weighed = rows.selectExpr("*", "if(v is null, 0L, 1L) as c")
    return weighed.selectExpr(
        *map(quoted, keys),
        "v",
        "c",
        "v as s",
        f"sum(c) over (partition by {by} order by v nulls last rows unbounded preceding) as cum",
        f"count(*) over (partition by {by}) as n",
        f"count(v) over (partition by {by}) as nn",
        *([f"avg(v) over (partition by {by}) as mid"] if spread else []),
    )


def _heavy_groups(rows: DataFrame, keys: list[str]) -> tuple[DataFrame | None, int]:
    """Groups of more than ``HEAVY_ROWS`` rows, if any, and the number of all rows.

    Only groups of a bucket with as many rows can be heavy, so groups are counted in few buckets.
    """
    bucket = F.pmod(F.xxhash64(*map(col, keys)), F.lit(bounds.SIZE_BUCKETS)).alias("_bucket")
    by_bucket = rows.select(bucket).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    by_bucket = checkpointed(by_bucket)
    full = by_bucket.where(F.col("_size") > bounds.HEAVY_ROWS).select("_bucket")
    total, found = by_bucket.agg(
        F.expr("coalesce(sum(_size), 0)"), F.count_if(F.col("_size") > bounds.HEAVY_ROWS)
    ).first()
    if not found:
        return None, total
    near = attach(rows.select(*map(col, keys), bucket), full, ["_bucket"], found)
    sizes = near.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("_size"))
    # Kept, so that both sides agree on which groups are heavy, whatever is computed anew.
    return checkpointed(sizes.where(F.col("_size") > bounds.HEAVY_ROWS).drop("_size")), total


def _split(rows: DataFrame, keys: list[str], stats: list[Stat], spread: bool) -> DataFrame:
    """Heavy groups by bins, all others sorted."""
    heavy, total = _heavy_groups(rows, keys)
    found = heavy.count() if heavy is not None else 0
    if not found:
        return _by_plan(rows, keys, stats, "sorted", spread, total)
    marked = attach(rows, heavy.withColumn("_heavy", F.lit(True)), keys, found, how="left")
    light = marked.where("_heavy is null").drop("_heavy")
    return _by_plan(light, keys, stats, "sorted", spread, total).unionByName(
        _by_plan(attach(rows, heavy, keys, found), keys, stats, "ranked", spread)
    )


def _by_plan(
    rows: DataFrame, keys: list[str], stats: list[Stat], plan: str, spread: bool, total: int | None = None
) -> DataFrame:
    if plan == "split":
        return _split(rows, keys, stats, spread)
    if plan == "direct":
        wanted = [f"{s.of_sorted()} as {s.name}" for s in stats]
        wanted += ["sd", "lo", "hi"] if spread else []
        return _gathered(rows, keys, spread).selectExpr(*map(quoted, keys), *wanted)
    wanted = [f"{s.of_ranks()} as {s.name}" for s in stats]
    if plan == "sorted":
        wanted += [*_SORTED_SPREAD] if spread else []
        table = _sorted_table(rows, keys, spread, rows.count() if total is None else total)
    elif plan == "ranked":
        wanted += ["max(sd) as sd", "min(lo) as lo", "max(hi) as hi"] if spread else []
        table = _rank_table(rows, keys, stats, spread)
    else:
        raise ValueError(f"unknown plan {plan!r}")
    return table.groupBy(*map(col, keys)).agg(*map(F.expr, wanted))


def describe(
    df: DataFrame,
    keys: list[str],
    measure: str,
    stats: list[Stat],
    *,
    plan: str,
    spread: bool = False,
    total: int | None = None,
) -> DataFrame:
    """``stats`` of ``measure`` per ``keys``; a null key is a group of its own.

    ``direct`` and ``sorted`` say that every group is proven to fit one task. With another ``plan`` the
    first passes over the data run at once, to find where the ranks lie.
    ``spread`` adds the columns ``sd``, ``lo`` and ``hi``. ``total`` bounds the rows where that is known; ``sorted``
    counts them otherwise.
    """
    rows = _measure_rows(df, keys, measure)
    if not any(s.ranks() for s in stats):
        plain = [f"{s.plain()} as {s.name}" for s in stats]
        return rows.groupBy(*map(col, keys)).agg(*map(F.expr, [*plain, *(_SPREAD if spread else ())]))
    return _by_plan(rows, keys, stats, plan, spread, total)


def settled_average(column: str) -> Column:
    """A mean that is the same in every evaluation, for use as a stored value."""
    return settle(F.avg(column))
