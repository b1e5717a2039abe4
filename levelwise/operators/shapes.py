"""Scatter samples with trend lines, and kernel density curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.cohort import Cohort
from levelwise.functions.predicates import apply_measure_rule, complete_cases
from levelwise.functions.ranks import Stat, describe
from levelwise.functions.rounding import col
from levelwise.operators.tables import _zero_rule
from levelwise.plans.bounds import attach, fits_one_task
from levelwise.sources.scratch import checkpointed

# Sample size, trimming quantiles and density grid.
SAMPLE_ROWS = 1000
BAND = (0.05, 0.95)
MESH = 512
REACH = 4


def scatter_rows(cohort: Cohort, group: str, x: str, y: str, *extra: str) -> DataFrame:
    """Rows with group, x and y all present."""
    return complete_cases(
        cohort.df.select(*map(col, dict.fromkeys([*extra, group, x, y]))), [group, x, y]
    )


def draw_of(key: str, seed: int) -> Column:
    """A row's draw: a hash of seed and key, the key as text."""
    text = F.coalesce(col(key).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def scatter_sample(
    cohort: Cohort,
    group: str,
    x: str,
    y: str,
    key: str | None = None,
    seed: int = 42,
    size: int = SAMPLE_ROWS,
) -> DataFrame:
    """Exactly ``size`` random rows with group, x and y present, or all if fewer.

    The rows with the smallest draws are taken. With a unique ``key`` the draw is
    a hash of seed and key, so the sample depends on the rows alone and not on
    how they are laid out. A null key draws as an empty one.
    """
    cohort.roles.require(group, "group")
    keys = [key] if key is not None else []
    draw = draw_of(key, seed) if key else F.rand(seed)
    rows = scatter_rows(cohort, group, x, y, *keys).withColumn("_draw", draw)
    if not fits_one_task(cohort.book.rows):
        rows = _low_draws(rows, size, hashed=key is not None)
    return rows.orderBy("_draw", *map(col, keys)).limit(size).drop("_draw")


def _low_draws(rows: DataFrame, size: int, hashed: bool) -> DataFrame:
    """Rows that certainly include those with the ``size`` smallest draws.

    Taking the smallest of many tasks would send ``size`` rows from each to one
    place. Draws are uniform, so a limit ten standard deviations above the
    wanted share leaves little more than ``size`` rows over all tasks. Should it
    ever leave fewer, every row stays a candidate.
    """
    count = rows.count()
    share = (size + 10 * math.sqrt(size) + 10) / max(count, 1)
    if share >= 1:
        return rows
    # The first 13 hexadecimal digits of a hash are a number below 2**52.
    limit = f"{int(share * 16**13):013x}" if hashed else share
    low = checkpointed(rows.where(F.col("_draw") < F.lit(limit)))
    return low if low.count() >= size else rows


def linear_trend(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x per group, with its ends over the group's x."""
    fit = points.groupBy(col(group)).agg(
        F.regr_slope(col(y), col(x)).alias("slope"),
        F.regr_intercept(col(y), col(x)).alias("intercept"),
        F.regr_count(col(y), col(x)).alias("n"),
        F.min(col(x)).alias("x_min"),
        F.max(col(x)).alias("x_max"),
    )
    for end in ("min", "max"):
        at_end = F.col("intercept") + F.col("slope") * F.col(f"x_{end}")
        fit = fit.withColumn(f"fit_{end}", at_end)
    return fit


def _year_rows(
    cohort: Cohort, group: str, measure: str, year: str | None, signed: bool | None
) -> DataFrame:
    rows = cohort.df if year is None else cohort.df.where(F.col("Financial_Year") == year)
    rows = rows.select("Financial_Year", col(group), col(measure)).where(
        col(group).isNotNull() | col(measure).isNotNull()
    )
    return apply_measure_rule(rows, measure, _zero_rule(measure, signed, "positive"))


def quantile_band(
    cohort: Cohort,
    group: str,
    measure: str,
    year: str | None = None,
    signed: bool | None = None,
    method: str = "auto",
) -> DataFrame:
    """5% and 95% quantile of the measure in a year, or in every year."""
    return _band(cohort, _year_rows(cohort, group, measure, year, signed), measure, method)


def _band(cohort: Cohort, rows: DataFrame, measure: str, method: str) -> DataFrame:
    keys = ["Financial_Year"]
    plan = cohort.plan(keys, method)
    stats = [Stat("quantile", "p05", BAND[0]), Stat("quantile", "p95", BAND[1])]
    return describe(rows, keys, measure, stats, plan=plan)


def density_rows(
    cohort: Cohort,
    group: str,
    measure: str,
    year: str,
    signed: bool | None = None,
    method: str = "auto",
) -> DataFrame:
    """A year's rows whose measure lies between its overall 5% and 95% quantile."""
    return _within_band(cohort, _year_rows(cohort, group, measure, year, signed), group, measure, method)


def _within_band(
    cohort: Cohort, rows: DataFrame, group: str, measure: str, method: str
) -> DataFrame:
    cohort.roles.require(group, "group")
    cohort.roles.require(measure, "measure")
    band = _band(cohort, rows, measure, method).first()
    if band is None:
        return rows.where(F.lit(False))
    return rows.where(col(measure).between(band["p05"], band["p95"]))


def density_bandwidth(
    cohort: Cohort, rows: DataFrame, group: str, measure: str, method: str = "auto"
) -> DataFrame:
    """Rule-of-thumb bandwidth per group; null for a group of a single row."""
    stats = [Stat("valid", "n"), Stat("quantile", "q25", 0.25), Stat("quantile", "q75", 0.75)]
    plan = cohort.plan([group], method)
    both = describe(rows, [group], measure, stats, plan=plan, spread=True)
    narrow = F.least(F.col("sd"), (F.col("q75") - F.col("q25")) / 1.34)
    # A group without spread falls back to its value, then to one.
    scale = F.coalesce(
        F.nullif(narrow, F.lit(0.0)),
        F.nullif(F.col("sd"), F.lit(0.0)),
        F.nullif(F.abs("lo"), F.lit(0.0)),
        F.lit(1.0),
    )
    h = 0.9 * scale * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return both.withColumn("h", F.when(F.col("n") >= 2, h))


def density_curve(
    cohort: Cohort,
    group: str,
    measure: str,
    year: str,
    signed: bool | None = None,
    method: str = "auto",
) -> DataFrame:
    """Gaussian kernel density of the measure per group, on 512 points.

    Points span the overall range of the trimmed values; a group of one row has
    no curve. Each value is shared between its two neighbouring mesh points,
    which aggregates the data to at most 512 weights per group; kernel sums and
    the final interpolation work on those weights only.
    """
    whole = _year_rows(cohort, group, measure, year, signed)
    one_pass = ("direct", "sorted")
    if not all(cohort.plan([k], method) in one_pass for k in ("Financial_Year", group)):
        # Ranks take several passes; the cohort, which may be a join, is read in one.
        whole = checkpointed(whole)
    rows = _within_band(cohort, whole, group, measure, method)
    widths = checkpointed(density_bandwidth(cohort, rows, group, measure, method))
    lo, hi, groups = widths.agg(F.min("lo"), F.max("hi"), F.count(F.lit(1))).first()
    lo, hi, last = F.lit(lo), F.lit(hi), F.lit(MESH - 1)
    reach = REACH * F.col("h")
    mesh = widths.where(F.col("h").isNotNull()).select(
        col(group), "n", "h", (lo - reach).alias("start"), ((hi - lo + 2 * reach) / last).alias("step")
    )
    placed = attach(rows, mesh, [group], groups)
    at = (col(measure) - F.col("start")) / F.col("step")
    weights = (
        placed.withColumn("_at", at)
        .groupBy(col(group), F.floor("_at").cast("int").alias("i"), "n", "h", "start", "step")
        .agg(
            F.sum(1 - (F.col("_at") - F.floor("_at"))).alias("left"),
            F.sum(F.col("_at") - F.floor("_at")).alias("right"),
        )
    )
    # At most MESH weights per group, whatever the number of rows.
    curves = weights.groupBy(col(group), "n", "h", "start", "step").agg(
        F.sort_array(F.collect_list(F.struct("i", "left", "right"))).alias("weights")
    )
    # Summed before the points are listed, so once per group and mesh point.
    kernel = (
        f"transform(sequence(0, {MESH}), d -> exp(-0.5D * (d * step / h) * (d * step / h))"
        f" / (n * h * {math.sqrt(2 * math.pi)!r}D)) as kernel"
    )
    near = "w.left * get(kernel, abs(j - w.i)) + w.right * get(kernel, abs(j - w.i - 1))"
    summed = curves.selectExpr("*", kernel).select(
        col(group),
        "start",
        "step",
        F.expr(
            f"transform(sequence(0, {MESH - 1}), j ->"
            f" aggregate(weights, 0D, (acc, w) -> acc + {near})) as mesh"
        ),
    )
    points = summed.withColumn("point", F.explode(F.sequence(F.lit(0), last)))
    x = lo + F.col("point") * (hi - lo) / last
    at = (F.col("x") - F.col("start")) / F.col("step")
    below = F.get("mesh", F.floor("_at").cast("int"))
    above = F.coalesce(F.get("mesh", F.floor("_at").cast("int") + 1), F.lit(0.0))
    density = below + (F.col("_at") - F.floor("_at")) * (above - below)
    return (
        points.withColumn("x", x)
        .withColumn("_at", at)
        .select(col(group), "point", "x", density.alias("density"))
    )
