"""How an imputed dataset differs from its raw version; what columns it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelwise.cohort import Cohort, joint_plan
from levelwise.functions.ranks import MEAN, ROWS, Stat, describe
from levelwise.functions.rounding import col, quoted, round_measures

_STATS = [ROWS, Stat("valid", "valid"), MEAN, Stat("median", "median")]


def _both_long(imputed: Cohort, measures: list[str], keys: list[str]) -> DataFrame:
    """Both variants of every measure from one pass over the imputed rows and what they were."""
    pairs = [
        F.struct(F.lit(variant).alias("variant"), F.lit(m).alias("measure"), col(c).cast("double").alias("value"))
        for m in measures
        for variant, c in (("raw", imputed.originals.get(m, m)), ("imputed", m))
    ]
    return imputed.base.where(imputed.kept).select(*map(col, keys), F.inline(F.array(*pairs)))


def _long(cohort: Cohort, variant: str, measures: list[str], keys: list[str]) -> DataFrame:
    pairs = [
        F.struct(F.lit(m).alias("measure"), col(m).cast("double").alias("value"))
        for m in measures
    ]
    return cohort.df.select(F.lit(variant).alias("variant"), *map(col, keys), F.inline(F.array(*pairs)))


def imputation_compare(
    raw: Cohort | None,
    imputed: Cohort,
    measures: list[str] | None = None,
    group: str | None = None,
    method: str = "auto",
) -> DataFrame:
    """Per measure (and group): rows, gaps, mean and median in both, and changes.

    Without ``raw`` the raw values are those that the imputed dataset carries along (columns named
    ``_raw_`` and the measure), and both variants come from one pass.
    """
    measures = list(measures or imputed.roles.measures)
    keys = [] if group is None else [imputed.roles.require(group, "group")]
    if raw is None:
        if not imputed.originals:
            raise ValueError("the imputed dataset carries no raw values")
        both, plan = _both_long(imputed, measures, keys), imputed.plan(keys, method)
    else:
        both = _long(raw, "raw", measures, keys).unionByName(_long(imputed, "imputed", measures, keys))
        plan = joint_plan([raw, imputed], keys, method)
    stats = describe(both, ["measure", *keys, "variant"], "value", _STATS, plan=plan)

    def of(variant: str, column: str):
        return F.max(F.when(F.col("variant") == variant, F.col(column)))

    sides = []
    for v in ("raw", "imputed"):
        gaps = of(v, "n") - of(v, "valid")
        sides += [
            of(v, "n").alias(f"{v}_rows"),
            gaps.alias(f"{v}_nulls"),
            F.try_divide(100 * gaps, of(v, "n")).alias(f"{v}_null_percent"),
            of(v, "mean").alias(f"{v}_mean"),
            of(v, "median").alias(f"{v}_median"),
        ]
    table = stats.groupBy("measure", *map(col, keys)).agg(*sides)
    for s in ("mean", "median"):
        change = F.col(f"imputed_{s}") - F.col(f"raw_{s}")
        table = table.withColumn(f"{s}_change", change)
    return round_measures(table)


def imputation_rows(
    raw: DataFrame, imputed: DataFrame, key: str, measures: list[str]
) -> DataFrame:
    """Per measure what the imputation did row by row, and how filled values lie against observed ones.

    ``n`` rows in both variants, ``raw_only`` and ``imputed_only`` rows of one; ``filled`` had no value before,
    ``missing`` have none still, ``changed`` had another. Mean and spread of the filled and of the observed values.
    Variants from ``sources.buckets`` join without a shuffle.
    """
    sides = []
    for name, df in (("r", raw), ("i", imputed)):
        values = [
            F.nanvl(col(m).cast("double"), F.lit(None).cast("double")).alias(f"{name}{j}")
            for j, m in enumerate(measures)
        ]
        sides.append(df.select(col(key).alias(f"{name}_key"), *values))
    joined = sides[0].join(sides[1], F.col("r_key") == F.col("i_key"), "full")
    pairs = [
        F.struct(F.lit(m).alias("measure"), F.col(f"r{j}").alias("r"), F.col(f"i{j}").alias("i"))
        for j, m in enumerate(measures)
    ]
    both, filled = "r_key is not null and i_key is not null", "r is null and i is not null"
    table = joined.select("r_key", "i_key", F.inline(F.array(*pairs))).groupBy("measure")
    found = table.agg(
        *[
            F.expr(f"count_if({condition}) as {name}")
            for name, condition in (
                ("n", both),
                ("raw_only", "i_key is null"),
                ("imputed_only", "r_key is null"),
                ("filled", f"{both} and {filled}"),
                ("missing", f"{both} and i is null"),
                ("changed", f"{both} and r <> i"),
            )
        ],
        *[
            F.expr(f"{f}(if({both} and {condition}, i, null)) as {name}_{short}")
            for name, condition in (("filled", filled), ("observed", "r is not null"))
            for short, f in (("mean", "avg"), ("sd", "stddev_samp"))
        ],
    )
    return round_measures(found)


def catalog_roles(cohort: Cohort) -> DataFrame:
    """A row per role column: its position, uses, and how many rows have a value."""
    roles = cohort.roles
    listed = [
        (c, role, i, len(columns) - i + 1)
        for role, columns in (
            ("time", roles.times),
            ("group", roles.groups),
            ("measure", roles.measures),
        )
        for i, c in enumerate(columns, start=1)
    ]
    filled = cohort.df.selectExpr(*[f"count({quoted(c)}) as {quoted(c)}" for c, *_ in listed])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(role).alias("role"),
            F.lit(i).alias("ordinal"),
            F.lit(back).alias("reverse_ordinal"),
            F.lit(role == "group" and c in roles.area_groups).alias("in_area"),
            F.lit(c in roles.filterable).alias("filterable"),
            col(c).alias("filled_rows"),
        )
        for c, role, i, back in listed
    ]
    return filled.select(F.inline(F.array(*rows)))
