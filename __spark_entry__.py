
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from levelwise.cohort import Cohort  # noqa: E402
from levelwise.functions.fiscal import CALENDAR_LEVELS, fiscal_columns  # noqa: E402
from levelwise.functions.predicates import nonzero, positive, visible_label  # noqa: E402
from levelwise.functions.ranks import MEAN, MEDIAN, ROWS, TRIMMED  # noqa: E402
from levelwise.functions.rounding import round_half_even, round_measures  # noqa: E402
from levelwise.levels import level_values  # noqa: E402
from levelwise.operators import compare, grid, shapes, tables, trends  # noqa: E402
from levelwise.sources.buckets import write_buckets  # noqa: E402
from levelwise.sources.catalog import DatasetCatalog, write_dataset, write_levels  # noqa: E402
from levelwise.sources.cube import CountCube, with_cube, write_cube  # noqa: E402
from levelwise.sources.manifest import kept_levels, refresh_levels  # noqa: E402
from levelwise.sources.samples import stored_sample, write_sample  # noqa: E402
from levelwise.sources.scratch import scratch_path  # noqa: E402
from levelwise.sources.sketches import (  # noqa: E402
    approximate_quantiles,
    checked_quantiles,
    write_sketches,
)
from levelwise.sources.star import line_catalog, order_catalog  # noqa: E402
from oracle import ORACLE_SQL  # noqa: E402

try:  # the training-data operators can be taken out as a whole
    import corpus_pipeline
    from levelwise.llm import queries as training
except ModuleNotFoundError as absent:
    # Only their own absence: a library that they lack is a fault to be seen.
    if absent.name not in ("corpus_pipeline", "levelwise.llm", "levelwise.llm.queries"):
        raise
    corpus_pipeline = training = None

QUARTER, MONTH, YQ, FY = "Financial_Quarter", "Month", "Year_Quarter", "Financial_Year"
SEGMENT, STATUS, NATION = "Demographic_Segment", "Demographic_Status", "Demographic_Nation"
PRIORITY, REGION = "Demographic_Priority", "Demographic_Region"
SCORE, BALANCE, PRICE = "Num_Score", "Num_Balance", "Num_Price"
FLAG, LINE_PRICE, QUANTITY, TAX = (
    "Demographic_ReturnFlag", "Num_ExtPrice", "Num_Quantity", "Num_Tax",
)
LINE, ORDER = "Demographic_Line", "Demographic_Order"
KEPT_REGIONS = ["ASIA", "EUROPE"]
DENSITY_YEAR = "1998-99"
ROLE_COLUMNS = ["Row_ID", SEGMENT, STATUS, BALANCE, SCORE]

# One catalog per session and folder, so level dictionaries are found once.
_catalogs: dict[tuple[str, str, str], DatasetCatalog] = {}


def _catalog(spark: SparkSession, folder: str, kind: str) -> DatasetCatalog:
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _catalogs:
        build = {"orders": order_catalog, "lines": line_catalog}[kind]
        _catalogs[key] = build(spark, folder)
    return _catalogs[key]


def _raw(spark: SparkSession, folder: str) -> Cohort:
    return _catalog(spark, folder, "orders").dataset("Raw")


def _imputed(spark: SparkSession, folder: str) -> Cohort:
    return _catalog(spark, folder, "orders").dataset("Imputed")


def _kept(spark: SparkSession, folder: str) -> Cohort:
    return _catalog(spark, folder, "orders").cohort("Raw", REGION, KEPT_REGIONS)


def _lines(spark: SparkSession, folder: str) -> Cohort:
    return _catalog(spark, folder, "lines").dataset()


def _numbered_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with numbers for labels: few of one kind, many of the other."""
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(
        *[c.alias(name) for name, c in fiscal_columns("l_shipdate").items()],
        F.col("l_linenumber").alias(LINE),
        F.col("l_orderkey").alias(ORDER),
        F.col("l_quantity").alias(QUANTITY),
        F.col("l_tax").alias(TAX),
    )


def _numbered(spark: SparkSession, folder: str) -> Cohort:
    return Cohort.of(_numbered_rows(spark, folder), CALENDAR_LEVELS)


def _mixed(spark: SparkSession, folder: str) -> Cohort:
    """Order lines with many small groups and one that holds a third of all rows."""
    rows = _numbered_rows(spark, folder)
    order = F.when(F.col(ORDER) % 3 == 0, F.lit(0)).otherwise(F.col(ORDER))
    return Cohort.of(rows.withColumn(ORDER, order), CALENDAR_LEVELS)


def _on(source, build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(source(spark, folder))


def _export_round_trip(cohort: Cohort) -> DataFrame:
    table = tables.summary(cohort, QUARTER, SCORE, SEGMENT)
    path = scratch_path(cohort.df.sparkSession, grid.export_name(SCORE))
    grid.export_csv(table, path)
    return grid.read_export(table, path)


def _export_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Parts sold, with quotes, line breaks, blanks and the text NA in labels; numbered, written and read."""
    name, kind = F.concat(F.lit("part "), "l_partkey"), F.col("l_partkey") % 5
    label = (
        F.when(kind == 0, F.concat(F.lit('say "'), name, F.lit('", twice')))
        .when(kind == 1, F.concat(name, F.lit("\nsecond line")))
        .when(kind == 3, F.lit("NA"))
        .when(kind == 4, F.concat(F.lit("  "), name))
    )
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_partkey")
    table = lines.agg(F.count(F.lit(1)).alias("n")).select("l_partkey", label.alias("label"), "n")
    path = scratch_path(spark, grid.export_name("label"))
    grid.export_csv(table, path, ["l_partkey"], missing="(missing)")
    return grid.read_export(table.select(F.lit(0).cast("long").alias("row"), "*"), path, missing="(missing)")


def _stored_year(cohort: Cohort) -> DataFrame:
    """Store the dataset by year, reopen it by path, and summarise one year."""
    spark = cohort.df.sparkSession
    path, levels = scratch_path(spark, "dataset"), scratch_path(spark, "levels")
    write_dataset(cohort.df, path)
    write_levels(cohort, levels)
    stored = DatasetCatalog(spark, {"Raw": path}, stored_levels={"Raw": levels})
    return tables.summary(stored.cohort("Raw", FY, [DENSITY_YEAR]), MONTH, SCORE, PRIORITY)


CUBE_VIEWS = [[QUARTER, SEGMENT, STATUS, REGION], [QUARTER, SEGMENT, STATUS], [QUARTER, SEGMENT]]
SKETCHED = [FY, QUARTER, SEGMENT, REGION]


def _cube_crosstab(cohort: Cohort) -> DataFrame:
    """A crosstab of a filtered cohort, counted from a stored cube of the whole dataset."""
    spark = cohort.df.sparkSession
    path = scratch_path(spark, "cube")
    write_cube(cohort, path, CUBE_VIEWS)
    stored = with_cube(cohort, CountCube(spark, path))
    return tables.crosstab(stored.keep(REGION, KEPT_REGIONS), QUARTER, SEGMENT, STATUS)


def _sketched_quantiles(cohort: Cohort) -> DataFrame:
    """Quantiles of a filtered cohort from stored sketches, with their ranks checked against the rows."""
    spark = cohort.df.sparkSession
    path = scratch_path(spark, "sketches")
    write_sketches(cohort, path, SKETCHED, [SCORE, PRICE], "positive")
    found = approximate_quantiles(
        spark.read.parquet(path), SKETCHED, SCORE, [QUARTER, SEGMENT], [0.05, 0.5, 0.95], [(REGION, KEPT_REGIONS)]
    )
    kept = cohort.keep(REGION, KEPT_REGIONS)
    return checked_quantiles(found, kept, SCORE, [QUARTER, SEGMENT], "positive")


def _levels_after_change(cohort: Cohort) -> DataFrame:
    """Level counts of a dataset that got more rows and had a third of them written anew."""
    spark = cohort.df.sparkSession
    path, manifest = scratch_path(spark, "growing"), scratch_path(spark, "manifest")
    columns = [SEGMENT, PRIORITY, STATUS]
    rows = cohort.df.select(*columns, (F.col("Row_ID") % 3).cast("int").alias("batch"))

    def write(batch: int, df: DataFrame) -> None:
        some = df.where(F.col("batch") == batch).write.partitionBy("batch")
        some.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        refresh_levels(spark, path, manifest, columns)

    write(0, rows)
    write(1, rows)
    # As many rows as before, with other labels.
    renamed = F.when(F.col(SEGMENT) == "BUILDING", "Houses").otherwise(F.col(SEGMENT))
    write(1, rows.withColumn(SEGMENT, renamed))
    write(2, rows)
    stored = Cohort.over(spark.read.parquet(path), stored=kept_levels(spark, path, manifest))
    return tables.complete_counts(stored, columns)


def _scatter(cohort: Cohort) -> DataFrame:
    return shapes.scatter_sample(cohort, SEGMENT, BALANCE, SCORE, key="Row_ID")


def _stored_scatter(cohort: Cohort) -> DataFrame:
    """The same sample, read from rows stored by year."""
    spark = cohort.df.sparkSession
    path = scratch_path(spark, "sample")
    write_sample(cohort, path, "Row_ID", [FY], depth=500)
    return stored_sample(cohort, spark.read.parquet(path), SEGMENT, BALANCE, SCORE, "Row_ID")


def _page_of_rows(cohort: Cohort) -> DataFrame:
    """A late page of all rows, best scores first, from a result stored in that order."""
    spark = cohort.df.sparkSession
    path = scratch_path(spark, "pages")
    order = [F.col(SCORE).desc_nulls_last(), "Row_ID"]
    grid.write_pages(cohort.df.select(*ROLE_COLUMNS), path, order, 5000)
    return grid.stored_page(spark, path, page=37, size=40, chunk_rows=5000)


def _imputed_rows(spark: SparkSession, folder: str) -> DataFrame:
    variants = {"Raw": _raw(spark, folder).df, "Imputed": _imputed(spark, folder).df}
    measures = [PRICE, BALANCE, SCORE]
    slim = {name: df.select("Row_ID", *measures) for name, df in variants.items()}
    stored = write_buckets(spark, slim, "Row_ID", 16)
    return compare.imputation_rows(stored["Raw"], stored["Imputed"], "Row_ID", measures)


def _trend_lines(cohort: Cohort) -> DataFrame:
    fit = shapes.linear_trend(_scatter(cohort), SEGMENT, BALANCE, SCORE)
    return fit.select(
        *[
            round_half_even(F.col(c), 6).alias(c) if c not in (SEGMENT, "n") else F.col(c)
            for c in fit.columns
        ]
    )


def _bandwidths(cohort: Cohort) -> DataFrame:
    rows = shapes.density_rows(cohort, STATUS, SCORE, DENSITY_YEAR)
    widths = shapes.density_bandwidth(cohort, rows, STATUS, SCORE)
    return round_measures(widths.select(STATUS, "n", "sd", "q25", "q75", "h"), 4)


def _curve(cohort: Cohort, group: str, measure: str, method: str = "auto") -> DataFrame:
    curve = shapes.density_curve(cohort, group, measure, DENSITY_YEAR, method=method)
    # Raw densities are tiny; per million they compare well after rounding.
    per_million = round_half_even(F.col("density") * 1e6, 4).alias("density_e6")
    return curve.select(group, "point", round_half_even(F.col("x"), 4).alias("x"), per_million)


def _percent_long(cohort: Cohort) -> DataFrame:
    wide = tables.crosstab(cohort, QUARTER, SEGMENT)
    values = [c for c in wide.columns if c.endswith("_percent")]
    return trends.melt(wide.select(QUARTER, *values), [QUARTER], values)


def _fiscal(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    dims = [c.alias(name) for name, c in fiscal_columns("o_orderdate").items()]
    return orders.select("o_orderkey", "o_orderdate", *dims)


def _levels(cohort: Cohort) -> DataFrame:
    return level_values(cohort.df, cohort.roles.filterable, CALENDAR_LEVELS)


def _years(cohort: Cohort) -> DataFrame:
    recoded = tables.recode_year(cohort)
    return recoded.df.groupBy("Year", FY).agg(F.count(F.lit(1)).alias("n"))


def entry(spark: SparkSession) -> DataFrame:
    """Summary statistics by quarter and segment on the smallest tables."""
    return tables.summary(_raw(spark, "/root/testdata/sf0.001"), QUARTER, SCORE, SEGMENT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {"pipeline": corpus_pipeline.run, **training.queries()} if training else {}
    return _cohort_queries() | more


def _cohort_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # Datasets and roles
        "load_dataset": _on(_imputed, lambda c: round_measures(c.df)),
        "load_dataset_raw": _on(_raw, lambda c: c.df),
        "cohort_filter": _on(_kept, lambda c: c.df),
        "export_csv": _on(_raw, _export_round_trip),
        "dataset_by_year": _on(_raw, _stored_year),
        "catalog_roles": _on(_raw, compare.catalog_roles),
        "level_values": _on(_raw, _levels),
        "levels_after_change": _on(_raw, _levels_after_change),
        "level_values_numeric": _on(_numbered_rows, lambda df: level_values(df, [LINE, ORDER])),
        "export_csv_rows": _export_rows,
        "summary_many_labels": _on(
            _numbered, lambda c: tables.summary(c, FY, QUANTITY, ORDER)
        ),
        "summary_mixed_groups": _on(
            _mixed,
            lambda c: tables.measure_stats(
                c, [ORDER], QUANTITY, [MEAN, MEDIAN, TRIMMED, ROWS], "nonzero", method="split"
            ),
        ),
        "year_recode": _on(_raw, _years),
        "fiscal_dims": _fiscal,
        # Filters
        "filter_nonzero": _on(
            _raw, lambda c: c.df.where(nonzero(BALANCE) & nonzero(SCORE)).select(*ROLE_COLUMNS)
        ),
        "filter_positive": _on(
            _raw, lambda c: c.df.where(positive(BALANCE) & positive(SCORE)).select(*ROLE_COLUMNS)
        ),
        "filter_labels": _on(
            _raw, lambda c: c.df.where(visible_label(SEGMENT)).select(*ROLE_COLUMNS)
        ),
        "filter_labels_strict": _on(
            _raw,
            lambda c: c.df.where(visible_label(SEGMENT, True) & visible_label(NATION, True)).select(
                *ROLE_COLUMNS, NATION
            ),
        ),
        "scatter_complete": _on(
            _raw, lambda c: shapes.scatter_rows(c, SEGMENT, BALANCE, SCORE, "Row_ID")
        ),
        # Counts and crosstabs
        "freq_table": _on(_raw, lambda c: tables.freq_table(c, QUARTER, SEGMENT)),
        "freq_table_filtered": _on(_kept, lambda c: tables.freq_table(c, MONTH, REGION)),
        "reliability_band": _on(
            _raw, lambda c: grid.with_bands(tables.freq_table(c, MONTH, SEGMENT))
        ),
        "reliability_band_crosstab": _on(
            _raw, lambda c: grid.with_bands(tables.crosstab(c, MONTH, STATUS))
        ),
        "group_count_1": _on(_raw, lambda c: tables.group_count(c, [QUARTER])),
        "group_count_2": _on(_raw, lambda c: tables.group_count(c, [QUARTER, SEGMENT])),
        "group_count_3": _on(_raw, lambda c: tables.group_count(c, [QUARTER, SEGMENT, STATUS])),
        "complete_grid": _on(_kept, lambda c: tables.complete_counts(c, [YQ, SEGMENT, REGION])),
        "row_percent_long": _on(_raw, lambda c: tables.row_percent(c, QUARTER, SEGMENT)),
        "pivot_counts": _on(_raw, lambda c: tables.pivot_counts(c, [QUARTER], SEGMENT)),
        "crosstab_1": _on(_raw, lambda c: tables.crosstab(c, QUARTER, SEGMENT)),
        "crosstab_1_filtered": _on(_kept, lambda c: tables.crosstab(c, "DOTW", REGION)),
        "crosstab_1_r_names": _on(
            _raw, lambda c: tables.crosstab(c, FY, PRIORITY, r_names=True)
        ),
        "crosstab_2": _on(_raw, lambda c: tables.crosstab(c, QUARTER, SEGMENT, STATUS)),
        "crosstab_2_cube": _on(_raw, _cube_crosstab),
        # Summaries
        "quantiles_sketched": _on(_raw, _sketched_quantiles),
        "summary_1": _on(_raw, lambda c: tables.summary(c, MONTH, SCORE)),
        "summary_2": _on(_raw, lambda c: tables.summary(c, QUARTER, SCORE, SEGMENT)),
        "summary_signed": _on(
            _raw, lambda c: tables.summary(c, QUARTER, BALANCE, SEGMENT, signed=True)
        ),
        "summary_imputed": _on(_imputed, lambda c: tables.summary(c, FY, SCORE, PRIORITY)),
        "summary_ranked": _on(
            _raw, lambda c: tables.summary(c, QUARTER, SCORE, SEGMENT, method="ranked")
        ),
        "summary_lines": _on(_lines, lambda c: tables.summary(c, MONTH, QUANTITY, FLAG)),
        "summary_lines_ranked": _on(
            _lines, lambda c: tables.summary(c, FY, LINE_PRICE, FLAG, method="ranked")
        ),
        "median_strict": _on(
            _raw, lambda c: tables.measure_stats(c, [QUARTER, SEGMENT], SCORE, [MEDIAN, ROWS])
        ),
        "trimmed_mean": _on(
            _lines, lambda c: tables.measure_stats(c, [QUARTER, FLAG], LINE_PRICE, [TRIMMED, ROWS])
        ),
        "trimmed_mean_bucketed": _on(
            _lines,
            lambda c: tables.measure_stats(
                c, [QUARTER, FLAG], LINE_PRICE, [TRIMMED, ROWS], method="ranked"
            ),
        ),
        "quantile_band": _on(
            _raw, lambda c: round_measures(shapes.quantile_band(c, SEGMENT, SCORE))
        ),
        "quantile_band_ranked": _on(
            _raw,
            lambda c: round_measures(shapes.quantile_band(c, SEGMENT, SCORE, method="ranked")),
        ),
        "ordered_summary": _on(
            _raw,
            lambda c: tables.in_level_order(
                tables.summary(c, MONTH, BALANCE, SEGMENT), c, [MONTH, SEGMENT]
            ),
        ),
        # Trends, bars, areas
        "trend_1": _on(_raw, lambda c: trends.trend(c, MONTH, SCORE)),
        "trend_filtered_vs_all": lambda spark, folder: trends.trend(
            _kept(spark, folder), QUARTER, SCORE, _raw(spark, folder), compare=True
        ),
        "trend_filtered_vs_all_ranked": lambda spark, folder: trends.trend(
            _kept(spark, folder), MONTH, BALANCE, _raw(spark, folder), True, method="ranked"
        ),
        "trend_groups_overall": _on(
            _raw, lambda c: trends.trend_by_group(c, QUARTER, SEGMENT, SCORE)
        ),
        "trend_groups_overall_numeric": _on(
            _numbered, lambda c: trends.trend_by_group(c, MONTH, LINE, TAX)
        ),
        "stacked_share": _on(
            _raw,
            lambda c: trends.stack(
                trends.share_area(c, SEGMENT, fill=True), c, "Time", "Condition", "Percentage", SEGMENT
            ),
        ),
        "trend_groups_overall_ranked": _on(
            _lines, lambda c: trends.trend_by_group(c, MONTH, FLAG, TAX, method="ranked")
        ),
        "grouping_sets_median": _on(
            _raw, lambda c: trends.grouping_medians(c, QUARTER, SEGMENT, SCORE)
        ),
        "latest_bar_1": _on(_raw, lambda c: trends.latest_bar(c, QUARTER, [SEGMENT], SCORE)),
        "latest_bar_2": _on(
            _raw, lambda c: trends.latest_bar(c, MONTH, [SEGMENT, STATUS], SCORE)
        ),
        "area_mean": _on(_raw, lambda c: trends.area_mean(c, SEGMENT, SCORE)),
        "area_mean_positive": _on(
            _raw, lambda c: trends.area_mean(c, SEGMENT, SCORE, measure_rule="positive")
        ),
        "share_area": _on(_raw, lambda c: trends.share_area(c, SEGMENT)),
        "share_area_filled": _on(_raw, lambda c: trends.share_area(c, SEGMENT, fill=True)),
        "share_area_hidden": _on(_raw, lambda c: trends.share_area(c, NATION)),
        "share_area_year": _on(
            _raw, lambda c: trends.share_area(tables.recode_year(c), SEGMENT, "Year")
        ),
        "share_area_r_names": _on(
            _raw, lambda c: trends.share_area(c, PRIORITY, strict_labels=True, r_names=True)
        ),
        "unpivot_share": _on(_raw, _percent_long),
        "stacked_layout": _on(
            _raw, lambda c: trends.stack(trends.area_mean(c, SEGMENT, PRICE), c, YQ, SEGMENT)
        ),
        "stacked_bars": _on(
            _raw,
            lambda c: trends.stack(
                trends.latest_bar(c, QUARTER, [SEGMENT, STATUS], SCORE), c, SEGMENT, STATUS
            ),
        ),
        # Scatter and density
        "scatter_sample": _on(_raw, _scatter),
        "scatter_sample_stored": _on(_raw, _stored_scatter),
        "linear_trend": _on(_raw, _trend_lines),
        "density_trim": _on(_raw, lambda c: shapes.density_rows(c, SEGMENT, SCORE, DENSITY_YEAR)),
        "density_bandwidth": _on(_raw, _bandwidths),
        "density_curve": _on(_raw, lambda c: _curve(c, STATUS, SCORE)),
        "density_curve_lines_ranked": _on(
            _lines, lambda c: _curve(c, FLAG, LINE_PRICE, method="ranked")
        ),
        # Result tables
        "grid_filter": _on(
            _raw,
            lambda c: grid.grid_filter(
                tables.summary(c, MONTH, SCORE, SEGMENT),
                {"n": (100, None), SEGMENT: ["BUILDING", "MACHINERY", "Other"], MONTH: "a"},
            ),
        ),
        "grid_search": _on(
            _raw, lambda c: grid.grid_search(tables.summary(c, QUARTER, SCORE, SEGMENT), "build")
        ),
        "grid_page": _on(
            _raw,
            lambda c: grid.grid_page(
                tables.summary(c, QUARTER, SCORE, SEGMENT),
                [QUARTER, F.col(SEGMENT).asc_nulls_last()],
                page=2,
                size=10,
            ),
        ),
        "grid_page_stored": _on(_raw, _page_of_rows),
        "top_k": _on(
            _raw,
            lambda c: grid.top_k(
                tables.group_count(c, [YQ, SEGMENT]), "n", 10, YQ, SEGMENT
            ),
        ),
        # Imputed against raw
        "imputation_compare": _on(_imputed, lambda c: compare.imputation_compare(None, c)),
        "imputation_rows": _imputed_rows,
        "imputation_compare_by_group": lambda spark, folder: compare.imputation_compare(
            _raw(spark, folder), _imputed(spark, folder), [SCORE], PRIORITY
        ),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL) | (training.oracle_sql() if training else {})
