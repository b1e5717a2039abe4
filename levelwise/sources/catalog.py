"""Named variants of a dataset."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.cohort import Cohort
from levelwise.functions.fiscal import CALENDAR_LEVELS
from levelwise.levels import level_counts, level_index

# The names of the two dataset variants.
IMPUTED = "Imputed"
RAW = "Raw"


class DatasetCatalog:
    """Variant name to DataFrame, with one level dictionary per variant.

    A variant is a parquet path, or a function that builds the DataFrame. Any
    name but ``Raw`` means the imputed data. ``stored_levels`` names what
    ``write_levels`` wrote for a variant, which saves counting its labels again.
    """

    def __init__(
        self,
        spark: SparkSession,
        variants: Mapping[str, str | Callable[[], DataFrame]],
        declared_levels: Mapping[str, tuple[str, ...]] = CALENDAR_LEVELS,
        rows: int | None = None,
        stored_levels: Mapping[str, str] | None = None,
    ):
        self._spark = spark
        self._variants = dict(variants)
        self._declared = declared_levels
        self._rows = rows
        self._stored = dict(stored_levels or {})
        self._cohorts: dict[str, Cohort] = {}

    def dataset(self, name: str = IMPUTED) -> Cohort:
        """The unfiltered rows of a variant; also the baseline for comparisons."""
        name = RAW if name == RAW else IMPUTED
        if name not in self._cohorts:
            source = self._variants[name]
            df = source() if callable(source) else self._spark.read.parquet(source)
            declared = {k: v for k, v in self._declared.items() if k in df.columns}
            stored = self._stored.get(name)
            labels = self._spark.read.parquet(stored) if stored else None
            self._cohorts[name] = Cohort.over(df, declared, self._rows, stored=labels)
        return self._cohorts[name]

    def cohort(
        self, name: str = IMPUTED, column: str | None = None, levels: list[str] | None = None
    ) -> Cohort:
        """A variant cut down to some levels of one column.

        Each call starts from the whole dataset: filters replace, never stack.
        """
        return self.dataset(name).keep(column, levels)

    def reset(self) -> Cohort:
        """The imputed dataset, unfiltered."""
        return self.cohort()


def write_dataset(df: DataFrame, path: str, partition_by: str = "Financial_Year") -> None:
    """Store a dataset so that a year filter reads only that year's files.

    Rebalancing gathers a year's rows before writing, merging small partitions
    and splitting one that holds most rows over many tasks.
    """
    df.hint("rebalance", partition_by).write.partitionBy(partition_by).mode("error").parquet(path)


def write_levels(cohort: Cohort, path: str) -> None:
    """Store the level counts of an unfiltered cohort's categorical columns.

    ``level_idx`` is a label's place where the order is not that of the text, else null.
    """
    if cohort.filtered:
        raise ValueError("levels belong to the whole dataset, not to a filtered cohort")
    place = F.lit(None).cast("int")
    for name, levels in cohort.book.ordered().items():
        place = F.when(F.col("dimension") == name, level_index("level", levels)).otherwise(place)
    counted = level_counts(cohort.df, cohort.roles.categorical)
    counted.withColumn("level_idx", place).write.mode("error").parquet(path)
