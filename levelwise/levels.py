"""Level dictionaries: the ordered labels of categorical columns.

Zero cells, crosstab columns and "the latest period" all depend on the labels a
column *can* have, not on those left after a filter. A ``LevelBook`` therefore
belongs to the unfiltered dataset and is handed to every cohort cut from it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from levelwise.functions.numbering import numbered
from levelwise.functions.rounding import col
from levelwise.plans.bounds import attach, fits_one_task
from levelwise.sources.scratch import checkpointed

# A column with more labels than this is an id, not a category.
MAX_LEVELS = 10_000
# A grid of more cells is a mistake in the choice of columns.
MAX_CELLS = 10_000_000


def numeric_columns(df: DataFrame, columns: Iterable[str]) -> frozenset[str]:
    """Those of ``columns`` whose labels are numbers and go in the order of numbers."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return frozenset(c for c in columns if isinstance(kinds.get(c), NumericType))


def as_labels(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` with ``columns`` as text; those that are text already are left alone."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    other = [c for c in columns if not isinstance(kinds[c], StringType)]
    return df.withColumns({c: col(c).cast("string") for c in other}) if other else df


def _number_key(label: str) -> tuple[float, int, str]:
    """Order of a number's text; whole numbers past a double's precision go by their digits."""
    return float(label), len(label), label


def level_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(dimension, level, n) for all ``columns`` from a single pass."""
    pairs = [
        F.struct(F.lit(c).alias("dimension"), col(c).cast("string").alias("level"))
        for c in columns
    ]
    return (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("dimension", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def level_index(column: str | Column, levels: Iterable[str]) -> Column:
    """One-based position of a label in its level order; null when unknown."""
    label = col(column) if isinstance(column, str) else column
    known = F.array(*[F.lit(v) for v in levels]).cast("array<string>")
    return F.nullif(F.array_position(known, label), F.lit(0)).cast("int")


class LevelBook:
    """Levels and their row counts, found once per dataset and kept.

    Labels with a natural order are declared; the rest are found by a counting
    job over the columns asked for, or read from ``stored``, the result of an
    earlier ``level_counts``, and ordered as text, or as numbers in ``numeric`` columns. An
    order that was stored with them goes before both. Stored levels whose counts do not
    sum to the dataset's rows are out of date, and its labels are counted anew.
    """

    def __init__(
        self,
        base: DataFrame,
        declared: Mapping[str, Iterable[str]] | None = None,
        rows: int | None = None,
        max_levels: int = MAX_LEVELS,
        stored: DataFrame | None = None,
        numeric: Iterable[str] = (),
    ):
        self._base = base
        self._declared = {k: tuple(v) for k, v in (declared or {}).items()}
        self._counts: dict[str, dict[str | None, int]] = {}
        self._rows = rows
        self._max = max_levels
        self._wide: set[str] = set()
        self._stored = stored
        self._numeric = frozenset(numeric)
        self._places: dict[str, dict[str, int]] = {}

    def load(self, *columns: str) -> None:
        """Count the labels of ``columns`` that are not known yet, in one job."""
        self._find(columns)
        for column in columns:
            if column in self._wide:
                raise ValueError(f"{column} has more than {self._max} levels")

    def _find(self, columns: Iterable[str]) -> None:
        """Like ``load``, but a column past the limit is only marked as such."""
        missing = [c for c in columns if c not in self._counts and c not in self._wide]
        if not missing:
            return
        if self._stored is not None and self._stale(missing):
            self._stored = None
        if self._stored is None:
            beyond = self._past_limit(missing)
            self._wide |= beyond
            missing = [c for c in missing if c not in beyond]
            if not missing:
                return
            labels = level_counts(self._base, missing)
        else:
            labels = self._stored.where(F.col("dimension").isin(*missing))
        # One label past the limit per column is enough to see the limit broken.
        found = labels.limit(len(missing) * (self._max + 2)).collect()
        counts: dict[str, dict[str | None, int]] = {c: {} for c in missing}
        for row in found:
            counts[row.dimension][row.level] = row.n
            if "level_idx" in found[0] and row.level_idx is not None:
                self._places.setdefault(row.dimension, {})[row.level] = row.level_idx
        wide = {c for c, seen in counts.items() if len(seen) > self._max + 1}
        self._wide |= wide
        if len(found) < len(missing) * (self._max + 2):
            self._counts.update({c: seen for c, seen in counts.items() if c not in wide})
        else:
            # What was fetched may be all of one column, so the others are counted anew.
            for column in missing if wide else ():
                self._find([column])
            if not wide:
                self._counts.update(counts)

    def _past_limit(self, columns: list[str]) -> set[str]:
        """Columns of a large dataset that have far more labels than the dictionary may hold.

        An estimate needs a few kilobytes a column, whereas counting labels holds all of a task's. Four times the
        limit is far beyond the estimate's error; columns below that are counted.
        """
        if fits_one_task(self.rows):
            return set()
        seen = self._base.agg(*[F.approx_count_distinct(col(c)) for c in columns]).first()
        return {c for c, n in zip(columns, seen) if n > 4 * self._max}

    def _stale(self, columns: Iterable[str]) -> bool:
        """Whether stored counts of ``columns`` do not sum to the rows the dataset has now.

        Rows are added or taken away after levels are stored; the row count of plain
        parquet is in its footers, so this reads no data.
        """
        kept = self._stored.where(F.col("dimension").isin(*columns))
        sums = kept.groupBy("dimension").agg(F.sum("n").alias("n")).collect()
        return {r.dimension: r.n for r in sums} != dict.fromkeys(columns, self.rows)

    def levels(self, column: str) -> tuple[str, ...]:
        if column in self._declared:
            return self._declared[column]
        self.load(column)
        labels = [v for v in self._counts[column] if v is not None]
        if column in self._places:
            return tuple(sorted(labels, key=lambda v: self._places[column].get(v, len(labels) + 1)))
        return tuple(sorted(labels, key=_number_key if column in self._numeric else None))

    def ordered(self) -> dict[str, tuple[str, ...]]:
        """Levels whose order is not that of their text, of columns within the limit."""
        self._find(self._numeric)
        counted = self._numeric - self._wide
        return {c: self.levels(c) for c in (*self._declared, *sorted(counted - set(self._declared)))}

    def last(self, column: str) -> str:
        return self.levels(column)[-1]

    def has_null(self, column: str) -> bool:
        self.load(column)
        return None in self._counts[column]

    @property
    def rows(self) -> int:
        """Rows of the unfiltered dataset (a footer read on plain parquet)."""
        if self._rows is None:
            self._rows = self._base.count()
        return self._rows

    def largest_group(self, keys: Iterable[str]) -> int:
        """Bound on the rows of one ``keys`` group, for any cohort cut from here.

        A column with too many labels for the dictionary proves nothing.
        """
        keys = list(keys)
        self._find(keys)
        known = [self._counts[k] for k in keys if k not in self._wide]
        return min([self.rows, *(max(c.values(), default=0) for c in known)])

    def few_groups(self, keys: Iterable[str], most: int) -> bool:
        """Whether ``keys`` have at most ``most`` groups, as far as the dictionary can prove it."""
        keys = list(keys)
        self._find(keys)
        if any(k in self._wide for k in keys):
            return False
        total = 1
        for k in keys:
            total *= len(self._counts[k])
        return total <= most

    def group_bound(self, keys: Iterable[str]) -> int:
        """Bound on the number of ``keys`` groups, null groups included."""
        total = 1
        for k in keys:
            total *= len(self.levels(k)) + 1
        return total


def level_grid(spark: SparkSession, levels: Mapping[str, Iterable[str | None]]) -> DataFrame:
    """Every combination of the given labels, one row each.

    Row numbers are split into label positions, so the grid is generated in
    parallel from a range and joins nothing. More than ``MAX_CELLS`` are refused.
    """
    choices = {c: list(v) for c, v in levels.items()}
    size = 1
    for v in choices.values():
        size *= len(v)
    if size > MAX_CELLS:
        raise ValueError(f"the levels of {list(choices)} make {size} cells, more than {MAX_CELLS}")
    parts = max(1, min(size // 50_000, 4_096))
    grid, stride, columns = spark.range(0, size, 1, parts), size, []
    for name, labels in choices.items():
        stride //= max(1, len(labels))
        position = F.floor(F.col("id") / F.lit(max(1, stride))) % F.lit(max(1, len(labels)))
        array = F.array(*[F.lit(v) for v in labels]).cast("array<string>")
        columns.append(F.get(array, position.cast("int")).alias(name))
    return grid.select(*columns)


def level_values(df: DataFrame, columns: Iterable[str], declared: Mapping = {}) -> DataFrame:
    """(dimension, level_idx, level, n): levels in order, null not being one.

    Declared labels go in their order, numbers in that of numbers, all others as text. A column may
    have any number of labels: they are numbered range by range.
    """
    columns = list(columns)
    numeric = F.col("dimension").isin(*numeric_columns(df, columns))
    number = F.when(numeric, F.expr("try_cast(level as double)"))
    digits = F.when(numeric, F.char_length("level"))
    order = F.lit(None).cast("int")
    for name, levels in declared.items():
        order = F.when(F.col("dimension") == name, level_index("level", levels)).otherwise(order)
    counts = level_counts(df, columns).where(F.col("level").isNotNull()).withColumn("_order", order)
    by_level = [F.col("dimension"), F.col("_order").asc_nulls_last(), number, digits, F.col("level")]
    placed = checkpointed(numbered(counts, by_level, "_row"))
    first = placed.groupBy("dimension").agg(F.min("_row").alias("_first"))
    placed = attach(placed, first, ["dimension"], len(columns))
    place = (F.col("_row") - F.col("_first") + 1).cast("int").alias("level_idx")
    return placed.select("dimension", place, "level", "n")
