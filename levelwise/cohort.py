"""A cohort: rows to analyse, with the roles and levels of their dataset."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.functions.rounding import col
from levelwise.levels import LevelBook, as_labels, numeric_columns
from levelwise.plans.bounds import FEW_GROUPS, fits_one_task, groups_fit_one_task
from levelwise.roles import ORIGINAL_PREFIX, RoleSchema

METHODS = ("direct", "sorted", "ranked", "split")


@dataclass(frozen=True)
class Cohort:
    """``df`` are the rows of ``base`` for which ``predicate`` holds, where the two are known.

    Cohorts with one base can be read in a single pass. ``originals`` names the columns of the base that hold a
    measure as it was before missing values were filled in. ``filters`` are the label filters that make up
    the predicate; with a ``cube`` (``sources.cube``) that has their columns, counts come from its views.
    """

    df: DataFrame
    roles: RoleSchema
    book: LevelBook
    filtered: bool = False
    base: DataFrame | None = None
    predicate: Column | None = None
    originals: Mapping[str, str] = field(default_factory=dict)
    filters: tuple[tuple[str, tuple], ...] = ()
    cube: object | None = None

    @classmethod
    def of(cls, df: DataFrame, declared=None, rows: int | None = None) -> Cohort:
        """A cohort over any wide table whose columns follow the naming rule.

        Labels of any type are text from here on; numbers keep their order.
        """
        return cls.over(df, declared, rows)

    @classmethod
    def over(cls, df: DataFrame, declared=None, rows: int | None = None, stored=None) -> Cohort:
        """Like ``of``, with the levels that ``write_levels`` stored."""
        roles = RoleSchema.infer(df)
        numeric = numeric_columns(df, roles.categorical)
        base = as_labels(df, roles.categorical)
        originals = {c[len(ORIGINAL_PREFIX) :]: c for c in df.columns if c.startswith(ORIGINAL_PREFIX)}
        df = base.drop(*originals.values()) if originals else base
        book = LevelBook(df, declared, rows, stored=stored, numeric=numeric)
        return cls(df, roles, book, base=base, originals=originals)

    def keep(self, column: str | None, levels: list[str] | None) -> Cohort:
        """Rows whose label is one of ``levels``; no levels means no filter."""
        if not column or not levels:
            return self
        self.roles.require(column, "categorical")
        wanted = [v if isinstance(v, str) else F.lit(v).cast("string") for v in levels]
        kept = col(column).isin(*wanted)
        both = kept if self.predicate is None else self.predicate & kept
        filters = (*self.filters, (column, tuple(wanted)))
        return replace(self, df=self.df.where(kept), filtered=True, predicate=both, filters=filters)

    def counted_by(self, cube) -> Cohort:
        """This cohort with counts read from the cube where it has them."""
        return replace(self, cube=cube)

    def counts(self, keys: list[str]) -> DataFrame:
        """``keys`` and ``n`` rows each, not yet summed: one by one, or as the cube has them."""
        if self.cube is not None:
            found = self.cube.counts(keys, self.filters)
            if found is not None:
                return found
        return self.df.select(*map(col, keys), F.lit(1).cast("bigint").alias("n"))

    @property
    def kept(self) -> Column:
        """True for the rows of the base that belong to this cohort."""
        return F.lit(True) if self.predicate is None else F.coalesce(self.predicate, F.lit(False))

    def shares_base(self, other: Cohort) -> bool:
        """Whether one pass over one table yields the rows of both."""
        return self.base is not None and self.base is other.base

    def has_null(self, column: str) -> bool:
        """Whether a missing label occurs in these rows."""
        if not self.book.has_null(column):
            return False
        return not self.filtered or not self.counts([column]).where(col(column).isNull()).isEmpty()

    def labels(self, column: str) -> list[str | None]:
        """Levels in order, then null where it occurs."""
        return [*self.book.levels(column), *([None] if self.has_null(column) else [])]

    def plan(self, keys: list[str], method: str = "auto") -> str:
        """How rank statistics by ``keys`` are to be found: a plan of ``describe``."""
        if method != "auto":
            if method not in METHODS:
                raise ValueError(f"unknown method {method!r}")
            return method
        few = self.book.few_groups(keys, FEW_GROUPS)
        if fits_one_task(self.book.rows) or groups_fit_one_task(self.book.largest_group(keys)):
            return "direct" if few else "sorted"
        return "ranked" if few else "split"


def joint_plan(cohorts: list[Cohort], keys: list[str], method: str = "auto") -> str:
    """A plan that is right for rows of all ``cohorts`` together."""
    plans = {c.plan(keys, method) for c in cohorts}
    return plans.pop() if len(plans) == 1 else "split"
