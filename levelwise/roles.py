"""Columns by role: time dimensions, grouping columns, measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# The naming rules and column names of the data model.
GROUP_PREFIX = "Demographic"
MEASURE_PREFIX = "Num"
ORIGINAL_PREFIX = "_raw_"
TABLE_TIMES = ("Month", "Financial_Quarter", "DOTW", "Financial_Year")
CHART_TIMES = ("Financial_Quarter", "Month")
AREA_TIMES = ("Year_Quarter",)
AREA_HIDDEN = ("Demographic_Event_Number",)
ID_COLUMNS = ("Row_ID", "unique_id")
SIGNED_MEASURES = ("Surplus",)


@dataclass(frozen=True)
class RoleSchema:
    """What each column of a wide table is for, found from its name."""

    times: tuple[str, ...]
    groups: tuple[str, ...]
    measures: tuple[str, ...]

    @classmethod
    def infer(cls, df: DataFrame) -> RoleSchema:
        names = df.columns
        known = (*TABLE_TIMES, *AREA_TIMES)
        return cls(
            times=tuple(c for c in known if c in names),
            groups=tuple(c for c in names if c.startswith(GROUP_PREFIX)),
            measures=tuple(c for c in names if c.startswith(MEASURE_PREFIX)),
        )

    @property
    def categorical(self) -> tuple[str, ...]:
        return (*self.times, *self.groups)

    @property
    def filterable(self) -> tuple[str, ...]:
        """Columns a cohort may be filtered on; times included, ids not."""
        return tuple(c for c in self.categorical if c not in ID_COLUMNS)

    @property
    def area_groups(self) -> tuple[str, ...]:
        return tuple(c for c in self.groups if c not in AREA_HIDDEN)

    @property
    def second_groups(self) -> tuple[str, ...]:
        """Choices for the second grouping column; its default is the last one."""
        return tuple(reversed(self.groups))

    @property
    def second_measures(self) -> tuple[str, ...]:
        return tuple(reversed(self.measures))

    def require(self, column: str, role: str) -> str:
        allowed = {
            "time": self.times,
            "group": self.groups,
            "measure": (*self.measures, *SIGNED_MEASURES),
            "categorical": self.categorical,
        }[role]
        if column not in allowed:
            raise ValueError(f"{column!r} is not a {role} column; choose from {list(allowed)}")
        return column


def is_signed(measure: str) -> bool:
    """Measures that may be zero or negative skip the zero rules."""
    return measure in SIGNED_MEASURES
