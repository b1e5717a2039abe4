"""Row and label predicates, and the reliability band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.functions.rounding import col, quoted

# Label pattern, its anchored variant, band limits.
HIDDEN_LABELS = "(?i)NA|Other"
HIDDEN_LABELS_STRICT = "(?i)^(na|other.*)$"
BAND_LOW = 100
BAND_MEDIUM = 300


def nonzero(measure: str) -> Column:
    """Drops zero and missing values, keeps negatives."""
    x = col(measure)
    return (x != 0) & ~F.isnan(x)


def positive(measure: str) -> Column:
    """Drops zero, negative and missing values."""
    x = col(measure)
    return (x > 0) & ~F.isnan(x)


_RULES = {"nonzero": nonzero, "positive": positive}


def apply_measure_rule(df: DataFrame, measure: str, rule: str) -> DataFrame:
    """``rule`` is ``nonzero``, ``positive`` or ``none`` (a signed measure)."""
    if rule == "none":
        return df
    return df.where(_RULES[rule](measure))


def visible_label(column: str | Column, strict: bool = False) -> Column:
    """True for labels that charts show.

    The default hides any label containing "na" or "other" in any case, even
    inside a longer word; ``strict`` hides only whole labels.
    """
    label = col(column) if isinstance(column, str) else column
    pattern = HIDDEN_LABELS_STRICT if strict else HIDDEN_LABELS
    return label.isNotNull() & ~label.rlike(pattern)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=[quoted(c) for c in columns])


def reliability_band(count: str | Column) -> Column:
    n = col(count) if isinstance(count, str) else count
    return (
        F.when(n <= BAND_LOW, "low")
        .when(n <= BAND_MEDIUM, "medium")
        .when(n.isNotNull(), "high")
    )
