"""Hand-made cohorts of a few rows."""

from __future__ import annotations

from levelwise.cohort import Cohort

TIME, GROUP, MEASURE = "Financial_Quarter", "Demographic_G", "Num_X"


def cohort(spark, rows, columns=(TIME, GROUP, MEASURE), kinds=None, declared=None) -> Cohort:
    kinds = kinds or ["double" if c.startswith("Num") else "string" for c in columns]
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds))
    return Cohort.of(spark.createDataFrame(rows, schema), declared)


def rows_of(df, *order):
    """Rows as tuples, sorted with nulls last."""
    found = [tuple(r) for r in df.select(*(order or df.columns)).collect()]
    return sorted(found, key=lambda r: [(v is None, str(type(v)), v) for v in r])
