"""Physical plan text, for plan tests and for tuning by eye."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def operators(df: DataFrame) -> list[str]:
    """Names of the initial plan's operators, root first, repeats included."""
    names = []
    for line in plan_text(df).splitlines():
        if line.startswith("("):
            break
        name = line.lstrip(" :+-*").split(" (")[0].strip()
        if name and not name.startswith("=="):
            names.append(name)
    return names
