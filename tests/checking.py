"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def differences(df, con, sql: str) -> list[str]:
    """What differs between the two results; empty when they agree."""
    found = []
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    sql_types = {d[0]: str(d[1]) for d in result.description}
    sql_rows = result.fetchall()
    if sorted(df.columns) != sorted(sql_columns):
        return [f"columns {sorted(df.columns)} / {sorted(sql_columns)}"]
    for name, kind in df.dtypes:
        if _KINDS[kind] != sql_types[name]:
            found.append(f"type of {name}: {kind} / {sql_types[name]}")
    ours = _bag(df.columns, [tuple(r) for r in df.collect()])
    theirs = _bag(sql_columns, sql_rows)
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} / {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return found
