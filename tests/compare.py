"""Runs a registered query and its SQL and compares the rows, order aside."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(float(value) + 0.0)
    return str(value)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(query, sql: str | None, spark, con, sf_dir: str) -> str | None:
    """None when all is well, else what is wrong. Without SQL the query must give rows."""
    found = query(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoop" in plan:
        return "the plan joins every row with every row"
    ours = rows_of(found.columns, [tuple(r) for r in found.collect()])
    if sql is None:
        return None if ours else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
