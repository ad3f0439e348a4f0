"""Exact quantiles with linear interpolation, at any number of rows: selection by digits.

All quantiles of all columns share the passes. A pass is one aggregate of fixed width that counts rows
by digit (see ``radix``) and brings back a bounded number of counts. It ends where every wanted rank lies in a digit of one
value: usually after two or three passes, and after six at the most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.operators import radix


def exact_quantiles(
    df: DataFrame, wanted: dict[str, tuple[str, float]], also: dict[str, Column] | None = None,
) -> dict[str, float | None]:
    """``{name: (column, p)}`` to ``{name: value}``; NULLs are ignored, no rows give None.

    ``also`` holds aggregates to compute in the first pass, as doubles. Makes several passes over ``df``: give it a staged table.
    """
    columns = sorted({column for column, _ in wanted.values()})
    first = _counted(df, [(c, radix.magnitude(_double(c)), None) for c in columns])
    also = also or {}
    if also:
        # A row per aggregate, numbered from -1 downwards.
        told = F.array(*[F.struct(F.lit(-1 - i).alias("window"), v.cast("double").alias("low")) for i, v in enumerate(also.values())])
        extra = df.agg(told.alias("told")).select(F.inline("told")).select(
            "window", F.lit(0).alias("digit"), F.lit(0).cast("long").alias("rows"), "low", F.lit(None).cast("double").alias("high"))
        first = first.union(extra)
    counts: dict[int, list] = {}
    for row in first.collect():
        counts.setdefault(row["window"], []).append(row)
    found: dict[str, float | None] = {name: counts[-1 - i][0]["low"] for i, name in enumerate(also)}

    sizes = [sum(r["rows"] for r in counts.get(i, ())) for i in range(len(columns))]
    places = {name: p * (sizes[columns.index(c)] - 1) for name, (c, p) in wanted.items()}
    ranks = {(columns.index(c), rank) for name, (c, _) in wanted.items() if sizes[columns.index(c)]
             for rank in (math.floor(places[name]), math.ceil(places[name]))}
    values = _select(df, columns, ranks, counts)
    for name, (c, _) in wanted.items():
        i, at = columns.index(c), places[name]
        if not sizes[i]:
            found[name] = None
            continue
        low, high = values[i, math.floor(at)], values[i, math.ceil(at)]
        found[name] = _number(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return found


def _double(column: str) -> Column:
    return F.col(column).cast("double")


def _number(value: float) -> float | None:
    return None if math.isnan(value) else float(value)


def _counted(df: DataFrame, windows: list[tuple[str, Column, tuple[float, float] | None]]) -> DataFrame:
    """Rows, least and greatest value by digit of each window: a column, its digit, and the values that take part."""
    entries = []
    for i, (column, digit, span) in enumerate(windows):
        x = _double(column)
        inside = x.isNotNull() if span is None else x.between(*span)
        entries.append(F.when(inside, F.struct(F.lit(i).alias("window"), digit.alias("digit"), x.alias("x"))))
    rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return rows.groupBy(F.col("e.window").alias("window"), F.col("e.digit").alias("digit")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("e.x").alias("low"), F.max("e.x").alias("high"))


def _select(
    df: DataFrame, columns: list[str], ranks: set[tuple[int, int]], counts: dict[int, list]
) -> dict[tuple[int, int], float]:
    """The value at each (column, rank)."""
    found: dict[tuple[int, int], float] = {}
    # By window: its column and how many rows of that column lie below it.
    windows = {i: (i, 0) for i in range(len(columns))}
    while True:
        spans: dict[tuple[int, float, float], int] = {}
        for number, (column, below) in windows.items():
            for row in sorted(counts.get(number, ()), key=lambda r: r["digit"]):
                inside = [rank for i, rank in ranks if i == column and below <= rank < below + row["rows"]]
                if inside and (row["low"] == row["high"] or math.isnan(row["high"])):
                    found.update({(column, rank): row["high"] for rank in inside})
                elif inside:
                    spans[column, row["low"], row["high"]] = below
                below += row["rows"]
        if not spans:
            return found
        windows = {i: (column, below) for i, ((column, _, _), below) in enumerate(spans.items())}
        ranks = ranks.difference(found)
        counts = {}
        for row in _counted(df, [(columns[c], radix.step(_double(columns[c]), low, high), (low, high)) for c, low, high in spans]).collect():
            counts.setdefault(row["window"], []).append(row)
