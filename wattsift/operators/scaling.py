"""Standard and min-max scaling with fitted, bounded statistics.

The deviation is that of the population, and a constant column becomes 0 either way, which is
why the library's own scalers are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    method: str
    names: list[str]
    shift: list[float]
    width: list[float]

    def columns(self, inputs: list[Column]) -> list[Column]:
        """Scaled inputs, in order, under the scaler's names."""
        return [
            (F.lit(0.0) if width == 0 else (column - F.lit(shift)) / F.lit(width)).alias(name)
            for name, shift, width, column in zip(self.names, self.shift, self.width, inputs)
        ]


def fit_scaler(df: DataFrame, names: list[str], inputs: list[Column], method: str = "standard") -> Scaler:
    """One aggregate over ``df``; ``inputs`` are the finite columns to scale."""
    numbered = df.select(*[c.alias(f"x{i}") for i, c in enumerate(inputs)])
    if method == "standard":
        made = [(F.avg, F.stddev_pop)] * len(names)
    elif method == "minmax":
        made = [(F.min, lambda c: F.max(c) - F.min(c))] * len(names)
    else:
        raise ValueError(f"method must be standard or minmax, not {method}")
    row = numbered.agg(*[
        part
        for i, (shift, width) in enumerate(made)
        for part in (shift(F.col(f"x{i}")).alias(f"s{i}"), width(F.col(f"x{i}")).alias(f"w{i}"))
    ]).first()
    count = range(len(names))
    return Scaler(
        method, list(names), [float(row[f"s{i}"] or 0.0) for i in count], [float(row[f"w{i}"] or 0.0) for i in count]
    )
