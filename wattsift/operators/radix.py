"""Digits of numbers that keep their order, for selection by rank.

A pass counts rows by digit and keeps the digits that hold the wanted ranks. The first digit is the
sign with the binary logarithm in steps of 1/64, so it splits any spread of magnitudes; later ones cut the
span between the least and the greatest value of a kept digit into equal steps. Both never fall as the
number grows, whatever is rounded, so ranks stay with their digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS_A_DOUBLING = 64
STEPS = 4096
# Above every logarithm of a double in these steps; smaller than the distance to the next sign.
_OFFSET = 70_000
_INFINITE, _NAN = 140_000, 150_000


def magnitude(x: Column) -> Column:
    """First digit: an integer between -140,000 and 150,000."""
    steps = F.least(F.lit(float(_INFINITE)), F.floor(F.log2(F.abs(x)) * STEPS_A_DOUBLING).cast("double") + _OFFSET)
    size = F.when(F.abs(x) == float("inf"), F.lit(float(_INFINITE))).otherwise(steps).cast("int")
    return F.when(F.isnan(x), _NAN).when(x > 0, size).when(x < 0, -size).otherwise(0)


def step(x: Column, low: float, high: float) -> Column:
    """A later digit: the place of x in low..high, 0 to STEPS - 1."""
    return F.least(F.lit(STEPS - 1), F.floor((x - F.lit(low)) / F.lit(high - low) * STEPS).cast("int"))
