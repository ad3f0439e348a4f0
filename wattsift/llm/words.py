"""Words of a text as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattsift.llm.tables import LOWER, UPPER

# Everything in ASCII but digits and small letters. What is beyond ASCII is part of words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z made small, then all maximal runs of digits, letters a-z and characters beyond ASCII."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def places(n: Column) -> Column:
    """1..n, empty below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
