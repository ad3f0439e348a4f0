"""Layout of a raw readings frame, decided on the driver from its column names alone."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.fixed_values import ACORN_LAYOUT, COLUMN_ALIASES, LAYOUT_MARKERS, STATE_LAYOUT


def detect_layout(columns: list[str]) -> str:
    """The layout with more markers found inside the column names; a tie is ACORN."""
    lowered = [c.lower() for c in columns]

    def found(layout: str) -> int:
        return len([m for m in LAYOUT_MARKERS[layout] if any(m in c for c in lowered)])

    return STATE_LAYOUT if found(STATE_LAYOUT) > found(ACORN_LAYOUT) else ACORN_LAYOUT


def standard_names(columns: list[str], layout: str | None = None) -> list[str]:
    """New names, position by position.

    Each standard name claims the first raw column that matches one of its aliases; a later
    standard name takes a column over from an earlier one.
    """
    layout = layout or detect_layout(columns)
    keys = [c.lower().strip() for c in columns]
    claimed: dict[int, str] = {}
    for standard, aliases in COLUMN_ALIASES[layout].items():
        accepted = {a.lower() for a in aliases}
        position = next((i for i, key in enumerate(keys) if key in accepted), None)
        if position is not None:
            # Columns that share one exact name are renamed together, as by any name-keyed rename.
            claimed.update({i: standard for i, c in enumerate(columns) if c == columns[position]})
    return [claimed.get(i, c) for i, c in enumerate(columns)]


def rename_standard(raw: DataFrame, layout: str | None = None) -> DataFrame:
    """The raw frame under standard names; raises when two columns end up with one name."""
    names = standard_names(raw.columns, layout)
    case_sensitive = raw.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    tally = Counter(n if case_sensitive else n.lower() for n in names)
    clashes = sorted(n for n, times in tally.items() if times > 1)
    if clashes:
        raise ValueError(f"more than one column would be named {', '.join(clashes)}: {raw.columns}")
    return raw.toDF(*names)


def standardize_columns(raw: DataFrame) -> DataFrame:
    """Standard names plus ``_data_format``, the layout that was found."""
    layout = detect_layout(raw.columns)
    return rename_standard(raw, layout).withColumn("_data_format", F.lit(layout))


def check_columns(df: DataFrame, required: list[str]) -> dict[str, object]:
    missing = [name for name in required if name not in df.columns]
    return {"valid": not missing, "missing": missing, "available": list(df.columns)}
