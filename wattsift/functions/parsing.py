"""Text to value: missing markers, numbers, timestamps. Missing is always NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.fixed_values import MISSING_TEXT

# Characters that Python's str.strip removes from ASCII text.
BLANKS = " \t\n\r\x0b\x0c"

# Type suffixes, hexadecimal text and NaN, which a cast to double would read.
NOT_A_DECIMAL = r"(?i)[0-9.][df]\s*$|x|nan"
# Days to either side of 1970 that nanosecond timestamps can hold; other times count as unreadable.
LAST_DAY = 106_751

# Day, month and year in either order; year first; year, month and day without separators; and with the month's name.
SLASHED = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(.*)$"
YEAR_FIRST = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(.*)$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})((?:[ T]?\d{4}(?:\d{2})?)?)$"
SECONDS, MINUTES = r"^[ T]?(\d{2})(\d{2})(\d{2})$", r"^[ T]?(\d{2})(\d{2})$"
DAY_NAME = r"^(\d{1,2})[ -]([A-Za-z]{3,9})[.,]?[ -](\d{4})(.*)$"
NAME_DAY = r"^([A-Za-z]{3,9})[.]? (\d{1,2}),? (\d{4})(.*)$"
TWELVE_HOURS = r"^(.*?)[ T]+(\d{1,2})(:\d{2}(?::\d{2}(?:[.]\d+)?)?)\s*([AaPp])[.]?[Mm][.]?$"
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + "".join(c if c.isprintable() and c not in "'\\" else f"\\u{ord(c):04x}" for c in value) + "'"


def literal_map(values: dict[str, str]) -> Column:
    """A constant map column."""
    return F.expr(f"map({', '.join(sql_text(x) for pair in values.items() for x in pair)})")


def blank_to_null(name: str) -> Column:
    """The text column, NULL wherever the text means "missing" in a readings file.

    It runs on every column of every row, hence the plain trim, which takes blanks only but
    costs next to nothing where there are none.
    """
    quoted = "`" + name.replace("`", "``") + "`"
    known = ", ".join(sql_text(t) for t in MISSING_TEXT)
    return F.expr(f"CASE WHEN trim({quoted}) NOT IN ({known}) THEN {quoted} END")


def finite(number: Column) -> Column:
    """The number, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def nan_to_null(number: Column) -> Column:
    return F.nullif(number, F.lit(float("nan")))


def read_number(column: Column, kind: T.DataType) -> Column:
    """Consumption as double. Bad text and NaN become NULL; infinities stay."""
    if isinstance(kind, T.NumericType):
        return nan_to_null(column.cast("double"))
    text = column.cast("string")
    return F.when(~text.rlike(NOT_A_DECIMAL), text.try_cast("double"))


def only_day_first(text: Column) -> Column:
    """Whether a date is one like 13/10/2024, which settles the order for a whole column."""
    first = F.regexp_extract(strip(text), SLASHED, 1)
    return F.coalesce(first != "", F.lit(False)) & F.coalesce(first.try_cast("int") > 12, F.lit(False))


def day_comes_first(text: Column) -> Column:
    """Aggregate: whether the dates of a column have the day first."""
    return F.coalesce(F.bool_or(only_day_first(text)), F.lit(False))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _month(name: Column) -> Column:
    """Number of a month by the first three letters of its name, else a text that is no number."""
    at = F.position(F.upper(F.substring(name, 1, 3)), F.lit(MONTHS))
    return F.when(at % 3 == 1, F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0")).otherwise("x")


def _iso(text: Column, day_first: bool) -> Column:
    """The date part of a known form as ISO, the rest as it is."""

    def written(pattern: str, *order: int, month: bool = False) -> Column:
        year, middle, day, rest = (F.regexp_extract(text, pattern, i) for i in order)
        return F.concat(year, F.lit("-"), _month(middle) if month else middle, F.lit("-"), day, rest)

    clock = F.regexp_replace(F.regexp_extract(text, COMPACT, 4), SECONDS, " $1:$2:$3")
    clock = F.regexp_replace(clock, MINUTES, " $1:$2")
    return (
        F.when(text.rlike(SLASHED), written(SLASHED, 3, *((2, 1) if day_first else (1, 2)), 4))
        .when(text.rlike(YEAR_FIRST), written(YEAR_FIRST, 1, 2, 3, 4))
        .when(text.rlike(COMPACT), F.concat(F.regexp_replace(text, COMPACT, "$1-$2-$3"), clock))
        .when(text.rlike(DAY_NAME), written(DAY_NAME, 3, 2, 1, 4, month=True))
        .when(text.rlike(NAME_DAY), written(NAME_DAY, 3, 1, 2, 4, month=True))
        .otherwise(text))


def _twenty_four(text: Column) -> Column:
    """1:30 PM as 13:30."""
    date, hour, rest, half = (F.regexp_extract(text, TWELVE_HOURS, i) for i in (1, 2, 3, 4))
    shown = hour.cast("int") % 12 + F.when(F.upper(half) == "P", 12).otherwise(0)
    clock = F.concat(date, F.lit(" "), F.lpad(shown.cast("string"), 2, "0"), rest)
    return F.when(~text.rlike(TWELVE_HOURS), text).when(hour.cast("int").between(1, 12), clock)


def read_timestamp(column: Column, kind: T.DataType, day_first: bool = False) -> Column:
    """Wall-clock time without zone; NULL where the text is no time.

    ISO text is cast as it is; other forms are brought to ISO and cast. All of a column has one
    order of day and month, ``day_first``; a date that does not fit it is not a time. No format
    depends on the session time zone.
    """
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    text = column.cast("string")
    iso = _bound(strip(text), lambda t: _iso(t, day_first))
    return F.coalesce(text.try_cast("timestamp_ntz"), _bound(iso, _twenty_four).try_cast("timestamp_ntz"))


def is_time(ts: Column) -> Column:
    """Whether a timestamp was read, and lies in the span. Uses ``ts`` once, since it may be costly."""
    return F.coalesce(F.abs(F.unix_date(ts.cast("date"))) <= LAST_DAY, F.lit(False))
