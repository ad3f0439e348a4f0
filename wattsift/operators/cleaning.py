"""Cleaning of raw readings.

Whole-row distinct needs every raw column in one shuffle. Alone, it is a count per distinct
row, which combines on the map side, so a row that is repeated billions of times costs one
record per map task, and the removed copies are known without a second pass.

Where readings are aggregated by consumer right after, they are shuffled by consumer and day instead.
Copies meet there as well, and what is left of a consumer's day is aggregated in place: no reading
crosses the network twice, and a consumer with a third of all readings is as many groups as it has days.

Whether 5/10/2024 has the day or the month first is a question to the whole time column. Aggregates do not ask it before:
they carry readings that depend on it in both orders, and what the column shows chooses between two results at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.functions.parsing import blank_to_null, day_comes_first, is_time, only_day_first, read_number, read_timestamp
from wattsift.functions.zones import region_of, region_source
from wattsift.sources.layouts import detect_layout, rename_standard

COPIES, REJECT, SLOT = "_copies", "_reject", "_slot"
# The order in which a reading's date was read, NULL where it does not matter; whether the date can only have the day first.
ORDER, DAY_SHOWN = "_order", "_day_shown"
MONTH_FIRST, DAY_FIRST = "month first", "day first"
# Slots of readings that show no day or no consumer, for each consumer.
SLOTS = 64
NO_VALUE, NEGATIVE, NO_TIME = "null", "negative", "bad_timestamp"


def drop_missing_markers(raw: DataFrame) -> DataFrame:
    """Text columns with "missing" markers as NULL."""
    return raw.select(*[
        (blank_to_null(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name)
        for f in raw.schema
    ])


def distinct_readings(raw: DataFrame) -> DataFrame:
    """Distinct raw rows under standard names, with the number of copies of each."""
    return _distinct(rename_standard(raw))


def _distinct(named: DataFrame) -> DataFrame:
    known = drop_missing_markers(named)
    return known.groupBy(*[F.col(f"`{c}`") for c in known.columns]).agg(F.count(F.lit(1)).alias(COPIES))


def slot_of(named: DataFrame) -> Column:
    """The day as it is written, equal for all copies of a reading; a hash of the row where there is none."""
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in named.columns]), F.lit(SLOTS)).cast("string")
    if "timestamp" not in named.columns:
        return spread
    day = F.substring(F.col("timestamp").cast("string"), 1, 10)
    return F.coalesce(F.when(F.col("consumer_id").isNotNull(), day), spread)


def _distinct_in_slots(named: DataFrame) -> DataFrame:
    """The distinct rows with their copies and slot, shuffled by consumer and slot."""
    known = drop_missing_markers(named)
    placed = known.withColumn(SLOT, slot_of(known)).repartition("consumer_id", SLOT)
    return placed.groupBy(*[F.col(f"`{c}`") for c in known.columns], SLOT).agg(F.count(F.lit(1)).alias(COPIES))


def _has_text_times(named: DataFrame) -> bool:
    kinds = {f.name: f.dataType for f in named.schema}
    return isinstance(kinds.get("timestamp"), T.StringType)


def find_day_first(named: DataFrame) -> bool:
    """Whether the day comes first in the time column: one aggregate over that column alone, all rows."""
    return _has_text_times(named) and named.agg(day_comes_first(F.col("timestamp"))).first()[0]


def _in_both_orders(frame: DataFrame) -> DataFrame:
    """Readings once where the order of day and month makes no difference, else in each order."""
    text = F.col("timestamp")
    month, day = (read_timestamp(text, T.StringType(), first) for first in (False, True))
    read = frame.withColumns({"_month": month, "_day": day, DAY_SHOWN: only_day_first(text)})

    def of(order: str | None, time: str) -> Column:
        return F.struct(F.lit(order).cast("string").alias(ORDER), F.col(time).alias("timestamp"))

    rows = F.when(F.col("_month").eqNullSafe(F.col("_day")), F.array(of(None, "_month"))).otherwise(
        F.array(of(MONTH_FIRST, "_month"), of(DAY_FIRST, "_day")))
    rest = [F.col(f"`{c}`") for c in read.columns if c not in ("timestamp", "_month", "_day")]
    return read.select(*rest, F.inline(rows))


def in_one_order(counted: DataFrame) -> DataFrame:
    """The rows of the order that the dates show, of rows that were counted in both: day first if any can only be that."""
    if ORDER not in counted.columns:
        return counted
    order = DAY_FIRST if counted.agg(F.max(DAY_SHOWN)).first()[0] else MONTH_FIRST
    return counted.filter(F.col(ORDER) == order).drop(ORDER, DAY_SHOWN)


def typed_columns(df: DataFrame, day_first: bool = False) -> dict[str, Column]:
    """Consumption as double and timestamp as time, NULL where unreadable."""
    kinds = {f.name: f.dataType for f in df.schema}
    readers = {"consumption": read_number, "timestamp": lambda column, kind: read_timestamp(column, kind, day_first)}
    return {name: read(F.col(name), kinds[name]) for name, read in readers.items() if name in kinds}


def tag_readings(raw: DataFrame, day_first: bool | None = None, by_consumer: bool = False) -> DataFrame:
    """Distinct typed readings, each with the reason for which cleaning drops it, or NULL.

    The first reason that applies is kept: no consumption, negative consumption, no time. Dates like 5/10/2024
    are read as ``day_first`` says; where that is None, a reading whose time depends on it is there in both orders, with
    the order as a column. ``by_consumer`` leaves readings together by consumer and slot, for an aggregate that follows.
    """
    named = rename_standard(raw)
    frame = _distinct_in_slots(named) if by_consumer else _distinct(named)
    if day_first is None and _has_text_times(named):
        frame = _in_both_orders(frame)
    frame = frame.withColumns(typed_columns(frame, bool(day_first)))
    reasons = []
    if "consumption" in frame.columns:
        reasons.append(F.when(F.col("consumption").isNull(), NO_VALUE).when(F.col("consumption") < 0, NEGATIVE))
    if "timestamp" in frame.columns:
        reasons.append(F.when(~is_time(F.col("timestamp")), NO_TIME))
    return frame.withColumn(REJECT, F.coalesce(*reasons) if reasons else F.lit(None).cast("string"))


def add_region(readings: DataFrame, layout: str) -> DataFrame:
    return readings.withColumn("region", region_of(region_source(readings.columns, layout), layout))


def clean_readings(raw: DataFrame, day_first: bool | None = None) -> DataFrame:
    """Valid distinct readings with typed values, their region and their layout.

    Validity depends on one row alone, so invalid rows leave before the distinct shuffles. The
    test is written on the raw columns: on the distinct rows, Spark would push it down all the
    same, but with every step in between repeated inside it.
    """
    layout = detect_layout(raw.columns)
    named = rename_standard(raw, layout)
    if day_first is None:
        day_first = find_day_first(named)
    typed = typed_columns(named, day_first)
    if "consumption" in typed:
        named = named.filter(typed["consumption"] >= 0)
    if "timestamp" in typed:
        named = named.filter(is_time(typed["timestamp"]))
    kept = _distinct(named).drop(COPIES)
    return add_region(kept.withColumns(typed_columns(kept, day_first)), layout).withColumn("_data_format", F.lit(layout))


def clean_report(raw: DataFrame, day_first: bool | None = None) -> DataFrame:
    """One row: rows before, rows removed by each rule, rows left."""
    reject = F.col(REJECT)
    tagged = tag_readings(raw, day_first)
    both = ORDER in tagged.columns
    counts = tagged.groupBy(*[ORDER] * both).agg(
        F.sum(COPIES).alias("raw_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.count_if(reject == NO_VALUE).alias("rejected_null"),
        F.count_if(reject == NEGATIVE).alias("rejected_negative"),
        F.count_if(reject == NO_TIME).alias("rejected_timestamp"),
        *[F.max(DAY_SHOWN).alias(DAY_SHOWN)] * both,
    )
    if both:
        # Three rows at most: the window is over them, not over readings.
        shown = F.coalesce(F.max(DAY_SHOWN).over(Window.partitionBy(F.lit(0))), F.lit(False))
        wanted = F.when(shown, DAY_FIRST).otherwise(MONTH_FIRST)
        counts = counts.withColumn("_wanted", wanted).filter(F.coalesce(ORDER, "_wanted") == F.col("_wanted"))
    return report_from_counts(counts, len(raw.columns))


def with_malformed(report: DataFrame, lines: DataFrame) -> DataFrame:
    """The report with the number of quarantined lines, which are in none of its other counts."""
    return report.withColumn("removed_malformed", F.lit(lines.count()))


def report_from_counts(counts: DataFrame, raw_columns: int) -> DataFrame:
    """The report row, from one or more rows of counts that add up."""
    total = {c: F.coalesce(F.sum(c), F.lit(0)) for c in (
        "raw_rows", "distinct_rows", "rejected_null", "rejected_negative", "rejected_timestamp")}
    summed = counts.agg(*[v.alias(c) for c, v in total.items()])
    final = (
        F.col("distinct_rows") - F.col("rejected_null") - F.col("rejected_negative") - F.col("rejected_timestamp")
    )
    return summed.select(
        F.col("raw_rows").alias("original_rows"),
        F.lit(raw_columns).cast("long").alias("original_columns"),
        (F.col("raw_rows") - F.col("distinct_rows")).alias("removed_duplicates"),
        F.col("rejected_null").alias("removed_nulls"),
        F.col("rejected_negative").alias("removed_negative"),
        F.col("rejected_timestamp").alias("removed_bad_timestamp"),
        final.alias("final_rows"),
        F.when(F.col("raw_rows") > 0, F.try_divide(final, F.col("raw_rows"))).otherwise(0.0).alias("cleaning_ratio"),
    )
