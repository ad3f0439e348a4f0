"""One row per consumer, and statistics over consumers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.functions.calendar import is_night_hour, is_peak_hour, is_weekend
from wattsift.functions.parsing import nan_to_null
from wattsift.operators.cleaning import (
    COPIES, DAY_FIRST, DAY_SHOWN, MONTH_FIRST, NEGATIVE, NO_TIME, NO_VALUE, ORDER, REJECT, SLOT,
)
from wattsift.operators.quantiles import exact_quantiles

REJECT_COUNTS = ["raw_rows", "distinct_rows", "rejected_null", "rejected_negative", "rejected_timestamp"]


def aggregate_consumers(readings: DataFrame) -> DataFrame:
    """Level, spread, count, first region and time-of-day shares of every consumer.

    The shares are shares of readings, not of energy. Readings without a consumer are left out.
    """
    known = readings.filter(F.col("consumer_id").isNotNull())
    return _per_consumer(known, "region", None, tagged=False)


def aggregate_tagged(
    tagged: DataFrame, source: str | None, classify: Callable[[Column], Column]
) -> DataFrame:
    """The same rows straight from tagged readings, with the counts a cleaning report needs.

    Grouping is by the raw region column, and ``classify`` runs once per consumer and code
    instead of once per reading. Consumers without a valid reading have ``reading_count`` 0,
    and readings without a consumer share one row whose id is NULL. Readings tagged in both orders of day and month give a
    row for each order.
    """
    return _per_consumer(tagged, source, classify, tagged=True)


def _per_consumer(
    readings: DataFrame, region: str | None, classify: Callable[[Column], Column] | None, tagged: bool
) -> DataFrame:
    # Two levels, both with fixed-width buffers only, so both hash-aggregate: a first-region buffer
    # would hold text and sort instead. The first is by consumer, region and, after a distinct by consumer and
    # day, the slot, so that it needs no shuffle. Elsewhere it combines on the map side, and a consumer with a third of
    # all readings leaves each map task as one row per region.
    timed = "timestamp" in readings.columns
    valid = F.col(REJECT).isNull() if tagged else None

    def kept(column: Column) -> Column:
        return column if valid is None else F.when(valid, column)

    value, ts = kept(F.col("consumption")), kept(F.col("timestamp")) if timed else None
    code = F.col(region) if region else F.lit(None).cast("string")
    first_level = [
        F.count(value).alias("n"), F.sum(value).alias("total"), F.var_pop(value).alias("var"),
        F.min(value).alias("low"), F.max(value).alias("high"),
    ]
    if timed:
        hour = F.hour(ts)
        first_level += [
            F.min(ts).alias("first_ts"),
            F.count_if(is_night_hour(hour)).alias("night"),
            F.count_if(is_weekend(ts)).alias("weekend"),
            F.count_if(is_peak_hour(hour)).alias("peak"),
        ]
    if tagged:
        reject = F.col(REJECT)
        first_level += [
            F.sum(COPIES).alias("raw_rows"),
            F.count_if(reject == NO_VALUE).alias("rejected_null"),
            F.count_if(reject == NEGATIVE).alias("rejected_negative"),
            F.count_if(reject == NO_TIME).alias("rejected_timestamp"),
        ]
    slot = [SLOT] if SLOT in readings.columns else []
    order_key = [ORDER] if ORDER in readings.columns else []
    if order_key:
        first_level.append(F.max(DAY_SHOWN).alias(DAY_SHOWN))
    by_region = readings.groupBy("consumer_id", *slot, *order_key, code.alias("code")).agg(*first_level)
    if order_key:
        # From here on a consumer's days are there in both orders; the shuffle carries them once where both are the same.
        orders = F.when(F.col(ORDER).isNull(), F.array(F.lit(MONTH_FIRST), F.lit(DAY_FIRST))).otherwise(F.array(ORDER))
        by_region = by_region.repartition("consumer_id").withColumn(ORDER, F.explode(orders))
    zone = F.col("code") if classify is None else classify(F.col("code"))
    # Deviations of the parts are merged about the consumer's mean; a difference of large squares would lose them.
    # The region is that of the earliest reading; equal times go to the smaller name. The windows need the same
    # clustering as the second level, so they cost no shuffle of their own; a consumer has a row per region and slot there.
    whole = Window.partitionBy("consumer_id", *order_key)
    own = F.try_divide("total", "n") - F.try_divide(F.sum("total").over(whole), F.sum("n").over(whole))
    order = [F.col("first_ts"), F.col("zone")] if timed else [F.col("zone")]
    in_time = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_region = by_region.withColumn("zone", zone)
    first_zone = F.first(F.when(F.col("n") > 0, F.col("zone")), ignorenulls=True).over(in_time)
    by_region = by_region.withColumns({"away": own, "region": first_zone})
    if tagged:
        rows = F.col("n") + F.col("rejected_null") + F.col("rejected_negative") + F.col("rejected_timestamp")
        by_region = by_region.withColumn("distinct_rows", rows)

    second_level = [
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.sum((F.col("var") + F.col("away") * F.col("away")) * F.col("n")).alias("spread"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    ]
    if timed:
        second_level += [F.sum(c).alias(c) for c in ("night", "weekend", "peak")]
    if tagged:
        second_level += [F.sum(c).alias(c) for c in REJECT_COUNTS]
    if order_key:
        second_level.append(F.max(DAY_SHOWN).alias(DAY_SHOWN))
    one = by_region.groupBy("consumer_id", *order_key, "region").agg(*second_level)

    n = F.col("n")
    shares = [("night_usage_ratio", "night"), ("weekend_readings_ratio", "weekend"), ("peak_usage_ratio", "peak")]
    return one.select(
        "consumer_id",
        nan_to_null(F.try_divide(F.col("total"), n)).alias("avg_consumption"),
        nan_to_null(F.when(n > 1, F.sqrt(F.try_divide("spread", n - 1)))).alias("std_consumption"),
        F.col("low").alias("min_consumption"),
        F.col("high").alias("max_consumption"),
        nan_to_null(F.col("total")).alias("total_consumption"),
        n.alias("reading_count"),
        "region",
        *([F.try_divide(F.col(c), n).alias(name) for name, c in shares] if timed else []),
        *(REJECT_COUNTS if tagged else []),
        *([ORDER, DAY_SHOWN] if order_key else []),
    )


def region_counts(consumers: DataFrame) -> DataFrame:
    known = consumers.filter(F.col("region").isNotNull())
    return known.groupBy("region").agg(F.count(F.lit(1)).alias("consumers"))


def dataset_statistics(consumers: DataFrame) -> DataFrame:
    """One row: consumers, mean and sample deviation of their averages, readings."""
    return consumers.agg(
        F.count(F.lit(1)).alias("total_consumers"),
        F.coalesce(F.avg("avg_consumption"), F.lit(0.0)).alias("avg_consumption_mean"),
        F.stddev_samp("avg_consumption").alias("avg_consumption_std"),
        F.coalesce(F.sum("reading_count"), F.lit(0)).alias("total_readings"),
    )


def region_map(consumers: DataFrame) -> DataFrame:
    """Consumers of every region, a row each by name. A region is a zone or any utility, so there is no bound on them."""
    return region_counts(consumers).orderBy("region")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def feature_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, minimum, maximum and median of each numeric column, long form."""
    return _summary(df, columns or numeric_columns(df), F.stddev_samp)


def basic_statistics(df: DataFrame, column: str) -> DataFrame:
    """The same five numbers of one column, with the population deviation."""
    return _summary(df, [column], F.stddev_pop).drop("feature")


def _summary(df: DataFrame, columns: list[str], deviation: Callable[[Column], Column]) -> DataFrame:
    medians = exact_quantiles(df, {c: (c, 0.5) for c in columns})
    aggregated = df.agg(*[
        F.struct(
            F.avg(c).cast("double").alias("mean"), deviation(F.col(c)).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(f"s{i}")
        for i, c in enumerate(columns)
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s"), F.lit(medians[c]).cast("double").alias("median"))
        for i, c in enumerate(columns)
    ])
    long = aggregated.select(F.inline(rows))
    return long.select("feature", "s.mean", "s.std", "s.min", "s.max", "median")
