"""Single readings: time series, flags against the consumer's own level, drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattsift.functions.calendar import iso_time
from wattsift.functions.labels import reading_reason

READINGS_SHOWN = 500
# Column of readings that are stored by consumer and day.
DAY = "_day"


def of_consumer(readings: DataFrame, consumer_id: object) -> DataFrame:
    return readings.filter(F.col("consumer_id").cast("string") == F.lit(str(consumer_id)))


def consumer_timeseries(readings: DataFrame, consumer_id: object) -> DataFrame:
    """One consumer's readings in time order. Ids compare as text."""
    mine = of_consumer(readings, consumer_id)
    return mine.orderBy("timestamp", "consumption") if "timestamp" in readings.columns else mine


def find_consumer(results: DataFrame, consumer_id: object) -> DataFrame:
    """The consumer's result row; raises when there is none."""
    found = results.filter(F.col("consumer_id").cast("string") == F.lit(str(consumer_id)))
    if found.isEmpty():
        raise LookupError(f"no consumer {consumer_id}")
    return found


def first_readings(readings: DataFrame, n: int | None = READINGS_SHOWN) -> DataFrame:
    """Every consumer's first ``n`` readings by time, equal times by consumption; all of them without ``n``.

    Spark keeps at most ``n`` rows per consumer on the map side as long as ``n`` is within its
    window group limit. Beyond that the first ``n`` of each slice of a consumer's readings are
    taken first, so that a consumer with a large share of all rows is never sorted by one task.
    """
    if n is None:
        return readings
    order = ["timestamp", "consumption"]
    limit = int(readings.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > limit:
        slices = F.pmod(F.xxhash64(*order), F.lit(256))
        within = F.row_number().over(Window.partitionBy("consumer_id", "_slice").orderBy(*order))
        readings = (
            readings.withColumn("_slice", slices).withColumn("_rank", within)
            .filter(F.col("_rank") <= n).drop("_slice", "_rank")
        )
    rank = F.row_number().over(Window.partitionBy("consumer_id").orderBy(*order))
    return readings.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def flag_readings(readings: DataFrame, consumers: DataFrame) -> DataFrame:
    """All readings of known consumers with ``is_anomalous`` and ``anomaly_reason``.

    A join on the consumer: adaptive execution broadcasts a small consumer side, and splits the
    readings of a consumer that holds a large share of them.
    """
    return _flagged(readings.join(_levels(consumers), "consumer_id"))


def _levels(consumers: DataFrame) -> DataFrame:
    return consumers.select(
        "consumer_id", F.col("avg_consumption").alias("_avg"), F.col("std_consumption").alias("_std"))


def _flagged(joined: DataFrame) -> DataFrame:
    reason = reading_reason(F.col("consumption"), F.col("timestamp"), F.col("_avg"), F.col("_std"))
    return (
        joined.withColumn("anomaly_reason", reason)
        .withColumn("is_anomalous", F.col("anomaly_reason").isNotNull())
        .withColumn("consumption", F.round("consumption", 4))
        .drop("_avg", "_std")
    )


def flag_by_day(stored: DataFrame, consumers: DataFrame) -> DataFrame:
    """``flag_readings`` of readings stored by consumer and day, which stay where they are.

    A level is laid out once for each day of its consumer, a fiftieth of the readings where they are half-hourly, so
    that both sides of the join have the buckets of the readings.
    """
    days = stored.select("consumer_id", DAY).distinct()
    return _flagged(stored.join(days.join(_levels(consumers), "consumer_id"), ["consumer_id", DAY])).drop(DAY)


def first_by_day(stored: DataFrame, n: int | None = READINGS_SHOWN) -> DataFrame:
    """``first_readings`` of readings stored by consumer and day.

    Days are counted in place; only readings of days before which a consumer has fewer than ``n`` are sorted, and the others
    do not leave their buckets. Readings without a time come first, as nulls do; they are one day here, wherever they are.
    """
    if n is None:
        return stored.drop(DAY)
    if "timestamp" not in stored.columns:
        return first_readings(stored.drop(DAY), n)
    day = F.when(F.col("first").isNotNull(), F.col(DAY)).otherwise(F.lit(None).cast("int"))
    counted = stored.groupBy("consumer_id", DAY).agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"))
    earlier = Window.partitionBy("consumer_id").orderBy("_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("consumer_id", "_time")
    seen = counted.withColumn("_time", day).withColumn(
        "before", F.sum("rows").over(earlier) - F.sum("rows").over(same))
    wanted = seen.filter(F.col("before") < n).select("consumer_id", DAY)
    # A null consumer is a consumer of its own in a window; it is no key of a join.
    key = (stored["consumer_id"].eqNullSafe(wanted["consumer_id"])) & (stored[DAY] == wanted[DAY])
    return first_readings(stored.join(wanted, key, "left_semi").drop(DAY), n)


def anomalous_readings(flagged: DataFrame) -> DataFrame:
    return flagged.filter("is_anomalous")


def _text(name: str, default: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)).alias(name)


def _rounded(name: str, places: int) -> Column:
    return F.round(F.coalesce(F.col(name), F.lit(0.0)), places).alias(name)


def consumer_detail(readings: DataFrame, results: DataFrame, n: int = READINGS_SHOWN) -> DataFrame:
    """Every consumer's record with its first ``n`` readings, flagged, as a nested list.

    Filter ``results`` to one consumer for a single drill-down; the readings are filtered with
    it. The list of a consumer is bounded by ``n``.
    """
    levels = results.select("consumer_id", "avg_consumption", "std_consumption")
    shown = first_readings(readings.select("consumer_id", "timestamp", "consumption"), n)
    # Flags are columns of rows, in compiled code, before the rows become a list.
    flagged = shown.join(levels, "consumer_id").withColumn("anomaly_reason", reading_reason(
        F.col("consumption"), F.col("timestamp"), F.col("avg_consumption"), F.col("std_consumption")))
    record = F.struct(
        iso_time(F.col("timestamp")).alias("timestamp"), F.round("consumption", 4).alias("consumption"),
        F.col("anomaly_reason").isNotNull().alias("is_anomalous"), "anomaly_reason")
    series = flagged.groupBy("consumer_id").agg(F.sort_array(F.collect_list(
        F.struct("timestamp", F.col("consumption").alias("_exact"), record.alias("record")))).alias("_series"))
    joined = results.join(series, "consumer_id", "left")
    none = F.array().cast(series.schema["_series"].dataType)
    listed = joined.withColumn("timeseries", F.coalesce("_series", none)["record"])
    listed = listed.withColumn("anomalous_records", F.filter("timeseries", lambda r: r["is_anomalous"]))
    have = set(results.columns)
    columns = [
        F.col("consumer_id"), _text("region", "N/A"),
        *[_rounded(c, 3) for c in ("avg_consumption", "std_consumption", "min_consumption", "max_consumption")],
        _rounded("anomaly_score", 4), _text("status", "N/A"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        _text("consumption_profile", "Normal") if "consumption_profile" in have
        else F.lit("Normal").alias("consumption_profile"),
        _text("ai_explanation", "No explanation available") if "ai_explanation" in have
        else F.lit("No explanation available").alias("ai_explanation"),
        *[_rounded(c, 3) if c in have else F.lit(0.0).alias(c) for c in ("night_day_ratio", "weekend_weekday_ratio")],
        F.col("timeseries"), F.col("anomalous_records"),
        F.size("anomalous_records").cast("long").alias("anomalous_record_count"),
        F.size("timeseries").cast("long").alias("total_records"),
    ]
    return listed.select(*columns)


def drill_down(
    readings: DataFrame, results: DataFrame, consumer_id: object, n: int | None = READINGS_SHOWN
) -> DataFrame:
    """One consumer's record; raises when the consumer has no result.

    Without ``n`` all its readings are meant, which are rows with flags and not a nested list.
    """
    mine, found = of_consumer(readings, consumer_id), find_consumer(results, consumer_id)
    return flag_readings(mine, found) if n is None else consumer_detail(mine, found, n)
