"""Cleaned readings, stored for drill-down, and stored by consumer and day for work on all of them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.functions.parsing import LAST_DAY
from wattsift.operators.readings import DAY

# Places, before all days, for readings without a time.
UNTIMED = 64


def save_readings(readings: DataFrame, path: str, files: int | None = None) -> None:
    """Write readings sorted by consumer and time.

    Files hold ranges of (consumer, time), so a consumer's readings lie together and row groups
    of other consumers are skipped, while a consumer with a large share spans several files.
    """
    order = [c for c in ("consumer_id", "timestamp") if c in readings.columns]
    ranged = readings.repartitionByRange(files, *order) if files else readings.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def _day(readings: DataFrame) -> Column:
    """Days since 1970; readings without a time are dealt over days that no time has, before all others."""
    spread = -2 * LAST_DAY - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in readings.columns]), F.lit(UNTIMED)).cast("int")
    if "timestamp" not in readings.columns:
        return spread
    return F.coalesce(F.unix_date(F.col("timestamp").cast("date")), spread)


def save_by_day(readings: DataFrame, path: str, buckets: int) -> None:
    """Write readings in buckets of (consumer, day), sorted by them, with one file a bucket.

    A consumer with a third of all readings is in as many buckets as it has days. The number of buckets is written last,
    so a folder that can be opened is whole. A folder that holds readings is not written again.
    """
    spark, keys = readings.sparkSession, ["consumer_id", DAY]
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    placed = readings.withColumn(DAY, _day(readings)).repartition(buckets, *keys)
    placed.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/readings").saveAsTable(name)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")


def open_by_day(spark: SparkSession, path: str) -> DataFrame:
    """Readings that ``save_by_day`` wrote, in this session or another one, with their day as a number."""
    buckets, name = spark.read.parquet(f"{path}/layout").first()[0], _table_name(path)
    if not spark.catalog.tableExists(name):
        found = spark.read.parquet(f"{path}/readings").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found)
        keys, place = f"consumer_id, {DAY}", path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS "
            f"LOCATION '{place}/readings'")
    return spark.table(name)


def _table_name(path: str) -> str:
    return f"readings_by_day_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
