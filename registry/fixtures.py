"""Inputs of the registered queries, as SQL over the given tables that both engines run.

The ``events`` table has no missing values, negatives or duplicates, and no regions, so fixed
arithmetic on its ids turns its rows into readings with every kind of consumer and of dirt.
Every event is a reading: consumers of the night, the weekend or the peak have theirs moved there.
``{events}`` is the table: a DataFrame in Spark, a name in the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READINGS = """
SELECT CAST(user_id AS STRING) AS consumer_id,
       CASE WHEN user_id % 11 = 3 AND event_id % 5 <> 0 AND hour(ts) BETWEEN 6 AND 13 THEN ts + INTERVAL '16' HOUR
            WHEN user_id % 11 = 3 AND event_id % 5 <> 0 AND hour(ts) BETWEEN 14 AND 21 THEN ts + INTERVAL '8' HOUR
            WHEN user_id % 11 = 5 AND event_id % 6 <> 0 AND day(ts) % 7 BETWEEN 1 AND 5
                 THEN ts + INTERVAL '1' DAY * CAST(6 - day(ts) % 7 AS INT)
            WHEN user_id % 11 = 7 AND event_id % 6 <> 0 AND NOT (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 18 AND 21)
                 THEN ts + INTERVAL '1' HOUR * CAST(18 - hour(ts) AS INT)
            ELSE ts END AS reading_ts,
       CASE WHEN user_id % 10 = 0 THEN value * 0.1
            WHEN user_id % 11 = 7 THEN value * 2.0
            WHEN event_id % 40 = 0 THEN 0.0
            WHEN event_id % 41 = 0 THEN value * 20.0
            ELSE value END AS consumption,
       CASE user_id % 9 WHEN 0 THEN 'UP' WHEN 1 THEN 'MH' WHEN 2 THEN 'KA' WHEN 3 THEN 'WB'
                        WHEN 4 THEN 'MP' WHEN 5 THEN 'Gujarat' WHEN 6 THEN ' gj ' WHEN 7 THEN 'ZZ'
                        ELSE NULL END AS state,
       CASE user_id % 7 WHEN 0 THEN 'ACORN-A' WHEN 1 THEN 'ACORN-E' WHEN 2 THEN 'acorn-h '
                        WHEN 3 THEN 'ACORN-K' WHEN 4 THEN 'ACORN-Q' WHEN 5 THEN 'Adversity'
                        ELSE NULL END AS acorn_group,
       CASE user_id % 8 WHEN 0 THEN 'AGR' WHEN 1 THEN 'IND' WHEN 2 THEN 'com' WHEN 3 THEN 'Agricultural'
                        WHEN 4 THEN NULL ELSE 'DOM' END AS consumer_type
FROM {events}
"""

RAW = """
SELECT CAST(user_id AS STRING) AS Consumer_ID,
       CASE WHEN event_id % 31 = 0 THEN 'bad' ELSE CAST(ts AS STRING) END AS DateTime,
       CASE WHEN event_id % 17 = 0 THEN 'Null' WHEN event_id % 19 = 0 THEN '-1.5'
            WHEN event_id % 23 = 0 THEN 'abc' WHEN event_id % 29 = 0 THEN ''
            WHEN event_id % 37 = 0 THEN 'nan'
            ELSE CAST(value AS STRING) END AS KWH,
       CASE user_id % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'KA' ELSE NULL END AS State,
       event_type AS Consumer_Type
FROM {events}
UNION ALL
SELECT CAST(user_id AS STRING), CAST(ts AS STRING), CAST(value AS STRING),
       CASE user_id % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'KA' ELSE NULL END, event_type
FROM {events}
WHERE event_id % 13 = 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0
  AND event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0
"""

# The time of every event written in a way that is not ISO, to the second.
TIME_TEXTS = {
    "dayfirst": "concat({day}, '/', {month}, '/', {year}, ' ', {hour}, ':', {minute}, ':', {second})",
    "monthfirst": "concat({month}, '/', {day}, '/', {year}, ' ', {half}, ':', {minute}, ':', {second}, ' ', {ampm})",
    "named": "concat({day}, '-', {name}, '-', {year}, ' ', {hour}, ':', {minute}, ':', {second})",
    "compact": "concat({year}, {month}, {day}, {hour}, {minute}, {second})",
}
_PARTS = {k: f"lpad(CAST({v} AS STRING), 2, '0')" for k, v in {
    "day": "day(ts)", "month": "month(ts)", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)",
    "half": "(hour(ts) + 11) % 12 + 1"}.items()} | {
    "year": "CAST(year(ts) AS STRING)", "ampm": "CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END",
    "name": "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(ts) - 2 AS INT), 3)"}


def timed_sql(form: str) -> str:
    """Raw readings of all events, their times as text of the given form; {events} is the table."""
    return f"""
SELECT CAST(user_id AS STRING) AS Consumer_ID, {TIME_TEXTS[form].format(**_PARTS)} AS DateTime,
       CAST(value AS STRING) AS KWH, CASE user_id % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'KA' ELSE NULL END AS State
FROM {{events}}"""


# A state that changes from reading to reading, on a level at which squares lose the deviation.
REGIONS = """
SELECT CAST(user_id AS STRING) AS consumer_id, ts AS reading_ts, value + 100000000.0 AS consumption,
       CASE event_id % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'KA' ELSE 'MH' END AS state
FROM {events}
"""

# One row per consumer with a score from a formula, so that everything after a model has SQL.
SCORED = """
WITH c AS (SELECT consumer_id, avg(consumption) AS avg_consumption, min(acorn_group) AS acorn_group
           FROM {readings} GROUP BY consumer_id),
     s AS (SELECT avg(avg_consumption) AS m, stddev_pop(avg_consumption) AS sd FROM c)
SELECT c.consumer_id, c.avg_consumption, c.acorn_group,
       -(0.3 + 0.7 * abs(c.avg_consumption - s.m) / (abs(c.avg_consumption - s.m) + s.sd)) AS raw_score
FROM c CROSS JOIN s
"""

# Analysis runs, one per order: the owner is the customer.
RUNS = """
SELECT CAST(o_custkey AS STRING) AS user_id,
       CAST(o_orderkey AS STRING) AS analysis_id,
       concat('readings-', CAST(o_orderkey AS STRING), '.csv') AS filename,
       CAST(floor(o_totalprice) AS BIGINT) AS total_consumers,
       o_orderpriority = '1-URGENT' AS used_autoencoder,
       o_orderdate AS created_at
FROM {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(READINGS, events=table(spark, sf_dir, "events"))
    return found.withColumnRenamed("reading_ts", "timestamp")


def timed(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return spark.sql(timed_sql(form), events=table(spark, sf_dir, "events"))


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.sql(REGIONS, events=table(spark, sf_dir, "events"))
    return found.withColumnRenamed("reading_ts", "timestamp")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW, events=table(spark, sf_dir, "events"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS, orders=table(spark, sf_dir, "orders"))
