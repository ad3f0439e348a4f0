"""What the plans of single operators must and must not hold."""

import re

from registry.fixtures import readings
from wattsift.operators import cleaning, consumers, readings as single
from wattsift.operators.results import sort_results

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(consumers.region_counts(consumers.aggregate_consumers(
        cleaning.add_region(readings(spark, SMALL), "india_smart_meters"))))
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "event_type" not in read and "props" not in read


def test_filters_on_stored_results_reach_the_scan(spark, folder):
    path = f"{folder}/r"
    spark.range(10).selectExpr("CAST(id AS STRING) AS consumer_id", "'Normal' AS status", "1.0D AS anomaly_score",
                               "2 AS unused").write.parquet(path)
    plan = plan_of(sort_results(spark.read.parquet(path).filter("status = 'Normal'")).select("consumer_id").limit(5))
    assert "EqualTo(status,Normal)" in plan and "unused" not in plan and "TakeOrderedAndProject" in plan


def test_all_readings_are_flagged_with_one_exchange_a_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = readings(spark, SMALL).select("consumer_id", "timestamp", "consumption")
        levels = spark.createDataFrame([("1", 1.0, 1.0)], "consumer_id string, avg_consumption double, std_consumption double")
        plan = plan_of(single.flag_readings(base, levels))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 2 and "SortMergeJoin" in plan


def test_a_hot_consumer_does_not_stay_in_one_task(spark):
    """Adaptive execution splits the readings of a consumer that has nearly all of them."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = spark.range(0, 40_000, 1, 8).selectExpr(
            "IF(id % 100 < 90, 'hot', CAST(id AS STRING)) AS consumer_id",
            "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS timestamp", "rand(1) AS consumption")
        levels = spark.range(0, 400).selectExpr(
            "IF(id = 0, 'hot', CAST(id * 100 + 95 AS STRING)) AS consumer_id", "0.5D AS avg_consumption", "0.1D AS std_consumption")
        flagged = single.flag_readings(hot, levels)
        assert len(flagged.collect()) == 36_000 + 399
        assert "skew=true" in plan_of(flagged)
    finally:
        for key in settings:
            spark.conf.unset(key)
