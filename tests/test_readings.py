import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattsift.fixed_values import READING_NIGHT, READING_ZERO
from wattsift.operators import readings as D
from wattsift.sources.stored import _table_name, open_by_day, save_by_day

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "consumer_id string, timestamp timestamp_ntz, consumption double"


@pytest.fixture
def readings(spark):
    rows = [("a", T0 + dt.timedelta(hours=h), 1.0 + h / 10) for h in range(48)]
    rows += [("b", T0, 0.0), ("b", T0, 2.0), ("7", T0 + dt.timedelta(hours=2), 9.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture
def results(spark):
    return spark.createDataFrame(
        [("a", "X", 3.0, 1.0, 0.25, True), ("b", None, 1.0, None, 0.123456, None), ("7", "Y", 5.0, 100.0, 1.0, False),
         ("gone", "Y", 1.0, 1.0, 0.0, False)],
        "consumer_id string, region string, avg_consumption double, std_consumption double, anomaly_score double, "
        "is_anomaly boolean").selectExpr(
        "*", "0.1 AS min_consumption", "9.0 AS max_consumption", "'Normal' AS status")


def test_series_in_time_order_by_text_id(readings):
    found = D.consumer_timeseries(readings, "a").collect()
    assert [r.timestamp for r in found] == [T0 + dt.timedelta(hours=h) for h in range(48)]
    assert D.consumer_timeseries(readings, 7).count() == 1


@pytest.mark.parametrize("limit", ["1000", "3"])
def test_first_readings(spark, readings, limit):
    """The same rows within Spark's own group limit and beyond it."""
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        found = D.first_readings(readings, 5).orderBy("consumer_id", "timestamp", "consumption").collect()
    finally:
        spark.conf.set(name, before)
    assert [(r.consumer_id, r.timestamp.hour) for r in found] == [
        ("7", 2), ("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 0)]
    assert found[0].__fields__ == readings.columns


def test_a_hot_consumer_is_limited_before_the_shuffle(readings):
    plan = D.first_readings(readings)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_flags(readings, results):
    found = {(r.consumer_id, r.consumption): r for r in D.flag_readings(readings, results).collect()}
    assert len(found) == 51
    assert found["b", 0.0].anomaly_reason == READING_ZERO and found["b", 0.0].is_anomalous
    assert found["7", 9.0].anomaly_reason == READING_NIGHT
    assert not found["a", 3.0].is_anomalous
    assert D.anomalous_readings(D.flag_readings(readings, results)).filter("anomaly_reason IS NULL").count() == 0


def test_detail(readings, results):
    found = {r.consumer_id: r for r in D.consumer_detail(readings, results, 20).collect()}
    assert found["a"].total_records == 20 and found["a"].timeseries[0].timestamp == "2024-01-01T00:00:00"
    b = found["b"]
    assert (b.region, b.std_consumption, b.anomaly_score, b.is_anomaly) == ("N/A", 0.0, 0.1235, False)
    assert (b.consumption_profile, b.ai_explanation, b.night_day_ratio) == ("Normal", "No explanation available", 0.0)
    assert [r.consumption for r in b.timeseries] == [0.0, 2.0] and b.anomalous_record_count == 1
    assert b.anomalous_records[0].anomaly_reason == READING_ZERO
    assert found["gone"].total_records == 0 and found["gone"].timeseries == []


def test_drill_down(readings, results):
    assert D.drill_down(readings, results, 7).first().total_records == 1
    with pytest.raises(LookupError):
        D.drill_down(readings, results, "nobody")


def test_drill_down_over_all_readings(readings, results):
    assert D.first_readings(readings, None).count() == readings.count()
    rows = D.drill_down(readings, results, "a", n=None).orderBy("timestamp").collect()
    assert len(rows) == 48 and {"is_anomalous", "anomaly_reason"} <= set(rows[0].asDict())
    with pytest.raises(LookupError):
        D.drill_down(readings, results, "nobody", n=None)


def test_drill_down_does_not_sort_all_readings(readings, results):
    plan = D.drill_down(readings, results, "a")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def by_day(rows, folder, buckets=8):
    save_by_day(rows, f"{folder}/by-day", buckets)
    return open_by_day(rows.sparkSession, f"{folder}/by-day")


@pytest.fixture
def untidy(spark):
    """A hot consumer, readings at equal times and without a time or a consumer, repeated rows, and an empty day."""
    rows = [("hot", T0 + dt.timedelta(hours=h % 400), float(h % 7)) for h in range(2000)]
    rows += [(None, T0, 1.0), (None, T0 + dt.timedelta(days=3), 2.0), ("b", None, 3.0), ("b", None, 4.0), ("b", None, None), ("b", T0, 1.0)]
    rows += [("c'", T0 + dt.timedelta(days=d), float(d)) for d in (9, 1, 5, 5, -800)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_readings_by_day_give_the_same_flags(spark, folder, untidy):
    levels = spark.createDataFrame([("hot", 3.0, 0.5), ("b", 1.0, None), ("c'", 4.0, 1.0), ("none", 1.0, 1.0)],
                                   "consumer_id string, avg_consumption double, std_consumption double")
    stored = by_day(untidy, folder)
    found, want = D.flag_by_day(stored, levels), D.flag_readings(untidy, levels)
    assert found.columns == want.columns
    assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
    assert D.flag_by_day(by_day(untidy.limit(0), f"{folder}/none"), levels).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 30, 5000, None])
def test_readings_by_day_give_the_same_first_readings(folder, untidy, n):
    found, want = D.first_by_day(by_day(untidy, folder), n), D.first_readings(untidy, n)
    assert found.columns == want.columns and sorted(found.collect(), key=str) == sorted(want.collect(), key=str)


def test_readings_by_day_do_not_move(spark, folder, untidy):
    """Neither the distinct days nor the join shuffle readings; the hot consumer has several buckets, the table outlives its session."""
    stored = by_day(untidy, folder)
    places = stored.filter("consumer_id = 'hot'").select(F.input_file_name()).distinct().count()
    assert places >= 4
    levels = spark.createDataFrame([("hot", 3.0, 0.5)], "consumer_id string, avg_consumption double, std_consumption double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for reopened in (False, True):
            if reopened:
                spark.sql(f"DROP TABLE {_table_name(folder + '/by-day')}")
                stored = open_by_day(spark, f"{folder}/by-day")
            assert stored.count() == untidy.count()
            plan = D.flag_by_day(stored, levels)._jdf.queryExecution().executedPlan().toString()
            # The days' side moves, by consumer and back by day; above the scan of the readings nothing does.
            assert plan.count("Exchange") == 3 and plan.count("FileScan") == 2 and "SortMergeJoin" in plan
            assert "Exchange" not in plan.split("FileScan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

