import datetime as dt
import math
import statistics

import pytest

from wattsift.operators import cleaning as C
from wattsift.operators import consumers as U
from wattsift.plans.analyze import count_consumers

T0 = dt.datetime(2024, 1, 5, 23)  # a Friday night
SCHEMA = "consumer_id string, timestamp timestamp_ntz, consumption double, region string"


def rows(*specs):
    return [(c, T0 + dt.timedelta(hours=h), v, z) for c, h, v, z in specs]


def one(spark, *specs):
    found = U.aggregate_consumers(spark.createDataFrame(rows(*specs), SCHEMA)).collect()
    assert len(found) == 1
    return found[0]


def test_levels_and_shares(spark):
    r = one(spark, ("a", 0, 1.0, "Z"), ("a", 1, 2.0, "Z"), ("a", 9, 4.0, "Z"), ("a", 15, 9.0, "Z"))
    assert (r.avg_consumption, r.min_consumption, r.max_consumption, r.total_consumption, r.reading_count) == (
        4.0, 1.0, 9.0, 16.0, 4)
    assert r.std_consumption == pytest.approx(statistics.stdev([1, 2, 4, 9]))
    assert (r.night_usage_ratio, r.weekend_readings_ratio, r.peak_usage_ratio) == (0.5, 0.75, 0.25)


def test_single_reading_has_no_deviation(spark):
    assert one(spark, ("a", 0, 1.0, "Z")).std_consumption is None


def test_constant_readings_have_exactly_no_deviation(spark):
    assert one(spark, *[("a", h, 0.1, "Z") for h in range(50)]).std_consumption == 0.0


def test_infinite_reading(spark):
    r = one(spark, ("a", 0, 1.0, "Z"), ("a", 1, float("inf"), "Z"))
    assert r.avg_consumption == math.inf and r.std_consumption is None


def test_missing_consumers_vanish(spark):
    assert one(spark, ("a", 0, 1.0, "Z"), (None, 0, 1.0, "Z")).consumer_id == "a"


def test_first_region_by_time_then_name(spark):
    assert one(spark, ("a", 5, 1.0, "A"), ("a", 2, 1.0, "Y"), ("a", 2, 1.0, "X"), ("a", 0, 1.0, None)).region == "X"
    assert one(spark, ("a", 0, 1.0, None)).region is None


def test_several_regions_pool_into_one_deviation(spark):
    data = [(i, (i * 37 % 11) + 0.5, "XYZ"[i % 3]) for i in range(60)]
    r = one(spark, *[("a", i, v, z) for i, v, z in data])
    assert r.std_consumption == pytest.approx(statistics.stdev([v for _, v, _ in data]), rel=1e-12)
    assert r.avg_consumption == pytest.approx(statistics.mean([v for _, v, _ in data]), rel=1e-12)


def test_without_timestamps(spark):
    df = spark.createDataFrame([("a", 1.0, "Y"), ("a", 3.0, "X")], "consumer_id string, consumption double, region string")
    found = U.aggregate_consumers(df)
    assert "night_usage_ratio" not in found.columns
    assert (found.first().avg_consumption, found.first().region) == (2.0, "X")


def test_readings_are_hash_aggregated(spark):
    df = spark.createDataFrame(rows(("a", 0, 1.0, "Z")), SCHEMA)
    plan = U.aggregate_consumers(df)._jdf.queryExecution().executedPlan().toString()
    # The level that sees readings, below the lowest exchange, must not sort them.
    lowest = plan.split("Exchange")[-1]
    assert "partial_var_pop" in lowest and "SortAggregate" not in plan


def test_readings_cross_the_network_once(spark):
    raw = spark.createDataFrame(
        [("a", "2024-01-05 23:00:00", "1.0", "UP")], "Consumer_ID string, Timestamp string, KWH string, State string")
    plan = count_consumers(raw, False)._jdf.queryExecution().executedPlan().toString()
    # The levels of the consumer aggregate, and the distinct, lie between the one shuffle of readings and that of their days.
    days, readings = plan.split("Exchange hashpartitioning")[1:]
    assert "partial_var_pop" in days and "partial_count" in days and "FileScan" not in days and "SortAggregate" not in plan
    assert readings.startswith("(consumer_id") and "_slot" in readings.split(",")[1] and "Aggregate" not in readings


def test_slots_do_not_change_consumers(spark):
    import random

    rng = random.Random(4)
    stamps = [f"2024-0{rng.randint(1, 3)}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:30:00" for _ in range(150)] + [None, "soon", "2024-01-01"]
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice(stamps), str(rng.choice([1.5, 2, -1, "x", 1e6, None])),
             rng.choice(["UP", "KA", "??", None])) for _ in range(4000)]
    raw = spark.createDataFrame(rows, "Consumer_ID string, Timestamp string, KWH string, State string").repartition(7)
    counted = count_consumers(raw, False).collect()
    assert len({r.consumer_id for r in counted}) == len(counted) == 4
    plain = {r.consumer_id: r for r in U.aggregate_consumers(C.clean_readings(raw, False)).collect()}
    for r in counted:
        if r.consumer_id is None:
            continue
        for name in plain[r.consumer_id].asDict():
            want = plain[r.consumer_id][name]
            assert r[name] == (pytest.approx(want, rel=1e-12) if isinstance(want, float) else want), name
    assert C.report_from_counts(spark.createDataFrame(counted), 4).first() == C.clean_report(raw, False).first()


def test_dataset_statistics_and_region_map(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 10, "X"), ("b", 3.0, 5, "X"), ("c", 5.0, 1, None)],
        "consumer_id string, avg_consumption double, reading_count long, region string")
    r = U.dataset_statistics(df).first()
    assert (r.total_consumers, r.avg_consumption_mean, r.avg_consumption_std, r.total_readings) == (3, 3.0, 2.0, 16)
    assert [tuple(r) for r in U.region_map(df).collect()] == [("X", 2)]
    assert U.dataset_statistics(df.limit(0)).first().avg_consumption_mean == 0.0


def test_feature_summary_takes_numeric_columns(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 3, None), ("c", 8, 2.0)], "k string, n int, x double")
    found = {r.feature: r for r in U.feature_summary(df).collect()}
    assert set(found) == {"n", "x"}
    assert (found["n"].mean, found["n"].median, found["n"].max) == (4.0, 3.0, 8.0)
    assert found["x"].median == 1.5 and found["x"].std == pytest.approx(math.sqrt(0.5))


def test_basic_statistics_use_the_population_deviation(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 9.0)], "x double")
    r = U.basic_statistics(df, "x").first()
    assert (r["mean"], r["min"], r["max"], r["median"]) == (4.0, 1.0, 9.0, 3.0)
    assert r["std"] == pytest.approx(statistics.pstdev([1, 2, 4, 9]))


def test_deviation_over_regions_on_a_high_level(spark):
    specs = [("a", h, 1e8 + h % 2, "X" if h % 2 else "Y") for h in range(1000)]
    assert one(spark, *specs).std_consumption == pytest.approx(statistics.stdev(v for _, _, v, _ in specs))


def test_regions_are_merged_without_a_shuffle_of_their_own(spark):
    plan = U.aggregate_consumers(spark.createDataFrame(rows(("a", 0, 1.0, "X")), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2
