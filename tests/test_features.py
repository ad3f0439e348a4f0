import math

import pytest
from pyspark.sql import functions as F

from wattsift import fixed_values as V
from wattsift.operators import features as E
from wattsift.operators.scaling import fit_scaler

COLUMNS = (
    "consumer_id string, avg_consumption double, std_consumption double, min_consumption double, "
    "max_consumption double, night_usage_ratio double, weekend_readings_ratio double, peak_usage_ratio double")


@pytest.fixture
def consumers(spark):
    rows = [
        ("a", 1.0, 0.5, 0.0, 2.0, 0.25, 0.5, 0.3), ("b", 2.0, None, 2.0, 2.0, 1.0, 0.0, 0.7),
        ("c", 10.0, 30.0, 0.0, 90.0, 0.0, 1.0, 0.61), ("d", 0.0, 0.0, 0.0, 0.0, None, None, None),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def by_id(df):
    return {r.consumer_id: r for r in df.collect()}


def test_ratios(consumers):
    r = by_id(E.ratio_features(consumers))
    assert r["a"].cv_consumption == 0.5 / (1.0 + 1e-6) and r["a"].range_ratio == 2.0 / (1.0 + 1e-6)
    assert r["a"].night_day_ratio == 0.25 / (0.75 + 1e-6) and r["a"].off_peak_ratio == 0.7
    assert r["b"].cv_consumption is None and r["b"].night_day_ratio == pytest.approx(1e6)
    assert r["d"].cv_consumption == 0.0 and r["d"].weekend_weekday_ratio is None


def test_only_available_columns(spark):
    df = spark.createDataFrame([("a", 1.0)], "consumer_id string, avg_consumption double")
    found = E.ratio_features(df)
    assert found.columns == df.columns
    flagged = E.anomaly_flags(found, E.fit_population(found))
    assert E.model_columns(flagged) == ["avg_consumption", "low_consumption_flag"]
    assert E.add_profile(flagged, E.fit_population(found)).first().consumption_profile == "Normal"


def test_flags(consumers):
    df = E.ratio_features(consumers)
    p = E.fit_population(df)
    assert p.mean_avg == 3.25
    r = by_id(E.anomaly_flags(df, p))
    assert [r[i].low_consumption_flag for i in "abcd"] == [0, 0, 0, 1] or p.mean_avg * 0.3 == 0.975
    assert [r[i].low_consumption_flag for i in "abcd"] == [0, 0, 0, 1]
    assert [r[i].high_variability_flag for i in "abcd"] == [0, 0, 1, 0]
    assert [r[i].unusual_night_flag for i in "abcd"] == [0, 1, 0, 0]


def test_later_profiles_win(spark):
    population = E.Population(mean_avg=5.0, q10_avg=1.0, q70_avg=7.0, q90_avg=9.0, q90_cv=2.0, q95_night=1.0)
    schema = ("night_day_ratio double, weekend_weekday_ratio double, avg_consumption double, "
              "cv_consumption double, peak_usage_ratio double")
    cases = {
        "Normal": (1.5, 1.5, 5.0, 2.0, 0.6), "Night Shifter": (1.6, 1.0, 5.0, 1.0, 0.1),
        "Weekend Heavy": (1.6, 1.6, 5.0, 1.0, 0.1), "Low Consumer": (1.6, 1.6, 0.5, 1.0, 0.9),
        "High Consumer": (1.6, 1.6, 9.5, 1.0, 0.1), "Irregular": (1.6, 1.6, 9.5, 3.0, 0.1),
        "Summer AC Heavy": (1.6, 1.6, 9.5, 3.0, 0.7),
    }
    df = spark.createDataFrame(list(cases.values()), schema)
    assert [r[0] for r in E.add_profile(df, population).select("consumption_profile").collect()] == list(cases)
    types = {"AGR": "Agricultural Pump", "agr": "Agricultural Pump", "AGRX": "Irregular", "xAgrix": "Agricultural Pump",
             "IND": "Industrial", "industrial b": "Industrial", "Com": "Commercial", "Commercial": "Commercial",
             "DOM": "Irregular", None: "Irregular"}
    typed = spark.createDataFrame([(t, 9.5, 3.0) for t in types],
                                  "consumer_type string, avg_consumption double, cv_consumption double")
    assert [r[0] for r in E.add_profile(typed, population).select("consumption_profile").collect()] == list(types.values())


def test_vector_is_finite_and_ordered(spark):
    df = spark.createDataFrame(
        [(float("inf"), 1.0, None, 1)], "std_consumption double, avg_consumption double, cv_consumption double, "
        "low_consumption_flag int")
    assert df.select(E.feature_vector(df)).first()[0] == [1.0, 0.0, 0.0, 1.0]
    # The columns themselves keep what they hold.
    assert math.isinf(df.first().std_consumption)


def test_basic_features_fill_with_the_mean_before_infinities(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("b", None, float("inf")), ("c", 3.0, None)],
        "consumer_id string, avg_consumption double, std_consumption double")
    r = by_id(E.prepare_basic_features(df))
    assert [r[i].avg_consumption for i in "abc"] == [1.0, 2.0, 3.0]
    assert [r[i].std_consumption for i in "abc"] == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("method, want", [
    ("standard", [-math.sqrt(1.5), 0.0, math.sqrt(1.5)]), ("minmax", [0.0, 0.5, 1.0])])
def test_scaling(spark, method, want):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (3.0, 0.1)], "x double, c double")
    inputs = [F.col("x"), F.col("c")]
    rows = df.select(*fit_scaler(df, ["x", "c"], inputs, method).columns(inputs)).orderBy("x").collect()
    assert [r.x for r in rows] == pytest.approx(want)
    assert [r.c for r in rows] == [0.0, 0.0, 0.0]


def test_unknown_scaling(spark):
    with pytest.raises(ValueError):
        fit_scaler(spark.range(1), ["id"], [F.col("id")], "robust")


def test_constants_in_order():
    assert V.MODEL_FEATURES[0] == "avg_consumption" and len(V.MODEL_FEATURES) == 10
    assert len(V.BASIC_MODEL_FEATURES) == 7 and len(V.STATE_NAMES) == 35
