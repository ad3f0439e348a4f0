import pytest
from pyspark.sql import functions as F

from wattsift.operators import scoring as S


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(
        [(f"c{i}", -0.3 - i / 100) for i in range(40)], "consumer_id string, raw_score double")


def test_scores_reach_both_ends(scores):
    found = [r[0] for r in S.normalize_scores(scores, "raw_score").orderBy("raw_score").select("anomaly_score").collect()]
    assert found[0] == 1.0 and found[-1] == 0.0 and sorted(found, reverse=True) == found


def test_equal_scores_become_zero(spark):
    df = spark.createDataFrame([("a", -0.5), ("b", -0.5)], "consumer_id string, raw_score double")
    assert [r.anomaly_score for r in S.normalize_scores(df, "raw_score").collect()] == [0.0, 0.0]
    assert not any(r.is_anomaly for r in S.label_by_contamination(df, "raw_score").collect())  # strictly below


def test_labels(scores):
    flagged = S.label_by_contamination(scores, "raw_score", 0.1).filter("is_anomaly")
    assert sorted(r.consumer_id for r in flagged.collect()) == ["c36", "c37", "c38", "c39"]
    assert S.outlier_label(scores, "raw_score", 0.1).agg(F.sum("label")).first()[0] == 36 - 4
    one = S.label_by_threshold(S.normalize_scores(scores, "raw_score"), "anomaly_score", 1.0).filter("is_anomaly")
    assert [r.consumer_id for r in one.collect()] == ["c39"]  # at the threshold counts


@pytest.mark.parametrize("bad", [0, -0.1, 0.51, 1])
def test_contamination_range(scores, bad):
    with pytest.raises(ValueError):
        S.label_by_contamination(scores, "raw_score", bad)


def test_errors(spark):
    df = spark.createDataFrame([(f"c{i}", float(i)) for i in range(21)], "consumer_id string, e double")
    found = S.label_errors(df, "e", S.error_threshold(df, "e")).orderBy("e").collect()
    assert [r.ae_anomaly_score for r in found] == [i / 20 for i in range(21)]
    assert [r.consumer_id for r in found if r.ae_is_anomaly] == ["c19", "c20"]


def test_blend(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "consumer_id string, anomaly_score double")
    b = spark.createDataFrame([("y", 1.0), ("x", 0.0)], "consumer_id string, ae_anomaly_score double")
    found = {r.consumer_id: r.ensemble_score for r in S.blend_scores(a, b).collect()}
    assert found == {"x": pytest.approx(0.6), "y": pytest.approx(0.7)}
