import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattsift import analyze
from wattsift.fixed_values import SAY_LOW
from wattsift.operators.cleaning import clean_report
from wattsift.operators.results import zone_flag_counts
from wattsift.sources import runs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def raw(spark):
    """Forty steady households and two that are not."""
    random = np.random.default_rng(0)
    rows = []
    for c in range(42):
        level = 0.01 if c == 40 else 30.0 if c == 41 else 1.0
        for h in range(96):
            rows.append((f"MAC{c:06d}", str(T0 + dt.timedelta(minutes=30 * h)), f"{level * random.uniform(0.5, 1.5):.4f}",
                         "ACORN-A" if c % 2 else "ACORN-Q"))
    return spark.createDataFrame(rows, "LCLid string, DateTime string, `KWH/hh` string, Acorn_grouped string")


@pytest.fixture(scope="module")
def plain(raw):
    return analyze(raw)


def test_results(plain):
    rows = {r.consumer_id: r for r in plain.results.collect()}
    assert len(rows) == 42 and len(plain.analysis_id) == 8
    top = sorted(rows, key=lambda c: -rows[c].anomaly_score)[:2]
    assert set(top) == {"MAC000040", "MAC000041"}
    assert rows["MAC000041"].status == "High Risk" and rows["MAC000041"].is_anomaly
    assert rows["MAC000041"].consumption_profile == "High Consumer"
    assert {r.region for r in rows.values()} == {"Zone A", "Zone E"}
    assert all(SAY_LOW in r.ai_explanation for r in rows.values())  # said of every row with the defaults
    assert {r.anomaly_score for r in rows.values()} >= {0.0, 1.0}


def test_summary_and_report(raw, plain):
    s = plain.summary.first()
    assert s.total_consumers == 42 and s.anomalies_detected == 3
    assert sum(r.flagged for r in zone_flag_counts(plain.results).collect()) == 3
    assert plain.cleaning_report.first() == clean_report(raw).first()


def test_recorded_run(spark, plain, folder):
    runs.record_run(plain, "u1", "readings.csv", folder)
    row = runs.user_runs(runs.read_runs(spark, f"{folder}/analyses"), "u1").first()
    assert (row.analysis_id, row.filename, row.anomalies_detected) == (plain.analysis_id, "readings.csv", 3)
    page, total = runs.stored_consumers_page(spark, f"{folder}/consumers", plain.analysis_id, limit=3)
    top = page.collect()
    assert total == 42 and top[0].anomaly_score == 1.0 and "cv_consumption" in top[0].features


def test_autoencoder_changes_score_and_status_but_not_the_flag(raw, plain):
    both = analyze(raw, use_autoencoder=True, autoencoder_params={"epochs": 5}).results
    joined = both.alias("b").join(plain.results.alias("p"), "consumer_id")
    assert joined.filter("b.is_anomaly <> p.is_anomaly").count() == 0
    off = F.abs(F.col("b.anomaly_score") - (0.6 * F.col("p.anomaly_score") + 0.4 * F.col("b.ae_anomaly_score")))
    assert joined.agg(F.max(off)).first()[0] < 1e-12
    assert both.filter("ensemble_score <> anomaly_score").count() == 0
    assert both.filter("ae_is_anomaly").count() == 3


def test_bound_columns(raw):
    found = analyze(raw, bind="columns").results.filter(F.col("ai_explanation").contains(SAY_LOW))
    assert [r.consumer_id for r in found.collect()] == ["MAC000040"]


def test_same_seed_same_results(raw, plain):
    again = analyze(raw.repartition(13)).results
    want = {r.consumer_id: (pytest.approx(r.anomaly_score), r.status, r.is_anomaly) for r in plain.results.collect()}
    assert {r.consumer_id: (r.anomaly_score, r.status, r.is_anomaly) for r in again.collect()} == want


def test_refusals(spark, raw):
    with pytest.raises(ValueError, match="contamination"):
        analyze(raw, contamination=0.7)
    with pytest.raises(ValueError, match="bind"):
        analyze(raw, bind="other")
    with pytest.raises(ValueError, match="consumption"):
        analyze(spark.createDataFrame([("a",)], "LCLid string"))
    with pytest.raises(ValueError, match="no valid readings"):
        analyze(raw.withColumn("KWH/hh", F.lit("Null")))
    with pytest.raises(ValueError, match="no consumers"):
        analyze(raw.withColumn("LCLid", F.lit(None).cast("string")))


def test_readings_without_time(spark):
    raw = spark.createDataFrame([(f"c{i % 7}", str(i)) for i in range(70)], "LCLid string, kwh string")
    found = analyze(raw).results
    assert found.count() == 7 and "night_day_ratio" not in found.columns


def test_close_deletes_what_was_staged(raw):
    import os

    found = analyze(raw)
    paths = [f.removeprefix("file://") for df in found.staged for f in df.inputFiles()]
    assert paths and all(map(os.path.exists, paths)) and found.forest.offset is not None
    found.close()
    assert not any(map(os.path.exists, paths))
