import pytest

from wattsift.operators import results as G
from wattsift.sources import reports as R


@pytest.fixture
def results(spark):
    rows = [
        ("a", "X", 0.95, True, "High Risk", 1.23456), ("b", "X", 0.8, True, "Suspicious", None),
        ("c", "Y", 0.6, True, "Review Needed", 3.0), ("d", "Z", 0.1, False, "Normal", 4.0),
        ("e", None, 0.2, True, "Normal", 5.0), ("f", "Y", None, False, "Normal", 6.0),
    ]
    return spark.createDataFrame(
        rows, "consumer_id string, region string, anomaly_score double, is_anomaly boolean, status string, "
        "avg_consumption double")


def ids(df):
    return [r.consumer_id for r in df.collect()]


def test_summary(results):
    r = G.summarize(results).first()
    assert (r.total_consumers, r.anomalies_detected, r.high_risk_count, r.suspicious_count, r.review_needed_count) == (
        6, 4, 1, 1, 1)
    assert r.avg_anomaly_score == pytest.approx(2.65 / 5) and r.max_anomaly_score == 0.95
    assert r.high_risk_zones == ["X", "Y"]
    assert G.summary_counts(results).first().asDict() == {k: r[k] for k in G.summary_counts(results).columns}


def test_summary_of_partial_and_empty_frames(spark, results):
    r = G.summarize(spark.createDataFrame([("a",)], "consumer_id string")).first()
    assert (r.total_consumers, r.anomalies_detected, r.avg_anomaly_score, r.high_risk_zones) == (1, 0, 0.0, [])
    assert G.summarize(results.limit(0)).first().high_risk_zones == []


def test_zones(results):
    assert [tuple(r) for r in G.zone_statistics(results).collect()] == [
        ("X", 2, 0.875, 2, 1.0), ("Y", 2, 0.6, 1, 0.5), ("Z", 1, 0.1, 0, 0.0)]
    assert [tuple(r) for r in G.top_zones(results, 1).collect()] == [("X", 2)]
    assert {tuple(r) for r in G.zone_flag_counts(results).collect()} == {("X", 2), ("Y", 1)}


def test_sorting_puts_missing_last_both_ways(results):
    assert ids(G.sort_results(results)) == ["a", "b", "c", "e", "d", "f"]
    assert ids(G.sort_results(results, descending=False)) == ["d", "e", "c", "b", "a", "f"]
    assert ids(G.sort_results(results, "region", False)) == ["a", "b", "c", "f", "d", "e"]
    assert ids(G.sort_results(results, "no such column")) == list("abcdef")


def test_pages(results):
    assert ids(G.results_page(results, 2, 2)) == ["c", "e"]
    assert ids(G.results_page(results, status="Normal")) == ["e", "d", "f"]
    assert ids(G.results_page(results, status="Normal", region="Y")) == ["f"]
    assert G.page_totals(results, 4).first().asDict() == {"total": 6, "total_pages": 2}
    assert G.page_totals(results, 4, region="none").first().asDict() == {"total": 0, "total_pages": 0}


@pytest.mark.parametrize("page, limit", [(0, 10), (1, 0), (1, 501)])
def test_page_ranges(results, page, limit):
    with pytest.raises(ValueError):
        G.results_page(results, page, limit)


def test_page_rows_fill_what_is_missing(results):
    rows = {r.consumer_id: r for r in G.page_rows(results).collect()}
    assert (rows["a"].avg_consumption, rows["b"].avg_consumption, rows["f"].anomaly_score) == (1.235, 0.0, 0.0)
    assert rows["e"].region == "N/A" and rows["a"].consumption_profile == "Normal"


def test_report(results, folder, spark):
    summary = G.summarize(results)
    tables = R.report_tables(results, summary, top=2)
    assert [tuple(r) for r in tables["summary"].select("metric", "value").collect()] == [
        ("Total Consumers", "6"), ("Anomalies Detected", "4"), ("High Risk Cases", "1"), ("Suspicious Cases", "1"),
        ("Average Anomaly Score", "0.530"), ("High Risk Zones", "X, Y")]
    assert ids(tables["top_consumers"]) == ["a", "b"]
    assert ids(tables["flagged_consumers"]) == ["a", "b", "c", "e", "d", "f"]  # all of them, sorted
    assert R.summary_table(G.summarize(results.limit(0))).collect()[-1].value == "None"
    for fmt in ("csv", "parquet"):
        paths = R.write_report(results, summary, f"{folder}/{fmt}", fmt)
        assert set(paths) == {"summary", "top_consumers", "flagged_consumers", "all_consumers"}
        assert spark.read.format(fmt).option("header", True).load(paths["all_consumers"]).count() == 6
    with pytest.raises(ValueError):
        R.write_report(results, summary, folder, "pdf")


def test_reports_rank_by_the_exact_score(spark):
    close = spark.createDataFrame(
        [("a", 0.90001), ("b", 0.90004)], "consumer_id string, anomaly_score double").selectExpr(
        "*", "'X' AS region", "1.0D AS avg_consumption", "'High Risk' AS status", "true AS is_anomaly")
    tables = R.report_tables(close, G.summarize(close), top=1)
    assert ids(tables["top_consumers"]) == ["b"] and ids(tables["flagged_consumers"]) == ["b", "a"]
    assert tables["top_consumers"].first().anomaly_score == 0.9
