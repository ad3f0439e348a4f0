"""Every query with SQL against DuckDB, and every other query for rows."""

import pytest

import __spark_entry__ as entry_points
from compare import compare
from compare import database as open_database
from registry.oracle import ORACLE as REGISTERED_SQL
from registry.spark_queries import QUERIES as REGISTERED

QUERIES, ORACLE = REGISTERED, REGISTERED_SQL
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def database():
    return open_database(MEDIUM)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    assert compare(QUERIES[name], ORACLE.get(name), spark, database, MEDIUM) is None


def test_entry(spark):
    found = entry_points.entry(spark)
    assert found.columns == ["zone", "consumer_count", "avg_anomaly_score", "anomaly_count", "anomaly_rate"]
    assert found.count() > 0


def test_fixtures_reach_every_label(spark):
    """Otherwise equal results would say little."""
    typed = {r[0] for r in QUERIES["profiles_with_type"](spark, MEDIUM).select("consumption_profile").collect()}
    plain = {r[0] for r in QUERIES["profiles"](spark, MEDIUM).select("consumption_profile").collect()}
    assert typed | plain == {
        "Night Shifter", "Weekend Heavy", "Low Consumer", "High Consumer", "Irregular", "Agricultural Pump",
        "Industrial", "Commercial", "Summer AC Heavy", "Normal"}
    assert {r[0] for r in QUERIES["status_from_score"](spark, MEDIUM).select("status").collect()} == {
        "High Risk", "Suspicious", "Review Needed", "Normal"}
    reasons = QUERIES["reading_flags"](spark, MEDIUM).select("anomaly_reason").distinct().collect()
    assert len(reasons) == 5
    flags = QUERIES["anomaly_flags"](spark, MEDIUM)
    for name in ("low_consumption_flag", "high_variability_flag", "unusual_night_flag"):
        assert {r[0] for r in flags.select(name).collect()} == {0, 1}
