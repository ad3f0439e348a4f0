import datetime as dt

import pytest

from wattsift.operators import cleaning as C
from wattsift.operators.consumers import aggregate_consumers
from wattsift.plans.analyze import count_consumers

SCHEMA = "Consumer_ID string, DateTime string, KWH string, State string"
ROWS = [
    ("a", "2024-01-01 00:00:00", "1.0", "UP"),
    ("a", "2024-01-01 00:00:00", "1.0", "UP"),       # copy
    ("a", "2024-01-01 00:00:00", "1.00", "UP"),      # other text, kept
    ("a", "2024-01-01 00:30:00", "Null", "UP"),      # missing
    ("a", "2024-01-01 01:00:00", "", "UP"),          # missing, and the same row as the next
    ("a", "2024-01-01 01:00:00", "NA", "UP"),
    ("a", "2024-01-01 01:30:00", "-1", "UP"),        # negative
    ("a", "never", "2.0", "UP"),                     # no time
    ("a", "never", "Null", "UP"),                    # missing comes first
    ("a", "2024-01-01 02:00:00", "inf", "UP"),       # kept
    ("b", "2024-01-01 02:00:00", "0", None),
    (None, "2024-01-01 02:00:00", "3", "UP"),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_report(raw):
    row = C.clean_report(raw).first().asDict()
    assert row.pop("cleaning_ratio") == pytest.approx(5 / 12)
    assert row == {
        "original_rows": 12, "original_columns": 4, "removed_duplicates": 2, "removed_nulls": 3,
        "removed_negative": 1, "removed_bad_timestamp": 1, "final_rows": 5}


def test_clean(raw):
    found = C.clean_readings(raw)
    assert found.columns == ["consumer_id", "timestamp", "consumption", "state", "region", "_data_format"]
    rows = sorted((r.consumer_id or "", r.timestamp, r.consumption, r.region) for r in found.collect())
    midnight, two = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 2)
    assert rows == [
        ("", two, 3.0, "North India"), ("a", midnight, 1.0, "North India"), ("a", midnight, 1.0, "North India"),
        ("a", two, float("inf"), "North India"), ("b", two, 0.0, "Unknown")]


def test_one_pass_gives_the_same_report_and_consumers(raw):
    counted = C.in_one_order(count_consumers(raw))
    assert C.report_from_counts(counted, 4).first() == C.clean_report(raw).first()
    used = counted.filter("consumer_id IS NOT NULL AND reading_count > 0")
    apart = aggregate_consumers(C.clean_readings(raw))
    assert sorted(used.select(apart.columns).collect()) == sorted(apart.collect())


SLASHED = [
    ("a", "5/10/2024 01:00", "1.0", "UP"), ("a", "5/10/2024 02:00", "2.0", "Delhi"), ("a", "2024-01-09 10:00:00", "3.0", "UP"),
    ("b", "2/3/2024 23:00", "4.0", "UP"), ("b", "3/2/2024 23:00", "5.0", "Delhi"), ("b", "31/12/2024", "6.0", "UP"),
    ("b", "12/31/2024", "7.0", "UP"), ("c", "99/99/2024", "1.0", "UP"), (None, "1/2/2024", "x", "UP"), ("d", "2024-01-01", "1", "UP")]


@pytest.mark.parametrize("rows", [SLASHED, [r for r in SLASHED if not r[1].startswith(("31", "99"))]])
def test_both_orders_of_the_date_in_one_scan(spark, rows):
    """What the dates of the whole column show chooses, and the raw readings are read once."""
    raw = spark.createDataFrame(rows + rows[:2], SCHEMA).repartition(3)
    known = C.find_day_first(C.rename_standard(raw))
    assert known == (len(rows) == len(SLASHED))
    both = count_consumers(raw)
    counted = C.in_one_order(both)
    want = count_consumers(raw, known)
    assert both.count() == 2 * want.count() and counted.columns == want.columns
    assert sorted(counted.collect(), key=str) == sorted(want.collect(), key=str)
    assert C.clean_report(raw).first() == C.clean_report(raw, known).first() == C.report_from_counts(counted, 4).first()
    other = count_consumers(raw, not known)
    assert sorted(other.collect(), key=str) != sorted(want.collect(), key=str)
    assert plan_exchanges(count_consumers(raw)) == plan_exchanges(count_consumers(raw, known)) == 2


def plan_exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = C.clean_report(empty).first()
    assert (row.original_rows, row.final_rows, row.cleaning_ratio) == (0, 0, 0.0)
    assert C.clean_readings(empty).count() == 0


def test_without_timestamp_or_consumption(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x")], "LCLid string, note string")
    assert C.clean_readings(df).collect()[0].asDict() == {
        "consumer_id": "a", "note": "x", "region": "Zone F", "_data_format": "london_smart_meters"}
    assert C.clean_report(df).first().removed_duplicates == 1


def test_typed_input(spark):
    df = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1), 1.5), ("a", dt.datetime(2024, 1, 1), float("nan"))],
        "LCLid string, DateTime timestamp_ntz, kwh double")
    assert [(r.timestamp, r.consumption) for r in C.clean_readings(df).collect()] == [(dt.datetime(2024, 1, 1), 1.5)]


def test_times_outside_the_span_are_no_times(spark):
    rows = [("a", t, "1") for t in ("1600-01-01", "2024-01-01", "2300-01-01", "202401")]
    df = spark.createDataFrame(rows, "LCLid string, DateTime string, kwh string")
    assert [r.timestamp for r in C.clean_readings(df).collect()] == [dt.datetime(2024, 1, 1)]
    assert C.clean_report(df).first().removed_bad_timestamp == 3


def test_many_copies_of_one_row_meet_on_the_map_side(spark):
    """The distinct must aggregate before its shuffle, or one row's copies would be one task's work."""
    raw = spark.range(1000).selectExpr(*[f"'{v}' AS {n}" for n, v in zip(
        ["Consumer_ID", "DateTime", "KWH", "State"], ROWS[0])])
    found = C.distinct_readings(raw)
    assert found.first()[C.COPIES] == 1000 and found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan.split("Exchange")[1]
