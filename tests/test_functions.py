import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift import fixed_values as V
from wattsift.functions import calendar as K
from wattsift.functions import labels as L
from wattsift.functions import zones as Z
from wattsift.functions.parsing import blank_to_null, day_comes_first, finite, read_number, read_timestamp

INF = float("inf")


def test_numbers(values):
    rows = ["1.5", " 2 ", "1e3", ".5", "5.", "+3", "inf", "-Infinity", "1.5d", "2f", "0x1p3", "abc", "nan", "Null", "1,5", None]
    assert values(rows, "string", lambda c: read_number(c, T.StringType())) == [
        1.5, 2.0, 1000.0, 0.5, 5.0, 3.0, INF, -INF, None, None, None, None, None, None, None, None]
    assert values([1.0, float("nan"), INF], "double", lambda c: read_number(c, T.DoubleType())) == [1.0, None, INF]


def test_missing_markers(spark):
    df = spark.createDataFrame([(t,) for t in V.MISSING_TEXT + [" NA ", "Null", "nAn", "0"]], "x string")
    kept = [r[0] for r in df.select(blank_to_null("x").alias("x")).collect()]
    assert kept == [None] * (len(V.MISSING_TEXT) + 1) + ["Null", "nAn", "0"]


def test_timestamps_in_known_formats(values):
    rows = [
        "2024-01-13 10:30:00", "2024-01-13T10:30:00", "2024-01-13 10:30", "2024/01/13 10:30:00", " 2024-01-13 10:30:00.000 ",
        "13-Jan-2024 10:30", "13 January 2024 10:30 am", "Jan 13, 2024 10:30:00 AM", "2024-01-13 10:30 a.m.", "20240113 1030",
        "20240113103000", "20240113T103000"]
    want, none = dt.datetime(2024, 1, 13, 10, 30), ["bad", "2024-02-30", "", "13-Foo-2024", "2024-01-13 13:30 PM", "99999999", None]
    for day_first in (False, True):
        read = lambda c: read_timestamp(c, T.StringType(), day_first)  # noqa: E731, B023
        assert values([*rows, *none], "string", read) == [want] * len(rows) + [None] * len(none)
    half = ["2024-01-13 12:05 AM", "2024-01-13 12:05 PM", "2024-01-13 1:05:07 pm", "20240113"]
    assert values(half, "string", lambda c: read_timestamp(c, T.StringType())) == [
        dt.datetime(2024, 1, 13, 0, 5), dt.datetime(2024, 1, 13, 12, 5), dt.datetime(2024, 1, 13, 13, 5, 7), dt.datetime(2024, 1, 13)]


def test_a_column_has_one_order_of_day_and_month(values):
    rows = ["05/10/2024", "13/10/2024", "10-13-2024 1:30 PM", "5.10.2024 01:30"]
    month = values(rows, "string", lambda c: read_timestamp(c, T.StringType()))
    assert month == [dt.datetime(2024, 5, 10), None, dt.datetime(2024, 10, 13, 13, 30), dt.datetime(2024, 5, 10, 1, 30)]
    day = values(rows, "string", lambda c: read_timestamp(c, T.StringType(), True))
    assert day == [dt.datetime(2024, 10, 5), dt.datetime(2024, 10, 13), None, dt.datetime(2024, 10, 5, 1, 30)]


def test_the_column_shows_its_order(spark):
    def found(*rows):
        return spark.createDataFrame([(r,) for r in rows], "t string").agg(day_comes_first(F.col("t"))).first()[0]

    assert found("05/10/2024", " 13/10/2024", None) and not found("05/10/2024", "10/13/2024", "2024-13-01") and not found()


def test_timestamps_do_not_depend_on_the_session_zone(spark, values):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # This hour does not exist there.
        assert values(["2024-03-10 02:30:00", "03/10/2024 02:30"], "string",
                      lambda c: read_timestamp(c, T.StringType())) == [dt.datetime(2024, 3, 10, 2, 30)] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_finite(values):
    assert values([1.0, float("nan"), INF, -INF, None], "double", finite) == [1.0, None, None, None, None]


def test_acorn_zones(values):
    rows = ["ACORN-A", "acorn-e ", "x ACORN-H y", "ACORN-L", "ACORN-Q", "Affluent", "ACORN-U", "ACORN-", "", None]
    assert values(rows, "string", Z.acorn_zone) == [
        "Zone A", "Zone B", "Zone C", "Zone D", "Zone E", "Zone F", "Zone F", "Zone F", "Zone F", "Zone F"]
    assert values([m for ms in V.ACORN_ZONES.values() for m in ms], "string", Z.acorn_zone) == [
        z for z, ms in V.ACORN_ZONES.items() for _ in ms]


def _zone_by_loop(text):
    """Brute force over the whole rule."""
    if text is None:
        return "Unknown"
    text = text.strip().upper()
    hits = [z for z, codes in V.STATE_ZONES.items() if text in codes]
    hits += [z for z, codes in V.STATE_ZONES.items() if any(c in text or text in c for c in codes)]
    return hits[0] if hits else "Unknown"


def test_state_zones(values):
    rows = ["UP", " gj ", "Maharashtra", "Gujarat", "Delhi", "", " ", "U", "P", "ZZ", "up", "\tMH\n", "CG", "Goa", "XUPX", None]
    rows += [c for codes in V.STATE_ZONES.values() for c in codes] + list(V.STATE_NAMES.values())
    found = values(rows, "string", Z.state_zone)
    assert found == [_zone_by_loop(t) for t in rows]
    assert found[:7] == ["North India", "West India", "East India", "East India", "Unknown", "North India", "North India"]


def test_state_names(values):
    assert values(["UP", " ka", "zz", None], "string", Z.state_name) == ["Uttar Pradesh", "Karnataka", "ZZ", "Unknown"]
    assert values(list(V.STATE_NAMES), "string", Z.state_name) == list(V.STATE_NAMES.values())


def test_region_sources():
    assert Z.region_source(["discom", "state"], V.STATE_LAYOUT) == "state"
    assert Z.region_source(["discom"], V.STATE_LAYOUT) == "discom"
    assert Z.region_source(["acorn_group"], V.STATE_LAYOUT) is None
    assert Z.region_source(["acorn_group"], V.ACORN_LAYOUT) == "acorn_group"


def test_region_without_source(spark):
    one = spark.range(1)
    assert one.select(Z.region_of(None, V.STATE_LAYOUT)).first()[0] == "Unknown"
    assert one.select(Z.region_of(None, V.ACORN_LAYOUT)).first()[0] == "Zone F"
    d = spark.createDataFrame([("UPPCL",)], "discom string")
    assert d.select(Z.region_of("discom", V.STATE_LAYOUT)).first()[0] == "UPPCL"


def test_hours(values):
    hours = list(range(24))
    assert values(hours, "int", K.time_of_day) == (
        ["night"] * 6 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 4 + ["night"] * 2)
    assert [h for h, yes in zip(hours, values(hours, "int", K.is_peak_hour)) if yes] == [7, 8, 9, 18, 19, 20, 21]
    assert [h for h, yes in zip(hours, values(hours, "int", K.is_night_hour)) if yes] == [0, 1, 2, 3, 4, 5, 22, 23]


def test_days_and_display(values):
    days = [dt.datetime(2024, 1, d, 1, 2, 3) for d in range(1, 8)]  # Monday to Sunday
    assert values(days, "timestamp_ntz", K.day_of_week) == [0, 1, 2, 3, 4, 5, 6]
    assert values(days, "timestamp_ntz", K.is_weekend) == [False] * 5 + [True] * 2
    assert values(days[:1], "timestamp_ntz", K.display_time) == ["2024-01-01 01:02:03"]
    both = [dt.datetime(2024, 1, 1, 1, 2, 3), dt.datetime(2024, 1, 1, 1, 2, 3, 4500), dt.datetime(2024, 1, 1, 1, 2, 4)]
    assert values(both, "timestamp_ntz", K.iso_time) == [t.isoformat() for t in both]


def test_status_and_color(values):
    scores = [1.0, 0.9, 0.8999, 0.75, 0.7499, 0.5, 0.4999, 0.0, None]
    assert values(scores, "double", L.status_of) == [
        "High Risk", "High Risk", "Suspicious", "Suspicious", "Review Needed", "Review Needed", "Normal", "Normal", "Normal"]
    assert values(["High Risk", "Normal", "?", None], "string", L.status_color) == [
        "#DC2626", "#10B981", "#6B7280", "#6B7280"]


@pytest.mark.parametrize("row, bound, want", [
    ((0.95, 1.0, 9.0, 1.0, 1.0), False, [V.SAY_IRREGULAR, V.SAY_LOW]),
    ((0.8, 2.5, 9.0, 1.0, 1.0), False, [V.SAY_SUSPICIOUS, V.SAY_NIGHT_HIGH, V.SAY_LOW]),
    ((0.1, 0.1, 9.0, 1.0, 1.0), False, [V.SAY_NIGHT_LOW, V.SAY_LOW]),
    ((0.1, 1.0, 9.0, 1.0, 1.0), True, [V.SAY_DEFAULT]),
    ((0.1, 1.0, 0.4, 1.0, 0.5), True, [V.SAY_LOW]),
    ((0.1, 1.0, 0.4, 0.2, 0.9), True, [V.SAY_WEEKEND_LOW, V.SAY_VARIABLE, V.SAY_LOW]),
    ((0.1, 1.0, 2.0, 2.5, 1.0), True, [V.SAY_WEEKEND_HIGH]),
    ((0.1, None, None, None, None), True, [V.SAY_DEFAULT]),
])
def test_explanations(spark, row, bound, want):
    df = spark.createDataFrame([row], "s double, n double, a double, w double, d double")
    more = [F.col("a"), F.col("w"), F.col("d")] if bound else []
    assert df.select(L.explanation(F.col("s"), F.col("n"), *more)).first()[0] == " ".join(want)


def test_reading_reasons(spark):
    def reason(consumption, hour, avg, std):
        df = spark.createDataFrame(
            [(consumption, dt.datetime(2024, 1, 1, hour), avg, std)], "c double, t timestamp_ntz, a double, s double")
        return df.select(L.reading_reason(F.col("c"), F.col("t"), F.col("a"), F.col("s"))).first()[0]

    assert reason(0.005, 3, 1.0, 0.1) == V.READING_ZERO
    assert reason(0.006, 3, 0.01, 0.1) == V.READING_LOW  # below 0.01 although above a tenth of the average
    assert reason(0.09, 3, 1.0, 0.1) == V.READING_LOW
    assert reason(0.1, 3, 1.0, 0.1) is None
    assert reason(1.31, 12, 1.0, 0.1) == V.READING_SPIKE
    assert reason(2.9, 12, 1.0, None) is None and reason(3.1, 12, 1.0, None) == V.READING_SPIKE
    assert reason(3.1, 12, 1.0, 0.0) == V.READING_SPIKE
    for hour, flagged in [(0, False), (1, True), (5, True), (6, False), (21, False), (22, False)]:
        assert (reason(1.6, hour, 1.0, 1.0) == V.READING_NIGHT) is flagged
    assert reason(5.0, 3, 1.0, 1.0) == V.READING_SPIKE  # the spike comes first
