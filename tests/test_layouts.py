import pytest

from wattsift.fixed_values import ACORN_LAYOUT, STATE_LAYOUT
from wattsift.sources.layouts import (
    check_columns, detect_layout, rename_standard, standard_names, standardize_columns,
)


def test_layout_by_markers_inside_names():
    assert detect_layout(["Consumer_ID", "State", "DISCOM"]) == STATE_LAYOUT
    assert detect_layout(["LCLid", "stdorToU", "Acorn_grouped"]) == ACORN_LAYOUT
    assert detect_layout(["id", "electricity"]) == STATE_LAYOUT  # holds "city"
    assert detect_layout(["id", "statement"]) == STATE_LAYOUT  # holds "state"
    assert detect_layout(["state", "acorn"]) == ACORN_LAYOUT  # tie
    assert detect_layout(["a", "b"]) == ACORN_LAYOUT


def test_each_marker_counts_once():
    assert detect_layout(["state", "state_2", "acorn", "lclid"]) == ACORN_LAYOUT


def test_first_matching_column_in_frame_order():
    names = standard_names(["Meter_Number", "Consumer_ID", "DateTime", " KWH ", "State", "Tariff_Category"])
    assert names == ["consumer_id", "Consumer_ID", "timestamp", "consumption", "state", "tariff"]


def test_london_columns():
    assert standard_names(["LCLid", "DateTime", "KWH/hh", "Acorn_grouped", "stdorToU"]) == [
        "consumer_id", "timestamp", "consumption", "acorn_group", "stdorToU"]


def test_two_columns_with_one_standard_name_raise(spark):
    df = spark.createDataFrame([("a", "1", "2", "UP")], "id string, KWH string, consumption string, state string")
    with pytest.raises(ValueError, match="consumption"):
        rename_standard(df)


def test_standardize_adds_the_layout(spark):
    df = spark.createDataFrame([("a", "1")], "`LCLid` string, `KWH/hh` string")
    row = standardize_columns(df).first()
    assert row.asDict() == {"consumer_id": "a", "consumption": "1", "_data_format": ACORN_LAYOUT}


def test_check_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert check_columns(df, ["a", "c"]) == {"valid": False, "missing": ["c"], "available": ["a", "b"]}
    assert check_columns(df, ["b"])["valid"]
