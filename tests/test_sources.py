import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wattsift.operators.readings import consumer_timeseries
from wattsift.operators.results import sort_results, summarize
from wattsift.sources import files, pages, runs
from wattsift.sources.layouts import standard_names
from wattsift.sources.staging import stage, staging_folder, unstage
from wattsift.sources.stored import read_readings, save_readings


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_readings_csv_as_text(spark, folder):
    path = write(f"{folder}/r.csv", 'LCLid,DateTime,KWH/hh,note\nMAC1,2024-01-01 00:00:00,0.10,"a ""b"", c"\nMAC2,,Null,\n')
    df = files.read_readings_csv(spark, path)
    assert dict(df.dtypes) == dict.fromkeys(["LCLid", "DateTime", "KWH/hh", "note"], "string")
    rows = df.orderBy("LCLid").collect()
    assert rows[0]["KWH/hh"] == "0.10" and rows[0]["note"] == 'a "b", c'
    assert rows[1]["DateTime"] is None and rows[1]["KWH/hh"] == "Null"


def test_names_that_differ_only_in_case(spark, folder):
    path = write(f"{folder}/r.csv", "LCLid,kwh,KWH\na,1,2\n")
    df = files.read_readings_csv(spark, path)
    assert df.columns == ["LCLid", "kwh", "KWH2"]
    assert standard_names(df.columns) == ["consumer_id", "consumption", "KWH2"]
    assert tuple(df.first()) == ("a", "1", "2")


def test_bad_csv(spark, folder):
    with pytest.raises(ValueError, match="csv"):
        files.read_readings_csv(spark, f"{folder}/r.txt")
    with pytest.raises(ValueError, match="no rows"):
        files.read_readings_csv(spark, write(f"{folder}/r.csv", "LCLid,kwh\n"))


def test_preview(spark):
    df = spark.createDataFrame([(float(i), "t") for i in range(8)] + [(float("inf"), "t")], "`a/b` double, s string")
    found = files.preview(df.orderBy(F.col("`a/b`").desc()))
    assert found["rows"] == 9 and found["columns"] == ["a/b", "s"]
    assert [r[0] for r in found["preview"].collect()] == [None, 7.0, 6.0, 5.0, 4.0]


def test_sinks(spark, folder):
    df = spark.createDataFrame([("a", True, None), ("b", False, "x,\"y\"")],
                               "Consumer_ID string, Is_Anomaly boolean, Anomaly_Type string")
    files.write_labels_csv(df.withColumn("more", F.lit(1)), f"{folder}/labels.csv")
    back = files.read_readings_csv(spark, f"{folder}/labels.csv")
    assert back.columns == files.LABEL_COLUMNS
    assert {(r[0], r[1], r[2]) for r in back.collect()} == {("a", "true", None), ("b", "false", 'x,"y"')}
    files.write_json(df, f"{folder}/j")
    assert sorted(files.read_json(spark, f"{folder}/j", df.schema).collect()) == sorted(df.collect())


def test_stage_uses_the_shared_folder(spark):
    assert staging_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    found = stage(df, "numbers")
    assert sorted(found.collect()) == sorted(df.collect())
    assert found.inputFiles()[0].removeprefix("file://").startswith(staging_folder(spark))
    assert found.schema == df.schema or {f.dataType for f in found.schema} == {f.dataType for f in df.schema}


def test_unstaged_tables_are_gone(spark):
    import os

    first, second = stage(spark.range(3), "first"), stage(spark.range(4), "second")
    folder = os.path.dirname(first.inputFiles()[0].removeprefix("file://"))
    unstage(first)
    assert not os.path.exists(folder) and second.count() == 4


def test_csv_folder(spark, folder):
    files.write_csv(spark.range(100, numPartitions=4).selectExpr("CAST(id AS STRING) AS a", "'x,y' AS b"), f"{folder}/many")
    found = files.read_readings_csv(spark, f"{folder}/many")
    assert found.count() == 100 and found.columns == ["a", "b"] and found.first().b == "x,y"
    with pytest.raises(ValueError):
        files.read_readings_csv(spark, f"{folder}/x.txt")


@pytest.fixture
def results(spark):
    rows = [(f"c{i:02d}", "X", float(i), i / 30, "Normal" if i % 2 else "High Risk", i > 28, i * 1.5) for i in range(30)]
    return spark.createDataFrame(
        rows, "consumer_id string, region string, avg_consumption double, anomaly_score double, status string, "
        "is_anomaly boolean, cv_consumption double")


def test_run_history(spark, folder, results):
    path = f"{folder}/analyses"
    for user, run in (("u1", "r1"), ("u2", "r2"), ("u1", "r3")):
        runs.save_run(runs.run_row(summarize(results), user, run, "f.csv", 0.05, False), run, path)
    table = runs.read_runs(spark, path)
    mine = runs.user_runs(table, "u1").collect()
    assert [r.analysis_id for r in mine] == ["r3", "r1"]
    assert mine[0].summary.high_risk_zones == ["X"] and mine[0].total_consumers == 30
    assert isinstance(mine[0].created_at, dt.datetime)
    assert runs.run_by_id(table, "r2", "u2").count() == 1 and runs.run_by_id(table, "r2", "u1").count() == 0
    assert len(runs.new_analysis_id()) == 8


def test_stored_consumers(spark, folder, results):
    path = f"{folder}/consumers"
    for _ in range(2):
        runs.save_consumers(results, "0012", path)
    runs.save_consumers(results.limit(3), "other run/1", path)
    table = runs.read_consumers(spark, path)
    assert {tuple(r) for r in table.groupBy("analysis_ref").count().collect()} == {("0012", 30), ("other run/1", 3)}
    page, total = runs.stored_consumers_page(spark, path, "0012", 2, 4, "Normal")
    rows = page.collect()
    assert total == 15 and [r.consumer_id for r in rows] == ["c21", "c19", "c17", "c15"]
    assert rows[0].features == {"cv_consumption": 31.5} and rows[0].analysis_ref == "0012"
    assert runs.stored_consumers_page(spark, path, "other run/1", 1, 2)[1] == 3
    assert runs.page_count(15, 4) == 4


def test_a_page_reads_its_files_only(spark, folder):
    df = spark.range(0, 4000, 1, 8).selectExpr(
        "concat('c', id) AS consumer_id", "IF(id % 7 = 0, NULL, CAST(id % 13 AS DOUBLE)) AS anomaly_score",
        "IF(id % 3 = 0, 'Normal', IF(id = 4, NULL, 'High Risk')) AS status")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages.store_pages(df, folder, descending=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = [tuple(r) for r in sort_results(df, descending=False).collect()]
    files = len(spark.read.parquet(f"{folder}/rows").inputFiles())
    assert files == 8
    for status in (None, "Normal", "none"):
        want = [r for r in whole if status is None or r[2] == status]
        for page, limit in ((1, 10), (2, 130), (9, 130), (31, 130), (1, 5000), (390, 10), (500, 100)):
            found, total = pages.stored_page(spark, folder, page, limit, status)
            assert [tuple(r) for r in found.collect()] == want[(page - 1) * limit : page * limit] and total == len(want)
            if limit <= 130 and found.count():
                assert len(found.inputFiles()) <= 2
                assert "Exchange range" not in found._jdf.queryExecution().executedPlan().toString()
    pages.store_pages(df.limit(0), f"{folder}/none")
    assert pages.stored_page(spark, f"{folder}/none")[1] == 0 and pages.stored_page(spark, f"{folder}/none")[0].count() == 0
    with pytest.raises(ValueError):
        pages.stored_page(spark, folder, 0)


def test_a_run_is_listed_only_with_its_consumers(spark, folder, results, monkeypatch):
    done = SimpleNamespace(analysis_id="r1", results=results, summary=summarize(results), contamination=0.05, used_autoencoder=False)
    other = SimpleNamespace(**(done.__dict__ | {"analysis_id": "r2"}))
    for _ in range(2):
        runs.record_run(done, "u1", "f.csv", folder)

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(runs, "store_sorted", lost)
    with pytest.raises(OSError):
        runs.record_run(other, "u1", "f.csv", folder)
    assert [r.analysis_id for r in runs.user_runs(runs.read_runs(spark, f"{folder}/analyses"), "u1").collect()] == ["r1"]
    assert runs.read_consumers(spark, f"{folder}/consumers").count() == 30
    assert [tuple(r) for r in runs.read_zones(spark, f"{folder}/zones").collect()] == [("X", 1, "r1")]


def test_malformed_lines_are_quarantined(spark, folder):
    lines = ["LCLid,kwh,tstp", "a,1,t", 'b,"1,5",t', "c,2", 'd,3,t,"x,y"', "e,4,t,,", "f,5,", '"g,g,g,g",6,t', "h"]
    path = write(f"{folder}/r.csv", "\n".join(lines) + "\n")
    found = files.read_readings_csv(spark, path)
    assert found.columns == ["LCLid", "kwh", "tstp"]
    assert [tuple(r) for r in found.collect()] == [
        ("a", "1", "t"), ("b", "1,5", "t"), ("c", "2", None), ("f", "5", None), ("g,g,g,g", "6", "t"), ("h", None, None)]
    assert [tuple(r) for r in files.malformed_lines(spark, path).collect()] == [("r.csv", lines[4]), ("r.csv", lines[5])]
    assert found.select("kwh").count() == 6 and [r[0] for r in found.select("tstp").collect()] == ["t", "t", None, None, "t", None]
    with pytest.raises(ValueError, match="more than 3 fields"):
        files.read_readings_csv(spark, path, malformed="raise")
    clean = write(f"{folder}/c.csv", "\n".join(lines[:4]) + "\n")
    assert files.read_readings_csv(spark, clean, malformed="raise").count() == 3
    assert files.malformed_lines(spark, clean).count() == 0


def test_stored_readings_are_clustered_by_consumer(spark, folder):
    rows = spark.range(0, 20_000, 1, 4).selectExpr(
        "IF(id % 2 = 0, 'hot', CONCAT('c', id % 500)) AS consumer_id",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS timestamp", "CAST(id AS DOUBLE) AS consumption")
    path = f"{folder}/readings"
    save_readings(rows, path, files=8)
    stored = read_readings(spark, path)
    assert sorted(stored.collect()) == sorted(rows.collect())
    places = stored.select("consumer_id", F.input_file_name().alias("file")).distinct()
    files = places.groupBy("consumer_id").agg(F.count(F.lit(1)).alias("files"))
    assert files.filter("consumer_id = 'hot'").first().files >= 3  # half of the rows, several files
    assert files.filter("files > 2 AND consumer_id <> 'hot'").count() == 0
    plan = consumer_timeseries(stored, "c7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(consumer_id,c7)" in plan
