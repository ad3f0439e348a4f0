"""The registered queries. Each reads the given tables whole and returns a DataFrame."""

from __future__ import annotations

import uuid
from dataclasses import replace
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry.fixtures import moving, raw, readings, runs, timed
from wattsift.fixed_values import ACORN_LAYOUT, STATE_LAYOUT
from wattsift.functions.calendar import (
    day_of_week, display_time, is_night_hour, is_peak_hour, is_weekend, iso_time, time_of_day,
)
from wattsift.functions.labels import explanation, status_color, status_of
from wattsift.functions.zones import acorn_zone, state_name, state_zone
from wattsift.operators import autoencoder as A
from wattsift.operators import cleaning as C
from wattsift.operators import consumers as U
from wattsift.operators import features as E
from wattsift.operators import forest as M
from wattsift.operators import readings as D
from wattsift.operators import results as G
from wattsift.operators import scoring as S
from wattsift.operators.quantiles import exact_quantiles
from wattsift.operators.scaling import fit_scaler
from wattsift.plans.analyze import analyze
from wattsift.sources.files import (
    malformed_lines, preview, preview_rows, read_json, read_readings_csv, write_csv, write_json, write_labels_csv,
)
from wattsift.sources.layouts import standardize_columns
from wattsift.sources.pages import store_pages, stored_page
from wattsift.sources.reports import report_tables, summary_table
from wattsift.sources.runs import (
    read_consumers, read_runs, record_run, run_by_id, run_row, save_consumers, save_run, stored_consumers_page, user_runs,
)
from wattsift.sources.staging import stage, staging_folder
from wattsift.sources.stored import open_by_day, read_readings, save_by_day, save_readings

CONTAMINATION = 0.05
THRESHOLD = 0.6
FIRST_READINGS = 20
PAGE, PAGE_ROWS = 2, 20
PLANTED = 5


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since two engines add them up in different orders; times as text.

    A mean over 32 readings can end exactly between two rounded values, where the order of the
    sum would decide; both engines therefore add the same billionth first.
    """
    return df.select(*[
        F.round(F.col(f.name) + 1e-9, places).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))
        else F.col(f.name)
        for f in df.schema
    ])


def scratch(spark: SparkSession, label: str) -> str:
    return f"{staging_folder(spark)}/wattsift/{label}-{uuid.uuid4().hex}"


# --- shared inputs ------------------------------------------------------------------------


def consumers(spark: SparkSession, sf: str, layout: str = STATE_LAYOUT) -> DataFrame:
    return U.aggregate_consumers(C.add_region(readings(spark, sf), layout))


def staged_features(spark: SparkSession, sf: str, layout: str = STATE_LAYOUT) -> DataFrame:
    return stage(E.ratio_features(consumers(spark, sf, layout)), "features")


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    features = staged_features(spark, sf)
    return E.anomaly_flags(features, E.fit_population(features))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Features by ACORN zone, with a raw score from a formula over the average."""
    features = staged_features(spark, sf, ACORN_LAYOUT)
    mean, spread = features.agg(F.avg("avg_consumption"), F.stddev_pop("avg_consumption")).first()
    away = F.abs(F.col("avg_consumption") - F.lit(mean))
    return features.withColumn("raw_score", -(F.lit(0.3) + F.lit(0.7) * away / (away + F.lit(spread))))


def results(spark: SparkSession, sf: str) -> DataFrame:
    base = scored(spark, sf)
    labelled = S.label_by_contamination(S.normalize_scores(base, "raw_score"), "raw_score", CONTAMINATION)
    labelled = labelled.withColumn("status", status_of(F.col("anomaly_score")))
    told = explanation(F.col("anomaly_score"), F.col("night_day_ratio"))
    return E.add_profile(labelled.withColumn("ai_explanation", told), E.fit_population(base))


# --- layout and cleaning ------------------------------------------------------------------


def q_standardize_columns(spark, sf):
    return standardize_columns(raw(spark, sf))


def q_upload_preview(spark, sf):
    return preview_rows(raw(spark, sf))


def q_upload_preview_ordered(spark, sf):
    """Rows in all, column names, and the first five rows in order of their columns."""
    whole = preview(raw(spark, sf))
    return preview_rows(raw(spark, sf), ordered=True).select(
        F.lit(whole["rows"]).alias("rows"), F.lit(",".join(whole["columns"])).alias("columns"), "*")


def q_dedup_rows(spark, sf):
    return C.distinct_readings(raw(spark, sf)).withColumnRenamed(C.COPIES, "copies")


def q_clean_readings(spark, sf):
    return rounded(C.clean_readings(raw(spark, sf)))


def _cleaned(spark, sf, form):
    return rounded(C.clean_readings(timed(spark, sf, form)).drop("_data_format"))


def q_clean_readings_dayfirst(spark, sf):
    return _cleaned(spark, sf, "dayfirst")


def q_clean_readings_monthfirst(spark, sf):
    return _cleaned(spark, sf, "monthfirst")


def q_clean_readings_named(spark, sf):
    return _cleaned(spark, sf, "named")


def q_clean_readings_compact(spark, sf):
    return _cleaned(spark, sf, "compact")


def q_clean_report(spark, sf):
    return rounded(C.clean_report(raw(spark, sf)))


# --- zones, names, clock --------------------------------------------------------------------


def q_zone_from_acorn(spark, sf):
    return readings(spark, sf).groupBy("acorn_group", acorn_zone(F.col("acorn_group")).alias("zone")).agg(
        F.count(F.lit(1)).alias("readings"))


def q_zone_from_state(spark, sf):
    return readings(spark, sf).groupBy("state", state_zone(F.col("state")).alias("zone")).agg(
        F.count(F.lit(1)).alias("readings"))


def q_state_name(spark, sf):
    return readings(spark, sf).groupBy("state", state_name(F.col("state")).alias("name")).agg(
        F.count(F.lit(1)).alias("readings"))


def q_region_by_layout(spark, sf):
    base = readings(spark, sf)
    both = C.add_region(C.add_region(base, STATE_LAYOUT).withColumnRenamed("region", "state_region"), ACORN_LAYOUT)
    bare = C.add_region(C.add_region(both.withColumnRenamed("region", "acorn_region").drop("state", "acorn_group"),
                                     STATE_LAYOUT).withColumnRenamed("region", "bare_state_region"), ACORN_LAYOUT)
    return bare.withColumnRenamed("region", "bare_acorn_region").groupBy(
        "state_region", "acorn_region", "bare_state_region", "bare_acorn_region").agg(
        F.count(F.lit(1)).alias("readings"))


def q_time_of_day(spark, sf):
    hour = F.hour("timestamp")
    return readings(spark, sf).groupBy(hour.alias("hour"), time_of_day(hour).alias("part")).agg(
        F.count(F.lit(1)).alias("readings"))


def q_calendar_flags(spark, sf):
    ts, hour = F.col("timestamp"), F.hour("timestamp")
    return readings(spark, sf).groupBy(
        hour.alias("hour"), day_of_week(ts).alias("day_of_week"), is_weekend(ts).alias("is_weekend"),
        is_night_hour(hour).alias("is_night"), is_peak_hour(hour).alias("is_peak"),
    ).agg(F.count(F.lit(1)).alias("readings"))


def q_format_ts(spark, sf):
    ts = F.col("timestamp")
    return readings(spark, sf).select(
        "consumer_id", display_time(ts).alias("display"), iso_time(ts).alias("iso"))


# --- consumers ------------------------------------------------------------------------------


def q_consumer_aggregate(spark, sf):
    return rounded(consumers(spark, sf))


def q_consumer_aggregate_regions(spark, sf):
    """Deviations of consumers whose state changes, at a level where differences of squares fail."""
    found = U.aggregate_consumers(C.add_region(moving(spark, sf), STATE_LAYOUT))
    return rounded(found.select("consumer_id", "std_consumption", "reading_count", "region"), 4)


def q_dataset_statistics(spark, sf):
    return rounded(U.dataset_statistics(consumers(spark, sf)))


def q_region_counts(spark, sf):
    return U.region_counts(consumers(spark, sf))


def q_region_map(spark, sf):
    return U.region_map(consumers(spark, sf))


def q_feature_summary(spark, sf):
    return rounded(U.feature_summary(staged_features(spark, sf)))


def q_basic_statistics(spark, sf):
    # A scan of one column, which Parquet prunes: nothing is gained by a copy.
    return rounded(U.basic_statistics(readings(spark, sf).select("consumption"), "consumption"))


# --- features -------------------------------------------------------------------------------


def q_variability_features(spark, sf):
    return rounded(E.variability_features(consumers(spark, sf)).select(
        "consumer_id", "cv_consumption", "range_consumption", "range_ratio"))


def q_behavior_features(spark, sf):
    return rounded(E.behavior_features(consumers(spark, sf)).select(
        "consumer_id", "night_day_ratio", "weekend_weekday_ratio", "off_peak_ratio"))


def q_population_thresholds(spark, sf):
    found = E.fit_population(staged_features(spark, sf))
    return rounded(spark.createDataFrame(
        [(k, v) for k, v in sorted(found.__dict__.items())], "name string, value double"))


def q_quantiles_counted(spark, sf):
    """The population's quantiles by themselves."""
    wanted = {
        "q10_avg": ("avg_consumption", 0.1), "q70_avg": ("avg_consumption", 0.7), "q90_avg": ("avg_consumption", 0.9),
        "q90_cv": ("cv_consumption", 0.9), "q95_night": ("night_day_ratio", 0.95)}
    found = exact_quantiles(staged_features(spark, sf), wanted)
    return rounded(spark.createDataFrame(sorted(found.items()), "name string, value double"))


def q_anomaly_flags(spark, sf):
    return flagged(spark, sf).select(
        "consumer_id", "low_consumption_flag", "high_variability_flag", "unusual_night_flag")


def q_feature_vector(spark, sf):
    df = flagged(spark, sf)
    return rounded(df.select("consumer_id", *E.model_inputs(df)))


def q_prepare_features(spark, sf):
    return rounded(E.prepare_basic_features(stage(consumers(spark, sf), "consumers")))


def _scaled(spark, sf, method):
    df = flagged(spark, sf)
    names, inputs = E.model_columns(df), E.model_inputs(df)
    return rounded(df.select("consumer_id", *fit_scaler(df, names, inputs, method).columns(inputs)))


def q_scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


def q_scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


def q_profiles(spark, sf):
    df = staged_features(spark, sf)
    return E.add_profile(df, E.fit_population(df)).select("consumer_id", "consumption_profile")


def q_profiles_with_type(spark, sf):
    # A text buffer would sort all readings; the distinct pairs are few.
    pairs = readings(spark, sf).select("consumer_id", "consumer_type").distinct()
    kinds = pairs.groupBy("consumer_id").agg(F.max("consumer_type").alias("consumer_type"))
    df = staged_features(spark, sf)
    return E.add_profile(df.join(kinds, "consumer_id"), E.fit_population(df)).select(
        "consumer_id", "consumer_type", "consumption_profile")


# --- single readings ------------------------------------------------------------------------


def q_reading_flags(spark, sf):
    base = readings(spark, sf).select("consumer_id", "timestamp", "consumption")
    return rounded(D.flag_readings(base, consumers(spark, sf)))


def q_anomalous_readings(spark, sf):
    base = readings(spark, sf).select("consumer_id", "timestamp", "consumption")
    return rounded(D.anomalous_readings(D.flag_readings(base, consumers(spark, sf))))


def q_reading_counts(spark, sf):
    base = readings(spark, sf).select("consumer_id", "timestamp", "consumption")
    return D.flag_readings(base, consumers(spark, sf)).groupBy("consumer_id").agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if("is_anomalous").alias("anomalous_record_count"))


def q_first_n_readings(spark, sf):
    base = readings(spark, sf).select("consumer_id", "timestamp", "consumption")
    return rounded(D.first_readings(base, FIRST_READINGS))


def q_all_readings_flagged_by_consumer(spark, sf):
    """All readings, without a limit, of the consumer with the highest score."""
    found = results(spark, sf)
    top = found.orderBy(F.desc("anomaly_score"), "consumer_id").first()["consumer_id"]
    shown = D.drill_down(readings(spark, sf).select("consumer_id", "timestamp", "consumption"), found, top, n=None)
    return rounded(shown)


def q_consumer_timeseries(spark, sf):
    base = readings(spark, sf).select("consumer_id", "timestamp", "consumption")
    most = base.groupBy("consumer_id").count().orderBy(F.desc("count"), "consumer_id").first()
    return rounded(D.consumer_timeseries(base, most["consumer_id"]))


def q_stored_readings(spark, sf):
    """The series of the consumer with most clean readings, out of the stored readings."""
    path = scratch(spark, "readings")
    save_readings(C.clean_readings(raw(spark, sf)), path)
    stored = read_readings(spark, path)
    most = stored.groupBy("consumer_id").count().orderBy(F.desc("count"), "consumer_id").first()
    return rounded(D.consumer_timeseries(stored, most["consumer_id"]).select("consumer_id", "timestamp", "consumption"))


def _by_day(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "readings-by-day")
    save_by_day(readings(spark, sf).select("consumer_id", "timestamp", "consumption"), path, buckets=16)
    return open_by_day(spark, path)


def q_reading_flags_by_day(spark, sf):
    return rounded(D.flag_by_day(_by_day(spark, sf), consumers(spark, sf)))


def q_first_n_readings_by_day(spark, sf):
    return rounded(D.first_by_day(_by_day(spark, sf), FIRST_READINGS))


def q_consumer_detail_by_day(spark, sf):
    first = D.first_by_day(_by_day(spark, sf))
    return D.consumer_detail(first, results(spark, sf)).drop("timeseries", "anomalous_records")


def q_consumer_detail(spark, sf):
    return D.consumer_detail(readings(spark, sf), results(spark, sf)).drop("timeseries", "anomalous_records")


def q_consumer_detail_records(spark, sf):
    return D.consumer_detail(readings(spark, sf), results(spark, sf)).select(
        "consumer_id", F.inline("timeseries"))


def q_drill_down(spark, sf):
    """The record of the consumer with the highest score."""
    found = results(spark, sf)
    top = found.orderBy(F.desc("anomaly_score"), "consumer_id").first()["consumer_id"]
    return D.drill_down(readings(spark, sf), found, top).drop("timeseries", "anomalous_records")


# --- scores, labels, text -------------------------------------------------------------------


def q_score_range(spark, sf):
    return rounded(scored(spark, sf).agg(F.min("raw_score").alias("low"), F.max("raw_score").alias("high")))


def q_score_threshold(spark, sf):
    cut = S.forest_threshold(scored(spark, sf), "raw_score", CONTAMINATION)
    return rounded(spark.createDataFrame([(cut,)], "threshold double"))


def q_normalize_scores(spark, sf):
    return rounded(S.normalize_scores(scored(spark, sf), "raw_score").select("consumer_id", "anomaly_score"))


def q_label_by_contamination(spark, sf):
    return S.label_by_contamination(scored(spark, sf), "raw_score", CONTAMINATION).select(
        "consumer_id", "is_anomaly")


def q_outlier_label(spark, sf):
    return S.outlier_label(scored(spark, sf), "raw_score", CONTAMINATION).select("consumer_id", "label")


def q_label_by_threshold(spark, sf):
    df = S.normalize_scores(scored(spark, sf), "raw_score")
    return S.label_by_threshold(df, "anomaly_score", THRESHOLD).select("consumer_id", "is_anomaly")


def q_label_errors(spark, sf):
    df = scored(spark, sf)
    cut = S.error_threshold(df, "std_consumption")
    return rounded(S.label_errors(df, "std_consumption", cut).select(
        "consumer_id", "ae_anomaly_score", "ae_is_anomaly"))


def q_blend_scores(spark, sf):
    df = scored(spark, sf)
    forest = S.normalize_scores(df, "raw_score").select("consumer_id", "anomaly_score")
    other = S.normalize_scores(df, "std_consumption", "ae_anomaly_score", low_is_anomalous=False)
    mixed = S.blend_scores(forest, other.select("consumer_id", "ae_anomaly_score"))
    return rounded(mixed.withColumn("status", status_of(F.col("ensemble_score"))))


def q_status_from_score(spark, sf):
    return rounded(results(spark, sf).select("consumer_id", "anomaly_score", "status"))


def q_status_color(spark, sf):
    return results(spark, sf).groupBy("status", status_color(F.col("status")).alias("color")).agg(
        F.count(F.lit(1)).alias("consumers"))


def q_explain_reference(spark, sf):
    return results(spark, sf).select("consumer_id", "ai_explanation")


def q_explain_columns(spark, sf):
    df = S.normalize_scores(scored(spark, sf), "raw_score")
    said = explanation(
        F.col("anomaly_score"), F.col("night_day_ratio"), F.col("avg_consumption"),
        F.col("weekend_weekday_ratio"), F.col("std_consumption"))
    return df.select("consumer_id", said.alias("ai_explanation"))


# --- results --------------------------------------------------------------------------------


def q_summary_counts(spark, sf):
    return rounded(G.summary_counts(results(spark, sf)))


def q_summary(spark, sf):
    """The whole summary, its lists as text."""
    found = stage(results(spark, sf), "results")
    counts = ",".join(f"{r['region']}={r['flagged']}" for r in G.zone_flag_counts(found).orderBy("region").collect())
    return rounded(G.summarize(found).withColumn("zone_anomaly_counts", F.lit(counts)).withColumn(
        "high_risk_zones", F.array_join("high_risk_zones", ",")))


def q_zone_flag_counts(spark, sf):
    return G.zone_flag_counts(results(spark, sf))


def q_zone_statistics(spark, sf):
    return G.zone_statistics(results(spark, sf))


def q_top_zones(spark, sf):
    return G.top_zones(results(spark, sf))


def q_results_page(spark, sf):
    return G.results_page(results(spark, sf), PAGE, PAGE_ROWS)


def q_deep_page(spark, sf):
    """The same page of stored results."""
    path = scratch(spark, "pages")
    store_pages(results(spark, sf), path)
    return G.page_rows(stored_page(spark, path, PAGE, PAGE_ROWS)[0])


def q_results_filtered(spark, sf):
    return G.results_page(
        results(spark, sf), 1, 50, status="Normal", region="Zone F", sort_by="avg_consumption", descending=False)


def q_page_totals(spark, sf):
    return G.page_totals(results(spark, sf), PAGE_ROWS, status="Normal")


def _report(spark, sf):
    found = results(spark, sf)
    return report_tables(found, G.summarize(found))


def q_top_consumers(spark, sf):
    """The report's table with the place of each row, so that its order is compared too."""
    rows = _report(spark, sf)["top_consumers"].collect()
    return spark.createDataFrame(
        [(i + 1, *r) for i, r in enumerate(rows)],
        "place int, consumer_id string, region string, avg_consumption double, anomaly_score double, status string")


def q_report_rows(spark, sf):
    return _report(spark, sf)["flagged_consumers"]


def q_report_summary(spark, sf):
    return summary_table(G.summarize(results(spark, sf))).drop("line")


# --- runs -----------------------------------------------------------------------------------


def q_user_history(spark, sf):
    """Runs of the user who has the most."""
    df = runs(spark, sf)
    most = df.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    return rounded(user_runs(df, most))


def q_run_by_id(spark, sf):
    """The newest run of all, looked up by id and owner."""
    df = runs(spark, sf)
    newest = df.orderBy(F.desc("created_at"), "analysis_id").first()
    return rounded(run_by_id(df, newest["analysis_id"], newest["user_id"]))


def q_stored_consumers_long_page(spark, sf):
    """A stored page of more than 500 rows."""
    path = scratch(spark, "stored")
    save_consumers(results(spark, sf), "run-1", path)
    page, total = stored_consumers_page(spark, path, "run-1", 1, 1000)
    return rounded(page.select("consumer_id", "anomaly_score").withColumn("total", F.lit(total)))


def q_json_round_trip(spark, sf):
    df, path = raw(spark, sf), scratch(spark, "json")
    write_json(df, path)
    return read_json(spark, path, df.schema)


def q_csv_round_trip(spark, sf):
    """Written and read again as text; an empty text and a missing one are alike in a CSV file."""
    path = scratch(spark, "csv")
    write_csv(raw(spark, sf), path)
    return read_readings_csv(spark, path)


def q_labels_round_trip(spark, sf):
    path = scratch(spark, "labels")
    found = results(spark, sf)
    write_labels_csv(found.select(
        F.col("consumer_id").alias("Consumer_ID"), F.col("is_anomaly").alias("Is_Anomaly"), F.col("status").alias("Anomaly_Type")), path)
    return spark.read.option("header", True).csv(path).withColumn("Is_Anomaly", F.col("Is_Anomaly").cast("boolean"))


def _stored_runs(spark, path):
    row = run_by_id(read_runs(spark, f"{path}/analyses"), "a1", "u1")
    stored = read_consumers(spark, f"{path}/consumers").filter("analysis_ref = 'a1'").groupBy("analysis_ref").agg(
        F.count(F.lit(1)).alias("stored"), F.count_if("is_anomaly").alias("flagged"))
    return rounded(row.join(stored, row["analysis_id"] == stored["analysis_ref"]).select(
        "user_id", "analysis_id", "filename", "total_consumers", "anomalies_detected", "contamination", "stored", "flagged"))


def q_runs_round_trip(spark, sf):
    """A run's row and its consumers, stored and read back by id."""
    path = scratch(spark, "runs")
    found = results(spark, sf)
    save_consumers(found, "a1", f"{path}/consumers")
    save_run(run_row(G.summarize(found), "u1", "a1", "f.csv", CONTAMINATION, False), "a1", f"{path}/analyses")
    return _stored_runs(spark, path)


def q_runs_recorded_twice(spark, sf):
    """The same after a job that was repeated: each row is there once."""
    path = scratch(spark, "runs")
    found = stage(results(spark, sf), "results")
    finished = SimpleNamespace(
        analysis_id="a1", results=found, summary=G.summarize(found), contamination=CONTAMINATION, used_autoencoder=False)
    for _ in range(2):
        record_run(finished, "u1", "f.csv", path)
    return _stored_runs(spark, path)


def q_csv_malformed(spark, sf):
    """Lines of other lengths than the header: longer ones are quarantined and counted, shorter ones lack values."""
    path = scratch(spark, "csv")
    given = raw(spark, sf)
    line = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in given.columns])
    line = F.when(F.col("KWH").endswith("7"), F.concat(line, F.lit(",more"))).when(
        F.col("KWH").endswith("3"), F.substring_index(line, ",", len(given.columns) - 1)).otherwise(line)
    # A separator that no line holds leaves the lines as they are.
    given.select(line.alias(",".join(given.columns))).write.option("header", True).option("sep", "\x01").csv(path)
    return C.with_malformed(read_readings_csv(spark, path), malformed_lines(spark, path))


def q_stored_consumers_page(spark, sf):
    path = scratch(spark, "stored")
    save_consumers(results(spark, sf), "run-1", path)
    page, _ = stored_consumers_page(spark, path, "run-1", PAGE, PAGE_ROWS, "Normal")
    return rounded(page.withColumn("cv_consumption", F.col("features")["cv_consumption"]).drop("features"))


# --- models (no SQL) ------------------------------------------------------------------------


def _model_inputs(spark, sf):
    df = stage(flagged(spark, sf), "flagged")
    return df, E.model_columns(df), E.model_inputs(df)


def q_forest_scores(spark, sf):
    df, names, inputs = _model_inputs(spark, sf)
    return M.fit_forest(df, names, inputs).score(df, inputs).select("consumer_id", "raw_score")


def q_forest_nodes(spark, sf):
    return M.fit_forest(*_model_inputs(spark, sf)).node_table(spark)


def q_forest_reload(spark, sf):
    df, names, inputs = _model_inputs(spark, sf)
    path = scratch(spark, "forest")
    M.fit_forest(df, names, inputs).save(spark, path)
    return M.load_forest(spark, path).score(df, inputs).select("consumer_id", "raw_score")


def q_forest_importance(spark, sf):
    forest = M.fit_forest(*_model_inputs(spark, sf))
    return forest.importance(spark).join(
        forest.importance(spark, "splits").withColumnRenamed("importance", "split_share"), "feature")


def q_forest_importance_uniform(spark, sf):
    return rounded(M.fit_forest(*_model_inputs(spark, sf)).importance(spark))


def q_forest_score_range(spark, sf):
    """How many raw scores there are, and how many lie between -1 and 0."""
    df, names, inputs = _model_inputs(spark, sf)
    return M.fit_forest(df, names, inputs).score(df, inputs).agg(
        F.count("raw_score").alias("scores"), F.count_if(F.col("raw_score").between(-1, 0)).alias("in_range"))


def q_forest_reload_labels(spark, sf):
    """A reloaded forest scores and labels as the one that was saved, with its own scaler and offset."""
    df, names, inputs = _model_inputs(spark, sf)
    scaler = fit_scaler(df, names, inputs)
    forest = M.fit_forest(df, names, scaler.columns(inputs))
    scores = forest.score(df, scaler.columns(inputs))
    forest = replace(forest, scaler=scaler, contamination=CONTAMINATION, offset=S.forest_threshold(scores, "raw_score", CONTAMINATION))
    path = scratch(spark, "forest")
    forest.save(spark, path)
    before = forest.label(df, inputs).select("consumer_id", F.col("raw_score").alias("was"), F.col("label").alias("said"))
    after = M.load_forest(spark, path).label(df, inputs)
    return after.join(before, "consumer_id").agg(
        F.count(F.lit(1)).alias("consumers"), F.count_if(F.col("raw_score") == F.col("was")).alias("equal_scores"),
        F.count_if(F.col("label") == F.col("said")).alias("equal_labels"), F.count_if(F.col("label") == -1).alias("flagged"))


def _autoencoder(spark, sf, **params):
    df, names, inputs = _model_inputs(spark, sf)
    fitted = A.fit_autoencoder(df, inputs, A.AutoencoderParams(names, **params), fit_scaler(df, names, inputs))
    return df, inputs, fitted


def q_autoencoder_parts(spark, sf):
    """Trained in parts of 40 rows: every consumer has an error that is not negative, 5 % are at the threshold or above."""
    df, inputs, fitted = _autoencoder(spark, sf, part_rows=40, epochs=5)
    errors = stage(fitted.error(df, inputs).select("consumer_id", "ae_error"), "errors")
    return errors.agg(
        F.count("ae_error").alias("errors"), F.count_if(F.col("ae_error") >= 0).alias("valid"),
        F.count_if(F.col("ae_error") >= F.lit(fitted.threshold)).alias("flagged"))


def q_autoencoder_reload_equal(spark, sf):
    """Consumers, and those whose error is the same after saving and reloading."""
    df, inputs, fitted = _autoencoder(spark, sf, epochs=5)
    path = scratch(spark, "autoencoder")
    fitted.save(spark, path)
    before = fitted.error(df, inputs, "was").select("consumer_id", "was")
    return A.load_autoencoder(spark, path).error(df, inputs).join(before, "consumer_id").agg(
        F.count(F.lit(1)).alias("consumers"), F.count_if(F.col("ae_error") == F.col("was")).alias("equal_errors"))


def q_autoencoder_codes(spark, sf):
    """Each consumer's code: its length, and whether all of it is finite and not negative."""
    df, inputs, fitted = _autoencoder(spark, sf, epochs=5)
    fine = F.forall("encoding", lambda x: (x >= 0) & (x < float("inf")))
    return fitted.encode(df, inputs).select("consumer_id", F.size("encoding").alias("length"), fine.alias("valid"))


def q_autoencoder_scores(spark, sf):
    df, inputs, fitted = _autoencoder(spark, sf)
    scores = stage(fitted.error(df, inputs).select("consumer_id", "ae_error"), "errors")
    return S.label_errors(scores, "ae_error", fitted.threshold)


def q_autoencoder_reload(spark, sf):
    df, inputs, fitted = _autoencoder(spark, sf)
    path = scratch(spark, "autoencoder")
    fitted.save(spark, path)
    return A.load_autoencoder(spark, path).error(df, inputs).select("consumer_id", "ae_error")


def q_autoencoder_encoding(spark, sf):
    df, inputs, fitted = _autoencoder(spark, sf)
    return fitted.encode(df, inputs).select("consumer_id", "encoding")


def q_analyze(spark, sf):
    return analyze(raw(spark, sf)).results


def q_analyze_with_autoencoder(spark, sf):
    return analyze(raw(spark, sf), use_autoencoder=True).results


def _analysis_facts(found):
    """What has to hold of any analysis, whatever the scores are."""
    score = F.col("anomaly_score")
    return found.agg(
        F.count(F.lit(1)).alias("consumers"), F.count_if(score.between(0, 1)).alias("in_range"),
        F.count_if("is_anomaly").alias("flagged"), F.count_if(F.col("status") == status_of(score)).alias("right_status"),
        F.count_if(F.length("ai_explanation") > 0).alias("explained"))


def q_analyze_facts(spark, sf):
    found = stage(analyze(raw(spark, sf)).results, "results")
    ends = found.agg(F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high"))
    worst = found.filter("is_anomaly").agg(F.min("anomaly_score")).first()[0]
    rest = found.filter("NOT is_anomaly").agg(F.max("anomaly_score")).first()[0]
    low, high = ends.first()
    return _analysis_facts(found).withColumns({
        "low": F.lit(low), "high": F.lit(high), "flags_are_the_top": F.lit(worst > rest)})


def q_analyze_with_autoencoder_facts(spark, sf):
    """The blend is that of both scores, and the flags are those without an autoencoder."""
    both = stage(analyze(raw(spark, sf), use_autoencoder=True, autoencoder_params={"epochs": 5}).results, "results")
    alone = stage(analyze(raw(spark, sf)).results, "results").select(
        "consumer_id", F.col("anomaly_score").alias("forest_score"), F.col("is_anomaly").alias("was_flagged"))
    mixed = F.col("forest_score") * 0.6 + F.col("ae_anomaly_score") * 0.4
    joined = both.join(alone, "consumer_id").agg(
        F.count_if(F.abs(F.col("anomaly_score") - mixed) < 1e-9).alias("blended"),
        F.count_if(F.col("is_anomaly") == F.col("was_flagged")).alias("same_flags")).first()
    return _analysis_facts(both).withColumns({k: F.lit(v) for k, v in joined.asDict().items()})


def planted(spark, sf):
    """The raw readings, and consumers made of those of one of them, all at night and at some fifty times the level.

    No other consumer is near them in level, range or share of the night: each of them lies as many deviations away as
    so few of so many can, in most features at once.
    """
    given = raw(spark, sf)
    chosen = given.filter(F.col("KWH").try_cast("double") > 0).agg(F.min("Consumer_ID")).first()[0]
    level = F.col("KWH").try_cast("double")
    base = given.filter((F.col("Consumer_ID") == chosen) & (level > 0))
    night = F.regexp_replace("DateTime", "[ T][0-9]{2}:", " 02:")
    made = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(PLANTED))).alias("k")).withColumns({
        "Consumer_ID": F.concat(F.lit("planted-"), F.col("k").cast("string")), "DateTime": night,
        "KWH": (level * (50 + F.col("k"))).cast("string")})
    return given.unionByName(made.drop("k"))


def _planted_inputs(spark, sf):
    found = stage(E.ratio_features(U.aggregate_consumers(C.clean_readings(planted(spark, sf)))), "planted")
    df = stage(E.anomaly_flags(found, E.fit_population(found)), "planted-flagged")
    names, inputs = E.model_columns(df), E.model_inputs(df)
    return df, names, inputs, fit_scaler(df, names, inputs)


def _first(scores, column, descending):
    """As many consumers as were planted, from the most anomalous one on."""
    order = F.col(column).desc() if descending else F.col(column)
    return scores.orderBy(order, "consumer_id").limit(PLANTED).select("consumer_id")


def q_forest_planted(spark, sf):
    df, names, inputs, scaler = _planted_inputs(spark, sf)
    columns = scaler.columns(inputs)
    return _first(M.fit_forest(df, names, columns).score(df, columns), "raw_score", False)


def q_autoencoder_planted(spark, sf):
    df, names, inputs, scaler = _planted_inputs(spark, sf)
    fitted = A.fit_autoencoder(df, inputs, A.AutoencoderParams(names, epochs=10), scaler)
    return _first(stage(fitted.error(df, inputs), "errors"), "ae_error", True)


def q_analyze_planted(spark, sf):
    return _first(analyze(planted(spark, sf)).results, "anomaly_score", True)


def q_blend_planted(spark, sf):
    found = analyze(planted(spark, sf), use_autoencoder=True, autoencoder_params={"epochs": 10})
    return _first(found.results, "anomaly_score", True)


def q_analyzed_consumers(spark, sf):
    """What a whole analysis says of every consumer apart from the scores."""
    found = analyze(raw(spark, sf)).results
    return rounded(found.drop("anomaly_score", "is_anomaly", "status", "ai_explanation"))


def q_analyzed_report(spark, sf):
    return rounded(analyze(raw(spark, sf)).cleaning_report)


def q_forest_shape(spark, sf):
    """Trees, rows at their roots and in their leaves, and whether none is too deep."""
    nodes = M.fit_forest(*_model_inputs(spark, sf)).node_table(spark)
    per_tree = nodes.groupBy("tree_id").agg(
        F.max(F.when(F.col("depth") == 0, F.col("size"))).alias("root"),
        F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("leaves"), F.max("depth").alias("depth"))
    return per_tree.agg(
        F.count(F.lit(1)).alias("trees"), F.sum("root").alias("root_rows"), F.sum("leaves").alias("leaf_rows"),
        F.max(F.col("depth") > F.ceil(F.log2("root"))).alias("too_deep"))


QUERIES = {name[2:]: call for name, call in list(globals().items()) if name.startswith("q_")}
