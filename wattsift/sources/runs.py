"""History of analysis runs and the consumers stored for each run.

Everything of a run lies in folders of its own, which writing again replaces. The run's row is
written last: a run that is listed has its consumers.
"""

from __future__ import annotations

import math
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.operators.results import zone_flag_counts
from wattsift.sources.pages import ROW, read_page, store_sorted


def new_analysis_id() -> str:
    return str(uuid.uuid4())[:8]


def run_row(
    summary: DataFrame,
    user_id: str,
    analysis_id: str,
    filename: str,
    contamination: float,
    used_autoencoder: bool,
) -> DataFrame:
    """The history row of one run, made from its one-row summary."""
    return summary.select(
        F.lit(str(user_id)).alias("user_id"),
        F.lit(analysis_id).alias("analysis_id"),
        F.lit(filename).alias("filename"),
        "total_consumers",
        "anomalies_detected",
        F.lit(float(contamination)).alias("contamination"),
        F.lit(bool(used_autoencoder)).alias("used_autoencoder"),
        F.struct(*summary.columns).alias("summary"),
        F.current_timestamp().alias("created_at"),
    )


def _own_folder(path: str, column: str, value: str) -> str:
    """The folder of one partition value, as Spark would name it."""
    return f"{path}/{column}={quote(value, safe=' ')}"


def _read(spark: SparkSession, path: str, column: str) -> DataFrame:
    """All partitions; the partition value is text even when it looks like a number."""
    found = spark.read.parquet(path)
    schema = T.StructType([f for f in found.schema if f.name != column] + [T.StructField(column, T.StringType())])
    return spark.read.schema(schema).parquet(path)


def save_run(row: DataFrame, analysis_id: str, path: str) -> None:
    """Store the row of a run, in place of an earlier one of the same id."""
    row.drop("analysis_id").coalesce(1).write.mode("overwrite").parquet(_own_folder(path, "analysis_id", analysis_id))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "analysis_id")


def record_run(analysis, user_id: str, filename: str, folder: str) -> None:
    """Store a finished analysis: its consumers, its flagged consumers per zone, and at last its row."""
    run = analysis.analysis_id
    save_consumers(analysis.results, run, f"{folder}/consumers")
    zone_flag_counts(analysis.results).write.mode("overwrite").parquet(_own_folder(f"{folder}/zones", "analysis_id", run))
    row = run_row(analysis.summary, user_id, run, filename, analysis.contamination, analysis.used_autoencoder)
    save_run(row, run, f"{folder}/analyses")


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "analysis_id")


def user_runs(runs: DataFrame, user_id: str) -> DataFrame:
    """One user's runs, newest first."""
    return runs.filter(F.col("user_id") == F.lit(str(user_id))).orderBy(F.desc("created_at"), "analysis_id")


def run_by_id(runs: DataFrame, analysis_id: str, user_id: str) -> DataFrame:
    mine = (F.col("analysis_id") == F.lit(analysis_id)) & (F.col("user_id") == F.lit(str(user_id)))
    return runs.filter(mine).limit(1)


def consumer_rows(results: DataFrame, analysis_ref: str) -> DataFrame:
    """Results as stored: fixed columns, and every other number in the ``features`` map."""
    fixed = ["consumer_id", "region", "avg_consumption", "anomaly_score", "status", "is_anomaly"]
    extra = [f.name for f in results.schema if isinstance(f.dataType, T.NumericType) and f.name not in fixed]
    features = F.map_from_arrays(
        F.array(*[F.lit(n) for n in extra]), F.array(*[F.col(n).cast("double") for n in extra])
    ) if extra else F.create_map().cast("map<string,double>")
    return results.select(F.lit(analysis_ref).alias("analysis_ref"), *fixed, features.alias("features"))


def save_consumers(results: DataFrame, analysis_ref: str, path: str) -> None:
    """Store a run's consumers by score with the index of their pages, in place of earlier ones of the same run."""
    rows = consumer_rows(results, analysis_ref).drop("analysis_ref")
    store_sorted(rows, *_stored_in(path, analysis_ref))


def _stored_in(path: str, analysis_ref: str) -> tuple[str, str]:
    return _own_folder(path, "analysis_ref", analysis_ref), _own_folder(f"{path}-index", "analysis_ref", analysis_ref)


def read_consumers(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "analysis_ref").drop(ROW)


def stored_consumers_page(
    spark: SparkSession, path: str, analysis_ref: str, page: int = 1, limit: int = 50, status: str | None = None
) -> tuple[DataFrame, int]:
    """One page of a run's consumers by score, and how many there are in all. Reads the files of that page only."""
    found, total = read_page(spark, *_stored_in(path, analysis_ref), page, limit, status)
    return found.withColumn("analysis_ref", F.lit(analysis_ref)), total


def page_count(total: int, limit: int) -> int:
    return math.ceil(total / limit)
