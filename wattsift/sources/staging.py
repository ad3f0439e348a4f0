"""Staged tables: a frame written once to shared storage and read back.

A staged table cuts lineage the way a checkpoint does, and stays columnar: later passes read
only the columns they use. It lives in the folder that ``spark.checkpoint.dir`` names, so it
outlasts any executor. It stays until it is unstaged, or that folder is cleaned up.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def staging_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="wattsift-")
    return _local_folders[app]


def unstage(*frames: DataFrame) -> None:
    """Delete the staged tables that frames read. What still needs them can no longer run."""
    for df in frames:
        spark = df.sparkSession
        root = f"{staging_folder(spark)}/wattsift/"
        inside = "/wattsift/"
        for label in {f.rpartition(inside)[2].split("/")[0] for f in df.inputFiles() if inside in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root + label)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/wattsift/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
