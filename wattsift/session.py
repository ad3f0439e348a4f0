"""Session settings."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

SHUFFLE_TARGET_BYTES = 256 * 1024 * 1024


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Partitions that keep one shuffled partition near 256 MB, and every core busy."""
    return max(cores, math.ceil(input_bytes / SHUFFLE_TARGET_BYTES))


def build_session(
    app: str = "wattsift",
    master: str | None = None,
    partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC wall-clock time.

    On a cluster leave ``master`` to spark-submit and size ``partitions`` with
    :func:`shuffle_partitions`; adaptive execution merges what turns out too small.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # No call-site capture per column expression: plans of many columns build faster.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(extra or {})
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
