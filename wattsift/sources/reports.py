"""The tables inside a report. Page layout is left to whatever shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.operators.results import by_score, report_rows, top_by_score


def summary_table(summary: DataFrame, zones: int = 5) -> DataFrame:
    """Metric and value, in reading order, from a one-row summary."""
    shown = F.slice("high_risk_zones", 1, zones)
    lines = [
        ("Total Consumers", F.col("total_consumers").cast("string")),
        ("Anomalies Detected", F.col("anomalies_detected").cast("string")),
        ("High Risk Cases", F.col("high_risk_count").cast("string")),
        ("Suspicious Cases", F.col("suspicious_count").cast("string")),
        ("Average Anomaly Score", F.format_string("%.3f", F.coalesce("avg_anomaly_score", F.lit(0.0)))),
        ("High Risk Zones", F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise("None")),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("line"), F.lit(name).alias("metric"), value.alias("value"))
        for i, (name, value) in enumerate(lines)
    ])
    return summary.select(F.inline(rows))


def report_tables(results: DataFrame, summary: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """All by the exact score; scores are rounded for display only after that."""
    return {
        "summary": summary_table(summary),
        "top_consumers": report_rows(top_by_score(results, top)),
        "flagged_consumers": report_rows(by_score(results)),
        "all_consumers": report_rows(results),
    }


def write_report(results: DataFrame, summary: DataFrame, folder: str, fmt: str = "csv") -> dict[str, str]:
    """Write each report table to its own folder; returns where each one is."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"format must be csv or parquet, not {fmt}")
    paths = {}
    for name, table in report_tables(results, summary).items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        writer = table.write.mode("overwrite")
        writer.option("header", True).csv(paths[name]) if fmt == "csv" else writer.parquet(paths[name])
    return paths
