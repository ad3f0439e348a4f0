"""Results stored in the order of their pages, with an index of the files.

The rows are sorted once and written as files that follow one another. The index has a row per file, and
per file and status: how many rows there are, and how many in the files before. It gives the total and
the files that a page lies in, so a page reads those alone, however far down it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattsift.operators.results import sort_results

ROW = "_row"


def store_sorted(
    results: DataFrame, rows: str, index: str, sort_by: str = "anomaly_score", descending: bool = True
) -> None:
    """Write the sorted results and their index, in place of what was there."""
    spark = results.sparkSession
    # The number tells the partition and the place in it, so it grows from row to row.
    numbered = sort_results(results, sort_by, descending).withColumn(ROW, F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(rows)
    stored = spark.read.schema(numbered.schema).parquet(rows).withColumn("file", F.col("_metadata.file_name"))
    # No status stands for all rows of the file.
    kinds = F.array(F.lit(None).cast("string"), F.col("status")) if "status" in results.columns else F.array(
        F.lit(None).cast("string"))
    known = stored.select("file", ROW, F.explode(F.array_distinct(kinds)).alias("status")).groupBy("file", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.min(ROW).alias("first"))
    # As many rows as files and statuses.
    whole = Window.partitionBy("status")
    before = F.sum("rows").over(whole.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    known.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("rows").over(whole)}).coalesce(1).write.mode(
        "overwrite").parquet(index)


def read_page(
    spark: SparkSession, rows: str, index: str, page: int = 1, limit: int = 50, status: str | None = None
) -> tuple[DataFrame, int]:
    """A page of stored results, counted from 1, and how many rows there are in all."""
    if page < 1 or limit < 1:
        raise ValueError(f"page and limit start at 1, not {page} and {limit}")
    start = (page - 1) * limit
    reaches = (F.col("before") < start + limit) & (F.col("before") + F.col("rows") > start)
    last = F.col("before") + F.col("rows") == F.col("total")
    # The files of the page, at most `limit` of them, and the last file for the total.
    found = spark.read.parquet(index).filter(F.col("status").eqNullSafe(F.lit(status))).filter(reaches | last).orderBy("before").collect()
    files = [r for r in found if r["before"] < start + limit and r["before"] + r["rows"] > start]
    if not files:
        return spark.read.parquet(rows).drop(ROW).limit(0), found[0]["total"] if found else 0
    held = spark.read.parquet(*[f"{rows}/{r['file']}" for r in files])
    skip = start - files[0]["before"]
    if status is not None:
        held = held.filter(F.col("status") == F.lit(status))
    else:
        # Rows of a file are numbered one after the other.
        spans = [F.col(ROW).between(r["first"] + max(start - r["before"], 0), r["first"] + min(start + limit - r["before"], r["rows"]) - 1)
                 for r in files]
        wanted, skip = spans[0], 0
        for span in spans[1:]:
            wanted = wanted | span
        held = held.filter(wanted)
    return held.orderBy(ROW).offset(skip).limit(limit).drop(ROW), files[0]["total"]


def store_pages(results: DataFrame, folder: str, sort_by: str = "anomaly_score", descending: bool = True) -> None:
    store_sorted(results, f"{folder}/rows", f"{folder}/index", sort_by, descending)


def stored_page(
    spark: SparkSession, folder: str, page: int = 1, limit: int = 50, status: str | None = None
) -> tuple[DataFrame, int]:
    return read_page(spark, f"{folder}/rows", f"{folder}/index", page, limit, status)
