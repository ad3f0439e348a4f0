"""CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.functions.parsing import finite

LABEL_COLUMNS = ["Consumer_ID", "Is_Anomaly", "Anomaly_Type"]


MALFORMED = "_malformed"
QUOTED = '"(?:[^"]|"")*"'


def read_readings_csv(
    spark: SparkSession, path: str, multiline: bool = False, malformed: str = "quarantine"
) -> DataFrame:
    """Raw readings with every column as text; cleaning types them.

    Schema inference would read the files twice and guess per file. Where names differ only in
    letter case, the first keeps its name and the others carry their position. A folder is read
    whole; its files have the same header. A line with fewer fields than the header lacks values; one with more
    is malformed: it is left out and found by ``malformed_lines``, or raises an error with ``malformed="raise"``.
    """
    if malformed not in ("quarantine", "raise"):
        raise ValueError(f"malformed must be quarantine or raise, not {malformed}")
    frame = _scanned(spark, path, multiline)
    if malformed == "raise" and (first := frame.filter(_too_long(frame)).select(MALFORMED).first()):
        raise ValueError(f"a line with more than {len(frame.columns) - 1} fields in {path}: {first[0]}")
    return frame.filter(~_too_long(frame)).drop(MALFORMED)


def malformed_lines(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Quarantine: file and text of the lines with more fields than the header."""
    frame = _scanned(spark, path, multiline)
    return frame.filter(_too_long(frame)).select(F.col("_metadata.file_name").alias("file"), F.col(MALFORMED).alias("line"))


def _scanned(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """The lines as they are; MALFORMED holds the text of those that do not have as many fields as the header."""
    name = path.rstrip("/").rpartition("/")[2]
    if "." in name and not name.endswith(".csv"):
        raise ValueError(f"neither a .csv path nor a folder: {path}")
    reader = spark.read.option("inferSchema", False).option("escape", '"').option("multiLine", multiline)
    plain = reader.option("header", True).csv(path)
    if plain.isEmpty():
        raise ValueError(f"no rows in {path}")
    names = _first_keeps_name(list(reader.option("header", False).csv(path).first()), plain.columns)
    # Fields are counted only where none is pruned.
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))] + [T.StructField(MALFORMED, T.StringType())])
    whole = reader.option("header", True).option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False).schema(schema).csv(path)
    return whole.withColumnsRenamed({f"_{i}": n for i, n in enumerate(names)})


def _too_long(frame: DataFrame) -> Column:
    fields = F.size(F.split(F.regexp_replace(MALFORMED, QUOTED, ""), ",", -1))
    # Spark reads no CSV for this column alone, so another one has a part in the condition.
    first = F.col("`" + frame.columns[0].replace("`", "``") + "`")
    return F.coalesce((fields > len(frame.columns) - 1) & (F.length(F.coalesce(first, F.lit(""))) >= 0), F.lit(False))


def _first_keeps_name(header: list[str | None], unique: list[str]) -> list[str]:
    """Spark adds the position to every one of a set of equal names; undo that for the first."""
    taken: set[str] = set()
    names = []
    for written, safe in zip(header, unique):
        key = (written or "").lower()
        names.append(safe if not key or key in taken else written)
        taken.add(key)
    return names


def preview(df: DataFrame, rows: int = 5) -> dict[str, object]:
    """Row count, column names and the first rows with NaN and infinities as NULL."""
    return {"rows": df.count(), "columns": list(df.columns), "preview": preview_rows(df, rows)}


def preview_rows(df: DataFrame, rows: int = 5, ordered: bool = False) -> DataFrame:
    """The first rows as they come, or the first in order of all columns, missing values first."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    quoted = [(c, F.col(f"`{c}`")) for c in df.columns]
    shown = df.orderBy(*[col.asc_nulls_first() for _, col in quoted]) if ordered else df
    return shown.limit(rows).select(*[(finite(col) if c in floats else col).alias(c) for c, col in quoted])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_labels_csv(labels: DataFrame, path: str) -> None:
    """Known anomalies, one row per consumer."""
    write_csv(labels.select(*LABEL_COLUMNS), path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
