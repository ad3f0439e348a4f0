"""Tables, Arrow batches and worker-wide caches shared by the operators."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows are handled a few MB at a time inside a task, however many rows a batch has.
PIECE_CHARS = 4_000_000
# What `str.lower` would do beyond A-Z is not wanted anywhere here; this is for UTF-8 bytes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only id and text, whatever other columns there are; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def kept(name: str, make: Callable):
    """A value that lives as long as the Python worker, across its tasks."""
    store = sys.modules.setdefault("wattsift_worker_values", types.ModuleType("wattsift_worker_values"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def forget() -> None:
    """Drop the values kept by earlier stages, whose workers are used again."""
    store = sys.modules.get("wattsift_worker_values")
    if store:
        for name in [n for n in vars(store) if not n.startswith("__")]:
            delattr(store, name)


def give_back() -> None:
    """Return freed memory to the system: idle workers of earlier stages stand beside those at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batches: Iterator[pa.RecordBatch], chars: int = PIECE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the first two columns, a bounded number of characters at a time."""
    ids: list = []
    found: list[str] = []
    held = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            value = text.as_py()
            ids.append(i)
            found.append(value)
            held += len(value)
            if held >= chars:
                yield ids, found
                ids, found, held = [], [], 0
    if ids:
        yield ids, found
    give_back()
