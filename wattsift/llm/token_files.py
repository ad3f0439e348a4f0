"""Token-id files: bit or byte planes of id blocks, each compressed, with a chunk index.

A corpus is written as segments in ascending order of the ids of its documents. A segment is a
self-contained file image of a bounded number of ids:

    magic, version, plane kind, ids a block, documents, ids, blocks, length of index   (head)
    document ids, flags of missing ids, tokens of each document                        (documents)
    ids of each block, planes of each block, byte length of each plane                 (chunk index)
    compressed planes                                                                  (payload)

Segments are rows of a Parquet table, so that Spark's own writers and readers carry them to and
from any store: part (the range of documents), segment (its number there), part_start (ids
before it in its part), n_ids and image. A second small table, the base of every part, makes
positions global. A plane is one bit or one byte of all ids of a block; planes that
are zero throughout are stored as empty.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.llm.tables import slices, texts
from wattsift.llm.tokens import text_ids, with_end
from wattsift.sources.staging import staging_folder

MAGIC = b"WSBP"
HEAD = "<4sBBIIQI"
BLOCK_IDS = 16_384
SEGMENT_IDS = 1_000_000
END_ID = 2
SEGMENTS = "part int, segment int, part_start long, n_ids long, image binary"
READ = "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The four byte planes, or 32 bit planes, of a block; lowest first; empty where all is zero."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(raw.T)
    return [row.tobytes() if row.any() else b"" for row in rows]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    width = (n + 7) // 8 if kind == "bit" else n
    rows = np.zeros((len(planes), width), np.uint8)
    for row, plane in zip(rows, planes):
        if plane:
            row[:] = np.frombuffer(plane, np.uint8)
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        raw = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        raw = np.ascontiguousarray(rows.T)
    return raw.reshape(-1).view("<u4")


def write_image(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, kind: str, block: int, level: int = 1) -> bytes:
    pack = zstandard.ZstdCompressor(level=level)
    payload, index = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        planes = [pack.compress(p) if p else b"" for p in to_planes(part, kind)]
        index.append(struct.pack(f"<II{len(planes)}I", len(part), len(planes), *map(len, planes)))
        payload += planes
    missing = np.array([i is None for i in doc_ids], np.uint8)
    named = np.array([0 if i is None else i for i in doc_ids], "<i8")
    chunk_index = b"".join(index)
    head = struct.pack(HEAD, MAGIC, 1, kind == "bit", block, len(doc_ids), len(ids), len(chunk_index))
    return b"".join([head, named.tobytes(), missing.tobytes(), np.asarray(sizes, "<i8").tobytes(), chunk_index, *payload])


def read_image(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, tokens of each, and all ids of a segment."""
    magic, version, bits, _, n_docs, n_ids, n_index = struct.unpack_from(HEAD, image)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token-id segment")
    at = struct.calcsize(HEAD)
    named = np.frombuffer(image, "<i8", n_docs, at)
    missing = np.frombuffer(image, np.uint8, n_docs, at + 8 * n_docs)
    sizes = np.frombuffer(image, "<i8", n_docs, at + 9 * n_docs)
    at += 17 * n_docs
    data, end = at + n_index, at + n_index
    unpack, blocks = zstandard.ZstdDecompressor(), []
    while at < end:
        n, planes = struct.unpack_from("<II", image, at)
        lengths = struct.unpack_from(f"<{planes}I", image, at + 8)
        at += 8 + 4 * planes
        found = []
        for length in lengths:
            found.append(unpack.decompress(image[data : data + length]) if length else b"")
            data += length
        blocks.append(from_planes(found, n, "bit" if bits else "byte"))
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
    if len(ids) != n_ids or sizes.sum() != n_ids:
        raise ValueError("a token-id segment is damaged")
    return [None if m else int(i) for i, m in zip(named, missing)], sizes, ids


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, kind: str = "byte", block: int = BLOCK_IDS,
    segment_ids: int = SEGMENT_IDS, end_id: int = END_ID,
) -> None:
    """Encode whole texts and write them under `path` in ascending order of document id.

    Rows of equal id follow each other in the order of their texts; rows without an id come
    first; an empty text has its end id only. A document is never split over two segments.
    """
    if kind not in ("bit", "byte"):
        raise ValueError("kind is bit or byte")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, start = TaskContext.get().partitionId(), 0, 0
        names: list = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        encoder = text_ids(tokenizer)

        def image():
            nonlocal number, start
            ids, each = np.concatenate(held), np.concatenate(sizes)
            row = [part], [number], [start], [len(ids)], [write_image(names, each, ids, kind, block)]
            number, start = number + 1, start + len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["part", "segment", "part_start", "n_ids", "image"])

        for ids, found in slices(batches, 2_000_000):
            tokens, each = with_end(*encoder.encode(found), end_id)
            names += ids
            sizes.append(each)
            held.append(tokens)
            if sum(map(len, held)) >= segment_ids:
                yield image()
                names, sizes, held = [], [], []
        if names:
            yield image()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    # Images are compressed already.
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    # One row per part: as many as there were tasks, whatever the size of the corpus.
    totals = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("part").agg(
        F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases, at = [], 0
    for row in totals:
        bases.append((row["part"], at))
        at += row["n"]
    spark.createDataFrame(bases, "part int, base long").coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, sizes, ids = read_image(row["image"])
                ends = np.cumsum(sizes)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(names), pa.int32()), pa.array(names, pa.int64()),
                     pa.array(ends - sizes + row["part_start"]), pa.array(sizes), pa.array(sums, pa.int64())],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    found = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").select("part", "part_start", "image")
    bases = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    return found.mapInArrow(decode, READ).join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the documents to a new folder of the shared staging area and read them back."""
    path = f"{staging_folder(docs.sparkSession)}/wattsift/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return read_token_files(docs.sparkSession, path)
