"""Questions about keys that documents share, asked and answered in bulk.

Some operators need, for very many keys of a document (windows, word pairs), a number that depends on all
documents. A row per key and document would be shuffled twice at many times the size of the text. Here documents are
dealt into blocks of a bounded number of characters by a hash of their row. A block asks each
distinct key once, however often it holds it, so a key that a third of all documents hold costs one
entry per block and cannot make a task heavy. The keys of a block go sorted to the shards that
own them; a shard sees all blocks, and answers each with one small value per key, in the
block's order, so that keys need not travel back. A shard of which a block has no key is not asked, so there are never more rows than keys. All steps are Spark group-bys over plain rows:

    docs by block -> (shard, block, kind, asked) by shard -> (block, shard, kind, answer) by block, with docs

A plan uses the shuffle of the documents by block once, however many times it reads it.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.llm.tables import forget, give_back

BLOCK_CHARS = 5_000_000
# Blocks to a shard: what a shard gathers is smaller than a block's text and words.
BLOCKS_TO_A_SHARD = 3
# So many blocks at least, for balance where there is little text.
LEAST_BLOCKS = 32
ASKED = "shard int, block int, kind int, asked binary"
ANSWER = "block int, shard int, kind int, answer binary"


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers: byte planes, those that are zero left out by the compressor."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    used = 8
    while used and not raw[:, used - 1].any():
        used -= 1
    planes = np.ascontiguousarray(raw[:, :used].T).tobytes()
    return struct.pack("<QB", len(raw), used) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_numbers(data: bytes) -> np.ndarray:
    n, used = struct.unpack_from("<QB", data)
    raw = np.zeros((n, 8), np.uint8)
    if n and used:
        planes = zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=n * used)
        raw[:, :used] = np.frombuffer(planes, np.uint8).reshape(used, n).T
    return raw.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def pack_flags(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<Q", len(flags)) + np.packbits(flags).tobytes())


def unpack_flags(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=struct.unpack_from("<Q", raw)[0]).astype(bool)


def pack_parts(parts: list[bytes]) -> bytes:
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def unpack_parts(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    lengths = struct.unpack_from(f"<{n}Q", data, 4)
    at, out = 4 + 8 * n, []
    for length in lengths:
        out.append(data[at : at + length])
        at += length
    return out


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the keys of each shard begin and end among sorted 64-bit keys: equal ranges of keys."""
    step = (1 << 64) // shards
    return np.concatenate([[0], np.searchsorted(keys, np.array([step * k for k in range(1, shards)], np.uint64)), [len(keys)]])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of 64-bit keys, as `shard_cuts` has it."""
    return np.minimum(keys // np.uint64((1 << 64) // shards), np.uint64(shards - 1))


def in_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, int, int]:
    """The rows with a block number, and how many blocks and shards there should be; `text` must not be null."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).collect()[0][0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(chars / block_chars))
    shards = max(LEAST_BLOCKS, blocks // BLOCKS_TO_A_SHARD)
    return docs.withColumn("block", block_of(F.col("doc_id"), F.col("text"), blocks)), blocks, shards


def block_of(doc_id: Column, text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).cast("int")


def rows_of(names: list[str], rows: list[tuple]) -> pa.Table:
    kinds = {"asked": pa.binary(), "answer": pa.binary()}
    return pa.table({n: pa.array([r[k] for r in rows], kinds.get(n, pa.int32())) for k, n in enumerate(names)})


def ask(blocks: DataFrame, make: Callable[[pa.Table], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Every block's questions: `make` gives (shard, kind, asked) for the rows of a block."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        block = table.column("block")[0].as_py()
        made = rows_of(["shard", "block", "kind", "asked"], [(s, block, k, a) for s, k, a in make(table)])
        give_back()
        return made

    return blocks.groupBy("block").applyInArrow(run, ASKED)


def answer(asked: DataFrame, reply: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """Every shard's answers: `reply` gets a kind and what all blocks ask, and answers each in that order."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["block"]))
        out = []
        for kind in sorted({r["kind"] for r in rows}):
            own = [r for r in rows if r["kind"] == kind]
            out += [(r["block"], r["shard"], kind, a) for r, a in zip(own, reply(kind, [r["asked"] for r in own]))]
        give_back()
        return rows_of(["block", "shard", "kind", "answer"], out)

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


def to_all_blocks(asked: DataFrame, count: Callable[[list[bytes]], tuple[int, int]], kind: int, blocks: int) -> DataFrame:
    """An answer to every block: two sums over all shards of what `count` finds, as text with a comma between."""

    def run(table: pa.Table) -> pa.Table:
        found = count([r["asked"] for r in sorted(table.to_pylist(), key=lambda r: r["block"])])
        give_back()
        return pa.table({"a": [found[0]], "b": [found[1]]})

    sums = asked.groupBy("shard").applyInArrow(run, "a long, b long").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    many = 4096
    far = sums.withColumn("far", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // many))))
    every = far.withColumn("near", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    every = every.withColumn("block", F.col("far") * many + F.col("near")).where(F.col("block") < blocks)
    said = F.encode(F.concat_ws(",", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))), "utf-8")
    return every.select("block", F.lit(-1).alias("shard"), F.lit(kind).alias("kind"), said.alias("answer"))


def told(table: pa.Table, kind: int) -> list[bytes]:
    """The answers of one kind that came to a block, in the order of shards."""
    return [r["answer"] for r in sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["shard"])]


def conclude(blocks: DataFrame, answers: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows of each block from its documents and the answers that came to it; blocks without rows give none."""

    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        made = make(docs, got)
        give_back()
        return made

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
