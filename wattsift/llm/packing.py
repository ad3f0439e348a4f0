"""Best-fit decreasing packing of documents into windows of a fixed number of tokens.

Documents longer than a window are first cut into full windows. What is left, and all shorter
documents, go longest first into the open window that they fill best: a segment tree over
remaining capacities gives the smallest capacity that is large enough in log2(window) steps.

Every task packs what it reads, a bounded number of tokens at a time; windows that are far from
full are taken apart and packed again with what comes next, so that a task leaves few of them.
Nothing is shuffled. Rows: sequence_id, length, padded_length, input_ids (without
padding) and the pieces in their order. A sequence is padded to the window unless its length is
a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattsift.llm.tables import slices, texts
from wattsift.llm.tokens import text_ids, with_end

WINDOW = 2048
END_ID = 1
# Tokens that a task holds before it packs them; the share of them it may keep for the next time.
BUFFER_TOKENS = 4_000_000
KEEP = 0.25
PIECE = "doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint"
SEQUENCES = f"sequence_id long, length int, padded_length int, input_ids array<int>, pieces array<struct<{PIECE}>>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """Open windows by remaining capacity: a segment tree whose leaves are capacities 0..size."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += by
            at //= 2

    def take(self, needed: int) -> tuple[int, int] | None:
        """The tightest open window with at least that capacity, removed; its capacity and number."""
        at = needed + self.leaves
        if not self.open[at]:
            # Up until a right neighbour has something, then down along its left side.
            while at > 1 and (at % 2 or not self.open[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._count(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Groups of indexes into `lengths` (1..window) whose sums are at most `window`."""
    order = np.argsort(-lengths, kind="stable")
    groups: list[list[int]] = []
    free = Capacities(window)
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        found = free.take(n)
        if found is None:
            found = window, len(groups)
            groups.append([])
        groups[found[1]].append(i)
        if found[0] > n:
            free.add(found[0] - n, found[1])
    return groups


def padded(length: int, window: int) -> int:
    return length if length & (length - 1) == 0 else window


def pack_batches(
    batches: Iterator[pa.RecordBatch], task: int, tokenizer: str | None, window: int, end_id: int, buffer_tokens: int,
) -> Iterator[list[tuple[int, list[tuple], np.ndarray]]]:
    """Lists of (sequence id, pieces, ids) of what a task reads."""
    encoder = text_ids(tokenizer)
    count = 0
    pieces: list[tuple] = []  # doc_id, start, length, doc_tokens, ids
    held = 0

    def number() -> int:
        nonlocal count
        count += 1
        return (task << 33) + count - 1

    def pack(keep: int) -> list:
        nonlocal pieces, held
        groups = best_fit(np.array([p[2] for p in pieces], np.int64), window)
        fill = [sum(pieces[i][2] for i in g) for g in groups]
        later: list[tuple] = []
        left, out = keep, []
        # The emptiest windows wait, as far as they fit in what may be kept.
        for n, g in sorted(zip(fill, groups)):
            if n <= left and n < window - window // 64:
                left -= n
                later += [pieces[i] for i in g]
            else:
                out.append((number(), [pieces[i][:4] for i in g], np.concatenate([pieces[i][4] for i in g])))
        pieces, held = later, keep - left
        return out

    for names, found in slices(batches, 2_000_000):
        ids, sizes = with_end(*encoder.encode(found), end_id)
        full = []
        for name, end, n in zip(names, np.cumsum(sizes).tolist(), sizes.tolist()):
            own = ids[end - n : end]
            cut = n - n % window
            for at in range(0, cut, window):
                full.append((number(), [(name, at, window, n)], own[at : at + window]))
            if cut < n:
                pieces.append((name, cut, n - cut, n, own[cut:].copy()))
                held += n - cut
        yield full
        if held >= buffer_tokens:
            yield pack(int(buffer_tokens * KEEP))
    if pieces:
        yield pack(0)


def _run(docs: DataFrame, rows, schema: str, tokenizer, window, end_id, buffer_tokens) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for found in pack_batches(batches, task, tokenizer, window, end_id, buffer_tokens):
            if found:
                yield rows(found, window)

    return texts(docs).mapInArrow(run, schema)


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))


def sequence_rows(found: list, window: int) -> pa.RecordBatch:
    names = [n.split(":")[0] for n in PIECE.split(",")]
    flat = [p for _, pieces, _ in found for p in pieces]
    structs = pa.StructArray.from_arrays([pa.array([p[k] for p in flat], pa.int64()) for k in range(4)], names=names)
    ends = np.cumsum([0, *(len(p) for _, p, _ in found)]).astype(np.int32)
    lengths = [len(ids) for _, _, ids in found]
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _, _ in found], pa.int64()), pa.array(lengths, pa.int32()),
         pa.array([padded(n, window) for n in lengths], pa.int32()),
         _lists([ids.astype(np.int32) for _, _, ids in found], pa.int32()),
         pa.ListArray.from_arrays(pa.array(ends), structs)],
        names=["sequence_id", "length", "padded_length", "input_ids", "pieces"])


def piece_rows(found: list, window: int) -> pa.RecordBatch:
    """One row per piece, its digest taken from the ids in the packed sequence."""
    rows: list[tuple] = []
    for sequence, pieces, ids in found:
        raw, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
        for name, start, length, total in pieces:
            rows.append((name, start, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), total, sequence, at))
            at += length
    columns = [c.split(" ")[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], names=columns)


def pack(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Packed sequences of all documents.

    A null or empty text is its end id alone; rows of equal id are documents of their own; a
    null id stays null in the pieces; an empty table gives no sequences.
    """
    return _run(docs, sequence_rows, SEQUENCES, tokenizer, window, end_id, buffer_tokens)


def packed_pieces(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """The same sequences as a row per piece: where it lies, and the checksum of the ids there."""
    return _run(docs, piece_rows, PIECES, tokenizer, window, end_id, buffer_tokens)
