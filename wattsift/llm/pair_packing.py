"""Packing by large-item matching: as few windows as possible.

Pieces above a third of a window stand at most two in one, so they are matched: the longest with
the longest partner that fits. Shorter pieces then go, longest first, into the tightest gap that is left.

Only lengths decide, and there are no more of them than tokens in a window. So one plan is made
for all documents from the number of pieces of every length: it says for the r-th piece of a length in which
sequence it lies, and where. Tasks number the pieces that they cut; a piece's rank is its number
after all those of its length in earlier tasks. Nothing but these few numbers leaves the tasks,
and the plan's size is bounded by the window, not by the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattsift.llm.tables import slices, texts
from wattsift.llm.tokens import BYTE_FILE, text_ids, with_end
from wattsift.sources.staging import stage

WINDOW = 1024
END_ID = 2
SLICE_CHARS = 2_000_000
CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Plan:
    """Where the pieces of every length go, as runs of ranks.

    From rank `first` on, `times` pieces each stand one after the other from `offset` on in the
    sequences `base`, `base` + 1 and so on.
    """

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.sequences = window, 0
        self.left = np.zeros(window + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rank = np.zeros(window + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []
        # Runs of sequences (first, how many) by what is free in them.
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
        self._match()
        self._fill()
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        self.lengths, self.first, self.base, self.offset, self.times = runs.T

    def _put(self, length: int, base: int, sequences: int, offset: int, times: int) -> None:
        self.runs.append((length, int(self.rank[length]), base, offset, times))
        self.rank[length] += sequences * times
        self.left[length] -= sequences * times

    def _open(self, sequences: int) -> int:
        self.sequences += sequences
        return self.sequences - sequences

    def _match(self) -> None:
        least = self.window // 3 + 1
        for a in range(self.window, least - 1, -1):
            b = min(a, self.window - a)
            while self.left[a]:
                while b >= least and not self.left[b] - (a == b) > 0:
                    b -= 1
                if b < least:
                    n, used = int(self.left[a]), a
                    self._put(a, self._open(n), n, 0, 1)
                elif a == b:
                    n, used = int(self.left[a]) // 2, 2 * a
                    self._put(a, self._open(n), n, 0, 2)
                else:
                    n, used = int(min(self.left[a], self.left[b])), a + b
                    base = self._open(n)
                    self._put(a, base, n, 0, 1)
                    self._put(b, base, n, a, 1)
                self.free[self.window - used].append((self.sequences - n, n))

    def _fill(self) -> None:
        for s in range(self.window // 3, 0, -1):
            while self.left[s]:
                gap = next((g for g in range(s, self.window + 1) if self.free[g]), None)
                if gap is None:
                    gap, n = self.window, max(1, int(self.left[s]) // (self.window // s))
                    base = self._open(n)
                else:
                    base, n = self.free[gap].pop()
                # A sequence takes as many as it can before the next one is begun.
                times = min(gap // s, int(self.left[s]))
                use = min(n, int(self.left[s]) // times)
                self._put(s, base, use, self.window - gap, times)
                self.free[gap - times * s].append((base, use))
                if use < n:
                    self.free[gap].append((base + use, n - use))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        # Runs are sorted by length, then rank; ranks stay far below 2**44.
        keys = (self.lengths << 44) + self.first
        at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        nth = rank - self.first[at]
        return self.base[at] + nth // self.times[at], self.offset[at] + nth % self.times[at] * length


def cuts(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows after what is left over."""
    first = n % window
    return ([(0, first)] if first else []) + [(at, window) for at in range(first, n, window)]


def cut_pieces(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """All pieces, numbered within their task and length, staged; `with_ids` adds their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        encoder = text_ids(tokenizer, BYTE_FILE)
        for names, found in slices(batches, SLICE_CHARS):
            ids, sizes = with_end(*encoder.encode(found), end_id)
            raw, at, rows = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0, []
            for name, n in zip(names, sizes.tolist()):
                for piece, (start, length) in enumerate(cuts(n, window)):
                    row = name, piece, start, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), part, seen[length]
                    rows.append((*row, ids[at : at + length]) if with_ids else row)
                    seen[length] += 1
                    at += length
            columns = list(zip(*rows))
            kinds = [pa.int32() if k in (1, 5) else pa.int64() for k in range(7)]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            labels = [c.split(" ")[0] for c in CUT.split(", ")]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
                labels.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=labels)

    return stage(texts(docs).mapInArrow(run, CUT + (", ids array<int>" if with_ids else "")), "pieces")


def placed(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of staged pieces, and their ids where they have them."""
    counted = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most one row per length of a window.
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(counts, window)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    more = [c for c in pieces.columns if c == "ids"]
    ranked = pieces.join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank"), *more)
    names = [c.split(" ")[0] for c in PLACED.split(", ")] + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]], names=names)

    return ranked.mapInArrow(run, PLACED + (", ids array<int>" if more else ""))


def packed_pieces(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
) -> DataFrame:
    """Every piece of every document, where it lies and the checksum of its ids.

    A null or empty text is its end id alone. Rows of equal id are documents of their own; a null
    id stays null. An empty table gives no rows. The pieces are staged: the result reads them.
    """
    return placed(cut_pieces(docs, tokenizer, window, end_id), window)


def sequences(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The packed sequences: sequence_id, length, input_ids without padding, and the pieces in their order."""
    found = placed(cut_pieces(docs, tokenizer, window, end_id, with_ids=True), window)
    # At most as many pieces as tokens in a window.
    whole = found.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("pieces"))
    return whole.select(
        "sequence_id", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("input_ids"),
        F.transform("pieces", lambda p: F.struct(p["doc_id"], p["piece"], p["start"], p["length"])).alias("pieces"))
