"""Substring removal with difference-cover anchors.

A window of 20 consecutive words is removed where its words start earlier as well, in a document of
smaller id or earlier in the same one. Hashing every window of every document for
that would shuffle several times the corpus.

Residues {0, 1, 3, 9} modulo 13 are a difference cover: for any two positions there is an offset
below 13 that brings both to a residue of the set. So if two windows are equal, some run of 8 words inside
them starts at such a position in both. Only these runs, 4 of 13, are hashed at first
(`anchors`). Anchors that occur once prove that no window around them repeats.

Windows that hold a repeated anchor are extended: they are hashed in full (96 bits), and the earliest
occurrence of each is found. All others are removed. Questions travel as in `exchange`:
a block asks every anchor and every window once, with the earliest place it has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wattsift.llm.exchange import (
    answer, ask, conclude, in_blocks, pack_flags, pack_numbers, pack_parts, pack_sorted, rows_of, shard_cuts, told,
    unpack_flags, unpack_numbers, unpack_parts, unpack_sorted,
)

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHORS, WINDOWS = 0, 1
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def check_cover(period: int, cover: tuple[int, ...], window: int) -> int:
    """The number of words of an anchor; the set must have every difference modulo the period."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover")
    if window < period:
        raise ValueError("the window is shorter than the period")
    return window - period + 1


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Block:
    """Words of a block's documents as numbers, one after the other, and the hashes of their windows."""

    def __init__(self, texts: list[str]):
        from xxhash import xxh3_128_digest

        place: dict[bytes, int] = {}
        numbers = [np.array([place.setdefault(w, len(place)) for w in t.encode().split()], np.int64) for t in texts]
        self.sizes = np.array([len(n) for n in numbers], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([*numbers, np.zeros(0, np.int64)])
        seen = np.frombuffer(b"".join(map(xxh3_128_digest, place)), np.uint64).reshape(-1, 2)
        self.value = np.ascontiguousarray(seen.T) if len(place) else np.zeros((2, 0), np.uint64)
        # Document of each word, place in it, and how many words follow.
        self.doc = np.repeat(np.arange(len(numbers)), self.sizes)
        self.at = np.arange(len(self.words)) - self.begin[self.doc]
        self.left = self.sizes[self.doc] - self.at

    def hashes(self, at: np.ndarray, size: int, half: int, seed: int) -> np.ndarray:
        """Of the runs of `size` words that start at the given places."""
        value = self.value[half][self.words]
        h = np.zeros(len(at), np.uint64)
        for k, m in enumerate(multipliers(size, seed)):
            h += mix(value[at + k] + m) * m
        return mix(h)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, which of them occur more than once, and the place of every key among them."""
    found, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return found, counts > 1, inverse


class Windows:
    """What a block works out from its documents, the same each time."""

    def __init__(self, table: pa.Table, window: int, period: int, cover: tuple[int, ...]):
        self.window, self.period = window, period
        self.size = check_cover(period, cover, window)
        self.texts = table.column("text").to_pylist()
        # A missing id comes before all others; rows of equal id are told apart by their texts.
        ids = [(-(1 << 63) if i is None else i, t) for i, t in zip(table.column("doc_id").to_pylist(), self.texts)]
        self.ids = np.array([i for i, _ in ids], np.int64)
        self.block = Block(self.texts)
        in_cover = np.zeros(period, bool)
        in_cover[list(cover)] = True
        b = self.block
        self.places = np.flatnonzero(in_cover[b.at % period] & (b.left >= self.size) & (b.sizes[b.doc] >= window))
        self.keys, self.often, self.inverse = distinct(b.hashes(self.places, self.size, 0, 1))

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor."""
        b = self.block
        found = self.places[repeated[self.inverse]]
        mark = np.zeros(len(b.words) + 1, np.int32)
        # An anchor is in the windows that start at most period - 1 words before it.
        first = np.maximum(found - (self.period - 1), b.begin[b.doc[found]]) if len(found) else found
        np.add.at(mark, first, 1)
        np.add.at(mark, found + 1, -1)
        return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (b.left >= self.window))

    def extended(self, repeated: np.ndarray):
        """Starts, sorted distinct hashes (64 and 32 bits), the earliest start of each, and each start's hash."""
        b = self.block
        at = self.candidates(repeated)
        high = b.hashes(at, self.window, 0, 2)
        low = b.hashes(at, self.window, 1, 3) >> np.uint64(32)
        rank = np.empty(len(self.ids), np.int64)
        rank[sorted(range(len(self.ids)), key=lambda i: (self.ids[i], self.texts[i]))] = np.arange(len(self.ids))
        order = np.lexsort((b.at[at], rank[b.doc[at]], low, high))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]
        return at, high[first], low[first], at[first], group


def repeated_anchors(got: pa.Table, often: np.ndarray) -> np.ndarray:
    flags = [unpack_flags(a) for a in told(got, ANCHORS)]
    return np.concatenate(flags) if flags else np.zeros(len(often), bool)


def _fields(digest: bool, given: DataFrame) -> list[tuple[str, pa.DataType]]:
    if digest:
        return [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    return [(f.name, f.type) for f in to_arrow_schema(given.schema)]


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, digest: bool = False,
) -> DataFrame:
    """The documents without repeated windows; all columns, with the kept words joined by a space.

    A document of which nothing is removed keeps its text as it is; one of which all is removed
    keeps a row with an empty text. `n_chars`, where there is one, follows the text. With
    `digest`: doc_id, n_words, n_removed and kept_sha256 instead. A null text has no words. Of rows
    of equal id the smaller text comes first; rows of equal id and text are one document's copies,
    and are all treated as the first. A missing id comes before all others.
    """
    check_cover(period, cover, window)
    others = [] if digest else [c for c in docs.columns if c not in ("doc_id", "text")]
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        *([F.struct(*others).alias("others")] if others else []))
    blocks, _, shards = in_blocks(given)
    def anchor_questions(table: pa.Table):
        own = Windows(table, window, period, cover)
        cut = shard_cuts(own.keys, shards).tolist()
        return [(s, ANCHORS, pack_parts([pack_sorted(own.keys[b:e]), pack_flags(own.often[b:e])]))
                for s, (b, e) in enumerate(zip(cut, cut[1:])) if e > b]

    def anchor_answers(_: int, asked: list[bytes]) -> list[bytes]:
        parts = [unpack_parts(a) for a in asked]
        keys = [unpack_sorted(p[0]) for p in parts]
        often = [unpack_flags(p[1]) for p in parts]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        same = np.diff(flat[order]) == 0
        repeated = np.concatenate(often)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        ends = np.cumsum([len(k) for k in keys])
        return [pack_flags(repeated[e - len(k) : e]) for k, e in zip(keys, ends)]

    def window_questions(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_of(["shard", "block", "kind", "asked"], [])
        number = table.column("block")[0].as_py()
        own = Windows(table, window, period, cover)
        _, high, low, first, _ = own.extended(repeated_anchors(got, own.often))
        b = own.block
        ids = own.ids[b.doc[first]].view(np.uint64) ^ np.uint64(1 << 63)
        cut = shard_cuts(high, shards).tolist()
        rows = []
        for s, (x, y) in enumerate(zip(cut, cut[1:])):
            if x == y:
                continue
            least = ids[x:y].min()
            rows.append((s, number, WINDOWS, pack_parts([
                pack_sorted(high[x:y]), pack_numbers(low[x:y]), pack_numbers(ids[x:y] - least),
                pack_numbers(np.array([least])), pack_numbers(b.at[first[x:y]].astype(np.uint64))])))
        return rows_of(["shard", "block", "kind", "asked"], rows)

    def window_answers(_: int, asked: list[bytes]) -> list[bytes]:
        """Whether the earliest place that a block has is the earliest of all."""
        parts = [unpack_parts(a) for a in asked]
        high = [unpack_sorted(p[0]) for p in parts]
        sizes = [len(h) for h in high]
        low = np.concatenate([unpack_numbers(p[1]) for p in parts])
        ids = np.concatenate([unpack_numbers(p[2]) + unpack_numbers(p[3]) for p in parts])
        at = np.concatenate([unpack_numbers(p[4]) for p in parts])
        flat = np.concatenate(high)
        order = np.lexsort((at, ids, low, flat))
        first = np.zeros(len(order), bool)
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(flat[order]) != 0) | (np.diff(low[order]) != 0)
        first[order[new]] = True
        ends = np.cumsum(sizes)
        return [pack_flags(first[e - n : e]) for n, e in zip(sizes, ends)]

    empty = pa.table({k: pa.array([], v) for k, v in _fields(digest, given)})

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        own = Windows(table, window, period, cover)
        b = own.block
        at, _, _, first, group = own.extended(repeated_anchors(got, own.often))
        flags = [unpack_flags(a) for a in told(got, WINDOWS)]
        earliest = np.concatenate(flags) if flags else np.zeros(len(first), bool)
        stays = np.zeros(len(at), bool)
        if len(at):
            # The earliest place of a window stays, in all copies of its row.
            place = b.at[at] == b.at[first[group]]
            alike = [own.texts[i] == own.texts[j] and own.ids[i] == own.ids[j]
                     for i, j in zip(b.doc[at[place]].tolist(), b.doc[first[group[place]]].tolist())]
            stays[np.flatnonzero(place)[np.array(alike, bool)]] = True
            stays &= earliest[group]
        mark = np.zeros(len(b.words) + 1, np.int32)
        np.add.at(mark, at[~stays], 1)
        np.add.at(mark, at[~stays] + window, -1)
        gone = np.cumsum(mark[:-1]) > 0
        ids = table.column("doc_id")
        removed = np.bincount(b.doc[gone], minlength=len(own.texts)) if len(b.words) else np.zeros(len(own.texts), np.int64)
        kept = []
        for text, n, begin in zip(own.texts, removed.tolist(), b.begin.tolist()):
            words = text.encode().split() if n else []
            kept.append(b" ".join(w for w, g in zip(words, gone[begin : begin + len(words)].tolist()) if not g) if n else None)
        if digest:
            sums = [hashlib.sha256(b" ".join(t.encode().split()) if k is None else k).hexdigest() for t, k in zip(own.texts, kept)]
            return pa.table({"doc_id": ids, "n_words": pa.array(b.sizes), "n_removed": pa.array(removed.astype(np.int64)),
                             "kept_sha256": pa.array(sums, pa.string())})
        new = pa.array([t if k is None else k.decode() for t, k in zip(own.texts, kept)], pa.string())
        columns = {"doc_id": ids, "text": new}
        if others:
            columns["others"] = table.column("others")
        return pa.table(columns)

    schema = DIGEST if digest else given.schema
    first = answer(ask(blocks, anchor_questions), anchor_answers)
    second = answer(conclude(blocks, first, window_questions, "shard int, block int, kind int, asked binary"), window_answers)
    done = conclude(blocks, first.unionByName(second), finish, schema)
    if digest:
        return done
    done = done.select("doc_id", "text", *(F.col("others")[c].alias(c) for c in others))
    if "n_chars" in others:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
