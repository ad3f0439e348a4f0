"""Fill-in-middle examples, cut between tokens by content-defined chunks that are summed up once.

A token is a run of letters A-Z and a-z, or any other character. A text is cut into chunks where a rolling hash
of its last 32 bytes says so, so equal passages fall into equal chunks wherever they stand. A chunk's summary
is kept by its content and found again only by equal content: its tokens, the letters it begins with, whether
it ends with one, its bytes. Chunks combine: a run of letters that crosses a border counts once.
The sums say in which chunk the k-th token ends, and only that chunk is looked at again.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.llm.tables import kept, slices, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Per cent of the texts that are rearranged, and of those, that begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
LEAST, MOST, MASK = 256, 4096, np.uint32(0x3FF << 22)
# Bytes of the chunks of a generation.
CHUNK_BYTES = 16_000_000
EXAMPLES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _spread(n: int) -> np.ndarray:
    """A well mixed 32-bit number for each of 0..n-1."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _spread(256)


def letters(data: np.ndarray) -> np.ndarray:
    low = data | np.uint8(32)
    return (low >= ord("a")) & (low <= ord("z")) & (data < 128)


def rolling(data: np.ndarray) -> np.ndarray:
    """At every byte the hash of the 32 bytes that end there: each weighs twice the one after it."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h[:-k] << np.uint32(k)
        h[k:] += more
    return h


def borders(data: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text end; texts end at `ends` and chunks between characters."""
    spots = (np.flatnonzero((rolling(data) & MASK) == 0) + 1).tolist() if len(data) else []
    out, at = [], 0
    for end in ends.tolist():
        own = []
        while end - at > LEAST:
            k = bisect_left(spots, at + LEAST)
            cut = min(spots[k] if k < len(spots) else end, at + MOST)
            while cut < end and data[cut] & 0xC0 == 0x80:
                cut += 1
            if cut >= end:
                break
            own.append(cut)
            at = cut
        if end > at:
            own.append(end)
        at = end
        out.append(own)
    return out


def token_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bytes begin a token when every piece that ends at `ends` stands alone."""
    letter = letters(data)
    follows = np.zeros(len(data), bool)
    follows[1:] = letter[:-1]
    follows[ends[:-1]] = False
    return np.where(letter, ~follows, data & 0xC0 != 0x80)


def summaries(chunks: list[bytes]) -> np.ndarray:
    """Per chunk: tokens, letters at its beginning, 1 if it ends with a letter, bytes."""
    data = np.frombuffer(b"".join(chunks), np.uint8)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    letter = letters(data)
    other = np.append(np.flatnonzero(~letter), len(data))
    lead = np.minimum(other[np.searchsorted(other, starts)], ends) - starts
    tokens = np.add.reduceat(token_starts(data, ends).astype(np.int64), starts)
    return np.stack([tokens, lead, letter[ends - 1].astype(np.int64), sizes], axis=1)


class Summaries:
    """Summaries by content, the last used in two generations of bounded size."""

    def __init__(self, most: int = CHUNK_BYTES):
        self.most, self.held = most, 0
        self.new: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}

    def get(self, chunks: list[bytes]) -> np.ndarray:
        if self.held > self.most:
            self.old, self.new, self.held = self.new, {}, 0
        fresh = []
        for chunk in set(chunks).difference(self.new):
            if chunk in self.old:
                self.new[chunk] = self.old[chunk]
            else:
                fresh.append(chunk)
            self.held += len(chunk)
        if fresh:
            self.new.update(zip(fresh, summaries(fresh)))
        return np.stack([self.new[c] for c in chunks])


class Chunked:
    """A text's chunks with their sums: answers where its k-th token ends."""

    def __init__(self, text: bytes, summary: np.ndarray):
        self.text = text
        self.tokens, self.lead, last, self.sizes = summary.T if len(summary) else np.zeros((4, 0), np.int64)
        self.joined = np.zeros(len(self.tokens), bool)
        self.joined[1:] = (last[:-1] == 1) & (self.lead[1:] > 0)
        self.upto = np.cumsum(self.tokens - self.joined)
        self.ends = np.cumsum(self.sizes)
        self.n = int(self.upto[-1]) if len(self.upto) else 0

    def end_of(self, k: int) -> int:
        """The byte where the first k tokens end."""
        if k == 0:
            return 0
        j = int(np.searchsorted(self.upto, k))
        begin, end = int(self.ends[j] - self.sizes[j]), int(self.ends[j])
        own = k - (int(self.upto[j - 1]) if j else 0) + int(self.joined[j])
        if own < self.tokens[j]:
            data = np.frombuffer(self.text, np.uint8)[begin:end]
            return begin + int(np.flatnonzero(token_starts(data, np.array([len(data)])))[own])
        # The chunk's last token may go on into the chunks after it.
        while j + 1 < len(self.joined) and self.joined[j + 1]:
            j += 1
            end += int(self.lead[j])
            if self.lead[j] < self.sizes[j]:
                break
        return end


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def example(doc_id: int | None, text: bytes, chunked: Chunked, seed: int, rate: int, suffix_first: int) -> tuple:
    n = chunked.n
    one, two, three, four = draws(doc_id, seed)
    if not text or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = (chunked.end_of(k) for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < suffix_first:
        form, output = "spm", SUFFIX.encode() + suffix + PREFIX.encode() + prefix + MIDDLE.encode() + middle
    else:
        form, output = "psm", PREFIX.encode() + prefix + SUFFIX.encode() + suffix + MIDDLE.encode() + middle
    return doc_id, n, form, len(prefix.decode()), len(middle.decode()), output


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n tokens, form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    The draws of a row depend on the seed and its id alone. Null and empty texts, texts that hold a
    control string and those beyond the rate are plain: their own text, without lengths. Rows of equal id are
    drawn alike, each with its own text; a null id is drawn as an empty one. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept("chunk_summaries", Summaries)
        for names, found in slices(batches):
            raw = [t.encode() for t in found]
            ends = np.cumsum([len(t) for t in raw])
            data = b"".join(raw)
            cuts = borders(np.frombuffer(data, np.uint8), ends)
            flat = [c for own in cuts for c in own]
            chunks = [data[a:b] for a, b in zip([0, *flat], flat)]
            summary = known.get(chunks) if chunks else np.zeros((0, 4), np.int64)
            rows, at = [], 0
            for name, text, own in zip(names, raw, cuts):
                rows.append(example(name, text, Chunked(text, summary[at : at + len(own)]), seed, rate, suffix_first))
                at += len(own)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(
                [*columns[:5], columns[5].cast(pa.string())], names=[c.split(" ")[0] for c in EXAMPLES.split(", ")])

    return texts(docs).mapInArrow(run, EXAMPLES)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no control string."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))).when(
        form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))).otherwise(output)


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """The examples with the digests of their outputs and of the texts that come back from them."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
