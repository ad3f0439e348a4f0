"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two documents are linked when theirs differ in at most two. The bits
are cut into three segments. With two differing bits at most, one segment is equal in both, and
the one after it (cyclically) may be chosen to differ in at most one bit: if the errors are (0, 1, 1) the
next segment has one, and if two segments are equal, one of them follows the other.

The segment that may differ is decoded in the binary Golay code [23, 12, 7]. A word is within
distance 3 of exactly one codeword; a word at distance 3 of its own has five more at distance 4.
Words that differ in one bit always share one of these one or six codewords, so a
fingerprint has one to six keys (segment, its exact bits, index of a codeword) for each of three
segments, and linked fingerprints meet under at least one of them. Every meeting is verified.

Documents of equal fingerprint are one node from the start, so copies cost nothing. Under a key
only a spanning forest of the verified links leaves the task, which keeps all components with no
more rows than members; large keys look each member's neighbours up instead of comparing all pairs.
Components are found by rounds of alternating star contraction, checkpointed as staged tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.llm.tables import ASCII_LOWER, forget, kept, slices, texts
from wattsift.sources.staging import stage, unstage

SHINGLE = 3
SEED = 42
BITS = 2
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the code.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Members under a key above which neighbours are looked up: 2081 numbers are within two bits.
LOOK_UP = 6000


def _words(text: str) -> list[bytes]:
    # bytes.split() splits on the ASCII white space of the contract and nothing else.
    return text.encode().translate(ASCII_LOWER).split()


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, words joined by a space; fewer words than a shingle are one."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = zip(*(words[k:] for k in range(size)))
    return np.fromiter((xxh64_intdigest(b" ".join(t), SEED) for t in shingles), np.uint64, len(words) - size + 1)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """A bit is set where more than half of the hashes have it; zero for a text without words."""
    return simhash_of(shingle_hashes(_words(text), size))


def simhash_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    # How often each byte value stands at each of the eight places; then the bits of the values.
    places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    ones = (counts @ bits.astype(np.int64)).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def decoding_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error patterns (-1: none) of a syndrome."""
    low = np.array([_remainder(i) for i in range(1 << 12)], np.int64)
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.int64)
    patterns = np.full((1 << 11, 6), -1, np.int64)
    used = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            at = low[error & 4095] ^ high[error >> 12]
            patterns[at, used[at]] = error
            used[at] += 1
    return low, high, patterns


def codewords(words: np.ndarray) -> np.ndarray:
    """Indexes of the one or six codewords of each 23-bit word, -1 where there are no more."""
    low, high, patterns = kept("golay_tables", decoding_tables)
    errors = patterns[low[words & 4095] ^ high[words >> 12]]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned 64-bit fingerprints, and for each the index of its fingerprint."""
    parts = [((found >> np.uint64(b)) & np.uint64((1 << n) - 1)).astype(np.int64) for b, n in SEGMENTS]
    keys, owners = [], []
    for i in range(3):
        index = codewords(parts[(i + 1) % 3])
        key = (i << 34) | (parts[i][:, None] << 12) | index
        own = np.broadcast_to(np.arange(len(found))[:, None], index.shape)
        keys.append(key[index >= 0]), owners.append(own[index >= 0])
    return np.concatenate(keys), np.concatenate(owners)


def forest(members: np.ndarray, most: int = BITS, look_up: int = LOOK_UP) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same members as all links of at most `most` bits do, one fewer than members at most."""
    members = np.unique(members)
    n = len(members)
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    left: list[int] = []
    right: list[int] = []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(i), right.append(j)

    if n <= look_up:
        for at in range(0, n, 512):
            rows = members[at : at + 512]
            a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ members[None, at:]) <= most)
            a, b = a + at, b + at
            join(a[a < b], b[a < b])
    else:
        masks = [sum(1 << b for b in bits) for w in range(1, most + 1) for bits in combinations(range(64), w)]
        for mask in masks:
            other = members ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(members, other), n - 1)
            a = np.flatnonzero((members[at] == other) & (other > members))
            join(a, at[a])
    return members[left], members[right]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (a signed long) and a hash of the text, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        forget()
        for ids, found in slices(batches):
            made = np.array([fingerprint(t) for t in found], np.uint64)
            texts_ = np.array([xxh64_intdigest(t.encode(), SEED) for t in found], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(made.view(np.int64)), pa.array(texts_.view(np.int64))],
                names=["doc_id", "fp", "text_hash"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long, text_hash long")


def links(nodes: DataFrame) -> DataFrame:
    """Verified links (a, b), a < b as signed longs, that give all components of the distinct fingerprints."""

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            if len(found):
                keys, own = fuzzy_keys(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found[own].view(np.int64))], names=["key", "fp"])

    def to_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(members: np.ndarray):
            a, b = forest(members.view(np.uint64))
            a, b = a.view(np.int64), b.view(np.int64)
            return np.minimum(a, b), np.maximum(a, b)

        held: list[np.ndarray] = []
        current = None
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.diff(keys)) + 1
            out: list = []
            for begin, end in zip(np.append(0, cut).tolist(), np.append(cut, len(keys)).tolist()):
                if begin == end:
                    continue
                if keys[begin] != current:
                    if sum(map(len, held)) > 1:
                        out.append(made(np.concatenate(held)))
                    held, current = [], keys[begin]
                held.append(fps[begin:end])
            if out:
                yield _pairs(out)
        if sum(map(len, held)) > 1:
            yield _pairs([made(np.concatenate(held))])

    keyed = nodes.select("fp").mapInArrow(to_keys, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(to_links, "a long, b long").distinct()


def _pairs(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in found])) for k in range(2)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component of an undirected graph.

    Alternates two steps until nothing changes: every node tells its larger neighbours of its
    smallest one, then every node hands its smaller neighbours on to the smallest of them. Both are
    a group-by with map-side combine and a join that adaptive execution can split; the number of
    edges never grows, and rounds grow with the logarithm of the size.
    """
    edges = stage(edges, "star")
    while True:
        before = edges
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stage(
            both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "star")
        # Here every edge goes from the larger (a) to the smaller (b).
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b"))).distinct()
        after = stage(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "star")
        changed = after.exceptAll(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).limit(1).count()
        edges = after
        unstage(large, before)
        if not changed:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash and component_id of every row."""
    found = stage(fingerprints(docs), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = components(links(nodes))
    placed = nodes.join(named, nodes["fp"] == named["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # A fingerprint may be that of a third of all documents: the join can be split, unlike a window.
    known = placed.select("fp", "root").join(first, "root").select("fp", "component_id")
    return found.join(known, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that is reachable.

    A null text has no words, like an empty one. Rows of equal id each have a row. A null id is
    never the smallest; a component of null ids only has a null component_id.
    """
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one row of each group: that of the smallest id.

    Where that id has several rows, the text of the smallest hash stays, once. Rows without an id
    stay only where their whole group has none; of those, equal texts stay once.
    """
    first = grouped(docs).where("doc_id <=> component_id")
    # Ids are in one group only, but for ids that have several texts.
    wanted = stage(
        first.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("of_text")).agg(
            F.min("text_hash").alias("wanted"), F.count("*").alias("rows")), "kept-ids")
    hashed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))

    def of(chosen: DataFrame) -> DataFrame:
        same = hashed["doc_id"].cast("long").eqNullSafe(chosen["doc_id"]) & (hashed["_text_hash"] == chosen["wanted"])
        return hashed.join(chosen, same, "left_semi")

    # Only rows of ids that occur again are compared as a whole.
    several = of(wanted.where("rows > 1")).dropDuplicates(["doc_id", "_text_hash"])
    return of(wanted.where("rows = 1")).unionByName(several).drop("_text_hash")
