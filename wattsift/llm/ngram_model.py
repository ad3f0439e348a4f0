"""An n-gram model of words in sharded Elias-Fano tries, and the scores of whole texts.

A token is a word, or the end that follows every text; the end also stands before the first word.
Levels k = 2..order of a trie hold, for every context of k - 1 tokens, the sorted tokens that followed it in
training. Contexts of level 2 are a sorted list; those of a higher level are the entries of the one below, by their
place. Monotone pointers say where a context's successors begin; pointers and
successors are Elias-Fano sequences. A successor is stored relative to its context: context number times
the size of the shard's vocabulary plus the token's number there, which makes the whole level one rising sequence. A
lookup walks from level to level: an entry's place leads to its pointers, and between them the successor of that number is
searched. Each entry has a quantised probability code.

Smoothing is Dirichlet's: P(w | h) = (c(h w) + mu P(w | h')) / (c(h) + mu), down to P(w) = (c(w) + 1) / (N + V + 1), where
all unknown words share one. The code of an entry is its numerator's logarithm: counts are exact up to 64 and in steps of
2 % above. Denominators are counts of one order less, which the scorer has anyway.

Nothing is held whole. Counts are asked from shards as in `exchange`, first those of single tokens: a token's shard adds up
what all blocks bring and numbers its tokens, so that n-grams travel as short numbers that no two tokens share. Then blocks ask for
n-grams: a shard adds them up, builds its part of the trie in memory-mapped files, looks every distinct n-gram up
in it, and deletes the files. An n-gram is asked where the one that it continues is, so that a block sends its own trie, without
contexts above level 2. Successors are dealt to more shards the more often their context can occur, which the counts of its tokens
bound, so a very common word or pair is no burden; a rare one stays in one shard. A context stands in every shard of its successors.
What the blocks bring grows with the corpus.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.llm.anchors import mix
from wattsift.llm.exchange import (
    ASKED, answer, ask, conclude, in_blocks, pack_numbers, pack_parts, pack_sorted, rows_of, shard_cuts, shard_of, to_all_blocks, told,
    unpack_numbers, unpack_parts, unpack_sorted,
)
from wattsift.llm.tables import texts

ORDER = 3
MU = 200.0
# Successors of a context go to so many shards that each gets at most this part of what a shard has on average.
PARTS = 16
# N-grams that are looked up at once.
SLICE = 500_000
# Kinds of questions and answers: sums over all shards, single tokens, n-grams.
SUMS, TOKENS, GRAMS = 0, 1, 2
EXACT_COUNTS, STEP = 64, 1.02
# A one in each byte of a word, and by 256 * rank + byte the place of the byte's one of that rank.
EACH = 0x0101010101010101
IN_BYTE = np.argsort(~np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool), axis=1, kind="stable").T.reshape(-1)
SCORES = "doc_id long, n_tokens long, n_known long, log_counts double, vocabulary long, train_tokens long, score double"


def count_code(counts: np.ndarray) -> np.ndarray:
    c = np.asarray(counts, float)
    return np.where(c <= EXACT_COUNTS, c, EXACT_COUNTS + np.round(np.log(np.maximum(c, 1) / EXACT_COUNTS) / np.log(STEP))).astype(np.int64)


def count_of(code: np.ndarray) -> np.ndarray:
    k = np.asarray(code, float)
    return np.where(k <= EXACT_COUNTS, k, EXACT_COUNTS * STEP ** np.maximum(k - EXACT_COUNTS, 0))


class EliasFano:
    """A rising sequence: low bits packed, high bits as a bit per value and one per step."""

    def __init__(self, folder: str, name: str, values: np.ndarray | None = None, universe: int = 0):
        self.base = os.path.join(folder, name)
        if values is not None:
            self._write(np.asarray(values, np.uint64), universe)
        head = np.load(f"{self.base}-head.npy")
        self.n, self.low_bits = int(head[0]), int(head[1])
        self.low, self.high, self.ones = (np.load(f"{self.base}-{p}.npy", mmap_mode="r") for p in ("low", "high", "ones"))

    def _write(self, values: np.ndarray, universe: int) -> None:
        n = len(values)
        bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = (int(place[-1]) if n else 0) // 64 + 2
        high = np.zeros(words * 64, np.uint8)
        high[place] = 1
        packed = np.packbits(high, bitorder="little").view(np.uint64)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            kept = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, kept << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, kept[over] >> (np.uint64(64) - shift[over]))
        np.save(f"{self.base}-head.npy", np.array([n, bits]))
        np.save(f"{self.base}-low.npy", low)
        np.save(f"{self.base}-high.npy", packed)
        # Ones before each word of high bits.
        np.save(f"{self.base}-ones.npy", np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """Place of the rank-th (from 0) one or zero."""
        before = self.ones if one else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, rank, side="right") - 1
        left = (rank - before[word]).astype(np.uint64)
        bits = self.high[word] if one else ~self.high[word]
        # Ones up to the end of each byte, all eight sums in one word.
        sums = bits - ((bits >> np.uint64(1)) & np.uint64(0x55 * EACH))
        sums = (sums & np.uint64(0x33 * EACH)) + ((sums >> np.uint64(2)) & np.uint64(0x33 * EACH))
        sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F * EACH)) * np.uint64(EACH)
        # Bytes whose sum is at most the rank lie before the one that is wanted.
        most = ((left * np.uint64(EACH) | np.uint64(0x80 * EACH)) - sums) & np.uint64(0x80 * EACH)
        at = np.bitwise_count(most).astype(np.uint64) << np.uint64(3)
        left -= ((sums << np.uint64(8)) >> at) & np.uint64(0xFF)
        inside = IN_BYTE[(left << np.uint64(8)) | ((bits >> at) & np.uint64(0xFF))]
        return word * 64 + (at.astype(np.int64) + inside)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        value = self.low[word] >> shift
        more = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value | more) & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, True) - at).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(at)

    def find(self, values: np.ndarray, least: np.ndarray | int = 0, until: np.ndarray | int | None = None) -> np.ndarray:
        """Place of each value, from `least` to before `until`, -1 where it is not there: the successor search, one bucket of
        equal high bits at a time."""
        if not self.n:
            return np.full(len(values), -1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        most = int((len(self.ones) - 1) * 64 - self.ones[-1])
        inside = high < most
        high = np.where(inside, high, 0)
        # Ones before the end of step `high - 1` and of step `high`.
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = np.minimum(self._select(high, False) - high, self.n)
        begin, end = np.maximum(begin, least), np.minimum(end, self.n if until is None else until)
        low = values & np.uint64((1 << self.low_bits) - 1)
        out = np.full(len(values), -1)
        open_ = np.flatnonzero(inside & (begin < end))
        while len(open_):
            middle = (begin[open_] + end[open_]) // 2
            seen = self._low(middle)
            hit = seen == low[open_]
            out[open_[hit]] = middle[hit]
            less = seen < low[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            end[open_] = np.where(less, end[open_], middle)
            open_ = open_[~hit & (begin[open_] < end[open_])]
        return out


class Level:
    """Contexts, pointers, successors and codes of one order in memory-mapped files."""

    def __init__(
        self, folder: str, contexts: np.ndarray, tokens: np.ndarray, counts: np.ndarray, parents: int | None = None,
        vocabulary: np.ndarray | None = None,
    ):
        """With `parents`, contexts are the places of that many entries of the level below. With `vocabulary`, tokens are places in
        that sorted list, and entries rise and do not repeat."""
        os.makedirs(folder, exist_ok=True)
        if vocabulary is None:
            order = np.lexsort((tokens, contexts))
            c, w, n = contexts[order], tokens[order], counts[order]
            new = np.ones(len(c), bool)
            new[1:] = (np.diff(c) != 0) | (np.diff(w) != 0)
            c, w, n = c[new], w[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n
            vocabulary, number = np.unique(w, return_inverse=True)
            self.number = np.arange(len(vocabulary))
        else:
            c, n = contexts, counts
            used = np.bincount(tokens, minlength=len(vocabulary)) > 0
            self.number = np.where(used, np.cumsum(used) - 1, -1)
            vocabulary, number = vocabulary[used], self.number[tokens]
        self.size = max(1, len(vocabulary))
        if parents is None:
            first = np.flatnonzero(np.diff(c, prepend=~c[:1]))
            known = c[first]
            owner = np.repeat(np.arange(len(known)), np.diff(first, append=len(c)))
            np.save(f"{folder}/contexts.npy", known)
            self.contexts = np.load(f"{folder}/contexts.npy", mmap_mode="r")
        else:
            owner, self.contexts = c.astype(np.int64), None
            first = np.searchsorted(owner, np.arange(parents))
        np.save(f"{folder}/vocabulary.npy", vocabulary)
        np.save(f"{folder}/codes.npy", count_code(n).astype(np.uint16))
        self.successors = EliasFano(
            folder, "successors", (owner * self.size + number).astype(np.uint64), len(first) * self.size)
        self.pointers = EliasFano(folder, "pointers", np.append(first, len(c)), len(c) + 1)
        self.vocabulary, self.codes = (np.load(f"{folder}/{p}.npy", mmap_mode="r") for p in ("vocabulary", "codes"))

    @staticmethod
    def _place(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(sorted_values):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
        return np.where(sorted_values[at] == wanted, at, -1)

    def find(self, contexts: np.ndarray, tokens: np.ndarray, numbers: bool = False) -> np.ndarray:
        """Places of the wanted entries, -1 where there is none; a context that is the place -1 has none. With `numbers`, tokens
        are places in the vocabulary that the level was given. A run of equal contexts is looked up once."""
        w = self.number[tokens] if numbers else self._place(self.vocabulary, tokens)
        begins = np.flatnonzero(np.diff(contexts, prepend=~contexts[:1]))
        runs = np.diff(begins, append=len(contexts))
        c = contexts[begins] if self.contexts is None else self._place(self.contexts, contexts[begins])
        known = np.maximum(c, 0)
        least, until = (self.pointers.get(known + k).astype(np.int64) if len(self.codes) else known for k in (0, 1))
        c, least, until = (np.repeat(x, runs) for x in (c, least, until))
        out = np.full(len(contexts), -1)
        there = np.flatnonzero((c >= 0) & (w >= 0))
        out[there] = self.successors.find((c[there] * self.size + w[there]).astype(np.uint64), least[there], until[there])
        return out

    def codes_at(self, places: np.ndarray) -> np.ndarray:
        """Codes of the entries, 0 for the place -1."""
        out = np.zeros(len(places), np.int64)
        out[places >= 0] = self.codes[places[places >= 0]]
        return out

    def lookup(self, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Codes of the wanted entries, 0 where there is none."""
        return self.codes_at(self.find(contexts, tokens))

    def successors_of(self, context: int) -> np.ndarray:
        """Tokens that follow a context, through its pointers."""
        at = self._place(self.contexts, np.array([context], np.uint64))
        if at[0] < 0:
            return np.zeros(0, np.uint64)
        begin, end = self.pointers.get(np.array([at[0], at[0] + 1])).astype(np.int64)
        return self.vocabulary[(self.successors.get(np.arange(begin, end)).astype(np.int64)) - at[0] * self.size]


def trained(doc_id: Column) -> Column:
    """A missing id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


class Tokens:
    """Tokens of a block: numbers, hashes, and what each document and position is."""

    def __init__(self, table: pa.Table):
        from xxhash import xxh3_128_digest

        # Arrow lower-cases A-Z only and splits at the same six blanks.
        split = pc.ascii_split_whitespace(pc.ascii_lower(table.column("text").cast(pa.large_string())))
        words = pc.list_flatten(split).combine_chunks()
        there = np.asarray(pc.binary_length(words)) > 0
        owner = np.repeat(np.arange(table.num_rows), np.asarray(pc.list_value_length(split), np.int64))
        self.sizes = np.bincount(owner[there], minlength=table.num_rows) + 1
        if not there.all():
            words = words.filter(pa.array(there))
        words = words.dictionary_encode()
        # No word is empty: the end, after every text, is number 0.
        self.token = np.zeros(len(words) + table.num_rows, np.int64)
        inside = np.ones(len(self.token), bool)
        inside[np.cumsum(self.sizes) - 1] = False
        self.token[inside] = np.asarray(words.indices) + 1
        distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        seen = np.frombuffer(b"".join(map(xxh3_128_digest, [b"", *distinct])), np.uint64).reshape(-1, 2)
        self.high, self.low = seen[:, 0].copy(), seen[:, 1] >> np.uint64(32)
        self.training = np.repeat(table.column("training").to_numpy(zero_copy_only=False), self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.order = _rising(self.high, self.low)


def _distinct(values: np.ndarray) -> np.ndarray:
    rising = np.sort(values)
    new = np.ones(len(rising), bool)
    new[1:] = np.diff(rising) != 0
    return rising[new]


def _in_order(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys from 0 to before `below`, the first place there of each distinct key, and which of these each key is."""
    bits = len(keys).bit_length()
    if int(below).bit_length() + bits < 64:
        # Sorting numbers is several times faster than sorting their places.
        by = np.sort(keys << bits | np.arange(len(keys)))
        rising = by >> bits
        by &= (1 << bits) - 1
    else:
        by = np.argsort(keys)
        rising = keys[by]
    new = np.flatnonzero(np.diff(rising, prepend=-1))
    group = np.empty(len(by), np.int64)
    group[by] = np.repeat(np.arange(len(new)), np.diff(new, append=len(by)))
    return by, new, group


def _rising(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order by both numbers; equal `high` are so rare that mostly one sort is enough."""
    by = np.argsort(high)
    again = np.flatnonzero(np.diff(high[by]) == 0)
    return np.lexsort((low, high)) if (low[by[again]] > low[by[again + 1]]).any() else by


class Grams:
    """Distinct n-grams of one order in a block, rising, and the entries that ask for them: one in the shard of the
    n-gram, and one in every other shard that has n-grams which continue it."""

    def __init__(self, parent: np.ndarray, token: np.ndarray, counts: np.ndarray, shard: np.ndarray, least: np.ndarray):
        self.parent, self.token, self.counts, self.shard = parent, token, counts, shard
        # Occurrences of the rarest token in all training texts: the n-gram has no more.
        self.least = least
        # Positions of the block that end such an n-gram, and which one.
        self.where = self.group = np.zeros(0, np.int64)
        # Entries by shard, and the entry of the n-gram that each continues.
        self.at = self.gram = self.above = np.zeros(0, np.int64)

    def enter(self, below: Grams | None, shards: int) -> None:
        self.at, self.gram = self.shard, np.arange(len(self.shard))
        if below is not None:
            context = below.parent[below.gram]
            away = below.at != self.shard[context]
            more = np.unique(below.at[away] * len(self.shard) + context[away])
            if len(more):
                gram = np.concatenate([self.gram, more % len(self.shard)])
                by = np.argsort(gram, kind="stable")
                self.at, self.gram = np.concatenate([self.at, more // len(self.shard)])[by], gram[by]
        by = np.argsort(self.at.astype(np.uint16 if shards < 1 << 16 else np.int64), kind="stable")
        self.at, self.gram = self.at[by], self.gram[by]
        if below is not None:
            keys = self.at * len(self.shard) + self.gram
            below.above = np.searchsorted(keys, below.at * len(self.shard) + below.parent[below.gram])

    def own(self, of_entries: np.ndarray) -> np.ndarray:
        """Values of the n-grams from those of their entries."""
        mine = self.at == self.shard[self.gram]
        out = np.zeros(len(self.shard), of_entries.dtype)
        out[self.gram[mine]] = of_entries[mine]
        return out


def _grams(own: Tokens, ids: np.ndarray, counts: np.ndarray, total: int, order: int, shards: int) -> tuple[np.ndarray, list[Grams]]:
    """Sorted numbers of a block's tokens, and its n-grams of orders 2 to `order`, each under the one it continues.

    Nothing here depends on the order of a block's rows: tokens are named by the numbers that their shards gave them.
    """
    by = np.argsort(ids)
    known, often = ids[by], counts[by]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    token = rank[own.token]
    at = np.arange(len(token)) - np.repeat(own.begin, own.sizes)
    # Before the first token stands the end.
    parent = np.append(rank[0], token[:-1])
    parent[own.begin] = rank[0]
    where = np.arange(len(token))
    levels: list[Grams] = []
    for k in range(2, order + 1):
        keys = parent[where] * len(known) + token[where]
        by, new, group = _in_order(keys, len(token) * len(known))
        found = keys[by[new]]
        seen = np.bincount(group, own.training[where], len(found)).astype(np.uint64)
        above, last = found // len(known), found % len(known)
        home, least = (_first_shard(known[above], shards), often[above]) if k == 2 else (levels[-1].shard[above], levels[-1].least[above])
        shard = (home + _slice_of(known[last], k, spread(least, total, shards))) % shards
        levels.append(Grams(above, last, seen, shard, np.minimum(least, often[last])))
        levels[-1].where, levels[-1].group = where, group
        ends = np.full(len(token), -1)
        ends[where] = group
        parent = np.append(-1, ends[:-1])
        where = np.flatnonzero(at >= k - 1)
    below = None
    for g in reversed(levels):
        g.enter(below, shards)
        below = g
    return known, levels


def spread(counts: np.ndarray, total: int, shards: int) -> np.ndarray:
    """How many shards have the successors of contexts that occur at most so often among `total` tokens."""
    return np.clip(np.ceil(PARTS * shards * (counts / max(1, total))), 1, shards).astype(np.int64)


def _scaled(h: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
    return ((mix(h) >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64)


def _first_shard(first: np.ndarray, shards: int) -> np.ndarray:
    return _scaled(mix(first + np.uint64(1)), np.uint64(shards))


def _slice_of(token: np.ndarray, order: int, slices: np.ndarray) -> np.ndarray:
    out = np.zeros(len(token), np.int64)
    many = np.flatnonzero(slices > 1)
    out[many] = _scaled(mix(token[many] + np.uint64(order << 56)), slices[many].astype(np.uint64))
    return out


def _log_sums(values: np.ndarray, own: Tokens) -> np.ndarray:
    return np.add.reduceat(values, own.begin) if len(own.begin) else np.zeros(0)


def score_texts(docs: DataFrame, order: int = ORDER, mu: float = MU, training: Column | None = None) -> DataFrame:
    """Scores of every row by a model of the rows in training (default: as `trained` says).

    doc_id, n_tokens, n_known, train_tokens, base_score and score, both log10 probabilities. A null text is an empty
    one: its only token is the end. Every row counts for itself, also with an id that others have.
    """
    given = texts(docs).withColumn("training", trained(F.col("doc_id")) if training is None else training)
    blocks, number, shards = in_blocks(given)

    def token_questions(table: pa.Table):
        own = Tokens(table)
        seen = np.bincount(own.token, own.training, len(own.high)).astype(np.uint64)
        o = own.order
        cut = shard_cuts(own.high[o], shards).tolist()
        return [(s, TOKENS, pack_parts([pack_sorted(own.high[o[b:e]]), pack_numbers(own.low[o[b:e]]), pack_numbers(seen[o[b:e]])]))
                for s, (b, e) in enumerate(zip(cut, cut[1:])) if e > b]

    def token_totals(asked: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Counts of a shard's distinct tokens, rising; which one each question is about, and where a block's questions end."""
        parts = [unpack_parts(a) for a in asked]
        high = [unpack_sorted(p[0]) for p in parts]
        flat = np.concatenate(high)
        low, n = (np.concatenate([unpack_numbers(p[k]) for p in parts]) for k in (1, 2))
        by = _rising(flat, low)
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(flat[by]) != 0) | (np.diff(low[by]) != 0)
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        return np.add.reduceat(n[by], np.flatnonzero(new)), group, np.cumsum([len(h) for h in high]).tolist()

    def token_answers(_: int, asked: list[bytes]) -> list[bytes]:
        totals, group, ends = token_totals(asked)
        own = [group[b:e] for b, e in zip([0, *ends], ends)]
        return [pack_parts([pack_numbers(totals[g]), pack_sorted(g.astype(np.uint64))]) for g in own]

    def token_sums(asked: list[bytes]) -> tuple[int, int]:
        totals = token_totals(asked)[0]
        return int(totals.sum()), int((totals > 0).sum())

    def learnt(own: Tokens, got: pa.Table) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Training tokens, distinct ones, and the counts and numbers of a block's tokens."""
        total, vocabulary = map(int, told(got, SUMS)[0].decode().split(","))
        answers = [unpack_parts(a) for a in told(got, TOKENS)]
        o = own.order
        counts, ids = np.zeros((2, len(o)), np.uint64)
        counts[o] = np.concatenate([unpack_numbers(a[0]) for a in answers])
        # The place in its shard and the shard make a number that only one token has.
        ids[o] = np.concatenate([unpack_sorted(a[1]) for a in answers]) * np.uint64(shards) + shard_of(own.high[o], shards)
        return total, vocabulary, counts.astype(np.int64), ids

    def gram_questions(table: pa.Table, got: pa.Table) -> pa.Table:
        names = ["shard", "block", "kind", "asked"]
        if not table.num_rows:
            return rows_of(names, [])
        own = Tokens(table)
        total, _, counts, ids = learnt(own, got)
        known, levels = _grams(own, ids, counts, total, order, shards)
        rows = []
        cuts = [np.searchsorted(g.at, np.arange(shards + 1)) for g in levels]
        place_of = np.zeros(len(known), np.int64)
        for s in np.flatnonzero(np.diff(cuts[0])).tolist() if levels else []:
            parts = [slice(int(c[s]), int(c[s + 1])) for c in cuts]
            grams = [g.gram[p] for g, p in zip(levels, parts)]
            # Tokens are sent once; entries name them by their places.
            named = np.concatenate([g.token[own_] for g, own_ in zip(levels, grams)])
            used = _distinct(named)
            place_of[used] = np.arange(len(used))
            place = place_of[named]
            heads, sizes = np.unique(levels[0].parent[grams[0]], return_counts=True)
            sent = [pack_sorted(known[used]), pack_sorted(known[heads])]
            for k, (g, p, own_) in enumerate(zip(levels, parts, grams)):
                if k:
                    sizes = np.bincount(g.above[p] - parts[k - 1].start, minlength=len(grams[k - 1]))
                sent += [pack_numbers(x.astype(np.uint64)) for x in (sizes, place[: len(own_)], g.counts[own_])]
                place = place[len(own_) :]
            rows.append((s, table.column("block")[0].as_py(), GRAMS, pack_parts(sent)))
        return rows_of(names, rows)

    def gram_answers(_: int, asked: list[bytes]) -> list[bytes]:
        # What a block asks is sorted by (context, token), as it was sent, and so are the numbers below.
        parts = [unpack_parts(a) for a in asked]
        tokens, heads = ([unpack_sorted(p[k]) for p in parts] for k in (0, 1))
        vocabulary, contexts = _distinct(np.concatenate(tokens)), _distinct(np.concatenate(heads))
        tokens = [np.searchsorted(vocabulary, t) for t in tokens]
        owners = [np.searchsorted(contexts, h) for h in heads]
        out: list[list[bytes]] = [[] for _ in parts]
        parents = None
        with tempfile.TemporaryDirectory() as folder:
            for k in range(2, order + 1):
                sent = [[unpack_numbers(x).astype(np.int64) for x in p[3 * k - 4 : 3 * k - 1]] for p in parts]
                keys = np.concatenate([np.repeat(o, x[0]) * len(vocabulary) + t[x[1]] for o, t, x in zip(owners, tokens, sent)])
                ends = np.cumsum([len(x[1]) for x in sent]).tolist()
                counts = np.concatenate([x[2] for x in sent])
                del sent, owners
                by, new, group = _in_order(keys, max(1, len(contexts)) * len(vocabulary))
                # Every distinct n-gram is looked up once, whichever blocks ask for it.
                owner, word = np.divmod(keys[by[new]], len(vocabulary))
                counts = np.add.reduceat(counts[by], new) if len(new) else counts
                del keys, by
                seen = counts > 0
                c = contexts[owner]
                level = Level(f"{folder}/{k}", c[seen], word[seen], counts[seen], parents=parents, vocabulary=vocabulary)
                # The places found are the contexts of the next level.
                contexts = np.concatenate([
                    level.find(c[b : b + SLICE], word[b : b + SLICE], numbers=True) for b in range(0, len(c), SLICE)] or [c.astype(np.int64)])
                codes = level.codes_at(contexts).astype(np.uint64)[group]
                owners = [group[b:e] for b, e in zip([0, *ends], ends)]
                for o, b, e in zip(out, [0, *ends], ends):
                    o.append(pack_numbers(codes[b:e]))
                parents = len(level.codes)
        return [pack_parts(o) for o in out]

    names = [f.split(" ")[0] for f in SCORES.split(", ")]

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2 + [pa.float64()]
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
        own = Tokens(table)
        total, vocabulary, counts, ids = learnt(own, got)
        c = counts[own.token]
        p = (c + 1.0) / (total + vocabulary + 1.0)
        # The context of a token is the one before it; before the first stands the end.
        before = np.append(0, own.token[:-1])
        before[own.begin] = 0
        held = counts[before].astype(float)
        codes = [unpack_parts(a) for a in told(got, GRAMS)]
        for k, grams in enumerate(_grams(own, ids, counts, total, order, shards)[1]):
            n = np.zeros(len(own.token))
            n[grams.where] = count_of(grams.own(np.concatenate([unpack_numbers(c[k]) for c in codes])))[grams.group]
            # Rounded counts of a long context may pass those of its own tokens' sum by the quantum.
            p = (np.minimum(n, held) + mu * p) / (held + mu)
            held = np.append(0.0, n[:-1])
            held[own.begin] = 0.0
        rows = [table.column("doc_id"), own.sizes, np.add.reduceat((c > 0).astype(np.int64), own.begin),
                _log_sums(np.log10(c + 1.0), own), np.full(len(own.sizes), vocabulary), np.full(len(own.sizes), total),
                _log_sums(np.log10(p), own)]
        return pa.table(dict(zip(names, rows)))

    asked = ask(blocks, token_questions)
    first = answer(asked, token_answers).unionByName(to_all_blocks(asked, token_sums, SUMS, number))
    second = answer(conclude(blocks, first, gram_questions, ASKED), gram_answers)
    scored = conclude(blocks, first.unionByName(second), finish, SCORES)
    parts = F.log10(F.col("train_tokens").cast("double") + F.col("vocabulary") + 1.0)
    return scored.select(
        "doc_id", (~trained(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        (F.col("log_counts") - F.col("n_tokens") * parts).alias("base_score"), "score")
