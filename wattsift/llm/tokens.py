"""Token ids of whole texts by a public tokenizer file.

Texts are cut into segments at blanks where the file's rules never look across. A segment that is seen again
is looked up; new ones of plain letters, digits and signs are cut further, by the file's own rule, into
units, and each distinct unit goes to the file's model once. Segments are kept as Arrow strings beside flat
arrays, a fraction of what Python's own strings and dictionaries take; when they are too many, those that were
seen last stay. A file whose rules are not known here gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, count, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wattsift.llm.tables import kept

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"
# Characters of the kept segments, each counted with so many more; characters of new ones that are encoded at a time.
SEGMENT_CHARS, KEY_CHARS, LEARN_CHARS = 12_000_000, 26, 250_000
# Letters here are those of ASCII and Latin-1; what has others is left to the tokenizer.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# No sign that begins a special token either.
PLAIN = re.compile(f"[\x01-;=-\x7f{LETTERS}]*")
# Stands between segments; no unit holds it.
MARK = "\0"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_UNIT = re.compile(rf"{SHORT}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9\x00]+|\x00", re.A)
BYTE_UNIT = re.compile(
    rf"{SHORT}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9\x00]+|\s+(?![^\s\x00])|\s+|\x00", re.A)
# What the byte-level rule does not split at every blank: other blanks and control characters, runs of blanks.
_BYTE_ODD = (
    r"[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]{3}|[ \n]{2}\z")
_BEFORE_WORD = re.compile(r"(?= \S)")
# The rules of the two files, as they state them.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
WORD_RULES = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True}, _BYTES | {"use_regex": False}]})
BYTE_RULES = (None, _BYTES | {"use_regex": True})


def word_segments(texts: pa.StringArray) -> pa.ListArray:
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def byte_segments(texts: pa.StringArray) -> pa.ListArray:
    """A blank belongs to the word after it; a line feed is a segment of its own."""
    return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), MARK)


class Rules(NamedTuple):
    """`odd` texts are cut by `odd_segments`, all others by `segments`."""

    segments: Callable[[pa.StringArray], pa.ListArray] | None = None
    unit: re.Pattern | None = None
    lower: bool = False
    odd: str | None = None
    odd_segments: Callable[[str], list[str]] = lambda text: [text]


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of `flat`, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    where = np.repeat(starts - (ends - sizes), sizes)
    where += np.arange(len(where))
    return flat[where]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class Known:
    """Ids by key; `learn` gives (ids, sizes) of new keys in their order."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], chars: int):
        self.learn, self.chars, self.round = learn, chars, 0
        self.keys = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.sizes, self.seen = np.zeros((3, 0), np.int32)

    def places(self, keys: pa.StringArray) -> np.ndarray:
        """Where the keys, all different, are from now on; places hold until the next call."""
        self.round += 1
        self._forget()
        found = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(found.is_null())
        at = found.fill_null(-1).to_numpy().copy()
        if len(new):
            at[at < 0] = np.arange(len(self.keys), len(self.keys) + len(new))
            self._add(new)
        self.seen[at] = self.round
        return at

    def _add(self, new: pa.StringArray) -> None:
        ids, sizes = self.learn(new.to_pylist())
        starts = np.cumsum(sizes) - sizes + len(self.flat)
        self.keys = pa.concat_arrays([self.keys, new])
        self.flat = np.concatenate([self.flat, ids])
        self.starts, self.sizes = (
            np.concatenate([a, b.astype(np.int32)]) for a, b in ((self.starts, starts), (self.sizes, sizes)))
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int32)])

    def _forget(self) -> None:
        """When the keys are too many: those that were seen last stay, half of what is allowed."""
        loads = pc.utf8_length(self.keys).to_numpy() + KEY_CHARS
        if loads.sum(dtype=np.int64) <= self.chars:
            return
        last = np.argsort(-self.seen, kind="stable")
        stay = np.sort(last[np.cumsum(loads[last], dtype=np.int64) <= self.chars // 2])
        self.flat, self.sizes = self.ids(stay)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.keys, self.seen = self.keys.take(pa.array(stay)), self.seen[stay]

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at]
        return _gathered(self.flat, self.starts[at], sizes), sizes


def _counts(sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of consecutive sizes, so many at a time as `groups` says."""
    upto = np.append(0, np.cumsum(sizes))
    return np.diff(upto[np.append(0, np.cumsum(groups))])


def _places(odd: np.ndarray) -> np.ndarray:
    """Where each is when the odd stand behind the others."""
    return np.argsort(np.argsort(odd, kind="stable"), kind="stable")


class TextIds:
    def __init__(self, path: str, segment_chars: int = SEGMENT_CHARS, learn_chars: int = LEARN_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in stated["added_tokens"]]
        rules = stated["normalizer"], stated["pre_tokenizer"]
        self.rules = Rules()
        if rules == WORD_RULES:
            self.rules = Rules(word_segments, WORD_UNIT, True)
        elif rules == BYTE_RULES:
            self.rules = Rules(byte_segments, BYTE_UNIT, False, _BYTE_ODD, _BEFORE_WORD.split)
        if not all("<" in s for s in self.special):
            self.rules = self.rules._replace(unit=None)
        # Units are cut, and made small, already; the model takes them in the byte-level spelling of plain characters.
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {i: spell(chr(i))[0][0] for i in range(1, 256)} | {0: MARK}
        self.learn_chars = learn_chars
        self.segments = Known(self._learn, segment_chars)

    def _encoded(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)])

    def _by_units(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain segments; each distinct unit is encoded once."""
        joined = MARK.join(plain)
        cut = self.rules.unit.findall(joined.lower() if self.rules.lower else joined)
        place: dict[str, int] = defaultdict(count().__next__)
        # The mark is the first unit, and has no ids.
        place[MARK]
        at = np.fromiter(map(place.__getitem__, cut), np.int64, len(cut))
        spelled = MARK.join(islice(place, 1, None)).translate(self.spelling).split(MARK)
        ids, sizes = _flat([[], *([t.id for t in self.model.tokenize(u)] for u in spelled)])
        each = sizes[at]
        # Segments end with their marks.
        ends = np.concatenate([[0], np.flatnonzero(at == 0) + 1, [len(at)]])
        return _gathered(ids, (np.cumsum(sizes) - sizes)[at], each), _counts(each, np.diff(ends))

    def _learn(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys))) // self.learn_chars
        parts = np.split(np.arange(len(keys)), np.flatnonzero(np.diff(ends)) + 1)
        learned = [self._learn_part(keys[p[0] : p[-1] + 1]) for p in parts]
        return np.concatenate([ids for ids, _ in learned]), np.concatenate([sizes for _, sizes in learned])

    def _learn_part(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.rules.unit:
            return self._encoded(keys)
        odd = np.fromiter((not PLAIN.fullmatch(k) for k in keys), bool, len(keys))
        if not odd.any():
            return self._by_units(keys)
        ids, sizes = (np.concatenate(x) for x in zip(
            self._by_units([k for k, o in zip(keys, odd) if not o]), self._encoded([k for k, o in zip(keys, odd) if o])))
        # Without plain keys the units are those of one empty segment.
        sizes = sizes[len(sizes) - len(keys) :]
        back = _places(odd)
        return _gathered(ids, (np.cumsum(sizes) - sizes)[back], sizes[back]), sizes[back]

    def _odd(self, texts: pa.StringArray) -> np.ndarray:
        odd = np.full(len(texts), self.rules.segments is None)
        if self.rules.odd:
            odd |= pc.match_substring_regex(texts, self.rules.odd).to_numpy(zero_copy_only=False)
        # Special tokens hold the sign that few texts have.
        signed = all("<" in s for s in self.special)
        at = np.flatnonzero(pc.match_substring(texts, "<").to_numpy(zero_copy_only=False)) if signed else np.arange(len(texts))
        few = texts.take(pa.array(at))
        for s in self.special:
            odd[at] |= pc.match_substring(few, s).to_numpy(zero_copy_only=False)
        return odd

    def _cut(self, text: str) -> list[str]:
        return [text] if any(s in text for s in self.special) else self.rules.odd_segments(text)

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        texts = pa.array(found, pa.string())
        odd = self._odd(texts)
        lists = [self._cut(t) for t, o in zip(found, odd) if o] if odd.any() else []
        groups, parts = np.zeros(0, np.int64), []
        if not odd.all():
            cut = self.rules.segments(texts.filter(pa.array(~odd)) if lists else texts)
            groups, parts = np.diff(cut.offsets.to_numpy()), [cut.flatten()]
        parts.append(pa.array(list(chain.from_iterable(lists)), pa.string()))
        coded = pa.concat_arrays(parts).dictionary_encode()
        ids, sizes = self.segments.ids(self.segments.places(coded.dictionary)[coded.indices.to_numpy()])
        sizes = _counts(sizes, np.concatenate([groups, np.fromiter(map(len, lists), np.int64, len(lists))]))
        if not lists:
            return ids, sizes
        # Back from the others, then the odd, to the order given.
        back = _places(odd)
        return _gathered(ids, (np.cumsum(sizes) - sizes)[back], sizes[back]), sizes[back]


def text_ids(path: str | None = None, name: str = WORD_FILE) -> TextIds:
    """The worker's encoder for a tokenizer file; None: the public file of that name that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return kept(f"text_ids_{path}", lambda: TextIds(path))


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after every text."""
    if not len(sizes):
        return ids, sizes
    return np.insert(ids, np.cumsum(sizes), np.uint32(end)), sizes + 1
