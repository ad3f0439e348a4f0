"""Fill-in-middle, packing by matching and the audit of sources against plain versions; the token cache."""

import os
import random
import subprocess
import sys
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wattsift.llm import divergence, fill_middle, pair_packing, tokens
from wattsift.llm.queries import QUERIES


def rows(df):
    return [tuple(r) for r in df.collect()]


def ordered(found):
    return sorted(found, key=str)


# Token cache

SCRAPS = [
    "a", "Be", "é", "ß", "ñ", " ", "  ", "   ", "\n", "\n\n\n", "\t", "'s", "'S", "1", "23", "²", "，", "中", "!", "..", "\x1c", "\x85",
    "\xa0", "\0", "\u0301", "İ", "<|", "endoftext", "<|endoftext|>", " the", "\r\n", "\u2003", "\u200b"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_ids_are_the_tokenizers(name, odd_rows):
    rng = random.Random(3)
    made = ["".join(rng.choices(SCRAPS, k=rng.randint(0, 12))) for _ in range(20_000)] + [t or "" for _, t in odd_rows]
    # So small that generations change all the time.
    cache = tokens.TextIds(public_tokenizers.path(name), 20_000, 9_000)
    want = [e.ids for e in cache.tokenizer.encode_batch_fast(made, add_special_tokens=False)]
    got = []
    for at in range(0, len(made), 300):
        ids, sizes = cache.encode(made[at : at + 300])
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == want
    assert [len(x) for x in cache.encode([])] == [0, 0]


def test_unknown_rules_get_whole_texts(tmp_path):
    from tokenizers import models, pre_tokenizers

    other = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "a ": 2, "a a": 3}, merges=[("a", " "), ("a ", "a")]))
    other.pre_tokenizer = pre_tokenizers.Split("x", "removed")
    other.save(f"{tmp_path}/t.json")
    ids, sizes = tokens.TextIds(f"{tmp_path}/t.json").encode(["a a", "", "a axa"])
    assert ids.tolist() == [3, 3, 0] and sizes.tolist() == [1, 0, 2]


KEEPS = """
import random, re, sys
from wattsift.llm.tokens import text_ids

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

encoder, rng, most = text_ids(None, sys.argv[1]), random.Random(5), 0
encoder.encode(["a b"])
begun = held()
for _ in range(12):
    encoder.encode([" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(80_000))])
    most = max(most, held())
print(most - begun)
"""


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_worker_that_sees_many_words_stays_small(name):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = subprocess.run([sys.executable, "-c", KEEPS, name], cwd=root, capture_output=True, text=True, check=True, timeout=300)
    assert int(found.stdout) < 160


PACKS = """
import random, re, sys
import pyarrow as pa
from wattsift.llm.packing import pack_batches

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

def batches():
    for i in range(12):
        texts = [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(800)) for _ in range(100)]
        yield pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], names=["doc_id", "text"])

rng, most, pieces, begun = random.Random(5), 0, 0, held()
for found in pack_batches(batches(), 0, None, 2048, 1, 400_000):
    most, pieces = max(most, held()), pieces + sum(len(p) for _, p, _ in found)
assert pieces >= 1200
print(most - begun)
"""


def test_a_packing_task_that_sees_many_words_stays_small():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = subprocess.run([sys.executable, "-c", PACKS], cwd=root, capture_output=True, text=True, check=True, timeout=300)
    assert int(found.stdout) < 220


def test_kept_segments_are_those_seen_last():
    import pyarrow as pa

    asked = []

    def learn(keys):
        asked.extend(keys)
        return np.array([ord(k[0]) for k in keys for _ in k], np.uint32), np.array(list(map(len, keys)))

    cache = tokens.Known(learn, 8 * (tokens.KEY_CHARS + 1))
    for keys in ("abcd", "efgh", "ab", "ijk", "ab", "cd", "l"):
        ids, sizes = cache.ids(cache.places(pa.array(list(keys))))
        assert bytes(ids.tolist()).decode() == keys and sizes.tolist() == [1] * len(keys)
    assert "".join(asked) == "abcdefghijkbcdl"  # i, j, k and a stayed
    assert len(cache.keys) == len(cache.sizes) == len(cache.starts) == len(cache.seen) <= 9


# Fill in the middle


def test_fill_middle_given_table(spark, small, given):
    assert ordered(rows(QUERIES["op11_fill_middle"](spark, small))) == ordered(brute.fill_middle(given("documents", "doc_id, text")))


def test_fill_middle_odd_rows(docs, odd_rows):
    made = [*odd_rows, (None, "no id, but a text"), (3, "again three"), (3, "again three"), (20, "a <P> inside"), (21, "<M>"), (22, "<S> x <P>"),
            (23, "<S< >P> <"), (24, "S>P><"), *((30 + i, "<<S P>>M> <" * i) for i in range(30)), *((100 + i, "aé1 B" * (i * 60)) for i in range(40)),
            *((200 + i, "ab" * 700 * i + "\n" * i) for i in range(20))]
    got = rows(fill_middle.fill_in_middle_digests(docs(made)))
    assert ordered(got) == ordered(brute.fill_middle(made))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert rows(fill_middle.fill_in_middle(docs([]))) == []
    assert {r.form for r in fill_middle.fill_in_middle(docs(made), rate=0).collect()} == {"plain"}


def test_every_cut_of_chunked_texts(odd_rows):
    import re

    known = fill_middle.Summaries(most=5000)
    for text in [t for _, t in odd_rows if t][:9] + ["x" * 9000 + "é" * 3000 + " " + "Ab" * 4000, "\n".join("abc" * i for i in range(90))]:
        raw = text[:30_000].encode()
        data = np.frombuffer(raw, np.uint8)
        (cuts,) = fill_middle.borders(data, np.array([len(raw)]))
        assert cuts[-1] == len(raw) and max(np.diff([0, *cuts])) <= fill_middle.MOST + 3
        chunked = fill_middle.Chunked(raw, known.get([raw[a:b] for a, b in zip([0, *cuts], cuts)]))
        ends = [0, *np.cumsum([len(w.encode()) for w in re.findall("[A-Za-z]+|[^A-Za-z]", raw.decode())]).tolist()]
        assert chunked.n == len(ends) - 1
        for k in {*range(0, len(ends), 97), len(ends) - 1, *range(min(40, len(ends)))}:
            assert chunked.end_of(k) == ends[k]


def test_equal_passages_fall_into_equal_chunks():
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefg hij", k=20_000))
    one, two = (("".join(rng.choices("klm no", k=n)) + passage).encode() for n in (777, 5001))
    chunks = []
    for raw in (one, two):
        (cuts,) = fill_middle.borders(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
        chunks.append({raw[a:b] for a, b in zip([0, *cuts], cuts)})
    assert sum(map(len, chunks[0] & chunks[1])) > 14_000


# Packing by matching


def check_placed(found, texts, tokenizer, window=1024):
    whole = [([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], d) for d, t in texts]
    want = []
    for ids, d in whole:
        for k, (start, length) in enumerate(pair_packing.cuts(len(ids), window)):
            want.append((d, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    assert ordered(r[:5] for r in found) == ordered(want)
    fill: dict = {}
    for _, _, _, length, _, sequence, offset in sorted(found, key=lambda r: r[5:]):
        assert offset == fill.get(sequence, 0)
        fill[sequence] = offset + length
    assert max(fill.values()) <= window
    return fill


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pair_packing_given_table(spark, small, given, tokenizer):
    found = rows(QUERIES["op12_pair_packing"](spark, small))
    fill = check_placed(found, given("documents", "doc_id, text"), tokenizer)
    assert len(fill) <= brute.best_fit_decreasing([r[3] for r in found], 1024) * 1.01 + 1


def test_pair_packing_odd_rows(docs, odd_rows, tokenizer):
    made = [*odd_rows, (None, "same"), (None, "same"), (6, None)]
    for window in (1024, 7, 1):
        found = rows(pair_packing.packed_pieces(docs(made).repartition(5), window=window))
        check_placed(found, made, tokenizer, window)
    assert rows(pair_packing.packed_pieces(docs([]))) == [] == rows(pair_packing.sequences(docs([])))


def test_sequences_hold_the_ids(docs, odd_rows, tokenizer):
    texts = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in odd_rows}
    held = 0
    for r in pair_packing.sequences(docs(odd_rows)).collect():
        at = 0
        for p in r.pieces:
            assert r.input_ids[at : at + p.length] == texts[p.doc_id][p.start : p.start + p.length]
            at += p.length
        assert at == r.length == len(r.input_ids)
        held += at
    assert held == sum(map(len, texts.values()))


def test_plans_waste_little_and_stay_small():
    rng = np.random.default_rng(4)
    for window, lengths in (
            (1024, rng.integers(1, 1025, 50_000)), (1024, rng.integers(300, 700, 20_000)), (1024, rng.integers(1, 40, 30_000)),
            (64, rng.integers(1, 65, 3000)), (9, rng.integers(1, 10, 50)), (1024, np.full(1001, 1)), (1024, np.full(5, 512)),
            (1024, rng.geometric(0.004, 100_000).clip(1, 1024))):
        counts = np.bincount(lengths, minlength=window + 1)
        plan = pair_packing.Plan({n: int(c) for n, c in enumerate(counts) if c}, window)
        ranks = np.concatenate([np.arange(c) for c in counts])
        size = np.repeat(np.arange(window + 1), counts)
        sequence, offset = plan.place(size, ranks)
        order = np.lexsort((offset, sequence))
        s, o, n = sequence[order], offset[order], size[order]
        follows = s[1:] == s[:-1]
        assert (o[1:][follows] == (o + n)[:-1][follows]).all() and (o[1:][~follows] == 0).all() and o[0] == 0
        assert (o + n).max() <= window and len(set(s.tolist())) == plan.sequences == s.max() + 1
        assert plan.sequences <= max(brute.best_fit_decreasing(lengths.tolist(), window) * 1.004 + 1, -(-lengths.sum() // window))
        assert len(plan.first) < 40 * window


def test_long_pieces_are_matched_as_often_as_possible():
    plan = pair_packing.Plan({600: 2, 424: 1, 400: 2, 350: 1, 1024: 3}, 1024)
    assert plan.sequences == 3 + 3


# Divergence


def group_rows(spark, made):
    table = [(i, *r, 7, "x") for i, r in enumerate(made)]
    return spark.createDataFrame(table, "doc_id long, lang string, source string, text string, n long, chunk string")


def test_divergence_given_table(spark, small, given):
    assert ordered(rows(QUERIES["op13_divergence"](spark, small))) == ordered(brute.divergence(given("documents", "lang, source, text")))


def test_divergence_odd_rows(spark, odd_rows):
    made = [(lang, source, text) for i, (_, text) in enumerate(odd_rows) for lang, source in ((("en", f"s{i % 4}"),) if i % 3 else ((None, None), ("en", "")))]
    made += [("en", "s1", "The-the THE's the,the 123 the_x")] * 5 + [("de", "only", "word " * 9)] * 3 + [("fr", "a", None), ("fr", "b", ""), ("fr", None, "un")]
    made += [("es", f"e{i}", f"uno{i % 5} dos.{i % 2} tres,{i}") for i in range(30)]
    # Three documents that no chunk proves, and two that many chunks show.
    made += [("it", "p", "qa,"), ("it", "p", "qa."), ("it", "q", "qa;"), ("it", "q", "zb! zb? (zb) zb"), ("it", "p", "(zb zb, zb")]
    want = ordered(brute.divergence(made))
    assert ordered(rows(divergence.divergence(group_rows(spark, made)))) == want
    assert ordered(rows(divergence.divergence(group_rows(spark, made).repartition(7)))) == want
    assert {r.term for r in divergence.kept_counts(group_rows(spark, made)).where("lang = 'it'").collect()} == {"qa"}
    assert rows(divergence.divergence(group_rows(spark, []))) == []


def test_terms_are_cut_at_the_top(spark):
    made = [("en", s, " ".join(f"{s}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))) for s in "kl" for _ in range(3)]
    got = [r for r in rows(divergence.divergence(group_rows(spark, made))) if r[2] == "term"]
    assert got and ordered(got) == ordered(r for r in brute.divergence(made) if r[2] == "term") and max(r[5] for r in got) == 200


def test_rows_of_a_chunk_meet_once(spark, small):
    """The text is read once, and shuffled by chunk and by term only."""
    plan = divergence.kept_counts(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan") == 1


def test_merged_batches_hold_back_rows_that_go_on():
    import pyarrow as pa

    made = [divergence.count_chunks(pa.table({
        "lang": ["en", "en", "en", "de"], "source": ["a", "b", "a", "c"], "text": ["X y x", "x", "y\tz", " y z "],
        "row": [at, at + 1, at + 2, at + 3]})) for at in (0, 10)]
    rows = sorted((r for b in made for r in b.to_pylist() if r["word"]), key=lambda r: (r["word"], r["lang"]))
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 2], schema=made[0].schema) for i in range(0, len(rows), 2)]
    got = [r for b in divergence.merged(iter(batches)) for r in b.to_pylist()]
    assert [(r["word"], r["lang"], r["documents"], {u["source"]: u["n"] for u in r["uses"]}) for r in got] == [
        ("x", "en", [0, 1, 10], {"a": 4, "b": 2}), ("y", "de", [3, 13], {"c": 2}), ("y", "en", [0, 2, 10], {"a": 4}),
        ("z", "de", [3, 13], {"c": 2}), ("z", "en", [2, 12], {"a": 2})]
