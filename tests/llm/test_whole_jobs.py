"""Small tests of places that once did less than the whole job."""

import brute
import numpy as np
import pytest

import corpus_pipeline
from wattsift.llm import html_text, ngram_model, spotsigs
from wattsift.llm.queries import QUERIES


def test_pipeline_keeps_one_of_each_group(spark, docs, small):
    rng = np.random.default_rng(5)
    made, first = [], []
    for i in range(40):
        words = [f"v{x}" for x in rng.integers(0, 5000, 4000)]
        group = [(i, " ".join(words)), (1000 + i, " ".join(words).upper()), (2000 + i, "\n".join(words))]
        # A word more changes three shingles of four thousand.
        group.append((3000 + i, " ".join([*words, "more"])))
        roots = {c for _, _, c in brute.near_duplicates(group)}
        made += group
        first += sorted(roots)
    made += [(9000, ""), (9001, None), (9002, "short text"), (9003, "short text"), (9004, "short text here")]
    # Repeated rows, one id with two texts, and rows without an id.
    made += [(5, made[4 * 5][1])] * 3 + [(9002, "short text")] * 2 + [(9100, "one text of it"), (9100, "quite another one")]
    made += [(None, "nobody's text")] * 3 + [(None, "short text")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs(made), small).collect()]
    assert len(got) == len(set(got)) and sum(d == 9100 for d, _ in got) == 1
    assert sorted(d for d, _ in got if d is not None) == sorted([*first, 9000, 9002, 9004, 9100])
    assert [t for d, t in got if d is None] == ["nobody's text"] and len(first) < 80


def test_end_tags_of_elements_that_are_not_open_are_cheap():
    import time

    start = time.perf_counter()
    page = "<div>" * 60_000 + "</table></nav>" * 60_000 + "<p>text"
    assert [x for x, _ in html_text.lines_of(page)] == ["text"]
    assert time.perf_counter() - start < 10
    nested = "<article><section><div><p>a</section><p>b</nav><p>c</article><p>d"
    assert [x for x, _ in html_text.lines_of(nested)] == ["a", "b", "c", "d"]


def html_texts(spark, pages):
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.main_text(table).collect()}


def test_copied_open_pages_keep_their_text(spark):
    page = "<p>Site line<p>Story {0}<p>More of {0}<p>Site end"
    pages = [(i, f"http://h.org/a?x={i}", page.format("one")) for i in range(1, 41)]
    pages += [(50, "http://h.org/a?x=near", page.format("one").replace("More", "Much more"))]
    pages += [(60 + i, "http://h.org/b", page.format("two")) for i in range(3)]
    pages += [(70 + i, f"http://twice.org/?s={i}", page.format("alone")) for i in range(2)]
    pages += [(80 + i, f"http://one.org/view?id={i}", page.format(i)) for i in range(2)]
    got = html_texts(spark, pages)
    assert {got[i] for i in range(1, 41)} == {"Story one\n\nMore of one"}
    assert got[50] == "Story one\n\nMuch more of one"
    assert {got[60 + i] for i in range(3)} == {"Story two\n\nMore of two"}
    assert got[70] == got[71] == "Site line\n\nStory alone\n\nMore of alone\n\nSite end"
    assert got[80] == "Story 0\n\nMore of 0"


def test_names_of_wrappers_and_sections_keep_their_text(spark):
    names = ["content has-sidebar", "no-ads", "header-fixed", "page-with-nav", "site search-enabled", "widget", "sidebar", "comments"]
    pages = [(k, f"http://w{k}.org/", f"<div class='{c}'><article><p>Text</article></div><p>out") for k, c in enumerate(names)]
    inside = "<article><p>Text {0}<div class='{1}'><p>Section {0}<p>Follow us</div><div class='ad'>Buy</div><div id=comments>Hi</div></article>"
    sections = ["social-history", "share-price", "related-work", "notice"]
    for k, c in enumerate(sections):
        pages += [(100 + 2 * k + i, f"http://s{k}.org/{i}", inside.format(f"{c} {i}", c)) for i in range(2)]
    pages += [(200, "http://t.org/", "<article>Text</article><div class=comments><article>Reader</article></div>"),
              (201, "http://u.org/", "<div class=search><main>Found</main></div><article>Teaser</article>")]
    got = html_texts(spark, pages)
    assert [got[k] for k in range(len(names))] == ["Text"] * len(names)
    for k, c in enumerate(sections):
        assert got[100 + 2 * k] == f"Text {c} 0\n\nSection {c} 0"
    assert got[200] == "Text" and got[201] == "Found\n\nTeaser"


def test_every_page_is_differenced_and_then_checked_by_markup(spark):
    page = "<nav><a>Home<li>Own {0}</nav><div class=ad>Ad {0}</div><article><h1>Story {0}</h1><p>Same.<p>Text {0}</article><footer>Foot</footer>"
    pages = [(i, f"http://h.org/a/{i}?x", page.format(i)) for i in (1, 2)] + [(3, "http://h.org/a/1?y", page.format(1))]
    pages += [(4, "http://h.org/b", ""), (None, "http://h.org/c", "<p>Open<nav>Out</nav>"), (6, "http://one.org/", page.format(6))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(table).collect()}
    # A menu's line of this page only is out, the articles' common sentence is not.
    for i, story in ((1, 1), (2, 2), (3, 1), (6, 6)):
        assert got[i].text == f"Story {story}\n\nSame.\n\nText {story}" and got[i].n_chars == len(got[i].text)
    assert {k: (r.n_lines, r.n_shared) for k, r in got.items()} == {
        1: (7, 3), 2: (7, 3), 3: (7, 3), 4: (0, 0), None: (2, 0), 6: (7, 0)}
    assert got[None].text == "Open" and len(got) == len(pages)


def test_differencing_marks_given_pages(spark, small):
    got = QUERIES["op8_html"](spark, small).agg({"n_lines": "sum", "n_shared": "sum", "page_id": "count"}).first().asDict()
    assert 0 < got["sum(n_shared)"] < got["sum(n_lines)"] and got["count(page_id)"] == spark.read.parquet(f"{small}/pages.parquet").count()


def test_model_query_has_three_orders(spark, small, given):
    import zlib

    in_training = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    want = {r[0]: r for r in brute.model_scores(given("documents", "doc_id, text"), in_training, 3, ngram_model.MU)}
    for r in QUERIES["op4_ngram_model"](spark, small).collect():
        assert r.score == pytest.approx(want[r.doc_id][5], abs=0.002 * r.n_tokens)


def test_trie_walks_from_level_to_level(tmp_path):
    pairs = np.array([[5, 7], [5, 8], [9, 7]], np.uint64).T
    two = ngram_model.Level(f"{tmp_path}/2", *pairs, np.array([3, 1, 2], np.uint64))
    places = two.find(np.array([9, 5, 5, 9], np.uint64), np.array([7, 8, 7, 8], np.uint64))
    assert places.tolist() == [2, 1, 0, -1]
    three = ngram_model.Level(f"{tmp_path}/3", places[[0, 2]], np.array([4, 6], np.uint64), np.array([2, 3], np.uint64), parents=3)
    assert three.lookup(places, np.array([4, 4, 6, 4], np.uint64)).tolist() == [2, 0, 3, 0]
    assert three.pointers.get(np.arange(4)).tolist() == [0, 1, 1, 2]


def test_texts_without_common_words_look_like_their_edits(spark, docs):
    english = "this is the story of a king and the queen that was in her castle on the hill near some river " * 5
    numbers = " ".join(f"k{i},{i * i}" for i in range(150))
    russian = " ".join(f"слово{i % 50} дело{i}" for i in range(100))
    chinese = "".join(chr(0x4E00 + i * i % 3000) for i in range(300))
    texts = [numbers, russian, chinese, "again hello world " * 60]
    got = {r.doc_id: r for r in spotsigs.fingerprints_and_edits(docs(
        [(2 * k + 1, t) for k, t in enumerate(texts)] + [(2 * k, english) for k in range(len(texts))])).collect()}
    for k in range(len(texts)):
        assert got[2 * k + 1].near_edited > (0.4 if k < 3 else 0.0) and got[2 * k + 1].near_next < got[2 * k + 1].near_edited


def test_ngrams_spread_evenly_over_many_shards():
    import pyarrow as pa
    import pyarrow.parquet as pq

    text = pa.array([t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()])
    own = ngram_model.Tokens(pa.table({"text": text, "training": pa.array([True] * len(text))}))
    counts = np.bincount(own.token)
    shards = 2000
    _, levels = ngram_model._grams(own, own.high, counts, len(own.token), 3, shards)
    pairs, triples = levels
    at = np.bincount(triples.shard, minlength=shards)
    assert at.max() <= 2 * at.mean()
    # An n-gram stands where those are that continue it, and few stand twice.
    assert (triples.at == pairs.at[triples.above]).all() and (pairs.gram[triples.above] == triples.parent[triples.gram]).all()
    assert len(pairs.at) <= 1.25 * len(pairs.shard) and len(triples.at) == len(triples.shard)
    assert (pairs.own(pairs.gram) == np.arange(len(pairs.shard))).all()


def test_shards_without_keys_are_not_asked(spark, docs):
    from wattsift.llm import exchange

    blocks, number, shards = exchange.in_blocks(docs([(k, f"word{k}") for k in range(3)]))
    keys = np.array([5, 2**63], np.uint64)

    def questions(table):
        cut = exchange.shard_cuts(keys, shards).tolist()
        return [(s, 1, exchange.pack_sorted(keys[b:e])) for s, (b, e) in enumerate(zip(cut, cut[1:])) if e > b]

    asked = exchange.ask(blocks, questions)
    held = blocks.select("block").distinct().count()
    assert asked.count() == 2 * held
    told = exchange.to_all_blocks(asked, lambda a: (len(a), 1), 0, number).collect()
    assert sorted(r.block for r in told) == list(range(number)) and {bytes(r.answer) for r in told} == {f"{2 * held},2".encode()}
    assert exchange.shard_of(keys, shards).tolist() == [0, shards // 2]


def test_only_texts_with_special_tokens_go_whole_to_the_tokenizer():
    import pyarrow as pa

    from wattsift.llm.tokens import text_ids

    encoder = text_ids()
    found = ["x < y", "plain", "", f"a {encoder.special[0]} b", "<", f"{encoder.special[-1]}"]
    assert encoder._odd(pa.array(found)).tolist() == [False, False, False, True, False, True]
    ids, sizes = encoder.encode(found)
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in found]
    assert sizes.tolist() == list(map(len, whole)) and ids.tolist() == sum(whole, [])


def test_elias_fano_selects_every_one_and_zero(tmp_path):
    rng = np.random.default_rng(4)
    # Sparse, dense, and with words that are all ones or all zeros.
    for k, values in enumerate([rng.integers(0, 9000, 700), rng.integers(0, 40, 900), np.repeat([5, 90_000], 200), np.arange(300)]):
        values = np.sort(values).astype(np.uint64)
        found = ngram_model.EliasFano(str(tmp_path), f"s{k}", values, int(values[-1]) + 1)
        bits = np.unpackbits(np.asarray(found.high).view(np.uint8), bitorder="little").astype(bool)
        for one, places in ((True, np.flatnonzero(bits)), (False, np.flatnonzero(~bits))):
            assert found._select(np.arange(len(places)), one).tolist() == places.tolist()
        assert found.get(np.arange(len(values))).tolist() == values.tolist()


def test_a_run_of_equal_contexts_asks_the_pointers_once(tmp_path, monkeypatch):
    contexts = np.repeat(np.array([3, 7, 9], np.uint64), [400, 1, 300])
    tokens = np.concatenate([np.arange(400), [5], np.arange(300)])
    level = ngram_model.Level(str(tmp_path), contexts, tokens, np.ones(len(tokens), np.uint64), vocabulary=np.arange(500, dtype=np.uint64) * 2)
    asked, get = [], ngram_model.EliasFano.get
    monkeypatch.setattr(ngram_model.EliasFano, "get", lambda self, at: asked.append(len(at)) or get(self, at))
    wanted = np.append(contexts, np.array([9, 9, 11], np.uint64))
    places = np.append(tokens, [299, 450, 0])
    found = level.find(wanted, places.astype(np.uint64) * np.uint64(2))
    assert found.tolist() == [*range(701), 700, -1, -1]
    assert sum(asked) <= 2 * 4
    assert level.find(wanted, places, numbers=True).tolist() == found.tolist()


@pytest.mark.parametrize("below", [1 << 20, 1 << 62])
def test_keys_in_order(below):
    keys = np.random.default_rng(2).integers(0, 300, 2000) * 3000
    by, new, group = ngram_model._in_order(keys, below)
    rising, places = np.unique(keys, return_inverse=True)
    assert (np.diff(keys[by]) >= 0).all() and sorted(by.tolist()) == list(range(2000))
    assert keys[by[new]].tolist() == rising.tolist() and group.tolist() == places.tolist()
    assert [len(x) for x in ngram_model._in_order(keys[:0], below)] == [0, 0, 0]
