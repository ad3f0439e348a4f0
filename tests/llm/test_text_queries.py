"""The registered queries with SQL against DuckDB, and the pipeline against its stages' plain versions."""

import brute
import pytest
from compare import compare
from compare import database as open_database
from test_text_operators import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline
from wattsift.llm import quality
from wattsift.llm.oracle import ORACLE
from wattsift.llm.queries import QUERIES
from wattsift.sources.staging import stage

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert compare(QUERIES[name], ORACLE[name], spark, open_database(MEDIUM), MEDIUM) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, small, given):
    """Each stage is judged on what the one before it kept."""
    import public_tokenizers

    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    good = stage(steps["quality_classifier"](spark, docs, small), "test")
    trees = quality.fit_quality(docs, spark.read.parquet(f"{small}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.score_quality(docs, trees).collect()}
    assert text(good) == [(d, t) for d, t in text(docs) if score[d] >= 0.7] and good.columns == docs.columns
    one = stage(steps["simhash_near_dedup"](spark, good, small), "test")
    first = {d for d, _, c in brute.near_duplicates(text(good)) if d == c}
    assert text(one) == [(d, t) for d, t in text(good) if d in first] and one.columns == docs.columns
    cut = stage(steps["substring_dedup"](spark, one, small), "test")
    assert cut.columns == docs.columns
    digest = {d: (gone, sha) for d, _, gone, sha in brute.repeats(text(one))}
    before = dict(text(one))
    for d, t in text(cut):
        assert brute.sha(t) == digest[d][1] if digest[d][0] else t == before[d]
    clean = stage(steps["benchmark_decontamination"](spark, cut, small), "test")
    hit = {r[0] for r in brute.contamination(text(cut), given("benchmark", "item_id, text")) if r[5]}
    assert text(clean) == [(d, t) for d, t in text(cut) if d not in hit] and clean.columns == docs.columns
    packed = [tuple(r) for r in steps["packing"](spark, clean, small).collect()]
    check_pieces(packed, text(clean), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_pipeline_runs(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 50
