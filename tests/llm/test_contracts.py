"""Each contract query against a brute-force form, the given SQL, or held-out accuracy."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from quire.llm.queries import ORACLES, QUERIES  # noqa: E402
from quire.plans.compare import compare, duck_connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    r = compare(name, QUERIES[name](spark, SMALL), duck_connect(SMALL), ORACLES[name])
    assert r.ok, r.detail


def test_quality_statistics(spark, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
           for r in QUERIES["op1_quality_rules"](spark, SMALL).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        s = brute.base_stats(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert got[i][:6] == (*s, failed)
        assert not (failed and got[i][6])


def test_quality_rules_tell_labels_apart(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = QUERIES["op1_quality_rules"](spark, MEDIUM).filter("NOT base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.3 * len(bad)


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source")
    rows = QUERIES["op2_mixing"](spark, SMALL).join(docs, "doc_id").collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    for part in by.values():
        assert abs(sum(r.taken for r in part) - part[0].target) <= 1
        assert part[0].target <= 2 * part[0].source_size
    assert sum(p[0].target for p in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_embedding_components(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute.cosine(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op3_embedding_dedup"](spark, SMALL).collect()}
    assert got == want


def test_jaccard_components(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_jaccard_join"](spark, SMALL).collect()}
    assert got == brute.jaccard(texts)


def test_toxicity_on_the_held_out_fold(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_token_files_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_files"](spark, SMALL).collect()}
    at = 0
    for i, t in sorted(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i] == (at, len(ids), brute.crc(ids))
        at += len(ids)


def test_languages_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op7_language_id"](spark, MEDIUM).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_separator_scan(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in QUERIES["op8_token_counts"](spark, SMALL).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in texts}


def test_line_dedup(spark, texts):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op9_line_dedup"](spark, SMALL).collect()}
    assert got == brute.line_dedup(texts)


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op10_packing"](spark, SMALL).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start:r.start + r.length])
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids[i]), 4096))
        assert sum(r.length for r in parts) == len(ids[i])
    assert set(by_doc) == set(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_seq) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    schema = docs.schema.simpleString()
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(function(spark, docs, SMALL), f"test-{name}")
        assert out.schema.simpleString() == schema
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            want = sorted(i for i, (_, root) in brute.jaccard(rows).items() if i == root)
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == want
        if name == "line_dedup":
            want = {i: v[2] for i, v in brute.line_dedup([(r.doc_id, r.text) for r in docs.collect()]).items()}
            assert {r[0]: r[1] for r in out.select("doc_id", F.sha2("text", 256)).collect()} == want
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.filter("piece = 0").count() == docs.count()
