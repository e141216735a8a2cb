"""Super-k-mer windows against a plain count of windows."""

import hashlib
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from quire.llm import substring_dedup as sd  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def plain(docs, window):
    """{(id, text): (n_words, n_removed, kept text)}"""
    least = {}
    for i, t in docs:
        w = brute.words(t)
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k:k + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in docs:
        w = brute.words(t)
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out[i, t] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def check(spark, docs, window, gram):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sd.dedup_substrings(df.withColumn("was", F.col("text")), carry=["was"], window=window, gram=gram)
    rows = got.collect()
    want = plain(docs, window)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id, r.was], r.doc_id
    return sum(r.n_removed for r in rows)


def corpus(seed, n=120, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [" ".join(word() for _ in range(rng.randrange(5, 90))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(passages), rng.choice([" ", "\n", " \t  "]).join(word() for _ in range(rng.randrange(0, 30)))]
        docs.append((i * 7 % 1000, " ".join(parts)))
    docs += [(2000 + i, docs[3][1]) for i in range(40)]
    return docs


@pytest.mark.parametrize("window,gram,vocabulary", [(50, 8, 400), (6, 2, 400), (5, 5, 3), (1, 1, 50), (9, 4, 2)])
def test_equals_plain_count(spark, window, gram, vocabulary):
    assert check(spark, corpus(window, vocabulary=vocabulary), window, gram) > 0


def test_hot_minimisers_go_by_window(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_STRINGS", 3)
    monkeypatch.setattr(sd, "HOT_SHARE", 10_000_000)
    assert check(spark, corpus(1), 20, 4) > 0


def test_large_buckets_are_passed_on(spark, monkeypatch):
    for limit in (1, 30, 200):
        monkeypatch.setattr(sd, "BUCKET_WINDOWS", limit)
        assert check(spark, corpus(2), 20, 4) > 0


def test_small_slices_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "SLICE_BYTES", 300)
    monkeypatch.setattr(sd, "CHUNK_BYTES", 200)
    monkeypatch.setattr(sd, "SEGMENT_WORDS", 17)
    monkeypatch.setattr(sd, "MAX_RUN", 4)
    monkeypatch.setattr(sd, "GROUP_WINDOWS", 10)
    assert check(spark, corpus(3), 12, 3) > 0


def test_copies_that_repeat_themselves(spark):
    """A string twice in each of several copies: two copies meet in one task, larger id first, a smaller
    one is in another task."""
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(9999)}" for _ in range(70))
    text = f"{passage} middle words {passage}"
    one = spark.createDataFrame([(5, text), (3, text)], "doc_id long, text string").coalesce(1)
    df = one.unionByName(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1))
    got = {r.doc_id: r.n_removed for r in sd.dedup_substrings(df).collect()}
    assert got == {1: 0, 3: 142, 5: 142}


def test_hashes_that_clash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(sd, "_mix", lambda x: x % 13)  # nearly all windows share a hash
    assert check(spark, corpus(4, n=40), 10, 3) > 0


def test_edges(spark):
    rng = random.Random(9)
    prose = " ".join(f"w{rng.randrange(10_000)}" for _ in range(130))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "short text"), (5, prose), (6, prose.replace(" ", "\n ")), (6, prose + " other end"),
            (None, prose), (None, None), (7, "ab " * 3000), (8, "ab " * 3000), (-5, " ".join(["é"] * 200)), (9, "x\x1cy " * 60),
            (10, "x\x1cy " * 60), (11, "x" * 200_000)]
    assert check(spark, docs, 50, 8) > 0
    repeated = [(3, prose), (3, prose), (2, prose), (2, prose)]
    df = spark.createDataFrame(repeated, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in sd.dedup_substrings(df).collect())
    assert got == [(2, 0), (2, 0), (3, 130), (3, 130)]
    assert sd.dedup_substrings(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sd.dedup_substrings(df.withColumn("kept", F.lit(1)), carry=["kept"])


def test_query_equals_plain_count(spark):
    from quire.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, m, k) in plain(docs, 50).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op12_substring_dedup"](spark, SMALL).collect()}
    assert got == want


def test_segments_hold_every_window_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sd, "CHUNK_BYTES", 50)
    monkeypatch.setattr(sd, "SEGMENT_WORDS", 7)
    words = [f"w{i}" for i in range(61)]
    batch = pa.record_batch({"text": ["\n".join(words), None, "a b"]})
    seen = [tuple(text.split()[k:k + 5]) for _, first, text in sd._segments(batch, 5) for k in range(text.count(b" ") + 1 - 4)]
    assert sorted(seen) == sorted(tuple(w.encode() for w in words[k:k + 5]) for k in range(57))


def test_sliding_minimum():
    import numpy as np

    x = np.random.default_rng(0).integers(0, 1 << 62, 200).astype(np.uint64)
    for width in (1, 2, 3, 5, 8, 43, 64):
        assert (sd._sliding_min(x, width) == [x[i:i + width].min() for i in range(200 - width + 1)]).all()
