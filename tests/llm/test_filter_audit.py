"""Removal steps by the min-plus product, and the audit against walking every order through the rows."""

import itertools
import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from quire.llm import filter_audit as fa  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


def failing(docs):
    """Per row the set of failed filters, by the definitions."""
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = brute.words(t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            fails.add("E")
        out.append(fails)
    return out


def walk(docs, labels):
    fails = failing(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in itertools.permutations("ABCDE"):
            left, gone = list(own), []
            for step, f in enumerate(order, 1):
                redundant = sum(f in x for _, x in gone)
                lost = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                gone += lost
                shapley[f] += len(lost)
                rows["".join(order), step] = [len(left), len(lost), redundant, sum(x == {f} for _, x in own),
                                              sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
        out |= {(part, o, s): (*r, shapley[o[s - 1]]) for (o, s), r in rows.items()}
    return out


def audited(spark, docs, labels):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    counts = fa.failures(d, spark.createDataFrame(labels, LABELS), fa.text_failures(F.col("text")))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in fa.audit(counts, list("ABCDE")).collect()}


def test_equals_walking_every_order(spark):
    rng = random.Random(3)
    texts = [None, "", "x", " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i}" for i in range(199)), "a b " * 150,
             "A" * 3 + "b" * 147, "A" * 3 + "b" * 146, "money $", "é" * 49 + "A", "é" * 48 + "A", "a b " * 220,
             " ".join(f"W{i}" for i in range(200)) + " #"]
    texts += [" ".join(f"w{i}" for i in range(100)) + " w0" * 100, " ".join(f"w{i}" for i in range(100)) + " w0" * 101]
    docs = [(rng.randrange(60) if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(150)]
    docs += [docs[0], docs[0], (docs[0][0], docs[0][1], "other")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1), (999, 1, 1)]
    got = audited(spark, docs, labels)
    want = walk(docs, labels)
    assert got == want and len(got) == 120 * 5 * 4


def test_empty(spark):
    assert audited(spark, [], []) == {}


@pytest.mark.parametrize("k", [1, 2, 4])
def test_removal_steps(k):
    orders, steps, positions = fa.removal_steps(k)
    for o, order in enumerate(orders.tolist()):
        assert [order[positions[o, f]] for f in range(k)] == list(range(k))
        for mask in range(1 << k):
            hits = [s for s, f in enumerate(order) if mask >> f & 1]
            assert steps[o, mask] == (hits[0] if hits else k)


def test_other_filters(spark):
    """Counts of any filters can be audited; combinations may repeat."""
    counts = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 0), ("p", True, False, 1, 0, 1), ("q", False, False, 4, 4, 4)],
                                   "part string, X boolean, Y boolean, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): r for r in fa.audit(counts, ["X", "Y"]).collect()}
    assert len(got) == 8 and got["q", "XY", 2].kept == 4 and got["p", "XY", 1].removed == 6 and got["p", "YX", 1].removed == 2
    assert got["p", "YX", 2].redundant == 2 and got["p", "YX", 2].unique_fails == 4 and got["p", "YX", 2].shapley == 10
    with pytest.raises(ValueError):
        fa.audit(counts, [])
