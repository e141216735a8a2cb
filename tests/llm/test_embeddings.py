"""NN-descent alone against brute force, and the audit that only measures."""

import numpy as np
import pytest

from quire.llm import embeddings

DIM = 64


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def partners(rng, x, cosine):
    """A vector at this cosine from each of x."""
    y = rng.standard_normal(x.shape)
    y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * y


def crowd_and_pairs(rng):
    """Vectors in a cone that are hardly linked, pairs in that cone, a linked crowd, pairs that stand alone, single ones."""
    cone = unit(rng.standard_normal(DIM) / np.sqrt(DIM) + 0.33 * unit(rng.standard_normal((1000, DIM))))
    crowd = unit(unit(rng.standard_normal(DIM)) + 0.2 * unit(rng.standard_normal((600, DIM))))
    alone = unit(rng.standard_normal((300, DIM)))
    return np.concatenate([cone, partners(rng, cone[:100], 0.956), crowd, alone, partners(rng, alone, 0.953),
                           unit(rng.standard_normal((900, DIM)))])


def brute_components(x):
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    s = x @ x.T
    for i, j in zip(*np.nonzero(np.triu(s >= embeddings.THRESHOLD, 1))):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(x))}


def rows_of(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")


def test_search_alone_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "AUDIT", 2)  # next to no vector is audited
    x = crowd_and_pairs(np.random.default_rng(3))
    got = {r.vec_id: r.component_id for r in embeddings.near_vectors(rows_of(spark, x)).collect()}
    assert got == brute_components(x)


def test_search_that_finds_nothing_fails(spark, monkeypatch):
    """The audit sees every link of so small a table, and must not lend them to the result."""
    found = embeddings._leaf_lists
    monkeypatch.setattr(embeddings, "_leaf_lists", lambda *a: found(*a).limit(0))
    monkeypatch.setattr(embeddings, "PASSES", 3)
    rng = np.random.default_rng(4)
    x = unit(rng.standard_normal((40, DIM)))
    with pytest.raises(RuntimeError, match="recall"):
        embeddings.near_vectors(rows_of(spark, np.concatenate([x, partners(rng, x, 0.97)])))
