"""Spectrum slicing against numpy's decomposition; the contract query against a brute-force form."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.llm import whitening  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def with_spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("values", [
    np.arange(1.0, 21), np.geomspace(1e-9, 1e4, 30), [5.0, 5, 5, 1], [3.0, 3 + 1e-13, 2, 1, 0, 0], [7.0], [2.0, 1],
    [1e6, 1, 1 - 1e-9, 0.5, 0.5, 0.1], [1.0] * 12, -np.arange(1.0, 6),
])
def test_inertia_counts_eigenvalues(values):
    v = with_spectrum(values)
    true = np.linalg.eigvalsh(v)
    for s in np.concatenate([true - 1e-5 * abs(true).max(), true + 1e-5 * abs(true).max(), [-1e9, 0.3, 1e9]]):
        if np.abs(true - s).min() > 1e-9 * abs(true).max():
            assert whitening.inertia_above(v, s) == (true > s).sum()


@pytest.mark.parametrize("values", [
    np.arange(1.0, 21), np.geomspace(1e-9, 1e4, 30), [5.0, 5, 5, 1], [3.0, 3 + 1e-13, 2, 1, 0, 0], [7.0], [2.0, 1],
    [1e6, 1, 1 - 1e-9, 0.5, 0.5, 0.1], [1.0] * 12, [0.0, 0.0],
])
def test_leading_eigenpairs(values):
    v = with_spectrum(values)
    got, turn = whitening.leading_eigenpairs(v, 8, 1e-12 * np.trace(v))
    true = np.linalg.eigvalsh(v)[::-1]
    true = true[true > 1e-12 * np.trace(v)][:8]
    assert len(got) == len(true) and np.allclose(got, true, rtol=1e-12, atol=1e-13 * max(map(abs, values)))
    assert np.allclose(turn.T @ turn, np.eye(len(got)), atol=1e-12)
    assert np.abs(v @ turn - turn * got).max(initial=0) <= 1e-11 * max(1e-300, *map(abs, values))


def brute(rows, count=8):
    ok = [(i, np.floor(1024 * np.array(v, dtype=float)) + 100000) for i, v in rows
          if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in ok], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:count]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    white = centred @ u[:, order] / np.sqrt(e[order])
    return [i for i, _ in ok], n, deviation, white, e[order] / np.trace(v)


def test_query_equals_brute_force(spark):
    from quire.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, n, deviation, white, explained = brute(rows)
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_embedding_whitening"](spark, SMALL).collect()}
    assert len(got) == 8 * len(ids)
    assert max(r.identity_error for r in got.values()) < 1e-8
    for k in range(8):
        mine = np.array([got[i, k + 1].whitened for i in ids])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-8
        assert all(abs(got[i, k + 1].explained - explained[k]) < 1e-10 for i in ids)
        assert [got[i, k + 1].deviation for i in ids] == deviation and {got[i, k + 1].n for i in ids} == {n}


def test_edges(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.5, -2.0, 0.5]), (3, None), (4, [1.0, None, 0.5]), (5, [float("nan"), 1.0, 0.5]),
            (6, [float("inf"), 1.0, 0.5]), (7, []), (8, [1.0, 2.0]), (9, [0.25, 1.0, 0.5]), (9, [0.25, 1.0, 0.5]),
            (None, [1.0, 1.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    # the third entry never varies, so two components; the repeated row comes back twice
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 2, 9, 9) for c in (1, 2))
    assert {r.n for r in got} == {5} and max(r.identity_error for r in got) < 1e-9
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(df.limit(0)).columns == whitening.whiten(df).columns


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(1000)] + [(5000, [2.0e6, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).collect()}
    _, _, deviation, _, _ = brute(rows)
    assert deviation[-1] >= 1 << 63 and got[5000] is None
    assert all(got[i] == deviation[i] for i in range(1000))


def test_names_of_the_result_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 3), (2, [2.0, 2.0], 3)], "vec_id long, embedding array<double>, whitened int")
    model = whitening.fit(df)
    with pytest.raises(ValueError):
        model.transform(df, carry=["whitened"])
    assert whitening.whiten(df).count() == 2
