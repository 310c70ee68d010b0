"""Whitening: LOBPCG and whole results against numpy's dense eigenvectors."""

import numpy as np
import pytest
from scriptorium.llm import whitening as W


@pytest.mark.parametrize(("width", "wanted"), [(1, 1), (3, 8), (20, 8), (64, 8), (150, 5)])
def test_lobpcg_equals_dense_eigenvectors(width, wanted):
    a = np.random.default_rng(width).standard_normal((500, width))
    v = a.T @ a
    values, vectors = W.lobpcg(lambda b: v @ b, width, min(wanted, width))
    e, q = np.linalg.eigh(v)
    k = min(wanted, width)
    assert np.allclose(values, e[::-1][:k], rtol=1e-12)
    assert np.allclose(np.abs((vectors * q[:, ::-1][:, :k]).sum(axis=0)), 1, atol=1e-10)


def test_lobpcg_says_so_if_it_does_not_end():
    v = np.diag(np.linspace(1, 2, 200))
    with pytest.raises(RuntimeError):
        W.lobpcg(lambda b: v @ b, 200, 4, guards=0, rounds=2)


def brute(rows):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    a = ((n * x - s) / n).astype(float)
    v = a.T @ a / n
    e, q = np.linalg.eigh(v)
    return n, deviation.tolist(), e[::-1], a @ q[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), np.trace(v)


def held(found, rows, atol=1e-8):
    n, deviation, e, w, trace = brute(rows)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    k = max(r["component"] for r in found)
    assert len(found) == k * len(rows)
    signs = {c: np.sign(sum(by[key][c]["whitened"] * w[i, c - 1] for i, (key, _) in enumerate(rows))) for c in range(1, k + 1)}
    for i, (key, _) in enumerate(rows):
        for c in range(1, k + 1):
            r = by[key][c]
            assert r["n"] == n and r["deviation"] == (deviation[i] if deviation[i] < 1 << 63 else None)
            assert abs(r["whitened"] - signs[c] * w[i, c - 1]) <= atol
            assert abs(r["explained"] / (e[c - 1] / trace) - 1) < 1e-6 and r["identity_error"] < 1e-6
    return k


def test_whole_query_equals_dense_eigenvectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert held(W.op12_whitening(spark, sf).collect(), rows) == 8


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(3, 2, 4).tolist()) for k in range(60)] + [(100, [0.0] * 4), (101, [1e3, -1e3, 5.0, 0.25]), (102, [1e3, -1e3, 5.0, 0.25])]
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [1.0, 2.0]), (205, []), (206, [1e300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(k, v, 1) for k, v in good + odd], "vec_id long, embedding array<double>, x int")
    assert held(W.whitened(frame).collect(), good, atol=1e-5) == 4
    twice = spark.createDataFrame([(k, v) for k, v in good + [(7, good[7][1]), (None, good[3][1])]], "vec_id long, embedding array<double>")
    assert W.whitened(twice, wanted=2).count() == 2 * (len(good) + 2)


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(k, [float(v)]) for k, v in enumerate([0, 1, 10**6, 2.9e6, 3.1e9, 4e12])]
    found = {r["vec_id"]: r["deviation"] for r in W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [int(np.floor(1024 * v[0])) + 100000 for _, v in rows]
    want = [(6 * v - sum(x)) ** 2 for v in x]
    assert found == {k: (d if d < 1 << 63 else None) for k, d in enumerate(want)}


def test_nothing_to_whiten(spark):
    kind = "vec_id long, embedding array<float>"
    assert W.whitened(spark.createDataFrame([], kind)).count() == 0
    assert W.whitened(spark.createDataFrame([(1, [1.0, 2.0])], kind)).count() == 0
    assert W.whitened(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], kind)).count() == 0
    flat = [(k, [float(k % 3), 5.0, float(k % 3)]) for k in range(9)]  # one direction alone varies
    assert {r["component"] for r in W.whitened(spark.createDataFrame(flat, kind)).collect()} == {1}
