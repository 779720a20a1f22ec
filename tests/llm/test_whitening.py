"""Whitening against numpy's dense eigenvectors."""
import math

import numpy as np
import pytest

from weekloom.llm.queries import QUERIES
from weekloom.llm.whitening import leading, whitened

COLUMNS = "vec_id long, embedding array<float>, component string"


def brute(vectors):
    """n, deviations, components and whitened values of a list of clean vectors."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    return n, deviations, values, centred @ basis / np.sqrt(np.maximum(values, 1e-300))


def compare(rows, ids, vectors, count):
    n, deviations, values, white = brute(vectors)
    found = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(found) == len(ids) * count
    sign = [np.sign(sum(found[i, k + 1]["whitened"] * white[j][k] for j, i in enumerate(ids))) for k in range(count)]
    for j, i in enumerate(ids):
        for k in range(count):
            r = found[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, deviations[j])
            assert abs(r["whitened"] * sign[k] - white[j][k]) < 1e-9
            assert abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-10
            assert r["identity_error"] < 1e-10 and r["residual"] < 1e-11


def test_query_equals_dense_eigenvectors(spark):
    sf = "/root/testdata/sf0.001"
    given = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    compare(QUERIES["op12_whitening"](spark, sf).collect(), [g[0] for g in given], [g[1] for g in given], 8)


def test_unusable_vectors_and_clashing_columns(spark):
    g = np.random.default_rng(1)
    clean = [(k, [float(c) for c in g.standard_normal(3) * [3, 2, 1]], "x") for k in range(40)]
    clean += [(40, clean[0][1], None)]
    odd = [(90, None, "x"), (91, [1.0, None, 2.0], "x"), (92, [1.0, float("nan"), 2.0], "x"), (93, [float("inf"), 0.0, 0.0], "x"), (94, [1.0], "x"), (95, [], "x"), (96, [1e30, 0.0, 0.0], "x")]
    rows = whitened(spark.createDataFrame(clean + odd, COLUMNS).repartition(3)).collect()
    compare(rows, [c[0] for c in clean], [c[1] for c in clean], 3)


def test_empty_tables_and_no_variance(spark):
    assert whitened(spark.createDataFrame([], COLUMNS)).collect() == []
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0], "")], COLUMNS)).collect() == []
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], COLUMNS)).collect() == []
    two = whitened(spark.createDataFrame([(None, [1.0, 2.0], ""), (2, [1.5, 2.0], "")], COLUMNS)).collect()
    assert sorted(abs(r["whitened"]) for r in two) == pytest.approx([1.0, 1.0]) and {r["vec_id"] for r in two} == {None, 2}


def test_deviation_beyond_a_long_is_null(spark):
    rows = whitened(spark.createDataFrame([(1, [3e9, 0.0], ""), (2, [0.0, 1.0], ""), (3, [1.0, 0.0], "")], COLUMNS)).collect()
    assert {r["vec_id"]: r["deviation"] is None for r in rows} == {1: True, 2: True, 3: True}


@pytest.mark.parametrize("spectrum", [
    np.r_[1e6, 1e3, np.linspace(10, 1, 198)], np.ones(100), np.r_[np.linspace(1.001, 1, 20), np.full(80, 0.99)], np.r_[3, 2, 1, np.zeros(97)],
    np.r_[np.full(4, 5.0), np.full(4, 4.9), np.linspace(1, 0.1, 300)], np.exp(-np.arange(300) / 3), np.array([2.0]),
])
def test_leading_pairs_of_awkward_spectra(spectrum):
    size = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(0).standard_normal((size, size)))[0]
    v = (turn * spectrum) @ turn.T
    found = leading(lambda q: v @ q, size, 8)
    expected = np.sort(spectrum)[::-1][:8]
    assert np.abs(found.values - expected).max() < 1e-12 * expected[0]
    assert np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0).max() < 1e-11 * expected[0]


def test_a_direction_missed_by_the_first_block_is_found():
    size = 200
    v = np.diag(np.r_[10.0, np.linspace(5, 1, size - 1)])
    first = np.linalg.qr(np.random.default_rng(12).standard_normal((size, 32)))[0]
    calls = []

    def apply(q):  # hides the first direction until the block has been formed
        calls.append(1)
        if len(calls) == 1:
            q = q.copy()
            q[0] = 0
        out = v @ q
        out[0] *= len(calls) > 1
        return out

    assert first.shape == (size, 32)
    assert abs(leading(apply, size, 8).values[0] - 10) < 1e-10
