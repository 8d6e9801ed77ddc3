"""Lanczos whitening against a dense eigensolver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import whitening


def table(spark, vectors, extra="extra string"):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "k") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<double>, {extra}")


def dense(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    y = (len(x) * x - x.sum(axis=0)) / len(x)
    e, q = np.linalg.eigh(y.T @ y / len(x))
    return x, y, e[::-1], q[:, ::-1]


def compared(spark, vectors, k, tolerance=1e-9):
    df = table(spark, vectors)
    model = whitening.fit(df, components=k)
    x, y, e, q = dense(vectors)
    k = len(model.values)
    assert np.allclose(model.values, e[:k], rtol=1e-10) and np.isclose(model.trace, e.sum(), rtol=1e-12)
    assert np.allclose(model.components @ model.components.T, np.eye(k), atol=1e-13)
    rows = {r.vec_id: r for r in whitening.whiten(df, model).collect()}
    white = np.array([rows[i].whitened for i in range(len(vectors))])
    assert [rows[i].deviation for i in range(len(vectors))] == ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()
    # residual of V c = e c: also right where eigenvalues are equal
    v = y.T @ y / len(x)
    assert np.abs(v @ model.components.T - model.components.T * model.values).max() < 1e-10 * e[0]
    assert np.abs(white - y @ model.components.T / np.sqrt(model.values)).max() < tolerance
    assert model.identity_error < 1e-9
    gram = (white - white.mean(axis=0)).T @ (white - white.mean(axis=0)) / len(white)
    assert np.abs(gram - np.eye(k)).max() < 1e-9
    return model, e, q


def test_general(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 10)) * np.geomspace(3, 0.1, 10)
    model, e, q = compared(spark, vectors, 4)
    assert np.allclose(np.abs((model.components * q[:, :4].T).sum(axis=1)), 1, atol=1e-12)


def test_equal_eigenvalues(spark):
    """Plus and minus unit vectors: every eigenvalue is the same, each step is a new start."""
    vectors = np.concatenate([np.eye(6), -np.eye(6)])
    model, _, _ = compared(spark, vectors, 4)
    assert len(model.values) == 4 and model.steps == 6


def test_low_rank_and_few_rows(spark):
    rng = np.random.default_rng(4)
    low = rng.integers(-3, 4, (80, 2)) @ rng.integers(-3, 4, (2, 7)) / 4.0
    model, _, _ = compared(spark, low, 5)
    assert len(model.values) == 2
    model, _, _ = compared(spark, rng.standard_normal((3, 9)), 8)
    assert len(model.values) == 2


def test_a_dominant_value_stops_early(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((200, 30)) * np.geomspace(50, 1e-4, 30)
    model, _, _ = compared(spark, vectors, 3)
    assert model.steps < 30


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0, None], [nan, 1.0], [1.0, inf], [1.0, -inf], [1.0, 2.0, 3.0]]
    good = [[0.5, 1.0], [0.5, 1.0], [-0.25, 2.0], [1.5, 0.125]]
    df = table(spark, bad + good, "whitened string").withColumns({c: F.lit(1) for c in ("x", "i", "p", "__x2", "w")})
    model = whitening.fit(df)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "x", "i", "p", "__x2", "w", "deviation", "whitened"]
    assert sorted(r.vec_id for r in out.collect()) == [7, 8, 9, 10] and model.n == 4
    alike = whitening.fit(table(spark, [[1.0, 2.0]] * 3))
    assert alike.n == 3 and not len(alike.values)
    assert [r.whitened for r in whitening.whiten(table(spark, [[1.0, 2.0]] * 3), alike).collect()] == [[]] * 3
    none = table(spark, bad[:3])
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0


def test_contract(spark, sf_dir):
    rows = whitening.op12_whitening(spark, sf_dir).collect()
    ids = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    x, y, e, q = dense(list(ids.values()))
    white = y @ q[:, :8] / np.sqrt(e[:8])
    got = np.zeros_like(white)
    at = {v: i for i, v in enumerate(ids)}
    assert len(rows) == 8 * len(ids)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(ids) and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-8
