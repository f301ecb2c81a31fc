"""Whitening against plain numpy, and on awkward rows."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidebar.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, components=8):
    """Whole table in numpy; exact deviations in Python numbers."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x]
    centred = x - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, len(e))
    return n, deviation, np.abs(centred @ axes[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


def held(df, vectors):
    n, deviation, whitened, explained = plain(list(vectors.values()))
    rows = df.collect()
    k = whitened.shape[1]
    assert len(rows) == n * k
    place = {v: i for i, v in enumerate(vectors)}
    for r in rows:
        i, c = place[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == deviation[i]
        assert abs(abs(r.whitened) - whitened[i, c]) < 1e-6 and abs(r.explained - explained[c]) < 1e-9
        assert 0 <= r.identity_error < 1e-6
    for c in range(k):  # one sign for all rows
        w = np.array([r.whitened for r in sorted(rows, key=lambda r: r.vec_id) if r.component == c + 1])
        assert abs(w.mean()) < 1e-9 and abs((w * w).mean() - 1) < 1e-9


@pytest.mark.parametrize("width,rows", [(256, 4096), (7, 11)])
def test_whole_table(spark, data, monkeypatch, width, rows):
    monkeypatch.setattr(whitening, "WIDTH", width)
    monkeypatch.setattr(whitening, "ROWS", rows)
    t = pq.read_table(f"{data}/embeddings.parquet").to_pylist()
    held(queries.op13_embedding_whitening(spark, data), {r["vec_id"]: r["embedding"] for r in t})


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = {i: rng.normal(size=3).astype(np.float32).tolist() for i in range(40)}
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1e38, 0.0, 0.0])]
    rows = [(i, v, 1) for i, v in [*good.items(), *bad]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "label", "1 as n", "2 as vector", "3 as whitened")
    held(whitening.whiten(df), good)


def test_repeats_null_ids_and_no_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 1)] * 3, SCHEMA)).collect()
    assert len(one) == 6 and all(r.vec_id is None and r.n == 3 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (2, [2.0, 4.0], 1)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in line) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 1, False), (2, 2, True), (2, 2, True)]
    assert all(r.identity_error < 1e-9 for r in line)


def test_empty(spark):
    out = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [2.0**39], 1), (2, [0.0], 1), (3, [1.0], 1)], SCHEMA)).collect()
    assert all(r.deviation is None or r.deviation >= 0 for r in out) and any(r.deviation is None for r in out)
