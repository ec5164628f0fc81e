import math

import numpy as np
import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from sparkwarden.llm import registry
from sparkwarden.llm.whitening import eigenpairs, whiten

SCHEMA = "vec_id long, embedding array<double>, label int"


def symmetric(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.asarray(values, float)) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        np.arange(40, 0, -1), 10.0 ** np.arange(3, -9, -1), [5, 5, 5, 1, 1, 0, 0], [1.0] * 9, np.zeros(6), [3.0],
        1 + 1e-9 * np.arange(20), [7, 7 + 1e-7, 7 + 2e-7, 3, 3 + 1e-10, 2], [1e12, 1, 1e-3], 1e-200 * np.arange(1, 9),
        np.concatenate([100 + 1e-8 * np.arange(30), np.arange(30), 50 + 1e-12 * np.arange(5)]),
    ],
)
def test_eigenpairs(values):
    """Float64 accuracy, clusters included: residual, orthogonality, order, and the values of float64 LAPACK."""
    v, _ = symmetric(values, 3)
    v = (v + v.T) / 2
    e, x = eigenpairs(v)
    size = max(np.abs(v).max(), 1e-300)
    n = len(v)
    assert (np.diff(e) <= 0).all()
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-13
    assert np.abs(x.T @ (v / size) @ x - np.diag(e / size)).max() < 1e-13 * n
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-13 * n * size


def test_vectors_inside_a_cluster():
    """Gaps of 1e-8 are far below float32, yet the vectors are as good as their gap allows."""
    v, q = symmetric(5 + 1e-8 * np.arange(12), 8)
    v = (v + v.T) / 2
    _, x = eigenpairs(v)
    assert np.abs(np.abs(x.T @ q[:, ::-1]) - np.eye(12)).max() < 1e-6


def reference(vectors, components=4):
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array(sums) / n
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    w = ((np.array(x, float) - np.array(sums) / n) @ q[:, :components]) / np.sqrt(e[:components])
    return n, deviations, w, e[:components] / np.trace(cov)


def collected(df, components=4):
    """One list of rows per id, in the order of components."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.component):
        out.setdefault(r[0], []).append(r)
    assert all([r.component for r in rows] == list(range(1, components + 1)) * (len(rows) // components) or len(rows) % components == 0 for rows in out.values())
    return out


def check(got, ids, vectors, components=4):
    n, deviations, w, explained = reference(vectors, components)
    assert set(got) == set(ids)
    ours = np.array([[r.whitened for r in got[i]] for i in ids])
    for c in range(components):
        sign = np.sign(ours[:, c] @ w[:, c])
        assert np.abs(ours[:, c] * sign - w[:, c]).max() < 1e-9 * max(1, np.abs(w).max())
    for i, dev in zip(ids, deviations):
        assert {(r.n, r.deviation) for r in got[i]} == {(n, dev)}
        assert np.allclose([r.explained for r in got[i]], explained, rtol=1e-9)
        assert len({r.identity_error for r in got[i]}) == 1 and got[i][0].identity_error < 1e-9


def test_given_table(spark):
    got = registry.op11_whitening(spark, MEDIUM)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()
    check(collected(got), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_copies_offset_and_scale(spark):
    """A third of the rows is one vector; a large common offset must not cost digits."""
    draw = np.random.default_rng(1)
    vectors = (draw.normal(size=(300, 6)) * [4, 3, 2, 1, 0.5, 0.1] + 40_000).tolist()
    vectors += [vectors[7]] * 150
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    got = collected(whiten(df, "vec_id", "embedding", 4))
    check(got, list(range(len(vectors))), vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -0.25, 1.0], [0.0, 0.0, 0.0], [-0.0, 3.0, 0.1], [9.0, -7.0, 2.5], [0.5, -0.25, 1.0]]
    rows = [(i, v, None) for i, v in enumerate(good)]
    rows += [(10, None, 1), (11, [1.0, None, 2.0], 1), (12, [nan, 1.0, 1.0], 1), (13, [1.0, -inf, 1.0], 1), (14, [], 1), (15, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("component", F.lit(1)).withColumn("id", F.lit("a"))
    got = collected(whiten(df, "vec_id", "embedding"), 3)
    check(got, range(5), good, 3)
    again = spark.createDataFrame([(None, good[0], 1), (3, good[1], 1), (3, good[2], 1)], SCHEMA)
    assert sorted((r.vec_id is None, r.component) for r in whiten(again, "vec_id", "embedding").withColumnRenamed("id", "vec_id").collect()) == sorted(
        [(True, c) for c in (1, 2, 3)] + [(False, c) for c in (1, 2, 3)] * 2
    )
    assert whiten(df.limit(0), "vec_id", "embedding", 4).count() == 0


def test_components_without_variance(spark):
    rows = [(0, [1.0, 2.0, 3.0, 4.0, 5.0], 0), (1, [2.0, 4.0, 6.0, 8.0, 10.0], 0), (2, [1.0, 2.0, 3.0, 4.0, 5.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = collected(whiten(df, "vec_id", "embedding", 4))
    assert all([abs(abs(r[0].whitened) - 1) < 1e-12 and r[k].whitened is None for k in (1, 2, 3)] for r in got.values())
    assert got[0][0].explained == pytest.approx(1) and got[0][0].identity_error < 1e-12
    one = collected(whiten(df.where("vec_id <> 1"), "vec_id", "embedding", 4))
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for rs in one.values() for r in rs)


def test_large_deviations(spark):
    """Those that fit a long are exact, others are null."""
    vectors = [[1e5, 0.0], [-1e5, 0.5], [3e5, 3.0], [6e6, 1.0]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
    _, deviations, _, _ = reference(vectors, 2)
    got = collected(whiten(df, "vec_id", "embedding", 2), 2)
    assert [got[i][0].deviation for i in range(4)] == [d if d < 1 << 63 else None for d in deviations]
    assert any(d >= 1 << 63 for d in deviations) and any(d < 1 << 63 for d in deviations)
