import numpy as np
import pytest
from test_neighbours import frame

from sparkwarden.llm import vector_dedup
from sparkwarden.llm.vector_dedup import near_duplicate_vectors


def brute_force(ids, x, cosine=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    part = np.array(ids)
    while True:
        new = np.minimum(part, np.where(linked, part[None, :], part.max()).min(1))
        if (new == part).all():
            break
        part = new
    return {int(i): (int(n), int(c), int(c) == int(i)) for i, n, c in zip(ids, linked.sum(1), part)}


def result(df):
    return {r.id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, monkeypatch, block):
    """A large group of near copies, pairs close to the limit, and a third of all rows the same vector."""
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    draw = np.random.default_rng(1)
    base = draw.normal(size=(120, 32))
    near = base[0] + 0.12 * draw.normal(size=(150, 32))
    z = draw.normal(size=(120, 32))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    z -= (z * unit).sum(1, keepdims=True) * unit
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = draw.uniform(0.901, 0.93, size=(120, 1))
    edge = 3 * (cosine * unit + np.sqrt(1 - cosine**2) * z)
    x = np.concatenate([base, near, edge, np.repeat(base[5:6], 190, 0)]).astype(np.float32).astype(float)
    ids = draw.permutation(len(x))
    assert result(near_duplicate_vectors(frame(spark, ids, x))) == brute_force(ids, x)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [2, 0], None, [0, 0], [nan, 1], [inf, 0], [None, 1], [], [1, 2, 3], [-1, 0], [1, 0.1]]
    df = frame(spark, range(11), vectors, "double")
    alone = {i: (0, i, True) for i in range(2, 10)}
    want = {0: (2, 0, True), 1: (2, 0, False), 10: (2, 0, False)} | alone
    assert result(near_duplicate_vectors(df)) == want
    assert result(near_duplicate_vectors(df.unionByName(df.where("vec_id = 10")))) == want
    assert near_duplicate_vectors(df.limit(0)).count() == 0
    assert result(near_duplicate_vectors(df.where("vec_id = 3"))) == {3: (0, 3, True)}


def test_given_vectors(spark):
    from conftest import MEDIUM

    df = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    rows = df.collect()
    want = brute_force([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    assert result(near_duplicate_vectors(df)) == want


def test_pairs_at_the_limit_are_linked(spark):
    """Vectors of whole numbers whose cosine is 0.9 exactly: rounding of scaled vectors must not drop them."""
    pairs = [([10, 0, 0, 0], [9, 3, 3, 1]), ([20, 0, 0, 0], [9, 3, 3, 1]), ([0, 7, 0, 0], [1, 9, 3, 3]), ([0, 0, 3, 0], [3, 3, 9, 1]), ([0, 0, 0, 13], [3, 1, 3, 9])]
    for a, b in pairs:
        df = frame(spark, [1, 2], [a, b], "double")
        assert result(near_duplicate_vectors(df)) == {1: (1, 1, True), 2: (1, 1, False)}, (a, b)


def test_pairs_just_above_the_limit(spark):
    """Pairs of 64 dimensions with cosines up to 0.905: two rotations of filters left out some of them."""
    draw = np.random.default_rng(3)
    base, z = draw.normal(size=(5000, 64)), draw.normal(size=(5000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    z -= (z * base).sum(1, keepdims=True) * base
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = draw.uniform(0.9001, 0.905, size=(5000, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * z])
    got = result(near_duplicate_vectors(frame(spark, range(10_000), x.tolist(), "double")))
    assert got == {i: (1, i % 5000, i < 5000) for i in range(10_000)}


def test_chains_hold_together(spark):
    """4 and 3 are linked, but 4 also to the smaller 1 and 3 to the smaller 2, and all four are in one filter."""
    angles = np.deg2rad([0, 0.7, 1.4, 2.1])
    x = np.stack([np.cos(angles), np.sin(angles)], 1)
    want = brute_force([1, 4, 3, 2], x, 0.9999)
    assert want == {1: (1, 1, True), 4: (2, 1, False), 3: (2, 1, False), 2: (1, 1, False)}
    assert result(near_duplicate_vectors(frame(spark, [1, 4, 3, 2], x.tolist(), "double"), cosine=0.9999)) == want


@pytest.mark.parametrize(["cosine", "block_bytes"], [(0.5, 1 << 25), (0.35, 1 << 16)])
def test_pairs_that_share_no_direction(spark, monkeypatch, cosine, block_bytes):
    """Far from each other, vectors seldom lie in one spherical cap; all pairs are compared."""
    monkeypatch.setattr(vector_dedup, "BLOCK_BYTES", block_bytes, raising=False)
    draw = np.random.default_rng(4)
    base = draw.normal(size=(300, 32))
    x = np.concatenate([base, base + 1.6 * draw.normal(size=(300, 32))])
    ids = draw.permutation(len(x)) + 5
    assert result(near_duplicate_vectors(frame(spark, ids, x.tolist(), "double"), cosine=cosine)) == brute_force(ids, x, cosine)


def test_vectors_of_all_lengths(spark):
    """Vectors of a rarer length are compared with each other; an id with several has the one of the usual length."""
    rows = [(1, [1, 0]), (2, [2, 0]), (3, [0, 1]), (4, [1, 2, 3]), (5, [2, 4, 6]), (6, [1, 2, 3]), (3, [1, 2, 3]), (7, [0, -1]), (8, [-1, 0])]
    df = frame(spark, [i for i, _ in rows], [v for _, v in rows], "double")
    got = result(near_duplicate_vectors(df))
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (2, 4, True), 5: (2, 4, False), 6: (2, 4, False), 7: (0, 7, True), 8: (0, 8, True)}
