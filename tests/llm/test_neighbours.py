import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import neighbours
from sparkwarden.llm.neighbours import nearest


def frame(spark, ids, vectors, kind="float"):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit(1)).withColumn("list", F.lit(2))


def brute_force(ids, x, asked, k=20):
    out = {}
    for q in asked:
        score = (x * x[list(ids).index(q)]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), score[i]) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_given_vectors(spark):
    from conftest import MEDIUM

    df = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got, want = found(nearest(df, F.col("id") % 20 == 0)), brute_force(ids, x, [i for i in ids if i % 20 == 0])
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rows in got.items():
        for i, score in rows:
            assert score == pytest.approx(float(x[list(ids).index(q)] @ x[list(ids).index(i)]), abs=1e-12)


def test_norms_copies_and_blocks(spark, monkeypatch):
    """Vectors of very different lengths, a third of all rows the same vector, many small blocks."""
    monkeypatch.setattr(neighbours, "LIST_BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 12)) * draw.uniform(0.1, 5, size=(300, 1))
    x[::3] = x[0]
    x = x.astype(np.float32).astype(float)
    ids = np.arange(300)
    got = found(nearest(frame(spark, ids, x), F.col("id") % 20 == 0))
    want = brute_force(ids, x, range(0, 300, 20))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    copy = [q for q in want if q % 3 == 0 and want[q][0][1] == pytest.approx((x[0] ** 2).sum())]
    for q in copy:  # ties go to the smaller id
        ties = [i for i, s in got[q] if s == got[q][0][1]]
        assert ties == sorted(ties)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [0.5, 0.5], None, [0, 0], [nan, 1], [inf, 0], [None, 1], [], [1, 2, 3], [-1, 0]]
    df = frame(spark, range(0, 200, 20), vectors)
    got = found(nearest(df, F.col("id") % 20 == 0))
    assert got == {0: [(20, 0.5), (180, -1.0)], 20: [(0, 0.5), (180, -0.5)], 180: [(20, -0.5), (0, -1.0)]}
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    again = df.unionByName(df.where("vec_id = 0")).unionByName(df.select(F.lit(None).cast("long").alias("vec_id"), "embedding", "score", "list"))
    assert found(nearest(again, F.col("id") % 20 == 0)) == got


def test_hypothesis_tests_drop_few_true_neighbours():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(3000, 48))
    queries = pd.DataFrame({"query_id": range(10), "vector": list(x[:10]), "beat": np.inf})
    largest = float(np.sqrt((x**2).sum(1).max()))
    vectors = pd.DataFrame({"id": range(3000), "vector": list(x)})
    scan = neighbours._scan(neighbours.rotation(49, 1), largest, 20)
    exact = scan(vectors, queries)
    worst = exact.groupby("query_id").score.min().to_numpy()
    queries["beat"] = (x[:10] ** 2).sum(1) + largest**2 - 2 * worst
    again = scan(vectors, queries)
    assert len(again.merge(exact, on=["query_id", "id"])) >= 0.97 * len(exact) and len(exact) == 200
