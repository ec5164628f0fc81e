import math
import re
from collections import Counter

import pytest
from odd_rows import odd_documents

from sparkwarden.llm import lm_scores as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def counts(texts):
    one, two, followed = Counter(), Counter(), Counter()
    for t in map(tokens, texts):
        one.update(t)
        two.update(zip(t, t[1:]))
        followed.update(t[:-1])
    return one, two, followed, sum(one.values())


def check(spark, docs, target):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    (one_b, two_b, fol_b, n_b), (one_t, two_t, fol_t, n_t) = counts(t for _, t in rows), counts(r.text for r in target.collect())
    v = len(one_b | one_t)
    want = []
    for i, text in rows:
        words = tokens(text)
        own, own2, own_fol, b, t = Counter(words), Counter(zip(words, words[1:])), Counter(words[:-1]), 0.0, 0.0
        for k, w in enumerate(words):
            p = (one_b[w] - own[w] + L.FLOOR) / (n_b - len(words) + L.FLOOR * v)
            q = (one_t[w] + L.NU * p) / (n_t + L.NU)
            if k:
                u = words[k - 1]
                p, q = (two_b[u, w] - own2[u, w] + L.MU * p) / (fol_b[u] - own_fol[u] + L.MU), (two_t[u, w] + L.MU * q) / (fol_t[u] + L.MU)
            b, t = b - math.log(p), t - math.log(q)
        n = max(len(words), 1)
        want.append((i, len(words), t / n, b / n, (b - t) / n))
    got = sorted(tuple(r) for r in L.cross_entropy_difference(docs, target).collect())
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g == pytest.approx(w, abs=1e-9)
    return got


def test_against_plain_counts(spark, monkeypatch):
    from conftest import SMALL

    monkeypatch.setattr(L, "BATCH", 5000)  # many batches and ranges
    monkeypatch.setattr(L, "RANGE_BYTES", 1 << 17)
    docs, target = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    small = check(spark, docs, target)
    monkeypatch.setattr(L, "BATCH", 50_000)
    monkeypatch.setattr(L, "LOW_BITS", 3)  # most counts of words have more
    assert sorted(tuple(r) for r in L.cross_entropy_difference(docs, target).collect()) == small  # to the last digit


def test_probabilities_add_up(spark):
    """The documents "w" and "a w" of every word w show each model's p(w) and p(w | a); what they add themselves is taken away again."""
    corpus = list(enumerate(["a b a c a", "b c", "a", "c a b"]))
    goal = spark.createDataFrame([("a d a",), ("d",), ("b a",)], "text string")

    def losses(text):
        docs = spark.createDataFrame([*corpus, (99, text)], "doc_id long, text string")
        (row,) = L.cross_entropy_difference(docs, goal).where("doc_id = 99").collect()
        return row.n_tokens * row.loss_background, row.n_tokens * row.loss_target

    one, two = ({w: losses(f"{context}{w}") for w in "abcd"} for context in ("", "a "))
    for k in (0, 1):
        assert sum(math.exp(-one[w][k]) for w in "abcd") == pytest.approx(1)
        assert sum(math.exp(one["a"][k] - two[w][k]) for w in "abcd") == pytest.approx(1)


def test_rows_hold_something(spark):
    """A batch has one row per range in which it has a word or pair, however many ranges there are."""
    docs = spark.createDataFrame([(i, f"w{i} x{i}") for i in range(8)], "doc_id long, text string").repartition(4, "doc_id")
    read = docs.mapInArrow(L._read(False), L._TOKENS).select("batch", "target", "counts", "words", "tokens")
    few, many = (read.mapInArrow(L._ask(n), L._ASKED) for n in (1, 1 << 20))
    assert few.selectExpr("sum(size(grams))").first()[0] == 8 * 5  # two words, each as a last one too, and a pair
    assert many.count() <= 8 * 5 and many.where("size(grams) = 0").count() == 0


def test_odd_rows(spark):
    target = spark.createDataFrame([("the new bridge over the river",), (None,), ("",)], "text string")
    got = check(spark, odd_documents(spark), target)
    score = {g[0]: g[4] for g in got}
    assert score[3] == score[4] == 0
    assert L.cross_entropy_difference(odd_documents(spark).limit(0), target).count() == 0
    assert L.cross_entropy_difference(odd_documents(spark), target.limit(0)).count() == len(got)


def test_memory_of_scoring_grows_little_with_a_batch():
    """Losses are worked out some texts at a time: about 200 bytes a token were held at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    draw, n = np.random.default_rng(5), 600_000
    tokens, counts = draw.integers(0, 50_000, n).astype(np.int32), np.full(n // 300, 300, np.int32)
    words = np.unique(draw.integers(1, 1 << 62, 50_100))[:50_000]
    columns = {"batch": [0], "target": [False], "doc_ids": [np.arange(len(counts))], "counts": [counts], "words": [words], "tokens": [tokens]}
    kinds = dict(zip(columns, [pa.int64(), pa.bool_(), *map(pa.list_, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))]))
    read = pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})
    asked = list(L._ask(4)(iter(read.select(["batch", "target", "counts", "words", "tokens"]).to_batches())))
    asked = pa.Table.from_batches(asked)
    told = pa.concat_tables([L._answer(31)(asked.filter(pa.array(asked["range"].to_numpy() == r))) for r in range(4)])
    score = L._score(n, 0, len(words), 31)
    tracemalloc.start()
    try:
        out = score(read, told.drop_columns(["words"]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(out) == len(counts) and set(out["n_tokens"].to_pylist()) == {300}
    assert peak < 150 * n, peak / n
