import math
from collections import Counter

import numpy as np
import pytest
from odd_rows import odd_documents
from pyspark.sql import functions as F

from sparkwarden.llm import quality
from sparkwarden.llm.registry import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op2_quality_cotraining"](spark, folder)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    held_out = scored.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right, lost, n = held_out.selectExpr(
        "sum(cast(kept = (quality = 1) as int))", "sum(cast(not kept and quality = 1 as int))", "count(*)"
    ).first()
    assert n > 500 and right >= 0.97 * n and lost <= 0.01 * n


def test_pseudo_labels_reach_the_other_view(spark):
    """Few labels; the sources of unlabelled junk are learned from what the content view is sure about."""
    clean = "A plain sentence with ordinary words, and then another one that follows it."
    junk = "### $$$ | | %%% &&& ### | $$$ %%% | |"
    rows = [(i, clean if i % 2 else junk, "good" if i % 2 else "bad", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    # Labelled rows are shown without their sources, so only pseudo-labels tell about them.
    docs = docs.withColumn("source", F.when(F.col("doc_id") < 20, "none").otherwise(F.col("source")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    described = quality.describe(docs).join(labels, "doc_id", "left")
    rows = {r.doc_id: r for r in described.collect()}
    model = quality.fit(described, rounds=3)
    once = quality.fit(described, rounds=1)
    source = rows[101].metadata[0], rows[100].metadata[0]
    gap = [m.metadata.odds[0, source[0]] - m.metadata.odds[0, source[1]] for m in (once, model)]
    assert gap[0] == 0 and gap[1] > 3


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (9, 1), (10, 0), (None, 0), (77, 1), (5, None), (4, 7)], "doc_id long, label int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.where("doc_id is not null").count()
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in rows)
    assert all(r.kept and r.score == 1 for r in quality.classify(docs, labels.limit(1)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs.select("doc_id", "text"), labels).count() == len(rows)


def test_rounds_against_a_plain_loop(spark):
    """Counts, pseudo-labels and the combination of views, row by row on the given documents."""
    folder = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    labels = labels.where("doc_id % 3 <> 0")  # the others are left to pseudo-labels
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = quality.describe(docs).join(labels, "doc_id", "left").collect()
    views = [[list(r.content) for r in rows], [list(r.metadata) for r in rows]]
    known = [r.label for r in rows]
    y = np.array([t for t in known if t is not None], float)
    assert 0 < y.sum() < len(y) < len(rows)

    def probability(view, weights, odds):
        total = [weights[-1] + sum(w * odds[f, b] for f, (w, b) in enumerate(zip(weights, bins))) for bins in view]
        return [1 / (1 + math.exp(-t)) for t in total], total

    sure, taught = [known, known], 0  # labels that each view learns from
    for _ in range(quality.ROUNDS):
        odds, weights = [], []
        for view, labelled in zip(views, sure):
            seen = Counter((f, b, t) for bins, t in zip(view, labelled) if t is not None for f, b in enumerate(bins))
            all_of = Counter(t for t in labelled if t is not None)
            size = 0.5 * quality.BINS
            odds.append({
                (f, b): math.log((seen[f, b, 1] + 0.5) / (all_of[1] + size)) - math.log((seen[f, b, 0] + 0.5) / (all_of[0] + size))
                for f in range(len(view[0])) for b in range(quality.BINS)
            })
            evidence = [[odds[-1][f, b] for f, b in enumerate(bins)] for bins, t in zip(view, known) if t is not None]
            weights.append(quality.fit_logistic(np.array(evidence), y, ridge=1e-3))
        p = [probability(view, w, o) for view, w, o in zip(views, weights, odds)]
        sure = [
            [t if t is not None else int(q > 0.5) if q >= quality.SURE or q <= 1 - quality.SURE else None for t, q in zip(known, p[1 - k][0])]
            for k in (0, 1)
        ]
        taught += sum(a is not None for s in sure for a in s) - 2 * len(y)
    assert taught > 0
    both = np.array([p[0][1], p[1][1]]).T
    w = quality.fit_logistic(both[[t is not None for t in known]], y, ridge=1e-4)
    want = {r.doc_id: 1 / (1 + math.exp(-(w[0] * a + w[1] * b + w[2]))) for r, (a, b) in zip(rows, both)}
    got = quality.classify(docs, labels).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, abs=1e-6)
    assert {r.doc_id: r.content_score for r in got} == pytest.approx({r.doc_id: q for r, q in zip(rows, p[0][0])}, abs=1e-6)
