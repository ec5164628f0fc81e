from collections import defaultdict

import pytest
from odd_rows import odd_documents
from pyspark.sql import functions as F

import corpus_pipeline as P
from sparkwarden.llm import quality
from sparkwarden.llm.near_dedup import near_duplicates
from sparkwarden.llm.secret_spans import mask_secrets
from sparkwarden.llm.staging import stage
from sparkwarden.llm.suffix_dedup import remove_repeats

pytest.importorskip("public_tokenizers")


def test_stages_take_effect_one_after_the_other(spark):
    from conftest import MEDIUM

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{MEDIUM}/labels.parquet")
    for name, function in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(function(spark, docs, MEDIUM), name)
        assert after.columns == columns and after.dtypes == docs.dtypes
        rows = {r.doc_id: r.text for r in after.collect()}
        if name == "quality_classifier":
            good = {r.doc_id for r in quality.classify(docs, labels.selectExpr("doc_id", "quality as label")).where("kept").collect()}
            assert rows == {i: t for i, t in before.items() if i in good} and len(rows) < len(before)
            bad = {r.doc_id for r in labels.where("quality = 0").collect()}
            assert len(bad & rows.keys()) < 0.05 * len(bad)
        elif name == "near_dedup":
            kept = {r.doc_id for r in near_duplicates(docs, 5, 80).where("kept").collect()}
            assert rows == {i: t for i, t in before.items() if i in kept} and len(rows) < len(before)
        elif name == "suffix_dedup":
            cut = {r.doc_id: bytes(r.kept).decode() for r in remove_repeats(docs, whole_characters=True).collect()}
            assert rows == before | cut and cut
        else:
            assert rows == {r.doc_id: r.text for r in mask_secrets(docs).collect()}
            assert any("[SECRET]" in t for t in rows.values())
        assert after.where("n_chars <> char_length(text)").count() == 0
        docs = after
    packed = P.run(spark, MEDIUM).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    room = defaultdict(int)
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096


def test_odd_rows(spark):
    from conftest import SMALL

    docs = odd_documents(spark)
    columns = docs.columns
    for name, function in P.STAGES:
        for rows in (docs, docs.limit(0)):
            out = function(spark, rows, SMALL)
            n = out.count()
            assert name == "packing" or out.columns == columns
            assert rows is docs or n == 0
        docs = stage(function(spark, docs, SMALL), name)
    assert 0 in {r.doc_id for r in docs.collect()}


def test_rows_that_repeat_an_id_with_different_texts(spark):
    from conftest import MEDIUM

    def after(function, *texts):
        rows = spark.createDataFrame(texts, "doc_id long, text string")
        return sorted((r.doc_id, r.text) for r in stage(function(spark, rows, MEDIUM), "repeated").collect())

    one, two, three = (" ".join(f"{w}{(i * k) % 97}" for i in range(60)) for w, k in (("oak", 5), ("elm", 7), ("ash", 11)))
    assert after(P.near_dedup, (1, one), (2, one), (2, two), (2, three)) == [(1, one), (2, three), (2, two)]
    cut = after(P.suffix_dedup, (1, one), (2, "start " + one), (2, two), (2, two + three), (3, three))
    assert len(cut) == 5 and {(1, one), (2, "start ")} <= set(cut)
    assert sum(two in t for _, t in cut) == sum(three in t for _, t in cut) == 1

    # Rows that repeat id and text are copies, whatever their other columns hold.
    twice = spark.createDataFrame(
        [(1, one, "b", {"k": 1}), (1, one, "a", {"k": 2}), (2, two, "c", None), (None, three, "d", None), (None, three, "d", None), (3, None, "e", None), (3, None, "e", None)],
        "doc_id long, text string, source string, extra map<string,int>",
    )
    left = stage(P.near_dedup(spark, twice, MEDIUM), "copies")
    assert sorted((r.doc_id or 0, r.source) for r in left.collect()) == [(0, "d"), (0, "d"), (1, "a"), (2, "c"), (3, "e")]
    assert P.suffix_dedup(spark, left, MEDIUM).count() == P.secret_scan(spark, left, MEDIUM).count() == 5
    packed = P.packing(spark, left, MEDIUM).collect()
    assert sorted(r.doc_id for r in packed) == [1, 2, 3]

    # Of a rejected and a kept document that share an id one goes.
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{name}.parquet") for name in ("documents", "labels"))
    kept = {r.doc_id for r in P.quality_classifier(spark, docs, MEDIUM).collect()}
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    bad, good = next(i for i in ids if i not in kept), next(i for i in ids if i in kept)
    texts = {r.doc_id: r.text for r in docs.where(f"doc_id in ({bad}, {good})").collect()}
    shared = docs.withColumn("doc_id", F.when(F.col("doc_id").isin(bad, good), 10**9).otherwise(F.col("doc_id")))
    rows = P.quality_classifier(spark, shared, MEDIUM).where(f"doc_id = {10**9}").collect()
    assert [r.text for r in rows] == [texts[good]]
