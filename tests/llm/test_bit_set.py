import random
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sparkwarden.llm import bit_set
from sparkwarden.llm.suffix_dedup import cut_repeats, find_repeats

pytest.importorskip("public_tokenizers")


def on_disk(spark):
    """Bytes of all shuffle files of the session."""
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle"))


def moved(spark, df):
    before = on_disk(spark)
    rows = df.collect()
    return on_disk(spark) - before, rows


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def large_texts(spark, n=400, size=20_000):
    draw = random.Random(5)
    letters = string.ascii_letters + string.digits + "  "
    rows = [(i, "".join(draw.choices(letters, k=size)), "web", "en", size) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")


@pytest.mark.parametrize("words", [1 << 19, 1])
def test_parted(spark, monkeypatch, words):
    """Also when the set lets very much through."""
    monkeypatch.setattr(bit_set, "WORDS", words)
    rows = spark.range(5000).selectExpr("nullif(id, 7) as doc_id", "id as n").unionByName(spark.range(3).selectExpr("id as doc_id", "-id as n"))
    ids = spark.createDataFrame([(i,) for i in (0, 1, 40, 41, 9999, None)], "doc_id long")
    clear, others = bit_set.parted(rows, "doc_id", ids)
    clear, others = clear.collect(), others.collect()
    assert sorted(clear + others, key=str) == sorted(rows.collect(), key=str)
    assert not {0, 1, 40, 41} & {r.doc_id for r in clear}
    assert words == 1 or len(others) < 20
    clear, others = bit_set.parted(rows, "doc_id", ids.limit(0))
    assert clear.count() == 5003 and others.count() == 0


def test_dropping_rows_does_not_move_the_others(spark, no_broadcast):
    docs = P.stage(large_texts(spark), "docs")
    rows = docs.withColumn("__row", F.when(F.col("doc_id") != 9, F.col("doc_id")))  # a row without a key stays
    gone = spark.createDataFrame([(3,), (9,), (77,), (1000,)], "doc_id long")
    size, out = moved(spark, P._without(rows, gone))
    assert sorted(out) == sorted(docs.where("doc_id not in (3, 77)").collect())
    assert size < 1_000_000  # of 8 MB


def test_cutting_passages_does_not_move_texts_that_keep_all(spark, no_broadcast):
    docs = large_texts(spark)
    shared, whole = "shared passage " * 10, docs.where("doc_id = 5").first().text
    text = F.when(F.col("doc_id").isin(20, 30), F.concat("text", F.lit(shared))).when(F.col("doc_id") == 50, F.lit(whole)).otherwise(F.col("text"))
    docs = P.stage(docs.withColumn("text", text), "docs")
    want = {r.doc_id: r.text for r in docs.collect()}
    found = find_repeats(docs)
    assert {r.doc_id for r in found.ids.collect()} == {20, 30, 50}  # in 20 the passage repeats within itself
    size, cut = moved(spark, cut_repeats(found, whole_characters=True))
    assert size < 1_000_000  # of 8 MB
    want |= {r.doc_id: bytes(r.kept).decode() for r in cut}
    out = P.suffix_dedup(spark, docs, "")
    size, rows = moved(spark, out)
    assert size < 1_000_000
    assert {r.doc_id: r.text for r in rows} == want and want[50] == "" and want[30] == large_texts(spark).where("doc_id = 30").first().text
    assert all(r.n_chars == len(r.text) for r in rows) and out.columns == docs.columns
