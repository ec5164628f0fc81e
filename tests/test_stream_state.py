"""Stateful streams against their batch counterparts, over several batches."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkwarden.plans import incremental as inc
from sparkwarden.streaming import jobs, state

ASSETS = "account_id string, asset_id long, repo string, seen_at string"


@pytest.fixture
def arriving(spark, tmp_path):
    """Writes rows as one more file; a stream over the folder takes one file a batch, in order."""
    folder = str(tmp_path / "in")

    def add(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def stream(schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    add.stream = stream
    return add


def test_seen_set_equals_the_batch_upsert(spark, arriving, tmp_path):
    """Two batches, a restart between them: new times, first repositories kept, keys never listed kept."""
    before = spark.createDataFrame([("a", 1, "a/old", "t0"), ("b", 9, "b/never", "t0")], ASSETS)
    first = [("a", 1, "a/new", "t1"), ("a", 2, "a/z", "t1"), ("a", 2, "a/b", "t1"), ("c", 1, None, "t1")]
    second = [("a", 2, "a/a", "t2"), ("c", 1, "c/x", "t2"), ("d", 5, "d/x", "t2"), ("d", 5, "d/x", "t2")]
    keys, expected, out = ["account_id", "asset_id"], before, None
    for n, rows in enumerate((first, second)):
        arriving(rows, ASSETS)
        listed = arriving.stream(ASSETS)
        updates = state.mark_seen(listed, keys, ["repo"], ["seen_at"], before)
        out = jobs.write_batches(updates, "seen", lambda batch: batch, "update", str(tmp_path / "out"))
        new = spark.createDataFrame(rows, ASSETS)
        new = new.groupBy(*keys).agg(F.min("repo").alias("repo"), F.max("seen_at").alias("seen_at"))
        expected = spark.createDataFrame(inc.upsert(expected, new, keys, keep_old=("repo",)).select(*expected.columns).collect(), ASSETS)
    table = state.seen_table(out, keys, before)
    got = sorted(map(tuple, table.select("account_id", "asset_id", "repo", "seen_at").collect()))
    want = sorted(map(tuple, expected.select("account_id", "asset_id", "repo", "seen_at").collect()))
    assert got == want and len(got) == 5
    assert {(r.account_id, r.asset_id) for r in out.where("is_new").collect()} == {("a", 2), ("c", 1), ("d", 5)}


def test_first_findings_equal_the_batch_order(spark, arriving, tmp_path):
    """Rows of a key arrive out of order and over batches; what the watermark has passed equals the batch result."""
    schema = "repo string, rule string, ord long, evidence string, at timestamp"
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def row(repo, rule, ord_, hours):
        return repo, rule, ord_, f"{repo}-{rule}-{ord_}", start + timedelta(hours=hours)

    first = [row("r1", "x", 5, 0), row("r1", "x", 3, 1), row("r2", "x", 1, 2), row("r1", "y", None, 3)]
    second = [row("r1", "x", 1, 4), row("r2", "x", 7, 2), row("r1", "y", 2, 5), row("r3", "z", 4, 6)]
    last = [row("end", "end", 0, 200)]
    for rows in (first, second, last):
        arriving(rows, schema)
    out = state.first_findings(arriving.stream(schema), ["repo", "rule"], ["ord"], "at", "1 hour", 24 * 3_600_000)
    got = jobs.append_to_table(out, "first", str(tmp_path / "out"))
    assert sorted((r.repo, r.rule, r.evidence) for r in got.collect()) == [
        ("r1", "x", "r1-x-1"), ("r1", "y", "r1-y-None"), ("r2", "x", "r2-x-1"), ("r3", "z", "r3-z-4")]


def test_ledger_totals_over_batches(spark, arriving, tmp_path):
    """Totals run on over batches; a batch that is run again, and a fold of old batches, change nothing."""
    for n in range(3):
        arriving([(f"a{k % 2}",) for k in range(4 + n)], "account_id string")
    count = lambda batch: batch.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    folder = str(tmp_path / "out")
    batches = jobs.write_batches(arriving.stream("account_id string"), "ledger", count, "append", folder)

    def totals(table):
        rows = jobs.ledger_totals(table, ["account_id"], "n", "so_far").collect()
        return sorted((r.account_id, r.batch_id, r.n, r.so_far) for r in rows)

    before = totals(batches)
    assert [(r[0], r[2], r[3]) for r in before] == [("a0", 2, 2), ("a0", 3, 5), ("a0", 3, 8), ("a1", 2, 2), ("a1", 2, 4), ("a1", 3, 7)]
    one = spark.read.parquet(f"{folder}/table/batch_id=1").collect()
    spark.createDataFrame(one, "account_id string, n long").write.mode("overwrite").parquet(f"{folder}/table/batch_id=1")
    assert totals(spark.read.parquet(f"{folder}/table")) == before
    folded = totals(jobs.fold_ledger(spark.read.parquet(f"{folder}/table"), ["account_id"], "n", 1))
    assert folded == [("a0", 1, 5, 5), ("a0", 2, 3, 8), ("a1", 1, 4, 4), ("a1", 2, 3, 7)]


def test_tables_stored_as_folders_arrive(spark, tmp_path):
    """A table may be a folder of part files or a file; tables whose names begin alike, or folders' own file names, are not mixed up."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, "other")], "doc_id long, text string").write.parquet(str(tmp_path / "part.parquet"))
    read = lambda name: jobs.append_to_table(jobs.read_stream(spark, str(tmp_path), name), name)
    assert sorted(map(tuple, read("documents").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert [tuple(r) for r in read("part").collect()] == [(9, "other")]
    count = lambda batch: batch.agg(F.count("*").alias("n"))
    stream = jobs.read_stream(spark, str(tmp_path), "documents")
    assert [tuple(r) for r in jobs.write_batches(stream, "counts", count, "append").collect()] == [(3, 0)]


def test_a_stream_without_batches_gives_no_rows(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    stream = spark.readStream.schema("account_id string").parquet(str(tmp_path / "empty"))
    count = lambda batch: batch.groupBy("account_id").agg(F.count("*").alias("n"))
    got = jobs.write_batches(stream, "none", count, "append")
    assert got.columns == ["account_id", "n", "batch_id"] and got.collect() == []
    assert jobs.ledger_totals(got, ["account_id"], "n", "so_far").collect() == []


def test_kept_keys_are_aggregated_by_spark(spark, arriving):
    """Without forgetting no Python runs per key; of rows that repeat a key in the seen table one stands, and null keys meet."""
    arriving([(None, 1, "x/new", "t1"), ("a", 1, "a/new", "t1"), ("b", 2, "b/b", "t1"), ("b", 2, "b/a", None)], ASSETS)
    before = spark.createDataFrame([(None, 1, "x/old", "t0"), ("a", 1, "a/old", "t0"), ("a", 1, "a/old", "t0")], ASSETS)
    listed, keys = arriving.stream(ASSETS), ["account_id", "asset_id"]
    updates = state.mark_seen(listed, keys, ["repo"], ["seen_at"], before)
    assert "TransformWithState" not in updates._jdf.queryExecution().logical().toString()
    assert "TransformWithState" in state.mark_seen(listed, keys, ["repo"], ["seen_at"], before, 1000)._jdf.queryExecution().logical().toString()
    got = jobs.write_batches(updates, "seen", lambda batch: batch, "update").drop("batch_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 1, "x/old", "t1", False), ("a", 1, "a/old", "t1", False), ("b", 2, "b/a", "t1", True)], key=repr)
