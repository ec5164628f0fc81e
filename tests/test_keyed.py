"""Claimed numbers, keyed tables with filters, and runs that overlap."""

import threading
from dataclasses import replace

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sparkwarden.catalog import queries as Q
from sparkwarden.operators.skew import hot_in, key_sketches, salted_join
from sparkwarden.plans import claims
from sparkwarden.plans import run as runs
from sparkwarden.plans import scan as sc
from sparkwarden.plans.keyed import KeyTable

KEYS = "account string, sha string, n long"


def rows(spark, begin, end, step=1):
    k = F.col("id")
    return spark.range(begin, end, step, 2).select(
        F.concat(F.lit("a"), (k % 3).cast("string")).alias("account"), F.md5(k.cast("string")).alias("sha"), k.alias("n")
    )


def files_read(df):
    return {f.split("/rows/")[1].rsplit("/", 1)[0] for f in df.inputFiles() if "/rows/" in f}


def test_claims_are_granted_once(spark, tmp_path):
    got, folder = [], str(tmp_path)

    def take():
        for _ in range(15):
            got.append(claims.claim(spark, folder))

    threads = [threading.Thread(target=take) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 61))


def test_commit_files_appear_whole(spark, tmp_path):
    folder = str(tmp_path)
    assert claims.committed(spark, folder) == []
    claims.commit(spark, folder, 7, report="é.md")
    claims.commit(spark, folder, 3)
    assert claims.committed(spark, folder) == [3, 7]
    assert claims.commit_of(spark, folder, 7) == {"report": "é.md"} and claims.commit_of(spark, folder, 3) == {}


def test_unseen_reads_only_buckets_that_may_hit(spark, tmp_path):
    table = KeyTable(spark, str(tmp_path), KEYS, ["account", "sha"], rows_per_bucket=100)
    table.append(rows(spark, 0, 6000), 1)
    table.append(rows(spark, 6000, 6400), 2)
    table.append(rows(spark, 8000, 9000), 3)
    counted = [1, 2]
    sizes = {s.name: s.buckets for s in table.sources(counted)}
    assert sizes == {"0000000001": 64, "0000000002": 4}

    few = rows(spark, 5998, 6002).unionByName(rows(spark, 8000, 8003))
    found = table.unseen(few, counted)
    assert sorted(r.n for r in found.collect()) == [8000, 8001, 8002]
    read = files_read(found)
    assert 0 < len([f for f in read if f.startswith("v=0000000001")]) <= 4 and not any("0000000003" in f for f in read)

    none = rows(spark, 100_000, 100_020)
    hits = table.hit_buckets(none, counted)
    assert sum(map(len, hits.values())) <= 4  # a filter errs for about one key in a hundred
    assert table.unseen(none, counted).count() == 20
    everything = rows(spark, 0, 9000)
    assert table.unseen(everything, [1, 2, 3]).count() == 1600
    assert table.unseen(everything, []).count() == 9000


def test_compaction_changes_nothing_but_what_is_read(spark, tmp_path):
    schema = "account string, sha string, at string, first string"
    table = KeyTable(spark, str(tmp_path), schema, ["account", "sha"], ["at"], ["first"], rows_per_bucket=200)

    def version(v, begin, end):
        return rows(spark, begin, end).select("account", "sha", F.lit(f"t{v}").alias("at"), F.lit(f"f{v}").alias("first"))

    for v, (a, b) in {1: (0, 500), 2: (400, 900), 3: (100, 150), 5: (880, 1000)}.items():
        table.append(version(v, a, b), v)
    counted = [1, 2, 3, 5]
    before = sorted(map(tuple, table.read(counted).collect()))
    assert len(before) == 1000
    by_sha = {r[1]: r[2:] for r in before}
    sha = {r.n: r.sha for r in rows(spark, 0, 1000).collect()}
    assert by_sha[sha[450]] == ("t2", "f1") and by_sha[sha[120]] == ("t3", "f1") and by_sha[sha[950]] == ("t5", "f5")

    name = table.compact(counted)
    assert [s.name for s in table.sources(counted)] == [name]
    assert sorted(map(tuple, table.read(counted).collect())) == before
    # A slower run that commits an earlier number later is neither lost nor hidden by the base.
    table.append(version(4, 990, 1100), 4)
    assert [s.name for s in table.sources([*counted, 4])] == [name, "0000000004"]
    assert table.read([*counted, 4]).count() == 1100
    # A reader that does not count a version must not see it in a base.
    assert table.read([1, 2]).count() == 900
    looked = table.lookup(rows(spark, 985, 1003), [*counted, 4])
    assert looked.count() == 18 and looked.where("at = 't5'").count() == 15
    assert {r.first for r in looked.where("at = 't5'").collect()} == {"f5", "f4"}  # t4 < t5: the first value is version 4's
    assert table.compact([*counted, 4]) and table.read([*counted, 4]).count() == 1100


def test_odd_keys(spark, tmp_path):
    """Empty versions, null parts of keys, rows given twice."""
    table = KeyTable(spark, str(tmp_path), KEYS, ["account", "sha"], ["n"])
    assert table.read([1]).count() == 0 and table.unseen(rows(spark, 0, 3), [1]).count() == 3
    table.append(rows(spark, 0, 0), 1)
    twice = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "", 2)], KEYS)
    table.append(twice, 2)
    table.append(twice, 2)
    assert sorted(map(tuple, table.read([1, 2]).collect())) == [("a", "", 2), ("a", "x", 1)]
    asked = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "x")], "account string, sha string")
    assert sorted(r.account or "" for r in table.unseen(asked, [1, 2]).collect()) == ["", "b"]


def test_two_runs_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    """A second run starts, scans other accounts and commits while the first is under way."""
    folder = str(tmp_path)
    every = Q.accounts(spark, SMALL).where("account_ord < 6")
    tables = replace(Q.scan_tables(spark, SMALL), accounts=every)
    other = replace(tables, accounts=every.where("account_ord < 2"))
    inner, plain = [], runs.scan

    def scan(*args, **kwargs):
        if not inner:
            inner.append(None)
            inner[0] = runs.run_scan(spark, other, folder, "inner", "2024-03-01T00:00:00Z")
        return plain(*args, **kwargs)

    monkeypatch.setattr(runs, "scan", scan)
    outer = runs.run_scan(spark, tables, folder, "outer", "2024-03-02T00:00:00Z")
    assert claims.committed(spark, folder) == [1, 2] and inner[0].commits < outer.commits
    ledger = runs.read_runs(spark, folder)
    assert ledger.where("finished_at is not null").count() == ledger.count() == ledger.select("run_id").distinct().count()
    assert {r.started_at for r in ledger.select("started_at").distinct().collect()} == {"inner", "outer"}
    assert runs.read_scanned(spark, folder).count() == outer.commits
    found = runs.read_findings(spark, folder, Q.findings(spark, SMALL).schema)
    per_run = {r.run: r.n for r in found.groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert set(per_run) == {1, 2} and per_run[1] > per_run[2] > 0
    cursors = runs.read_cursors(spark, folder)
    assert cursors.count() == cursors.select("account_id", "repo").distinct().count() > 0
    assert {r.last_scanned_at for r in cursors.collect()} == {"2024-03-02T00:00:00Z"}
    again = runs.run_scan(spark, tables, folder, "third", "2024-03-03T00:00:00Z")
    assert again.commits == 0
    state = sorted(map(tuple, runs.read_cursors(spark, folder).collect()))
    runs.compact_state(spark, folder, least=2)
    assert sorted(map(tuple, runs.read_cursors(spark, folder).collect())) == state
    assert len(runs.scanned_table(spark, folder).sources(claims.committed(spark, folder))) == 1


def test_stored_sketches_of_versions(spark):
    """Sketches of two versions, united, tell the hot keys of both; a join with them counts nothing."""
    left = spark.range(4000).select(F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    more = spark.range(900).select(F.lit(7).cast("long").alias("k"), (F.col("id") + 5000).alias("v"))
    stored = key_sketches(left, ["k"]).unionByName(key_sketches(more, ["k"]))
    both = left.unionByName(more)
    assert {n: s for _, n, s in hot_in(stored, 500)} == {1000: 2, 901: 2}
    right = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    boom = spark.createDataFrame([], "k long, v long").select("k", "v", F.raise_error(F.lit("counted")).alias("z"))
    joined = salted_join(both, right, ["k"], ["v"], 500, counted=boom, sketches=stored)
    assert "salt" in joined._jdf.queryExecution().toString()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, both.join(right, "k").collect()))


def test_a_scan_with_stored_sketches_does_not_count_the_tree(spark, monkeypatch):
    tables = replace(Q.scan_tables(spark, SMALL), accounts=Q.accounts(spark, SMALL).where("account_id = 'acct_4'"))
    kept = replace(tables, tree_sketches=key_sketches(tables.tree, ["commit_sha"]))
    plain = sorted(map(tuple, sc.planned_files(tables).collect()))
    counted = []
    from sparkwarden.operators import skew

    sketch = skew.key_sketches
    monkeypatch.setattr(skew, "key_sketches", lambda df, keys: counted.append(tuple(keys)) or sketch(df, keys))
    assert sorted(map(tuple, sc.planned_files(kept).collect())) == plain
    assert ("commit_sha",) not in counted


@pytest.mark.parametrize("scheme", ["file:", ""])
def test_paths_with_and_without_a_scheme(spark, tmp_path, scheme):
    assert claims.create(spark, f"{scheme}{tmp_path}/x y/é") and not claims.create(spark, f"{scheme}{tmp_path}/x y/é")
