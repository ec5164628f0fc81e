"""Scan, state, reports and streams: properties on the small tables and hand-made rows."""

import re
from dataclasses import replace

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sparkwarden.catalog import queries as Q
from sparkwarden.catalog.inputs import load
from sparkwarden.model import FINDINGS_SCHEMA, FINDING_COLUMNS, ORDER_COLUMNS, ScanOptions
from sparkwarden.operators import names
from sparkwarden.operators.lines import line_findings
from sparkwarden.operators.logs import log_findings
from sparkwarden.operators.rules import LINE_RULES
from sparkwarden.operators.skew import first_per_key, hot_keys, running_totals, salted_join
from sparkwarden.plans import incremental as inc
from sparkwarden.plans import report as rep
from sparkwarden.plans import scan as sc
from sparkwarden.sources import files as src
from sparkwarden.sources import records as rec
from sparkwarden.streaming import jobs


def bag(df, *columns):
    return sorted(map(repr, df.select(*(columns or df.columns)).collect()))


# ---------------------------------------------------------------- skew
def test_salted_join_equals_plain_join(spark):
    left = spark.range(6_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    right = spark.range(50).select(F.col("id").alias("k"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("w"))
    hot = hot_keys(left, ["k"], 500)
    assert len(hot) == 1 and hot[0][2] >= 4
    salted = salted_join(left, right, ["k"], ["v"], rows_per_salt=500)
    assert bag(salted, "k", "v", "w") == bag(left.join(right, "k"), "k", "v", "w")


def test_cold_keys_join_without_salt(spark):
    left = spark.range(100).select((F.col("id") % 50).alias("k"), "id")
    assert hot_keys(left, ["k"], 500) == []
    assert hot_keys(left.where("id < 0"), ["k"], 500) == []


def test_more_hot_keys_than_a_few_hundred(spark):
    left = spark.range(9_000).selectExpr("id % 900 as k", "id as v")
    right = spark.range(900).selectExpr("id as k", "id * 2 as w")
    assert len(hot_keys(left, ["k"], 5)) == 900
    salted = salted_join(left, right, ["k"], ["v"], rows_per_salt=5)
    assert bag(salted, "k", "v", "w") == bag(left.join(right, "k"), "k", "v", "w")


def test_salts_copy_no_more_rows_than_the_left_side_has(spark):
    left = spark.range(100).selectExpr("1 as k", "id as v")
    right = spark.range(60).selectExpr("1 as k", "id as w")
    salted = salted_join(left, right, ["k"], ["v"], rows_per_salt=2)
    assert bag(salted, "k", "v", "w") == bag(left.join(right, "k"), "k", "v", "w")


def test_running_totals_equal_one_window(spark):
    df = spark.range(1_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("p"), (F.col("id") % 7).alias("n"))
    ours = running_totals(df, ["g"], "p", {"n": "total"}, block=6)  # four levels of blocks
    plain = df.withColumn("total", F.sum("n").over(W.partitionBy("g").orderBy("p")))
    assert bag(ours, "g", "p", "total") == bag(plain, "g", "p", "total")


def test_first_per_key_equals_row_number(spark):
    df = spark.range(2_000).select((F.col("id") % 13).alias("k"), F.xxhash64("id").alias("o"), F.col("id").alias("v"))
    w = W.partitionBy("k").orderBy("o")
    plain = df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    assert bag(first_per_key(df, [F.col("k")], ["o"])) == bag(plain)


# ---------------------------------------------------------------- the scan
@pytest.fixture(scope="module")
def tables(spark):
    return Q.scan_tables(spark, SMALL)


@pytest.fixture(scope="module")
def findings(spark):
    return Q.findings(spark, SMALL)


def test_scan_equals_file_by_file(spark, tables, findings):
    """Every file scanned on its own, without blob reuse, one detector after the other."""
    files = sc.planned_files(tables)
    texts = files.where("route = 'text'").join(tables.blobs, "blob_sha")
    key = ["account_id", "repo", "commit_sha", "path", "blob_sha"]
    parts = [line_findings(texts, key, LINE_RULES), log_findings(texts, key),
             names.suspicious_names(texts.select(*key), key), names.risk_names(texts.select(*key), key)]
    naive = parts[0]
    for p in parts[1:]:
        naive = naive.unionByName(p, allowMissingColumns=True)
    ours = findings.where("rule <> 'custom-keyword' and metadata is null and scanner_ord + rule_ord >= 0").where(
        ~F.col("rule").isin("device-serial", "owner-name", "camera-model", "software-metadata"))
    left = ours.select("account", "repo", "commit", "file", "line", "rule", "severity", "redacted_evidence")
    right = naive.select("account_id", "repo", "commit_sha", "path", "line", "rule", "severity", "redacted_evidence")
    assert bag(left.toDF(*right.columns)) == bag(right) and left.count() > 0


def test_salted_scan_equals_plain_scan(tables, findings):
    assert bag(sc.scan(tables, rows_per_salt=20), *FINDING_COLUMNS) == bag(findings, *FINDING_COLUMNS)


def test_findings_schema(findings):
    got = findings.select(*FINDING_COLUMNS).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in FINDINGS_SCHEMA]


def test_scan_options(tables):
    plain = sc.planned_files(tables).count()
    wide = ScanOptions(include_forks=True, include_archived=True)
    assert sc.planned_files(tables, wide).count() > plain
    assert sc.planned_files(tables, ScanOptions(max_file_bytes=100_000)).count() < plain
    strict = sc.planned_files(tables, ScanOptions(strict_extensions=True))
    assert strict.where("path = 'keys/id_rsa'").count() == 0


def test_size_filter_reads_no_content(tables):
    plan = sc.planned_files(tables)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


# ---------------------------------------------------------------- records
def test_account_validation(spark):
    schema = "account_id string, user string, enabled boolean, account_ord int"
    ok = spark.createDataFrame([("a", "u", None, 0), ("b", "v", False, 1)], schema)
    assert [r.enabled for r in rec.normalize_accounts(ok).collect()] == [True, False]
    bad = spark.createDataFrame([("a", "", True, 0)], schema)
    with pytest.raises(Exception, match="Invalid account"):
        rec.normalize_accounts(bad).collect()


def test_decode_content(spark):
    rows = [("plain", None, "text"), ("b64", "base64", "aGVsbG8="), ("lines", "base64", "aGVs\nbG8=\n"),
            ("bad-bytes", "base64", "/w=="), ("url", "base64", "_w"), ("odd", "base64", "aGVsb"),
            ("empty", "base64", ""), ("none", "none", "x"), ("null", None, None)]
    df = spark.createDataFrame(rows, "id string, encoding string, content string")
    got = {r.id: r.text for r in rec.decode_content(df).collect()}
    assert got == {"plain": "text", "b64": "hello", "lines": "hello", "bad-bytes": "�", "url": "�", "odd": "hel"}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"mail me@mail.org\n\xff")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    got = src.read_text_files(spark, str(tmp_path), max_file_bytes=50).collect()
    assert [(r.path.rsplit("/")[-1], r.size, r.text) for r in got] == [("a.txt", 18, "mail me@mail.org\n�")]


# ---------------------------------------------------------------- state
def test_two_incremental_runs_equal_one_full_run(spark):
    commits = load(spark, SMALL, "commits").select("account_id", "repo", "commit_sha", "date")
    nothing = spark.createDataFrame(
        [], "account_id string, repo string, last_scanned_sha string, last_scanned_date string, last_scanned_at string")
    unscanned = spark.createDataFrame([], "account_id string, repo string, commit_sha string")
    early = commits.where("date <= '1997-01-01' and hash(commit_sha) % 5 <> 0")  # the others arrive late
    first = inc.new_commits(early, unscanned)
    cursors = inc.upsert(nothing, inc.next_cursors(first, nothing, "t1"), ["account_id", "repo"])
    second = inc.new_commits(commits, first)
    assert bag(first.unionByName(second)) == bag(inc.new_commits(commits, unscanned, full=True))
    assert second.where("date = '' or date < '1996-01-01'").count() > 0
    after = inc.upsert(cursors, inc.next_cursors(second, cursors, "t2"), ["account_id", "repo"])
    once = inc.next_cursors(commits, nothing, "t2")
    assert bag(after.select("account_id", "repo", "last_scanned_sha")) == bag(once.select("account_id", "repo", "last_scanned_sha"))
    assert inc.new_commits(commits, first.unionByName(second)).count() == 0


def test_seen_sets(spark):
    seen = spark.createDataFrame([("a", "old", 1, "t0")], "account_id string, repo string, asset_id long, seen_at string")
    listed = spark.createDataFrame([("a", "new", 1), ("a", "new", 2)], "account_id string, repo string, asset_id long")
    keys = ["account_id", "asset_id"]
    assert [r.asset_id for r in inc.unseen(listed, seen, keys).collect()] == [2]
    marked = inc.mark_assets_seen(seen, listed, "t1")
    assert bag(marked, "asset_id", "repo", "seen_at") == bag(spark.createDataFrame(
        [(1, "old", "t1"), (2, "new", "t1")], "asset_id long, repo string, seen_at string"))
    assert inc.unseen(listed, marked, keys).count() == 0


def test_upsert_keeps_null_of_new_row(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(1, None), (3, "z")], "k int, v string")
    assert bag(inc.upsert(old, new, ["k"])) == bag(spark.createDataFrame([(1, None), (2, "y"), (3, "z")], "k int, v string"))


def test_runs(spark):
    runs = spark.createDataFrame([(1, "a"), (2, None)], "run_id long, finished_at string")
    assert inc.last_run(runs).first().run_id == 2 and inc.last_finished_run(runs).first().run_id == 1


def test_versions(spark, tmp_path):
    df = spark.range(3)
    path = inc.write_version(df, str(tmp_path), 7)
    assert path.endswith("v=0000000007") and spark.read.parquet(path).count() == 3


# ---------------------------------------------------------------- reports
RUN = rep.RunInfo("2024-01-01T00:05:00.000Z", 1, 3, 5)
ROW = dict(account="M", repo="owner/repo", file="config/.env", line=1, commit="abc1234def", rule="env-file",
           severity="high", redacted_evidence="Sensitive file: .env", metadata=None, suggested_action="Remove it.",
           account_ord=0, repo_ord=0, commit_ord=0, scanner_ord=3, line_ord=1, rule_ord=0, match_ord=0)


def make(spark, *changes):
    order = T.StructType([T.StructField(c, T.IntegerType()) for c in ROW if c.endswith("_ord")])
    schema = T.StructType(FINDINGS_SCHEMA.fields + order.fields)
    return spark.createDataFrame([tuple({**ROW, **c}.values()) for c in changes], schema)


def read_report(df):
    return "\n".join(r.text for r in df.orderBy(*rep.REPORT_ORDER).collect())


def test_report_text(spark):
    text = read_report(rep.account_reports(make(spark, {}), RUN))
    for part in ("# Privacy Report", "## Summary", "- Accounts scanned: 1", "- Repositories scanned: 3",
                 "- New commits scanned: 5", "- Findings: 1", "  - High: 1", "## Findings", "### HIGH: env-file\n",
                 "- Account: M", "- Repo: owner/repo", "- File: config/.env", "- Line: 1", "- Commit: abc1234def",
                 "## Repo: owner/repo", "### HIGH: env-file in config/.env (line 1)", "- Commit to check: abc1234\n"):
        assert part in text
    assert "- Metadata:" not in text
    assert text.index("## Summary") < text.index("## Agent Instructions") < text.index("## Findings")


def test_report_of_nothing(spark):
    none = make(spark, {}).where("false")
    whole = rep.summaries(none, RUN).where("account is null").first().text
    assert "- Findings: 0" in whole and "No findings. All clear." in whole


def test_block_without_line_and_with_metadata(spark):
    df = make(spark, {"line": None, "commit": None, "metadata": {"a": "1", "b": "2"}})
    block = df.select(rep.finding_block().alias("b"), rep.fix_block().alias("f")).first()
    assert "- Line" not in block.b and "- Commit" not in block.b and "- Metadata: a=1, b=2" in block.b
    assert "(line" not in block.f and "- Commit to check: N/A" in block.f


def test_order_and_first_occurrence(spark):
    df = make(spark, {"commit_ord": 2, "commit": "old"}, {"severity": "low", "rule": "photo-file"},
              {"commit_ord": 1, "commit": "new"}, {"severity": "critical", "rule": "pem-file", "repo_ord": 9})
    assert [r.severity for r in rep.sorted_findings(df).collect()] == ["critical", "high", "high", "low"]
    unique = rep.unique_findings(df).collect()
    assert len(unique) == 3 and [r.commit for r in unique if r.rule == "env-file"] == ["new"]
    assert {r.severity: r.n for r in rep.severity_counts(df).collect()} == {
        "critical": 1, "high": 2, "medium": 0, "low": 1}


def test_written_report_reads_in_order(spark, findings, tmp_path):
    rows = rep.account_reports(findings, RUN)
    rep.write_reports(rows, str(tmp_path / "reports"))
    account = rows.first().account
    folder = tmp_path / "reports" / f"account={account}"
    written = "".join(p.read_text() for p in sorted(folder.glob("*.txt")))
    assert written == read_report(rows.where(F.col("account") == account)) + "\n"


def test_findings_sink(spark, findings, tmp_path):
    path = rep.write_findings(findings, str(tmp_path), 3)
    assert spark.read.parquet(path).count() == findings.count()


def test_summary_of(spark):
    texts = ["x\n## Summary\n- a: 1\n\n## Findings\n- b", "## Summary\n- a: 1\n\nNo findings. All clear.\n", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(rep.summary_of(F.col("t")))
    assert [r[0] for r in df.collect()] == [
        "## Summary\n- a: 1", "## Summary\n- a: 1\n\nNo findings. All clear.", rep.NO_SUMMARY]
    assert rep.report_name(RUN.finished_at) == "audit-report-2024-01-01T00-05-00-000Z.md"


def test_digests(spark):
    accounts = spark.createDataFrame(
        [("M", "m@mail.org", "REPLACE_CC"), ("N", "REPLACE_X", None), ("O", "o@mail.org", None)],
        "account_id string, contact_email string, cc_email string")
    found = make(spark, {}, {"account": "N"})
    messages = rep.digests(accounts, found, RUN)
    assert {(r.to, r.cc, r.subject) for r in messages.collect()} == {
        ("m@mail.org", None, "Privacy Report for M — 1 finding — 2024-01-01")}
    # the text of the message is the whole report of the account
    text = "\n".join(r.text for r in messages.orderBy(*rep.RUN_ORDER).collect())
    assert text == read_report(rep.account_reports(found, RUN).where("account = 'M'"))
    assert "### HIGH: env-file" in text and "## Findings" in text


def test_run_report(spark):
    read = lambda found: "\n".join(r.text for r in rep.run_report(found, RUN).orderBy(*rep.RUN_ORDER).collect())
    text = read(make(spark, {}, {"account": "N", "severity": "critical"}))
    assert text.startswith("# Privacy Report") and "- Findings: 2" in text
    findings = text[text.index("## Findings"):]
    assert findings.index("### CRITICAL") < findings.index("### HIGH")
    clear = read(make(spark, {}).limit(0))
    assert clear.endswith("No findings. All clear.\n") and "## Findings" not in clear


def test_no_exchange_carries_texts(spark):
    """With blobs bucketed by their key neither a full scan nor an incremental one shuffles texts."""
    tables = Q.scan_tables(spark, SMALL)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blobs = src.write_blobs(tables.blobs, "texts_for_plan", 4)
        for restricted in (False, True):
            found = sc.scan(replace(tables, blobs=blobs), restricted=restricted)
            plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
            moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
            assert moved and not any(re.search(r"\btext#", columns) for columns in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("drop table if exists texts_for_plan")


# ---------------------------------------------------------------- streams
def test_stream_restarts_where_it_stopped(spark, tmp_path):
    docs = load(spark, SMALL, "documents").repartition(4)
    source = str(tmp_path / "in")
    docs.where("doc_id < 100").write.parquet(source)
    run = lambda: jobs.append_to_table(
        line_findings(spark.readStream.schema(docs.schema).parquet(source), ["doc_id"], LINE_RULES), "t",
        str(tmp_path / "out"))
    first = run().count()
    docs.where("doc_id >= 100").write.mode("append").parquet(source)
    both = run()
    batch = line_findings(docs, ["doc_id"], LINE_RULES)
    assert first < both.count() and bag(both) == bag(batch)
    assert run().count() == batch.count()


def test_order_columns_cover_findings(findings):
    assert set(ORDER_COLUMNS) <= set(findings.columns)


def test_salted_left_join_keeps_unmatched_rows(spark):
    left = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(1_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    salted = salted_join(left, right, ["k"], ["id"], rows_per_salt=200, how="left")
    assert bag(salted, "k", "id", "w") == bag(left.join(right, "k", "left"), "k", "id", "w")


def test_hot_keys_meet_a_few_rows_where_they_are(spark):
    """A right side of a few rows is broadcast, though the plan can't know that it is small; a larger one is salted."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
        right = spark.range(1_000).groupBy(F.col("id").alias("k")).agg(F.max("id").alias("w"))
        for how in ("inner", "left"):
            few, many = (salted_join(left, right, ["k"], ["id"], 200, how=how, few_rows=n) for n in (1_000, 999))
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in (few, many)]
            assert "BroadcastHashJoin [k" in plans[0] and "SortMergeJoin [k" not in plans[0] and "SortMergeJoin [k" in plans[1]
            assert bag(few, "k", "id", "w") == bag(many, "k", "id", "w") == bag(left.join(right, "k", how), "k", "id", "w")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_per_key_sends_no_column_twice(spark):
    df = spark.createDataFrame(
        [("a", 1, 5, {"x": "1"}, "p"), ("a", 1, 4, None, "q"), ("a", 2, None, {"y": "2", "z": None}, "r"), (None, 1, 0, {}, "s")],
        "repo string, line int, ord int, metadata map<string,string>, text string",
    )
    got = first_per_key(df, ["repo", F.coalesce("line", F.lit(0))], ["ord", "repo"])
    assert got.columns == df.columns
    assert bag(got) == sorted(map(repr, df.where("ord is null or ord <> 5").collect()))
    assert "min_by" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bucketed_blobs_join_without_moving_texts(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    blobs = load(spark, SMALL, "doc_files").select("blob_sha", "text")
    try:
        spark.sql(f"create database if not exists scratch location '{tmp_path}/db'")
        table = src.write_blobs(blobs, "scratch.blobs", 4)
        pairs = blobs.select("blob_sha", F.lit("the").alias("pattern")).distinct()
        plan = salted_join(pairs, table, ["blob_sha"], ["pattern"])._jdf.queryExecution().executedPlan().toString()
        right = plan[plan.rindex("Sort ["):]
        assert "Exchange" not in right and "text" in right
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop database if exists scratch cascade")
