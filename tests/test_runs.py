"""Whole runs on the smallest tables: state moves on, a second run finds nothing new."""

from dataclasses import replace

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sparkwarden.catalog import queries as Q
from sparkwarden.plans import incremental as inc
from sparkwarden.plans import report as rep
from sparkwarden.plans import run as runs
from sparkwarden.plans import scan as sc


def test_runs(spark, tmp_path):
    folder = str(tmp_path)
    tables = replace(Q.scan_tables(spark, SMALL), accounts=Q.accounts(spark, SMALL))
    early = replace(tables, commits=tables.commits.where("date <= '1997-01-01'"))
    first = runs.run_scan(spark, early, folder, "t0", "2024-01-01T00:00:00Z")
    second = runs.run_scan(spark, tables, folder, "t1", "2024-01-02T00:00:00Z")
    third = runs.run_scan(spark, tables, folder, "t2", "2024-01-03T00:00:00Z")
    whole = Q.findings(spark, SMALL)
    stored = runs.read_findings(spark, folder, whole.schema)

    assert first.commits + second.commits == sc.selected_commits(Q.scan_tables(spark, SMALL)).count()
    assert third.commits == 0 and first.accounts == 21
    columns = ["account", "repo", "commit", "file", "line", "rule", "redacted_evidence"]
    assert sorted(map(repr, stored.select(columns).collect())) == sorted(map(repr, whole.select(columns).collect()))

    ledger = runs.read_runs(spark, folder)
    last = ledger.groupBy("finished_at").agg(F.max("findings_count").alias("n")).orderBy("finished_at").collect()
    assert sum(r.n for r in last) == whole.count() and last[2].n == 0
    summary = runs.last_summary(spark, folder).first()
    assert summary.name == "audit-report-2024-01-03T00-00-00Z.md"
    assert summary.summary.startswith("## Summary") and summary.summary.endswith("No findings. All clear.")
    assert "- Findings: 0" in summary.summary
    assert ledger.select("run_id").distinct().count() == ledger.count()

    full = runs.run_scan(spark, tables, folder, "t3", "2024-01-04T00:00:00Z", full=True)
    assert full.commits == first.commits + second.commits


def test_unknown_account_is_an_error(spark):
    with pytest.raises(ValueError, match="no accounts"):
        runs.choose_accounts(Q.accounts(spark, SMALL), "nobody")
    assert runs.choose_accounts(Q.accounts(spark, SMALL), "acct_4").count() == 1


STEPS = [
    (runs, "scan"), (rep, "write_findings"), (runs, "skipped_files"), (rep, "write_reports"), (rep, "digests"),
    (rep, "write_run_report"), (inc, "next_cursors"), (inc, "ledger_rows"),
]


def test_a_run_that_fails_anywhere_is_made_up_for(spark, tmp_path, monkeypatch):
    """Each failing run leaves a started row and nothing that counts; the next whole one gives everything."""
    folder = str(tmp_path)
    tables = replace(Q.scan_tables(spark, SMALL), accounts=Q.accounts(spark, SMALL).where("account_ord < 4"))
    for n, (module, step) in enumerate(STEPS):
        def fail(*args, **kwargs):
            raise RuntimeError(step)

        with monkeypatch.context() as patch:
            patch.setattr(module, step, fail)
            with pytest.raises(RuntimeError, match=step):
                runs.run_scan(spark, tables, folder, f"start {n}", "2024-02-01T00:00:00Z")
        assert runs.read_scanned(spark, folder).isEmpty() and runs.read_cursors(spark, folder).isEmpty()
        last = inc.last_run(runs.read_runs(spark, folder)).first()
        assert last.finished_at is None and last.started_at == f"start {n}"
        assert runs.last_summary(spark, folder).first().summary == rep.NO_SUMMARY
    info = runs.run_scan(spark, tables, folder, "at last", "2024-02-02T00:00:00Z")
    found = runs.read_findings(spark, folder, Q.findings(spark, SMALL).schema)
    accounts = [r.account_id for r in tables.accounts.where("coalesce(enabled, true)").collect()]
    assert found.count() == Q.findings(spark, SMALL).where(F.col("account").isin(accounts)).count() > 0
    assert f"- New commits scanned: {info.commits}" in runs.last_summary(spark, folder).first().summary
    report = spark.read.text(f"{folder}/reports/audit-report-2024-02-02T00-00-00Z.md")
    assert report.where("value like '### %'").count() >= found.count()


def test_late_and_undated_commits_are_scanned(spark, tmp_path):
    """Commits that arrive with old dates or none, after newer ones were scanned."""
    folder = str(tmp_path)
    tables = replace(Q.scan_tables(spark, SMALL), accounts=Q.accounts(spark, SMALL).where("account_ord < 4"))
    late = F.xxhash64("commit_sha") % 3 == 0
    runs.run_scan(spark, replace(tables, commits=tables.commits.where(~late)), folder, "t0", "2024-01-01T00:00:00Z")
    before = {r.repo: r.last_scanned_date for r in runs.read_cursors(spark, folder).collect()}
    second = runs.run_scan(spark, tables, folder, "t1", "2024-01-02T00:00:00Z")
    assert second.commits > 0
    for r in runs.read_cursors(spark, folder).collect():
        assert r.last_scanned_date >= before.get(r.repo, "")
    whole = runs.run_scan(spark, tables, str(tmp_path / "full"), "t0", "2024-01-02T00:00:00Z", full=True)
    schema = Q.findings(spark, SMALL).schema
    columns = ["account", "repo", "commit", "file", "line", "rule", "redacted_evidence"]
    both, once = (runs.read_findings(spark, f, schema).select(columns).collect() for f in (folder, str(tmp_path / "full")))
    assert sorted(map(repr, both)) == sorted(map(repr, once)) and once
    assert whole.commits == runs.read_scanned(spark, folder).count()


def test_files_too_large_are_listed(spark, tmp_path):
    from sparkwarden.model import ScanOptions

    tables = replace(Q.scan_tables(spark, SMALL), accounts=Q.accounts(spark, SMALL).where("account_ord < 4"))
    options = ScanOptions(max_file_bytes=200_000)
    runs.run_scan(spark, tables, str(tmp_path), "t0", "2024-01-01T00:00:00Z", options)
    skipped = spark.read.parquet(f"{tmp_path}/skipped")
    read = sc.planned_files(replace(tables, accounts=runs.choose_accounts(tables.accounts)), options)
    every = sc.planned_files(replace(tables, accounts=runs.choose_accounts(tables.accounts)), ScanOptions(max_file_bytes=1 << 60))
    assert skipped.count() == every.count() - read.count() > 0 and skipped.where("size <= 200000").count() == 0
