"""Whole runs: scan what is new, keep the state, write findings, reports and messages.

A run first claims a number that no other run can get, so runs may overlap.  Its folder holds, with that number in
each name,

    claims/…                the claimed numbers
    scan_runs_started/v=…   one row per account, written before anything else
    findings/run=…          the findings
    skipped/run=…           files that were too large to read
    account_reports/run=…   report text files per account
    digests/run=…           one message per account with findings and an address, as rows of its text
    reports/….md            the report of the whole run, as text files that read on in name order
    repo_state, scanned     keyed tables (``keyed``): cursors of the run's repositories, keys of its commits
    scan_runs/v=…           ledger rows
    commits/….json          one file that makes all of these count, written last

A run that fails leaves started rows and output that no reader takes; the next run gets a new number and
scans the same commits again.  Two runs at once may both scan a commit that is new to both; neither loses anything:
each has its own outputs and ledger rows, and of two cursors the newer stands.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ScanOptions
from ..sources.files import stage
from ..sources.records import account_by_id, enabled_accounts, filter_repos
from . import claims
from . import incremental as inc
from . import report as rep
from .keyed import KeyTable
from .scan import ScanTables, scan, selected_commits, skipped_files

CURSORS = "account_id string, repo string, last_scanned_sha string, last_scanned_date string, last_scanned_at string"
SCANNED = "account_id string, repo string, commit_sha string"
RUNS = (
    "run_id long, started_at string, finished_at string, account_id string, repos_scanned long, "
    "commits_scanned long, findings_count long, account_repos long, account_commits long, account_findings long"
)
#: Ledger rows of a run are numbered from its claimed number times this, one per account.
RUN_IDS = 1_000_000_000
#: So many versions of a keyed table are compacted into one.
COMPACT_FROM = 16


def _versions(spark: SparkSession, folder: str, schema: str, numbers: list[int] | None = None) -> DataFrame:
    """The versions of a table with the given numbers, or all; only a missing folder means that there is none yet."""
    there = [n for n in claims.names(spark, folder) if n.startswith("v=")]
    if numbers is not None:
        there = sorted({f"v={n:010d}" for n in numbers} & set(there))
    if not there:
        return spark.createDataFrame([], f"{schema}, v long")
    return spark.read.option("basePath", folder).schema(f"{schema}, v long").parquet(*(f"{folder}/{n}" for n in there))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger: finished runs, and started ones that never finished."""
    finished = _versions(spark, f"{folder}/scan_runs", RUNS, claims.committed(spark, folder)).drop("v")
    started = _versions(spark, f"{folder}/scan_runs_started", RUNS).drop("v")
    return finished.unionByName(started.join(finished, "run_id", "left_anti"))


def cursor_table(spark: SparkSession, folder: str) -> KeyTable:
    """Of two rows of a repository the one with the newer commit stands, so no late run moves a cursor back."""
    return KeyTable(
        spark, f"{folder}/repo_state", CURSORS, ["account_id", "repo"], ["last_scanned_date", "last_scanned_sha", "last_scanned_at"]
    )


def scanned_table(spark: SparkSession, folder: str) -> KeyTable:
    return KeyTable(spark, f"{folder}/scanned", SCANNED, inc.SCANNED_KEY)


def read_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """The cursors as finished runs left them."""
    return cursor_table(spark, folder).read(claims.committed(spark, folder))


def read_scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of all commits that finished runs have scanned."""
    return scanned_table(spark, folder).read(claims.committed(spark, folder))


def read_findings(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Findings of all finished runs, with their run."""
    numbers = claims.committed(spark, folder)
    paths = [f"{folder}/findings/run={n:010d}" for n in numbers]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("int"))
    return spark.read.option("basePath", f"{folder}/findings").schema(schema).parquet(*paths)


def compact_state(spark: SparkSession, folder: str, least: int = COMPACT_FROM) -> None:
    """Merges the versions of the keyed tables once there are ``least`` of them."""
    counted = claims.committed(spark, folder)
    for table in (cursor_table(spark, folder), scanned_table(spark, folder)):
        if len(table.sources(counted)) >= least:
            table.compact(counted)


def choose_accounts(accounts: DataFrame, account_id: str | None = None) -> DataFrame:
    """The enabled accounts, or the named one whether enabled or not; none is an error."""
    chosen = account_by_id(accounts, account_id) if account_id else enabled_accounts(accounts)
    if chosen.isEmpty():
        raise ValueError("no accounts to scan: check the account table or the account id")
    return chosen


def run_scan(
    spark: SparkSession, tables: ScanTables, folder: str, started_at: str, finished_at: str,
    options: ScanOptions = ScanOptions(), account_id: str | None = None, full: bool = False,
) -> rep.RunInfo:
    """One run.  ``tables.commits`` needs a ``date`` column; ``accounts`` the contact columns."""
    accounts = choose_accounts(tables.accounts, account_id)
    chosen = replace(tables, accounts=accounts)
    run = claims.claim(spark, folder)
    first_id, counted = run * RUN_IDS, claims.committed(spark, folder)
    inc.write_version(inc.started_rows(accounts, first_id, started_at), f"{folder}/scan_runs_started", run)

    cursors, scanned = cursor_table(spark, folder), scanned_table(spark, folder)
    listed = stage(selected_commits(chosen, options, more_columns=("date",)), "listed")
    commits = listed if full else stage(scanned.unseen(listed, counted), "commits")
    repos = selected_repos(chosen, options)

    restricted = account_id is not None or not (full or not scanned.sources(counted))
    found = scan(chosen, options, restricted=restricted, commits=commits)
    path = rep.write_findings(found, f"{folder}/findings", run)
    findings = spark.read.schema(found.schema).parquet(path)
    skipped_files(chosen, options, commits=commits).write.mode("overwrite").parquet(f"{folder}/skipped/run={run:010d}")

    info = rep.RunInfo(finished_at, accounts.count(), repos.count(), commits.count())
    rep.write_reports(rep.account_reports(findings, info), f"{folder}/account_reports/run={run:010d}")
    rep.digests(accounts, findings, info).write.mode("overwrite").parquet(f"{folder}/digests/run={run:010d}")
    name = rep.report_name(finished_at)
    rep.write_run_report(rep.run_report(findings, info), f"{folder}/reports/{name}")

    before = cursors.lookup(commits.select("account_id", "repo"), counted)
    cursors.append(inc.next_cursors(commits, before, finished_at), run)
    scanned.append(commits.select(*inc.SCANNED_KEY).distinct(), run)
    ledger = inc.ledger_rows(
        accounts, repos, commits, findings.select(F.col("account").alias("account_id")), first_id,
        started_at, finished_at,
    )
    inc.write_version(ledger, f"{folder}/scan_runs", run)
    claims.commit(spark, folder, run, report=name, finished_at=finished_at)
    compact_state(spark, folder)
    return info


def selected_repos(t: ScanTables, options: ScanOptions = ScanOptions()) -> DataFrame:
    return filter_repos(t.repos, options).join(t.accounts.select("account_id"), "account_id")


def last_summary(spark: SparkSession, folder: str) -> DataFrame:
    """``name, summary`` of the newest report of a finished run, or a row that says there is none.

    Only the first file with text is read: it begins with the summary.
    """
    names = [claims.commit_of(spark, folder, n)["report"] for n in claims.committed(spark, folder)]
    name = rep.latest_report(spark.createDataFrame([(n,) for n in names], "name string")).first().name
    if name is None:
        return spark.range(1).select(F.lit(None).cast("string").alias("name"), F.lit(rep.NO_SUMMARY).alias("summary"))
    parts = claims.names(spark, f"{folder}/reports/{name}", empty_files=False)
    first = next(f for f in parts if f.startswith("part-"))
    text = spark.read.text(f"{folder}/reports/{name}/{first}", wholetext=True)
    return text.select(F.lit(name).alias("name"), rep.summary_of(F.col("value")).alias("summary"))
