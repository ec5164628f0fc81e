"""The streaming jobs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.inputs import load
from ..operators.lines import line_findings
from ..operators.rules import LINE_RULES, PII_RULES
from . import jobs, state


def _found(spark: SparkSession, folder: str, keys: list[str], rules) -> DataFrame:
    files = load(spark, folder, "doc_files", jobs.read_stream)
    timed = files.withColumn("seen_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 600))
    return line_findings(timed.select(*keys, "text"), keys, rules)


def scanned_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = _found(spark, folder, ["doc_id", "path"], LINE_RULES)
    columns = ["doc_id", "path", "line", "rule", "severity", "redacted_evidence"]
    return jobs.append_to_table(found.select(*columns), "stream-findings")


def unique_event_findings(spark: SparkSession, folder: str) -> DataFrame:
    jobs.keep_state_on_disk(spark)
    found = _found(spark, folder, ["repo", "path"], PII_RULES)
    unique = jobs.unique_findings(found)
    return jobs.append_to_table(unique.select("repo", "path", "rule", "line0"), "stream-unique")


def windowed_severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    jobs.keep_state_on_disk(spark)
    found = _found(spark, folder, ["doc_id", "seen_at"], LINE_RULES)
    counts = jobs.severity_counts(found, "seen_at", "1 hour", "1 day")
    batches = jobs.write_batches(counts, "stream-counts", lambda batch: batch, "update")
    latest = jobs.latest_counts(batches, ["window_start", "severity"])
    day = F.date_from_unix_date((F.unix_seconds("window_start") / 86_400).cast("int"))
    return latest.select(day.cast("string").alias("window_start"), "severity", "n")


def unseen_gists(spark: SparkSession, folder: str) -> DataFrame:
    jobs.keep_state_on_disk(spark)
    listed = load(spark, folder, "gists", jobs.read_stream)
    return jobs.append_to_table(jobs.first_seen(listed, ["account_id", "gist_id"]), "stream-gists")


def run_ledger(spark: SparkSession, folder: str) -> DataFrame:
    found = _found(spark, folder, ["doc_id"], LINE_RULES)
    count = lambda batch: batch.agg(F.count(F.lit(1)).alias("findings_count"))
    batches = jobs.write_batches(found.select("doc_id"), "stream-ledger", count, "append")
    return batches.select("batch_id", "findings_count")


def ledger_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of each batch per account and their running totals over the batches."""
    found = _found(spark, folder, ["account_id"], LINE_RULES)
    count = lambda batch: batch.groupBy("account_id").agg(F.count(F.lit(1)).alias("findings_count"))
    batches = jobs.write_batches(found.select("account_id"), "stream-ledger", count, "append")
    return jobs.ledger_totals(batches, ["account_id"], "findings_count", "findings_so_far")


def assets_marked_seen(spark: SparkSession, folder: str) -> DataFrame:
    """The seen set of assets after a stream of listings: met assets get a new time and keep their first repository."""
    keys, seen = ["account_id", "asset_id"], load(spark, folder, "seen_assets")
    listed = load(spark, folder, "assets", jobs.read_stream).withColumn("seen_at", F.lit("2024-06-01T06:00:00Z"))
    updates = state.mark_seen(listed, keys, ["repo"], ["seen_at"], seen)
    return state.seen_table(jobs.write_batches(updates, "stream-assets", lambda batch: batch, "update"), keys, seen)


def first_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The first finding of each repository, file, rule and line by document, once its day and an hour have passed."""
    found = _found(spark, folder, ["doc_id", "repo", "path", "seen_at"], PII_RULES)
    rows = found.select("repo", "path", "rule", "line", "doc_id", "match_ord", "redacted_evidence", "seen_at")
    keys = ["repo", "path", "rule", "line"]
    first = state.first_findings(rows, keys, ["doc_id", "match_ord"], "seen_at", "1 hour", 86_400_000)
    return jobs.append_to_table(first, "stream-first").select("doc_id", *keys, "redacted_evidence")
