"""Counts, ordered lists and Markdown reports from the findings table.

A report is a table of text blocks with sort columns, never one string: a single account may own a
third of all findings.  ``write_reports`` turns it into ordered text files per account.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.regex import BLANKS
from ..functions.text import severity_rank
from ..model import ORDER_COLUMNS
from ..operators.skew import FEW_ROWS, first_per_key, salted_join
from ..sources.files import stage

HEADER, FIX_LIST, FINDINGS = 0, 1, 2


@dataclass(frozen=True)
class RunInfo:
    """What a run scanned; three counters, not data."""

    finished_at: str
    accounts: int
    repos: int
    commits: int


# ---------------------------------------------------------------- counts
def _severity_columns() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES]


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row per severity, zeros included; one pass without a join."""
    counts = findings.agg(*_severity_columns())
    rows = [F.struct(F.lit(i).alias("severity_rank"), F.lit(s).alias("severity"), F.col(s).alias("n"))
            for i, s in enumerate(V.SEVERITIES)]
    return counts.select(F.inline(F.array(*rows)))


def counts_by_account(findings: DataFrame) -> DataFrame:
    """Severity counts of every account and, with a NULL account, of the whole run.

    The total is summed from the accounts' counts, and is there even without findings.
    """
    per_account = findings.groupBy("account").agg(F.count(F.lit(1)).alias("findings"), *_severity_columns())
    total = per_account.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("findings", *V.SEVERITIES)]
    )
    return per_account.unionByName(total, allowMissingColumns=True)


def findings_cube(findings: DataFrame) -> DataFrame:
    """Findings by every combination of rule, severity and account, with totals (``level`` tells which are).

    Counted once per combination; the cube adds up those counts.
    """
    counts = findings.groupBy("rule", "severity", "account").agg(F.count(F.lit(1)).alias("n"))
    return counts.cube("rule", "severity", "account").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))


def findings_by_repo(findings: DataFrame) -> DataFrame:
    """Findings per repository with the sort key of its first one.

    The large aggregate is of fixed width; only its few rows per repository are compared as structs.
    """
    counts = findings.groupBy("repo", "account_ord", "repo_ord").agg(
        F.count(F.lit(1)).alias("n"), F.min("commit_ord").alias("commit_ord")
    )
    return counts.groupBy("repo").agg(
        F.sum("n").alias("n"), F.min(F.struct("account_ord", "repo_ord", "commit_ord")).alias("first")
    ).select("repo", "n", "first.*")


def run_totals(accounts: DataFrame, repos: DataFrame, commits: DataFrame, findings: DataFrame) -> DataFrame:
    """Accounts, repositories, commits listed and findings, one row each."""
    parts = [
        table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "n")
        for metric, table in (("accounts", accounts), ("repos", repos), ("commits", commits),
                              ("findings", findings))
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


# ---------------------------------------------------------------- order and first occurrences
def sorted_findings(findings: DataFrame) -> DataFrame:
    """Most severe first, then reading order."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "severity_rank", *ORDER_COLUMNS
    )


def unique_findings(findings: DataFrame) -> DataFrame:
    """The first finding per repository, file, rule and line, across commits."""
    keys = ["repo", "file", "rule", F.coalesce("line", F.lit(0))]
    order = [c for c in ORDER_COLUMNS if c not in ("repo", "file", "line_ord")]  # the others are the same in a key
    return first_per_key(findings, keys, [*order, "redacted_evidence"])


# ---------------------------------------------------------------- text blocks
def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), value.cast("string"))


def finding_block() -> Column:
    """Markdown block of one finding; absent values leave no line."""
    metadata = F.when(
        F.size("metadata") > 0,
        F.array_join(
            F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "
        ),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.upper("severity"), F.lit(": "), "rule"),
        _line("Account", F.col("account")),
        _line("Repo", F.col("repo")),
        _line("File", F.col("file")),
        _line("Line", F.when(F.col("line") > 0, F.col("line"))),
        _line("Commit", F.when(F.col("commit") != "", F.col("commit"))),
        _line("Rule", F.col("rule")),
        _line("Redacted evidence", F.col("redacted_evidence")),
        _line("Metadata", metadata),
        _line("Suggested action", F.col("suggested_action")),
        F.lit(""),
    )


def short_sha(sha: Column) -> Column:
    return F.coalesce(F.substring(sha, 1, 7), F.lit("N/A"))


def fix_block() -> Column:
    """What to do about one finding."""
    where = F.when(F.col("line") > 0, F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.upper("severity"), F.lit(": "), "rule", F.lit(" in "), "file",
                 F.coalesce(where, F.lit(""))),
        _line("What was found", F.col("redacted_evidence")),
        _line("Action", F.col("suggested_action")),
        _line("Commit to check", short_sha(F.col("commit"))),
        F.lit(""),
    )


def summary_text(run: RunInfo, accounts: Column) -> Column:
    """Title and summary from a row of ``counts_by_account``."""
    count = lambda label, value, indent="": F.concat(
        F.lit(f"{indent}- {label}: "), value.cast("string"))
    return F.concat_ws(
        "\n",
        F.lit("# Privacy Report"),
        F.lit(f"Generated: {run.finished_at}"),
        F.lit(""),
        F.lit("## Summary"),
        count("Accounts scanned", accounts),
        count("Repositories scanned", F.lit(run.repos)),
        count("New commits scanned", F.lit(run.commits)),
        count("Findings", F.col("findings")),
        *[count(s.capitalize(), F.col(s), "  ") for s in V.SEVERITIES],
        F.lit(""),
        F.when(F.col("findings") == 0, F.lit("No findings. All clear.\n")),
    )


def summaries(findings: DataFrame, run: RunInfo) -> DataFrame:
    """Header and summary per account and, with a NULL account, of the run."""
    accounts = F.when(F.col("account").isNull(), F.lit(run.accounts)).otherwise(F.lit(1))
    return counts_by_account(findings).select("account", summary_text(run, accounts).alias("text"))


FIX_LIST_OPENING = (
    "## Agent Instructions\n\n```\n"
    "Work list, one entry per place. For each entry open the file at the line given, decide whether the\n"
    "value is real, and if so put a neutral sample value in its stead.\n"
)
FIX_LIST_CLOSING = "End of the work list. Older revisions are a separate job for whoever owns the repository.\n```\n"


def fix_list(findings: DataFrame) -> DataFrame:
    """Repository headings and fix blocks in reading order, as rows."""
    shown = ["account", "severity", "line", "rule", "redacted_evidence", "suggested_action"]
    unique = unique_findings(findings.select(*shown, *ORDER_COLUMNS))
    blocks = unique.select("account", *ORDER_COLUMNS, F.lit(1).alias("part"), fix_block().alias("text"))
    first = (
        findings.groupBy("account", "account_ord", "repo_ord", "repo").agg(F.count(F.lit(1)).alias("n"))
        .select("account", "account_ord", "repo_ord", "repo", F.lit(0).alias("part"),
                F.concat(F.lit("## Repo: "), "repo", F.lit("\n")).alias("text"))
    )
    return first.unionByName(blocks, allowMissingColumns=True)


def finding_blocks(findings: DataFrame) -> DataFrame:
    return findings.select(
        "account", severity_rank(F.col("severity")).alias("severity_rank"), *ORDER_COLUMNS,
        finding_block().alias("text"),
    )


REPORT_ORDER = ("account", "section", "severity_rank", "account_ord", "repo_ord", "repo", "part",
                "commit_ord", "commit", "file", "scanner_ord", "line_ord", "rule_ord", "match_ord")


RUN_ORDER = REPORT_ORDER[1:]


def _fixed_rows(counts: DataFrame, run: RunInfo, accounts: Column) -> DataFrame:
    """Summary and fixed texts of each row of ``counts_by_account``; without findings the summary says it all."""
    def row(section: int, severity: int | None, part: int | None, text: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(severity).cast("int").alias("severity_rank"),
            F.lit(part).cast("int").alias("part"), text.alias("text"),
        )

    texts = (
        (FIX_LIST, -1, -1, FIX_LIST_OPENING),
        (FIX_LIST, len(V.SEVERITIES), 2, FIX_LIST_CLOSING),
        (FINDINGS, -1, -1, "## Findings\n"),
    )
    head = row(HEADER, None, None, summary_text(run, accounts))
    more = [F.when(F.col("findings") > 0, row(*fixed, F.lit(text))) for *fixed, text in texts]
    return counts.select("account", F.inline(F.array_compact(F.array(head, *more))))


def _report(findings: DataFrame, fixed: DataFrame) -> DataFrame:
    fixes = fix_list(findings).withColumn("section", F.lit(FIX_LIST)).withColumn("severity_rank", F.lit(0))
    blocks = finding_blocks(findings).withColumn("section", F.lit(FINDINGS)).withColumn("part", F.lit(0))
    return fixed.unionByName(fixes, allowMissingColumns=True).unionByName(blocks, allowMissingColumns=True)


def account_reports(findings: DataFrame, run: RunInfo) -> DataFrame:
    """The reports of all accounts as rows; sorted by ``REPORT_ORDER`` they read as the report."""
    counts = findings.groupBy("account").agg(F.count(F.lit(1)).alias("findings"), *_severity_columns())
    return _report(findings, _fixed_rows(counts, run, F.lit(1)))


def run_report(findings: DataFrame, run: RunInfo) -> DataFrame:
    """The report of the whole run as rows; sorted by ``RUN_ORDER`` they read as the report."""
    counts = counts_by_account(findings).where(F.col("account").isNull())
    return _report(findings, _fixed_rows(counts, run, F.lit(run.accounts)))


def write_reports(rows: DataFrame, folder: str) -> None:
    """Text files per account; a big account spans several files that read on in name order."""
    (
        rows.repartitionByRange(*REPORT_ORDER)
        .sortWithinPartitions(*REPORT_ORDER)
        .select("account", F.col("text").alias("value"))
        .write.mode("overwrite").partitionBy("account")
        .text(folder)
    )


def write_run_report(rows: DataFrame, path: str) -> None:
    """Text files that read on in name order; the first one begins with the summary."""
    (
        rows.repartitionByRange(*RUN_ORDER)
        .sortWithinPartitions(*RUN_ORDER)
        .select(F.col("text").alias("value"))
        .write.mode("overwrite").text(path)
    )


def write_findings(findings: DataFrame, folder: str, run_id: int) -> str:
    """The findings table of one run, partitioned by severity for readers of the worst ones."""
    path = f"{folder.rstrip('/')}/run={run_id:010d}"
    findings.write.mode("overwrite").partitionBy("severity").parquet(path)
    return path


# ---------------------------------------------------------------- finished reports and messages
NO_SUMMARY = "There is no summary yet. Run a scan to get a report."


def report_name(finished_at: str) -> str:
    return "audit-report-" + finished_at.replace(":", "-").replace(".", "-") + ".md"


def latest_report(names: DataFrame, name: str = "name") -> DataFrame:
    return names.where(F.col(name).endswith(".md")).agg(F.max(name).alias(name))


def summary_of(report: Column) -> Column:
    """From the summary heading to the next heading or the end, trimmed of Unicode blanks."""
    found = F.regexp_extract(report, r"(?s)(## Summary.*?)(?=\n## |\n?\z)", 1)
    trimmed = F.regexp_replace(found, rf"[{BLANKS}]+\z", "")
    return F.when(trimmed == "", F.lit(NO_SUMMARY)).otherwise(trimmed)


def usable_address(address: Column) -> Column:
    """The address, or NULL for a missing one or a placeholder."""
    return F.when(~(address.startswith("REPLACE_") | address.contains("placeholder") | (address == "")), address)


def digests(accounts: DataFrame, findings: DataFrame, run: RunInfo) -> DataFrame:
    """One message per account with findings and a usable contact address, as the rows of its text.

    Every row carries address and subject; sorted by ``REPORT_ORDER`` the texts of a message are the account's
    whole report.
    """
    ready = accounts.select(
        F.col("account_id").alias("account"), usable_address(F.col("contact_email")).alias("to"),
        usable_address(F.col("cc_email")).alias("cc"),
    ).where(F.col("to").isNotNull())
    counted = findings.groupBy("account").agg(F.count(F.lit(1)).alias("findings"))
    plural = F.when(F.col("findings") == 1, F.lit("")).otherwise(F.lit("s"))
    subject = F.concat(
        F.lit("Privacy Report for "), "account", F.lit(" — "), F.col("findings").cast("string"),
        F.lit(" finding"), plural, F.lit(f" — {run.finished_at[:10]}"),
    )
    # staged: a few short rows, of which the plan knows that they are few, so the texts stay where they are
    messages = stage(ready.join(counted, "account").withColumn("subject", subject), "messages")
    text = account_reports(findings, run)
    return salted_join(
        text, messages, ["account"], ["section", "repo", "file", "commit", "line_ord", "rule_ord"], counted=findings, few_rows=FEW_ROWS
    ).select(F.col("account").alias("account_id"), "to", "cc", "subject", "findings", *RUN_ORDER, "text")
