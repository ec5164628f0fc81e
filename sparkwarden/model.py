"""Data model: scan options, rules, column order of findings and the shared session helpers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

from . import fixed_values as V


@dataclass(frozen=True)
class ScanOptions:
    """What a scan includes.  ``redact_secrets`` is accepted but secrets are always redacted."""

    include_forks: bool = V.INCLUDE_FORKS
    include_archived: bool = V.INCLUDE_ARCHIVED
    max_file_bytes: int = V.MAX_FILE_BYTES
    redact_secrets: bool = V.REDACT_SECRETS
    store_exact_gps: bool = V.STORE_EXACT_GPS
    strict_extensions: bool = False


@dataclass(frozen=True)
class Gate:
    """A cheap condition that every match meets: one of some fragments, or a pattern.

    The pattern is ``first`` (one character) followed by ``rest``.  Gates are tested on the whole
    text and again on each line, so they must not be anchored.
    """

    literals: tuple[str, ...] = ()
    first: str = ""
    rest: str = ""


@dataclass(frozen=True)
class Rule:
    """A line rule.  ``drop`` marks matches that are false positives."""

    ord: int
    name: str
    severity: str
    pattern: str
    gate: Gate
    redact: Callable[[Column], Column]
    group: int = 0
    drop: Callable[[Column], Column] | None = None


# position of each scanner in the reading order of a file's findings
SCANNER_IMAGE = 0
SCANNER_SECRET = 0
SCANNER_PII = 1
SCANNER_SUSPICIOUS_NAME = 2
SCANNER_RISK_NAME = 3
SCANNER_RISK_CONTENT = 4
SCANNER_KEYWORD = 5

FINDING_COLUMNS = (
    "account", "repo", "file", "line", "commit", "rule", "severity", "redacted_evidence",
    "metadata", "suggested_action",
)

# the reading order of findings: account, repo, commit, file, scanner, line, rule, match
ORDER_COLUMNS = (
    "account_ord", "repo_ord", "repo", "commit_ord", "commit", "file", "scanner_ord", "line_ord",
    "rule_ord", "match_ord",
)

FINDINGS_SCHEMA = T.StructType(
    [
        T.StructField("account", T.StringType(), False),
        T.StructField("repo", T.StringType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("line", T.IntegerType(), True),
        T.StructField("commit", T.StringType(), True),
        T.StructField("rule", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("redacted_evidence", T.StringType(), True),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("suggested_action", T.StringType(), True),
    ]
)
