"""Log-like content: counts per file inside the row, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import is_log_line, lines_of, once
from ..model import SCANNER_RISK_CONTENT


def is_long(text: Column) -> Column:
    return once(
        text,
        lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) >= V.LARGE_LOG_MIN_LINES,
    )


def log_line_counts(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Lines and log-like lines of every file."""
    counts = once(
        lines_of(F.col(text)),
        lambda lines: F.struct(
            F.size(lines).alias("n_lines"), F.size(F.filter(lines, is_log_line)).alias("n_log_lines")
        ),
    )
    return _computed_once(df, keys, counts, "counts").select(*keys, "counts.*")


def _computed_once(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """A column that later filters and projections read without computing it again: an explode of
    one element, which Catalyst does not look through."""
    return df.select(*keys, F.explode_outer(F.array(value)).alias(name))


def large_logs(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Files of more than 100 lines of which more than 30 % look like log output."""
    return log_line_counts(df.where(is_long(F.col(text))), keys, text).where(
        F.col("n_log_lines") > F.col("n_lines") * F.lit(V.LARGE_LOG_MIN_RATIO)
    )


def _evidence(lines: Column) -> Column:
    logged = F.size(F.filter(lines, is_log_line))
    return once(
        logged,
        lambda n: F.when(
            n > F.size(lines) * F.lit(V.LARGE_LOG_MIN_RATIO),
            F.format_string("Large log-like file (%d lines, %d log-pattern lines)", F.size(lines), n),
        ),
    )


def log_evidence(text: Column) -> Column:
    """Evidence text of a large log, NULL for any other file."""
    return once(text, lambda t: F.when(is_long(t), once(lines_of(t), _evidence)))


def log_findings(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    rule, severity = V.LARGE_LOG_RULE
    evidence = _computed_once(df, keys, log_evidence(F.col(text)), "redacted_evidence")
    return evidence.where(F.col("redacted_evidence").isNotNull()).select(
        *keys,
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        "redacted_evidence",
        F.lit(SCANNER_RISK_CONTENT).alias("scanner_ord"),
        F.lit(0).alias("rule_ord"),
    )
