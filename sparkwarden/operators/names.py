"""File-name rules: every pattern that fits the base name gives one finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.regex import expand
from ..functions.text import base_name, is_suspicious_base, once
from ..model import SCANNER_RISK_NAME, SCANNER_SUSPICIOUS_NAME

RISK_NAME_PATTERNS = (
    [(V.EVIDENCE["sensitive"], *p) for p in V.SENSITIVE_NAME_PATTERNS]
    + [(V.EVIDENCE["picture"], *p) for p in V.PICTURE_NAME_PATTERNS]
    + [(V.EVIDENCE["log"], *p) for p in V.LOG_NAME_PATTERNS]
)


def _hit(rule: str, severity: str, evidence: Column, scanner: int, ord_: int) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        evidence.alias("redacted_evidence"),
        F.lit(scanner).alias("scanner_ord"),
        F.lit(ord_).alias("rule_ord"),
    )


def _suspicious(name: Column) -> Column:
    rule, severity = V.SUSPICIOUS_NAME_RULE
    evidence = F.concat(F.lit(V.EVIDENCE["suspicious-filename"]), name)
    return F.when(is_suspicious_base(name), _hit(rule, severity, evidence, SCANNER_SUSPICIOUS_NAME, 0))


def _risks(name: Column) -> list[Column]:
    return [
        F.when(
            name.rlike(expand(pattern)),
            _hit(rule, severity, F.concat(F.lit(prefix), name), SCANNER_RISK_NAME, i),
        )
        for i, (prefix, rule, severity, pattern) in enumerate(RISK_NAME_PATTERNS)
    ]


# one pass tells whether any pattern can fit; most file names fit none
_ANY_NAME = "|".join(
    f"(?:{expand(p)})" for p in ("(?i)" + "|".join(V.SUSPICIOUS_NAME_WORDS), *(x[3] for x in RISK_NAME_PATTERNS))
)


def name_hits(path: Column, suspicious: bool = True, risks: bool = True) -> Column:
    """Array of all name findings of a path."""

    def hits(name: Column) -> Column:
        found = ([_suspicious(name)] if suspicious else []) + (_risks(name) if risks else [])
        return F.when(name.rlike(_ANY_NAME), F.array_compact(F.array(*found)))

    return once(base_name(path), hits)


def _explode_hits(df: DataFrame, keys: Sequence[str], hits: Column) -> DataFrame:
    """One row per hit.

    The outer form keeps Catalyst from copying the patterns into a filter before the explode, which
    would run them twice.
    """
    return (
        df.select(*keys, F.explode_outer(hits).alias("hit"))
        .where(F.col("hit").isNotNull())
        .select(*keys, "hit.*")
    )


def suspicious_names(df: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    return _explode_hits(df, keys, name_hits(F.col(path), risks=False))


def risk_names(df: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    return _explode_hits(df, keys, name_hits(F.col(path), suspicious=False))
