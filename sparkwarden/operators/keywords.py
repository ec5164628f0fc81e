"""Per-account keywords.

Accounts with the same keyword list share one pattern, and a text is matched against a pattern
once, however many files and accounts point at it.  A table of wanted (text, pattern) pairs says which
texts meet which patterns.  With many patterns an inverted index (``keyword_index``) tells the lines on which a pair
may match, so a text is read once; a few patterns are simply tried on the texts in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import lines_of
from ..model import SCANNER_KEYWORD
from ..sources.files import stage
from . import keyword_index

#: From so many different patterns on the index is used.  A checked size, as for a broadcast: both ways give the same rows.
INDEX_FROM = 32

# letters outside ASCII fold as Unicode, ASCII letters only among themselves
_FOLD_NON_ASCII = r"([^\x00-\x7f]+)"


def keyword_pattern(keywords: Column) -> Column:
    """One alternation in list order; NULL when no keyword is left."""
    escaped = F.transform(
        F.filter(keywords, lambda k: k != ""),
        lambda k: F.regexp_replace(k, r"([.*+?^${}()|\[\]\\])", r"\\$1"),
    )
    return F.when(F.size(escaped) > 0, F.array_join(escaped, "|"))


def keyword_patterns(accounts: DataFrame) -> DataFrame:
    """Accounts that have keywords, with their pattern."""
    return accounts.select(
        "account_id", keyword_pattern(F.col("keywords")).alias("pattern")
    ).where(F.col("pattern").isNotNull())


def distinct_patterns(accounts: DataFrame) -> DataFrame:
    """``pattern, keywords`` of each pattern that an account has, once."""
    rows = accounts.select(keyword_pattern(F.col("keywords")).alias("pattern"), "keywords").where(F.col("pattern").isNotNull())
    return rows.groupBy("pattern").agg(F.min("keywords").alias("keywords"))


def _java(pattern: Column) -> Column:
    return F.concat(F.lit("(?i)"), F.regexp_replace(pattern, _FOLD_NON_ASCII, "(?iu:$1)"))


def keyword_severity(match: Column) -> Column:
    low = F.lower(match)
    risky = F.lit(False)
    for word in V.HIGH_RISK_KEYWORD_WORDS:
        risky = risky | low.contains(word)
    return F.when(risky, F.lit("medium")).otherwise(F.lit("low"))


def _found_per_line(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    java = F.col("java")
    with_java = texts.select(*keys, text, F.explode_outer(F.array(_java(F.col("pattern")))).alias("java"))
    to_read = F.when(F.rlike(F.col(text), java), lines_of(F.col(text)))
    lines = with_java.select(*keys, "java", F.posexplode_outer(to_read).alias("pos", "content"))
    return lines.where(F.col("content").isNotNull()).select(
        *keys, (F.col("pos") + 1).alias("line"),
        F.explode_outer(F.array(F.regexp_extract_all("content", java, F.lit(0)))).alias("found"),
    )


def _found_by_index(texts: DataFrame, wanted: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that may match, joined with their contents; no text and no list of patterns is moved."""
    where = stage(keyword_index.candidate_lines(texts, wanted, patterns, key, text), "keyword-lines")
    read = texts.join(where.select(key).distinct(), key, "left_semi")
    lines = read.select(key, F.posexplode(lines_of(F.col(text))).alias("pos", "content")).withColumn("line", F.col("pos") + 1)
    java = patterns.select("pattern", _java(F.col("pattern")).alias("java"))
    met = where.join(lines.select(key, "line", "content"), [key, "line"]).join(java, "pattern")
    found = F.regexp_extract_all("content", F.col("java"), F.lit(0))
    return met.select(key, "pattern", "line", F.explode(F.array(found)).alias("found")).where(F.size("found") > 0)


def _found(texts: DataFrame, wanted: DataFrame, patterns: DataFrame, key: str, text: str, index_from: int) -> DataFrame:
    """``key, pattern, line, found`` for wanted pairs of ``key, pattern``.

    ``texts`` has one row per key, ``patterns`` the columns ``pattern, keywords``, each pattern once.
    """
    many = patterns.limit(index_from).count() >= index_from
    if many:
        return _found_by_index(texts, wanted, patterns, key, text)
    # Fewer than index_from patterns: so short are the lists, and so many times at most a text is tried.
    lists = wanted.groupBy(key).agg(F.collect_set("pattern").alias("patterns"))
    pairs = texts.select(key, text).join(lists, key).select(key, text, F.explode("patterns").alias("pattern"))
    return _found_per_line(pairs, [key, "pattern"], text)


def wanted_matches(
    texts: DataFrame, wanted: DataFrame, patterns: DataFrame, key: str, text: str = "text", index_from: int = INDEX_FROM
) -> DataFrame:
    """All matches of the wanted pairs: ``key, pattern, line, match_ord, match``."""
    found = _found(texts, wanted, patterns, key, text, index_from)
    return _matches(found, [key, "pattern"])


def wanted_findings(
    texts: DataFrame, wanted: DataFrame, patterns: DataFrame, key: str, text: str = "text", index_from: int = INDEX_FROM
) -> DataFrame:
    """First match per line and lower-cased keyword of the wanted pairs, with the columns of a finding."""
    return _findings(_found(texts, wanted, patterns, key, text, index_from), [key, "pattern"])


def _matches(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.select(*keys, "line", F.posexplode_outer("found").alias("match_ord", "match")).where(F.col("match").isNotNull())


def keyword_matches(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """All matches of each row's ``pattern`` in its text, line by line."""
    return _matches(_found_per_line(texts, keys, text), keys)


def keyword_findings(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """First match per line and lower-cased keyword, inside the row."""
    return _findings(_found_per_line(texts, keys, text), keys)


def _findings(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    low = F.transform("found", lambda m: F.lower(m))
    first = F.transform(
        F.array_distinct(low),
        lambda k: F.struct(
            (F.array_position(low, k) - 1).cast("int").alias("match_ord"),
            F.get(F.col("found"), (F.array_position(low, k) - 1).cast("int")).alias("match"),
        ),
    )
    rows = found.select(*keys, "line", F.inline_outer(first)).where(F.col("match").isNotNull())
    return rows.select(
        *keys,
        "line",
        F.lit(V.KEYWORD_RULE).alias("rule"),
        keyword_severity(F.col("match")).alias("severity"),
        F.concat(F.lit('Keyword match: "'), "match", F.lit('"')).alias("redacted_evidence"),
        F.lit(SCANNER_KEYWORD).alias("scanner_ord"),
        F.lit(0).alias("rule_ord"),
        "match_ord",
    )
