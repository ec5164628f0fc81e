"""Line-by-line detection as one narrow stage: no shuffle, no Python, text dropped at the first step."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.regex import expand
from ..functions.text import lines_of, lookup, once
from ..model import SCANNER_PII, SCANNER_RISK_CONTENT, SCANNER_SECRET, Rule
from .logs import log_evidence
from .rules import SECRET_RULES


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table, as read from files, that has fewer splits than the cluster has cores.

    Such an input is at most (cores x one split) big, so the shuffle is bounded; a large input has
    more splits than cores and is left where it is.  Not for results of joins or aggregates, which
    are spread already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys)


def document_lines(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    return df.select(*keys, F.posexplode(lines_of(F.col(text))).alias("pos", "content")).select(
        *keys, (F.col("pos") + 1).alias("line"), "content"
    )


def any_gate(text: Column, rules: Sequence[Rule]) -> Column:
    """True if any gate lets the text through.

    Plain fragments are searched in the bytes; the regular expressions are merged into one, so that
    the text is decoded and walked once.
    """
    literals = [x for r in rules for x in r.gate.literals]
    rests: dict[str, list[str]] = {}
    for r in rules:
        if r.gate.first:
            rests.setdefault(r.gate.first, []).append(r.gate.rest)
    merged = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in rests.items())

    def test(t: Column) -> Column:
        parts = [t.contains(x) for x in literals] + ([t.rlike(merged)] if merged else [])
        return reduce(lambda a, b: a | b, parts)

    return once(text, test)


def _gate(text: Column, rule: Rule) -> Column:
    if rule.gate.first:
        return text.rlike(f"{rule.gate.first}(?:{rule.gate.rest})")
    return reduce(lambda a, b: a | b, [text.contains(x) for x in rule.gate.literals])


def _found(ord_: int, values: Column) -> Column:
    return F.struct(F.lit(ord_).alias("rule_ord"), values.alias("found"))


def _present(hits: list[Column]) -> Column:
    return F.filter(F.array(*hits), lambda hit: F.size(hit["found"]) > 0)


def _rule_hits(line: Column, rules: Sequence[Rule]) -> list[Column]:
    return [
        _found(
            r.ord,
            F.when(_gate(line, r), F.regexp_extract_all(line, F.lit(expand(r.pattern)), F.lit(r.group))),
        )
        for r in rules
    ]


def scan_lines(
    df: DataFrame, keys: Sequence[str], rules: Sequence[Rule], text: str = "text",
    drop_false_positives: bool = True,
) -> DataFrame:
    """All matches of all rules: ``keys, line, rule_ord, match_ord, match``.

    Texts, then lines, that fail every gate leave before a pattern runs.  Each rule matches on its
    own, so matches of different rules may overlap.
    """
    content, line = F.col(text), F.col("content")
    to_read = F.when(any_gate(content, rules), lines_of(content))
    lines = df.select(*keys, F.posexplode_outer(to_read).alias("pos", "content")).where(any_gate(line, rules))
    return _matches(lines, keys, _rule_hits(line, rules), rules, drop_false_positives)


def _matches(
    lines: DataFrame, keys: Sequence[str], hits: list[Column], rules: Sequence[Rule],
    drop_false_positives: bool,
) -> DataFrame:
    """Outer explodes only: for an inner explode Catalyst adds a filter on the exploded expression,
    which would run every pattern twice, and push it below a repartition."""
    matches = (
        lines.select(*keys, (F.col("pos") + 1).alias("line"), F.inline_outer(_present(hits)))
        .select(*keys, "line", "rule_ord", F.posexplode_outer("found").alias("match_ord", "match"))
        .where(F.col("match").isNotNull())
    )
    if not drop_false_positives:
        return matches
    return matches.where(~is_dropped(F.col("rule_ord"), F.col("match"), rules))


# rows of a whole-text scan that are not matches of a line rule
READABLE, LARGE_LOG = -1, -2


def text_findings(texts: DataFrame, keys: Sequence[str], rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Everything a text's content says, in one pass over the text.

    Line rules, the large-log check, and for each text one row without a rule which says that the
    text could be read.  Texts that fail every gate are not split into lines.
    """
    content, line = F.col(text), F.col("content")
    to_read = F.when(any_gate(content, rules), lines_of(content)).otherwise(F.array(F.lit("")))
    # the log check stands in a step of its own: next to the explode it would run once per line
    judged = texts.select(*keys, text, log_evidence(content).alias("log_evidence"))
    lines = judged.select(*keys, "log_evidence", F.posexplode_outer(to_read).alias("pos", "content"))
    first = F.col("pos") == 0
    hits = [
        _found(READABLE, F.when(first, F.array(F.lit("")))),
        _found(LARGE_LOG, F.when(first & F.col("log_evidence").isNotNull(), F.array("log_evidence"))),
        *_rule_hits(line, rules),
    ]
    matches = _matches(lines.where(first | any_gate(line, rules)), keys, hits, rules, True)
    ord_ = F.col("rule_ord")
    log_rule, log_severity = V.LARGE_LOG_RULE
    secret = ord_ <= max(r.ord for r in SECRET_RULES)
    return matches.select(
        *keys,
        F.when(ord_ >= 0, F.col("line")).alias("line"),
        F.when(ord_ == LARGE_LOG, F.lit(log_rule)).otherwise(rule_name(ord_, rules)).alias("rule"),
        F.when(ord_ == LARGE_LOG, F.lit(log_severity)).otherwise(rule_severity(ord_, rules)).alias("severity"),
        F.when(ord_ == LARGE_LOG, F.col("match"))
        .otherwise(redacted(ord_, F.col("match"), rules))
        .alias("redacted_evidence"),
        F.when(ord_ == LARGE_LOG, SCANNER_RISK_CONTENT)
        .when(secret, SCANNER_SECRET)
        .otherwise(SCANNER_PII)
        .alias("scanner_ord"),
        F.greatest(ord_, F.lit(0)).alias("rule_ord"),
        "match_ord",
    )


def is_dropped(rule_ord: Column, match: Column, rules: Sequence[Rule]) -> Column:
    """Exclusions of the rules; rules that share one exclusion share its test."""
    shared: dict = {}
    for r in rules:
        if r.drop is not None:
            shared.setdefault(r.drop, []).append(r.ord)
    tests = [rule_ord.isin(*ords) & drop(match) for drop, ords in shared.items()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def redacted(rule_ord: Column, match: Column, rules: Sequence[Rule]) -> Column:
    shared: dict = {}
    for r in rules:
        shared.setdefault(r.redact, []).append(r.ord)
    cases = F
    for fn, ords in shared.items():
        cases = cases.when(rule_ord.isin(*ords), fn(match))
    return cases


def redacted_text(text: Column, rules: Sequence[Rule]) -> Column:
    """The text with every match redacted, line by line and rule after rule; false positives stay.

    A line is cut at the matches of a rule and put together again around the redacted ones.
    """
    def apply(line: Column, rule: Rule) -> Column:
        pattern = expand(rule.pattern)

        def one(rest: Column, match: Column) -> Column:
            shown = rule.redact(match) if rule.drop is None else F.when(rule.drop(match), match).otherwise(rule.redact(match))
            return F.concat(rest, F.coalesce(shown, F.lit("")))

        def rebuilt(x: Column) -> Column:
            pieces = F.zip_with(F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), one)
            return F.when(_gate(x, rule) & x.rlike(pattern), F.array_join(pieces, "")).otherwise(x)

        return once(line, rebuilt)

    done = F.array_join(F.transform(lines_of(text), lambda line: reduce(apply, rules, line)), "\n")
    return F.when(any_gate(text, rules), done).otherwise(text)


def rule_name(rule_ord: Column, rules: Sequence[Rule]) -> Column:
    return lookup(rule_ord, {r.ord: r.name for r in rules})


def rule_severity(rule_ord: Column, rules: Sequence[Rule]) -> Column:
    return lookup(rule_ord, {r.ord: r.severity for r in rules})


def line_findings(
    df: DataFrame, keys: Sequence[str], rules: Sequence[Rule], text: str = "text"
) -> DataFrame:
    """Matches as redacted finding rows, with the order columns of their scanner."""
    secret_ords = [r.ord for r in rules if r in SECRET_RULES]
    rule_ord = F.col("rule_ord")
    scanner = (
        F.when(rule_ord.isin(*secret_ords), F.lit(SCANNER_SECRET)).otherwise(F.lit(SCANNER_PII))
        if secret_ords
        else F.lit(SCANNER_PII)
    )
    return scan_lines(df, keys, rules, text).select(
        *keys,
        "line",
        rule_name(rule_ord, rules).alias("rule"),
        rule_severity(rule_ord, rules).alias("severity"),
        redacted(rule_ord, F.col("match"), rules).alias("redacted_evidence"),
        scanner.alias("scanner_ord"),
        "rule_ord",
        "match_ord",
    )
