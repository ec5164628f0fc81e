"""Redaction and scoring of matched values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_ends(value: Column, head: int, mark: str, tail: int) -> Column:
    """First ``head`` characters, a mark, last ``tail`` characters."""
    return F.concat(F.substring(value, 1, head), F.lit(mark), F.right(value, F.lit(tail)))


def email(value: Column) -> Column:
    user, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    return F.concat(F.substring(user, 1, 2), F.lit("***@"), domain)


def phone(value: Column) -> Column:
    return keep_ends(value, 4, "...", 2)


def postcode(value: Column) -> Column:
    return keep_ends(value, 2, "***", 2)


def handle(value: Column) -> Column:
    return keep_ends(value, 3, "***", 3)


def unchanged(value: Column) -> Column:
    return value


def secret(value: Column) -> Column:
    """First 6 and last 4 characters; nothing at all of a value that short."""
    return F.when(F.length(value) <= 10, F.lit("...")).otherwise(keep_ends(value, 6, "...", 4))


def serial(value: Column) -> Column:
    return F.when(F.length(value) <= 4, F.lit("...")).otherwise(keep_ends(value, 2, "...", 2))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character, rounded to 6 digits."""
    share = F.transform(
        F.array_distinct(F.split(value, "")),
        lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value),
    )
    bits = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.round(bits, 6)
