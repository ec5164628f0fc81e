"""Column expressions on paths, lines and small lookups."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .regex import expand


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed a single time.

    Catalyst copies a projected expression to every place that names it.  A lambda binds it instead,
    and it is evaluated outside generated code: dozens of patterns inlined into one generated method
    would pass the JVM's method size and cost the whole stage its code.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def lines_of(text: Column) -> Column:
    """All lines of a text; an empty text has one empty line, trailing empty lines stay."""
    return F.split(text, "\n")


def base_name(path: Column) -> Column:
    """What follows the last ``/`` or ``\\``; empty for a trailing separator."""
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def is_image(path: Column) -> Column:
    endings = "|".join(s.replace(".", r"\.") for s in V.IMAGE_SUFFIXES)
    return F.lower(path).rlike(rf"(?:{endings})\z")


def is_scannable(path: Column, strict: bool = False) -> Column:
    """True for every path, unless ``strict`` asks for one of the known text suffixes."""
    if not strict:
        return path.isNotNull()
    endings = "|".join(s.replace(".", r"\.") for s in V.TEXT_SUFFIXES)
    return F.lower(path).rlike(rf"(?:{endings})\z")


def is_suspicious_name(path: Column) -> Column:
    return is_suspicious_base(base_name(path))


def is_suspicious_base(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(V.SUSPICIOUS_NAME_WORDS))


def is_log_line(line: Column) -> Column:
    return line.rlike(expand(V.LOG_LINE_PATTERN))


def lookup(key: Column, values: Mapping) -> Column:
    """Constant map lookup; folds to one literal map."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 3 for low."""
    return F.array_position(F.array(*[F.lit(s) for s in V.SEVERITIES]), severity).cast("int") - 1


def action_for(rule: Column) -> Column:
    return F.coalesce(lookup(rule, V.ACTIONS), F.lit("Look at the finding and delete it if private."))
