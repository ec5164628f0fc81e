"""Secrets in texts: fixed patterns, and windows of high entropy in candidate strings.

Patterns: values assigned to a secret's name (``assign``), access keys (``access``) and long hex runs
(``hex``), leftmost and without overlap within a kind.  Matches that are too short are dropped afterwards,
so they still use up their text.

Entropy (kind ``entropy``): a candidate is a run of at least ``WINDOW`` characters of the base-64 alphabets.
It is cut at what the allow list matches, so no window overlaps an allowed match, and the pieces are looked at
one by one.  A piece without a letter, an UUID, and words of letters joined by ``-_/`` with a short number at the
end are no secrets.  In the other pieces, letters-only ones included, a window of ``WINDOW`` characters slides on;
the Shannon entropy of its characters follows from a sum over counts that is brought up to date with the
character that enters and the one that leaves, so the work is linear in the length.  The limit depends on the
character class of the piece.  The span runs from its first to its last window above the limit.

Only DataFrame functions are used and no row is shuffled.  Null texts are empty and have no spans; rows with
a null id and rows that repeat an id are looked at like all others; other columns are not looked at.
Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the task: patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run holds no longer one, so the length may stand in the pattern
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Class of a candidate: the first pattern that holds, and the entropy in bits above which a window counts.
CLASSES = (("^[0-9a-fA-F]+$", 3.05), ("^[A-Za-z0-9]+$", 3.75), ("", 3.85))
#: Candidates are cut at these.
ALLOWED = (
    "(?i:example|sample|dummy|placeholder|xxxx|abcdefgh|01234567|12345678)",
    "[0-9]{4}-[0-9]{2}-[0-9]{2}",
)
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: What words joined by ``-_/`` with a number of up to four digits at the end do not hold.
NO_WORDS = "[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Za-z]{15}|[0-9][^0-9]|[0-9]{5}|[+=]"
KINDS = ("assign", "access", "hex", "entropy")


#: Matches are walked in blocks of so many, and blocks one by one, so that a list never grows match by match beyond it.
BLOCK = 512


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """``start, match, value`` of every match, only worked out for texts that have one."""
    kind = "array<struct<start:int,match:string,value:string>>"
    empty = F.array().cast(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    steps = F.filter(F.arrays_zip(matches.alias("match"), values.alias("value"), between.alias("gap")), lambda s: s["match"].isNotNull())

    def place(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        return F.struct(
            (start + F.char_length(s["match"])).alias("at"),
            F.array_append(acc["found"], F.struct(start.alias("start"), s["match"].alias("match"), s["value"].alias("value"))).alias("found"),
        )

    def blocks(steps: Column) -> Column:
        """Matches of each block, placed from the block's begin on, and the block's length."""
        begin = F.struct(F.lit(0).alias("at"), empty.alias("found"))
        firsts = F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK))
        return F.transform(firsts, lambda i: F.aggregate(F.slice(steps, i, BLOCK), begin, place))

    def follow(acc: Column, block: Column) -> Column:
        moved = F.transform(
            block["found"],
            lambda m: F.struct((acc["at"] + m["start"]).alias("start"), m["match"].alias("match"), m["value"].alias("value")),
        )
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["found"], moved).alias("found"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))
    bound = F.transform(F.array(steps), lambda s: F.aggregate(blocks(s), begin, follow)["found"])  # steps are worked out once
    return F.when(text.rlike(pattern), F.flatten(bound[0])).otherwise(empty)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("nth"),
            (m["start"] + F.char_length(m["match"])).alias("end"), F.lit(kind).alias("kind"),
        ),
    )


def _windows(string: Column, window: int, limit: Column) -> Column:
    """``first, last``: starts of the first and the last window above the limit, -1 if there is none."""

    def weight(n: Column) -> Column:  # n log2 n
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def count(inside: Column, character: Column) -> Column:
        return F.char_length(inside) - F.char_length(F.replace(inside, character, F.lit("")))

    def step(acc: Column, enters: Column) -> Column:
        start = acc["start"] + 1
        full = start > 0
        leaves = F.substring(acc["inside"], 1, 1)
        rest = F.when(full, F.substring(acc["inside"], F.lit(2), F.lit(window - 1))).otherwise(acc["inside"])
        out = count(acc["inside"], leaves)
        new = count(rest, enters)
        total = (
            acc["total"]
            - F.when(full, weight(out) - weight(out - 1)).otherwise(F.lit(0.0))
            + weight(new + 1) - weight(new)
        )
        high = (start >= 0) & (F.log2(F.lit(float(window))) - total / window > acc["limit"])
        return F.struct(
            F.concat(rest, enters).alias("inside"), start.alias("start"), total.alias("total"), acc["limit"].alias("limit"),
            F.when(high & (acc["first"] < 0), start).otherwise(acc["first"]).alias("first"),
            F.when(high, start).otherwise(acc["last"]).alias("last"),
        )

    begin = F.struct(
        F.lit("").alias("inside"), F.lit(-window).alias("start"), F.lit(0.0).alias("total"), limit.alias("limit"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )
    return F.aggregate(F.split(string, ""), begin, step)


def _pieces(candidate: Column, allowed: Sequence[str]) -> Column:
    """``start, piece``: what lies between allowed matches of a candidate."""
    if not allowed:
        return F.array(F.struct(candidate["start"].alias("start"), candidate["match"].alias("piece")))
    cut = "|".join(f"(?:{p})" for p in allowed)
    ends = F.transform(_found(candidate["match"], cut), lambda m: candidate["start"] + m["start"] + F.char_length(m["match"]))
    starts = F.concat(F.array(candidate["start"]), ends)
    return F.arrays_zip(starts.alias("start"), F.split(candidate["match"], cut, -1).alias("piece"))


def _entropy_spans(text: Column, window: int, allowed: Sequence[str]) -> Column:
    def suspect(p: Column) -> Column:
        piece = p["piece"]
        return (F.char_length(piece) >= window) & piece.rlike("[A-Za-z]") & piece.rlike(NO_WORDS) & ~piece.rlike(UUID)

    def limit(string: Column) -> Column:
        out = F.lit(CLASSES[-1][1])
        for pattern, bits in reversed(CLASSES[:-1]):
            out = F.when(string.rlike(pattern), F.lit(bits)).otherwise(out)
        return out

    pieces = F.flatten(F.transform(_found(text, CANDIDATE), lambda m: _pieces(m, allowed)))
    high = F.transform(
        F.filter(pieces, suspect),
        lambda p: F.struct(p["start"].alias("start"), _windows(p["piece"], window, limit(p["piece"])).alias("w")),
    )
    return F.transform(
        F.filter(high, lambda m: m["w"]["first"] >= 0),
        lambda m: F.struct(
            (m["start"] + m["w"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("nth"),
            (m["start"] + m["w"]["last"] + window).alias("end"), F.lit("entropy").alias("kind"),
        ),
    )


def base_spans(text: Column) -> Column:
    """Spans of the patterns as ``start, nth, end, kind``, in order of start and kind."""
    assigned = F.filter(_found(text, ASSIGN, 2), lambda m: F.char_length(m["value"]) >= ASSIGN_LEAST)
    return F.array_sort(
        F.concat(_spans(assigned, "assign"), _spans(_found(text, ACCESS), "access"), _spans(_found(text, HEX), "hex"))
    )


def find_secrets(docs: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``doc_id, text, base, spans``: arrays of ``start, nth, end, kind``, in order of start and kind.

    ``base`` holds the spans of the patterns, ``spans`` those and the entropy spans.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", "text", base_spans(text).alias("base"), _entropy_spans(text, WINDOW, allowed).alias("more"))
    return found.select("doc_id", "text", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """The same rows and columns; in ``text`` each span, or run of overlapping spans, is replaced by the mask.

    Null texts stay null.
    """
    text = F.coalesce("text", F.lit(""))
    spans = docs.withColumn("__base", base_spans(text)).withColumn("__more", _entropy_spans(text, WINDOW, allowed))
    spans = spans.withColumn("__spans", F.array_sort(F.concat("__base", "__more")))
    return spans.withColumn("text", _masked(F.col("text"), F.col("__spans"), mask)).drop("__base", "__more", "__spans")


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text is cut at the ends of blocks of spans, so that no place is searched from the begin of a long text."""

    def cover(acc: Column, s: Column) -> Column:
        before = F.substring(acc["chunk"], acc["at"] - acc["origin"] + 1, s["start"] - acc["at"])
        return F.struct(
            acc["chunk"].alias("chunk"), acc["origin"].alias("origin"), F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.array_append(acc["out"], F.concat(before, F.lit(mask)))).otherwise(acc["out"]).alias("out"),
        )

    nothing = F.array().cast("array<string>")

    def follow(acc: Column, i: Column) -> Column:
        block = F.slice(spans, i, BLOCK)
        stop = F.greatest(acc["at"], F.array_max(F.transform(block, lambda s: s["end"])))
        begin = F.struct(
            F.substring(acc["rest"], F.lit(1), stop - acc["at"]).alias("chunk"), acc["at"].alias("origin"), acc["at"].alias("at"), nothing.alias("out"),
        )
        done = F.aggregate(block, begin, cover, lambda end: F.array_join(end["out"], ""))
        return F.struct(
            F.substring(acc["rest"], stop - acc["at"] + 1, F.char_length(acc["rest"])).alias("rest"), stop.alias("at"),
            F.array_append(acc["out"], done).alias("out"),
        )

    begin = F.struct(text.alias("rest"), F.lit(0).alias("at"), nothing.alias("out"))
    firsts = F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK))
    masked = F.aggregate(firsts, begin, follow, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))
    return F.when(F.size(spans) > 0, masked).otherwise(text)
