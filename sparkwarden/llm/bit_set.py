"""Sets of ids as bits of hashes, so that rows with large texts move only if they may meet an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: so many rows at most are broadcast, whatever the number of ids; the fuller they are, the more they let through.
WORDS = 1 << 19


def _place(key: str) -> tuple[Column, Column]:
    """Word of a key, and its bit there."""
    place = F.xxhash64(F.col(key).cast("long")).bitwiseAND(F.lit(64 * WORDS - 1))
    return F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")


def parted(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is certainly none of the ids (the only column), and all others; no row is moved for it.

    Both together are the rows, so a join of the others with the ids is exact.  ``rows`` and ``ids`` are read
    more than once: they should be cheap to read.
    """
    word, bit = _place(ids.columns[0])
    words = ids.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    word, bit = _place(key)
    met = rows.join(F.broadcast(words), word == F.col("__word"), "left")
    told = F.coalesce(F.getbit("__bits", bit), F.lit(0)) == 1
    return met.where(~told).select(*rows.columns), met.where(told).select(*rows.columns)
