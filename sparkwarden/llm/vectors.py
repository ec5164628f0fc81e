"""Vectors that can be compared, and their form in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _finite(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``id, vector`` of the rows with an id and a vector that is neither empty nor zero and whose components are all finite."""
    v = F.col("vector")
    kind = vectors.schema[column].dataType.simpleString()
    kept = F.col(column) if kind == "array<float>" else F.col(column).cast("array<double>")
    return vectors.select(F.col(key).cast("long").alias("id"), kept.alias("vector")).where(
        F.col("id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )


def _sizes(rows: DataFrame) -> DataFrame:
    """Rows and ids of each length, the most frequent one first (the smaller length, if two are equally frequent)."""
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))
    return sizes.orderBy(F.desc("rows"), "n")


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``id, vector`` of the rows that can take part.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do vectors of another length than most have (the smaller length, if two are equally
    frequent).  Of rows that repeat an id the smallest vector stands.
    """
    rows = _finite(vectors, key, column)
    usual = _sizes(rows).first()
    if usual is None:
        return rows
    rows = rows.where(F.size("vector") == usual.n)
    return rows if usual.rows == usual.ids else rows.groupBy("id").agg(F.min("vector").alias("vector"))


def comparable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """As ``usable``, but vectors of all lengths take part, of which an id has one.

    Of rows that repeat an id a vector of the length that most rows have stands if there is one, and of several
    the smallest.
    """
    rows = _finite(vectors, key, column)
    usual = _sizes(rows).first()
    if usual is None or rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    first = F.min(F.struct((F.size("vector") != usual.n).alias("other"), "vector"))
    return rows.groupBy("id").agg(first.alias("first")).select("id", "first.vector")


def matrix(lists: pa.Array) -> np.ndarray:
    """One row of doubles per vector; all have the same length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def drawn(rows: DataFrame, n: int) -> np.ndarray:
    """The ``n`` vectors with the smallest hashes of ids, one row of doubles each."""
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("vector").toArrow().column("vector")
    return matrix(taken.combine_chunks()) if len(taken) else np.zeros((0, 1))


def rotation(n: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))
