"""Approximate nearest neighbours by inner product: inverted lists and adaptive dimension scans.

Fit: on a bounded sample (``SAMPLE`` vectors, the smallest hashes of ids) k-means gives the list centres, and
the number of probed lists is the smallest with which the sample's own nearest neighbours would be found
with a share of ``FOUND``.  All vectors are indexed: each goes into the list of its nearest centre.

The largest inner product becomes the smallest distance once every vector has one more component,
``sqrt(M**2 - |x|**2)`` with the largest norm ``M`` (0 for queries); the result is rotated at random, so that the first
components of a difference tell about its length.

Search: a query first scans its nearest list, which yields a distance to beat, then its other lists.  In
a list, partial distances grow block of columns by block of columns.  After each block a hypothesis test
drops the candidates whose distance, extrapolated from the columns seen, exceeds the one to beat by more
than chance allows; what is left is scored on the original vectors in double precision.

Lists and the queries that probe them are cut into blocks, and each block of queries meets each block of the
list; tasks are bounded whatever the size of a list.  Vectors that can't be compared take no part
(see ``vectors.usable``); ties go to the smaller id; with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import release, stage
from .vectors import drawn, rotation, usable

SAMPLE, LISTS, ROUNDS = 16_384, 128, 8
FOUND = 0.97
COLUMNS = 8
CHANCE = 2.1  # the test errs with a chance that falls exponentially in the square of this
LIST_BLOCK, QUERY_BLOCK = 8192, 1024


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centres, up to a constant of each row."""
    return (centres**2).sum(1) - 2 * x @ centres.T


def _fit(sample: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """List centres, and the number of lists to probe so that a share of FOUND of the ``k`` nearest is met."""
    lists = max(1, min(LISTS, len(sample) // 32))
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _nearest(sample, centres).argmin(1)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    own = _nearest(sample, centres).argmin(1)
    asked = sample[:: max(1, len(sample) // 512)].copy()
    asked[:, -1] = 0  # as queries have it
    place = _nearest(asked, centres).argsort(1).argsort(1)
    far = np.argsort((sample**2).sum(1) - 2 * asked @ sample.T, axis=1)[:, : k + 1]
    need = np.take_along_axis(place, own[far], 1)
    return centres, int(np.quantile(need, FOUND, method="higher")) + 1


def _augmented(vectors: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, largest**2 - (vectors**2).sum(1)))
    return np.column_stack([vectors, rest])


def _scan(turn: np.ndarray, largest: float, k: int) -> Callable:
    """Best ``k`` of a block of a list for a block of queries."""
    width = len(turn)

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        if not len(vectors) or not len(queries):
            return out
        ids, asked = vectors["id"].to_numpy(), queries["query_id"].to_numpy()
        x, q = np.stack(vectors["vector"]), np.stack(queries["vector"])
        beat = queries["beat"].to_numpy()  # largest distance that is still of interest, squared
        xr = _augmented(x, largest) @ turn
        qr = np.column_stack([q, np.zeros(len(q))]) @ turn
        found = []
        step = max(1, (1 << 20) // len(x))
        for at in range(0, len(q), step):
            part, limit = qr[at : at + step], beat[at : at + step]
            near = np.zeros((len(part), len(x)))
            alive = None
            for c in range(0, width, COLUMNS):
                a, b = part[:, c : c + COLUMNS], xr[:, c : c + COLUMNS]
                seen = min(c + COLUMNS, width)
                if alive is None:  # most candidates are left: whole blocks
                    near += (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T
                else:
                    near += ((a[alive[0]] - b[alive[1]]) ** 2).sum(1)
                if seen < width:
                    most = limit * (seen / width) * (1 + CHANCE / np.sqrt(seen)) ** 2
                else:
                    most = limit * (1 + 1e-9) + 1e-9
                if alive is None:
                    left = near <= most[:, None]
                    if seen == width or left.mean() < 0.2:
                        alive = np.nonzero(left)
                        near = near[alive]
                else:
                    left = near <= most[alive[0]]
                    alive, near = (alive[0][left], alive[1][left]), near[left]
            one, two = alive
            own = asked[at + one] != ids[two]
            one, two = one[own] + at, two[own]
            score = (q[one] * x[two]).sum(1)
            order = np.lexsort((ids[two], -score, one))
            one, two, score = one[order], two[order], score[order]
            rank = np.arange(len(one)) - np.searchsorted(one, one)
            best = rank < k
            found.append(pd.DataFrame({"query_id": asked[one[best]], "id": ids[two[best]], "score": score[best]}))
        return pd.concat([out, *found])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest found for every row for which ``queries`` holds."""
    rows = usable(vectors, key, column)
    sample = drawn(rows, SAMPLE)
    if not len(sample):
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    largest = float(rows.agg(F.max(norm)).first()[0]) ** 0.5
    fitted = _augmented(sample, largest)
    centres, probes = _fit(fitted, k)
    turn = rotation(fitted.shape[1], 9)

    def assign(frames):
        for f in frames:
            x = np.stack(f["vector"]) if len(f) else np.zeros((0, len(turn) - 1))
            f["list"] = _nearest(_augmented(x, largest), centres).argmin(1).astype("int32") if len(f) else []
            yield f[["id", "list", "vector"]]

    def probe(frames):
        for f in frames:
            if len(f):
                x = np.stack(f["vector"])
                lists = _nearest(np.column_stack([x, np.zeros(len(x))]), centres).argsort(1, kind="stable")[:, :probes]
                f["lists"] = list(lists.astype("int32"))
                yield f[["id", "vector", "lists"]]

    indexed = stage(rows.mapInPandas(assign, "id long, list int, vector array<double>"), "lists")
    asked = stage(
        rows.where(queries).mapInPandas(probe, "id long, vector array<double>, lists array<int>").withColumnRenamed("id", "query_id"), "queries"
    )
    sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("parts"))

    def blocked(probing: DataFrame) -> DataFrame:
        """Blocks of queries against blocks of the lists they probe."""
        parts = sizes.join(
            probing.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("turns")), "list"
        )
        keys = ["list", "part", "turn"]

        def every(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        some = indexed.join(parts, "list").select(
            "id", "list", "vector", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), every("turns").alias("turn")
        )
        who = probing.join(parts, "list").select(
            "query_id", "list", "vector", "beat", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("turn"), every("parts").alias("part")
        )
        return some.groupBy(*keys).cogroup(who.groupBy(*keys)).applyInPandas(_scan(turn, largest, k), "query_id long, id long, score double")

    none = F.lit(float("inf"))
    first = stage(_top(blocked(asked.select("query_id", "vector", F.col("lists")[0].alias("list"), none.alias("beat"))), k), "found")
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    limits = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
    others = asked.join(limits, "query_id", "left").select(
        "query_id", "vector", F.explode(F.slice("lists", 2, probes)).alias("list"),
        F.coalesce(length + F.lit(largest**2) - 2 * F.col("worst"), none).alias("beat"),
    )
    rest = stage(blocked(others), "found")
    release(indexed, asked)
    return _top(first.drop("rank").unionByName(rest), k)
