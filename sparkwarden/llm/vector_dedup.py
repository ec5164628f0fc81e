"""Near-duplicate vectors: all pairs, compared in tiles.

1. Equal vectors form a class; its smallest id stands for it.
2. Classes are dealt over blocks by hashes of their ids, and every pair of blocks is one cell, so each pair of classes
   meets in exactly one cell.  There are as many blocks as keep all cores busy, or more if a block would hold over
   ``BLOCK_BYTES`` of vectors; a task holds two blocks, and of their products one tile (``BLOCK`` x ``BLOCK``) at a time.
3. A tile is multiplied in single precision.  Only rows and columns with a product that may reach the limit, as the bound
   of its rounding tells, are multiplied again in double precision; pairs at the limit are judged by sums without
   rounding.  No pair leaves the task, only counts of links and, for each vector, the smallest id that it is
   connected with inside the cell, over one link or many.
4. Components come from alternating large-star and small-star.

The work is quadratic in the number of distinct vectors; memory of a task is not.  Only vectors of the same length are compared.
Vectors that can't be compared (see ``vectors.comparable``) link with nothing and get a row of their own.  Rows without
an id are left out; of rows that repeat an id a vector of the length that most have stands, the smallest of those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import release, stage
from .vectors import comparable, matrix

BLOCK = 1024
BLOCK_BYTES = 32 << 20
#: Blocks are at least so many that this many cells stand ready for each core.
CELLS_PER_CORE = 8
#: Products so close to the limit are judged by ``_cosine``; rounding is far smaller.
CLOSE = 1e-11

_MEMBERS = "id long, links long, least long"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of the given vectors, not scaled ones, with exact sums; the order of the two plays no part."""
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (a, b))  # by powers of two, against overflow
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _root(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    top = parent[at]
    while ((up := parent[top]) != top).any():
        top = up
    parent[at] = top
    return top


def _connect(parent: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Every tree of places that an edge leads out of is hung below the smallest root it leads to, until none does."""
    while len(one):
        a, b = _root(parent, one), _root(parent, two)
        apart = a != b
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class _Side:
    """The vectors of one block: as given, and as single-precision unit vectors."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("id").combine_chunks()
        self.ids, self.copies = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
        self.vectors = rows.column("vector").combine_chunks()
        self.links = np.zeros(len(self.ids), np.int64)
        self.units = [_unit(self.given(at, at + BLOCK)).astype(np.float32) for at in range(0, len(self.ids), BLOCK)]

    def given(self, begin: int, end: int) -> np.ndarray:
        return matrix(self.vectors[begin:end])


def _tile(a: np.ndarray, b: np.ndarray, given: tuple, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows and columns of a tile that may have a link, and which of these are linked."""
    product = a @ b.T
    low = cosine - (a.shape[1] + 8) * 2.0**-23  # each product is off by less
    if product.max() < low:
        return None
    may = product >= low
    rows, columns = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    x, y = (side.given(at, at + BLOCK)[which] for (side, at), which in zip(given, (rows, columns)))
    exact = _unit(x) @ _unit(y).T
    linked = exact >= cosine
    for i, j in np.argwhere(np.abs(exact - cosine) <= CLOSE):
        linked[i, j] = _cosine(x[i], y[j]) >= cosine
    return rows, columns, linked


def _compare(cosine: float):
    """Links between the two blocks of a cell, or inside its one block."""

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        side = cell.column("side").to_numpy()
        sides = [_Side(cell.filter(pa.array(side == k)).select(["id", "copies", "vector"])) for k in np.unique(side)]
        # a cell of two blocks of which one is empty has nothing to compare
        pairs = [(sides[0], sides[0])] if side[0] == 0 else [(sides[0], sides[1])] if len(sides) == 2 else []
        ids = np.concatenate([s.ids for s in sides])
        parent, start = np.arange(len(ids)), [0, len(sides[0].ids)]
        for one, two in pairs:
            same, offset = one is two, start[one is not two]
            for p, a in enumerate(one.units):
                for q, b in enumerate(two.units):
                    if same and q < p:
                        continue
                    at, to = p * BLOCK, q * BLOCK
                    if (found := _tile(a, b, ((one, at), (two, to)), cosine)) is None:
                        continue
                    rows, columns, linked = found
                    rows, columns = rows + at, columns + to
                    if same:
                        linked &= rows[:, None] != columns
                    one.links[rows] += linked @ two.copies[columns]
                    if not (same and p == q):  # in a tile of a block with itself each pair was seen from both sides
                        two.links[columns] += one.copies[rows] @ linked
                    i, j = np.nonzero(linked)
                    _connect(parent, rows[i], columns[j] + offset)
        links = np.concatenate([s.links for s in sides])
        # parents are smaller places; ids ascend within a side only, so a tree's smallest id is looked up
        root = _root(parent, np.arange(len(ids)))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        has = links > 0
        return pa.table({"id": ids[has], "links": links[has], "least": least[root][has]})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept`` of every row with an id.

    Two vectors are linked if their cosine, in double precision, is at least ``cosine``.
    """
    every = vectors.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct()
    rows = stage(comparable(vectors, key, column), "vectors")
    zero = F.lit(0).cast("long")
    classes = stage(rows.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    size = 8 * (classes.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(size / BLOCK_BYTES), math.ceil(math.sqrt(2 * CELLS_PER_CORE * cores)))
    block, other = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = classes.select(F.col("rep").alias("id"), "copies", "vector", block.alias("block"), other.alias("with")).select(
        F.size("vector").alias("size"), F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"),
        F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2).alias("side"),
        "id", "copies", "vector",
    )
    keys = ["size", "one", "two"]
    found = stage(cells.repartition(blocks * (blocks + 1) // 2, *keys).groupBy(*keys).applyInArrow(_compare(cosine), _MEMBERS), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    final = stage(components(found.select("id", "least")), "components")
    out = (
        rows.join(classes, "vector").select("id", "rep", "copies")
        .join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "id", (F.coalesce("links", zero) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
        )
    )
    out = stage(out, "result")
    release(rows, classes, found, final)
    alone = every.join(out, "id", "left_anti").select("id", zero.alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("id") == F.col("component_id"))
