"""Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf.  Leaves are numbered within their group; while a group has several nodes, every ``arity``
consecutive ones (the last run may be shorter, even one) become the digest of their concatenated digests.  What
remains is the group's subroot; the subroots, in the order of the groups, are the leaves of one more such tree.

1. *Numbering.*  Leaves are sorted by ranges of (group, order, leaf, row), so a group of any size is spread over
   many tasks.  A place is the offset of a (range, group) among the ranges plus the place inside it.
2. *Levels.*  Each node with a sibling in slot zero is shifted to that sibling's index (``at XOR 1`` for binary trees,
   less its slot otherwise) and equijoined with the node that stands there.  Rows in slot zero, which then hold their
   whole run, emit the parent and hand the run on.  Keys (group, index) are unique.
3. *Proofs.*  From the top down each node meets its parent, whose run less the node are its siblings and whose path
   follows them; so a leaf is moved once, and a run and a path are held once per parent.

Digests travel as 32 bytes.  Nothing but the size of the largest group and the root reaches the driver.

Nulls: a null field is hashed as ``-``, which no other value gives; null groups are one group, the first; rows
without an order value come first within their group.  Rows that repeat an order value are ordered by their digests, equal
rows are leaves of their own.  Empty and very long values are hashed whole.  An empty table has no leaves and no root.
Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import release, stage

ARITY = 16
_EMPTY = b""


def field(column: Column) -> Column:
    """A value as ``-`` (null) or its size in bytes, a colon and itself, so that no two rows give one text."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*columns: Column) -> Column:
    """The SHA-256 of a row's fields in lowercase hexadecimal digits."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows with ``g`` (number of their group), ``at`` (place within it) and ``n`` (its size), staged."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = stage(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "sorted")
    parts = stage(ranged.groupBy("__part", group).agg(F.min("__seq").alias("__first"), F.count("*").alias("__size")), "ranges")
    # At most one row per range and group.
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    sizes = parts.groupBy(group).agg(F.sum("__size").alias("n"))
    numbers = _ordered(sizes.select(group), group).withColumnRenamed(group, "__key")
    sizes = sizes.join(numbers, F.col(group).eqNullSafe(F.col("__key"))).drop("__key").withColumnRenamed(group, "__key")
    offsets = offsets.join(sizes, F.col(group).eqNullSafe(F.col("__key"))).drop("__key")
    offsets = offsets.select(F.col("__part").alias("__p"), F.col(group).alias("__key"), "__first", "__offset", "g", "n")
    joined = ranged.join(offsets, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__key")))
    at = F.col("__offset") + F.col("__seq") - F.col("__first")
    out = stage(joined.withColumn("at", at).drop("__part", "__seq", "__p", "__key", "__first", "__offset"), "numbered")
    release(ranged, parts)
    return out


def _ordered(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys with their place ``g`` in ascending order, null first."""
    ranged = keys.repartitionByRange(key).sortWithinPartitions(key)
    ranged = stage(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "groups")
    parts = ranged.groupBy("__part").agg(F.min("__seq").alias("__first"), F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = parts.select(F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    joined = ranged.join(parts, F.col("__part") == F.col("__p"))
    return joined.select(key, (F.col("__offset") + F.col("__seq") - F.col("__first")).alias("g"))


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    """``g, at, n, digest, run`` of the level above, where ``run`` holds the digests of the children."""
    at, slot = F.col("at"), F.col("at") % arity
    first = at.bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else at - slot
    told = nodes.where(slot > 0).select(
        F.col("g").alias("__g"), first.alias("__to"), F.struct(slot.cast("int").alias("slot"), F.col("digest").alias("other")).alias("__sibling")
    )
    zero = nodes.where(slot == 0).select("g", "at", "n", "digest")
    joined = zero.join(told, (F.col("g") == F.col("__g")) & (at == F.col("__to")), "left")
    runs = joined.groupBy("g", "at").agg(F.first("n").alias("n"), F.first("digest").alias("digest"), F.array_sort(F.collect_list("__sibling")).alias("__run"))
    run = F.aggregate("__run", F.col("digest"), lambda a, s: F.concat(a, s["other"]))
    above = runs.select("g", F.floor(at / arity).alias("at"), F.ceil(F.col("n") / arity).alias("n"), run.alias("run"))
    return above.select("g", "at", "n", F.unhex(F.sha2(_hex(F.col("run")), 256)).alias("digest"), "run")


def _levels(nodes: DataFrame, largest: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Staged levels above the nodes, lowest first, and ``g, subroot``."""
    levels, tops = [], nodes.where("n = 1").select("g", F.col("digest").alias("subroot"))
    while largest > 1:
        nodes = stage(_parents(nodes.where("n > 1"), arity), f"level{len(levels) + 1}")
        levels.append(nodes)
        tops = tops.unionByName(nodes.where("n = 1").select("g", F.col("digest").alias("subroot")))
        largest = -(-largest // arity)
    return levels, tops


def _under(nodes: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``path``: the parent's run less the node, then the parent's path."""
    joined = nodes.withColumn("__up", F.floor(F.col("at") / arity)).join(above.withColumnRenamed("run", "__run"), ["g", "__up"])
    at = ((F.col("at") % arity) * 32).cast("int")
    step = F.struct(
        F.substring("__run", F.lit(1), at).alias("left"), F.substring("__run", at + 33, F.octet_length("__run")).alias("right")
    )
    return joined.withColumn("path", F.concat(F.array(step), "path")).drop("__up", "__run")


def _paths(nodes: DataFrame, levels: list[DataFrame], tails: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``path``, their own siblings first; ``tails`` are the paths of the groups."""
    above, held = None, None
    for level in reversed(levels):
        rows = level.where("n = 1").join(tails, "g")
        if above is not None:
            rows = rows.unionByName(_under(level.where("n > 1"), above, arity).select(*rows.columns))
        above = stage(rows.withColumnRenamed("at", "__up").drop("n", "digest"), "paths")
        if held is not None:
            release(held)
        held = above
    lone = nodes.where("n = 1").join(tails, "g")
    return lone if above is None else lone.unionByName(_under(nodes.where("n > 1"), above, arity).select(*lone.columns))


@dataclass
class Manifest:
    """``leaves``: the given rows with ``digest``, ``subroot`` and ``path`` (siblings left and right, lowest level first).

    ``subroots`` has the columns ``g, subroot`` in the order of the groups; ``root`` is in hexadecimal digits.
    """

    leaves: DataFrame
    subroots: DataFrame
    root: str | None


def manifest(rows: DataFrame, group: str, order: str, leaf: str, arity: int = ARITY) -> Manifest:
    """The tree over rows with a ``leaf`` digest in hexadecimal digits; leaves ascend by ``order`` within ``group``."""
    rows = rows.select(
        F.struct("*").alias("load"), F.col(group).alias("__group"), F.col(order).alias("__order"), F.col(leaf).alias("__leaf"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = stage(rows, "leaves")
    nodes = _numbered(rows, "__group", "__order", "__leaf", "__row")
    release(rows)
    nodes = nodes.select("g", "at", "n", F.unhex("__leaf").alias("digest"), "load")
    sizes = nodes.agg(F.max("n").alias("n"), F.max("g").alias("g")).first()
    path = F.array().cast("array<struct<left:binary,right:binary>>")
    if sizes.n is None:
        empty = nodes.select("load.*", "digest", F.lit(None).cast("binary").alias("subroot"), path.alias("path"))
        return Manifest(empty, nodes.select("g", F.col("digest").alias("subroot")), None)
    levels, tops = _levels(nodes, sizes.n, arity)
    tops = stage(tops, "subroots")

    # The same once more over the subroots, which are one group.
    above = tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.lit(sizes.g + 1).alias("n"), F.col("subroot").alias("digest"))
    upper, root = _levels(above, sizes.g + 1, arity)
    root = bytes(root.first().subroot).hex()
    nothing = above.limit(1).select("g", path.alias("path"))
    tails = _paths(above, upper, nothing, arity).select(F.col("at").alias("g"), "path")
    tails = stage(tails.join(tops, "g"), "tails")
    release(*upper)

    leaves = _paths(nodes, levels, tails, arity)
    release(*levels)
    return Manifest(leaves.select("load.*", "digest", "subroot", "path"), tops, root)


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    joined = F.aggregate(path, F.lit(_EMPTY), lambda a, s: F.concat(a, s["left"], s["right"]))
    return F.sha2(_hex(joined), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(_hex(s["left"]), a, _hex(s["right"])), 256))
