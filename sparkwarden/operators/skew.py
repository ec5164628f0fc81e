"""Joins and running totals that hold up when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

ROWS_PER_SALT = 1_000_000
#: At most so many keys are split.  A key beyond them has less than this share of the rows, so even on as
#: many cores it is no more than one core's even part; see ``hot_in``.
HOT_KEYS = 10_000
TRACKED_KEYS = 2 * HOT_KEYS
SKETCHES = 256
#: For ``few_rows`` where the right side is short by nature, as accounts are: so many rows at most are sent to every task.
FEW_ROWS = 10_000


def key_sketches(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``part, sketch, n``: frequent-item sketches of the keys, of fixed size and at most ``SKETCHES`` of them.

    Sketches of parts of a table, such as its versions, may be kept beside it and united: ``hot_in`` merges
    them, so the keys of a table are counted once, when it is written.
    """
    return (
        df.select(F.xxhash64(*keys).alias("h"), (F.spark_partition_id() % SKETCHES).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(h, {TRACKED_KEYS})").alias("sketch"), F.count("*").alias("n"))
    )


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT) -> list[tuple[int, int, int]]:
    """The hot keys of a table, counted now."""
    return hot_in(key_sketches(df, keys), rows_per_salt)


def hot_in(sketches: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> list[tuple[int, int, int]]:
    """Hash, rows and salts of each key that has too many rows for one task.

    Too many is more than ``rows_per_salt``, or than an even share of ``HOT_KEYS`` tasks if that is more; so the
    list can't be longer than ``HOT_KEYS``, whatever the number of rows.  Frequent-item sketches of fixed size,
    merged in two steps, find the keys: no shuffle of keys.  The list only steers where rows go, never which
    rows are joined.
    """
    # grouped, because combining no sketches at all fails
    merged = sketches.groupBy((F.col("part") * 0).alias("all")).agg(
        F.expr(f"approx_top_k_combine(sketch, {TRACKED_KEYS})").alias("sketch"), F.sum("n").alias("total")
    )
    top = merged.select("total", F.expr(f"inline(approx_top_k_estimate(sketch, {HOT_KEYS}))").alias("h", "n"))
    limit = F.greatest(F.lit(rows_per_salt), F.ceil(F.col("total") / HOT_KEYS))
    found = top.where(F.col("n") > limit).select("h", "n", F.ceil(F.col("n") / limit).cast("int").alias("salts"))
    return [(r.h, r.n, r.salts) for r in found.collect()]


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_on: Sequence[str],
    rows_per_salt: int = ROWS_PER_SALT, counted: DataFrame | None = None, how: str = "inner",
    sketches: DataFrame | None = None, few_rows: int = 0,
) -> DataFrame:
    """Inner or left equi-join whose hot left keys are split over salts.

    If the right side has ``few_rows`` at most, hot keys need no salts: the left side stays where it is.  With 0 nobody looks.

    Rows of ``right`` for a hot key are repeated once per salt, but never into more rows than the left side has for
    the key; ``spread_on`` are columns that vary within a hot key, hashed so that a repeated task sends each
    row to the same place.  Without hot keys this is a plain join, and Catalyst broadcasts the right side if
    its size allows.  ``counted`` is a table whose keys are cheaper to count than those of ``left``; nothing is
    counted if ``sketches`` of its keys are given.
    """
    if sketches is None:
        sketches = key_sketches(left if counted is None else counted, keys)
    hot = hot_in(sketches, rows_per_salt)
    if not hot:
        return left.join(right, list(keys), how)
    if few_rows and right.limit(few_rows + 1).count() <= few_rows:
        return left.join(F.broadcast(right), list(keys), how)
    # At most HOT_KEYS rows of three numbers, so the broadcasts below are bounded.
    spark = left.sparkSession
    table = spark.createDataFrame(hot, "h long, n long, salts int")
    matches = right.select(F.xxhash64(*keys).alias("h")).join(F.broadcast(table.select("h")), "h")
    copied = table.join(matches.groupBy("h").agg(F.count("*").alias("m")), "h", "left").select(
        "h", F.least("salts", F.greatest(F.lit(1), F.floor(F.col("n") / F.coalesce("m", F.lit(1))))).cast("int").alias("salts")
    )
    salts = F.broadcast(spark.createDataFrame([tuple(r) for r in copied.collect()], "salt_key long, salts int"))

    def with_salts(df: DataFrame) -> DataFrame:
        return df.withColumn("salt_key", F.xxhash64(*keys)).join(salts, "salt_key", "left").drop("salt_key")

    n_salts = F.coalesce("salts", F.lit(1))
    salted = with_salts(left).withColumn("salt", F.pmod(F.xxhash64(*spread_on), n_salts).cast("int")).drop("salts")
    copies = with_salts(right).withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts - 1))).drop("salts")
    return salted.join(copies, [*keys, "salt"], how).drop("salt")


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """The row that comes first in ``order`` for every key.

    An aggregate, not a window: each task keeps one row per key before anything is shuffled, so
    many copies of one key cost nothing.  Keys given by name, and columns of the order, travel once.
    """
    plain = [k for k in keys if isinstance(k, str)]
    named = [k if isinstance(k, str) else k.alias(f"key_{i}") for i, k in enumerate(keys)]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    maps = [c for c, kind in kinds.items() if isinstance(kind, T.MapType)]
    rest = [c for c in df.columns if c not in plain and c not in order]
    # maps have no order, their entries do; rows that the order leaves equal come by their other columns
    value = [F.col(c) for c in order if c not in plain] + [F.map_entries(c).alias(c) if c in maps else F.col(c) for c in rest]
    back = [c if c in plain else F.map_from_entries(f"row.{c}").alias(c) if c in maps else F.col(f"row.{c}") for c in df.columns]
    return df.groupBy(*named).agg(F.min(F.struct(*value)).alias("row")).select(*back)


def running_totals(
    df: DataFrame, group: Sequence[str], position: str, values: dict[str, str], block: int = 4_096
) -> DataFrame:
    """Running sums of ``values`` (column -> output name) along a dense ``position`` in each group.

    Sums inside blocks of positions, plus the running sums over block totals, which are found in the same
    way; so never more than ``block`` rows of a group meet in one task, however many it has.
    """
    whole = {c: f"whole_{out}" for c, out in values.items()}
    at = f"{position}_block"
    blocked = df.withColumn(at, F.floor(F.col(position) / block))
    totals = blocked.groupBy(*group, at).agg(*[F.sum(c).alias(total) for c, total in whole.items()])
    farthest = totals.agg(F.max(at)).first()[0] or 0
    through = {total: f"through_{total}" for total in whole.values()}
    if farthest >= block:
        running = running_totals(totals, group, at, through, block)
    else:
        along = W.partitionBy(*group).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
        running = totals.select("*", *[F.sum(total).over(along).alias(out) for total, out in through.items()])
    offsets = running.select(
        *group, at,
        *[(F.col(through[whole[c]]) - F.col(whole[c])).alias(f"offset_{out}") for c, out in values.items()],
    )
    inside = W.partitionBy(*group, at).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return blocked.join(offsets, [*group, at]).select(
        *df.columns,
        *[
            (F.col(f"offset_{out}") + F.sum(c).over(inside)).cast(T.LongType()).alias(out)
            for c, out in values.items()
        ],
    )
