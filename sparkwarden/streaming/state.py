"""Keyed state of streams that plain streaming operators can't keep: updated seen sets, first findings with timers.

State lives in RocksDB, one value per key; Spark partitions it by key and restores it after a failure together with the
stream's offsets.  A processor handles the new rows of one key, which it reads one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import jobs


class MarkSeen(StatefulProcessor):
    """Per key the first value of some columns that isn't null and the last of others, each row of input an upsert.

    Of the rows of one batch the smallest value is the first one, as in the batch operator.
    """

    def __init__(self, keys: Sequence[str], first: Sequence[str], last: Sequence[str], forget_after_ms: int | None):
        self.keys, self.first, self.last, self.ttl = list(keys), list(first), list(last), forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = ", ".join(f"{c} string" for c in [*self.first, *self.last])
        self.seen = handle.getValueState("seen", schema, self.ttl)

    def handleInitialState(self, key: tuple, row: Row, timerValues) -> None:
        self.seen.update(tuple(row[c] for c in [*self.first, *self.last]))

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        smallest, largest = [None] * len(self.first), [None] * len(self.last)
        for row in rows:
            smallest = [_least(a, row[c]) for a, c in zip(smallest, self.first)]
            largest = [_most(a, row[c]) for a, c in zip(largest, self.last)]
        before = self.seen.get() if self.seen.exists() else None
        old = before[: len(self.first)] if before is not None else [None] * len(self.first)
        kept = tuple(b if a is None else a for a, b in zip(old, smallest))
        value = (*kept, *largest)
        self.seen.update(value)
        named = dict(zip([*self.keys, *self.first, *self.last], [*key, *value]))
        yield Row(**named, is_new=before is None)

    def close(self) -> None:
        pass


def _least(a, b):
    return b if a is None or (b is not None and b < a) else a


def _most(a, b):
    return b if a is None or (b is not None and b > a) else a


def mark_seen(
    listed: DataFrame, keys: Sequence[str], first: Sequence[str], last: Sequence[str], seen: DataFrame | None = None,
    forget_after_ms: int | None = None,
) -> DataFrame:
    """Each key that a batch lists, with its state after it and whether it ``is_new``.

    ``seen`` is what is known before the stream begins.  With ``forget_after_ms`` a key that is not listed for so long
    is forgotten; without, the state grows with the keys, and Spark's own aggregates keep it.
    """
    jobs.keep_state_on_disk(listed.sparkSession)
    if not forget_after_ms:
        return _aggregated(listed, list(keys), list(first), list(last), seen)
    kinds = {f.name: f.dataType.simpleString() for f in listed.schema.fields}
    columns = [*keys, *first, *last]
    schema = ", ".join(f"{c} {kinds[c] if c in keys else 'string'}" for c in columns)
    grouped = listed.select(*keys, *(F.col(c).cast("string") for c in (*first, *last))).groupBy(*keys)
    start = None
    if seen is not None:
        start = seen.select(*(F.col(c).cast(kinds[c]) for c in keys), *(F.col(c).cast("string") for c in (*first, *last))).groupBy(*keys)
    processor = MarkSeen(keys, first, last, forget_after_ms)
    mode = "processingTime" if forget_after_ms else "None"
    return grouped.transformWithState(processor, f"{schema}, is_new boolean", "Update", mode, start)


def _aggregated(listed: DataFrame, keys: list[str], first: list[str], last: list[str], seen: DataFrame | None) -> DataFrame:
    """As ``MarkSeen`` without forgetting.  Batches are told apart by their time, the same if a batch runs again."""
    text = lambda c: F.col(c).cast("string")
    timed = lambda c: F.struct("batch_time", F.col(c).alias("value"))
    rows = listed.select(*keys, *(text(c).alias(c) for c in (*first, *last)), F.current_timestamp().alias("batch_time"))
    met = rows.groupBy(*keys).agg(
        *[F.min(F.when(F.col(c).isNotNull(), timed(c)))["value"].alias(c) for c in first],
        *[F.max(timed(c))["value"].alias(c) for c in last],
        (F.min("batch_time") == F.max("batch_time")).alias("is_new"),
    )
    if seen is None:
        return met
    kinds = {f.name: f.dataType.simpleString() for f in listed.schema.fields}
    known = seen.groupBy(*[F.col(k).cast(kinds[k]).alias(f"seen_{k}") for k in keys]).agg(
        *[F.min(text(c)).alias(f"seen_{c}") for c in first], F.lit(True).alias("known")
    )
    joined = met.join(known, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"seen_{k}")) for k in keys]), "left")
    return joined.select(
        *keys, *[F.coalesce(f"seen_{c}", c).alias(c) for c in first], *last, (F.col("is_new") & F.col("known").isNull()).alias("is_new")
    )


def seen_table(updates: DataFrame, keys: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """The table that the updates of all batches leave: their last row per key, and keys never listed as they were."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id", "is_new")]
    last = updates.groupBy(*keys).agg(*(F.max_by(c, "batch_id").alias(c) for c in rest))
    if seen is None:
        return last
    return last.unionByName(seen.select(*last.columns).join(last.select(*keys), list(keys), "left_anti"))


class FirstInOrder(StatefulProcessor):
    """Per key the row that comes first in an order; it is given out when the watermark has passed the key's wait."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], time: str, wait_ms: int, schema: str):
        self.columns, self.order, self.time = list(columns), list(order), time
        self.wait_ms, self.schema = wait_ms, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)

    def _place(self, row: Sequence) -> tuple:
        named = dict(zip(self.columns, row))
        return tuple((named[c] is not None, named[c]) if named[c] is not None else (False,) for c in self.order)

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        best = tuple(self.best.get()) if self.best.exists() else None
        until = None
        for row in rows:
            value = tuple(row[c] for c in self.columns)
            if best is None or self._place(value) < self._place(best):
                best = value
            at = int(row[self.time].timestamp() * 1000) + self.wait_ms
            until = at if until is None else min(until, at)
        if not self.best.exists():
            self.handle.registerTimer(until)
        self.best.update(best)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.best.exists():
            yield Row(**dict(zip(self.columns, self.best.get())))
            self.best.clear()

    def close(self) -> None:
        pass


def first_findings(findings: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, delay: str, wait_ms: int) -> DataFrame:
    """The first finding of each key in ``order``, once the watermark is ``wait_ms`` beyond the key's first event time.

    Rows of a key may arrive in any order until then.  State is freed when a finding is given out, so it holds only keys
    that still wait; a key that shows up later than that is a new one.
    """
    jobs.keep_state_on_disk(findings.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.schema.fields)
    grouped = findings.withWatermark(time, delay).groupBy(*keys)
    return grouped.transformWithState(FirstInOrder(findings.columns, order, time, wait_ms, schema), schema, "Append", "EventTime")
