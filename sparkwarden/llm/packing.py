"""Best-fit packing of tokenized documents into sequences of bounded length, by large-item matching.

1. Every whole text is tokenized and ended by one id; only what exceeds a sequence is cut.
2. The packing looks at the histogram of piece lengths alone, at most one row per length, whatever the
   number of documents.  Pieces above one third of a sequence go at most two to a sequence: from the
   longest down, each is matched with the longest such piece that still fits.  Smaller pieces follow from
   the longest down, each into the smallest gap that takes it.  Equal sequences are handled as one pattern
   with a count, so the plan is a table of rules ``length, ranks from .. to -> sequences``.
3. Pieces are numbered within their length in two steps (blocks of hashed ids, then rows of a block), so a
   length that a third of all pieces have does not meet in one task; the rules then place each piece.

Null or empty texts are one piece with the end id only.  Rows with a null id are left out; rows that repeat
an id are packed one by one.  Only id and text are looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .staging import stage
from .tokens import encoder

#: Pieces of one length that are numbered together.
NUMBERED = 100_000


def _tokenize(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in W.slices(batch, "text", 2 * W.SLICE_BYTES):
                ids, counts = of.ids(part.column(1))
                ends = np.cumsum(counts)
                out = np.empty(len(ids) + len(counts), np.uint32)
                keep = np.ones(len(out), bool)
                keep[ends + np.arange(len(ends))] = False
                out[keep], out[~keep] = ids, end_id
                counts = counts + 1
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                offsets = np.concatenate([[0], np.cumsum(length)]) * 4
                blobs = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
                rows = np.arange(row, row + len(doc))
                row += len(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)),
                     pa.array(length.astype(np.int64)), blobs.cast(pa.binary())],
                    names=["row", "doc_id", "piece", "start", "length", "ids"],
                )

    return run


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) and a number for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return docs.mapInArrow(
        _tokenize(path, capacity, end_id), "row long, doc_id long, piece int, start long, length long, ids binary"
    )


class Rules:
    """Which ranks of a length go where: sequence ``base + (rank - first) // each``, at ``offset`` and on."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = dict(counts)
        self.next_rank = dict.fromkeys(counts, 0)
        self.gaps: list[int] = []  # gaps that some pattern has, ascending
        self.by_gap: dict[int, list[tuple[int, list]]] = {}  # gap: (sequences, slots)
        self.done: list[tuple[int, list]] = []
        self._match_large(capacity)
        self._fit_small(capacity)
        self.rows = []
        base = 0
        for n, slots in self.done + [g for gap in self.gaps for g in self.by_gap[gap]]:
            for size, first, each, offset in slots:
                self.rows.append((size, first, first + n * each, base, each, offset))
            base += n
        self.sequences = base
        self.rows.sort()

    def _take(self, size: int, n: int) -> int:
        first = self.next_rank[size]
        self.next_rank[size] += n
        self.left[size] -= n
        return first

    def _add(self, gap: int, n: int, slots: list) -> None:
        if gap == 0:
            self.done.append((n, slots))
        elif gap in self.by_gap:
            self.by_gap[gap].append((n, slots))
        else:
            self.by_gap[gap] = [(n, slots)]
            insort(self.gaps, gap)

    def _match_large(self, capacity: int) -> None:
        large = sorted(s for s in self.left if 3 * s > capacity)
        while large:
            size = large[-1]
            n = self.left[size]
            at = bisect_left(large, capacity - size + 1) - 1
            while at >= 0 and self.left[large[at]] == 0:
                at -= 1
            other = large[at] if at >= 0 else None
            if other == size and n == 1:
                other = large[at - 1] if at else None
            if other is None:
                self._add(capacity - size, n, [(size, self._take(size, n), 1, 0)])
            elif other == size:
                pairs = n // 2
                self._add(capacity - 2 * size, pairs, [(size, self._take(size, 2 * pairs), 2, 0)])
            else:
                pairs = min(n, self.left[other])
                self._add(
                    capacity - size - other, pairs,
                    [(size, self._take(size, pairs), 1, 0), (other, self._take(other, pairs), 1, size)],
                )
                if not self.left[other]:
                    large.remove(other)
            if not self.left[size]:
                large.pop()

    def _fit_small(self, capacity: int) -> None:
        for size in sorted((s for s in self.left if 3 * s <= capacity), reverse=True):
            while n := self.left[size]:
                at = bisect_left(self.gaps, size)
                if at == len(self.gaps):
                    each = capacity // size
                    self._add(capacity, -(-n // each), [])
                    continue
                gap = self.gaps[at]
                free, slots = self.by_gap[gap].pop()
                each = min(gap // size, n)
                use = min(free, n // each)
                if not self.by_gap[gap]:
                    del self.by_gap[gap], self.gaps[at]
                if free > use:  # the others keep their gap; ranks are dealt out in order
                    self._add(gap, free - use, [(s, f + use * e, e, o) for s, f, e, o in slots])
                self._add(gap - each * size, use, [*slots, (size, self._take(size, use * each), each, capacity - gap)])


def _place(rules: list[tuple[int, ...]]) -> Callable:
    table = np.array(rules, np.int64).reshape(-1, 6)
    lengths, begins = np.unique(table[:, 0], return_index=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = f["rank"].to_numpy()
            rule = np.empty((len(f), 6), np.int64)
            for length, at in f.groupby("length").indices.items():
                i = np.searchsorted(lengths, length)
                own = table[begins[i] : begins[i + 1] if i + 1 < len(begins) else None]
                rule[at] = own[np.searchsorted(own[:, 1], rank[at], side="right") - 1]
            nth, place = np.divmod(rank - rule[:, 1], rule[:, 4])
            yield pd.DataFrame(
                {"row": f["row"], "sequence_id": rule[:, 3] + nth, "offset": rule[:, 5] + place * rule[:, 0]}
            )

    return run


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of every piece."""
    pieces = stage(tokenized_pieces(docs, path, capacity, end_id), "pieces")
    sizes = pieces.select("row", "length")
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rules = Rules(histogram, capacity)
    blocks = -(-max(histogram.values(), default=1) // NUMBERED)
    sizes = sizes.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy("length", "block").agg(F.count("*").alias("n")).select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")
    )
    inside = Window.partitionBy("length", "block").orderBy("row")
    ranked = (
        sizes.withColumn("rank", F.row_number().over(inside) - 1)
        .join(starts, ["length", "block"])
        .select("row", "length", (F.col("rank") + F.col("from")).alias("rank"))
    )
    placed = ranked.mapInPandas(_place(rules.rows), "row long, sequence_id long, offset long")
    return pieces.join(placed, "row").drop("row")
