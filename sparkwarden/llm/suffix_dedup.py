"""Removal of repeated passages: blockwise suffix sorting with a difference cover.

A byte goes if a ``LENGTH``-byte string over it also starts earlier: in a document of smaller id, or earlier
in the same one.  Strings are judged on the input, may overlap and never cross documents.

1. *Suffix buckets.*  Each ``LENGTH``-byte string belongs to the smallest hash among its ``GRAM``-byte grams
   (the leftmost of equals), its anchor.  Equal strings have equal anchors at equal distance, so the hash of
   the anchor names the bucket in which a suffix is sorted.  Consecutive suffixes with one anchor travel as one
   segment.  A bucket with a single segment can't hold a repeat and is not sorted: buckets are counted, and
   those with several segments set a bit in a set of ``FILTER_WORDS`` words, so that few other segments are
   moved to meet their count.  The set is of one size; the fuller it is, the more it lets through.
2. A segment that equals an earlier one of the same batch of rows is a repeat and goes no further, so what
   very many texts share is thinned out where it is read.  A bucket that still has over ``HOT`` segments is not
   sorted in one task: its strings are grouped one by one, by 128 bits of hashes, with pre-aggregation.
3. *Blockwise sort.*  A task takes its buckets block by block, ``BLOCK_BYTES`` of segments at a time.  Segments
   are laid out with their anchors at one residue of the cover's period.  The suffixes at residues of the
   cover are ranked first; all others are sorted by their first 16 bytes, and ties by the rank of the next
   cover suffix, which lies at the same distance in all suffixes of a bucket with the same distance to the
   anchor.  Neighbours that agree in ``LENGTH`` bytes are repeats of the earliest of them.
4. Runs of repeats become byte spans, which are merged per document.  Texts that certainly lose nothing (told by bits
   of the ids with spans) are not moved to meet them.

A text that equals an earlier one is removed whole (if it has ``LENGTH`` bytes) and never sorted.  Null texts
are empty.  Rows with a null id are left out; of rows that repeat an id the smallest text stands.
Only id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .bit_set import parted
from .staging import free_shuffles, one_text_per_id, release, stage

LENGTH, GRAM = 100, 32
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)  # a perfect difference set: each difference modulo 31 occurs once
BLOCK_BYTES = 1 << 20
HOT = 20_000
FILTER_WORDS = 1 << 21

_SPREAD = np.random.default_rng(7).integers(0, 1 << 64, size=256, dtype=np.uint64)
_STEPS = np.random.default_rng(8).integers(0, 1 << 64, size=5, dtype=np.uint64) | np.uint64(1)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first start, number of starts, distance to the anchor and hash of each segment."""
    starts = len(data) - LENGTH + 1
    if starts <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    x = _SPREAD[data]
    for k, c in enumerate(_STEPS):
        x = x[: -(1 << k)] * c + x[1 << k :]
    x = W.mix(x)
    y = (x & _HIGH) | np.arange(len(x), dtype=np.uint64)
    window, k = 1, 1
    while window + k <= LENGTH - GRAM + 1:
        y = np.minimum(y[:-k], y[k:])
        window += k
        k = window
    rest = LENGTH - GRAM + 1 - window
    if rest:
        y = np.minimum(y[:-rest], y[rest:])
    owner = (y & ~_HIGH).astype(np.int64)
    edge = np.zeros(starts + LENGTH, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:starts]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1])
    a = np.flatnonzero(first)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (owner[1:] != owner[:-1])
    n = np.flatnonzero(ends) - a + 1
    text = np.searchsorted(offsets, a, side="right") - 1
    return text, a - offsets[text], n, owner[a] - a, x[owner[a]].view(np.int64)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a buffer, one after the other, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)], offsets


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of a buffer, gathered part by part."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(starts), 1 << 14):
        size = sizes[at : at + (1 << 14)]
        pieces, offsets = _gather(data, starts[at : at + (1 << 14)], size)
        scale = W.powers(_STEPS[0], int(size.max()))
        terms = _SPREAD[pieces] * scale[np.arange(len(pieces)) - np.repeat(offsets[:-1], size)]
        out[at : at + len(size)] = np.add.reduceat(terms, offsets[:-1])
    return W.mix(out + sizes.astype(np.uint64))


_FOUND = "bucket long, doc_id long, place long, end long"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their buckets.

    A segment that equals an earlier one of the same batch is a repeat whatever other documents hold; such
    segments come as spans, without a bucket, so a passage that very many texts share is sent on once.
    """
    for batch in batches:
        data, offsets = W.text_bytes(batch.column(1))
        parts = [[np.zeros(0, np.int64)] * 5]
        row = 0
        for part in W.slices(batch, "text", 1 << 19):
            text, *rest = _anchors(*W.text_bytes(part.column(1)))
            parts.append([text + row, *rest])
            row += len(part)
        text, a, n, off, key = (np.concatenate(x) for x in zip(*parts))
        doc = batch.column(0).to_numpy()[text]
        order = np.argsort(key, kind="stable")
        twice = np.zeros(len(key), bool)
        same = key[order][1:] == key[order][:-1]
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        whole = _hashes(data, offsets[text[at]] + a[at], n[at] + LENGTH - 1)
        order = np.lexsort((a[at], doc[at], whole, key[at]))
        again = np.zeros(len(at), bool)
        one, two = at[order[:-1]], at[order[1:]]
        again[order[1:]] = (key[one] == key[two]) & (whole[order[:-1]] == whole[order[1:]])
        gone = np.zeros(len(key), bool)
        gone[at[again]] = True
        place = a << 16 | n << 8 | off
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[~gone]), pa.array(doc[~gone]), pa.array(place[~gone]), pa.nulls(int((~gone).sum()), pa.int64())],
            names=["bucket", "doc_id", "place", "end"],
        )
        at = np.flatnonzero(gone)  # in the order of texts and starts
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (text[at][1:] != text[at][:-1]) | (a[at][1:] != (a + n)[at][:-1])
            first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(first), pa.int64()), pa.array(doc[first]), pa.array(a[first]), pa.array((a + n)[last] + LENGTH - 1)],
                names=["bucket", "doc_id", "place", "end"],
            )


_SEGMENTS = "bucket long, doc_id long, place long, bytes binary"


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            data, offsets = W.text_bytes(part.column(1))
            row, place, key = _zones(part.column(2))
            pieces, cuts = _gather(data, offsets[row] + (place >> 16), (place >> 8 & 255) + LENGTH - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), part.column(0).take(pa.array(row)), pa.array(place), _binary(pieces, cuts)],
                names=["bucket", "doc_id", "place", "bytes"],
            )


def _single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each string of the given segments, and where it starts."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            data, offsets = W.text_bytes(part.column(1))
            row, place, _ = _zones(part.column(2))
            n = place >> 8 & 255
            of = np.repeat(np.arange(len(row)), n)
            begin = (place[of] >> 16) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start, size = offsets[row[of]] + begin, np.full(len(of), LENGTH)
            back = _hashes(data[::-1], len(data) - start - LENGTH, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_hashes(data, start, size).view(np.int64)), pa.array(back.view(np.int64)),
                 part.column(0).take(pa.array(row[of])), pa.array(begin)],
                names=["one", "two", "doc_id", "begin"],
            )


def _zones(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and bucket of each segment."""
    counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
    return np.repeat(np.arange(len(lists)), counts), flat.field("place").to_numpy(), flat.field("bucket").to_numpy()


_NEXT = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])  # to the next cover residue


def _sort_block(bucket: np.ndarray, place: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of each suffix of whole buckets that repeats an earlier one.

    Rows are ordered by bucket, id and place of the anchor.
    """
    n, off = place >> 8 & 255, place & 255
    sizes = np.diff(offsets)
    # Each segment begins so that its anchor is at residue 0; behind it there is room for a cover suffix.
    room = PERIOD * (-(-(sizes + PERIOD + LENGTH + 8) // PERIOD))
    at = np.cumsum(room) - room + (-off) % PERIOD
    text = np.zeros(int(room.sum()) + LENGTH + 8, np.uint8)
    text[np.arange(offsets[-1]) + np.repeat(at - offsets[:-1], sizes)] = data
    word = text[:-7].astype(np.uint64)  # big-endian words at every place
    for k in range(1, 8):
        word = word << np.uint64(8) | text[k : len(text) - 7 + k]

    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = at[row] + i
    cover = start + _NEXT[start % PERIOD]
    samples, which = np.unique(cover, return_inverse=True)
    keys = [word[samples + k] for k in range(0, LENGTH, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)

    distance = off[row] - i
    order = np.lexsort((row, rank[which], word[start + 8], word[start], distance, bucket[row]))
    row, start, distance = row[order], start[order], distance[order]
    same = (bucket[row][1:] == bucket[row][:-1]) & (distance[1:] == distance[:-1])
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same &= word[start[1:] + k] == word[start[:-1] + k]
    # Ranks look further than LENGTH bytes, so the earliest may stand anywhere in its run.
    begins = np.flatnonzero(np.concatenate([[True], ~same]))
    earliest = np.repeat(np.minimum.reduceat(row, begins), np.diff(np.append(begins, len(row))))
    later = row != earliest
    return row[later], i[order][later]


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last of consecutive starts."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    ends = np.append(new[1:], True) if len(row) else new
    return row[new], start[new], start[ends]


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte spans of repeats from segments that arrive in the order of their buckets."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> pa.RecordBatch:
        part = table.combine_chunks().to_batches()[0]
        bucket, doc, place = (part.column(k).to_numpy() for k in range(3))
        data, offsets = W.text_bytes(part.column(3))
        order = np.lexsort(((place >> 16) + (place & 255), doc, bucket))
        bucket, doc, place = bucket[order], doc[order], place[order]
        data, offsets = _gather(data, offsets[:-1][order], np.diff(offsets)[order])
        row, first, last = _runs(*_sort_block(bucket, place, data, offsets))
        begin = (place[row] >> 16) + first
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(begin), pa.array(begin + last - first + LENGTH)], names=["doc_id", "begin", "end"]
        )

    size = 0
    for batch in batches:
        for part in W.slices(batch, "bytes", BLOCK_BYTES):
            key = part.column(0).to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            size += part.nbytes
            if size > BLOCK_BYTES and (whole or (held and held[-1].column(0)[-1].as_py() != key[0])):
                table = pa.Table.from_batches([*held, part.slice(0, whole)])
                held, size = [part.slice(whole)], part.slice(whole).nbytes
                yield work(table)
            else:
                held.append(part)
    if held:
        yield work(pa.Table.from_batches(held))


def _bits_of(buckets: DataFrame) -> np.ndarray:
    """A bit for each bucket, by some bits of its number; ``FILTER_WORDS`` words at most reach the driver."""
    place = F.col("bucket").bitwiseAND(F.lit(64 * FILTER_WORDS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = buckets.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def _in_filter(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy() & np.int64(64 * FILTER_WORDS - 1)
            met = words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
            yield batch.filter(pa.array(met.astype(bool)))

    return run


def _cut(whole_characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offsets = W.text_bytes(part.column(1))
                gone = np.zeros(len(data) + 1, np.int64)
                counts = np.diff(part.column(2).offsets.to_numpy())
                spans = part.column(2).flatten()
                base = np.repeat(offsets[:-1], counts)
                np.add.at(gone, base + spans.field("begin").to_numpy(), 1)
                np.add.at(gone, base + spans.field("end").to_numpy(), -1)
                gone = np.cumsum(gone[:-1]) > 0
                if whole_characters:  # a character goes only if all its bytes go
                    char = np.cumsum((data & 0xC0) != 0x80) - 1
                    keep = np.zeros(int(char[-1]) + 1 if len(char) else 0, bool)
                    keep[char[~gone]] = True
                    gone = ~keep[char]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = offsets[:-1][np.diff(offsets) > 0]
                begins[heads] = gone[heads]
                sums = np.concatenate([[0], np.cumsum(gone)])
                runs = np.concatenate([[0], np.cumsum(begins)])
                removed = np.diff(sums[offsets])
                kept = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(runs[offsets])), _binary(data[~gone], kept)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


@dataclass
class Repeats:
    """What repeats: ``doc_id, spans`` (they may overlap), all texts, and whole copies, which have no spans."""

    spans: DataFrame
    texts: DataFrame
    copies: DataFrame

    @property
    def ids(self) -> DataFrame:
        """Of all documents with spans and all copies."""
        return self.spans.select("doc_id").unionByName(self.copies.select("doc_id"))


def find_repeats(docs: DataFrame, hot: int = HOT) -> Repeats:
    docs = one_text_per_id(docs)
    digests = docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    digests = digests.where(F.col("n_bytes") >= LENGTH)
    # Staged, so that the join below is one of two plain tables, whose skewed parts adaptive execution may split.
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stage(firsts.select("digest", "first"), "firsts")
    copies = stage(digests.join(firsts, "digest").where("doc_id <> first").select("doc_id", "n_bytes"), "copies")
    release(firsts)
    texts, docs = docs, docs.join(copies.select("doc_id"), "doc_id", "left_anti")

    found = stage(docs.mapInArrow(_find_anchors, _FOUND), "anchors")
    free_shuffles(docs.sparkSession)
    anchors = found.where("bucket is not null").select("bucket", "doc_id", "place")
    shared = stage(anchors.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    free_shuffles(docs.sparkSession)
    anchors = anchors.mapInArrow(_in_filter(_bits_of(shared)), "bucket long, doc_id long, place long")
    zones = anchors.join(shared.select("bucket", (F.col("n") > hot).alias("hot")), "bucket")
    zones = stage(zones.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "place", "hot")).alias("zones")), "zones")
    release(shared)
    nearby = stage(found.where("bucket is null").select("doc_id", F.col("place").alias("begin"), "end"), "spans")
    release(found)
    free_shuffles(docs.sparkSession)
    cold = zones.select("doc_id", F.filter("zones", lambda z: ~z["hot"]).alias("zones"))
    segments = docs.join(cold, "doc_id").select("doc_id", "text", "zones").mapInArrow(_cut_segments, _SEGMENTS)
    sorted_ = stage(
        segments.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets, "doc_id long, begin long, end long"),
        "spans",
    )
    spans, read = sorted_.unionByName(nearby), [zones, sorted_, nearby]
    warm = zones.select("doc_id", F.filter("zones", lambda z: z["hot"]).alias("zones")).where(F.size("zones") > 0)
    if warm.limit(1).count():
        single = docs.join(warm, "doc_id").select("doc_id", "text", "zones")
        single = stage(single.mapInArrow(_single_strings, "one long, two long, doc_id long, begin long"), "strings")
        read.append(single)
        first = single.groupBy("one", "two").agg(F.min(F.struct("doc_id", "begin")).alias("first"))
        later = single.join(first, ["one", "two"]).where(F.struct("doc_id", "begin") != F.col("first"))
        spans = spans.unionByName(later.select("doc_id", "begin", (F.col("begin") + LENGTH).alias("end")))
    free_shuffles(docs.sparkSession)
    merged = stage(spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "repeats")
    release(*read)
    free_shuffles(docs.sparkSession)
    return Repeats(merged, texts, copies)


def cut_repeats(found: Repeats, whole_characters: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) of every document that loses something.

    With ``whole_characters`` a multi-byte character goes only if all its bytes are repeated, so that what
    is kept stays valid UTF-8.
    """
    _, texts = parted(found.texts, "doc_id", found.spans.select("doc_id"))
    cut = texts.join(found.spans, "doc_id").mapInArrow(
        _cut(whole_characters), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    whole = found.copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    return cut.where("n_removed > 0").unionByName(whole)


def remove_repeats(docs: DataFrame, whole_characters: bool = False, hot: int = HOT) -> DataFrame:
    """What ``cut_repeats`` leaves of the documents that lose something."""
    return cut_repeats(find_repeats(docs, hot), whole_characters)
