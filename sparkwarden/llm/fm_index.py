"""Benchmark decontamination by an FM-index per shard of the training texts.

Words are maximal runs of digits, letters and characters beyond ASCII, after A-Z became a-z.  A window is
``WINDOW`` consecutive words of a benchmark item; an item with fewer words (but not none) is one window.  Every
word of a document inside an occurrence of a window is hit.

1. *Index.*  A task cuts its rows into shards of about ``SHARD`` words, documents one after the other, each
   closed by an end mark.  A shard's symbols are the ranks of its distinct words.  Suffixes are sorted by
   prefix doubling, of which only unresolved ones go on; end marks differ, so no suffix compares beyond
   its document.  What is kept is the Burrows-Wheeler text as a wavelet matrix (a bit plane per bit of a symbol,
   with running counts per 64 bits), the number of smaller symbols, the distinct words, and every ``SAMPLE``-th
   position of a suffix as well as those at which documents begin.  The index is a table: it outlives lost executors
   and is searched by any number of benchmarks.
2. *Search.*  Windows are cut into blocks by their hash, each of about ``BLOCK`` windows whatever the benchmark's
   size; a block is sent to the tasks that read the index.  All windows of a block step backwards together, a
   word at a time, by ranks in the wavelet matrix, and leave as soon as nothing is left of their range.
3. *Locate.*  Each occurrence steps back through the text until it meets a kept position.  A document's first word is
   one, so no step crosses documents.
4. *Spans.*  Occurrences of a document are merged into removal spans, word ranges first, byte ranges of the
   text where a span is cut out.  Which items occurred comes from a join of the found windows with the items.

Words are compared by 64-bit hashes.  Nulls: null texts have no words; items without an id or without words take no part; rows
without a document id, and rows that repeat one, are judged one by one.  Items that repeat an id count as one item
with the windows of all its texts.  Long texts are indexed whole, a text of more than ``SHARD`` words as a shard of
its own.  Empty tables give no rows, or rows without hits.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from . import words as W
from .staging import stage

WINDOW = 10
SHARD = 1 << 19
SAMPLE = 16
BLOCK = 1 << 17

_BREAK = np.zeros(256, dtype=bool)
_BREAK[:128] = True
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, their number per text, and where each begins and ends in its text."""
    data, offsets = W.text_bytes(texts)
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_BREAK[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    first = np.repeat(offsets[:-1], counts)
    return W.run_hashes(data, starts, inside), counts, starts - first, ends - first


def _suffixes(symbols: np.ndarray, sigma: int) -> np.ndarray:
    """Places of all suffixes in order.  Symbol 0 marks ends; of two marks the earlier is smaller."""
    n = len(symbols)
    bits = max(int(sigma).bit_length(), 1)
    step = max(1, 62 // bits)
    # The first words of each suffix in one number; what follows an end mark doesn't count.
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    for k in range(step):
        s = np.zeros(n, np.int64)
        s[: max(n - k, 0)] = symbols[k:]
        key = key << bits | np.where(open_, s, 0)
        open_ &= s != 0
    ends = np.flatnonzero(symbols == 0)
    upto = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words before the end mark
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    # A suffix whose end mark is among its first words is smaller the earlier it stands, which the stable sort gives.
    closed = upto[order] < step
    new[1:] |= closed[1:]
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # ranks are first places of groups, so they stay when groups split
    rank[order] = group
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        at = np.flatnonzero(np.repeat(size > 1, size))  # places in the order that are not settled
        if not len(at):
            return order
        p = order[at]
        follow = np.where(upto[p] >= step, rank[np.minimum(p + step, n - 1)], 0)
        sort = np.lexsort((follow, rank[p]))
        p, follow = p[sort], follow[sort]
        order[at] = p
        differs = np.ones(len(at), bool)
        differs[1:] = (rank[p][1:] != rank[p][:-1]) | (follow[1:] != follow[:-1])
        new[at] |= differs
        rank[p] = at[np.flatnonzero(differs)[np.cumsum(differs) - 1]]
        step *= 2


def _planes(symbols: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A wavelet matrix: words of bits and running counts, plane after plane, and the zeros of each plane."""
    n = len(symbols)
    size = n // 64 + 1
    planes, counts, zeros = np.zeros((bits, size), np.uint64), np.zeros((bits, size), np.int32), np.zeros(bits, np.int64)
    for level in range(bits):
        bit = (symbols >> (bits - 1 - level) & 1).astype(bool)
        padded = np.zeros(size * 64, bool)
        padded[:n] = bit
        planes[level] = np.packbits(padded, bitorder="little").view(np.uint64)
        counts[level, 1:] = np.cumsum(np.bitwise_count(planes[level]))[:-1]
        zeros[level] = n - bit.sum()
        symbols = np.concatenate([symbols[~bit], symbols[bit]])
    return planes, counts, zeros


class _Index:
    """A shard as it is searched."""

    def __init__(self, row: dict):
        self.counts = np.asarray(row["counts"])
        self.n = int(self.counts.sum()) + len(self.counts)
        self.vocabulary = np.asarray(row["words"]).view(np.uint64)
        self.smaller = np.asarray(row["smaller"]).astype(np.int64)
        self.bits = max(len(self.vocabulary).bit_length(), 1)
        self.zeros = np.asarray(row["zeros"])
        self.planes = np.frombuffer(row["planes"], np.uint64).reshape(self.bits, -1)
        self.ones = np.frombuffer(row["ones"], np.int32).reshape(self.bits, -1)
        self.marks = np.frombuffer(row["marks"], np.uint64)
        self.marked = np.frombuffer(row["marked"], np.int32)
        self.places = np.frombuffer(row["places"], np.int32)

    def _rank(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits of a plane."""
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        low = self.planes[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.ones[level][word] + np.bitwise_count(low)

    def _before(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``i`` of the Burrows-Wheeler text."""
        start = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._rank(level, start), self._rank(level, i)
            start = np.where(one, self.zeros[level] + a, start - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return i - start

    def _symbols(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places of the Burrows-Wheeler text, and how often they occur before."""
        symbol, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for level in range(self.bits):
            word, rest = i >> 6, (i & 63).astype(np.uint64)
            one = (self.planes[level][word] >> rest & np.uint64(1)).astype(bool)
            symbol = symbol << 1 | one
            a, b = self._rank(level, start), self._rank(level, i)
            start = np.where(one, self.zeros[level] + a, start - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return symbol, i - start

    def search(self, grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows that occur, with their ranges of suffixes; ``grams`` is (window, word)."""
        if not len(grams) or not len(self.vocabulary):
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        known = (self.vocabulary[at] == grams) | (np.arange(grams.shape[1]) >= sizes[:, None])
        live = np.flatnonzero(known.all(axis=1))
        symbols = at + 1
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for back in range(int(sizes.max(initial=0))):
            left = sizes[live] - 1 - back  # the word to put in front
            s = symbols[live, np.maximum(left, 0)]
            both = self._before(np.concatenate([s, s]), np.concatenate([low, high]))
            go = left >= 0
            low = np.where(go, self.smaller[s] + both[: len(s)], low)
            high = np.where(go, self.smaller[s] + both[len(s) :], high)
            some = high > low
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Places in the shard of suffixes given by their ranks."""
        out, steps, open_ = np.zeros(len(i), np.int64), 0, np.arange(len(i))
        while len(open_):
            word, rest = i >> 6, (i & 63).astype(np.uint64)
            met = (self.marks[word] >> rest & np.uint64(1)).astype(bool)
            which = self.marked[word] + np.bitwise_count(self.marks[word] & ((np.uint64(1) << rest) - np.uint64(1)))
            out[open_[met]] = self.places[which[met]] + steps
            open_, i = open_[~met], i[~met]
            if len(open_):
                symbol, before = self._symbols(i)
                i = self.smaller[symbol] + before
            steps += 1
        return out


_INDEX = (
    "shard long, doc_ids array<long>, counts array<int>, words array<long>, smaller array<int>, zeros array<long>, "
    "planes binary, ones binary, marks binary, marked binary, places binary"
)
_FIELDS = [f.split(" ")[0] for f in _INDEX.split(", ")]


def _list(values: np.ndarray, kind: str) -> pa.Array:
    values = pa.array(values.astype(kind, copy=False))
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _index(hashes: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """The index of one shard, as columns after ``shard`` and ``doc_ids``."""
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    n, sigma = len(hashes) + len(counts), len(vocabulary) + 1
    ends = np.cumsum(counts + 1) - 1  # of documents, where their end marks stand
    text = np.zeros(n, np.int64)
    word = np.ones(n, bool)
    word[ends] = False
    text[word] = symbols + 1
    order = _suffixes(text, sigma)
    smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
    planes, ones, zeros = _planes(text[order - 1], max((sigma - 1).bit_length(), 1))
    kept = order % SAMPLE == 0
    begins = np.zeros(n, bool)
    begins[ends - counts] = True
    kept |= begins[order]
    padded = np.zeros((n // 64 + 1) * 64, bool)
    padded[:n] = kept
    marks = np.packbits(padded, bitorder="little").view(np.uint64)
    marked = np.concatenate([[0], np.cumsum(np.bitwise_count(marks))[:-1]]).astype(np.int32)

    def blob(values: np.ndarray) -> pa.Array:
        return pa.array([values.tobytes()], pa.binary())

    return [
        _list(counts, "int32"), _list(vocabulary.view(np.int64), "int64"), _list(smaller, "int32"), _list(zeros, "int64"),
        blob(planes), blob(ones), blob(marks), blob(marked), blob(order[kept].astype(np.int32)),
    ]


def _build(shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, hashes, counts, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            docs = pa.concat_arrays(ids)
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            columns = _index(np.concatenate(hashes), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array([number]), doc_ids, *columns], names=_FIELDS)

        for batch in batches:
            for part in W.slices(batch, "text", min(W.SLICE_BYTES, 4 * shard)):
                h, c, _, _ = _words(part.column(1))
                if size and size + len(h) > shard:
                    yield out()
                    number += 1
                    ids, hashes, counts, size = [], [], [], 0
                ids.append(part.column(0))
                hashes.append(h)
                counts.append(c)
                size += len(h) + len(c)
        if ids:
            yield out()

    return run


def build_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard of ``doc_id, text``, staged; rows keep their places in ``doc_ids``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = shared_folder(docs.sparkSession, "fm_index")
    # Few rows a file, since a reader's batch holds many rows of one file.
    rows.mapInArrow(_build(shard), _INDEX).write.options(compression="zstd", maxRecordsPerFile=8).parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item_id, grams`` of every window of every item."""
    for batch in batches:
        for part in W.slices(batch, "text", 1 << 19):
            h, c, _, _ = _words(part.column(1))
            n = np.where(c >= WINDOW, c - WINDOW + 1, np.minimum(c, 1))
            item = np.repeat(np.arange(len(c)), n)
            start = (np.cumsum(c) - c)[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            size = np.minimum(c[item], WINDOW)
            ends = np.cumsum(size)
            flat = h[np.repeat(start - ends + size, size) + np.arange(size.sum())]
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(item)), grams], names=["item_id", "grams"])


def windows(items: DataFrame) -> DataFrame:
    """``item_id, grams`` (hashes of words) from ``item_id, text``, each pair once, staged."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    return stage(rows.mapInArrow(_windows, "item_id string, grams array<long>").distinct(), "windows")


_FOUND = "shard long, place int, doc_id long, spans array<struct<begin:int,end:int>>, windows array<array<long>>"
_SPAN = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint, not even touching ranges of each document, in order."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    # Running maxima restart at each document, as its ranges lie beyond all of the one before.
    width = int(end.max(initial=0)) + 1
    shift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))[: len(doc)] * width
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = (begin + shift)[1:] > reach[:-1]
    new[1:] |= doc[1:] != doc[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1 if len(doc) else np.zeros(0, np.int64)
    return doc[new], begin[new], (reach - shift)[last]


def _search(grams: np.ndarray, sizes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                values = {f: batch.column(k)[row] for k, f in enumerate(_FIELDS)}
                index = _Index({f: v.as_buffer() if pa.types.is_binary(v.type) else v.values.to_numpy() for f, v in values.items() if f not in ("shard", "doc_ids")})
                which, low, high = index.search(grams, sizes)
                if not len(which):
                    continue
                n = high - low
                of = np.repeat(which, n)
                at = index.locate(np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n))
                begins = np.cumsum(index.counts + 1) - index.counts - 1
                doc = np.searchsorted(begins, at, side="right") - 1
                begin = at - begins[doc]
                d, b, e = _merged(doc, begin, begin + sizes[of])
                docs, pairs = np.unique(d), np.unique(np.column_stack([doc, of]), axis=0)
                cuts = np.searchsorted(d, np.append(docs, len(index.counts)))
                spans = pa.StructArray.from_arrays([pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32))], names=["begin", "end"])
                size = sizes[pairs[:, 1]]
                ends = np.cumsum(size)
                flat = grams[np.repeat(pairs[:, 1], size), np.arange(size.sum()) - np.repeat(ends - size, size)]
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64)))
                upto = np.searchsorted(pairs[:, 0], np.append(docs, len(index.counts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), values["shard"].as_py())), pa.array(docs.astype(np.int32)),
                     values["doc_ids"].values.take(pa.array(docs)),
                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans),
                     pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words)],
                    names=["shard", "place", "doc_id", "spans", "windows"],
                )

    return run


def _join_spans(spans):
    """Sorted ranges as disjoint ones that don't touch."""
    empty = F.array().cast("array<struct<begin:int,end:int>>")

    def add(done, s):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["begin"] <= F.try_element_at(done, F.lit(-1))["end"]), longer).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def find_windows(index: DataFrame, grams: DataFrame, block: int = BLOCK) -> DataFrame:
    """``shard, place, doc_id, spans, windows`` of the rows with hits: merged ranges of words, and the windows found.

    ``grams`` is a table of windows, of which equal ones count once.  Each block of them is one pass over the index.
    """
    spark = index.sparkSession
    distinct = stage(grams.select("grams").distinct(), "grams")
    blocks = max(1, -(-distinct.count() // block))
    found = []
    for b in range(blocks):
        taken = distinct.where(F.pmod(F.xxhash64("grams"), F.lit(blocks)) == b) if blocks > 1 else distinct
        lists = taken.toArrow().column("grams").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        if not len(sizes):
            continue
        table = np.zeros((len(sizes), int(sizes.max())), np.uint64)
        table[np.arange(table.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy().view(np.uint64)
        found.append(stage(index.mapInArrow(_search(table, sizes), _FOUND), "found"))
    if not found:
        return spark.createDataFrame([], _FOUND)
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rows = every.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("windows")).alias("windows")
    )
    return rows.withColumn("spans", _join_spans(F.col("spans")))


def contamination(docs: DataFrame, items: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, item_ids`` of every document; spans are ranges of its words.

    ``docs`` has ``doc_id, text``, ``items`` ``item_id, text``.  ``item_ids`` are distinct, sorted as strings.
    """
    index = build_index(docs, shard)
    grams = windows(items)
    found = stage(find_windows(index, grams, block), "hits")
    pairs = found.select("shard", "place", F.explode("windows").alias("grams")).join(grams, "grams")
    told = pairs.groupBy("shard", "place").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hits = found.select("shard", "place", "spans").join(told, ["shard", "place"])
    every = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "counts")).alias("place", "row"))
    every = every.select("shard", "place", F.col("row.doc_ids").alias("doc_id"), F.col("row.counts").cast("long").alias("n_words"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return every.join(hits, ["shard", "place"], "left").select(
        "doc_id", "n_words", F.coalesce(size, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array()).alias("spans"), F.coalesce("item_ids", F.array()).alias("item_ids"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes from the first to the last word of each span."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            data, offsets = W.text_bytes(part.column(1))
            _, counts, begin, end = _words(part.column(1))
            first, spans = np.cumsum(counts) - counts, part.column(2)
            sizes, flat = np.diff(spans.offsets.to_numpy()), spans.flatten()
            text = np.repeat(np.arange(len(part)), sizes)
            a = begin[first[text] + flat.field("begin").to_numpy()]
            b = end[first[text] + flat.field("end").to_numpy() - 1]
            gone = np.zeros(len(data) + 1, np.int32)
            np.add.at(gone, offsets[text] + a, 1)
            np.add.at(gone, offsets[text] + b, -1)
            keep = np.cumsum(gone[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            bytes_ = pa.Array.from_buffers(
                pa.binary(), len(part), [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[keep]))]
            )
            ranges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["begin", "end"]))
            yield pa.RecordBatch.from_arrays([part.column(0), bytes_.cast(pa.string()), ranges], names=["doc_id", "text", "removed"])


def remove_hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text, removed`` of the documents with hits: text without its hit words, and their byte ranges.

    ``found`` is the result of :func:`contamination`; ids should name one document each.
    """
    spans = found.where("n_hit > 0").select("doc_id", "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id")
    return rows.mapInArrow(_cut, "doc_id long, text string, removed array<struct<begin:long,end:long>>")
