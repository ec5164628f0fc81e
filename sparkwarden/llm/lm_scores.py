"""Cross-entropy difference: a target and a background bigram model over one vocabulary score each document.

Both models have the same order and smoothing, and one vocabulary: all ``V`` words of either side's texts, counted
exactly, of which every token of both is one.  With counts ``c``, target ``T`` and background ``B``, where a document's own
counts are taken from the background while it is scored, and ``c(v .)`` is how often a word follows ``v``:

    p_B(w) = (c_B(w) + FLOOR) / (N_B + FLOOR V)    p_B(w | v) = (c_B(v w) + MU p_B(w)) / (c_B(v .) + MU)
    p_T(w) = (c_T(w) + NU p_B(w)) / (N_T + NU)     p_T(w | v) = (c_T(v w) + MU p_T(w)) / (c_T(v .) + MU)

Each adds up to 1 over the vocabulary.  A token's losses are the negative logarithms of these (the first token of a
text has no context); a document's score is the mean difference, background less target: above 0 it is closer to the
target.  Losses are added up text by text, so they don't depend on how texts fall into batches.

Counts cover all texts and are never held in one place.  Texts are read in batches of about ``BATCH`` words; a
batch asks for the counts of its distinct words, pairs and words at the end of texts, once each, cut into ranges of their
hashes.  One task per range adds up what all batches hold and answers each; the answers go back to the batches, where
tokens are scored.  A frequent word or pair is one entry per batch, so no range is hot.  Only ranges that a batch has
something in are rows, so there are never more rows than words and pairs.

Null and blank texts have no tokens, losses of 0 and a score of 0.  Rows without an id are left out; rows that
repeat an id are scored one by one (and counted one by one).  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .staging import free_shuffles, long_rows, release, stage

BATCH = 1_200_000
SCORED = 1 << 17  # tokens whose losses are worked out together
RANGE_BYTES = 16 << 20
ROWS, ARROW_BYTES = 4, 8 << 20  # rows read, and bytes sent to Python, together; a row of tokens has several megabytes
LOW_BITS = 31  # of a count, in the lists of answers; the rest of larger counts is told beside them
MU, NU, FLOOR = 8.0, 2000.0, 0.5
_END = np.uint64(0x9E3779B97F4A7C15)  # stands for the end of a text

_TOKENS = "batch long, target boolean, doc_ids array<long>, counts array<int>, words array<long>, tokens array<int>"
_ASKED = "range int, batch long, target boolean, grams array<long>, n array<int>"
_TOLD = "batch long, range int, words long, background array<int>, target array<int>, over array<int>, high array<int>"
_SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def _lists(values: np.ndarray, ends: list[int], kind: str) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.array([0, *ends], np.int32)), pa.array(values.astype(kind)))


def _read(target: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) + (1 << 31 if target else 0)
        ids, hashes, counts, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            every = np.concatenate(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([target]), _lists(np.concatenate(ids), [len(every)], "int64"),
                 _lists(every, [len(every)], "int32"), _lists(words.view(np.int64), [len(words)], "int64"),
                 _lists(tokens, [len(tokens)], "int32")],
                names=["batch", "target", "doc_ids", "counts", "words", "tokens"],
            )

        for batch in batches:
            for part in W.slices(batch, "text"):
                h, c = W.words(*W.text_bytes(part.column(1)))
                ids.append(part.column(0).to_numpy())
                hashes.append(h)
                counts.append(c)
                size += len(h) + len(c)
                if size >= BATCH:
                    yield out()
                    number += 1
                    ids, hashes, counts, size = [], [], [], 0
        if ids:
            yield out()

    return run


def _pairs(tokens: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring tokens within texts as numbers, and where their second token stands."""
    first = np.zeros(len(tokens), bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    at = np.flatnonzero(~first)
    return tokens[at - 1].astype(np.int64) * words + tokens[at], at


def _last(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The last token of every text that has one."""
    return tokens[np.cumsum(counts)[counts > 0] - 1]


def _gram_hashes(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """One number for each distinct word and pair of a batch, and for each of its words as the last one of a text.

    Those of words are odd, the others even.
    """
    words = words.view(np.uint64)
    v, w = np.divmod(pairs, max(len(words), 1))
    mixed, odd = W.mix(words), np.uint64(1)
    others = np.concatenate([W.mix(mixed[v] * np.uint64(3) + words[w]), W.mix(mixed * np.uint64(5) + _END)])
    return np.concatenate([mixed | odd, others & ~odd])


def _ask(ranges: int):
    starts_of = _starts(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                counts, words, tokens = (batch.column(k)[row].values.to_numpy() for k in (2, 3, 4))
                pairs, n_pairs = np.unique(_pairs(tokens, counts, len(words))[0], return_counts=True)
                grams = _gram_hashes(words, pairs)
                n_last = np.bincount(_last(tokens, counts), minlength=len(words))
                n = np.concatenate([np.bincount(tokens, minlength=len(words)), n_pairs, n_last])
                order = np.argsort(grams)
                grams, n = grams[order], n[order]
                held, starts = np.unique(np.searchsorted(starts_of, grams, "right") - 1, return_index=True)
                ends = np.append(starts[1:], len(grams)).tolist() if len(held) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.astype(np.int32)), pa.array([batch.column(0)[row].as_py()] * len(held), pa.int64()),
                     pa.array([batch.column(1)[row].as_py()] * len(held), pa.bool_()),
                     _lists(grams.view(np.int64), ends, "int64"), _lists(n, ends, "int32")],
                    names=["range", "batch", "target", "grams", "n"],
                )

    return run


def _starts(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)


def _answer(low_bits: int):
    """For each batch the counts, over all batches, of the grams of one range it asked for."""

    def run(asked: pa.Table) -> pa.Table:
        rows = asked.combine_chunks()
        parts = [rows.column("grams")[i].values.to_numpy().view(np.uint64) for i in range(len(rows))]
        n = [rows.column("n")[i].values.to_numpy() for i in range(len(rows))]
        target = rows.column("target").to_pylist()
        grams, which = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.zeros((2, len(grams)), np.int64)
        ends = np.cumsum([len(p) for p in parts])
        for end, p, c, t in zip(ends, parts, n, target):
            sums[int(t), which[end - len(p) : end]] += c
        words = np.zeros(len(rows), np.int64)
        words[0] = np.count_nonzero(grams & np.uint64(1))  # told once per range
        low = [(sums[k] & ((1 << low_bits) - 1))[which] for k in (0, 1)]
        high = (sums >> low_bits)[:, which].T.ravel()  # both sides in turn
        at = np.flatnonzero(high)
        row = np.searchsorted(ends, at // 2, "right")
        over = at - 2 * np.concatenate([[0], ends])[row]
        until = np.searchsorted(row, np.arange(len(rows)), "right").tolist()
        return pa.table({
            "batch": rows.column("batch"), "range": rows.column("range"), "words": words,
            "background": _lists(low[0], ends.tolist(), "int32"), "target": _lists(low[1], ends.tolist(), "int32"),
            "over": _lists(over, until, "int32"), "high": _lists(high[at], until, "int32"),
        })

    return run


def _told(told: pa.Table, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the background and the target of a batch's grams in order."""
    order = pa.array(told.column("range").to_numpy().argsort())
    lists = {name: told.column(name).combine_chunks().take(order) for name in ("background", "target", "over", "high")}
    sizes, many = (lists[name].value_lengths().to_numpy() for name in ("background", "over"))
    both = np.empty((len(lists["background"].flatten()), 2), np.int64)
    for k, name in enumerate(("background", "target")):
        both[:, k] = lists.pop(name).flatten().to_numpy()
    start = 2 * (np.cumsum(sizes, dtype=np.int64) - sizes)
    both.ravel()[np.repeat(start, many) + lists["over"].flatten().to_numpy()] += lists["high"].flatten().to_numpy().astype(np.int64) << low_bits
    return both[:, 0], both[:, 1]


def _own(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    _, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[which]


def _score(n_background: int, n_target: int, vocabulary: int, low_bits: int):
    def run(tokens: pa.Table, told: pa.Table) -> pa.Table:
        out = [pa.table({k: pa.array([], pa.int64() if k in ("doc_id", "n_tokens") else pa.float64()) for k in ("doc_id", "n_tokens", "loss_target", "loss_background", "score")})]
        for row in range(len(tokens)):
            ids, counts, words, places = (tokens.column(k)[row].values.to_numpy() for k in ("doc_ids", "counts", "words", "tokens"))
            n, counts = len(words), counts.astype(np.int64)
            pairs, at = _pairs(places, counts, n)
            pairs, which = np.unique(pairs, return_inverse=True)
            at, which, m = at.astype(np.int32), which.astype(np.int32), len(pairs)
            order = np.argsort(_gram_hashes(words, pairs))
            del pairs
            c, followed = {}, {}
            for name, answered in zip(("background", "target"), _told(told, low_bits)):
                c[name] = np.zeros(len(order))
                c[name][order] = answered
                followed[name] = c[name][:n] - c[name][n + m :]  # how often a word follows
            del order, answered
            final = np.zeros(len(counts), places.dtype)
            final[counts > 0] = _last(places, counts)
            ends = np.cumsum(counts)
            begin = 0
            while begin < len(counts):  # whole texts of about SCORED tokens at a time
                first = ends[begin] - counts[begin]
                end = max(begin + 1, int(np.searchsorted(ends, first + SCORED, "right")))
                many, here = counts[begin:end], places[first : ends[end - 1]]
                inside = slice(*np.searchsorted(at, [first, ends[end - 1]]))
                second, pair = at[inside] - first, n + which[inside]
                text = np.repeat(np.arange(len(many)), many)
                own = _own(text * n + here)
                p_b = (c["background"][here] - own + FLOOR) / (n_background - many[text] + FLOOR * vocabulary)
                p_t = (c["target"][here] + NU * p_b) / (n_target + NU)
                loss_b, loss_t = -np.log(p_b), -np.log(p_t)
                before = here[second - 1]
                own_followed = own[second - 1] - (before == final[begin:end][text[second]])
                own = _own(text[second] * max(m, 1) + which[inside])
                loss_b[second] = -np.log((c["background"][pair] - own + MU * p_b[second]) / (followed["background"][before] - own_followed + MU))
                loss_t[second] = -np.log((c["target"][pair] + MU * p_t[second]) / (followed["target"][before] + MU))
                b, t = (np.bincount(text, x, minlength=len(many)) for x in (loss_b, loss_t))
                size = np.maximum(many, 1)
                out.append(pa.table({"doc_id": ids[begin:end], "n_tokens": many, "loss_target": t / size, "loss_background": b / size, "score": (b - t) / size}))
                begin = end
        return pa.concat_tables(out)

    return run


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` of every document.

    ``docs`` has ``doc_id, text`` and is the background as well; ``target`` has a column ``text``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), "text")
    read = stage(rows.mapInArrow(_read(False), _TOKENS).unionByName(wanted.mapInArrow(_read(True), _TOKENS)), "tokens")
    size = F.sum(F.size("tokens"))
    totals = {r.target: r for r in read.groupBy("target").agg(size.alias("n"), F.sum(2 * F.size("tokens") + F.size("counts")).alias("grams")).collect()}
    n_background, n_target = (totals[t].n if t in totals else 0 for t in (False, True))
    ranges = max(1, -(-12 * sum(r.grams for r in totals.values()) // RANGE_BYTES))
    asked = read.select("batch", "target", "counts", "words", "tokens").mapInArrow(_ask(ranges), _ASKED)
    with long_rows(docs.sparkSession, ROWS, ARROW_BYTES):
        told = stage(asked.groupBy("range").applyInArrow(_answer(LOW_BITS), _TOLD), "counts")
    vocabulary = told.agg(F.sum("words")).first()[0] or 0
    free_shuffles(docs.sparkSession)
    scored = (
        read.where(~F.col("target")).groupBy("batch")
        .cogroup(told.drop("words").groupBy("batch"))
        .applyInArrow(_score(n_background, n_target, vocabulary, LOW_BITS), _SCORES)
    )
    with long_rows(docs.sparkSession, ROWS, ARROW_BYTES):
        out = stage(scored, "scores")
    release(read, told)
    return out
