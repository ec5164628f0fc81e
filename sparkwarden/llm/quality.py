"""Quality classifier by co-training: text content and page metadata teach each other.

The *content* view sees only the text: shares of symbols, blanks, digits and capitals, repetition, shape of words
and lines.  The *metadata* view sees only source, language, length and number of lines.  Either view cuts each of
its features into bins and adds up log odds of the bins, weighted by feature (naive Bayes on counts, calibrated
by a logistic regression).

Each of ``ROUNDS`` rounds counts bins over all rows that are labelled, or that the other view is sure about (its calibrated
probability is beyond ``SURE``); so confident pseudo-labels go from view to view.  Counting is one
aggregation over all rows per round, with at most ``BINS`` rows per feature; nothing else is collected but a bounded sample
of the labelled rows (``SAMPLE`` of each label, the smallest hashes of ids), on which views are calibrated and combined.

Null texts are empty; null sources and languages are categories of their own.  Rows without an id are left out;
rows that repeat an id are scored one by one.  Without labels of both kinds every document is kept with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .fitting import fit_logistic, sigmoid
from .staging import release, stage

ROUNDS, SURE, SAMPLE = 3, 0.97, 10_000
BINS = 64
CONTENT = (
    "symbols", "bars", "blanks", "digits", "capitals", "letters", "sentence_marks", "word_length", "distinct_words",
    "repeated_words", "long_words", "line_length", "short_lines", "symbols_per_word",
)
METADATA = ("source", "lang", "length", "lines")


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SYMBOLS = _class(b"#$%&*|~^<>{}[]\\@+=_/")
_BAR, _LINE, _MARKS, _DIGITS = _class(b"|"), _class(b"\n"), _class(b".,!?;:"), _class(b"0123456789")
_CAPITALS = _class(bytes(range(65, 91)))
_LETTERS = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def content_features(texts: pa.Array) -> np.ndarray:
    """One row per text, in the order of CONTENT; all values lie between 0 and 1."""
    data, offsets = W.text_bytes(texts)
    n = np.diff(offsets)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    def share(a: np.ndarray, b: np.ndarray, usual: float = 0.0, weight: float = 40.0) -> np.ndarray:
        """A share, drawn towards its usual value where there is little to judge by."""
        return np.clip((a + weight * usual) / (b + weight), 0, 1)

    hashes, words = W.words(data, offsets)
    text = np.repeat(np.arange(len(n)), words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((hashes, text))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=len(n))
    repeated = np.bincount(text[again], minlength=len(n))
    blanks = total(W._BLANK[data])
    symbols, lines = total(_SYMBOLS[data]), total(_LINE[data]) + 1
    ink = n - blanks
    # Blank-free stretches of over 24 bytes, and lines of under 24 bytes.
    long_words = _stretches(~W._BLANK[data], offsets, 24, np.greater)
    short_lines = _stretches(~_LINE[data], offsets, 24, np.less)
    return np.column_stack([
        share(symbols, n), share(total(_BAR[data]), n), share(blanks, n, 0.16), share(total(_DIGITS[data]), n),
        share(total(_CAPITALS[data]), n, 0.03), share(total(_LETTERS[data]), n, 0.8), share(total(_MARKS[data]), words, 0.15, 10),
        share(ink, 20 * words, 0.25, 200), share(distinct, words, 0.9, 10), share(repeated, words, 0, 10),
        share(long_words, words, 0, 10), np.clip(np.log10((n + 100) / (lines + 1)) / 5, 0, 1),
        share(short_lines, lines, 0.2, 5), share(symbols, 4 * words, 0, 40),
    ])


def _stretches(mask: np.ndarray, offsets: np.ndarray, size: int, test) -> np.ndarray:
    """Number of runs of each text whose length passes the test."""
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(mask))]
    begin[cuts], end[cuts - 1] = mask[cuts], mask[cuts - 1]
    starts = np.flatnonzero(begin)
    passed = test(np.flatnonzero(end) + 1 - starts, size)
    return np.diff(np.concatenate([[0], np.cumsum(passed)])[np.searchsorted(starts, offsets)])


def _bins(x: np.ndarray) -> np.ndarray:
    """Finer bins near 0, where shares of rare characters lie."""
    return np.minimum((np.sqrt(x) * 20).astype(np.int64), 19)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text", 1 << 20):
            bins = _bins(content_features(part.column(1)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bins.ravel().astype(np.int32)), bins.shape[1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists.cast(pa.list_(pa.int32())), *(part.column(k) for k in range(2, 6))],
                names=["doc_id", "content", "source", "lang", "length", "lines"],
            )


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, content, metadata``: bins of both views for every row with an id."""
    def category(column: str):
        name = F.coalesce(F.col(column).cast("string"), F.lit("")) if column in docs.columns else F.lit("")
        return F.pmod(F.xxhash64(name), F.lit(BINS)).cast("int").alias(column)

    text = F.coalesce("text", F.lit(""))

    def magnitude(n):
        return F.least(F.floor(3 * F.log2(n + 1)), F.lit(BINS - 1)).cast("int")

    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), category("source"), category("lang"),
        magnitude(F.char_length(text)).alias("length"),
        magnitude(F.char_length(text) - F.char_length(F.translate(text, "\n", ""))).alias("lines"),
    )
    described = rows.mapInArrow(_describe, "doc_id long, content array<int>, source int, lang int, length int, lines int")
    return described.select("doc_id", "content", F.array(*METADATA).alias("metadata"))


@dataclass
class View:
    """Log odds of each bin of each feature, and the weights that calibrate their sum."""

    odds: np.ndarray
    weights: np.ndarray | None = None

    def evidence(self, bins: np.ndarray) -> np.ndarray:
        return self.odds[np.arange(bins.shape[1]), bins]

    def logit(self, bins: np.ndarray) -> np.ndarray:
        return self.evidence(bins) @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, bins: np.ndarray, y: np.ndarray) -> None:
        self.weights = fit_logistic(self.evidence(bins), y, ridge=1e-3)


@dataclass
class Model:
    content: View
    metadata: View
    weights: np.ndarray  # of the calibrated views, and the intercept

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, ...]:
        views = np.column_stack([self.content.logit(content), self.metadata.logit(metadata)])
        return sigmoid(views @ self.weights[:-1] + self.weights[-1]), sigmoid(views[:, 0]), sigmoid(views[:, 1])


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy()
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), np.int32)


def _count(views: tuple[View, View] | None):
    """Rows per view, feature, bin and label, counted within a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            known = batch.column(2).to_numpy(zero_copy_only=False).astype(float)  # not a number: no label
            bins = [_matrix(batch.column(k)) for k in (0, 1)]
            out = []
            for k in (0, 1):
                y = known.copy()
                if views is not None:  # what the other view is sure about
                    p = sigmoid(views[1 - k].logit(bins[1 - k]))
                    sure = np.isnan(y) & ((p >= SURE) | (p <= 1 - SURE))
                    y[sure] = p[sure] > 0.5
                use = ~np.isnan(y)
                for f in range(bins[k].shape[1]):
                    n = np.bincount(bins[k][use, f] * 2 + y[use].astype(int), minlength=2 * BINS)
                    at = np.flatnonzero(n)
                    out.append(np.column_stack([np.full(len(at), k), np.full(len(at), f), at // 2, at % 2, n[at]]))
            table = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in table.T], names=["view", "feature", "bin", "label", "n"])

    return run


def _views(rows: DataFrame, views: tuple[View, View] | None) -> tuple[View, View]:
    counts = (
        rows.select("content", "metadata", F.col("label").cast("double").alias("label"))
        .mapInArrow(_count(views), "view long, feature long, bin long, label long, n long")
        .groupBy("view", "feature", "bin", "label").agg(F.sum("n").alias("n")).collect()
    )
    out = []
    for k, names in enumerate((CONTENT, METADATA)):
        table = np.zeros((len(names), BINS, 2))
        for r in counts:
            if r["view"] == k:
                table[r.feature, r.bin, r.label] = r.n
        table += 0.5
        share = table / table.sum(1, keepdims=True)
        out.append(View(np.log(share[:, :, 1] / share[:, :, 0])))
    return out[0], out[1]


def fit(rows: DataFrame, rounds: int = ROUNDS, sample: int = SAMPLE) -> Model | None:
    """A model from ``doc_id, content, metadata, label`` (1 good, 0 bad, null unknown); None without both labels."""
    ids = rows.where("label in (0, 1)")
    kept = [ids.where(F.col("label") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    table = kept[0].unionByName(kept[1]).select("content", "metadata", "label").collect()
    y = np.array([r.label for r in table], float)
    if len(set(y)) < 2:
        return None
    content, metadata = np.array([r.content for r in table]), np.array([r.metadata for r in table])
    views = None
    for _ in range(rounds):
        views = _views(rows, views)
        views[0].calibrate(content, y)
        views[1].calibrate(metadata, y)
    both = np.column_stack([views[0].logit(content), views[1].logit(metadata)])
    return Model(*views, fit_logistic(both, y, ridge=1e-4))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, content_score, metadata_score, kept`` of every row with an id.

    ``labels`` has ``doc_id, label`` (1 good, 0 bad); scores are probabilities of 1, and a document is kept
    from one half on.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where("label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    described = stage(describe(docs), "views")
    rows = stage(described.join(known, "doc_id", "left"), "labelled")
    model = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch.column(1)), _matrix(batch.column(2))) if len(batch) else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores)], names=["doc_id", "score", "content_score", "metadata_score"])

    release(rows)
    if model is None:
        one = F.lit(1.0)
        out = described.select("doc_id", one.alias("score"), one.alias("content_score"), one.alias("metadata_score"))
    else:
        out = described.mapInArrow(run, "doc_id long, score double, content_score double, metadata_score double")
    return out.withColumn("kept", F.col("score") >= 0.5)
