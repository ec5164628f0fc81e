"""Words of many texts at once, as numpy arrays over one UTF-8 buffer.

A word is a maximal run of bytes outside space and tab to carriage return, after A-Z became a-z.
White space is ASCII here, so the bytes of longer UTF-8 characters always belong to words.
Every function takes whole texts; null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together.  A longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and len(texts) + 1 offsets into them."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch of rows so that the texts of each part hold about ``limit`` bytes; no text is cut."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < len(batch):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(batch))
        yield batch.slice(start, end - start)
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text."""
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = ~_BLANK[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begin[cuts] = inside[cuts]  # words don't run on into the next text
    starts = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(starts, offsets))
    if len(starts) == 0:
        return np.zeros(0, np.uint64), counts
    terms = powers(_BASE, len(data))
    terms *= _LOWER[data].astype(np.uint64) + np.uint64(1)
    terms *= inside
    sums = np.add.reduceat(terms, starts)  # blanks behind a word add nothing
    del terms
    sizes = np.add.reduceat(inside, starts, dtype=np.uint64)
    hashes = mix(sums * _shift_back(starts)) + sizes
    return hashes, counts


def run_hashes(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes marked ``inside`` from the given starts on, after A-Z became a-z."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    terms = powers(_BASE, len(data))
    terms *= _LOWER[data].astype(np.uint64) + np.uint64(1)
    terms *= inside
    sums = np.add.reduceat(terms, starts)  # blanks behind a word add nothing
    del terms
    sizes = np.add.reduceat(inside, starts, dtype=np.uint64)
    return mix(sums * _shift_back(starts)) + sizes


def _shift_back(starts: np.ndarray) -> np.ndarray:
    """Powers of the inverse base at the given ascending places."""
    low = powers(_INVERSE, 4096)
    high = powers(np.uint64(pow(int(_INVERSE), 4096, 1 << 64)), int(starts[-1]) // 4096 + 1)
    return low[starts % 4096] * high[starts // 4096]


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``width`` words in a row for each text, ascending, and how many each text has.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    n, ends = len(counts), np.cumsum(counts)
    if len(hashes) == 0:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    starts = ends - counts
    text = np.repeat(np.arange(n), counts)
    left = np.repeat(ends, counts) - np.arange(len(hashes))  # words from here to the end of the text
    keep = (left >= width) | (np.arange(len(hashes)) == starts[text])
    at = np.flatnonzero(keep)
    length = np.minimum(left[at], width)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        more = length > k
        out[more] = mix(out[more] * _BASE + hashes[at[more] + k] + np.uint64(k + 1))
    owner = text[at]
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[first], owner[first]
    return out, np.bincount(owner, minlength=n).astype(np.int64)
