"""SentencePiece encoding and decoding by suffix-array matching.

The model is a BPE model with identity normalization, a space put before every text and byte fallback.  In its
vocabulary a space stands only at the start of a piece, so a text falls into units (spaces and what follows up
to the next space) that are encoded on their own, each distinct one once; a unit is cut further between a letter and
punctuation that no piece has behind a letter.

1. The new units of a slice of texts are put one after the other, and the suffix array of that text is built by doubling
   as far as the longest piece reaches.
2. Every piece of the vocabulary is searched in it, all binary searches side by side; its range of suffixes gives its
   occurrences: edges from its start to its end.
3. Edges are sorted by unit, rank of the piece and position, and relaxed: an edge is taken when its ends are boundaries
   with exactly one boundary between them and no better edge of the unit can be taken; taking it removes that
   boundary.  All units are relaxed side by side; a long unit goes through a heap of its edges.
4. What no piece covers becomes the ids of its UTF-8 bytes.

Null texts are empty and have no ids; rows without an id are left out, and rows that repeat an id are encoded
one by one.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tokens import _spread

SPACE = "▁"
#: Units that one worker remembers; beyond that it starts afresh.
REMEMBERED = 250_000
#: Units beyond this length are relaxed through a heap.
LONG = 96


def _code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, one after the other, and offsets."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = np.zeros(256, np.int64)
        self.text = [b""] * n  # what an id stands for
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:-1], 16)] = i
                self.text[i] = bytes([int(names[i][3:-1], 16)])
        for i in plain:
            self.text[i] = names[i].replace(SPACE, " ").encode()
            if SPACE in names[i].lstrip(SPACE):
                raise ValueError(f"a piece with a space inside: {names[i]!r}")
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.ids = np.array(order)  # by rank: the piece that is merged first has rank 0
        self.names = [names[i] for i in order]
        self.points, self.offsets = _code_points(self.names)
        self.longest = int(np.diff(self.offsets).max())
        # Punctuation that no piece has right behind a letter: a unit can be cut there.
        behind = {b for name in self.names for a, b in zip(name, name[1:]) if a.isalpha()}
        cuts = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in behind)
        self.cut = rf"(?s)^(?P<word>.*\pL)(?P<rest>[{re.escape(cuts)}].*)$" if cuts else None
        self.flat, self.flat_offsets = np.frombuffer(b"".join(self.text), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in self.text])])

    # Encoding of distinct units ------------------------------------------------------------------------------

    def _edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and start of every occurrence of a piece."""
        alphabet, code = np.unique(points, return_inverse=True)
        code = code + 1  # 0 is the end
        n, bits = len(points), int(len(alphabet) + 2).bit_length()
        each = 63 // bits  # letters in one word
        padded = np.concatenate([code, np.zeros(each + self.longest, np.int64)])
        word = np.zeros(n + self.longest, np.int64)
        for k in range(each):
            word = word << bits | padded[k : k + len(word)]
        # Suffix array: by the first word, then by doubling.
        order = np.argsort(word[:n])
        reach = each
        while True:
            rank = np.zeros(n + max(reach, self.longest) + 1, np.int64)
            key = word[:n] if reach == each else key
            new = np.ones(n, np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank[order] = np.cumsum(new)
            if reach >= self.longest:
                break
            key = rank[:n] * (n + 2) + rank[reach : reach + n]
            order = np.argsort(key)
            reach *= 2
        # Pieces in the same words; those with letters that don't occur have no range.
        sizes = np.diff(self.offsets)
        at = np.searchsorted(alphabet, self.points)
        there = alphabet[np.minimum(at, len(alphabet) - 1)] == self.points
        used = np.flatnonzero(np.minimum.reduceat(there, self.offsets[:-1]))
        words = -(-self.longest // each)
        low = np.zeros((len(used), words * each), np.int64)
        pos = _spread(self.offsets[used], sizes[used])
        row = np.repeat(np.arange(len(used)), sizes[used])
        column = pos - self.offsets[used][row]
        low[row, column] = at[pos] + 1
        high = low.copy()
        high[np.arange(words * each) >= sizes[used][:, None]] = (1 << bits) - 1

        def packed(letters: np.ndarray) -> list[np.ndarray]:
            out = []
            for w in range(words):
                value = np.zeros(len(letters), np.int64)
                for k in range(each):
                    value = value << bits | letters[:, w * each + k]
                out.append(value)
            return out

        def bound(target: list[np.ndarray], after: bool) -> np.ndarray:
            """Number of suffixes before the targets (or not behind them)."""
            left, right = np.zeros(len(used), np.int64), np.full(len(used), n)
            while (left < right).any():
                middle = (left + right) // 2
                suffix = order[np.minimum(middle, n - 1)]
                less = np.zeros(len(used), bool)
                same = np.ones(len(used), bool)
                for w, value in enumerate(target):
                    own = word[np.minimum(suffix + w * each, len(word) - 1)]
                    less |= same & (own < value)
                    same &= own == value
                less |= same & after
                go = left < right
                left = np.where(go & less, middle + 1, left)
                right = np.where(go & ~less, middle, right)
            return left

        first, last = bound(packed(low), False), bound(packed(high), True)
        return np.repeat(used, last - first), order[_spread(first, last - first)]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and the number of ids of each."""
        strings = [u + "\0" for u in units]  # an end mark that no piece has
        points, offsets = _code_points(strings)
        size = np.diff(offsets) - 1
        unit = np.repeat(np.arange(len(units)), size + 1)
        rank, start = self._edges(points)
        length = np.diff(self.offsets)[rank]
        boundary = np.ones(len(points) + 1, bool)
        token = np.full(len(points), -1)
        single = length == 1
        token[start[single]] = self.ids[rank[single]]
        # In the order of units, ranks and places: the three in one number.
        rank, start = rank[~single], start[~single]
        edge = np.sort((unit[start] * len(self.names) + rank) * int(size.max(initial=0) + 1) + start - offsets[unit[start]])
        edge, start = np.divmod(edge, int(size.max(initial=0) + 1))
        of, rank = np.divmod(edge, len(self.names))
        start = start + offsets[of]
        end = start + np.diff(self.offsets)[rank]
        rank, start, end, of = (x.astype(np.int32) for x in (rank, start, end, of))
        if (size > LONG).any():
            self._relax_long(np.flatnonzero(size > LONG), of, rank, start, end, boundary, token, offsets, size)
            short = size[of] <= LONG
            rank, start, end, of = rank[short], start[short], end[short], of[short]
        inside = np.cumsum(boundary, dtype=np.int32)  # boundaries up to and with each place
        while len(rank):
            between = inside[end - 1] - inside[start]
            can = boundary[start] & boundary[end] & (between == 1)
            if not can.any():
                break
            # The first edge of each unit that can be taken is the best one.
            at = np.flatnonzero(can)
            best = at[np.concatenate([[True], of[at][1:] != of[at][:-1]])]
            s, e = start[best], end[best]
            boundary[np.flatnonzero(boundary)[inside[s]]] = False
            token[s] = self.ids[rank[best]]
            # Edges that lost an end, or were taken, or whose unit has nothing left to take, are done.
            active = np.zeros(len(units), bool)
            active[of[best]] = True
            inside = np.cumsum(boundary, dtype=np.int32)
            alive = active[of] & boundary[start] & boundary[end] & (inside[end - 1] > inside[start])
            rank, start, end, of = rank[alive], start[alive], end[alive], of[alive]
        keep = boundary[:-1].copy()
        keep[offsets[1:] - 1] = False  # end marks
        at = np.flatnonzero(keep)
        ids, owner = token[at], unit[at]
        if (ids < 0).any():
            ids, owner = self._fall_back(ids, owner, points[at])
        return ids, np.bincount(owner, minlength=len(units))

    def _relax_long(self, long, of, rank, start, end, boundary, token, offsets, size) -> None:
        """One unit after the other, the best edge first, from a heap."""
        for u in long:
            a, b = np.searchsorted(of, [u, u + 1])
            piece = dict(zip(zip(start[a:b].tolist(), end[a:b].tolist()), rank[a:b].tolist()))
            begin, stop = int(offsets[u]), int(offsets[u] + size[u])
            after = {i: i + 1 for i in range(begin, stop)}
            before = {i + 1: i for i in range(begin, stop)}
            heap = [(piece[i, i + 2], i, i + 2) for i in range(begin, stop - 1) if (i, i + 2) in piece]
            heapq.heapify(heap)
            while heap:
                r, s, e = heapq.heappop(heap)
                middle = after.get(s)
                if middle is None or middle == e or after.get(middle) != e:
                    continue
                after[s], before[e] = e, s
                del after[middle], before[middle]
                boundary[middle] = False
                token[s] = self.ids[r]
                if (p := before.get(s)) is not None and (p, e) in piece:
                    heapq.heappush(heap, (piece[p, e], p, e))
                if (n := after.get(e)) is not None and (s, n) in piece:
                    heapq.heappush(heap, (piece[s, n], s, n))

    def _fall_back(self, ids: np.ndarray, owner: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unknown = np.flatnonzero(ids < 0)
        encoded = [chr(p).encode("utf-8", "surrogatepass") for p in points[unknown]]
        size = np.ones(len(ids), np.int64)
        size[unknown] = [len(e) for e in encoded]
        out = np.repeat(ids, size)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
        return out, np.repeat(owner, size)


class Codec:
    """Encodes and decodes texts; remembers the ids of units."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.int64), np.zeros(1, np.int64)

    def _learn(self, units: list[str]) -> None:
        ids, sizes = self.vocabulary.encode_units(units)
        start, first = int(self.ends[-1]), len(self.ends) - 1
        if start + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:start], ids, np.zeros(len(self.flat) + len(ids), np.int64)])
        else:
            self.flat[start : start + len(ids)] = ids
        self.ends = np.concatenate([self.ends, start + np.cumsum(sizes)])
        self.place.update((u, first + i) for i, u in enumerate(units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array and the number of ids of each text."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        texts = pc.replace_substring(texts, SPACE, " ")
        runs = pc.split_pattern(texts, " ")
        flat = runs.flatten().dictionary_encode()
        offsets = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        distinct, code = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
        # A unit is a run with the spaces before it: its own one and one for each empty run before it.
        n = len(code)
        blank = np.fromiter((not d for d in distinct), bool, len(distinct))[code]
        last = np.zeros(n, bool)
        last[offsets[1:] - 1] = True
        head = np.zeros(n, bool)
        head[offsets[:-1]] = True
        ends = ~blank | last  # the last run of a text ends a unit even if it is empty
        reset = np.where(np.concatenate([[True], ends[:-1]]) | head, np.arange(n), 0)
        spaces = np.arange(n) - np.maximum.accumulate(reset) + 1
        empty_text = np.diff(offsets) == 1
        drop = np.zeros(n, bool)
        drop[offsets[:-1][empty_text]] = blank[offsets[:-1][empty_text]]
        keep = ends & ~drop
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))[keep]
        pair = spaces[keep] * len(distinct) + code[keep]
        pair, which = np.unique(pair, return_inverse=True)
        spaces, run = np.divmod(pair, max(len(distinct), 1))
        word, rest = self._cut(flat.dictionary)
        head = [SPACE * k + word[i] for k, i in zip(spaces.tolist(), run.tolist())]
        units, nth = np.unique(np.array(rest, object)[run], return_inverse=True) if len(run) else (np.array([], object), run)
        if len(self.place) + len(head) + len(units) > REMEMBERED:
            self._forget()
        place = np.stack([self._places(head), self._places(units.tolist())[nth]], axis=1)
        size = self.ends[place + 1] - self.ends[place]
        known = self.flat[_spread(self.ends[place].ravel(), size.ravel())]  # ids of each distinct run
        size = size.sum(1)
        begin = np.cumsum(size) - size
        return known[_spread(begin[which], size[which])], np.bincount(text, size[which], minlength=len(texts)).astype(np.int64)

    def _cut(self, runs: pa.Array) -> tuple[list[str], list[str]]:
        """Runs cut before the last punctuation that ends a unit; the second part may be empty."""
        if self.vocabulary.cut is None:
            return runs.to_pylist(), [""] * len(runs)
        split = pc.extract_regex(runs, self.vocabulary.cut)
        word = pc.coalesce(pc.struct_field(split, "word"), runs)
        return word.to_pylist(), pc.fill_null(pc.struct_field(split, "rest"), "").to_pylist()

    def _places(self, units: list[str]) -> np.ndarray:
        place = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        if len(new := np.flatnonzero(place < 0)):
            self._learn(list(dict.fromkeys(units[i] for i in new)))
            place[new] = [self.place[units[i]] for i in new]
        return place

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """One text for each number of ids; broken UTF-8 is replaced."""
        v = self.vocabulary
        size = v.flat_offsets[ids + 1] - v.flat_offsets[ids]
        data = v.flat[_spread(v.flat_offsets[ids], size)]
        cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        keep = np.ones(len(data), bool)  # all but the space put before each text
        begin = cuts[:-1][np.diff(cuts) > 0]
        keep[begin] = data[begin] != 32
        cuts = np.concatenate([[0], np.cumsum(keep)])[cuts]
        data = data[keep]
        texts = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        try:
            return texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this worker for a model file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, *more: str) -> DataFrame:
    """``doc_id, n_ids, ids`` (little-endian unsigned 32-bit numbers) of every row with an id, and its columns ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path)
        for batch in batches:
            for part in W.slices(batch, "text"):
                ids, counts = of.encode(part.column(1))
                offsets = np.concatenate([[0], np.cumsum(counts)]) * 4
                blobs = pa.Array.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(np.uint32))]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), blobs.cast(pa.binary()), *part.columns[2:]], names=["doc_id", "n_ids", "ids", *more]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).where("doc_id is not null")
    kinds = "".join(f", {name} {docs.schema[name].dataType.simpleString()}" for name in more)
    return rows.mapInArrow(run, f"doc_id long, n_ids long, ids binary{kinds}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The same rows with a column ``decoded``: the texts that ``ids`` stand for; broken UTF-8 is replaced."""
    place = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path)
        for batch in batches:
            for part in W.slices(batch, "ids", 2 * W.SLICE_BYTES):
                data, offsets = W.text_bytes(part.column(place))
                ids = np.frombuffer(data.tobytes(), np.uint32).astype(np.int64)
                texts = of.decode(ids, np.diff(offsets) // 4).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in encoded.dtypes)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")
