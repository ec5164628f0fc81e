"""Token ids of whole texts with a public tokenizer, encoding each distinct word once.

The tokenizer must lower-case, drop white space and keep letters apart from punctuation before it looks for
pieces (as ``word_bpe_49k.json`` does).  Then the ids of a text are those of its blank-free runs, and the ids
of a run of Latin letters with ASCII punctuation behind it are those of the lower-case word and of the
punctuation.  Any other run is encoded as it stands.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and other runs that one worker remembers; beyond that it starts afresh.
REMEMBERED = 500_000
#: A special token of the vocabulary, put between runs that are encoded in one call.
BETWEEN = "<|startoftext|>"

# Letters whose lower case and composed form don't depend on what stands beside them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
_RUN = rf"^(?P<word>[{_LETTERS}]+)(?P<rest>[!-&(-/:;=-@\[-`{{-~]*)$"
_WORD = re.compile(f"[{_LETTERS}]+")
# Byte-level vocabularies write a byte as a printable character; these are the ones written differently.
_SHOWN = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173]) if b > 32}


class Encoder:
    """``ids(texts)`` gives the ids of all texts in one array and the number of ids of each text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        # For words in their final form: the same pieces without the steps before them.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)  # ends[i] .. ends[i + 1]: ids of unit i

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, units: list[str]) -> None:
        words, others = [], []
        for unit in units:
            (words if _WORD.fullmatch(unit) else others).append(unit)
        plain = [u for u in others if BETWEEN not in u]
        odd = [u for u in others if BETWEEN in u]
        found, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        words.sort(key=str.isascii)  # words in ASCII are written as they are
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            text = " ".join(part)
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(_SHOWN)
            done = self.bare.encode(text, add_special_tokens=False)
            found.append(np.array(done.ids, np.int32))
            sizes.append(np.bincount(np.array(done.word_ids, np.int64), minlength=len(part)))
        for i in range(0, len(plain), 4096):
            ids = self._encode(BETWEEN.join(plain[i : i + 4096]))
            gaps = np.concatenate([[-1], np.flatnonzero(ids == self.between), [len(ids)]])
            sizes.append(np.diff(gaps) - 1)
            found.append(ids[ids != self.between])
        for unit in odd:
            found.append(self._encode(unit))
            sizes.append(np.array([len(found[-1])]))
        start, first = int(self.ends[-1]), len(self.ends) - 1
        new = np.concatenate(found)
        if start + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[:start], new, np.zeros(len(self.flat) + len(new), np.int32)])
        else:
            self.flat[start : start + len(new)] = new
        self.ends = np.concatenate([self.ends, start + np.cumsum(np.concatenate(sizes))])
        for i, unit in enumerate([*words, *plain, *odd]):
            self.place[unit] = first + i

    def _units(self, texts: list[str]) -> np.ndarray:
        place = np.fromiter(map(self.place.get, texts, repeat(-1)), np.int64, len(texts))
        if len(new := np.flatnonzero(place < 0)):
            self._learn([texts[i] for i in new])
            place[new] = [self.place[texts[i]] for i in new]
        return place

    def _gather(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, size = self.ends[unit], self.ends[unit + 1] - self.ends[unit]
        return self.flat[_spread(begin, size)], size

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        runs = pc.split_pattern(texts, " ")
        flat = runs.flatten().dictionary_encode()
        if len(self.place) + 2 * len(flat.dictionary) > REMEMBERED:
            self._forget()
        split = pc.extract_regex(flat.dictionary, _RUN)
        word = pc.coalesce(pc.utf8_lower(pc.struct_field(split, "word")), flat.dictionary).dictionary_encode()
        rest = pc.fill_null(pc.struct_field(split, "rest"), "").dictionary_encode()
        units = np.stack([
            self._units(word.dictionary.to_pylist())[word.indices.to_numpy()],
            self._units(rest.dictionary.to_pylist())[rest.indices.to_numpy()],
        ], axis=1)
        known, size = self._gather(units.ravel())  # ids of each distinct run
        size = size.reshape(-1, 2).sum(1)
        begin = np.cumsum(size) - size
        place = flat.indices.to_numpy()
        size = size[place]
        bounds = np.concatenate([[0], np.cumsum(size)])[runs.offsets.to_numpy() - runs.offsets[0].as_py()]
        return known[_spread(begin[place], size)], np.diff(bounds)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    top = max(int(begin.max(initial=0)) + int(size.max(initial=0)), int(ends[-1]) if len(ends) else 0)
    kind = np.int32 if top < 1 << 31 else np.int64
    out = np.repeat((begin - (ends - size)).astype(kind), size)
    out += np.arange(len(out), dtype=kind)
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
