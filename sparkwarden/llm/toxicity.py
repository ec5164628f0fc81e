"""Toxicity: misspelled terms by an automaton, and context windows that tell quotation from abuse.

*Lexicon.*  From a bounded sample of labelled texts (``SAMPLE`` of each label, the smallest hashes of ids, of near
copies only a few) come the words, and the stems of inflected words, that toxic texts have far more often.  A walk down the trie of
all prefixes keeps a prefix as a stem where its texts spread over several continuations, and a whole word
where one word accounts for them.  Words too short for a stem may be terms as whole words.  All that pass the tests are terms.

*Automaton.*  The Levenshtein automata of all terms are intersected with the lexicon's trie: a state is a set of
pairs of trie node and edits so far, made deterministic before the scan; many terms get one automaton for every ``GROUP`` of them.  All distinct words of a slice of
texts run through it side by side, one table look-up per character.  Short terms must be spelled right, longer
ones may have one or two edits; stems accept whatever follows.  Words with one or two symbols between them are looked at
together as well (``st*pid``), where none of them is a hit by itself.

*Context.*  For each hit the ``WINDOW`` words around it are looked at: quotation marks, ASCII or typographic, around the hit and words of
reporting or disapproval count as signs of quotation.

*Score.*  A logistic regression on what a text holds: hits that look like abuse, their density, and hits that look like
quotation.  A misspelled hit counts for less than an exact one: by the log odds that its word speaks for abuse, if one toxic hit
in ``1 / MISSPELLED`` is misspelled, given how many clean texts of the sample hold this very word.  Words that the sample
doesn't hold are judged by how many words near the same term only one of its clean texts holds.  The regression is fitted
on the same sample, each text without its own part in these counts.  Labels, language, source and id are no inputs.

Null and empty texts have no hits and get the score of a text without any.  Rows without an id are left out;
rows that repeat an id are scored one by one.  Without labelled rows of both kinds the lexicon is empty
and every score is the share of toxic labels (0 without labels).  Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .fitting import fit_logistic, sigmoid
from .staging import release, stage

SAMPLE = 4000
GROUP, LEAST_TEXTS = 64, 6
#: Least log odds of a term, and least log-likelihood ratio (chance alone gives 30 once in 10**7 terms).
LEAST_ODDS, LEAST_RATIO = 2.0, 30.0
#: Characters of the shortest and the longest stem; whole words may be shorter.
SHORTEST, LONGEST = 4, 12
WINDOW = 8
#: Words that report or reject what others said; they count if they stand in the window of a hit.
REPORTING = "said says wrote called calling quote quoted quoting alleged dit disait sagte schrieb dijo escribió zitat citation cita".split()
_QUOTES = np.zeros(256, bool)
_QUOTES[list(b"\"`")] = True
#: Typographic quotation marks (not the single ones that serve as apostrophes) and blanks.
MARKS, BLANKS = "“”„‟«»‹›「」『』", "\u00a0\u2007\u2009\u202f\u3000"
_ASCII = [(np.frombuffer(c.encode(), np.uint8), b) for s, b in ((MARKS, b'"'), (BLANKS, b" ")) for c in s]


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case, for UTF-8 bytes; typographic marks and blanks as ASCII, padded with blanks."""
    out = W._LOWER[data]
    beyond = np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3))
    for code, plain in _ASCII:
        at = beyond[beyond <= len(data) - len(code)]
        for k, byte in enumerate(code):
            at = at[data[at + k] == byte]
        out[at] = plain[0]
        for k in range(1, len(code)):
            out[at + k] = 32
    capital = np.zeros(len(out), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[capital] += 32
    return out


_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(0x80, 0x100)]] = True


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (letters and digits; bytes beyond ASCII count as letters), and words per text."""
    inside = _INSIDE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begin[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, offsets))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, whatever stands between them."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    terms = W.powers(W._BASE, len(data))
    terms *= data.astype(np.uint64) + np.uint64(1)
    terms *= _INSIDE[data]
    return W.mix(np.add.reduceat(terms, starts) * W._shift_back(starts)) + (ends - starts).astype(np.uint64)


@dataclass
class Term:
    text: bytes
    stem: bool

    @property
    def edits(self) -> int:
        n = len(self.text) - 1 if self.stem else len(self.text)
        return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """Levenshtein automata of the terms intersected with their trie, made deterministic."""

    def __init__(self, terms: list[Term]):
        self.letters = sorted({c for t in terms for c in t.text})
        self.classes = np.zeros(256, np.int64)
        for i, c in enumerate(self.letters):
            self.classes[c] = i + 1
        # Trie nodes: one trie for each number of edits allowed.
        children: list[dict[int, int]] = []
        limit, ends, stems, owner = [], [], [], []

        def node(k: int) -> int:
            children.append({})
            limit.append(k)
            ends.append(False)
            stems.append(False)
            owner.append(-1)
            return len(children) - 1

        roots: dict[int, int] = {}
        for k, t in enumerate(terms):
            at = roots.setdefault(t.edits, None)
            if at is None:
                at = roots[t.edits] = node(t.edits)
            for c in t.text:
                if c not in children[at]:
                    children[at][c] = node(t.edits)
                at = children[at][c]
            ends[at] = True
            stems[at] |= t.stem
            owner[at] = k if owner[at] < 0 else owner[at]

        def closed(states: dict[int, int]) -> frozenset:
            todo = list(states.items())
            while todo:  # leaving out letters of the term
                n, e = todo.pop()
                if e < limit[n]:
                    for m in children[n].values():
                        if states.get(m, 99) > e + 1:
                            states[m] = e + 1
                            todo.append((m, e + 1))
            return frozenset(states.items())

        def step(state: frozenset, c: int | None) -> frozenset:
            out: dict[int, int] = {}

            def put(n: int, e: int) -> None:
                if e <= limit[n] and out.get(n, 99) > e:
                    out[n] = e

            for n, e in state:
                put(n, e + 1)  # a letter too many
                for letter, m in children[n].items():
                    put(m, e if letter == c else e + 1)
            return closed(out)

        start = closed({r: 0 for r in roots.values()})
        number, order = {frozenset(): 0, start: 1}, [frozenset(), start]
        rows = []
        for state in order:  # grows while it is walked
            row = []
            for c in [None, *self.letters]:
                to = step(state, c) if state else state
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        far = (9, -1)
        # Least edits and the first term that they lead to, as one number.
        self.at_end = np.array([_rank(*min([(e, owner[n]) for n, e in s if ends[n]], default=far)) for s in order], np.int64)
        self.on_the_way = np.array([_rank(*min([(e, owner[n]) for n, e in s if stems[n]], default=far)) for s in order], np.int64)

    def edits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Least edits from each word to a term, 9 if there is none."""
        return self.nearest(data, starts, ends)[0]

    def nearest(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits from each word to a term, 9 if there is none, and the number of the first such term, or -1."""
        best = np.full(len(starts), _rank(9, -1), np.int64)
        alive, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        i = 0
        while len(alive):
            over = starts[alive] + i >= ends[alive]
            best[alive[over]] = np.minimum(best[alive[over]], self.at_end[state[over]])
            alive, state = alive[~over], state[~over]
            state = self.table[state, self.classes[data[starts[alive] + i]]]
            best[alive] = np.minimum(best[alive], self.on_the_way[state])
            going = state > 0
            alive, state = alive[going], state[going]
            i += 1
        return best >> 32, (best & 0xFFFFFFFF) - 1


def _rank(edits: int, term: int) -> int:
    return (edits << 32) + term + 1


class Lexicon:
    """The automata of groups of terms; terms keep their numbers."""

    def __init__(self, terms: list[Term]):
        order = sorted(range(len(terms)), key=lambda k: (terms[k].edits, terms[k].text))  # similar ones share a trie
        groups = [order[i : i + GROUP] for i in range(0, len(order), GROUP)]
        self.groups = [(np.array(g, np.int64), Automaton([terms[k] for k in g])) for g in groups]

    def edits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Least edits from each word to a term, 9 if there is none."""
        return self.nearest(data, starts, ends)[0]

    def nearest(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits from each word to a term, 9 if there is none, and the number of the nearest term, or -1."""
        edits, terms = np.full(len(starts), 9, np.int64), np.full(len(starts), -1, np.int64)
        for numbers, automaton in self.groups:
            e, t = automaton.nearest(data, starts, ends)
            closer = e < edits
            edits[closer], terms[closer] = e[closer], numbers[t[closer]]
        return edits, terms


MISSPELLED = 0.05


@dataclass
class Hits:
    """Hits with their texts, and the number of words of each text."""

    words: np.ndarray
    text: np.ndarray
    exact: np.ndarray
    quoted: np.ndarray
    term: np.ndarray
    word: np.ndarray  # its hash

    def table(self, weight: np.ndarray) -> np.ndarray:
        """One row per text: exact hits, misspelled hits by their weights, quoted hits and words."""
        n = len(self.words)
        columns = [np.where(self.exact & ~self.quoted, 1.0, 0.0), np.where(~self.exact & ~self.quoted, weight, 0.0), self.quoted]
        return np.column_stack([*(np.bincount(self.text, c, n) for c in columns), self.words])


def _together(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of two or three words with one or two symbols between them, in all; no longer runs are in reach of two edits."""
    gap = starts[1:] - ends[:-1]
    blank = np.concatenate([[0], np.cumsum(data <= 32)])
    near = (gap <= 2) & (text[1:] == text[:-1]) & (blank[starts[1:]] == blank[ends[:-1]])
    two = np.flatnonzero(near)
    three = np.flatnonzero(near[1:] & near[:-1] & (gap[1:] + gap[:-1] <= 2))
    return np.concatenate([two, three]), np.concatenate([two + 1, three + 2])


def _masked_hits(lexicon: Lexicon, data, starts, ends, hashes, text, hit) -> tuple[np.ndarray, ...]:
    """First and last word, hash, edits and term of hits of words that symbols divide; ``hit`` marks words that are hits by themselves."""
    first, last = _together(data, starts, ends, text)
    known = np.concatenate([[0], np.cumsum(hit)])
    free = known[last + 1] == known[first]
    first, last = first[free], last[free]
    key = W.mix(hashes[first])
    for k in (1, 2):  # symbols and word behind the first and the second word
        more = last - first >= k
        at = first[more] + k
        one, two = data[ends[at - 1]].astype(np.uint64), data[starts[at] - 1].astype(np.uint64)
        symbols = one * np.uint64(256) + two + np.uint64(65536) * (starts[at] - ends[at - 1]).astype(np.uint64)
        key[more] = W.mix(W.mix(key[more] * np.uint64(3) + symbols) + hashes[at])
    _, new, which = np.unique(key, return_index=True, return_inverse=True)
    edits, term = (x[which] for x in lexicon.nearest(data, starts[first[new]], ends[last[new]]))
    found = np.flatnonzero(edits < 9)
    taken = np.zeros(len(starts), bool)
    keep = []
    for i in found[np.lexsort((first[found], last[found] - first[found], edits[found]))]:  # a word belongs to one hit only
        if not taken[first[i] : last[i] + 1].any():
            taken[first[i] : last[i] + 1] = True
            keep.append(i)
    keep = np.array(keep, np.int64)
    return first[keep], last[keep], key[keep], edits[keep], term[keep]


def hits(lexicon: Lexicon, texts: pa.Array) -> Hits:
    data, offsets = W.text_bytes(texts)
    none = np.zeros(0, np.int64)
    data = _lower(data)
    starts, ends, counts = _spans(data, offsets) if len(data) else (none, none, np.zeros(len(texts), np.int64))
    if len(starts) == 0:
        return Hits(counts, none, none.astype(bool), none.astype(bool), none, none.astype(np.uint64))
    hashes = _word_hashes(data, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    edits, terms = (x[which] for x in lexicon.nearest(data, starts[first], ends[first]))
    text = np.repeat(np.arange(len(counts)), counts)
    hit = np.flatnonzero(edits < 9)
    masked = _masked_hits(lexicon, data, starts, ends, hashes, text, edits < 9)
    found = [np.concatenate(x) for x in zip((hit, hit, hashes[hit], edits[hit], terms[hit]), masked)]
    hit, behind, word, edits, terms = (x[np.argsort(found[0], kind="stable")] for x in found)  # first and last words of hits
    # Signs of quotation: an odd number of marks before the hit in its text and a mark behind it in the window.
    marks = np.concatenate([[0], np.cumsum(_QUOTES[data])])
    last = np.cumsum(counts)[text[hit]] - 1
    begin = np.maximum(hit - WINDOW, last + 1 - counts[text[hit]])
    end = np.minimum(behind + WINDOW, last)
    before = marks[starts[hit]] - marks[offsets[text[hit]]]
    opened = (before % 2 == 1) & (marks[starts[hit]] > marks[starts[begin]] - (begin == last + 1 - counts[text[hit]]))
    closed = marks[ends[end] - 1] - marks[ends[behind] - 1] + (marks[np.minimum(ends[end] + 2, offsets[text[hit] + 1])] - marks[ends[end] - 1]) > 0
    telling = np.isin(hashes, _REPORTING_HASHES)
    told = np.concatenate([[0], np.cumsum(telling)])
    quoted = (opened & closed) | (told[end + 1] - told[begin] > 0)
    return Hits(counts, text[hit], edits == 0, quoted, terms, word)


def features(found: np.ndarray) -> np.ndarray:
    """Abuse, whether there is any, its density, and quotation."""
    abuse = found[:, 0] + found[:, 1]
    return np.column_stack([np.log1p(abuse), abuse >= 0.5, np.sqrt(abuse / np.maximum(found[:, 3], 1)), np.log1p(found[:, 2])])


def _hash_of(words: list[str]) -> np.ndarray:
    data, offsets = W.text_bytes(pa.array(words))
    data = _lower(data)
    starts, ends, _ = _spans(data, offsets)
    return _word_hashes(data, starts, ends)


_REPORTING_HASHES = _hash_of(REPORTING)


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that have a word (ended by a blank) or a word that begins so."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                data = _lower(np.frombuffer((text or "").encode(), np.uint8))
                starts, ends, _ = _spans(data, np.array([0, len(data)]))
                raw = data.tobytes()
                words = {raw[a:b].decode(errors="replace") for a, b in zip(starts, ends)}
                keys = {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}
                found[toxic].update(keys | {w + " " for w in words})
            keys = sorted(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([found[t][k] for k in keys], pa.int64()) for t in (0, 1))], names=["term", "clean", "toxic"]
            )


KINDS = 1
_KINDS = np.random.default_rng(12).integers(0, 1 << 64, size=KINDS, dtype=np.uint64) | np.uint64(1)


def _mark_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the minima of a few hash functions over five words in a row: near copies share most of them."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            sets, counts = W.shingles(*W.words(*W.text_bytes(part.column(0))), 5)
            starts = (np.cumsum(counts) - counts)[counts > 0]
            kinds = np.zeros((len(part), KINDS), np.uint64)  # texts without words are of one kind
            for k, a in enumerate(_KINDS):
                if len(starts):
                    kinds[counts > 0, k] = np.minimum.reduceat(W.mix(sets * a), starts)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(np.ascontiguousarray(kinds[:, k]).view(np.int64)) for k in range(KINDS))],
                names=["text", "toxic", "id", *(f"kind_{k}" for k in range(KINDS))],
            )


def choose_terms(counted: dict[str, tuple[int, int]], clean: int, toxic: int) -> list[Term]:
    """Terms among prefixes (and words, ended by a blank) with their numbers of clean and toxic texts."""

    def odds(key: str) -> float:
        a, b = counted[key]
        return float(np.log((b + 0.5) / (toxic + 1)) - np.log((a + 0.5) / (clean + 1)))

    def ratio(key: str) -> float:
        a, b = counted[key]
        share = toxic / (clean + toxic)
        return 2 * (b * np.log(b / ((a + b) * share)) + (a * np.log(a / ((a + b) * (1 - share))) if a else 0))

    good = {k for k, (_, b) in counted.items() if b >= LEAST_TEXTS and odds(k) >= LEAST_ODDS and ratio(k) >= LEAST_RATIO}
    following: dict[str, list[str]] = {}
    for k in good:
        following.setdefault(k[:-1], []).append(k)
    terms = []
    starts = sorted(k for k in good if len(k) <= SHORTEST or k[:-1] not in good)  # others are reached from shorter ones
    for at in starts:  # grows while it is walked
        while True:
            best = max(following.get(at, []), key=lambda k: (counted[k][1], k), default=None)
            if at.endswith(" ") or best is None or counted[best][1] < 0.9 * counted[at][1]:
                break
            starts += sorted(k for k in following[at] if k != best)
            at = best
        # Other continuations of a stem are covered by it.
        terms.append((odds(at), counted[at][1], at))
    terms = sorted(terms, key=lambda t: (-t[1] * t[0], t[2]))
    return [Term(t.rstrip(" ").encode(), not t.endswith(" ")) for _, _, t in terms]


@dataclass
class Spelling:
    """What misspelled hits count, by numbers of clean and toxic texts of the sample.

    ``words`` are the hashes of all misspelled words that the sample holds, ascending, ``seen`` their clean and toxic texts;
    ``usual`` is expected of a word near each term.  ``scale`` brings the log odds of an exact hit to 1.
    """

    words: np.ndarray
    seen: np.ndarray
    usual: np.ndarray
    odds: float
    scale: float

    def _seen(self, word: np.ndarray) -> np.ndarray:
        if len(self.words) == 0:
            return np.zeros((len(word), 2))
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where((self.words[at] == word)[:, None], self.seen[at], 0)

    def weight(self, found: Hits, toxic: np.ndarray | None = None) -> np.ndarray:
        """The weight of each hit; texts of the sample (with labels) are left out of their own counts."""
        seen, usual = self._seen(found.word), self.usual[found.term]
        if toxic is not None:
            own = np.column_stack([~toxic[found.text], toxic[found.text]])
            usual = usual - np.column_stack([(seen[:, 0] == 1) & own[:, 0], np.zeros(len(own), bool)])
            seen = np.maximum(seen - own, 0)
        clean, abuse = (seen + usual).T
        return np.clip((np.log(abuse) - np.log(clean) + self.odds) * self.scale, 0, 1)


def fit_spelling(found: Hits, toxic: np.ndarray, terms: int) -> Spelling:
    """From the hits in the sample and the labels of its texts."""
    n = np.array([(~toxic).sum(), toxic.sum()])
    plain = ~found.quoted

    def texts(keep: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of hits, and clean and toxic texts with each."""
        keys, which = np.unique(key[keep], return_inverse=True)
        pairs = np.unique(np.column_stack([found.text[keep], which]), axis=0)
        return keys, np.column_stack([np.bincount(pairs[toxic[pairs[:, 0]] == t, 1], minlength=len(keys)) for t in (False, True)])

    words, seen = texts(plain & ~found.exact, found.word)
    used, exact = texts(plain & found.exact, found.term)
    usual = np.full((terms, 2), 0.5 / max(terms, 1))
    usual[used, 1] += exact[:, 1]
    usual[:, 1] *= MISSPELLED
    near = np.zeros(len(words), np.int64)
    near[np.searchsorted(words, found.word[plain & ~found.exact])] = found.term[plain & ~found.exact]
    usual[:, 0] += np.bincount(near[seen[:, 0] == 1], minlength=terms)
    with_hit = np.array([len(np.unique(found.text[plain & found.exact & (toxic[found.text] == t)])) for t in (False, True)])
    clean, abused = (with_hit[0] + 0.5) / (n[0] + 1), with_hit[1] / max(n[1], 1)
    scale = 1 / np.log(abused / clean) if abused > clean else 0.0
    return Spelling(words, seen, usual, float(np.log(n[0] + 1) - np.log(n[1] + 1)), float(scale))


@dataclass
class Model:
    automaton: Lexicon
    spelling: Spelling | None
    weights: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        found = hits(self.automaton, texts)
        x = features(found.table(self.spelling.weight(found) if self.spelling else np.zeros(len(found.text))))
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


_DESCRIBED = "toxic int, words long, exact array<boolean>, quoted array<boolean>, term array<long>, word array<long>"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``doc_id, text`` and labels ``doc_id, toxic`` (0 or 1); ids only pick the sample.

    The sample is drawn from the labels, so at most twice ``sample`` ids are broadcast to the texts.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(sample) for t in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")
    picked = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").select("text", "toxic", "id")
    picked = picked.mapInArrow(_mark_kinds, "text string, toxic int, id long, " + ", ".join(f"kind_{k} long" for k in range(KINDS)))
    for k in range(KINDS):  # of near copies few are left, so that no word counts because one text was copied
        same = Window.partitionBy(f"kind_{k}").orderBy("id", "text")
        picked = picked.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    picked = stage(picked.select("text", "toxic"), "labelled")
    totals = {r.toxic: r.n for r in picked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    counted = picked.mapInArrow(_prefix_counts, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    # Only terms that can pass are collected: each text of the bounded sample holds few of them.
    rare = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1)) >= LEAST_ODDS
    found = counted.where((F.col("toxic") >= LEAST_TEXTS) & rare).collect() if clean and toxic else []
    terms = choose_terms({r.term: (r.clean, r.toxic) for r in found}, clean, toxic)
    lexicon = Lexicon(terms)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = hits(lexicon, part.column(0))
                ends = np.searchsorted(found.text, np.arange(len(part) + 1)).astype(np.int32)
                lists = [found.exact, found.quoted, found.term, found.word.view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(found.words), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in lists)],
                    names=["toxic", "words", "exact", "quoted", "term", "word"],
                )

    spelling, weights = None, np.append(np.zeros(4), 35.0 if toxic else -35.0)
    if clean and toxic:
        rows = picked.mapInArrow(describe, _DESCRIBED).collect()  # of the bounded sample
        y = np.array([r.toxic for r in rows], float)
        text = np.repeat(np.arange(len(rows)), [len(r.term) for r in rows])
        kinds = {"exact": bool, "quoted": bool, "term": np.int64, "word": np.int64}
        lists = {k: np.array([x for r in rows for x in r[k]], kind) for k, kind in kinds.items()}
        sample = Hits(np.array([r.words for r in rows]), text, **lists | {"word": lists["word"].view(np.uint64)})
        spelling = fit_spelling(sample, y == 1, len(terms))
        weights = fit_logistic(features(sample.table(spelling.weight(sample, y == 1))), y, ridge=1e-4)
    release(picked)
    return Model(lexicon, spelling, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, score double")
