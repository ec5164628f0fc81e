import random
import re

import pytest
from odd_rows import odd_documents

from sparkwarden.llm import near_dedup
from sparkwarden.llm.near_dedup import near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_copies(spark, monkeypatch, width):
    """Groups of copies with very different numbers of edits: many buckets have members that don't link to the hub."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    draw = random.Random(width)
    rows = []
    for base in range(4):
        words = [f"w{draw.randrange(400)}" for _ in range(90)]
        for _ in range(30):
            copy = list(words)
            for _ in range(draw.randrange(0, 14)):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy).replace("w1", "W1")))
    draw.shuffle(rows)
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width))
    assert got == brute_force(rows, width, 80)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    got = near_duplicates(docs, 2)
    assert got.count() == len(rows)  # a repeated id has one row, a null id none
    assert result(got) == brute_force(rows.items(), 2, 80)
    assert near_duplicates(docs.limit(0), 2).count() == 0
