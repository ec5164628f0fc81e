import random

import pytest
from odd_rows import odd_documents

from sparkwarden.llm.suffix_dedup import remove_repeats


def brute_force(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(data[p : p + 100])
        if any(gone):
            spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(data)))
            out[i] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()}


def texts(seed):
    draw = random.Random(seed)

    def prose(n):
        return "".join(draw.choice("abcdefg hij é") for _ in range(n))

    shared, out = [prose(k) for k in (99, 100, 101, 130, 400)], []
    for i in range(60):
        out.append(prose(draw.randrange(0, 300)) + draw.choice(shared) + prose(draw.randrange(0, 90)) + draw.choice(shared)[draw.randrange(40) :])
    out += ["ab" * 200, "ab" * 130, "z" * 99, "z" * 100, "z" * 250, out[3], out[3], out[4][:120], "q" * 50 + out[5]]
    return list(enumerate(out))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_against_brute_force(spark, hot):
    """With a low limit most buckets take the way of hot ones."""
    rows = texts(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(remove_repeats(df, hot=hot)) == brute_force(rows)


def test_whole_characters(spark):
    rows = [(i, f"{i}" * 3 + "aé日" * 60 + "é" * i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = remove_repeats(df, whole_characters=True).collect()
    exact = brute_force(rows)
    assert {r.doc_id for r in cut} == set(exact)
    for r in cut:
        bytes(r.kept).decode()
        assert r.n_removed <= exact[r.doc_id][1]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert result(remove_repeats(docs)) == brute_force(rows.items())
    assert remove_repeats(docs.limit(0)).count() == 0
