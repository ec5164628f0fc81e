import hashlib
import random
import re

import numpy as np
import pytest
from odd_rows import odd_documents
from pyspark.sql import functions as F

from sparkwarden.llm import fm_index, registry

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items):
    """Rows of the query, sorted."""
    grams = {}
    for item, text in items:
        w = tokens(text)
        if item is not None:
            for k in range(max(len(w) - 9, min(len(w), 1))):
                grams.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        ids = ",".join(sorted(found, key=str.encode))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def naive_suffixes(symbols):
    ends = [k for k, s in enumerate(symbols) if s == 0]
    mark = {k: (-len(ends) + n,) for n, k in enumerate(ends)}
    def key(p):
        out = []
        for k in range(p, len(symbols)):
            if symbols[k] == 0:
                return [*out, mark[k][0]]
            out.append(symbols[k])
    return sorted(range(len(symbols)), key=key)


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_and_ranks(seed):
    """Order of suffixes, and search and location of every pattern, against plain loops; many copies and runs."""
    draw = random.Random(seed)
    docs = [[draw.randrange(1, 3 + seed * 4) for _ in range(draw.randrange(0, 40))] for _ in range(12)]
    docs += [docs[3]] * 5 + [[1] * 70, [1] * 33, [], [2, 1] * 40]
    symbols = np.array([s for d in docs for s in [*d, 0]])
    assert fm_index._suffixes(symbols, int(symbols.max()) + 1).tolist() == naive_suffixes(symbols.tolist())

    hashes = fm_index.W.mix(np.array([s for d in docs for s in d], np.uint64))
    columns = dict(zip(fm_index._FIELDS[2:], fm_index._index(hashes, np.array([len(d) for d in docs]))))
    row = {f: c[0].as_buffer() if c.type == fm_index.pa.binary() else c[0].values.to_numpy() for f, c in columns.items()}
    index = fm_index._Index(row)
    patterns = [d[k : k + draw.randrange(1, 11)] for d in docs for k in range(0, len(d), 3)] + [[1, 99], [99], [1] * 10]
    patterns = [p for p in patterns if p]
    sizes = np.array([len(p) for p in patterns])
    grams = np.zeros((len(patterns), 10), np.uint64)
    for k, p in enumerate(patterns):
        grams[k, : len(p)] = fm_index.W.mix(np.array(p, np.uint64))
    which, low, high = index.search(grams, sizes)
    flat, found = symbols.tolist(), dict(zip(which.tolist(), zip(low, high)))
    for k, p in enumerate(patterns):
        places = [q for q in range(len(flat)) if flat[q : q + len(p)] == p]
        assert sorted(index.locate(np.arange(*found[k])).tolist()) == places if places else k not in found


def fixture(seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "naïve", "日本", "x9", "A1"]

    def prose(n):
        return "".join(draw.choice(words) + draw.choice([" ", ", ", ".\n", "-", " '"]) for _ in range(n))

    items = [(k, prose(draw.randrange(8, 60))) for k in range(40)]
    items += [(40, "One two three"), (41, "solo"), (42, None), (43, " .,; "), (7, prose(30)), (None, prose(20)), (44, items[0][1]), (45, "w1 w2")]
    docs = []
    for k in range(150):
        parts = [prose(draw.randrange(0, 50))]
        for _ in range(draw.randrange(0, 3)):
            w = draw.choice(items)[1] or ""
            cut = draw.randrange(0, max(len(w), 1))
            parts += [w[cut:] if draw.random() < 0.6 else w.upper(), prose(draw.randrange(0, 30))]
        docs.append((k, "".join(parts)))
    docs += [(200 + k, docs[5][1]) for k in range(60)]
    docs += [(300, None), (301, ""), (302, "solo"), (303, "SOLO; solo!"), (304, "one TWO three one two"), (305, "one two"), (None, "solo act"), (302, "two rows, solo")]
    return docs, items


@pytest.mark.parametrize("shard,block", [(1 << 19, 1 << 17), (300, 1 << 17), (1000, 40)])
def test_against_brute_force(spark, tmp_path, shard, block):
    """Several shards, and benchmarks of several blocks, give the same as one."""
    docs, items = fixture(shard)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    if shard != 1 << 19:
        rows = fm_index.contamination(d, b, block, shard).withColumn("n", F.size("item_ids"))
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.n_hit > 0) for r in rows.collect()), key=repr)
    else:
        d.write.parquet(f"{tmp_path}/documents.parquet")
        b.write.parquet(f"{tmp_path}/benchmark.parquet")
        rows = registry.op12_decontamination(spark, str(tmp_path))
        assert rows.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        got = sorted((tuple(r) for r in rows.collect()), key=repr)
    assert got == brute_force(docs, items)


def test_shards_are_cut(spark):
    docs, items = fixture(1)
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    one = fm_index.build_index(rows)
    assert one.count() == 1 and fm_index.build_index(rows, 300).count() > 20
    grams = fm_index.windows(spark.createDataFrame(items, "item_id long, text string"))
    assert fm_index.find_windows(one, grams).count() > 0  # the same index serves more than one benchmark
    assert fm_index.find_windows(one, grams.limit(0)).count() == 0


def test_remove_hits(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, f"Before, {passage.upper()}! After."), (2, "clean text"), (3, f"é{passage} {passage}"), (4, f"naïve: {passage} … {passage.replace(' ', '-')}, fin")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(9, passage)], "item_id long, text string")
    found = fm_index.contamination(d, b)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()} == {1: [(1, 12)], 2: [], 3: [(1, 22)], 4: [(1, 12), (13, 24)]}
    cut = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in fm_index.remove_hits(d, found).collect()}
    assert {k: v[0] for k, v in cut.items()} == {1: "Before, ! After.", 3: "éalpha ", 4: "naïve:  … , fin"}
    for k, text in docs:
        if k in cut:
            raw = text.encode()
            for begin, end in reversed(cut[k][1]):
                raw = raw[:begin] + raw[end:]
            assert raw.decode() == cut[k][0]


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    items = [(5, "word17 and3 word18 and4 word19 and5 word20 and6 word21 and0 word22 and1"), (6, "x" * 20_000), (7, "one two"), (8, ""), (9, "größe naïve 日本 größe")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in registry.op12_decontamination(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute_force([(r.doc_id, r.text) for r in docs.collect()], items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in fm_index.contamination(docs, none).collect()} == {0}
    assert fm_index.contamination(docs.limit(0), none).count() == 0
