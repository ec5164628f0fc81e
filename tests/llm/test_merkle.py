import hashlib
import zlib
from itertools import groupby

import pytest
from odd_rows import odd_documents
from pyspark.sql import functions as F

from sparkwarden.llm import registry
from sparkwarden.llm.merkle import folded, manifest, proof, row_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves, arity):
    """Root and, per leaf, its siblings as (left, right) of each level."""
    nodes, members, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        above, owners = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for slot in range(len(run)):
                for i in members[k + slot]:
                    paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            above.append(digest(*run))
            owners.append([i for m in members[k : k + arity] for i in m])
        nodes, members = above, owners
    return nodes[0], paths


def low(value):
    return -1 if value is None else value


def brute_force(rows, arity=16):
    """Rows of the query from ``doc_id, text, lang, source, n_chars``."""
    rows = [(i, s, leaf_of(i, s, lang, n, t), leaf_of(i, s, lang, n, t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)), t) for i, t, lang, s, n in rows]
    rows.sort(key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, low(r[0]), r[2]))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    trees = [tree([r[2] for r in g], arity) for g in groups]
    root, upper = tree([t[0] for t in trees], arity) if trees else (None, [])
    out = []
    for group, (subroot, paths), tail in zip(groups, trees, upper):
        for (i, _, leaf, changed, _), path in zip(group, paths):
            path = path + tail
            fold = changed if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf
            for left, right in path:
                fold = digest(left, fold, right)
            out.append((i, leaf, subroot, root, digest(*(left + right for left, right in path)), fold, fold == root))
    return sorted(out, key=repr)


def query(spark, rows, folder, schema=SCHEMA):
    rows = rows if hasattr(rows, "write") else spark.createDataFrame(rows, schema)
    rows.write.parquet(f"{folder}/documents.parquet")
    got = registry.op13_merkle_manifest(spark, str(folder))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_brute_force(spark, tmp_path):
    """Sources of one row, of exactly one run, of one more, and of several levels; a null source and an empty one."""
    sizes = {None: 3, "": 17, "a": 1, "b": 16, "c": 257, "ä": 33, "Z": 2} | {f"s{k}": 1 for k in range(12)}
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            i += 1
            text = None if i % 31 == 0 else "" if i % 37 == 0 else f"Text {i} é" * (i % 4)
            rows.append((i * 7 % 401, text, None if i % 5 else "en", source, None if i % 11 == 0 else len(text or "")))
    got = query(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), tmp_path)
    assert got == brute_force(rows)
    changed = [r for r in got if not r[6]]
    assert changed and all(zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in changed)


@pytest.mark.parametrize("arity,n", [(2, 13), (3, 28), (16, 40)])
def test_arities(spark, arity, n):
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("g"), row_digest(F.col("id")).alias("leaf")).repartition(3)
    made = manifest(rows, "g", "k", "leaf", arity)
    leaves = [digest(f"{len(str(i))}:{i}") for i in range(n)]
    root, paths = tree(leaves, arity)
    assert made.root == root
    got = made.leaves.select("k", proof(F.col("path")).alias("p"), folded(F.col("leaf"), F.col("path")).alias("f")).collect()
    assert {r.k: (r.p, r.f) for r in got} == {i: (digest(*(a + b for a, b in paths[i])), root) for i in range(n)}


def test_fields_are_unambiguous(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "-"), ("-", None), ("", "1:a"), ("1:a", "")], "x string, y string")
    assert rows.select(row_digest(F.col("x"), F.col("y")).alias("d")).distinct().count() == 6


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark).unionByName(odd_documents(spark).where("doc_id in (1, 9)"))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    assert query(spark, docs, tmp_path) == brute_force(rows)


def test_one_row_and_none(spark, tmp_path):
    one = [(5, "Only", "en", "s", 4)]
    got = query(spark, one, tmp_path / "one")
    assert got == brute_force(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == digest()
    assert query(spark, [], tmp_path / "none") == []
