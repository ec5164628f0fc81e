import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import odd_documents

from sparkwarden.llm import packing
from sparkwarden.llm.packing import Rules, pack
from sparkwarden.llm.registry import QUERIES
from sparkwarden.llm.tokens import Encoder

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(40))
def test_rules_place_every_rank_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([1, 7, 30, 100, 4096])
    counts = Counter(min(capacity, max(1, int(draw.paretovariate(1) * draw.choice([1, 3, capacity / 6])))) for _ in range(draw.choice([0, 1, 5, 50, 3000])))
    rules, bins, got = Rules(counts, capacity), defaultdict(list), Counter()
    for size, first, last, base, each, offset in rules.rows:
        for k in range(first, last):
            nth, place = divmod(k - first, each)
            bins[base + nth].append((offset + place * size, size))
            got[size] += 1
    assert got == counts and len(bins) == rules.sequences
    for members in bins.values():
        end = 0
        for offset, size in sorted(members):
            assert offset == end
            end += size
        assert end <= capacity
        assert sum(3 * size > capacity for _, size in members) <= 2
    least = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    assert rules.sequences <= 1.25 * least + 1


def test_ids_are_those_of_the_tokenizer():
    texts = [
        "a b ́c Ἀθῆναι ΣΑΣ x<|startoftext|>y <|endoftext|>  \x1c q\x0b\x0cz 'S it'S 12٣ w\r\n é ﷺ İ ǅ", "", " ", "\x00a",
        "<|startoftext|> <|startoftext|>", "日本語 テスト 👩‍👩‍👧", "Über, straße. WORD!? (x) it's don't... é́ ſs", "a" * 9000,
    ]
    direct = tokenizers.Tokenizer.from_file(PATH)
    ids, counts = Encoder(PATH).ids(pa.array([*texts, None]))
    ends = np.cumsum(counts)
    for text, a, b in zip([*texts, ""], ends - counts, ends):
        assert ids[a:b].tolist() == direct.encode(text, add_special_tokens=False).ids


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 4)
    docs = odd_documents(spark)
    rows = pack(docs, PATH, capacity=256).collect()
    direct = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.where("doc_id is not null").collect():
        want[r.doc_id, np.array([*direct.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    by_doc, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.start == 256 * r.piece
        by_doc[r.doc_id].setdefault(r.piece, bytes(r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {(d, b"".join(p[k] for k in sorted(p))) for d, p in by_doc.items()} == set(want)
    assert sum(r.piece == 0 for r in rows) == sum(want.values())
    for members in sequences.values():
        members.sort()
        assert [o for o, _ in members] == [sum(n for _, n in members[:k]) for k in range(len(members))]
        assert sum(n for _, n in members) <= 256
    assert pack(docs.limit(0), PATH).count() == 0


def test_query_digest(spark):
    from conftest import SMALL

    row = QUERIES["op8_best_fit_packing"](spark, SMALL).where("piece = 0 and doc_id = 1").first()
    text = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id = 1").first().text
    ids = [*tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1][:4096]
    assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
