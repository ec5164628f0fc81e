import random

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import odd_documents

from sparkwarden.llm import pieces
from sparkwarden.llm.registry import QUERIES

library = pytest.importorskip("sentencepiece")
PATH = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def direct():
    return library.SentencePieceProcessor(model_file=PATH)


def test_ids_are_those_of_the_library(direct):
    draw = random.Random(2)
    texts = [
        "", "a", " a", "  a  b ", " ", "   ", "a\nb\tc", "日本語 テスト 👩‍👩‍👧", "<s>x</s> <unk> <0x41>", "▁▁a▁", "aaaaaaaa aaaaaaa", "é é ﬁ",
        "x" * 300 + " " + "ab" * 400, "the" * 100, "    def f(x):\n        return  x\n", "internationalization's re-evaluation 3.14159 != 2,718",
        *("".join(draw.choice("aeinorst lm.é日\n") for _ in range(draw.randrange(200))) for _ in range(200)),
    ]
    codec = pieces.Codec(PATH)
    ids, counts = codec.encode(pa.array([*texts, None]))
    ends = np.cumsum(counts)
    for text, a, b in zip([*texts, ""], ends - counts, ends):
        assert ids[a:b].tolist() == direct.encode(text), text
    assert codec.decode(ids, counts).to_pylist() == [t.replace("▁", " ") for t in [*texts, ""]]


def test_long_units_and_short_ones_agree(direct, monkeypatch):
    codec = pieces.Codec(PATH)
    units = ["▁" + u for u in ("internationalization", "a" * 40, "abcabcabc", "unbelievableness", "日本語")]
    short = codec.vocabulary.encode_units(units)
    monkeypatch.setattr(pieces, "LONG", 2)
    long = codec.vocabulary.encode_units(units)
    assert all((a == b).all() for a, b in zip(short, long))


def test_odd_rows(spark, direct):
    docs = odd_documents(spark)
    rows = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    texts = sorted((r.doc_id, r.text or "") for r in docs.where("doc_id is not null").collect())
    assert sorted((r.doc_id, r.decoded) for r in rows) == texts
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == direct.encode(r.decoded) and r.n_ids == len(r.ids) // 4
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_query_gives_texts_back(spark):
    from conftest import MEDIUM

    rows = QUERIES["op3_sentencepiece"](spark, MEDIUM).collect()
    assert len(rows) == 1000 and all(r.round_trip for r in rows)
