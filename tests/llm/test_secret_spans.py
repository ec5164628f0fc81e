import math
import re
import time
from collections import Counter

import numpy as np
from odd_rows import odd_documents

from sparkwarden.llm import secret_spans as S
from sparkwarden.llm.registry import QUERIES, SQL

TEXTS = [
    'password = "hunter2xyz" and PASSWD:short API-KEY apikey=abcdef', "token=token:abcdefghi secret: 'abcde'", "AKIA" + "Q7" * 8 + " AKIASHORT",
    "😀 é hex 0123456789abcdef0123456789abcdef end", "deadbeef" * 3 + "x" + "deadbeef" * 2, "key Zx8Qv2Lp0Rt6Yw4Nb1Mc7Kd5 end",
    "550e8400-e29b-41d4-a716-446655440000", "example_Zx8Qv2Lp0Rt6Yw4Nb1Mc7Kd5", "aaaaaaaaaaaaaaaaaaaaaaaaaa1", "nothing here", "", None,
    "2024-06-01-Zx9fQ2LmT7vRk4WpB8nYc3Hd", "/v1/example/Zx9fQ2LmT7vRk4WpB8nYc3Hd x", "KqZvRtYpLmWsXdFgHjBn and qzvrtypLMWSXDFGHJBNkeuia",
    "Zx9fQ2LmT7vRk4WpB8nYc3Hdplaceholder7vRk4WpB8nYc3HdZx9fQ2Lm sample-12345678-xxxxxxx", "/usr/local/share/some-words/HTML_Files-2024/",
    "Donaudampfschifffahrtsgesellschaft getUserNameFromConnection 12345678901234567890987", "😀" * 30 + "Zx9fQ2LmT7vRk4WpB8nYc3Hd=",
    "pre" + "a1" * 15 + "Zx8Qv2Lp0Rt6Yw4Nb1Mc7Kd5Hf" + "b2" * 20, "some-long-slug-with-many-words-2024", "secret==abcdefg secret = =abcdefg",
]


def reference(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(spans)
    for m in re.finditer("[A-Za-z0-9+/=_-]{20,}", text):
        at = m.start()
        for piece, allowed in cut(m[0]):
            begin, at = at, at + len(piece) + len(allowed)
            if len(piece) < 20 or not re.search("[A-Za-z]", piece) or is_uuid(piece) or are_words(piece):
                continue
            limit = 3.05 if re.fullmatch("[0-9a-fA-F]+", piece) else 3.75 if piece.isalnum() else 3.85
            high = [
                i for i in range(len(piece) - 19)
                if -sum(n / 20 * math.log2(n / 20) for n in Counter(piece[i : i + 20]).values()) > limit
            ]
            if high:
                spans.append((begin + high[0], 3, begin + high[-1] + 20, "entropy"))
    return base, sorted(spans)


def cut(candidate):
    """Pieces with the allowed match behind each."""
    allowed = "(example|sample|dummy|placeholder|xxxx|abcdefgh|01234567|12345678|[0-9]{4}-[0-9]{2}-[0-9]{2})"
    parts = [*re.split(allowed, candidate, flags=re.I), ""]
    return list(zip(parts[::2], parts[1::2]))


def is_uuid(piece):
    return bool(re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", piece))


def are_words(piece):
    """Words of up to 14 letters, in one case or with a capital, joined by ``-_/``, and up to four digits at the end."""
    words = re.split("[-_/]+", re.sub("(?<![0-9])[0-9]{1,4}$", "", piece))
    return all(not w or (w.isalpha() and len(w) < 15 and (w.islower() or w.isupper() or (w[0].isupper() and w[1:].islower()))) for w in words)


def test_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in S.find_secrets(docs).collect():
        base, spans = reference(r.text or "")
        assert ([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) == (base, spans), r.text
    assert any(k == "entropy" for t in TEXTS for *_, k in reference(t or "")[1])


def found(spark, text):
    return [tuple(s)[::2] for s in S.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans]


def test_allowed_matches_hide_only_their_windows(spark):
    key = "Zx9fQ2LmT7vRk4WpB8nYc3Hd"
    for before in ("2024-06-01-", "sample/", "backup-2024-06-01-", "/v1/example/"):
        (start, stop), = found(spark, before + key)
        assert len(before) <= start <= len(before) + 1 or before[-1] in "-/" and start == len(before) - 1
        assert stop == len(before + key)
    assert [len(found(spark, t)) for t in (key + "example" + key, key[:12] + "example" + key[12:], "KqZvRtYpLmWsXdFgHjBn")] == [2, 0, 1]


def test_long_candidates_and_many_matches(spark):
    """Time and positions of a candidate of 200,000 characters and of 6,000 matches in one text; both cost linear time."""
    random = np.random.default_rng(3)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    long = "".join(random.choice(alphabet, 200_000))
    many = "".join(f"é token=abc{i:05d} " for i in range(6_000))
    docs = spark.createDataFrame([(1, "x: " + long), (2, many)], "doc_id long, text string")
    begin = time.time()
    rows = {r.doc_id: r for r in S.find_secrets(docs).collect()}
    assert time.time() - begin < 60
    spans = [s for s in rows[1].spans if s.kind == "entropy"]
    assert 1 <= len(spans) < 20 and sum(s.end - s.start for s in spans) > 198_000
    assert [(s.start, s.end) for s in rows[2].base] == [m.span() for m in re.finditer("token=abc[0-9]{5}", many)]
    masked = S.mask_secrets(docs.where("doc_id = 2")).first().text
    assert masked == "é [SECRET] " * 6_000


def test_masks(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as spans", "2 as base")
    for r in S.mask_secrets(docs).collect():
        text, at, out = TEXTS[r.doc_id], 0, ""
        for start, _, end, _ in reference(text or "")[1]:
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert r.text == (None if text is None else out + text[at:]) and (r.spans, r.base) == (1, 2)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = S.find_secrets(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [tuple(s) for s in r.spans] == reference(r.text or "")[1]
    assert S.find_secrets(docs.limit(0)).count() == 0


def test_query_against_sql(spark):
    from conftest import MEDIUM
    from oracle_check import compare, duck

    name = "op5_secret_scan"
    assert compare(spark, duck(MEDIUM), MEDIUM, QUERIES[name], SQL[name]) is None


def test_no_python(spark):
    from conftest import SMALL

    plan = QUERIES["op5_secret_scan"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
