import random
import re

import numpy as np
import pyarrow as pa
from odd_rows import odd_documents

from sparkwarden.llm import toxicity as T
from sparkwarden.llm.registry import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    draw = random.Random(4)
    terms = [T.Term(b"scum", False), T.Term(b"clown", False), T.Term(b"clownish", False), T.Term(b"disgusting", False), T.Term(b"lowei", True), T.Term(b"achlich", True)]
    automaton = T.Automaton(terms)
    words = []
    for _ in range(600):
        w = bytearray(draw.choice(terms).text)
        for _ in range(draw.randrange(4)):
            k = draw.randrange(len(w) + 1)
            draw.choice([lambda: w.insert(k, draw.randrange(97, 123)), lambda: w.__delitem__(slice(k, k + 1)), lambda: w.__setitem__(slice(k, k + 1), bytes([draw.randrange(97, 123)]))])()
        words.append(bytes(w) + draw.choice([b"", b"", b"ness"]) or b"x")
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = automaton.edits(data, ends - [len(w) for w in words], ends)
    for word, edits in zip(words, got):
        best = 9
        for t in terms:
            candidates = [word[:n] for n in range(len(word) + 1)] if t.stem else [word]
            best = min(best, min((d for d in (distance(t.text, c) for c in candidates) if d <= t.edits), default=9))
        assert edits == best, word


def labelled(n=400):
    draw = random.Random(1)
    common = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "so") for b in ("lo", "ne", "pu") for c in ("", "n", "sti")]
    rows = []
    for i in range(n):
        words = [draw.choice(common) for _ in range(60)]
        toxic = int(i % 5 == 0)
        for _ in range(3 if toxic else 0):
            words.insert(draw.randrange(60), draw.choice(["worthless", "pathetic", "vequ" + draw.choice(common)]))
        rows.append((i, " ".join(words), toxic))
    return rows, common


def test_misspelling_quotation_and_clean_texts(spark):
    rows, common = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    filler = " ".join(common[:20])
    plain, wrong, stem, clean, quoted, reported = model.score(pa.array([
        f"{filler} you WORTHLESS and pathetic lot {filler}", f"{filler} worthles and pathhetic and worthlesss {filler}", f"{filler} vequabc {filler} vequxyz",
        f"{filler} {filler}", f'{filler} they shouted "worthless" and more {filler}', f"{filler} he said worthless {filler}",
    ]))
    assert plain > 0.9 and stem > 0.9 and clean < 0.1
    assert wrong > clean and quoted < 0.5 and reported < 0.5 and quoted < plain


def test_odd_rows(spark):
    rows, _ = labelled()
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = odd_documents(spark)
    model = T.fit(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    scores = T.score(docs, model).collect()
    assert len(scores) == docs.where("doc_id is not null").count()
    assert all(0 <= r.score < 0.5 for r in scores)
    assert T.score(docs.limit(0), model).count() == 0
    # Labels of one kind or none, and labels without documents.
    none = train.select("doc_id", "toxic").limit(0)
    assert {r.score for r in T.score(docs, T.fit(docs, none)).collect()} == {float(T.sigmoid(np.array(-35.0)))}
    one = spark.createDataFrame([(0, 1), (999, 1), (None, 1), (3, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.9 for r in T.score(docs, T.fit(docs, one)).collect())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op1_toxicity"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right, n = scored.selectExpr("sum(cast(predicted = toxic as int))", "count(*)").first()
    assert n > 500 and right >= 0.97 * n


def test_misspelled_terms_on_the_given_tables(spark):
    """One letter of every term left out: most such texts are still found, and clean texts stay clean."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held_out = "crc32(cast(doc_id as string)) % 5 = 0"
    model = T.fit(docs, labels.where(f"not {held_out}"))
    rows = docs.join(labels.where(held_out), "doc_id").where("text is not null").select("text", "toxic").collect()
    toxic, clean = ([r.text for r in rows if r.toxic == t] for t in (1, 0))
    words = sorted({w for t in toxic for w in re.findall(r"[^\W_]+", t.lower())})
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = ends - [len(w.encode()) for w in words]
    edits = model.automaton.edits(np.frombuffer("".join(words).encode(), np.uint8), starts, ends)
    terms = {w for w, e in zip(words, edits) if e == 0 and len(w) > 4}

    def misspelled(match):
        w = match[0]
        return w[: len(w) // 2] + w[len(w) // 2 + 1 :] if w.lower() in terms else w

    wrong = [re.sub(r"[^\W_]+", misspelled, t) for t in toxic]
    assert sum(a != b for a, b in zip(wrong, toxic)) > 0.8 * len(toxic)
    assert (model.score(pa.array(wrong)) >= 0.5).mean() > 0.5
    assert (model.score(pa.array(clean)) >= 0.5).mean() < 0.02


def test_every_term_that_passes_is_kept():
    draw = random.Random(6)
    words = sorted({"".join(draw.choice("abcdefghijklm") for _ in range(draw.randrange(3, 11))) for _ in range(150)})
    terms = T.choose_terms({f"{w} ": (0, 40) for w in words} | {"pathe": (0, 300), "pathet": (0, 290), "pathei": (0, 25)}, 1000, 1000)
    assert {t.text.decode() for t in terms} == {*words, "pathet", "pathei"}
    lexicon, tried = T.Lexicon(terms), [w[:k] + w[k + 1 :] for w in words for k in range(len(w))] + words
    data = "".join(tried).encode()
    ends = np.cumsum([len(w) for w in tried])
    edits, nearest = lexicon.nearest(np.frombuffer(data, np.uint8), ends - [len(w) for w in tried], ends)
    for word, e, k in zip(tried, edits, nearest):
        reached = [distance(t.text, word.encode()) for t in terms if not t.stem and distance(t.text, word.encode()) <= t.edits]
        assert e == min(reached, default=9) and (e == 9 or distance(terms[k].text, word.encode()) == e)


def test_short_and_masked_terms(spark):
    rows, common = labelled()
    rows = [(i, text.replace("worthless", "zax worthless"), toxic) for i, text, toxic in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    filler = " ".join(common[:20])
    texts = ["zax and zax", "zaxo and zxa", "worth*ess and path.tic, worth**ss", "worth ess and path tic", "worth-while and-or path/tic/of tic"]
    found = T.hits(model.automaton, pa.array(texts))
    assert found.table(np.ones(len(found.text)))[:, :2].tolist() == [[2, 0], [0, 0], [0, 3], [0, 0], [0, 1]]
    short, other, masked, apart = model.score(pa.array([f"{filler} {t} {filler}" for t in texts[:4]]))
    assert short > 0.5 > other and masked > 0.5 > apart


def test_typographic_marks_and_long_words(spark):
    """Marks of every language tell quotation, and stand beside words without being part of them."""
    lexicon = T.Lexicon([T.Term(b"worthless", False)])
    texts = [f"they wished {a}you are worthless{b} on the wall" for a, b in ("“”", "„“", "«»", "»«", "‹›", "「」", '""')]
    texts += ["« worthless\u00a0» stands there", "they wished you are worthless on the wall", "it’s worthless"]
    found = T.hits(lexicon, pa.array(texts))
    assert found.text.tolist() == list(range(len(texts))) and found.exact.all()
    assert found.quoted.tolist() == [True] * 8 + [False] * 2
    long = "x" * 40 + "donaudampfschiff"
    rows = [(long if t else "plain words", t) for t in (0, 1) for _ in range(3)]
    (batch,) = pa.table({"text": [r[0] for r in rows], "toxic": [r[1] for r in rows]}).to_batches()
    (counted,) = T._prefix_counts(iter([batch]))
    assert {"term": long + " ", "clean": 0, "toxic": 3} in counted.to_pylist()
