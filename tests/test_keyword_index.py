"""Many patterns through the inverted index give what each pattern tried on each text gives."""

import random

from pyspark.sql import functions as F

from sparkwarden.operators import keyword_index, keywords


CHARACTERS = "aAkKsSiIéÉß\u1e9e\u017f\u0131\u0130\u212a\u212båÅﬁjñÑ日本Σσςωあア+"


def fixture(spark, n_patterns=120):
    draw = random.Random(5)
    words = ["tok", "token", "License", "2.0.", "a+b", "Straße", "É", "x", "naïve plan", "ſecret", "K", "the", "über(all)", "日本", "", "end$"]
    lists = [["token", "the"], ["É"], ["x"], ["zzzz-none"], [""], None, ["a", "ab", "abc"]]
    lists += [[draw.choice(words) + draw.choice(["", str(k % 17), " "]) for _ in range(draw.randrange(1, 5))] for k in range(n_patterns)]
    accounts = spark.createDataFrame([(f"acct_{k}", v) for k, v in enumerate(lists)], "account_id string, keywords array<string>")
    texts = []
    for k in range(40):
        lines = [" ".join(draw.choice(words + ["TOKEN16", "straSSe", "STRASSE", "é2", "tHe", "K", "ﬁ", "abcabc"]) + draw.choice(["", "3", "!"]) for _ in range(draw.randrange(0, 30))) for _ in range(draw.randrange(1, 6))]
        texts.append((f"b{k}", "\n".join(lines)))
    texts += [("empty", ""), ("null", None), ("long", "filler " * 20_000 + "token16" + " x" * 500), ("ends", "\ntoken\n\n")]
    return accounts, spark.createDataFrame(texts, "blob_sha string, text string")


def rows(df):
    return sorted(map(repr, df.select("blob_sha", "pattern", "line", "match_ord", "match").collect()))


def test_index_equals_trying_each_pattern(spark):
    accounts, texts = fixture(spark)
    patterns = keywords.distinct_patterns(accounts)
    owned = keywords.keyword_patterns(accounts).select("pattern").distinct()
    # Each text wants some of the patterns, one text wants them all.
    wanted = texts.select("blob_sha").join(owned, (F.xxhash64("blob_sha", "pattern") % 3 == 0) | (F.col("blob_sha") == "b7"))
    wanted = wanted.select("blob_sha", "pattern")
    tried = keywords.wanted_matches(texts, wanted, patterns, "blob_sha", index_from=1 << 30)
    indexed = keywords.wanted_matches(texts, wanted, patterns, "blob_sha", index_from=1)
    assert rows(indexed) == rows(tried) and len(rows(tried)) > 500
    columns = ["blob_sha", "pattern", "line", "severity", "redacted_evidence", "match_ord"]
    both = [sorted(map(repr, keywords.wanted_findings(texts, wanted, patterns, "blob_sha", index_from=n).select(columns).collect())) for n in (1, 1 << 30)]
    assert both[0] == both[1]


def test_ten_thousand_patterns_on_one_blob(spark):
    """No list per blob, no copy of the text per pattern, and only patterns that can match are tried."""
    n = 10_000
    accounts = spark.range(n).select(F.concat(F.lit("acct_"), F.col("id")).alias("account_id"), F.array(F.concat(F.lit("word"), F.col("id"), F.lit(";"))).alias("keywords"))
    text = "Licence\n" + "\n".join(f"line {k} names word{k * 400}; and nothing else" for k in range(25))
    texts = spark.createDataFrame([("licence", text)], "blob_sha string, text string")
    patterns = keywords.distinct_patterns(accounts)
    wanted = patterns.select(F.lit("licence").alias("blob_sha"), "pattern")
    lines = keyword_index.candidate_lines(texts, wanted, patterns, "blob_sha")
    assert 25 <= lines.count() < 4_000  # of 260,000 pairs of a line and a pattern
    found = keywords.wanted_matches(texts, wanted, patterns, "blob_sha")
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    assert {(r.line, r.match) for r in found.collect()} == {(k + 2, f"word{k * 400};") for k in range(25)}


def test_folds_are_equal_for_whatever_matches(spark):
    """Every pair of characters that the match takes for one another has one fold."""
    pairs = [(a, b) for a in CHARACTERS for b in CHARACTERS]
    df = spark.createDataFrame(pairs, "a string, b string")
    java = keywords._java(F.regexp_replace("a", r"([+])", r"\\$1"))
    df = df.select("a", "b", F.regexp_like("b", java).alias("hit"), (keyword_index.folded(F.col("a")) == keyword_index.folded(F.col("b"))).alias("same"))
    wrong = [(r.a, r.b) for r in df.collect() if r.hit and not r.same]
    assert not wrong, wrong
