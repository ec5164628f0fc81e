"""Which patterns can match which lines, by an inverted index from q-grams of keywords.

A keyword can only match a line that holds its q-grams.  Each keyword is filed under the one of its q-grams that
fewest lines hold.  Texts are read once: the q-grams of their lines meet those of the keywords in a join, and only
the ones that a keyword has go on.  A wanted (text, pattern) pair meets the lines that hold a q-gram of one of the
pattern's keywords; so neither a text nor a list of patterns is ever put together, and the pairs that come
out are at most the wanted ones times their keywords, line by line.

Grams are compared by a fold in which all characters that a match takes for one another are equal: letters beyond ASCII
that have case become a blank on both sides, as do signs beyond ASCII.  What the index gives is confirmed by the match
itself, so folding may only err by giving too much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of
from ..sources.files import stage

#: Characters per gram; keywords that are shorter are filed under themselves.
GRAM = 4
#: Characters whose grams are listed together; a slice of a short piece costs little, wherever it lies in the line.
PIECE = 96


def folded(text: Column) -> Column:
    """Equal for texts that match ignoring case, character by character."""
    # Four letters beyond ASCII match ASCII ones; of the others those with case become a blank.
    plain = F.translate(text, "\u0130\u0131\u017f\u212a", "iisk")
    return F.lower(F.regexp_replace(plain, r"[\P{ASCII}&&\P{Lo}]", " "))


def _grams(word: Column) -> Column:
    size = F.least(F.char_length(word), F.lit(GRAM))
    at = F.sequence(F.lit(1), F.char_length(word) - size + 1)
    return F.transform(at, lambda i: F.substring(word, i, size))


def keyword_grams(patterns: DataFrame) -> DataFrame:
    """``pattern, place, gram`` of every keyword of each pattern; ``patterns`` has ``pattern, keywords``."""
    words = patterns.select("pattern", F.posexplode("keywords").alias("place", "keyword")).where("keyword <> ''")
    return words.select("pattern", "place", F.explode(_grams(folded(F.col("keyword")))).alias("gram")).distinct()


def line_grams(texts: DataFrame, grams: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, gram``: which lines hold which of the given grams, each once."""
    sizes = [r.n for r in grams.select(F.char_length("gram").alias("n")).distinct().collect()]  # 1 to GRAM
    lines = texts.select(key, F.posexplode(lines_of(folded(F.col(text)))).alias("pos", "fold"))
    # Each piece with the characters after it that a gram may reach.
    pieces = F.regexp_extract_all("fold", F.lit(f"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    parts = lines.select(key, (F.col("pos") + 1).alias("line"), F.explode(pieces).alias("piece"))
    at = parts.select(key, "line", "piece", F.explode(F.sequence(F.lit(1), F.char_length("piece"))).alias("at"))
    every = None
    for n in sizes:
        held = at.select(key, "line", F.substring("piece", F.col("at"), F.lit(n)).alias("gram")).join(grams.select("gram"), "gram", "left_semi")
        every = held if every is None else every.unionByName(held)
    if every is None:
        return texts.select(key, F.lit(0).alias("line"), F.lit("").alias("gram")).limit(0)
    return every.distinct()


def candidate_lines(texts: DataFrame, wanted: DataFrame, patterns: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, line, pattern``: the lines of wanted (text, pattern) pairs that may match; all others can't.

    ``wanted`` has ``key, pattern``, each pair once; ``patterns`` ``pattern, keywords``.
    """
    words = stage(keyword_grams(patterns), "keyword-grams")
    held = stage(line_grams(texts, words.select("gram").distinct(), key, text), "line-grams")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    known = words.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # A keyword with a gram that no line holds is filed under that, and meets none.
    filed = known.groupBy("pattern", "place").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).select("pattern", "gram").distinct()
    needed = wanted.select(key, "pattern").join(filed, "pattern")
    return needed.join(held, [key, "gram"]).select(key, "line", "pattern").distinct()
