"""Rows that every operator has to take: nulls, empty and long texts, repeats, clashing column names."""

from pyspark.sql import functions as F

PROSE = (
    "The committee met on Tuesday to look at the plans for the new bridge over the river and asked for more time. "
    "Several members wanted to see the figures again before they agreed to anything that could not be undone later. "
)


def odd_documents(spark, extra=()):
    long = " ".join(f"word{i} and{i % 7}" for i in range(6000))
    rows = [
        (0, PROSE, "en"), (1, PROSE, "en"), (2, PROSE + "A closing remark.", None), (3, None, "en"), (4, "", "de"),
        (5, " \n\t ", None), (6, "one", "en"), (7, "one", "en"), (8, "one two", None), (9, long, "en"),
        (10, "x" * 20_000, "en"), (11, "größe naïve 日本 " * 30, "fr"), (None, "no id at all", "en"), (12, "same id", "en"), (12, "same id", "en"),
        *extra,
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # Columns of names that operators use themselves.
    for name in ("score", "kept", "bucket", "component_id", "spans", "length", "label", "place", "row"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.char_length("text").cast("long"))


def by_id(df, *columns):
    return {r[0]: (r[1] if len(columns) == 2 else tuple(r[1:])) for r in df.select(*columns).collect()}
