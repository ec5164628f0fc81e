"""From documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept:

1. ``quality_classifier`` drops the documents that co-training rejects (labels come from ``labels``).
2. ``near_dedup`` keeps the document of smallest id of each group of near duplicates (sets of five-word
   shingles with a similarity of 0.8 or more).
3. ``suffix_dedup`` cuts passages of 100 bytes and more that an earlier document holds; what is left stays
   valid UTF-8, and a document that loses everything stays as an empty one.
4. ``secret_scan`` masks secrets.
5. ``packing`` tokenizes and packs what is left into sequences of at most 4096 tokens.

All but the last return the columns of ``documents``, with ``n_chars`` brought up to date where a text changed.
Further columns are handed on.  Rows without an id can't be named by a decision: they stay until the last
stage, which leaves them out.  Rows that repeat an id with different texts (in the first stage also with another source or
language) are documents of their own: one of them stands for the id, the others come after all ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import quality
from sparkwarden.llm.bit_set import parted
from sparkwarden.llm.near_dedup import near_duplicates
from sparkwarden.llm.packing import pack
from sparkwarden.llm.secret_spans import mask_secrets
from sparkwarden.llm.staging import free_shuffles, stage
from sparkwarden.llm.suffix_dedup import cut_repeats, find_repeats
from sparkwarden.sources.files import read_table

#: The result depends on a fitted model, on hashes and on a tokenizer.
ORACLE_SQL = None


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows with a key ``__row``: the id, but for rows of an id that differ from its first kind in the columns a hash from 2**62 on."""
    key = F.col("doc_id").cast("long")
    often = docs.where("doc_id is not null").groupBy(key.alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__id")
    if often.limit(1).count() == 0:
        return docs.withColumn("__row", key)
    content = F.xxhash64("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in docs.columns))
    kinds = docs.join(often, key == F.col("__id"), "left_semi").groupBy(key.alias("__id")).agg(
        F.min(content).alias("__first"), F.max(content).alias("__last")
    )
    kinds = stage(kinds.where("__first <> __last").drop("__last"), "repeated_ids")
    other = content.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    joined = docs.join(kinds, key == F.col("__id"), "left")
    return joined.withColumn("__row", F.when(content != F.col("__first"), other).otherwise(key)).drop("__id", "__first")


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("__row")).drop("__row")


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows without those of the keys; only rows that may have one of them are moved."""
    gone = stage(keys.select(F.col("doc_id").alias("__id")), "gone")
    clear, others = parted(rows, "__row", gone)
    return clear.unionByName(others.join(gone, others["__row"] == gone["__id"], "left_anti")).drop("__row")


def _once(rows: DataFrame) -> DataFrame:
    """One row of each key, the smallest; only rows whose key repeats are moved."""
    often = rows.where("__row is not null").groupBy("__row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("__row").alias("__key"))
    if often.limit(1).count() == 0:
        return rows
    often = stage(often, "repeated_rows")
    same = rows["__row"] == often["__key"]
    order = F.struct(*(c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind))
    merged = rows.join(often, same, "left_semi").groupBy("__row").agg(F.min_by(F.struct(*rows.columns), order).alias("row"))
    merged = merged.select("row.*")
    return rows.join(often, same, "left_anti").unionByName(merged)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = _keyed(docs, "text", "source", "lang")
    others = rows.where("__row <> doc_id").select("doc_id", "__row").distinct()
    others = labels.join(others, "doc_id").select(F.col("__row").alias("doc_id"), "label")
    return _without(rows, quality.classify(_by_key(rows), labels.unionByName(others)).where(~F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_shuffles(spark)  # of the stage before
    rows = _once(_keyed(docs, "text"))
    return _without(rows, near_duplicates(_by_key(rows), width=5, percent=80).where(~F.col("kept")))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_shuffles(spark)  # of the stage before
    rows = _keyed(docs, "text")
    found = find_repeats(_by_key(rows))
    cut = cut_repeats(found, whole_characters=True).select(F.col("doc_id").alias("__id"), F.col("kept").cast("string").alias("__kept"))
    clear, others = parted(rows, "__row", found.ids)
    joined = others.join(cut, others["__row"] == cut["__id"], "left")
    joined = joined.withColumn("text", F.coalesce("__kept", "text")).drop("__id", "__kept")
    return _counted(clear.unionByName(joined).drop("__row"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mask_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
