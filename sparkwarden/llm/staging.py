"""Intermediate tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder; only a session without it (tests) gets a temporary one.
A staged table outlives lost executors and cuts the lineage.  Tables that the returned DataFrame still
reads can't be deleted here; everything else is released as soon as the next table is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import free_shuffles as free_shuffles, shared_folder


def stage(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def long_rows(spark: SparkSession, rows: int, limit: int) -> Iterator[None]:
    """For tables of long rows that are written inside: so many rows are read together, and about ``limit`` bytes go to Python at once.

    By default thousands of rows are, in the JVM's vectors, which grow by doubling, and in the Python worker.
    """
    settings = {"spark.sql.parquet.columnarReaderBatchSize": rows, "spark.sql.execution.arrow.maxBytesPerBatch": limit}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with null texts as empty; rows without an id are left out.

    Of rows that repeat an id the smallest text stands.  Only those rows are shuffled with their texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.where("doc_id is not null")
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if often.limit(1).count() == 0:
        return docs
    merged = docs.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(often, "doc_id", "left_anti").unionByName(merged)
