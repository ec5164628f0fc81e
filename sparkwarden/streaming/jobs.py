"""Streaming runs of the batch operators.

The detectors are stateless column expressions, so a stream of arriving files goes through the same
functions as a table.  A stream's checkpoint takes the place of the cursor table.  State and output
live below the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import running_totals
from ..plans.claims import names
from ..sources.files import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Arriving parquet files of one table, which may be files or folders of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def keep_state_on_disk(spark: SparkSession) -> None:
    """Key state outgrows executor memory at scale; RocksDB keeps it on local disk with snapshots
    in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def append_to_table(stream: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """Runs the stream over everything that has arrived and returns its output table."""
    spark = stream.sparkSession
    base = folder or shared_folder(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint")
        .option("path", f"{base}/table")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def write_batches(
    stream: DataFrame, purpose: str, per_batch: Callable[[DataFrame], DataFrame], mode: str,
    folder: str | None = None,
) -> DataFrame:
    """Stores ``per_batch`` of each micro-batch under its batch id.

    A batch that is run again after a failure overwrites its own folder, so nothing counts twice.  A stream that
    nothing has reached yet has no batches, and gives no rows.
    """
    spark = stream.sparkSession
    base = folder or shared_folder(spark, purpose)

    def store(batch: DataFrame, batch_id: int) -> None:
        per_batch(batch).write.mode("overwrite").parquet(f"{base}/table/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not names(spark, f"{base}/table"):
        return per_batch(spark.createDataFrame([], stream.schema)).withColumn("batch_id", F.lit(0)).where(F.lit(False))
    return spark.read.parquet(f"{base}/table")


def ledger_totals(batches: DataFrame, group: Sequence[str], count: str, total: str) -> DataFrame:
    """Running totals over batches, from the counts of each batch.

    A batch that ran twice has written its counts once (``write_batches``), so the totals are as if it ran once.  Batch ids
    are dense positions, so no group meets in one task, however many batches it has.
    """
    every = batches.groupBy(*group, "batch_id").agg(F.sum(count).alias(count))
    return running_totals(every, list(group), "batch_id", {count: total})


def fold_ledger(batches: DataFrame, group: Sequence[str], count: str, upto: int) -> DataFrame:
    """The batches up to ``upto`` as one row per group under that number; totals of later batches stay as they were."""
    at = F.when(F.col("batch_id") <= upto, F.lit(upto)).otherwise(F.col("batch_id")).cast("long")
    return batches.groupBy(*group, at.alias("batch_id")).agg(F.sum(count).alias(count))


def unique_findings(findings: DataFrame, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """One finding per repository, file, rule and line.

    Without a delay the stream remembers every key for good: a copy counts as one however late it comes, and
    the state, which grows with the number of different findings, is kept by RocksDB.  With a delay copies are
    found among findings at most that far apart in event time, and older keys are forgotten.
    """
    keyed = findings.withColumn("line0", F.coalesce("line", F.lit(0)))
    keys = ["repo", "path", "rule", "line0"]
    if delay is None:
        return keyed.dropDuplicates(keys)
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def severity_counts(findings: DataFrame, event_time: str, delay: str, width: str) -> DataFrame:
    """Findings per time window and severity."""
    return (
        findings.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width).alias("window"), "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "severity", "n")
    )


def latest_counts(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last count written for every key."""
    return batches.groupBy(*keys).agg(F.max_by("n", "batch_id").alias("n"))


def first_seen(listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that the stream has not met before."""
    return listed.select(*keys).dropDuplicates(list(keys))
