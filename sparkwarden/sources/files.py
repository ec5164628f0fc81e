"""Readers for texts, archives and image records, and the folder that all executors share."""

from __future__ import annotations

import io
import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without that setting gets a temporary folder of this machine, as in tests; a
    cluster without it is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkwarden-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: The paths that ``stage`` has written for each ``stage_result`` under way.
_under_way: list[list[str]] = []


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table that several later steps read; it outlives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    if _under_way:
        _under_way[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_result(spark: SparkSession, make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """Stages what ``make`` returns, and deletes the tables that it staged on its way and the shuffle files of both.

    Otherwise these lie on disk beside all that later steps write.
    """
    _under_way.append([])
    try:
        out = stage(make(), purpose)
    finally:
        *others, path = _under_way.pop() or [None]
    for other in others:
        folder = spark._jvm.org.apache.hadoop.fs.Path(other)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if _under_way:
        _under_way[-1].append(path)
    free_shuffles(spark)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets the shuffle files of finished steps go before the next large one.

    Spark deletes them once the driver's JVM has collected what refers to them, which it makes sure of by a
    periodic collection; that is asked for here.  What a running or later step needs is still referred to.
    """
    for _ in range(2):
        time.sleep(0.3)  # until listeners have let go of the last step
        spark._jvm.System.gc()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_blobs(blobs: DataFrame, table: str, buckets: int) -> DataFrame:
    """A blob table bucketed by blob_sha: joins on blob_sha then leave the texts where they are."""
    blobs.write.bucketBy(buckets, "blob_sha").sortBy("blob_sha").saveAsTable(table)
    return blobs.sparkSession.table(table)


def read_text_files(
    spark: SparkSession, paths: str | list[str], max_file_bytes: int | None = None
) -> DataFrame:
    """Whole files of any size as ``path, size, text``; bytes that are not UTF-8 are replaced.

    A size filter is for callers who want one: it reaches the source, so larger files are listed but never
    opened.  ``plans.scan`` has its own limit and lists what it skips.
    """
    raw = spark.read.format("binaryFile").load(paths)
    if max_file_bytes is not None:
        raw = raw.where(F.col("length") <= max_file_bytes)
    return raw.select(
        F.col("path"),
        F.col("length").alias("size"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def write_text_files(texts: DataFrame, folder: str, *names: str, text: str = "text") -> str:
    """One file per row, in folders named after the values of ``names``, which together must be unique.

    As any text file it ends with a line end, which ``read_named_text_files`` takes away again.  On a mounted file system
    the tasks write the files themselves: without its native library Hadoop starts two ``chmod`` processes per file there.
    """
    rows = texts.select(*names, F.coalesce(text, F.lit("")).alias("text"))
    spark = texts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() != "file":
        rows.write.partitionBy(*names).text(folder)
        return folder
    if os.path.lexists(uri.getPath()):
        raise FileExistsError(folder)
    values = rows.select(*[F.col(n).cast("string") for n in names], F.col("text").cast("binary")).sortWithinPartitions(*names)
    values.mapInArrow(_write_files(uri.getPath(), names), "files long").agg(F.sum("files")).collect()
    os.makedirs(uri.getPath(), exist_ok=True)
    return folder


#: The characters that Spark escapes in the names of folders, and what stands there for null and empty values.
_ESCAPES = {i: f"%{i:02X}" for i in [*range(1, 32), *map(ord, "\"#%'*/:=?\\\x7f{[]^")]}
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _write_files(root: str, names: tuple[str, ...]):
    """Rows of names and texts, ordered by the names, as files below ``root``, laid out as Spark does.

    A file gets its name when it is whole, so an attempt that ends early leaves nothing that is read, and one that is
    repeated writes the same files.  Rows of a task with the same names are one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.txt"
        hidden = f".{name}.{context.taskAttemptId()}"
        last, place, out, files = None, "", None, 0

        def close() -> None:
            out.close()
            os.replace(f"{place}/{hidden}", f"{place}/{name}")

        for batch in batches:
            for *values, text in zip(*(column.to_pylist() for column in batch.columns)):
                if values != last:
                    if out is not None:
                        close()
                    folders = [f"{n.translate(_ESCAPES)}={v.translate(_ESCAPES) if v else _NO_VALUE}" for n, v in zip(names, values)]
                    last, place, files = values, "/".join([root, *folders]), files + 1
                    os.makedirs(place, exist_ok=True)
                    out = open(f"{place}/{hidden}", "wb")
                out.write(text)
                out.write(b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files])], names=["files"])

    return run


def read_named_text_files(spark: SparkSession, folder: str, schema: str, max_file_bytes: int | None = None) -> DataFrame:
    """Files that ``write_text_files`` wrote, with the values in their folders' names (``schema``) as columns.

    Folders are listed in parallel, and both the size filter and filters on names reach the source, so other files
    are never opened.  The names are taken from the files' paths, since Spark's own columns of folders take time that
    grows with the square of their number.  A scan packs only a few small files into a part, as opening one counts as 4 MB;
    parts are read in turn by a few tasks per core.
    """
    # by default up to 10,000 tasks list folders, one or a few each; here each core lists some shares of them
    setting, shares = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), shares))
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    finally:
        spark.conf.set(setting, before)
    if max_file_bytes is not None:
        raw = raw.where(F.col("length") <= max_file_bytes + 1)
    raw = raw.select("length", "content", F.col("_metadata.file_path").alias("place")).coalesce(shares)

    def value(name: str) -> Column:
        # blanks and letters beyond ASCII may be escaped as in addresses, and what Spark has escaped then is so twice
        once = F.url_decode(F.replace("place", F.lit("+"), F.lit("%2B")))
        found = F.regexp_extract(once, f".*/{re.escape(name.translate(_ESCAPES))}=([^/]*)/", 1)
        return F.url_decode(F.replace(F.nullif(found, F.lit(_NO_VALUE)), F.lit("+"), F.lit("%2B")))

    names = [value(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema.fields]
    content = F.make_valid_utf8(F.substring("content", F.lit(1), F.octet_length("content") - 1).cast("string"))
    return raw.select(*names, (F.col("length") - 1).alias("size"), content.alias("text"))


def stream_text_files(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Whole files as they arrive in a folder or folders below it: ``path, size, text``.  Empty files don't arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.load(folder)
    return raw.select("path", F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_archives(spark: SparkSession, paths: str | list[str], max_file_bytes: int | None = None) -> DataFrame:
    """Members of zip archives as ``archive, path, size, text``; bytes that are not UTF-8 are replaced.

    A member's size is looked up in the archive's list, so larger ones are not unpacked.  Members are unpacked one by
    one; folders and members under a password are left out, and what is no archive has no members.
    """
    limit = max_file_bytes

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
                except zipfile.BadZipFile:
                    continue
                for m in archive.infolist():
                    if m.is_dir() or m.flag_bits & 1 or (limit is not None and m.file_size > limit):
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()]), pa.array([m.filename]), pa.array([m.file_size]), pa.array([archive.read(m)], pa.binary())],
                        names=["archive", "path", "size", "content"],
                    )

    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    found = raw.mapInArrow(members, "archive string, path string, size long, content binary")
    return found.select("archive", "path", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_image_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One JSON document per file as ``path, meta_json``."""
    return read_text_files(spark, paths).select("path", F.col("text").alias("meta_json"))


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Account list from JSON lines; ``account_ord`` in the file gives the order."""
    schema = (
        "account_id string, user string, enabled boolean, contact_email string, cc_email string, "
        "keywords array<string>, account_ord int"
    )
    return spark.read.schema(schema).json(path)
