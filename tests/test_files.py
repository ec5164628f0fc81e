"""Folders, streams and archives of files."""

import os
import shutil
import zipfile

from pyspark.sql import functions as F

from sparkwarden.sources import files as src
from sparkwarden.streaming import jobs


def test_named_files_round_trip(spark, tmp_path):
    rows = [(1, "a/b c.txt", "x\ny\n"), (2, ".env", ""), (3, "50%=ü.md", "é\n\n"), (4, "big", "z" * 1000), (5, "n", None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    folder = src.write_text_files(df, str(tmp_path / "files"), "doc_id", "path")
    back = src.read_named_text_files(spark, folder, "doc_id long, path string")
    assert sorted((r.doc_id, r.path, r.text, r.size) for r in back.collect()) == [(i, p, t or "", len((t or "").encode())) for i, p, t in rows]
    small = src.read_named_text_files(spark, folder, "doc_id long, path string", max_file_bytes=5)
    assert {r.doc_id for r in small.collect()} == {1, 2, 3, 5}
    plan = small.where("doc_id = 1")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,6)]" in plan and "PartitionFilters" in plan


def test_folders_are_listed_by_a_few_tasks(spark, tmp_path):
    """One task a folder would take more time than the files."""
    df = spark.range(150).selectExpr("id as doc_id", "'p' as path", "'x' as text").repartition(4)
    folder = src.write_text_files(df, str(tmp_path / "files"), "doc_id", "path")
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(setting), spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        files = src.read_named_text_files(spark, folder, "doc_id long, path string")
        jobs_ = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("listing")]
        tasks = [context.statusTracker().getStageInfo(s).numTasks for job in jobs_ for s in job.stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * context.defaultParallelism
    assert files.count() == 150 and spark.conf.get(setting) == before


def test_many_named_files(spark, tmp_path):
    """Names stay texts, rows with the same names share a file, few tasks read, and Hadoop's writer (two processes a file) has no part in it."""
    rows = [(i, f"{i:03}", f"text {i}") for i in range(60)] + [(7, "007", "again"), (None, "a+b %41", "x")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").coalesce(1)
    folder = src.write_text_files(df, str(tmp_path / "files"), "doc_id", "path")
    assert len(list((tmp_path / "files").rglob("part-*"))) == 61 and not list((tmp_path / "files").rglob("*.crc"))
    files = src.read_named_text_files(spark, folder, "doc_id long, path string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert files.select("*").rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(i, p, t) for i, p, t in rows if i != 7} | {(7, "007", "text 7\nagain")}
    assert {(r.doc_id, r.path, r.text) for r in files.collect()} == want
    one = files.where("doc_id = 7")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan()
    one._jdf.collect()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert plan.metrics().apply("numFiles").value() == 1  # others are not opened
    # the layout is that of Spark's own writer
    df.write.partitionBy("doc_id", "path").text(str(tmp_path / "spark"))
    again = src.read_named_text_files(spark, str(tmp_path / "spark"), "doc_id long, path string")
    assert sorted(map(str, again.collect())) == sorted(map(str, files.collect()))


def test_only_the_result_stays(spark, tmp_path):
    """What a step stages on its way is deleted once its result is written, so it doesn't lie beside what later steps write."""
    from conftest import SMALL
    from sparkwarden.catalog import queries

    kept = []

    def inner():
        kept.append(src.stage(spark.range(9).toDF("x"), "deepest").inputFiles()[0])
        return spark.read.parquet(os.path.dirname(kept[0])).where("x > 1")

    def outer():
        middle = src.stage_result(spark, inner, "inner")
        kept.append(middle.inputFiles()[0])
        return middle.where("x > 2")

    out = src.stage_result(spark, outer, "outer")
    assert out.count() == 6 and not any(os.path.exists(f.removeprefix("file://")) for f in kept)

    shutil.copytree(SMALL, tmp_path / "tables")
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    found = queries.findings(spark, str(tmp_path / "tables"))
    stayed = {name.rsplit("-", 1)[0] for name in set(os.listdir(base)) - before}
    assert found.count() > 0 and "findings" in stayed and not stayed & {"commits", "files", "keyword-files", "keyword-lines", "keyword-grams", "line-grams"}


def test_archives(spark, tmp_path):
    def pack(name, members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in members.items():
                z.writestr(path, content)

    pack("one.zip", {"src/a.ts": "token = 1\n", "empty.txt": "", "dir/": "", "bad.bin": b"\xff\xfe ok", "large.log": "x" * 5000})
    pack("two.zip", {"é.md": "naïve"})
    (tmp_path / "three.zip").write_bytes(b"not an archive")
    found = src.read_archives(spark, str(tmp_path / "*.zip"), max_file_bytes=100)
    got = {(os.path.basename(r.archive), r.path): (r.size, r.text) for r in found.collect()}
    assert got == {
        ("one.zip", "src/a.ts"): (10, "token = 1\n"), ("one.zip", "empty.txt"): (0, ""), ("one.zip", "bad.bin"): (5, "�� ok"),
        ("two.zip", "é.md"): (6, "naïve"),
    }
    assert src.read_archives(spark, str(tmp_path / "one.zip")).where(F.col("path") == "large.log").first().size == 5000


def test_files_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for n in range(1, 3):
        (tmp_path / "in" / ("deep" if n > 1 else "") / f"{n}.txt").write_text(f"text {n}\n" * n)
    stream = src.stream_text_files(spark, str(tmp_path / "in"), files_per_batch=1)
    out = jobs.append_to_table(stream.select("size", "text"), "files", str(tmp_path / "out"))
    assert sorted((r.size, r.text) for r in out.collect()) == [(7, "text 1\n"), (14, "text 2\n" * 2)]
