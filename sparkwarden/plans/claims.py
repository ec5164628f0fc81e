"""Numbers that only one run can get, and the one small file that makes a run count.

A number is claimed by creating a file that must not exist yet, which the file system grants to one caller.
A run's outputs count once its commit file is there; that file is written under another name and renamed, so a
reader sees all of it or nothing.  Only names and a few numbers pass through the driver, one per run.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

_NUMBER = re.compile(r"(\d+)(\.json)?")


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def names(spark: SparkSession, folder: str, empty_files: bool = True) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    files, path = _files(spark, folder)
    found = files.listStatus(path) if files.exists(path) else []
    return sorted(f.getPath().getName() for f in found if empty_files or f.getLen())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return [int(m.group(1)) for m in map(_NUMBER.fullmatch, names(spark, folder)) if m]


def create(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if there is one already.  Of several callers at once one gets True."""
    files, at = _files(spark, path)
    files.mkdirs(at.getParent())
    whole = files.makeQualified(at).toString()
    if urlparse(whole).scheme == "file":  # where Hadoop looks first and creates then, in two steps
        try:
            os.close(os.open(unquote(urlparse(whole).path), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        files.create(at, False).close()
    except Exception:  # a lost race, if the file is there now
        if files.exists(at):
            return False
        raise
    return True


def write_whole(spark: SparkSession, path: str, content: dict) -> None:
    """A small JSON file that appears complete."""
    files, at = _files(spark, path)
    files.mkdirs(at.getParent())
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(part, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not files.rename(part, at):
        raise FileExistsError(path)


def read_whole(spark: SparkSession, path: str) -> dict:
    files, at = _files(spark, path)
    stream = files.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def claim(spark: SparkSession, folder: str) -> int:
    """The next number, which no other caller has or will get."""
    number = max(_numbers(spark, f"{folder}/claims"), default=0) + 1
    while not create(spark, f"{folder}/claims/{number:010d}"):
        number += 1
    return number


def commit(spark: SparkSession, folder: str, number: int, **content) -> None:
    """Makes the outputs of the run with a claimed number count."""
    write_whole(spark, f"{folder}/commits/{number:010d}.json", content)


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the runs that count, in order."""
    return _numbers(spark, f"{folder}/commits")


def commit_of(spark: SparkSession, folder: str, number: int) -> dict:
    return read_whole(spark, f"{folder}/commits/{number:010d}.json")
