"""A log of numbered records in a folder; a number is given out once.

Two writers may try the same number at once: one of them gets it, the other is told and goes on from
what the first has written. The record is written under a name of its own first and then takes its
place in one step, so a reader never sees half of one. On the machine's own files that step is a hard
link, elsewhere a rename; both refuse a name that is taken (so does HDFS; a store of objects must).
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def names(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """(name, seconds of the last change) of what lies in a folder; none if there is no folder."""
    fs, p = hadoop(spark, folder)
    if not fs.exists(p):
        return []
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p)]


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the records, rising."""
    return sorted(int(n[:-5]) for n, _ in names(spark, folder) if n[:-5].isdigit() and n.endswith(".json"))


def _file(folder: str, number: int) -> str:
    return f"{folder}/{number:020d}.json"


def record(spark: SparkSession, folder: str, number: int) -> dict:
    jvm = spark._jvm
    fs, p = hadoop(spark, _file(folder, number))
    stream = fs.open(p)
    try:
        return json.loads(jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine())
    finally:
        stream.close()


def last(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """Number and content of the newest record."""
    known = numbers(spark, folder)
    return (known[-1], record(spark, folder, known[-1])) if known else None


def append(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Create the record ``number``; whether it was free."""
    jvm = spark._jvm
    fs, own = hadoop(spark, f"{folder}/.{uuid.uuid4().hex}.tmp")
    _, target = hadoop(spark, _file(folder, number))
    out = fs.create(own, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return not fs.exists(target) and fs.rename(own, target)
        local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, own)]
        jvm.java.nio.file.Files.createLink(*local)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(own, False)
