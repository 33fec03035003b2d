"""Folders and small files on any file system that Spark reads; only names, sizes and single lines pass the driver."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    """A file: its full path, its path below the listed folder, its size and when it was changed."""

    path: str
    below: str
    size: int
    changed: int

    @property
    def name(self) -> str:
        return self.below.rpartition("/")[2]


def _at(spark: SparkSession, path: str):
    """The file system of ``path`` and the path there."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    store = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, store.makeQualified(there)


def files_below(spark: SparkSession, folder: str, ending: str = "") -> list[Entry]:
    """All files below a folder, at any depth, by path; none if the folder is absent. ``ending`` is compared without case."""
    store, there = _at(spark, folder)
    if not store.exists(there):
        return []
    root, found, out = there.toString().rstrip("/") + "/", store.listFiles(there, True), []
    while found.hasNext():
        status = found.next()
        path = status.getPath().toString()
        if path.lower().endswith(ending.lower()):
            out.append(Entry(path, path.removeprefix(root), status.getLen(), status.getModificationTime()))
    return sorted(out, key=lambda e: e.path)


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders right below one."""
    store, there = _at(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(there) if s.isDirectory()) if store.exists(there) else []


def exists(spark: SparkSession, path: str) -> bool:
    store, there = _at(spark, path)
    return store.exists(there)


def first_line(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> str | None:
    """The first line of a file, empty for an empty file, None if it can't be read."""
    java = spark.sparkContext._jvm.java.io
    store, there = _at(spark, path)
    try:
        reader = java.BufferedReader(java.InputStreamReader(store.open(there), encoding))
    except Py4JJavaError:
        return None
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def write_line(spark: SparkSession, path: str, line: str) -> None:
    """A file of one line, written anew."""
    store, there = _at(spark, path)
    stream = store.create(there, True)
    try:
        stream.write(bytearray(line.encode("utf-8")))
    finally:
        stream.close()


def looks_like_parquet(spark: SparkSession, path: str) -> bool:
    """Magic bytes at both ends of a file: a write that broke off lacks the last ones."""
    store, there = _at(spark, path)
    size = store.getFileStatus(there).getLen()
    if size < 12:
        return False
    stream, ends = store.open(there), []
    try:
        for at in (0, size - 4):
            stream.seek(at)
            ends.append(bytes(stream.read() for _ in range(4)))
    except Py4JJavaError:  # checksums of the file system do not fit
        return False
    finally:
        stream.close()
    return ends == [b"PAR1", b"PAR1"]
