"""Helpers shared by the training-data operators: tables, shared folders, expressions."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE_RUN = r"[\x20\x09-\x0D]+"


#: What one Arrow batch to a Python worker may hold; texts and sets differ in length by a factor of thousands.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches to ours; their buffers lie outside an executor's heap and grow with the largest."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def bounded_batches(spark: SparkSession):
    """``bound_batches`` for jobs that run inside; afterwards the session has its own settings again."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    bound_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def in_parts(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes, for the way back to the JVM."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


_HELD: dict = {}


def worker_memo(key, make):
    """What a Python worker keeps between tasks under ``key``: one thing at a time, so stages do not pile up in reused workers."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return a worker's freed memory to the system (where the C library can)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one of our own only if it is unset and Spark runs in one process."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("/tmp/casewise-shared")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_OF_STAGE: dict = {"open": False, "tables": []}  # tables that the last pipeline stage wrote for itself


def staged(stage):
    """A pipeline stage whose tables in the shared folder last until the next stage begins, when its result has been written."""

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        for old in _OF_STAGE["tables"]:
            discard(old)
        _OF_STAGE.update(open=True, tables=[])
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _OF_STAGE["open"] = False

    return run


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the reread table.

    Lineage ends at durable files that any executor can read, so a lost executor costs a reread only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/casewise/{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    written = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    if _OF_STAGE["open"]:
        _OF_STAGE["tables"].append(written)
    return written


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/casewise/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice shuffles that nothing refers to any more, so executors delete their files now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> None:
    """Let executors collect garbage and return heap that they do not need, so native memory (state stores, Python) has room."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc')").collect()


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name
