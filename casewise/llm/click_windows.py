"""Expiring deduplication of clicks on a row-based transformWithState (operator 11).

Copies of a click within ``SPAN`` hours of the first are repeats of it; a window is forgotten when the
stream's watermark has passed it, so state holds only what can still meet a repeat. ``cut_batches``
deals the copies into folders of the shared directory, which stand for what arrived between two
starts; ``follow`` starts one streaming query for each on a single checkpoint.

Clicks are hashed to buckets, the grouping key. A task first packs the copies of a bucket into one row
(a map-side combine: rows of transformWithState cost about 25 microseconds of Python each). A bucket
keeps two MapStates: windows by click, ``PAGES`` pages of packed entries because an entry of its own
costs about 150 microseconds to write, and a timing wheel, deadline hour to the clicks whose window
ends then. One timer a bucket stands at the wheel's earliest slot; when the watermark passes it, all
due slots are drained. A slot's entry whose window has since been replaced is passed over.

The watermark trails the largest event time by ``LATENESS`` hours and a millisecond, so copies at the
boundary are not late and a slot is due only when its hour lies before the boundary. What a batch has
made due leaves at the next start, before new rows are looked at, under the number of the batch that
closed it; so each start is one micro-batch. A last row far ahead in the final batch moves the watermark
past every window, and one more micro-batch without rows lets them go.

Each opening of a RocksDB store leaves some half a megabyte of counters (on 8 processors) that Spark 4.1 never frees, so an
executor's native memory grows with partitions times starts. Before every third start executors therefore collect their
garbage and return what heap the cut and earlier starts had grown.

A click with more than ``heavy`` rows would make its bucket large: of its copies only those with the
least hash of some (batch, hour) can ever open a window, so all others are summed up by hour before
the stream sees them; what remains grows with the hours, not with the rows.

Defined results: rows without an id or an arrival time have no copies (ids below zero have one); null
fields are empty in the hash; equal rows are repeats without conflict, and rows equal in hour and hash
are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .common import give_back, materialize, shared_dir, shrink_heaps, table

SPAN, LATENESS, BATCHES = 72, 48, 12
#: Windows of a bucket are kept in so many packed pages.
PAGES = 8
#: Copies that a bucket gets in a batch, about; and those that a task packs at once.
BUCKET_COPIES, PACK_COPIES = 32_768, 100_000
LEAST_BUCKETS = 32
#: Copies of a batch for one state partition, about; each keeps a store of its own, so small streams get few.
PARTITION_COPIES = 50_000
HEAVY = 50_000
#: Windows in one row of the result, at most, and starts between two collections of the executors' garbage.
CLOSED_ROWS, SHRINK_STARTS = 4_000, 3
#: Hours that event times lie after 1970 at least, so that no watermark is held at zero.
AHEAD = 240
HOUR_MS = 3_600_000

COPY = np.dtype([("id", "<i8"), ("hour", "<i8"), ("n", "<i8"), ("crc", "<i8"), ("hash", "V32")])
WINDOW = np.dtype([("id", "<i8"), ("start", "<i8"), ("repeats", "<i8"), ("conflicts", "<i8"), ("crc", "<i8"), ("hash", "V32")])

SOURCE = "click_id long, hour long, n long, crc long, hash binary, at timestamp"
PACKED = "click_id array<long>, start_hour array<long>, closed_batch long, n_repeats array<long>, n_conflicts array<long>, conflict_crc array<long>, hash array<string>"
RESULT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the streaming query and the cut need of a session while they run.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.maxConcurrentOutputFileWriters": "64",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 in UTC of a timestamp with or without a zone."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(name)
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")


def copies_of(clicks: DataFrame) -> DataFrame:
    """(click_id, hour, lag_hour, hash, crc): every row's copies, with the hour each is seen and the hour it arrives in the stream."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fields = [text(F.col("client_id")), text(F.col("kind")), text(F.floor(100 * F.col("value") + 0.5).cast("long")), text(_micros(clicks, "ts")), text(F.col("props"))]
    micros = _micros(clicks, "arrived_at")
    rows = clicks.where("click_id is not null and arrived_at is not null").select(
        F.col("click_id").cast("long").alias("click_id"),
        ((micros - F.pmod(micros, F.lit(1000 * HOUR_MS))) / F.lit(1000 * HOUR_MS)).cast("long").alias("base_hour"),
        F.concat_ws("|", *fields).alias("fields"),
    )
    dealt = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("click_id") % 3).cast("int"))))
    dealt = dealt.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string"))))
    dealt = dealt.withColumn("hour", F.col("base_hour") + 6 * F.col("j") * (F.col("c") % 10))
    hashed = F.sha2(F.concat_ws("|", "fields", (F.col("c") % 3).cast("string")), 256)
    return dealt.select("click_id", "hour", (F.col("hour") + F.floor(F.col("c") / 10) % 200).alias("lag_hour"), hashed.alias("hash"))


def _lightened(copies: DataFrame, clicks: DataFrame, heavy: int) -> DataFrame:
    """(batch, click_id, hour, hash, n, crc): copies, with those of heavy clicks that can open no window summed up by hour."""
    named = copies.select("batch", "click_id", "hour", F.unhex("hash").alias("hash"), F.lit(1).cast("long").alias("n"), F.crc32("hash").alias("crc"))
    ids = materialize(clicks.where("click_id is not null").groupBy(F.col("click_id").cast("long").alias("click_id")).count().where(F.col("count") > heavy).select("click_id"), "click-heavy")
    if ids.isEmpty():
        return named
    large = named.join(ids, "click_id", "left_semi")
    openers = large.groupBy("batch", "click_id", "hour").agg(F.min("hash").alias("hash")).select("click_id", "hash", F.lit(True).alias("opens")).distinct()
    openers = materialize(openers, "click-openers")
    rest = F.unhex(F.lit("ff" * 32))
    summed = large.join(openers, ["click_id", "hash"], "left").withColumn("hash", F.when(F.col("opens"), F.col("hash")).otherwise(rest))
    summed = summed.groupBy("batch", "click_id", "hour", "hash").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    return named.join(ids, "click_id", "left_anti").unionByName(summed)


@dataclass(frozen=True)
class Cut:
    """What was cut: least and largest hour, and the number of copies."""

    first: int
    last: int
    copies: int


def cut_batches(clicks: DataFrame, folder: str, batches: int = BATCHES, heavy: int = HEAVY) -> Cut | None:
    """Write the copies of ``clicks`` under ``folder`` as batch=0, 1, ... by arrival; None without any."""
    copies = copies_of(clicks)
    ends = copies.agg(F.min("lag_hour").alias("low"), F.max("lag_hour").alias("high"), F.min("hour").alias("first"), F.max("hour").alias("last"), F.count("*").alias("n")).first()
    if not ends.n:
        return None
    batch = F.expr(f"cast(((lag_hour - {ends.low}L) * {batches}) div {ends.high - ends.low + 1} as int)")
    rows = _lightened(copies.withColumn("batch", batch), clicks, heavy)
    beyond = ends["last"] + SPAN + LATENESS + 2
    last = clicks.sparkSession.range(1, numPartitions=1).selectExpr(f"{batches - 1} as batch", "cast(null as long) as click_id", f"{beyond}L as hour", "cast(null as binary) as hash", "0L as n", "0L as crc")
    at = F.timestamp_seconds((F.col("hour") - ends["first"] + AHEAD) * 3600)
    rows.unionByName(last).withColumn("at", at).write.partitionBy("batch").option("compression", "zstd").parquet(folder)
    return Cut(ends["first"], ends["last"], ends.n)


def _packer(buckets: int):
    """Copies of one bucket as one row (bucket, packed), for as many copies as a task holds at once; rows without a click are left out."""

    def packed(copies: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        copies, bucket = copies[order], bucket[order]
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        parts = [copies[a:b].tobytes() for a, b in zip(at, np.r_[at[1:], len(copies)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            batch = batch.filter(batch["click_id"].is_valid())
            if not batch.num_rows:
                continue
            copies = np.empty(batch.num_rows, COPY)
            for field, column in (("id", "click_id"), ("hour", "hour"), ("n", "n"), ("crc", "crc")):
                copies[field] = batch[column].to_numpy(zero_copy_only=False)
            copies["hash"] = np.frombuffer(b"".join(batch["hash"].to_pylist()), "V32")
            waiting.append((copies, batch["bucket"].to_numpy(zero_copy_only=False)))
            n += len(copies)
            if n >= PACK_COPIES:
                yield packed(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting, n = [], 0
        if waiting:
            yield packed(*map(np.concatenate, zip(*waiting, strict=True)))
        waiting = []
        give_back()

    return pack


class ClickWindows(StatefulProcessor):
    """Open windows of one bucket's clicks during the start number ``batch`` of the stream that was ``cut``."""

    def __init__(self, batch: int, cut: Cut):
        self.batch, self.cut, self.shift = batch, cut, AHEAD - cut.first

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "page int", "packed binary")
        self.wheel = handle.getMapState("wheel", "deadline long", "ids binary")

    def close(self) -> None:
        give_back()

    def _boundary(self, timers) -> int:
        """Windows whose deadline lies before this hour are over, and so are copies."""
        return (timers.getCurrentWatermarkInMs() + 1) // HOUR_MS - self.shift

    def _open(self) -> dict[int, list]:
        held = {}
        for _, (packed,) in self.windows.iterator():
            page = np.frombuffer(bytes(packed), WINDOW)
            hashes = page["hash"].tobytes()
            values = zip(*(page[k].tolist() for k in ("id", "start", "repeats", "conflicts", "crc")), strict=True)
            held.update((key, [*rest, hashes[32 * i : 32 * i + 32]]) for i, (key, *rest) in enumerate(values))
        return held

    def _keep(self, held: dict[int, list]) -> None:
        pages = np.empty(len(held), WINDOW)
        pages["id"] = np.fromiter(held, np.int64, len(held))
        for i, field in enumerate(("start", "repeats", "conflicts", "crc")):
            pages[field] = np.fromiter((w[i] for w in held.values()), np.int64, len(held))
        pages["hash"] = np.frombuffer(b"".join(w[4] for w in held.values()), "V32")
        page = pages["id"] % PAGES
        for i in range(PAGES):
            if (page == i).any():
                self.windows.updateValue((i,), (pages[page == i].tobytes(),))
            elif self.windows.containsKey((i,)):
                self.windows.removeKey((i,))

    def _arm(self, deadlines: list[int]) -> None:
        """The bucket's one timer stands at the least of ``deadlines``."""
        want, there = [(min(deadlines) + self.shift) * HOUR_MS] if deadlines else [], list(self.handle.listTimers())
        for other in set(there) - set(want):
            self.handle.deleteTimer(other)
        for new in set(want) - set(there):
            self.handle.registerTimer(new)

    def _closed(self, windows: list[tuple], batch: int) -> Iterator[Row]:
        for at in range(0, len(windows), CLOSED_ROWS):
            ids, starts, repeats, conflicts, crcs, hashes = map(list, zip(*windows[at : at + CLOSED_ROWS], strict=True))
            yield Row(click_id=ids, start_hour=starts, closed_batch=batch, n_repeats=repeats, n_conflicts=conflicts, conflict_crc=crcs, hash=[h.hex() for h in hashes])

    def _drain(self, held: dict[int, list], boundary: int) -> tuple[Iterator[Row], list[int]]:
        """Take windows that are due out of ``held`` and their slots off the wheel; rows for them, and the deadlines that are left."""
        closed, later = [], []
        for (deadline,), (ids,) in list(self.wheel.iterator()):
            if deadline >= boundary:
                later.append(deadline)
                continue
            for click in np.frombuffer(bytes(ids), "<i8").tolist():
                window = held.get(click)
                if window and window[0] + SPAN == deadline:
                    closed.append((click, *held.pop(click)))
            self.wheel.removeKey((deadline,))
        past_all = boundary > self.cut.last + SPAN  # after the last batch; else it was the one before that closed them
        return self._closed(closed, self.batch if past_all else self.batch - 1), later

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        copies = np.concatenate([np.frombuffer(bytes(r.packed), COPY) for r in rows])
        held, slots = self._open(), []
        if self.batch:
            boundary = self._boundary(timerValues)
            due, slots = self._drain(held, boundary)
            yield from due
            copies = copies[copies["hour"] >= boundary]
        h = np.frombuffer(copies["hash"].tobytes(), ">u8").reshape(-1, 4).astype(np.uint64)
        copies = copies[np.lexsort((h[:, 3], h[:, 2], h[:, 1], h[:, 0], copies["hour"], copies["id"]))]
        hashes = copies["hash"].tobytes()
        closed, opened = [], defaultdict(list)
        for i, (click, hour, n, crc) in enumerate(zip(*(copies[k].tolist() for k in ("id", "hour", "n", "crc")), strict=True)):
            own, window = hashes[32 * i : 32 * i + 32], held.get(click)
            if window is None or hour > window[0] + SPAN:
                if window:
                    closed.append((click, *window))
                held[click] = [hour, n - 1, 0, 0, own]
                opened[hour + SPAN].append(click)
            else:
                window[1] += n
                if own != window[4]:
                    window[2] += n
                    window[3] += crc
        self._keep(held)
        for deadline, clicks in opened.items():
            before = bytes(self.wheel.getValue((deadline,))[0]) if deadline in slots else b""
            self.wheel.updateValue((deadline,), (before + np.array(clicks, "<i8").tobytes(),))
        self._arm([*slots, *opened])
        yield from self._closed(closed, self.batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._open()
        due, later = self._drain(held, self._boundary(timerValues))
        self._keep(held)
        self._arm(later)
        yield from due


def windows_of(stream: DataFrame, batch: int, cut: Cut, buckets: int) -> DataFrame:
    """Windows that close, from a stream of copies (``SOURCE``), in the start number ``batch`` or just before it."""
    dealt = stream.withWatermark("at", f"{LATENESS} hours 1 millisecond").withColumn("bucket", F.pmod(F.xxhash64("click_id"), F.lit(buckets)).cast("int"))
    packed = dealt.drop("at").mapInArrow(_packer(buckets), "bucket int, packed binary")
    closed = packed.groupBy("bucket").transformWithState(ClickWindows(batch, cut), PACKED, "append", "eventTime")
    columns = ["click_id", "start_hour", "n_repeats", "n_conflicts", "conflict_crc", "hash"]
    each = closed.select("closed_batch", F.inline(F.arrays_zip(*columns)))
    return each.select([c.split()[0] for c in RESULT.split(", ")])


def _store(spark: SparkSession, folder: str):
    """The file system that holds ``folder``, and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Hand a batch over; one without copies has no folder."""
    store, path = _store(spark, source)
    if store.exists(path):
        store.rename(path, _store(spark, target)[1])


def deduplicate_clicks(clicks: DataFrame, batches: int = BATCHES, heavy: int = HEAVY) -> DataFrame:
    """(``RESULT``): one row for each window of copies of a click.

    The cut table, the checkpoint and the sink lie in a new folder of the shared directory; all but the sink go when the last
    batch has been followed.
    """
    spark = clicks.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/casewise/click-windows-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        cut = cut_batches(clicks, f"{home}/cut", batches, heavy)
        if cut is None:
            return spark.createDataFrame([], RESULT)
        buckets = max(LEAST_BUCKETS, -(-cut.copies // (batches * BUCKET_COPIES)))
        parts = "spark.sql.shuffle.partitions"
        before[parts] = spark.conf.get(parts)
        spark.conf.set(parts, str(min(int(before[parts]), max(4, cut.copies // (batches * PARTITION_COPIES)))))
        store, feed = _store(spark, f"{home}/feed")
        store.mkdirs(feed)
        for batch in range(batches):
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(batch == batches - 1).lower())
            if batch % SHRINK_STARTS == 0:
                shrink_heaps(spark)
            _move(spark, f"{home}/cut/batch={batch}", f"{home}/feed/{batch:03d}")
            arrived = spark.readStream.schema(SOURCE).option("recursiveFileLookup", "true").parquet(f"{home}/feed")
            sink = windows_of(arrived, batch, cut, buckets).writeStream.format("parquet").option("path", f"{home}/windows")
            sink.option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for part in ("cut", "feed", "checkpoint"):
        store, path = _store(spark, f"{home}/{part}")
        store.delete(path, True)
    return spark.read.schema(RESULT).parquet(f"{home}/windows")


def op11_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_clicks(table(spark, sf_dir, "clicks"))
