"""Product codes of vectors by Lloyd rounds over partition-local heaps (operator 13).

Vectors become integers and are cut into equal parts; each part position has a codebook of its own.
The first assignment compares every part with every entry and keeps the distance to the nearest entry
(an upper bound) and to the next one (a lower bound). A block of vectors keeps, for each position and
entry, a heap of its parts keyed by lower minus upper bound. When entries move, an entry's threshold
grows by its own drift and the largest drift among the others; only parts whose key the threshold has
passed can have changed their entry. They are popped and compared with every entry again; all others
keep theirs unread. A heap is a run sorted by key, so its pops are a prefix found by bisection, and a
block's heaps are rows of a table in the shared folder between rounds.

Sums are exact: a round sends, for each entry that gained or lost parts, the change of its count and of
its component sums, as 30-bit limbs that add up without overflow. At most positions times entries such
rows reach the driver. Distances are exact too: in double precision while all sums of squares stay
below 2^53, in whole numbers of any size beyond.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those
of another length than the one with the least id; a length that the positions do not divide is filled
up with zeros. Seeds are the least ids (ties by vector), a row without an id is coded but seeds nothing;
without seeds the result is empty. Repeated rows are coded alike. Codebooks start with fewer entries if
there are fewer rows. An error, or a sum of errors, that no long can hold is null. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, in_parts, materialize, table

LIMB = 30
MOVED = pa.list_(pa.struct([("slot", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
BLOCK = "vec_id array<long>, label array<string>, v array<double>, code binary, heap_key array<double>, heap_row array<int>, heap_at array<int>, moved array<struct<slot:int,n:long,sums:array<long>>>"


@dataclass(frozen=True)
class Coding:
    positions: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    block_rows: int = 2_048


@dataclass
class Books:
    """Codebooks by (position, entry, component) as whole numbers, with the thresholds of the heaps."""

    entries: np.ndarray
    largest: int  # no component of a vector is larger in absolute value
    passed: np.ndarray  # by (position, entry)

    def __post_init__(self):
        width = self.entries.shape[2]
        self.plain = 4 * width * (self.largest + 1) ** 2 < 1 << 53
        self.slack = 1e-6 + 1e-9 * float(self.largest)

    def distances(self, x: np.ndarray, position: int) -> np.ndarray:
        """Squared distances of parts (rows of whole numbers in double precision) to all entries, exact."""
        if self.plain:
            c = self.entries[position].astype(float)
            return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        return ((whole(x)[:, None, :] - self.entries[position][None]) ** 2).sum(2)

    def own(self, x: np.ndarray, code: np.ndarray, position: int) -> np.ndarray:
        """Squared distances to the entries named by ``code``."""
        if self.plain:
            return ((x - self.entries[position].astype(float)[code]) ** 2).sum(1)
        return ((whole(x) - self.entries[position][code]) ** 2).sum(1)

    def assigned(self, x: np.ndarray, position: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part, and by how much the next one is farther."""
        d = self.distances(x, position)
        near = np.argmin(d, axis=1)
        best = d[np.arange(len(d)), near].astype(float)
        if d.shape[1] == 1:
            return near, np.full(len(d), np.inf)
        rest = d.astype(float)
        rest[np.arange(len(d)), near] = np.inf
        return near, np.sqrt(rest.min(1)) - np.sqrt(best)

    def moved_to(self, entries: np.ndarray) -> Books:
        """After the entries have moved: each threshold grows by its entry's drift and the largest among the others."""
        drift = np.sqrt(((entries - self.entries) ** 2).sum(2).astype(float))
        if drift.shape[1] == 1:
            others = np.zeros_like(drift)
        else:
            most = np.sort(drift, axis=1)[:, -2:]
            others = np.where(drift == most[:, 1:], most[:, :1], most[:, 1:])
            others = np.where((drift == most[:, 1:]).sum(1, keepdims=True) > 1, most[:, 1:], others)
        return Books(entries, self.largest, self.passed + drift + others)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole(x: np.ndarray) -> np.ndarray:
    """Python's integers, of any size, from whole numbers in double precision."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def limbs(value: int, n: int) -> list[int]:
    return [value >> LIMB * i & (1 << LIMB) - 1 for i in range(n - 1)] + [value >> LIMB * (n - 1)]


class Block:
    """Vectors of one block with their codes and heaps."""

    def __init__(self, ids: pa.Array, labels: pa.Array, x: np.ndarray, p: Coding):
        self.ids, self.labels, self.x, self.p = ids, labels, x.reshape(len(ids), p.positions, -1), p

    @classmethod
    def of(cls, batch: pa.RecordBatch, at: int, p: Coding) -> Block:
        """From row ``at`` of a batch of ``BLOCK`` rows."""
        numbers = lambda name: batch[name][at].values.to_numpy(zero_copy_only=False)
        own = cls(batch["vec_id"][at].values, batch["label"][at].values, numbers("v"), p)
        own.code = np.frombuffer(batch["code"][at].as_py(), np.uint8).reshape(-1, p.positions).copy()
        key, rows, ends = numbers("heap_key"), numbers("heap_row"), numbers("heap_at")
        own.heaps = [(key[a:b], rows[a:b]) for a, b in zip(ends, ends[1:])]
        return own

    def row(self, moved: list[dict]) -> pa.RecordBatch:
        keys, rows = (np.concatenate(x) for x in zip(*self.heaps, strict=True))
        ends = np.r_[0, np.cumsum([len(k) for k, _ in self.heaps])].astype(np.int32)
        listed = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [listed(self.ids, pa.int64()), listed(self.labels, pa.string()), listed(self.x.ravel(), pa.float64()), pa.array([self.code.tobytes()], pa.binary()),
             listed(keys, pa.float64()), listed(rows, pa.int32()), listed(ends, pa.int32()), pa.array([moved], MOVED)],
            names=["vec_id", "label", "v", "code", "heap_key", "heap_row", "heap_at", "moved"])

    def start(self, books: Books) -> list[dict]:
        """Assign every part and fill the heaps; what each entry gained."""
        n, k, moved = len(self.ids), self.p.entries, []
        self.code, self.heaps = np.empty((n, self.p.positions), np.uint8), []
        for position in range(self.p.positions):
            near, slack = books.assigned(self.x[:, position], position)
            self.code[:, position] = near
            order = np.lexsort((slack, near))
            ends = np.searchsorted(near[order], np.arange(k + 1))
            self.heaps += [(slack[order[a:b]], order[a:b].astype(np.int32)) for a, b in zip(ends, ends[1:])]
            moved += self._changes(books, position, np.arange(n), None, near)
        return moved

    def follow(self, books: Books) -> list[dict]:
        """Pop and assign the parts whose bounds the entries' drift has passed; what each entry gained or lost."""
        k, moved = self.p.entries, []
        for position in range(self.p.positions):
            heaps = self.heaps[position * k : (position + 1) * k]
            limits = np.zeros(k)
            limits[: books.passed.shape[1]] = books.passed[position] + books.slack
            ends = np.array([np.searchsorted(key, limits[e], "right") for e, (key, _) in enumerate(heaps)])
            if not ends.any():
                continue
            rows = np.concatenate([r[:end] for (_, r), end in zip(heaps, ends, strict=True)])
            before = self.code[rows, position].astype(int)
            near, slack = books.assigned(self.x[rows, position], position)
            self.code[rows, position] = near
            key = slack + books.passed[position][near]
            for e in np.union1d(np.flatnonzero(ends), near):
                keys, own = (np.r_[a[ends[e] :], b[near == e]] for a, b in zip(heaps[e], (key, rows), strict=True))
                order = np.argsort(keys, kind="stable")
                self.heaps[position * k + e] = keys[order], own[order].astype(np.int32)
            other = near != before
            moved += self._changes(books, position, rows[other], before[other], near[other])
        return moved

    def _changes(self, books: Books, position: int, rows: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
        k, n_limbs = self.p.entries, limb_count(books.largest)
        x = self.x[rows, position]
        x = x.astype(np.int64) if books.largest * max(len(x), 1) < 1 << 62 else whole(x)
        count, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), x.dtype)
        np.add.at(count, after, 1)
        np.add.at(sums, after, x)
        touched = after
        if before is not None:
            np.subtract.at(count, before, 1)
            np.subtract.at(sums, before, x)
            touched = np.r_[before, after]
        return [{"slot": int(position * k + e), "n": int(count[e]), "sums": [limb for s in sums[e].tolist() for limb in limbs(s, n_limbs)]} for e in np.unique(touched)]

    def results(self, books: Books) -> tuple[list[str], list]:
        """Hexadecimal codes and errors."""
        error = sum(books.own(self.x[:, i], self.code[:, i], i) for i in range(self.p.positions))
        error = [e if e < 1 << 63 else None for e in map(int, error.tolist())]
        return [row.tobytes().hex() for row in self.code], error


def limb_count(largest: int) -> int:
    """Limbs for a sum of up to 2^64 components."""
    return -(-(64 + largest.bit_length()) // LIMB) + 1


def _usable(vectors: DataFrame, key: str, column: str, label: str | None, scale: int) -> DataFrame:
    """(vec_id, label as text, v): finite vectors, each component multiplied and rounded down, in double precision."""
    v = F.transform(column, lambda x: x.cast("double") * scale)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))


def _fitted(v: np.ndarray, width: int, length: int) -> np.ndarray:
    return np.pad(np.floor(v.reshape(-1, length)), ((0, 0), (0, width - length)))


def _beginning(books: Books, p: Coding, width: int, length: int):
    """Rows (vec_id, label, v) to blocks with first codes and heaps."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        built = Block(own["vec_id"], own["label"], _fitted(own["v"].flatten().to_numpy(zero_copy_only=False), width, length), p)
        return built.row(built.start(books))

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for part in (part for batch in batches for part in in_parts(batch)):
            waiting.append(part)
            n += part.num_rows
            if n >= p.block_rows:
                yield block(waiting)
                waiting, n = [], 0
        if n:
            yield block(waiting)

    return begun


def _following(books: Books, p: Coding):
    """Blocks to blocks, after the entries have moved."""

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (Block.of(batch, at, p) for batch in batches for at in range(batch.num_rows)):
            yield own.row(own.follow(books))

    return followed


def _ending(books: Books, p: Coding):
    """Blocks to rows (vec_id, label, code, error), after the entries have moved for the last time."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (Block.of(batch, at, p) for batch in batches for at in range(batch.num_rows)):
            own.follow(books)
            codes, errors = own.results(books)
            yield pa.RecordBatch.from_arrays([own.ids, own.labels, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return ended


def code_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str | None = "label", p: Coding = Coding()) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): every usable vector's product code."""
    spark = vectors.sparkSession
    rows = _usable(vectors, key, column, label, p.scale)
    seeded = rows.where("vec_id is not null").orderBy("vec_id", "v")
    least = seeded.first()
    if least is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long, label_error long, codebooks_sha256 string")
    length = len(least.v)
    width = -(-length // p.positions) * p.positions
    rows, seeded = rows.where(F.size("v") == length), seeded.where(F.size("v") == length)
    seeds = _fitted(np.array([r.v for r in seeded.limit(p.entries).collect()], float), width, length)
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    start = whole(seeds).reshape(len(seeds), p.positions, -1).transpose(1, 0, 2)
    books = Books(start, int(largest) + 1, np.zeros(start.shape[:2]))
    count = np.zeros(start.shape[:2], object)
    total = np.zeros(start.shape, object)
    with bounded_batches(spark):
        now = materialize(rows.mapInArrow(_beginning(books, p, width, length), BLOCK), "lloyd")
        for done in range(p.rounds):
            if done:
                after = materialize(now.mapInArrow(_following(books, p), BLOCK), "lloyd")
                discard(now)
                now = after
            _add(now, count, total, p, limb_count(books.largest))
            n = count[:, :, None]
            books = books.moved_to(np.where(n > 0, total // np.maximum(n, 1), books.entries))
        coded = materialize(now.mapInArrow(_ending(books, p), "vec_id long, label string, code string, error long"), "lloyd-codes")
        discard(now)
    sums = coded.groupBy(F.col("label").alias("same")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("exact"))
    sums = sums.select("same", F.expr("try_cast(exact as long)").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("same")), "left").withColumn("codebooks_sha256", F.lit(books.digest()))
    return out.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def _add(blocks: DataFrame, count: np.ndarray, total: np.ndarray, p: Coding, n_limbs: int) -> None:
    """Add what entries gained and lost: at most one row for each position, entry and component reaches the driver."""
    moved = blocks.select(F.inline("moved"))
    for r in moved.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        count[divmod(r.slot, p.entries)] += r.n
    each = moved.select("slot", F.posexplode("sums").alias("at", "limb"))
    for r in each.groupBy("slot", "at").agg(F.sum("limb").alias("limb")).collect():
        component, place = divmod(r["at"], n_limbs)
        total[(*divmod(r.slot, p.entries), component)] += r.limb << LIMB * place


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
