"""Near-duplicate vectors through iterative quantisation and multi-index Hamming tables (operator 12).

Equal vectors are one class. From a bounded sample of classes, iterative quantisation learns the
rotation of the principal axes that makes signs of the rotated coordinates the best binary code:
centred, so bits are balanced. A table takes some bits of the code as key; two classes meet in it if
those bits agree. How wide keys are follows from the number of classes, how many tables are needed from
the sample: vectors at exactly the threshold from sampled ones must meet in one of them, and lie within
the radius, in ``recall`` of all cases.

Codes alone are compared first: a left semi join keeps a class in a table only if its bucket holds
another code within the Hamming radius, one row however many there are. Only these fetch their vectors
and are ranked exactly, in double precision, bucket by bucket. A pair that meets in several tables
counts in the first. A bucket with more than ``block_rows`` classes is cut into blocks, compared two by
two. A bucket never lists pairs: it sends each class's sum of links, and one tie to the least class of
the group that it found connected.

Defined results: a vector that is null, zero, or holds a null or non-finite component links with
nothing, nor does a row without an id (its component is null, and it is kept); vectors of different
length are not linked; every row counts as a vector of its own, also one that repeats an id; an empty
table gives an empty result; other columns are ignored. A class is known by its least id and a 64-bit
hash of its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, table
from .components import connected_components
from .inner_product import usable


@dataclass(frozen=True)
class Near:
    threshold: float = 0.95
    recall: float = 0.985  # of pairs at the threshold, by the sample
    sample: int = 20_000  # classes for training, at most
    bits: int = 64
    rounds: int = 50
    rows_per_key: int = 4  # classes that share a key by chance, about
    most_tables: int = 64
    radius_share: float = 0.995  # of pairs at the threshold within the radius
    block_rows: int = 2_048


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Rotation:
    """Iterative quantisation of unit vectors of one length; ``mean`` and ``axes`` map a vector to signed coordinates."""

    def __init__(self, x: np.ndarray, p: Near, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean = x.mean(0)
        centred = x - self.mean
        values, vectors = np.linalg.eigh(centred.T @ centred)
        principal = vectors[:, np.argsort(values)[::-1][: p.bits]]
        turned = centred @ principal
        rotation = np.linalg.qr(rng.standard_normal((turned.shape[1],) * 2))[0]
        for _ in range(p.rounds):
            left, _, right = np.linalg.svd(np.where(turned @ rotation >= 0, 1.0, -1.0).T @ turned)
            rotation = (left @ right).T
        self.axes = principal @ rotation

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Signs of the rotated coordinates, as bits of an unsigned number."""
        bits = (x - self.mean) @ self.axes >= 0
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Tables:
    """Keys (bits of the code, as masks) and the Hamming radius for one length of vectors."""

    def __init__(self, x: np.ndarray, classes: int, p: Near, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.rotation = Rotation(x, p)
        bits = self.rotation.axes.shape[1]
        width = int(np.clip(np.ceil(np.log2(max(2, classes / p.rows_per_key))), 1, max(1, bits // 2)))
        probe = x[rng.permutation(len(x))[:4_000]]
        aside = rng.standard_normal(probe.shape)
        aside -= (aside * probe).sum(1, keepdims=True) * probe
        if x.shape[1] > 1:
            aside = unit(aside)
        near = p.threshold * probe + np.sqrt(max(0.0, 1 - p.threshold**2)) * aside
        differ = self.rotation.codes(probe) ^ self.rotation.codes(near)
        self.radius = int(np.quantile(ones(differ), p.radius_share, method="higher"))
        self.masks: list[int] = []
        met = np.zeros(len(differ), bool)
        while len(self.masks) < p.most_tables and (met & (ones(differ) <= self.radius)).mean() < p.recall:
            order = rng.permutation(bits)
            for at in range(0, bits - width + 1, width):
                mask = np.bitwise_or.reduce(np.uint64(1) << order[at : at + width].astype(np.uint64))
                met |= (differ & mask) == 0
                self.masks.append(int(mask))
        self.seen = float((met & (ones(differ) <= self.radius)).mean())  # recall at the threshold that the sample promises


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _encoder(models: dict[int, Tables]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["size"].to_numpy(zero_copy_only=False)
            code = np.zeros(batch.num_rows, np.uint64)
            for length in set(lengths.tolist()) & set(models):
                at = np.flatnonzero(lengths == length)
                x = batch["v"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), length)
                code[at] = models[length].rotation.codes(unit(x))
            yield batch.append_column("code", pa.array(code.view(np.int64)))

    return encode


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows that agree in ``by``, from batches in that order; only the last group of a batch waits for the next one."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        keys = np.stack([now[c].to_numpy() for c in by])
        ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for a, b in zip(np.r_[0, ends[:-1]], ends) if len(ends) else ():
            yield now.slice(a, b - a)
        rest = now.slice(ends[-1] if len(ends) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _linker(models: dict[int, Tables], p: Near):
    """Buckets to (vec_id, h, links, tied_id, tied_h): each class's links that no earlier table has, and whom it is tied to."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group in _groups(batches, ["size", "place", "key", "low", "high"]):
            if group.num_rows > 1:
                out.append(of_bucket(group.combine_chunks()))
            if sum(x.num_rows for x in out) >= 4_096:
                yield from out
                out = []
        yield from out

    def of_bucket(group: pa.Table) -> pa.RecordBatch:
        length, place, low, high = (group[c][0].as_py() for c in ("size", "place", "low", "high"))
        ids, h, n, block = (group[c].to_numpy() for c in ("vec_id", "h", "n", "block"))
        code = group["code"].to_numpy().view(np.uint64)
        x = unit(group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        near = x[left] @ x[right].T >= p.threshold
        if low == high:
            np.fill_diagonal(near, False)
        a, b = np.nonzero(near)
        differ = code[left[a]] ^ code[right[b]]
        fine = np.ones(len(a), bool)
        if length in models:
            fine = ones(differ) <= models[length].radius
            for mask in models[length].masks[:place]:
                fine &= (differ & np.uint64(mask)) != 0
        a, b = left[a[fine]], right[b[fine]]
        links = np.bincount(a, n[b], len(ids)).astype(np.int64)
        if low != high:
            links += np.bincount(b, n[a], len(ids)).astype(np.int64)
        root = np.arange(len(ids))
        while True:  # least row that links reach, by halving chains
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[at], h[at], links[at], ids[root[at]], h[root[at]])], ["vec_id", "h", "links", "tied_id", "tied_h"])

    return linked


def _in_blocks(met: DataFrame, p: Near) -> DataFrame:
    """Rows of tables with the two blocks (low, high) in which each takes part; small buckets are one block."""
    by = ["size", "place", "key"]
    large = materialize(met.groupBy(*by).count().where(F.col("count") > p.block_rows), "near-large")
    if large.isEmpty():
        return met.selectExpr("*", "0 as block", "0 as low", "0 as high")
    blocks = F.coalesce(F.ceil(F.col("count") / p.block_rows), F.lit(1)).cast("int")
    dealt = met.join(large, by, "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("vec_id", "h", F.lit(5)), "blocks").cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.selectExpr(*met.columns, "block", "least(block, other) as low", "greatest(block, other) as high")


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", p: Near = Near()) -> DataFrame:
    """(vec_id, n_links, component_id, kept): every row with its links and component."""
    spark = vectors.sparkSession
    v = F.transform(column, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    same = usable(rows, "vec_id", "v").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = materialize(same.select("vec_id", F.xxhash64("v").alias("h"), F.size("v").alias("size"), "n", "v"), "near-classes")
    sizes = {r["size"]: r["count"] for r in classes.groupBy("size").count().orderBy(F.desc("count")).limit(1_000).collect()}
    sample: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("vec_id", "h"), "vec_id").limit(p.sample).select("size", "v").toPandas().itertuples():
        sample.setdefault(r.size, []).append(r.v)
    models = {size: Tables(unit(np.array(v, float)), sizes[size], p) for size, v in sample.items() if size in sizes and len(v) >= 8}
    with bounded_batches(spark):
        coded = materialize(classes.mapInArrow(_encoder(models), "vec_id long, h long, size int, n long, v array<double>, code long"), "near-codes")
        discard(classes)
        found = _links(coded, models, p)
    node = lambda a, b: F.struct(F.col(a).alias("vec_id"), F.col(b).alias("h"))
    own = connected_components(found.select(node("vec_id", "h").alias("a"), node("tied_id", "tied_h").alias("b")), "near-components")
    own = own.select("node.*", F.col("component.vec_id").alias("component"))  # the least class of a component has its least id
    links = found.groupBy("vec_id", "h").agg(F.sum("links").alias("links"))
    several = coded.select("vec_id", "h", "n", "v").join(links, ["vec_id", "h"], "left").where("n > 1 or links is not null").join(own, ["vec_id", "h"], "left")
    several = several.select(F.col("h").alias("class_h"), F.col("v").alias("class_v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    several = materialize(several, "near-found")
    out = rows.withColumn("h", F.when(F.col("vec_id").isNotNull(), F.xxhash64("v")))
    out = out.join(several, (F.col("h") == F.col("class_h")) & (F.col("v") == F.col("class_v")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(coded: DataFrame, models: dict[int, Tables], p: Near) -> DataFrame:
    """(vec_id, h, links, tied_id, tied_h) of classes that link with another."""
    masks = F.lit(None).cast("array<struct<place:int,key:long>>")
    radius = F.lit(p.bits)
    for size, model in models.items():
        keys = F.array(*[F.struct(F.lit(i).alias("place"), F.col("code").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(model.masks)])
        masks, radius = F.when(F.col("size") == size, keys).otherwise(masks), F.when(F.col("a.size") == size, F.lit(model.radius)).otherwise(radius)
    whole = F.array(F.struct(F.lit(0).alias("place"), F.lit(0).cast("long").alias("key")))  # lengths without a model: all in one bucket
    tables = coded.select("vec_id", "h", "size", "code", F.inline(F.coalesce(masks, whole)))
    by = ["size", "place", "key"]
    a, b = tables.alias("a"), tables.alias("b")  # one exchange serves both
    within = (F.col("a.h") != F.col("b.h")) | (F.col("a.vec_id") != F.col("b.vec_id"))
    within &= F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code"))) <= radius
    for c in by:
        within &= F.col(f"a.{c}") == F.col(f"b.{c}")
    met = materialize(a.join(b, within, "left_semi").select("vec_id", "h", *by), "near-met")  # a semi join: one row a class and table
    rows = _in_blocks(met, p).join(coded.select("vec_id", "h", "n", "code", "v"), ["vec_id", "h"])
    group = [*by, "low", "high"]
    dealt = rows.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group)
    found = materialize(dealt.mapInArrow(_linker(models, p), "vec_id long, h long, links long, tied_id long, tied_h long"), "near-links")
    discard(met)
    return found


def op12_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
