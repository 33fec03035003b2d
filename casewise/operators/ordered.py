"""Order statistics and running sums without a task that holds all rows.

Ordered values are dealt to at most ``BUCKETS`` ranges; running sums go on inside a range, and each
range starts from the sums of those before it, which are one row of ``BUCKETS`` numbers. Ranges come
from a quantile sketch: a bad sketch makes them uneven, never wrong. Quantiles are read off the running
counts of distinct values, so no buffer holds the values; ranks and samples use the leading bits of a
hash, which are even by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
#: Rows that one task may order, about; a sample's cut is refined until no more are undecided.
FEW = 20_000


def _edges(rows: DataFrame, key: str) -> DataFrame:
    """One row: bounds that part the values of ``key`` into ranges of about equal size."""
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    return rows.agg(F.percentile_approx(key, shares, F.lit(8 * BUCKETS)).alias("__edges"))


def _range_of(value: Column, edges: Column) -> Column:
    """How many of the ascending ``edges`` are less than ``value``, by bisection."""
    steps = F.array(*[F.lit(BUCKETS >> i) for i in range(1, BUCKETS.bit_length())])

    def step(at: Column, by: Column) -> Column:
        inside = at + by <= F.size(edges)
        return F.when(inside & (F.get(edges, F.when(inside, at + by - 1).otherwise(0)) < value), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def prefix_sums(rows: DataFrame, key: str, values: list[str], descending: bool = False) -> DataFrame:
    """``rows`` (one a key) with ``before_<value>``: the sum of each value over all keys that come earlier; nulls of the key last."""
    placed = rows.crossJoin(F.broadcast(_edges(rows, key))).withColumn("__range", F.when(F.col(key).isNull(), -1 if descending else BUCKETS).otherwise(_range_of(F.col(key), F.col("__edges")))).drop("__edges")
    sums = placed.groupBy("__range").agg(*[F.sum(v).alias(v) for v in values])
    parts = sums.agg(F.collect_list(F.struct("__range", *values)).alias("__parts"))  # one row of at most BUCKETS + 1 parts

    def started(value: str) -> Column:
        """By range, from -1 on: the sum over the ranges before it."""
        kind = rows.schema[value].dataType
        zero = F.lit(0).cast("double" if kind.typeName() in ("double", "float") else "long")
        earlier = (lambda p, at: p["__range"] > at) if descending else (lambda p, at: p["__range"] < at)
        return F.transform(F.sequence(F.lit(-1), F.lit(BUCKETS)), lambda at: F.aggregate(F.filter("__parts", lambda p: earlier(p, at)), zero, lambda a, p: a + p[value]))

    starts = parts.select(*[started(v).alias(f"__start_{i}") for i, v in enumerate(values)])
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    own = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = placed.select("*", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"__own_{i}") for i, v in enumerate(values)])
    summed = running.crossJoin(F.broadcast(starts))  # with one row
    return summed.select(*rows.columns, *[(F.get(f"__start_{i}", F.col("__range") + 1) + F.col(f"__own_{i}")).alias(f"before_{v}") for i, v in enumerate(values)])


def exact_quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with ``quantiles``: the exact quantiles of a number, interpolated between neighbours, nulls left out; null without values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("__value")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__all"))
    placed = prefix_sums(counts, "__value", ["__n"]).crossJoin(F.broadcast(total))  # with one row

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("before___n") <= place) & (place < F.col("before___n") + F.col("__n")), F.col("__value")))

    parts = []
    for i, share in enumerate(shares):
        rank = F.lit(float(share)) * (F.col("__all") - 1)
        parts += [value_at(F.floor(rank)).alias(f"low_{i}"), value_at(F.ceil(rank)).alias(f"high_{i}"), F.max(rank - F.floor(rank)).alias(f"part_{i}")]
    one = placed.agg(*parts)
    mixed = [F.col(f"low_{i}") * (1 - F.col(f"part_{i}")) + F.col(f"high_{i}") * F.col(f"part_{i}") for i in range(len(shares))]
    return one.select(F.when(F.col("low_0").isNotNull(), F.array(*mixed)).alias("quantiles"))


def hash_ranks(rows: DataFrame, group: str, key: str, seed: int, name: str) -> DataFrame:
    """``rows`` with ``name``: the place, from 0, of each row in its group by a hash of ``key``, then ``key``."""
    hashed = rows.withColumn("__hash", F.xxhash64(key, F.lit(seed))).withColumn("__range", F.shiftright("__hash", 56).cast("int"))
    sums = hashed.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over at most 256 ranges
    starts = sums.select(F.col(group).alias("__group"), F.col("__range").alias("__part"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    own = Window.partitionBy(group, "__range").orderBy("__hash", key)
    placed = hashed.withColumn("__own", F.row_number().over(own))
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__part")))
    return joined.select(*rows.columns, (F.col("__start") + F.col("__own") - 1).alias(name))


def least_by_hash(rows: DataFrame, n: int, key: str, seed: int, few: int = FEW) -> DataFrame:
    """The ``n`` rows that come first by a hash of ``key``, then ``key``; all rows if there are no more.

    The cut is found from counts by leading bits of the hash, twelve more at a time inside the range that holds it, until few
    rows are undecided; only those are ordered. Counts, at most 4,096 a step, reach the driver.
    """
    hashed = rows.withColumn("__hash", F.xxhash64(key, F.lit(seed)))
    undecided, taken, below = hashed, 0, None
    for bits in range(12, 61, 12):
        leading = F.shiftright("__hash", 64 - bits)
        counts = sorted((r.at, r.n) for r in undecided.groupBy(leading.alias("at")).agg(F.count("*").alias("n")).collect())
        cut = None
        for at, count in counts:
            if taken + count > n:
                cut = at
                break
            taken += count
        if cut is None:
            return rows if bits == 12 else hashed.where(F.col("__hash") < F.lit(below)).drop("__hash")
        below = cut << (64 - bits)
        undecided = undecided.where(leading == cut)
        if count <= few:
            break
    rest = undecided.orderBy("__hash", key).limit(n - taken)
    return hashed.where(F.col("__hash") < F.lit(below)).unionByName(rest).drop("__hash")
