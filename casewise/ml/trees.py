"""Histogram trees grown level by level in Spark: second-order boosting, and a forest of bootstrap samples.

Features are binned once: a category is one 0/1 feature a level, a number has at most ``MAX_BINS`` ranges.
A level is one job: each task walks its rows down the trees that grow, sums what a split needs by (tree,
node, feature, bin) in numpy, and Spark adds the sums of all tasks. Splits are chosen in the same plan by
running sums over bins; one row a node reaches the driver, which holds the model and nothing else.

Draws of rows are hashes of row and tree, so they depend neither on partitions nor on retries. Boosted
margins are written to the shared folder every ``KEEP_ROUNDS`` trees, so lineage stays short and a task
adds few trees to what it reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder

MAX_BINS = 256
KEEP_ROUNDS = 20
#: Trees of a forest that grow in the same jobs.
FOREST_BATCH = 10
HISTOGRAM = "tree int, node int, feature int, bin int, a double, b double, n long"
_EVEN = np.uint64(0x9E3779B97F4A7C15)  # an odd constant near 2^64 over the golden ratio


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys, different for each ``salt``."""
    x = key.astype(np.int64).view(np.uint64) + np.uint64((salt + 1) * int(_EVEN) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def poisson_draws(u: np.ndarray) -> np.ndarray:
    """How often a row is in a bootstrap sample: Poisson with mean 1, from uniform numbers."""
    weights = np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 20)])
    return np.searchsorted(np.cumsum(weights), u, "right")


def _passed(bounds, value):
    """How many bounds lie below ``value``."""
    return F.size(F.filter(bounds, lambda e: e < value))


@dataclass
class Binning:
    """Levels of categories and upper bounds of number ranges, from training rows."""

    levels: dict[str, list[str]]
    edges: dict[str, list[float]]
    flags: list[str]

    @classmethod
    def of(cls, train: DataFrame, categories, numbers, flags) -> Binning:
        shares = F.array(*[F.lit(i / MAX_BINS) for i in range(1, MAX_BINS)])
        sets = [F.sort_array(F.collect_set(c)).alias(c) for c in categories]  # a handful of levels each
        one = train.agg(*sets, *[F.percentile_approx(c, shares, F.lit(16 * MAX_BINS)).alias(c) for c in numbers], *[F.max(c).alias(f"most_{c}") for c in numbers]).first()
        edges = {c: [e for e in sorted(set(one[c] or [])) if e < one[f"most_{c}"]] for c in numbers}
        return cls({c: list(one[c]) for c in categories}, edges, list(flags))

    @property
    def widths(self) -> list[int]:
        """Bins of each feature."""
        return [2 for levels in self.levels.values() for _ in levels] + [len(e) + 1 for e in self.edges.values()] + [2 for _ in self.flags]

    @property
    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, levels in self.levels.items() for v in levels] + list(self.edges) + self.flags

    def column(self):
        """array<int>: a row's bin for each feature; an unknown level is no level."""
        hot = [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, levels in self.levels.items() for v in levels]
        places = []
        for c, edges in self.edges.items():
            bounds = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
            places.append(_passed(bounds, F.col(c)))
        return F.array(*hot, *places, *[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in self.flags])


@dataclass
class Tree:
    """Nodes as arrays; ``feature`` is -1 at leaves, rows with bin <= ``cut`` go to ``left``, others to the node after it."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, at, gain
        for name, new in (("feature", -1), ("cut", 0), ("left", -1), ("value", 0.0), ("gain", 0.0)):
            getattr(self, name).extend([new, new])
        return at, at + 1

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        node = np.zeros(len(bins), np.int64)
        moving = np.flatnonzero(feature[node] >= 0)
        while len(moving):
            at = node[moving]
            node[moving] = left[at] + (bins[moving, feature[at]] > cut[at])
            moving = moving[feature[node[moving]] >= 0]
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.walk(bins)]


@dataclass
class Growing:
    """A tree in the middle of its growth: the nodes that may still split, and the features that it may use."""

    number: int
    tree: Tree
    opened: list[int]
    features: list[int]


def _sums(frames: Iterator[pd.DataFrame], growing: list[Growing], widths: list[int], terms) -> Iterator[pd.DataFrame]:
    """Partial histograms of a task: for each growing tree, of rows in its open nodes, ``terms`` (a, b, rows in use) by feature and bin."""
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        if not len(frame):
            continue
        bins = np.stack(frame["bins"].to_numpy()).astype(np.int64)
        for g in growing:
            a, b, used = terms(frame, bins, g.number)
            starts = np.r_[0, np.cumsum([widths[f] for f in g.features])]
            place = np.full(len(g.tree.feature), -1)
            place[g.opened] = np.arange(len(g.opened))
            node = place[g.tree.walk(bins)]
            rows = np.flatnonzero(used & (node >= 0))
            own = total.setdefault(g.number, np.zeros((3, len(g.opened) * starts[-1])))
            cell = (node[rows, None] * starts[-1] + starts[:-1] + bins[rows][:, g.features]).ravel()
            for i, x in enumerate((a, b, np.ones(len(frame)))):
                own[i] += np.bincount(cell, np.repeat(x[rows], len(g.features)), own.shape[1])
    for g in growing:
        if g.number not in total:
            continue
        starts = np.r_[0, np.cumsum([widths[f] for f in g.features])]
        at = np.flatnonzero(total[g.number][2])
        node, rest = np.divmod(at, starts[-1])
        feature = np.searchsorted(starts, rest, "right") - 1
        a, b, n = total[g.number][:, at]
        yield pd.DataFrame({
            "tree": np.int32(g.number), "node": np.array(g.opened, np.int32)[node], "feature": np.array(g.features, np.int32)[feature],
            "bin": (rest - starts[feature]).astype(np.int32), "a": a, "b": b, "n": n.astype(np.int64),
        })


def best_splits(histogram: DataFrame, gain, fits, features_a_node: int | None = None, seed: int = 0) -> DataFrame:
    """One row a (tree, node): its sums and, if any split fits, the one of largest gain (ties: smaller feature, then bin).

    ``gain(la, lb, a, b)`` and ``fits(lb, ln, b, n)`` are expressions of left and whole sums. ``features_a_node`` features, drawn
    by a hash, compete in a node; if all of these are constant there, the first in that order that is not.
    """
    cells = histogram.groupBy("tree", "node", "feature", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    own = Window.partitionBy("tree", "node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(c).over(upto).alias(f"l{c}") for c in "abn"] + [F.sum(c).over(own).alias(f"t{c}") for c in "abn"]
    cuts = cells.select("tree", "node", "feature", "bin", *sums)
    value = F.round(gain(F.col("la"), F.col("lb"), F.col("ta"), F.col("tb")), 9)
    fine = (F.col("ln") < F.col("tn")) & fits(F.col("lb"), F.col("ln"), F.col("tb"), F.col("tn"))
    cut = F.struct(value.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("c"), "la", "lb", "ln")
    each = cuts.groupBy("tree", "node", "feature").agg(F.first("ta").alias("a"), F.first("tb").alias("b"), F.first("tn").alias("n"), (F.count("*") > 1).alias("varies"), F.max(F.when(fine, cut)).alias("best"))
    if features_a_node:
        order = Window.partitionBy("tree", "node").orderBy(F.xxhash64("tree", "node", "feature", F.lit(seed)))
        each = each.withColumn("place", F.row_number().over(order)).withColumn("first", F.min(F.when(F.col("varies"), F.col("place"))).over(Window.partitionBy("tree", "node")))
        each = each.withColumn("best", F.when(F.col("place") <= F.greatest(F.lit(features_a_node), F.col("first")), F.col("best")))
    found = each.groupBy("tree", "node").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("n").alias("n"), F.max("best").alias("best"))
    return found.select("tree", "node", "a", "b", "n", F.col("best.gain").alias("gain"), (-F.col("best.f")).alias("feature"), (-F.col("best.c")).alias("cut"), "best.la", "best.lb", "best.ln")


@dataclass
class TreeModel:
    """A fitted ensemble: a row's score is the logistic curve of the sum of leaves, or their mean."""

    binning: Binning
    trees: list[Tree]
    logistic: bool
    base: float = 0.0

    def scores(self, frame: DataFrame, keep: tuple[str, ...] = ("caseid", "label")) -> DataFrame:
        held = frame.sparkSession.sparkContext.broadcast((self.trees, self.logistic, self.base))
        rows = frame.select(*keep, self.binning.column().alias("bins"))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "bins")

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees, logistic, base = held.value
            for part in frames:
                bins = np.stack(part["bins"].to_numpy()).astype(np.int64) if len(part) else np.zeros((0, 1), np.int64)
                total = sum((t.predict(bins) for t in trees), np.full(len(part), base))
                value = 1 / (1 + np.exp(-total)) if logistic else total / max(len(trees), 1)
                yield part.drop(columns="bins").assign(score=value)

        return rows.mapInPandas(score, f"{kinds}, score double")

    def feature_table(self) -> list[tuple[str, float]]:
        """Importances that sum to one, largest first: mean gain of a feature's splits (boosting), or a tree's share of its total gain (forest)."""
        names = self.binning.names
        gain, count = np.zeros(len(names)), np.zeros(len(names))
        for tree in self.trees:
            own = np.zeros(len(names))
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    own[f] += g
                    count[f] += 1
            gain += own if self.logistic else own / max(own.sum(), 1e-300)
        value = gain / np.maximum(count, 1) if self.logistic else gain
        return sorted(zip(names, (value / max(value.sum(), 1e-300)).tolist(), strict=True), key=lambda t: (-t[1], t[0]))

    def save(self, spark: SparkSession, folder: str) -> None:
        """One Parquet row a tree, and one JSON row of settings."""
        nodes = [(i, t.feature, t.cut, t.left, t.value, t.gain) for i, t in enumerate(self.trees)]
        spark.createDataFrame(nodes, "tree int, feature array<int>, cut array<int>, left array<int>, value array<double>, gain array<double>").write.mode("overwrite").parquet(f"{folder}/trees")
        settings = json.dumps({"levels": self.binning.levels, "edges": self.binning.edges, "flags": self.binning.flags, "logistic": self.logistic, "base": self.base})
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TreeModel:
        s = json.loads(spark.read.text(f"{folder}/settings").first()[0])
        trees = [Tree(list(r.feature), list(r.cut), list(r.left), list(r.value), list(r.gain)) for r in spark.read.parquet(f"{folder}/trees").orderBy("tree").toLocalIterator()]
        return cls(Binning(s["levels"], s["edges"], s["flags"]), trees, s["logistic"], s["base"])


def _rows(train: DataFrame, binning: Binning, seed: int) -> DataFrame:
    return train.select(F.xxhash64("caseid", F.lit(seed)).alias("key"), F.col("label").cast("double").alias("label"), binning.column().alias("bins"))


@dataclass
class Boosted:
    """Newton boosting of the logistic loss: L2 on leaves, a floor under a child's curvature, samples of rows and features a tree."""

    rounds: int = 400
    depth: int = 5
    rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    l2: float = 1.0
    least_curvature: float = 5.0
    seed: int = 42

    def fit(self, train: DataFrame, categories, numbers, flags) -> TreeModel:
        binning = Binning.of(train, categories, numbers, flags)
        count = train.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
        positives = int(count.p or 0)
        weight = max(1.0, (count.n - positives) / positives) if positives else 1.0  # of a positive row
        folder = f"{shared_folder(train.sparkSession)}/casewise/boosting-{uuid.uuid4().hex}"
        model, kept = TreeModel(binning, [], True), _kept(_rows(train, binning, self.seed).withColumn("margin", F.lit(0.0)), f"{folder}/0")
        recent: list[Tree] = []
        for number in range(self.rounds):
            tree = self._grow(kept, number, recent, weight, binning.widths)
            model.trees.append(tree)
            recent = [*recent, tree]
            if len(recent) == KEEP_ROUNDS:
                kept, recent = _kept(_with_margin(kept, recent), f"{folder}/{number + 1}"), []
        _remove(train.sparkSession, folder)
        return model

    def _grow(self, rows: DataFrame, number: int, recent: list[Tree], weight: float, widths: list[int]) -> Tree:
        tree, opened, l2 = Tree(), [0], self.l2
        drawn = np.random.default_rng([self.seed, number]).permutation(len(widths))[: max(1, int(self.feature_share * len(widths)))]
        features, share, floor = sorted(drawn.tolist()), self.row_share, self.least_curvature

        def terms(frame: pd.DataFrame, bins: np.ndarray, tree_number: int):
            margin = sum((t.predict(bins) for t in recent), frame["margin"].to_numpy(float))
            p, y = 1 / (1 + np.exp(-margin)), frame["label"].to_numpy(float)
            w = np.where(y == 1, weight, 1.0)
            return w * (p - y), w * p * (1 - p), uniform(frame["key"].to_numpy(), tree_number) < share

        def gain(la, lb, a, b):
            return (la * la / (lb + l2) + (a - la) * (a - la) / (b - lb + l2) - a * a / (b + l2)) / 2

        for _ in range(self.depth):
            found = _level(rows, [Growing(number, tree, opened, features)], widths, terms, gain, lambda lb, ln, b, n: (lb >= floor) & (b - lb >= floor))
            opened = []
            for r in found:
                tree.value[r.node] = -self.rate * r.a / (r.b + l2)
                if r.gain is not None and r.gain > 0:
                    left, right = tree.split(r.node, r.feature, r.cut, r.gain)
                    tree.value[left], tree.value[right] = -self.rate * r.la / (r.lb + l2), -self.rate * (r.a - r.la) / (r.b - r.lb + l2)
                    opened += [left, right]
            if not opened:
                break
        return tree


@dataclass
class Forest:
    """Gini trees of bootstrap samples without a limit of depth; classes weigh the same within each tree's own sample."""

    trees: int = 300
    depth: int | None = None
    least_rows: int = 10
    seed: int = 42

    def fit(self, train: DataFrame, categories, numbers, flags) -> TreeModel:
        binning = Binning.of(train, categories, numbers, flags)
        folder = f"{shared_folder(train.sparkSession)}/casewise/forest-{uuid.uuid4().hex}"
        rows = _kept(_rows(train, binning, self.seed), f"{folder}/0")
        model = TreeModel(binning, [], False)
        for first in range(0, self.trees, FOREST_BATCH):
            model.trees += self._grow(rows, range(first, min(first + FOREST_BATCH, self.trees)), binning.widths)
        _remove(train.sparkSession, folder)
        return model

    def _grow(self, rows: DataFrame, numbers: range, widths: list[int]) -> list[Tree]:
        seed, few = self.seed, self.least_rows
        trees = {i: Tree() for i in numbers}
        opened = {i: [0] for i in numbers}

        def drawn(frame: pd.DataFrame, number: int) -> np.ndarray:
            return poisson_draws(uniform(frame["key"].to_numpy(), number + seed))

        def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                y = frame["label"].to_numpy(float)
                for i in numbers:
                    times = drawn(frame, i)
                    yield pd.DataFrame({"tree": [i], "p": [float(times[y == 1].sum())], "n": [float(times.sum())]})

        sizes = {r.tree: (r.p, r.n) for r in rows.mapInPandas(counted, "tree int, p double, n double").groupBy("tree").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}
        weights = {i: (n / (2 * p) if p else 0.0, n / (2 * (n - p)) if n > p else 0.0) for i, (p, n) in sizes.items()}

        def terms(frame: pd.DataFrame, bins: np.ndarray, number: int):
            times, y = drawn(frame, number), frame["label"].to_numpy(float)
            w = times * np.where(y == 1, *weights[number])
            return w * y, w, times > 0

        def impurity(a, b):
            return F.when(b > 0, 2 * a * (b - a) / b).otherwise(0.0)  # gini times weight

        def gain(la, lb, a, b):
            return impurity(a, b) - impurity(la, lb) - impurity(a - la, b - lb)

        def leaf(tree: Tree, node: int, a: float, b: float, n: int) -> bool:
            """Give a node its share of positives; whether it may still split."""
            tree.value[node] = min(max(a / b, 0.0), 1.0) if b > 0 else 0.0
            return n >= 2 * few and 1e-9 * b < a < (1 - 1e-9) * b

        level, features = 0, list(range(len(widths)))
        while (self.depth is None or level < self.depth) and any(opened.values()):
            growing = [Growing(i, trees[i], nodes, features) for i, nodes in opened.items() if nodes]
            found = _level(rows, growing, widths, terms, gain, lambda lb, ln, b, n: (ln >= few) & (n - ln >= few), max(1, int(len(widths) ** 0.5)), seed)
            opened = {i: [] for i in numbers}
            for r in found:
                tree = trees[r.tree]
                if leaf(tree, r.node, r.a, r.b, r.n) and r.gain is not None:
                    left, right = tree.split(r.node, r.feature, r.cut, max(r.gain, 0.0))
                    opened[r.tree] += [x for x, own in ((left, (r.la, r.lb, r.ln)), (right, (r.a - r.la, r.b - r.lb, r.n - r.ln))) if leaf(tree, x, *own)]
            level += 1
        return [trees[i] for i in numbers]


def _level(rows: DataFrame, growing: list[Growing], widths: list[int], terms, gain, fits, features_a_node: int | None = None, seed: int = 0) -> list:
    """Sums and best splits of all open nodes: one job, one row a node to the driver."""
    held = rows.sparkSession.sparkContext.broadcast(growing)
    sums = rows.mapInPandas(lambda frames: _sums(frames, held.value, widths, terms), HISTOGRAM)
    found = best_splits(sums, gain, fits, features_a_node, seed).orderBy("tree", "node").collect()
    held.unpersist()
    return found


def _with_margin(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                bins = np.stack(frame["bins"].to_numpy()).astype(np.int64)
                yield frame.assign(margin=sum((t.predict(bins) for t in trees), frame["margin"].to_numpy(float)))

    return rows.mapInPandas(add, rows.schema)


def _kept(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
