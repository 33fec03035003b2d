"""Histogram trees against brute-force ones on the same draws."""

import math

import numpy as np
import pytest

from casewise.ml import metrics, models, trees

SCHEMA = "caseid string, label int, age_group string, sex_clean string, quarter string, year double, drug_n double, distinct_drug_n double, " + ", ".join(f"{c} double" for c in models.FLAGS)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        age, sex, quarter = rng.choice(["65-74", "75-84", ">=85"]), rng.choice(["F", "M"]), rng.choice(["Q1", "Q2", "Q3", "Q4"])
        drugs, flags = float(rng.poisson(4)), [float(x) for x in rng.random(10) < 0.3]
        odds = -1.5 + 0.9 * (age == ">=85") + 0.25 * drugs + 1.2 * flags[0] * flags[1] - 0.8 * (sex == "M")
        rows.append((str(i), int(rng.random() < 1 / (1 + math.exp(-odds))), str(age), str(sex), str(quarter), 2020.0 + i % 3, drugs, max(0.0, drugs - float(rng.integers(0, 3))), *flags))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def binned(frame, binning, seed):
    rows = trees._rows(frame, binning, seed).toPandas()
    return rows["key"].to_numpy(), rows["label"].to_numpy(float), np.stack(rows["bins"].to_numpy()).astype(int)


def best(x, a, b, n, features, gain, fits):
    """(gain, feature, cut) of largest gain, ties to the smaller feature, then cut."""
    found = None
    for f in features:
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            la, lb, ln = a[left].sum(), b[left].sum(), n[left].sum()
            if fits(lb, ln, b.sum(), n.sum()):
                g = round(gain(la, lb, a.sum(), b.sum()), 9)
                if found is None or g > found[0]:
                    found = (g, f, cut)
    return found


def test_boosting_equals_brute_force(spark, frame, monkeypatch):
    monkeypatch.setattr(trees, "KEEP_ROUNDS", 2)
    made = trees.Boosted(rounds=5, depth=3, rate=0.3, seed=9)
    model = made.fit(frame, models.CATEGORICAL, models.NUMERIC, models.FLAGS)
    key, y, x = binned(frame, model.binning, 9)
    weight = np.where(y == 1, max(1.0, (len(y) - y.sum()) / y.sum()), 1.0)
    margin = np.zeros(len(y))

    def grow(rows, depth, value, g, h, features):
        total = -0.3 * g[rows].sum() / (h[rows].sum() + 1)
        gain = lambda la, lb, a, b: (la**2 / (lb + 1) + (a - la) ** 2 / (b - lb + 1) - a**2 / (b + 1)) / 2
        found = best(x[rows], g[rows], h[rows], np.ones(len(rows)), features, gain, lambda lb, ln, b, n: lb >= 5 and b - lb >= 5) if depth else None
        if found is None or found[0] <= 0:
            return lambda z: np.full(len(z), total)
        left = x[rows][:, found[1]] <= found[2]
        low, high = (grow(part, depth - 1, value, g, h, features) for part in (rows[left], rows[~left]))
        return lambda z: np.where(z[:, found[1]] <= found[2], low(z), high(z))

    for number in range(5):
        p = 1 / (1 + np.exp(-margin))
        used = np.flatnonzero(trees.uniform(key, number) < 0.8)
        width = x.shape[1]
        features = sorted(np.random.default_rng([9, number]).permutation(width)[: int(0.8 * width)].tolist())
        tree = grow(used, 3, None, weight * (p - y), weight * p * (1 - p), features)
        margin = margin + tree(x)
        assert np.allclose(model.trees[number].predict(x), tree(x), atol=1e-9)
    scored = model.scores(frame)
    assert np.allclose(sorted(r.score for r in scored.collect()), sorted(1 / (1 + np.exp(-margin))), atol=1e-9)
    assert metrics.auc(scored).first()[0] > 0.7
    table = model.feature_table()
    assert sum(v for _, v in table) == pytest.approx(1.0) and len(table) == len(model.binning.names)


def test_forest_equals_brute_force(spark, frame):
    made = trees.Forest(trees=3, least_rows=10, seed=5)
    model = made.fit(frame, models.CATEGORICAL, models.NUMERIC, models.FLAGS)
    key, y, x = binned(frame, model.binning, 5)
    order = {}
    drawn = spark.createDataFrame([(t, n, f) for t in range(3) for n in range(len(model.trees[t].feature)) for f in range(x.shape[1])], "tree int, node int, feature int")
    for r in drawn.selectExpr("tree", "node", "feature", "xxhash64(tree, node, feature, 5) as h").collect():
        order.setdefault((r.tree, r.node), []).append((r.h, r.feature))
    few = int(x.shape[1] ** 0.5)
    for number, tree in enumerate(model.trees):
        times = trees.poisson_draws(trees.uniform(key, number + 5))
        n, p = times.sum(), times[y == 1].sum()
        w = times * np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
        at = tree.walk(x)
        below = {i: {i} for i in range(len(tree.feature))}
        for i in reversed(range(len(tree.feature))):
            if tree.feature[i] >= 0:
                below[i] |= below[tree.left[i]] | below[tree.left[i] + 1]
        impurity = lambda a, b: 2 * a * (b - a) / b if b > 0 else 0.0
        for i in range(len(tree.feature)):
            rows = np.flatnonzero(np.isin(at, list(below[i])) & (times > 0))
            a, b, ones = (w * y)[rows], w[rows], np.ones(len(rows))
            assert tree.value[i] == pytest.approx(a.sum() / b.sum(), abs=1e-9) and len(rows) >= 10
            features = [f for _, f in sorted(order[(number, i)])]
            varied = [f for f in features if len(np.unique(x[rows][:, f])) > 1]
            chosen = features[: max(few, features.index(varied[0]) + 1)] if varied else []
            found = best(x[rows], a, b, ones, sorted(chosen), lambda la, lb, sa, sb: impurity(sa, sb) - impurity(la, lb) - impurity(sa - la, sb - lb), lambda lb, ln, sb, sn: ln >= 10 and sn - ln >= 10)
            splits = found is not None and len(rows) >= 20 and 1e-9 * b.sum() < a.sum() < (1 - 1e-9) * b.sum()
            assert (tree.feature[i] >= 0) == splits
            if splits:
                assert tree.gain[i] == pytest.approx(max(found[0], 0.0), abs=1e-8) and (tree.feature[i], tree.cut[i]) == found[1:]
    assert max(len(t.feature) for t in model.trees) > 31
    mean = np.mean([t.predict(x) for t in model.trees], axis=0)
    assert np.allclose(sorted(r.score for r in model.scores(frame).collect()), sorted(mean), atol=1e-9)


def test_models_survive_a_save_and_unknown_levels(spark, frame, tmp_path):
    model = models.fit(frame, models.boosted(2, 2, 0.5))
    models.save(model, spark, str(tmp_path / "m"))
    again = trees.TreeModel.load(spark, str(tmp_path / "m"))
    odd = frame.limit(5).selectExpr("caseid", "label", "'new' as age_group", "cast(null as string) as sex_clean", *frame.columns[4:])
    both = [sorted(r.score for r in m.scores(odd).collect()) for m in (model, again)]
    assert both[0] == both[1] and len(both[0]) == 5
    assert model.scores(frame.limit(0)).count() == 0
    one = trees.Forest(trees=2).fit(frame.where("label = 0"), models.CATEGORICAL, models.NUMERIC, models.FLAGS)
    assert {r.score for r in one.scores(frame).collect()} == {0.0}
