"""Running sums, quantiles, ranks and samples against brute force, and their plans."""

import numpy as np
import pytest

from casewise.ml import metrics, models
from casewise.operators import ordered, report
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    numbers = [*np.round(rng.standard_normal(3_000), 3).tolist(), *[0.25] * 2_000, -1e300, 1e300, 5.0]
    rows = [(str(i), float(x), int(rng.random() < 0.3)) for i, x in enumerate(dict.fromkeys(numbers))]
    counts = {x: (numbers.count(x), i % 7) for i, (_, x, _) in enumerate(rows)}
    return spark.createDataFrame([(x, *c) for x, c in counts.items()], "score double, p long, n long").repartition(5).cache(), counts


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums(values, descending):
    rows, counts = values
    got = {r.score: (r.before_p, r.before_n) for r in ordered.prefix_sums(rows, "score", ["p", "n"], descending).collect()}
    p = n = 0
    for x in sorted(counts, reverse=descending):
        assert got[x] == (p, n)
        p, n = p + counts[x][0], n + counts[x][1]
    assert len(got) == len(counts)


def test_prefix_sums_of_nothing_nulls_and_one(spark):
    rows = spark.createDataFrame([(None, 4), (2.0, 1), (1.0, 2)], "score double, p long")
    assert {r.score: r.before_p for r in ordered.prefix_sums(rows, "score", ["p"]).collect()} == {1.0: 0, 2.0: 2, None: 3}
    assert {r.score: r.before_p for r in ordered.prefix_sums(rows, "score", ["p"], True).collect()} == {2.0: 0, 1.0: 1, None: 3}
    assert ordered.prefix_sums(rows.limit(0), "score", ["p"]).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    for numbers in ([3.5], [1.0, 2.0], [0.1] * 50 + [9.0], rng.exponential(size=1_777).round(2).tolist()):
        rows = spark.createDataFrame([(x,) for x in numbers] + [(None,)], "age_years double")
        shares = [0.0, 0.25, 0.5, 0.9, 1.0]
        assert ordered.exact_quantiles(rows, "age_years", shares).first()[0] == pytest.approx(np.quantile(numbers, shares).tolist(), abs=1e-12)
    assert ordered.exact_quantiles(rows.limit(0), "age_years", [0.5]).first()[0] is None
    summary = report.numeric_summary(rows).first()
    assert (summary.n, summary.median, summary.p75) == (1_777, round(np.quantile(numbers, 0.5), 2), round(np.quantile(numbers, 0.75), 2))
    assert report.numeric_summary(rows.limit(0)).first().n == 0
    assert "percentile(" not in plan(report.numeric_summary(rows))


def test_no_metric_orders_scores_in_one_task(spark):
    rng = np.random.default_rng(8)
    rows = [(int(y), round(float(s), 2)) for y, s in zip(rng.random(4_000) < 0.2, rng.random(4_000) ** 2, strict=True)]
    scored = spark.createDataFrame(rows, "label int, score double").repartition(6)
    for frame in (metrics.roc_points(scored), metrics.auc(scored), metrics.average_precision(scored)):
        lines = [x for x in plan(frame).splitlines() if "Window [" in x]
        assert lines and all("__range" in x for x in lines)
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    points = {r.threshold: (r.tp, r.fp) for r in metrics.roc_points(scored).collect()}
    assert points == {t: (int((y[s >= t]).sum()), int((1 - y[s >= t]).sum())) for t in set(s.tolist())}
    higher = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert metrics.auc(scored).first()[0] == pytest.approx(higher, abs=1e-12)
    edges = np.unique(np.quantile(s, np.linspace(0, 1, 11)))
    place = np.clip(np.searchsorted(edges, s, "left"), 1, len(edges) - 1)
    got = {r.bin: (r.n, pytest.approx(r.event_rate)) for r in metrics.calibration_bins(scored).collect()}
    assert got == {int(b): (int((place == b).sum()), y[place == b].mean()) for b in np.unique(place)}


def test_folds_and_samples_by_hash(spark):
    frame = spark.createDataFrame([(str(i), int(i % 9 == 0)) for i in range(3_000)], "caseid string, label int").repartition(7)
    keyed = [(r.h, r.caseid, r.label) for r in frame.select(F.xxhash64("caseid", F.lit(42)).alias("h"), "caseid", "label").collect()]
    want = {}
    for label in (0, 1):
        want |= {case: i % 5 for i, (_, case, own) in enumerate(sorted(x for x in keyed if x[2] == label))}
    folds = models.folds(frame)
    assert {r.caseid: r.fold for r in folds.collect()} == want
    assert all("__range" in x for x in plan(folds).splitlines() if "Window [" in x)
    for n, few in ((1, 20_000), (700, 1), (2_999, 3), (3_000, 5), (9_000, 5)):
        got = {r.caseid for r in ordered.least_by_hash(frame, n, "caseid", 42, few).collect()}
        assert got == {case for _, case, _ in sorted(keyed)[:n]}
    repeated = frame.union(frame).union(frame)
    assert ordered.least_by_hash(repeated, 1_001, "caseid", 42, 1).count() == 1_001
