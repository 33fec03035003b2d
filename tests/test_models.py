"""Metrics on hand-computed vectors, and models against an independent solution."""

import numpy as np
import pytest

from casewise import cli
from casewise.ml import metrics, models
from pyspark.sql import functions as F


def test_metrics_on_a_small_vector(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.1)], "label int, score double")
    values = metrics.all_metrics(scored)
    pairs = [(p, n) for p in (0.9, 0.8, 0.2) for n in (0.8, 0.3, 0.1)]
    assert values["roc_auc"] == pytest.approx(sum(1.0 if p > n else 0.5 if p == n else 0 for p, n in pairs) / 9)
    assert values["average_precision"] == pytest.approx((1 / 1 + 2 / 3 + 3 / 5) / 3)
    assert (values["tp"], values["fp"], values["fn"], values["tn"]) == (2, 1, 1, 2)
    assert metrics.youden_threshold(scored).first().threshold == 0.9
    assert metrics.calibration_bins(scored, 3).agg(F.sum("n")).first()[0] == 6


def test_logistic_matches_a_newton_solution(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), int(rng.random() < 0.3 + 0.3 * (i % 2)), ["65-74", "75-84"][i % 2], "FM"[i % 3 > 0], "Q1", 2020.0, float(i % 7), float(i % 5), *[float(i % (k + 2) == 0) for k in range(10)]) for i in range(400)]
    schema = "caseid string, label int, age_group string, sex_clean string, quarter string, year double, drug_n double, distinct_drug_n double, " + ", ".join(f"{c} double" for c in models.FLAGS)
    frame = models.balanced_weights(spark.createDataFrame(rows, schema))
    model = models.fit(frame, models.logistic(frame))
    seen = model.transform(frame).select("features", "label", "weight").toPandas()
    x = np.stack([v.toArray() for v in seen["features"]])
    x1, y, w = np.hstack([x, np.ones((len(x), 1))]), seen["label"].to_numpy(), seen["weight"].to_numpy()
    ridge = np.r_[np.ones(x.shape[1]), 0.0]
    theta = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ theta))
        theta -= np.linalg.solve((x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge + 1e-12), x1.T @ (w * (p - y)) + ridge * theta)
    assert np.abs(model.stages[-1].coefficients.toArray() - theta[:-1]).max() < 1e-3
    scored = models.scores(model, frame)
    curve = models.calibrator(scored)
    assert models.calibrated(scored, curve).where("score between 0 and 1").count() == 400
    limits = {r.metric: (r.low, r.high) for r in models.bootstrap(scored, 50).collect()}
    auc = metrics.auc(scored).first()[0]
    assert limits["roc_auc"][0] < auc < limits["roc_auc"][1]
    fold = models.folds(frame, 5).groupBy("label", "fold").count().toPandas()
    assert fold.groupby("label")["count"].agg(lambda c: c.max() - c.min()).max() <= 1
    assert models.fit(frame, models.forest(5, 4)) and models.fit(frame, models.boosted(3, 2))


def tiny_period(spark, folder):
    rows = [(f"c{i}", i % 7 == 0, i % 5 == 0, i % 3 == 0, ["65-74", "75-84", ">=85"][i % 3], "FM"[i % 2], f"Q{1 + i % 4}", 2021 + i % 4, 1 + i % 9, 1 + i % 6, i % 11 > 4) for i in range(420)]
    names = ["caseid", "is_fall_narrow", "is_fall_broad", "serious", "age_group", "sex_clean", "quarter", "year", "drug_n", "distinct_drug_n", "flag"]
    frame = spark.createDataFrame(rows, names)
    frame.drop("drug_n", "distinct_drug_n", "flag").write.parquet(f"{folder}/period/signal_dataset_2021_2024")
    flags = [F.col("flag").alias(c) for c in models.FLAGS]
    frame.select("caseid", "drug_n", "distinct_drug_n", *flags).write.parquet(f"{folder}/period/feature_dataset_2021_2024")


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_model_command(spark, tmp_path, kind):
    tiny_period(spark, tmp_path)
    options = ["--train-end-year", "2022", "--valid-year", "2023", "--test-year", "2024", "--cv-folds", "2", "--bootstrap-iterations", "20"]
    cli.main(["model", "--output", str(tmp_path), "--kind", kind, *options, "--n-estimators", "3", "--max-depth", "2"], spark)
    (folder,) = (tmp_path / "models").iterdir()
    assert {p.name for p in folder.iterdir()} >= {"cv.csv", "metrics.json", "split.csv", "roc.csv", "calibration.csv", "bootstrap.csv", "predictions", "pipeline", "features.csv"}
    assert spark.read.parquet(str(folder / "predictions")).count() == 105


def test_sample_and_bins(spark):
    frame = spark.createDataFrame([(str(i), int(i == 3)) for i in range(20)], "caseid string, label int")
    assert [models.fixed_sample(frame, n).count() for n in (None, 0, -1, 20, 50)] == [20] * 5
    one = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert [tuple(r) for r in metrics.calibration_bins(one).collect()] == [(1, 2, 0.5, 0.5)]
    three = spark.createDataFrame([(i % 2, s) for i, s in enumerate([0.1, 0.2, 0.3] * 4)], "label int, score double")
    assert sorted(r.bin for r in metrics.calibration_bins(three).collect()) == [1, 2, 3]
