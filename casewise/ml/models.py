"""Modelling frame, temporal split, logistic pipeline and trees, calibration, cross-validation and bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truth
from ..operators.cases import CLASSES
from ..operators.ordered import hash_ranks, least_by_hash
from .metrics import all_metrics
from .trees import Boosted, Forest, TreeModel

CATEGORICAL = ("age_group", "sex_clean", "quarter")
NUMERIC = ("year", "drug_n", "distinct_drug_n")
FLAGS = (*CLASSES, "polypharmacy_5")
TARGETS = ("is_fall_narrow", "is_fall_broad", "serious")


def modelling_frame(signals: DataFrame, features: DataFrame, target: str = "is_fall_narrow") -> DataFrame:
    """One row a case: label, categories with 'unknown', numbers with 0, flags as 0 or 1."""
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}")
    right = features.select("caseid", "drug_n", "distinct_drug_n", *FLAGS)
    joined = signals.select("caseid", target, *CATEGORICAL, "year").join(right, "caseid")
    return joined.select(
        "caseid", truth(target).cast("int").alias("label"), *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in CATEGORICAL],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMERIC], *[truth(c).cast("double").alias(c) for c in FLAGS],
    )


def temporal_split(frame: DataFrame, train_end: int = 2023, valid: int = 2024, test: int = 2025) -> dict[str, DataFrame]:
    year = F.col("year").cast("int")
    parts = {"train": frame.where(year <= train_end), "valid": frame.where(year == valid), "test": frame.where(year == test)}
    empty = [n for n, p in parts.items() if p.isEmpty()]
    if empty:
        raise ValueError(f"no rows in: {', '.join(empty)}")
    return parts


def split_summary(parts: dict[str, DataFrame]) -> DataFrame:
    rows = [p.agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_positive")).select(F.lit(n).alias("part"), "n_rows", "n_positive") for n, p in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


def fixed_sample(frame: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a hash: the same rows however the frame is partitioned. None, 0 or less: all rows, as with no more than ``n``."""
    if n is None or n <= 0:
        return frame
    out = least_by_hash(frame, n, "caseid", seed)
    if out is not frame and out.where("label = 1").isEmpty():
        raise ValueError("the sample has no positive case")
    return out


def balanced_weights(frame: DataFrame) -> DataFrame:
    row = frame.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    n, p = row.n, row.p or 0
    return frame.withColumn("weight", F.when(F.col("label") == 1, n / (2 * max(p, 1))).otherwise(n / (2 * max(n - p, 1))))


def feature_stages(train: DataFrame) -> list:
    """Categories one-hot with unseen levels as all zeros, numbers by mean and population deviation of ``train``, flags as they are."""
    index = StringIndexer(inputCols=list(CATEGORICAL), outputCols=[f"{c}_i" for c in CATEGORICAL], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in CATEGORICAL], outputCols=[f"{c}_v" for c in CATEGORICAL], dropLast=True)
    one = train.agg(*[F.avg(c).alias(f"m_{c}") for c in NUMERIC], *[F.stddev_pop(c).alias(f"s_{c}") for c in NUMERIC]).first()
    numbers = ", ".join(f"(`{c}` - {one[f'm_{c}'] or 0.0!r}D) / {one[f's_{c}'] or 1.0!r}D AS `{c}_s`" for c in NUMERIC)  # a constant becomes 0
    scaled = SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__")
    whole = VectorAssembler(inputCols=[*[f"{c}_v" for c in CATEGORICAL], *[f"{c}_s" for c in NUMERIC], *FLAGS], outputCol="features")
    return [index, hot, scaled, whole]


def logistic(train: DataFrame, max_iter: int = 2500, c: float = 1.0) -> LogisticRegression:
    """L2 with inverse strength ``c`` on the sum of weighted losses; MLlib averages, hence the scaling."""
    total = train.agg(F.sum("weight")).first()[0]
    return LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=1 / (c * total), elasticNetParam=0.0, standardization=False)


def forest(trees: int = 300, depth: int | None = None, seed: int = 42) -> Forest:
    return Forest(trees=trees, depth=depth, seed=seed)


def boosted(rounds: int = 400, depth: int = 5, rate: float = 0.05, seed: int = 42) -> Boosted:
    return Boosted(rounds=rounds, depth=depth, rate=rate, seed=seed)


def fit(train: DataFrame, estimator) -> PipelineModel | TreeModel:
    """A fitted model; trees weigh classes by their own rules, so they leave out the column of weights."""
    if isinstance(estimator, Boosted | Forest):
        return estimator.fit(train, CATEGORICAL, NUMERIC, FLAGS)
    return Pipeline(stages=[*feature_stages(train), estimator]).fit(train)


def scores(model: PipelineModel | TreeModel, frame: DataFrame) -> DataFrame:
    if isinstance(model, TreeModel):
        return model.scores(frame)
    return model.transform(frame).select("caseid", "label", vector_to_array("probability")[1].alias("score"))


def feature_table(model: PipelineModel | TreeModel, sample: DataFrame) -> list[tuple[str, float]]:
    """Names with coefficients or importances, largest in size first."""
    if isinstance(model, TreeModel):
        return model.feature_table()
    meta = model.transform(sample.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in meta.values() for a in kind}
    return sorted(((names[i], float(v)) for i, v in enumerate(model.stages[-1].coefficients.toArray())), key=lambda t: (-abs(t[1]), t[0]))


def save(model: PipelineModel | TreeModel, spark: SparkSession, folder: str) -> None:
    if isinstance(model, TreeModel):
        model.save(spark, folder)
    else:
        model.write().overwrite().save(folder)


def calibrator(valid: DataFrame) -> tuple[float, float]:
    """Slope and shift of Platt's logistic curve on the log-odds of validation scores."""
    logit = _logit(F.col("score"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(valid.select("label", logit.alias("x")))
    fitted = LogisticRegression(regParam=1 / max(rows.count(), 1), standardization=False, maxIter=200).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def _logit(score):
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), score))
    return F.ln(clipped / (1 - clipped))


def calibrated(scored: DataFrame, curve: tuple[float, float]) -> DataFrame:
    return scored.withColumn("score", 1 / (1 + F.exp(-(curve[0] * _logit(F.col("score")) + curve[1]))))


def folds(frame: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold numbers by rank of a hash within each label; no task orders a whole label."""
    ranked = hash_ranks(frame, "label", "caseid", seed, "__rank")
    return ranked.withColumn("fold", (F.col("__rank") % k).cast("int")).drop("__rank")


def cross_validate(frame: DataFrame, make, k: int = 5, seed: int = 42) -> pd.DataFrame:
    """Metrics by fold; ``make(train)`` gives an estimator."""
    rows = folds(frame, k, seed).cache()
    out = []
    for i in range(k):
        train = balanced_weights(rows.where(F.col("fold") != i))
        out.append({"fold": i} | all_metrics(scores(fit(train, make(train)), rows.where(F.col("fold") == i))))
    rows.unpersist()
    return pd.DataFrame(out)


def cv_summary(results: pd.DataFrame) -> pd.DataFrame:
    values = results.drop(columns="fold")
    return pd.DataFrame({"metric": values.columns, "mean": values.mean().to_numpy(), "std": values.std(ddof=1).to_numpy()})


def bootstrap(scored: DataFrame, draws: int = 1000, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """(metric, low, high): percentile limits from stratified resamples.

    A resample only needs how often each distinct score is drawn, so draws run on counts by score: one
    multinomial a label and draw, spread over tasks. Scores count to six digits, so the counts, which
    every task gets, are a million rows at most.
    """
    counts = scored.groupBy(F.round("score", 6).alias("score")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    table = counts.orderBy("score").toPandas()
    s, p, n = table["score"].to_numpy(float), table["p"].to_numpy(np.int64), table["n"].to_numpy(np.int64)

    def run(frames):
        for frame in frames:
            rows = []
            for draw in frame["id"]:
                rng = np.random.default_rng([seed, int(draw)])
                dp, dn = rng.multinomial(p.sum(), p / max(p.sum(), 1)), rng.multinomial(n.sum(), n / max(n.sum(), 1))
                below = np.cumsum(dn) - dn
                rank = (dp * (below + dn / 2)).sum() / max(dp.sum() * dn.sum(), 1)
                tp, fp = np.cumsum(dp[::-1]), np.cumsum(dn[::-1])
                ap = (dp[::-1] * tp / np.maximum(tp + fp, 1)).sum() / max(dp.sum(), 1)
                error = (dp * (1 - s) ** 2 + dn * s**2).sum() / max(dp.sum() + dn.sum(), 1)
                hit = s >= threshold
                rows += [("roc_auc", rank), ("average_precision", ap), ("brier", error), ("recall", dp[hit].sum() / max(dp.sum(), 1)), ("specificity", dn[~hit].sum() / max(dn.sum(), 1))]
            yield pd.DataFrame(rows, columns=["metric", "value"])

    drawn = scored.sparkSession.range(draws).mapInPandas(run, "metric string, value double")
    limits = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return drawn.groupBy("metric").agg(limits.alias("l")).select("metric", F.col("l")[0].alias("low"), F.col("l")[1].alias("high"))
