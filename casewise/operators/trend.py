"""Age-trend statistics and logistic inference; relations are aggregated first, tests run on a few counts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import normal_sf, student_sf
from ..functions.text import truth

GROUPS = ("65-74", "75-84", ">=85")


def trend_statistics(rates: DataFrame) -> DataFrame:
    """Pearson chi-square (3x2), Spearman rho and Cochran-Armitage z from the three age rows, in SQL.

    Empty margins give a null chi-square and rho and z = 0 instead of an error.
    """
    n, k, s = F.col("n_cases").cast("double"), F.col("n_outcome").cast("double"), F.col("age_order").cast("double")
    rates = rates.select(n.alias("n"), k.alias("k"), s.alias("s"))
    totals = rates.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.sum(F.col("n") * F.col("s")).alias("all_s"))
    joined = rates.crossJoin(F.broadcast(totals))  # three rows with one
    q = F.col("all_k") / F.nullif(F.col("all_n"), F.lit(0.0))
    hit, miss = F.col("n") * q, F.col("n") * (1 - q)
    chi = F.pow(F.col("k") - hit, 2) / F.nullif(hit, F.lit(0.0)) + F.pow(F.col("n") - F.col("k") - miss, 2) / F.nullif(miss, F.lit(0.0))
    mean = F.col("all_s") / F.nullif(F.col("all_n"), F.lit(0.0))
    off = F.col("s") - mean
    before = F.coalesce(F.sum("n").over(_before()), F.lit(0.0))
    joined = joined.withColumn("chi", chi).withColumn("q", q).withColumn("off", off).withColumn("rank", before + (F.col("n") + 1) / 2)
    one = joined.agg(
        F.first("all_n").alias("all_n"), F.first("all_k").alias("all_k"), F.first("q").alias("q"), F.count("chi").alias("whole"), F.sum("chi").alias("chi"),
        F.sum(F.col("off") * (F.col("k") - F.col("n") * F.col("q"))).alias("t"), F.sum(F.col("n") * F.col("off") * F.col("off")).alias("v"),
        F.sum(F.col("n") * F.pow(F.col("rank") - (F.col("all_n") + 1) / 2, 2)).alias("xx"),
        F.sum(F.col("k") * (F.col("rank") - (F.col("all_n") + 1) / 2)).alias("xk"),
    )
    # ranks of the outcome are (N-K+1)/2 for no and (N-K) + (K+1)/2 for yes, so they differ by N/2
    yy = F.col("all_k") * (F.col("all_n") - F.col("all_k")) / F.nullif(F.col("all_n"), F.lit(0.0)) * F.pow(F.col("all_n") / 2, 2)
    rho = F.col("xk") * F.col("all_n") / 2 / F.nullif(F.sqrt(F.col("xx") * yy), F.lit(0.0))
    variance = F.col("q") * (1 - F.col("q")) * F.col("v")
    z = F.when(variance > 0, F.col("t") / F.sqrt(variance)).otherwise(F.lit(0.0))
    return one.select(
        F.col("all_n").cast("long").alias("n_cases"),
        F.when(F.col("whole") == 3, F.col("chi")).alias("pearson_chi_square"),
        F.lit(2).alias("df"),
        F.when(F.col("whole") == 3, F.exp(-F.col("chi") / 2)).alias("pearson_p"),
        rho.alias("spearman_rho"),
        z.alias("trend_z"),
    )


def _before():
    from pyspark.sql import Window

    return Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # over three rows


def trend_tests(rates: DataFrame) -> dict[str, float | None]:
    """The statistics with their tail probabilities, on the driver (one row)."""
    row = trend_statistics(rates).first().asDict()
    n, rho, z = row["n_cases"] or 0, row["spearman_rho"], row["trend_z"]
    if rho is not None and n > 2:
        t = rho * math.sqrt((n - 2) / max(1 - rho * rho, 1e-300))
        row["spearman_p"] = 2 * student_sf(abs(t), n - 2)
    else:
        row["spearman_p"] = None
    row["trend_p_two_sided"] = 2 * normal_sf(abs(z)) if z else 1.0
    row["trend_p_increasing"] = normal_sf(z) if z else 1.0
    return row


def crosstab(cases: DataFrame, exposure: str = "is_zolpidem_suspect", outcome: str = "is_fall_narrow") -> DataFrame:
    """Exposed cases of each age group without and with the outcome; a group without cases is a row of zeros."""
    groups = cases.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("65-74", "75-84", ">=85")))).alias("age_group"))
    rows = cases.where(truth(exposure)).groupBy("age_group")
    counts = rows.agg(F.count_if(~truth(outcome)).alias("no_outcome"), F.count_if(truth(outcome)).alias("outcome"))
    return groups.join(counts, "age_group", "left").na.fill(0)


#: Flags that adjust the age trend (fixed values).
COVARIATES = ("serious", "polypharmacy_5", "is_benzo", "is_antidepressant", "is_antipsychotic", "is_opioid", "is_antiepileptic")


def trend_design(cases: DataFrame, outcome: str = "is_fall_narrow", exposure: str = "is_zolpidem_suspect") -> DataFrame:
    """(covariates, y) of exposed cases with a known age group: its order, years since the first, sex, and flags (absent ones are constant)."""
    order = F.when(F.col("age_group") == GROUPS[0], 0.0).when(F.col("age_group") == GROUPS[1], 1.0).when(F.col("age_group") == GROUPS[2], 2.0)
    exposed = cases.where(truth(exposure)).withColumn("age_order", order).where("age_order is not null")
    first = exposed.agg(F.min("year").alias("__first"))
    sex = F.coalesce(F.col("sex_clean"), F.lit(""))
    flags = [(truth(c) if c in cases.columns else F.lit(False)).cast("double").alias(c) for c in COVARIATES]
    return exposed.crossJoin(F.broadcast(first)).select(  # with one row
        "age_order", (F.col("year") - F.col("__first")).cast("double").alias("year_centered"), (sex == "M").cast("double").alias("sex_male"),
        (~sex.isin("F", "M")).cast("double").alias("sex_unknown"), *flags, truth(outcome).cast("double").alias("y"),
    )


class Design:
    """Sums over the rows of a logistic regression; covariates are any numbers, ``n`` rows stand behind each.

    Equal rows are counted once and for all; each step is one aggregation of gradient, packed upper triangle of the Gram
    matrix and log-likelihood over what is left, however much that is. Only these sums reach the driver.
    """

    def __init__(self, rows: DataFrame, y: str = "y"):
        names = [c for c in rows.columns if c != y]
        spread = rows.agg(F.count("*").alias("n"), F.sum(y).alias("k"), *[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in names]).first()
        self.n, self.k = int(spread.n), int(spread.k or 0)
        self.names = [c for c in names if self.n and spread[c].low != spread[c].high]
        self.rows = rows.groupBy(*self.names).agg(F.count("*").cast("double").alias("__n"), F.sum(y).alias("__k")).persist()
        self.width = len(self.names) + 1

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.rows.unpersist()

    def sums(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient, Gram matrix and log-likelihood at coefficients ``w`` (the first is the intercept)."""
        x = [F.lit(1.0), *map(F.col, self.names)]
        score = reduce(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(w, x, strict=True)])
        at = self.rows.select("*", F.greatest(F.lit(-500.0), F.least(F.lit(500.0), score)).alias("__s"))
        at = at.select("*", (1 / (1 + F.exp(-F.col("__s")))).alias("__p"))
        bend, lean = F.col("__n") * F.col("__p") * (1 - F.col("__p")), F.col("__k") - F.col("__n") * F.col("__p")
        fit = F.col("__k") * F.col("__s") - F.col("__n") * (F.greatest(F.col("__s"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("__s"))))
        pairs = [(i, j) for i in range(self.width) for j in range(i, self.width)]
        sums = [F.sum(lean * c) for c in x] + [F.sum(bend * x[i] * x[j]) for i, j in pairs] + [F.sum(fit)]
        values = [float(v or 0.0) for v in at.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        gram = np.zeros((self.width, self.width))
        for (i, j), v in zip(pairs, values[self.width :]):
            gram[i, j] = gram[j, i] = v
        return np.array(values[: self.width]), gram, values[-1]


def logistic_inference(rows: DataFrame, y: str = "y", steps: int = 100) -> list[dict]:
    """Unpenalised logistic fit of rows (covariates and ``y``): coefficient, standard error, z, p, odds ratio with limits, diagnostics.

    Newton steps with a pseudo-inverse, halved while the likelihood falls, so constant columns (left out), collinear and
    separating ones give finite, clipped results.
    """
    with Design(rows, y) as design:
        if not design.n:
            return []
        w, taken, converged = np.zeros(design.width), 0, False
        gradient, gram, fit = design.sums(w)
        while taken < steps and not converged:
            taken += 1
            step = np.clip(np.linalg.pinv(gram) @ gradient, -5, 5)
            for _ in range(30):
                after = np.clip(w + step, -50, 50)
                tried = design.sums(after)
                if tried[2] >= fit - 1e-9 * (1 + abs(fit)):
                    break
                step = step / 2
            converged = np.abs(after - w).max() < 1e-9
            w, (gradient, gram, fit) = after, tried
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(gram)), 0))
    out = []
    for name, b, s in zip(["intercept", *design.names], w, se, strict=True):
        z = b / s if s > 0 else 0.0
        low, high = (math.exp(min(max(b + d * 1.96 * s, -50), 50)) for d in (-1, 1))
        out.append(
            {
                "term": name, "coefficient": float(b), "std_error": float(s), "z": float(z), "p_value": 2 * normal_sf(abs(z)),
                "odds_ratio": math.exp(min(max(b, -50), 50)), "or_ci_low": low, "or_ci_high": high,
                "n_cases": design.n, "n_outcome": design.k, "converged": bool(converged), "iterations": taken,
                "log_likelihood": fit, "gradient_largest": float(np.abs(gradient).max()),
            }
        )
    return out


def age_trend_logistic(cases: DataFrame, outcome: str = "is_fall_narrow", exposure: str = "is_zolpidem_suspect") -> DataFrame:
    rows = logistic_inference(trend_design(cases, outcome, exposure))
    schema = (
        "term string, coefficient double, std_error double, z double, p_value double, odds_ratio double, or_ci_low double, or_ci_high double, "
        "n_cases long, n_outcome long, converged boolean, iterations long, log_likelihood double, gradient_largest double"
    )
    return cases.sparkSession.createDataFrame([tuple(r.values()) for r in rows], schema)
