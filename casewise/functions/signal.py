"""Disproportionality measures of a 2x2 table as column expressions on a, b, c, d."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numerics import gamma_ppf_array

Z = 1.96


def digamma(x: Column) -> Column:
    """Recurrence up to x + 8, then the asymptotic series."""
    y = x + F.lit(8.0)
    series = F.ln(y) - 1.0 / (2.0 * y) - 1.0 / (12.0 * y**2) + 1.0 / (120.0 * y**4) - 1.0 / (252.0 * y**6) + 1.0 / (240.0 * y**8)
    for k in range(8):
        series = series - 1.0 / (x + F.lit(float(k)))
    return series


def point_measures(cells: DataFrame) -> DataFrame:
    """Rates, ROR, PRR, Yates chi-square, IC and EBGM points for rows with bigint a, b, c, d."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    expected = F.when(n > 0, (a + b) * (a + c) / n).otherwise(F.lit(0.0))
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    shift = F.when(zero, F.lit(0.5)).otherwise(F.lit(0.0))
    a1, b1, c1, d1 = a + shift, b + shift, c + shift, d + shift
    ror, prr = (a1 * d1) / (b1 * c1), (a1 / (a1 + b1)) / (c1 / (c1 + d1))
    ror_se = F.sqrt(1.0 / a1 + 1.0 / b1 + 1.0 / c1 + 1.0 / d1)
    prr_se = F.sqrt(1.0 / a1 - 1.0 / (a1 + b1) + 1.0 / c1 - 1.0 / (c1 + d1))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    chi = F.when(margins > 0, n * F.pow(F.greatest(F.abs(a * d - b * c) - n / 2.0, F.lit(0.0)), 2) / margins).otherwise(F.lit(0.0))
    some = n > 0
    return cells.select(
        "*",
        n.cast("long").alias("n"),
        F.when(a + b > 0, a / (a + b)).alias("reporting_rate_exposed"),
        F.when(c + d > 0, c / (c + d)).alias("reporting_rate_unexposed"),
        F.when(some, ror).alias("ror"),
        F.when(some, F.exp(F.ln(ror) - Z * ror_se)).alias("ror_ci_low"),
        F.when(some, F.exp(F.ln(ror) + Z * ror_se)).alias("ror_ci_high"),
        F.when(some, prr).alias("prr"),
        F.when(some, F.exp(F.ln(prr) - Z * prr_se)).alias("prr_ci_low"),
        F.when(some, F.exp(F.ln(prr) + Z * prr_se)).alias("prr_ci_high"),
        chi.alias("chi_square_yates"),
        expected.alias("expected_a"),
        F.log2((a + 0.5) / (expected + 0.5)).alias("ic"),
        (F.exp(digamma(a + 1.0)) / (expected + 1.0)).alias("ebgm"),
    )


@F.pandas_udf(T.DoubleType())
def gamma_quantile(p: pd.Series, shape: pd.Series, rate: pd.Series) -> pd.Series:
    """Gamma quantiles; result frames have some dozens of rows."""
    return pd.Series(gamma_ppf_array(p.to_numpy(float), shape.to_numpy(float), rate.to_numpy(float)))


def full_measures(cells: DataFrame) -> DataFrame:
    """Point measures with credibility limits, signal flags and a conclusion."""
    a, e = F.col("a").cast("double"), F.col("expected_a")
    m = point_measures(cells)
    for name, p in (("ic025", 0.025), ("ic975", 0.975)):
        m = m.withColumn(name, F.log2(gamma_quantile(F.lit(p), a + 0.5, e + 0.5)))
    for name, p in (("eb05", 0.05), ("eb95", 0.95)):
        m = m.withColumn(name, gamma_quantile(F.lit(p), a + 1.0, e + 1.0))
    mhra = (F.col("a") >= 3) & (F.col("prr") >= 2) & (F.col("chi_square_yates") >= 4)
    m = m.withColumns(
        {
            "signal_flag_mhra": F.coalesce(mhra, F.lit(False)),
            "signal_flag_ror": F.coalesce(F.col("ror_ci_low") > 1, F.lit(False)),
            "signal_flag_ic": F.coalesce(F.col("ic025") > 0, F.lit(False)),
            "signal_flag_ebgm": F.coalesce((F.col("a") >= 3) & (F.col("eb05") >= 2), F.lit(False)),
        }
    )
    found = F.col("signal_flag_mhra") | F.col("signal_flag_ror") | F.col("signal_flag_ic") | F.col("signal_flag_ebgm")
    return m.withColumn("conclusion", F.when(found, "signal_detected").otherwise("no_clear_signal"))


