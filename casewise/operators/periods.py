"""Full-period relations: one report a case across all quarters, and the quarters' rows that match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, truth

INDEX = ("caseid", "primaryid", "fda_dt", "year", "quarter", "year_quarter")


def global_index(bases: DataFrame, first_year: int = 2004, last_year: int = 2025, clean: bool = True) -> DataFrame:
    """Latest quarterly report of each case; here a missing date or number loses. Without ``clean``, case ids are known to be stripped."""
    number = F.regexp_extract(F.upper(strip(F.col("quarter"))), "([1-4])", 1).try_cast("int")
    named = strip(F.col("caseid")) if clean else F.col("caseid")
    rows = bases.where(F.col("year").between(first_year, last_year)).where(named != "")
    order = [F.col("fda_dt").desc_nulls_last(), F.col("primaryid").desc_nulls_last(), F.desc("year"), number.desc_nulls_last()]
    place = Window.partitionBy("caseid").orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(place)).where("__place = 1").select(*INDEX)


def signal_of_period(index: DataFrame, signals: DataFrame, clean: bool = True) -> DataFrame:
    """Signal rows of the report that the index has for a case. Without ``clean``, keys are known to be stripped and upper-case."""
    if not clean:
        return signals.join(index.select("caseid", "year", "quarter"), ["caseid", "year", "quarter"])
    keys = index.select(strip(F.col("caseid")).alias("caseid"), F.col("year").cast("int").alias("year"), F.upper(strip(F.col("quarter"))).alias("quarter"))
    rows = signals.withColumns({"caseid": strip(F.col("caseid")), "year": F.col("year").cast("int"), "quarter": F.upper(strip(F.col("quarter")))})
    return rows.join(keys, ["caseid", "year", "quarter"])


def features_of_period(index: DataFrame, features: DataFrame) -> DataFrame:
    """``features`` has its period in ``year_quarter``."""
    return features.join(index.select("caseid", "year_quarter"), ["caseid", "year_quarter"])


def with_features(signals: DataFrame, features: DataFrame) -> DataFrame:
    """Signal rows with the features of the same case and period; a row without any keeps nulls, which count as false.

    The period is the report's quarter, and the name of the period (``dataset_period``) where several are read together.
    """
    if "year_quarter" not in signals.columns:
        signals = signals.withColumn("year_quarter", F.concat(F.col("year").cast("int").cast("string"), F.upper(strip(F.col("quarter")))))
    keys = ["caseid", *[c for c in ("year_quarter", "dataset_period") if c in signals.columns and c in features.columns]]
    own = [c for c in features.columns if c in keys or c not in signals.columns]
    return signals.join(features.select(*own), keys, "left")


def table_counts(**tables: DataFrame) -> DataFrame:
    rows = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.union(row)
    return out


def period_summary(index: DataFrame, signals: DataFrame, features: DataFrame) -> DataFrame:
    """(metric, value): all flag and group counts of the signal rows in one pass, turned into rows."""
    groups = ("no_suspect_drug", "no_target_zdrug_suspect", "other_zdrug_only", "zolpidem_only", "both_zolpidem_and_other_zdrug")
    counts = {
        "signal_dataset_cases": F.count("*"),
        "strict_fall_cases": F.count_if(truth("is_fall_narrow")),
        "broad_fall_cases": F.count_if(truth("is_fall_broad")),
        "suspect_any_cases_ps_ss": F.count_if(truth("suspect_role_any")),
        "suspect_any_cases_ps_only": F.count_if(truth("suspect_role_any_ps")),
        "zolpidem_any_cases": F.count_if(truth("is_zolpidem_any")),
        "zolpidem_suspect_cases_ps_ss": F.count_if(truth("is_zolpidem_suspect")),
        "zolpidem_suspect_cases_ps_only": F.count_if(truth("is_zolpidem_suspect_ps")),
        "other_zdrug_suspect_cases_ps_ss": F.count_if(truth("is_other_zdrug_suspect")),
        "other_zdrug_suspect_cases_ps_only": F.count_if(truth("is_other_zdrug_suspect_ps")),
    }
    for label, column in (("ps_ss", "target_drug_group"), ("ps_only", "target_drug_group_ps")):
        counts |= {f"group_{label}_{g}": F.count_if(F.coalesce(F.col(column) == g, F.lit(False))) for g in groups}
    wide = signals.agg(*[e.alias(n) for n, e in counts.items()])
    pairs = ", ".join(f"'{n}', {n}" for n in counts)
    long = wide.selectExpr(f"stack({len(counts)}, {pairs}) as (metric, value)")
    totals = table_counts(global_total_cases=index, feature_dataset_cases=features).toDF("metric", "value")
    return long.union(totals).orderBy("metric")
