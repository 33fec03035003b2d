"""Descriptive tables of a case relation; each is one aggregate turned into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, truth
from .ordered import exact_quantiles


def overview(cases: DataFrame) -> DataFrame:
    one = cases.agg(
        F.count("*").cast("string").alias("n_rows"),
        F.count_distinct("caseid").cast("string").alias("n_caseid"),
        F.count_distinct("primaryid").cast("string").alias("n_primaryid"),
        F.lit(str(len(cases.columns))).alias("n_columns"),
        F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ",").alias("years"),
        F.array_join(F.array_sort(F.collect_set("quarter")), ",").alias("quarters"),
        F.min("fda_dt").cast("string").alias("first_date"),
        F.max("fda_dt").cast("string").alias("last_date"),
    )
    return _rows(one, "indicator", "value")


def _rows(one: DataFrame, name: str, value: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', `{c}`" for c in one.columns)
    return one.selectExpr(f"stack({len(one.columns)}, {pairs}) as ({name}, {value})")


#: Columns whose missing values the report counts (fixed values).
KEY_COLUMNS = [
    "caseid", "primaryid", "fda_dt", "age_years", "age_group", "sex_clean", "serious", "is_serious_any", "is_fall_narrow", "is_fall_broad", "fall_pt_list",
    "is_zolpidem", "is_zolpidem_suspect", "is_zolpidem_suspect_ps", "target_drug_group", "target_drug_group_ps", "polypharmacy_5", "drug_n", "distinct_drug_n",
]


def missingness(cases: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls by column (an empty text or list is a value); columns that the relation lacks are left out.

    So is ``serious`` if no report states it while seriousness by outcome codes is known.
    """
    have = [c for c in columns if c in cases.columns]
    known = [F.lit(True).alias("__stated")]
    if "serious" in have and "is_serious_any" in cases.columns:
        known = [((F.count("serious") > 0) | (F.count("is_serious_any") == 0)).alias("__stated")]
    one = cases.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in have], F.count("*").alias("__n"), *known)
    pairs = ", ".join(f"'{c}', `{c}`" for c in have)
    long = one.selectExpr("__n", "__stated", f"stack({len(have)}, {pairs}) as (variable, n_missing)").where("variable != 'serious' or __stated")
    return long.select("variable", "n_missing", F.coalesce(F.round(100.0 * F.col("n_missing") / F.nullif(F.col("__n"), F.lit(0)), 2), F.lit(0.0)).alias("percent"))


def numeric_summary(cases: DataFrame, column: str = "age_years") -> DataFrame:
    c = F.col(column)
    one = cases.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = F.col("quantiles")
    both = one.crossJoin(F.broadcast(exact_quantiles(cases, column, [0.25, 0.5, 0.75])))  # one row with one row
    return both.select("n", *[F.round(v, 2).alias(name) for name, v in {"mean": F.col("mean"), "sd": F.col("sd"), "median": q[1], "p25": q[0], "p75": q[2], "min": F.col("min"), "max": F.col("max")}.items()])


def distribution(cases: DataFrame, column: str, label: str = "missing") -> DataFrame:
    """Counts and percent of each level, missing ones under ``label``."""
    level = F.when(is_blank(F.col(column)), F.lit(label)).otherwise(F.trim(F.col(column).cast("string")))
    counts = cases.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    total = cases.agg(F.count("*").alias("__n"))
    return counts.crossJoin(F.broadcast(total)).select(F.lit(column).alias("variable"), "level", "n", F.round(100.0 * F.col("n") / F.col("__n"), 2).alias("percent"))


def flag_distribution(cases: DataFrame, flags: list[str], only_known: bool = False) -> DataFrame:
    """Positive rows of each flag; with ``only_known``, flags that are never set are left out."""
    have = [c for c in flags if c in cases.columns]
    one = cases.agg(F.count("*").alias("__n"), *[F.struct(F.count_if(truth(c)).alias("n"), F.count(c).alias("k")).alias(c) for c in have])
    pairs = ", ".join(f"'{c}', `{c}`.n, `{c}`.k" for c in have)
    long = one.selectExpr("__n", f"stack({len(have)}, {pairs}) as (variable, n, k)")
    if only_known:
        long = long.where("k > 0")
    return long.select("variable", "n", F.coalesce(F.round(100.0 * F.col("n") / F.nullif(F.col("__n"), F.lit(0)), 2), F.lit(0.0)).alias("percent"))


def exposure_outcome_crosstab(cases: DataFrame, exposures: list[str], outcomes: list[str]) -> DataFrame:
    """Exposure x status x outcome with cases, outcomes and reporting rate."""
    cells = {}
    for e in exposures:
        for status in (True, False):
            side = truth(e) == F.lit(status)
            for o in outcomes:
                cells[(e, o, status)] = F.struct(F.count_if(side).alias("n"), F.count_if(side & truth(o)).alias("k"))
    one = cases.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells.values())])
    pairs = ", ".join(f"'{e}', '{o}', {str(s).lower()}, c{i}.n, c{i}.k" for i, (e, o, s) in enumerate(cells))
    long = one.selectExpr(f"stack({len(cells)}, {pairs}) as (exposure, outcome, exposed, n_cases, n_outcome)")
    return long.withColumn("rate", F.coalesce(F.round(F.col("n_outcome") / F.nullif(F.col("n_cases"), F.lit(0)), 6), F.lit(0.0)))


def top_terms(cases: DataFrame, top: int = 20) -> DataFrame:
    """Most frequent broad terms: distinct cases, as a percent of all rows and of rows with the broad outcome."""
    totals = cases.agg(F.count("*").alias("__n"), F.count_if(truth("is_fall_broad")).alias("__b"))
    terms = cases.select("caseid", F.explode(F.split("fall_pt_list", "[|]")).alias("pt")).where("pt != ''").distinct()
    ranked = terms.groupBy("pt").agg(F.count("*").alias("n_cases")).orderBy(F.desc("n_cases"), "pt").limit(top)
    return ranked.crossJoin(F.broadcast(totals)).select(
        "pt", "n_cases", F.round(100.0 * F.col("n_cases") / F.col("__n"), 2).alias("percent_all"),
        F.coalesce(F.round(100.0 * F.col("n_cases") / F.nullif(F.col("__b"), F.lit(0)), 2), F.lit(0.0)).alias("percent_broad"),
    )


def quarter_summary(cases: DataFrame) -> DataFrame:
    flags = ("is_fall_narrow", "is_fall_broad", "is_zolpidem_any", "is_zolpidem_suspect", "serious")
    return cases.groupBy("year", "quarter").agg(F.count("*").alias("n_cases"), *[F.count_if(truth(f)).alias(f"n_{f}") for f in flags])


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """A report of small tables."""
    lines = [f"# {title}", ""]
    for name, frame in tables.items():
        rows = frame.collect()
        lines += [f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows] + [""]
    return "\n".join(lines)
