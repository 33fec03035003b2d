"""From report versions to one retained report a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import age_group, age_years, clean_sex, number, strip, whole_number
from ..plans.study import StudySpec


def drop_deleted(demo: DataFrame, deleted: DataFrame, keys: tuple[str, ...] = ("caseid",)) -> DataFrame:
    """Reports whose case is not listed as deleted (an anti-join; lists apply to their own keys only)."""
    return demo.join(deleted.select(*keys).distinct(), list(keys), "left_anti")


def deletion_counts(demo: DataFrame, deleted: DataFrame) -> DataFrame:
    gone = demo.join(deleted.select("caseid").distinct(), "caseid", "left_semi")
    return gone.agg(F.count("*").alias("removed_rows"), F.count_distinct("caseid").alias("removed_cases"))


def latest_versions(demo: DataFrame, keys: tuple[str, ...] = ("caseid",), nulls_win: bool = True) -> DataFrame:
    """The last report of each key by date, version and report number.

    Within a quarter a missing date or number counts as the latest (``nulls_win``). Full ties go to the
    later file row where a ``file_row`` column gives it. Spark keeps one row a key before the shuffle.
    """
    down = (lambda c: F.col(c).desc_nulls_first()) if nulls_win else (lambda c: F.col(c).desc_nulls_last())
    order = [down(c) for c in ("fda_dt", "caseversion", "primaryid", "file_row") if c in demo.columns]
    place = Window.partitionBy(*keys).orderBy(*order)
    named = demo.where(strip(F.col("caseid")) != "")
    return named.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")


def case_base(
    demo: DataFrame, deleted: DataFrame | None, spec: StudySpec, keys: tuple[str, ...] = ("caseid",)
) -> DataFrame:
    """Retained reports: not deleted, latest, of the study's ages, with a known sex."""
    kept = demo if deleted is None else drop_deleted(demo, deleted, tuple(k for k in keys if k in deleted.columns))
    last = latest_versions(kept, keys)
    fallback = F.col("gndr_cod") if "gndr_cod" in last.columns else F.lit(None)
    years = age_years(number(F.col("age")), F.col("age_cod"))
    base = last.withColumn("age_years", years).withColumn("sex_clean", clean_sex(F.col("sex"), fallback))
    base = base.where(F.col("age_years").between(spec.min_age, spec.max_age) & F.col("sex_clean").isin("F", "M"))
    serious = []
    if "serious" in base.columns:
        text = F.upper(strip(F.col("serious")))
        serious = [F.when(text.isin("1", "Y", "YES", "TRUE"), True).when(text != "", False).alias("serious")]
    return base.select(
        strip(F.col("caseid")).alias("caseid"),
        F.col("primaryid").cast("long").alias("primaryid"),
        F.col("fda_dt").cast("date").alias("fda_dt"),
        "age_years",
        age_group(F.col("age_years")).alias("age_group"),
        "sex_clean",
        F.col("year").cast("int").alias("year"),
        F.col("quarter").cast("string").alias("quarter"),
        F.concat(F.col("year").cast("int").cast("string"), F.col("quarter")).alias("year_quarter"),
        *serious,
    )


def reports_of(base: DataFrame) -> DataFrame:
    """(primaryid, __base): the case of each retained report; two cases of one report stop the job that reads this.

    Child rows would be multiplied without it. The check is part of the plan and needs the exchange that the join on the
    report needs anyway.
    """
    names = F.concat(F.lit("report "), F.col("primaryid").cast("string"), F.lit(" belongs to the cases "), F.min("caseid"), F.lit(" and "), F.max("caseid"))
    own = F.when((F.count("*") > 1) & F.col("primaryid").isNotNull(), F.raise_error(names).cast("string")).otherwise(F.min("caseid"))
    return base.groupBy("primaryid").agg(own.alias("__base"))


def with_case_id(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Child rows of retained reports, with empty case ids filled from their report: semi-join and look-up in one join."""
    own = rows.withColumn("__own", F.nullif(strip(F.col("caseid")), F.lit(""))).drop("caseid")
    joined = own.withColumn("primaryid", whole_number(F.col("primaryid"))).join(reports_of(base), "primaryid")
    return joined.withColumn("caseid", F.coalesce("__own", "__base")).drop("__own", "__base").where("caseid != ''")
