"""The report relations derived from generated order tables, so studies run without report files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import stored


@dataclass(frozen=True)
class Reports:
    """The normalised relations every source gives."""

    demo: DataFrame
    deleted: DataFrame
    drug: DataFrame
    reac: DataFrame
    outc: DataFrame


def order_reports(spark: SparkSession, folder: str, retained: DataFrame | None = None) -> Reports:
    """With ``retained``, whose ``primaryid`` are reports, drug and reaction rows of those only: lines are parted from the rest before
    they meet their parts, once, and what is left is written for both relations."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    orders, customer, lines, part = read("orders"), read("customer"), read("lineitem"), read("part")
    month = F.col("c_nationkey") % 5 == 0
    age = F.lit(60) + F.col("c_custkey") % 40
    sex = F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE"), "F").when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "M").otherwise("")
    demo = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").cast("string").alias("caseid"),
        F.col("o_orderkey").alias("primaryid"),
        F.col("o_orderdate").cast("date").alias("fda_dt"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("caseversion"),
        F.when(month, age * 12).otherwise(age).cast("string").alias("age"),
        F.when(month, "MON").otherwise("YR").alias("age_cod"),
        sex.alias("sex"),
        F.year("o_orderdate").alias("year"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"),
    )
    deleted = customer.where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("caseid"))
    if retained is not None:
        lines = lines.join(retained.select(F.col("primaryid").alias("l_orderkey")), "l_orderkey", "left_semi")
    items = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_returnflag", "p_name", "p_brand", "p_type")
    if retained is not None:
        items = stored(items, "items")
    role = F.when(F.col("l_returnflag") == "R", "PS").when(F.col("l_returnflag") == "A", "SS").otherwise("C")
    drug = items.select(
        F.col("l_orderkey").alias("primaryid"), F.lit("").alias("caseid"), F.upper("p_name").alias("drugname"), F.upper("p_brand").alias("prod_ai"), role.alias("role_cod")
    )
    reac = items.select(F.col("l_orderkey").alias("primaryid"), F.lit("").alias("caseid"), F.upper("p_type").alias("pt"))
    code = F.create_map(*map(F.lit, ("1", "DE,HO", "2", "LT", "3", "OT/XX", "4", "", "5", "HO;OT")))
    outc = orders.select(
        F.col("o_orderkey").alias("primaryid"), F.lit("").alias("caseid"), F.element_at(code, F.substring("o_orderpriority", 1, 1)).alias("outc_cod")
    )
    return Reports(demo, deleted, drug, reac, outc)
