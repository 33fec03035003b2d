"""Structure of report files: which tables, columns and separators each quarter has, and how they change over the years.

Names and first lines (one a file) are a relation; everything else is expressions and groupings over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Separators, the earlier first among equals, and tables that file names begin with (fixed values).
SEPARATORS = ("$", "\t", "|", ",")
FAMILIES = ("DEMO", "DRUG", "INDI", "OUTC", "REAC", "RPSR", "THER", "STAT", "SIZE")


def header_lines(spark: SparkSession, root: str) -> DataFrame:
    """(below, size_bytes, header) of every text file under a year and a quarter; header is null where it can't be read."""
    entries = [e for e in store.files_below(spark, str(root), ".txt") if e.below.count("/") >= 2]
    rows = [(e.below, e.size, store.first_line(spark, e.path)) for e in entries]
    return spark.createDataFrame(rows, "below string, size_bytes long, header string")


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def scan_files(headers: DataFrame) -> DataFrame:
    """One row a file: year, quarter, table, folder, size, separator, cleaned columns or what is wrong with the header."""
    folders = F.split("below", "/")
    rows = headers.where(F.col("below").rlike("^[0-9]{4}/[Qq][1-4]/")).withColumn("file_name", F.element_at(folders, -1))
    votes = F.array(*[F.struct(_count(F.col("header"), s).alias("n"), F.lit(-i).alias("first"), F.lit(s).alias("separator")) for i, s in enumerate(SEPARATORS)])
    rows = rows.withColumn("vote", F.array_max(votes))
    issue = (
        F.when(F.col("header").isNull(), "read_error").when(F.col("header") == "", "empty_header").when(F.col("vote.n") == 0, "delimiter_not_detected").otherwise("")
    )
    upper = F.upper("file_name")
    known = F.get(F.filter(F.array(*map(F.lit, FAMILIES)), lambda f: F.startswith(upper, f)), 0)
    special = F.get(F.filter(folders, lambda f: F.upper(f) == "ASCII"), 0), F.get(F.filter(folders, lambda f: F.upper(f) == "DELETED"), 0)
    cleaned = F.transform(
        F.split("header", F.concat(F.lit("\\Q"), F.col("vote.separator"), F.lit("\\E"))), lambda c: F.regexp_replace(F.trim(c), "^(?:\ufeff|\u00ef\u00bb\u00bf)+", "")
    )
    rows = rows.withColumn("header_issue", issue)
    rows = rows.withColumn("columns", F.when(F.col("header_issue") == "", cleaned).otherwise(F.array().cast("array<string>")))
    return rows.select(
        F.get(folders, 0).cast("int").alias("year"), F.upper(F.get(folders, 1)).alias("quarter"), F.col("below").alias("relative_path"), "file_name",
        F.coalesce(known, F.when(upper.contains("DELETE"), "DELETE"), F.lit("OTHER")).alias("dataset_family"),
        F.coalesce(*special, F.lit("ROOT")).alias("folder_variant"), "size_bytes",
        F.when(F.col("header_issue") == "", F.col("vote.separator")).otherwise("").alias("delimiter"), F.size("columns").alias("column_count"),
        "header_issue", F.array_join(F.transform("columns", F.lower), "|").alias("header_signature"), "columns",
    )


def column_rows(files: DataFrame) -> DataFrame:
    """One row a file and column, in order."""
    each = files.select("year", "quarter", "relative_path", "file_name", "dataset_family", F.posexplode("columns").alias("at", "column_name"))
    return each.select(
        "year", "quarter", "relative_path", "file_name", "dataset_family", (F.col("at") + 1).alias("column_position"), "column_name",
        F.lower("column_name").alias("column_name_normalized"),
    )


def counters(files: DataFrame) -> DataFrame:
    """(counter, value, n_files): files by folder, separator and header issue, and all of them."""
    def kind(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("counter"), value.alias("value"))

    separator = F.when(F.col("delimiter") == "", "UNKNOWN").otherwise(F.col("delimiter"))
    kinds = F.array(
        kind("folder_variant", F.col("folder_variant")), kind("delimiter", separator), F.when(F.col("header_issue") != "", kind("header_issue", F.col("header_issue"))),
        kind("total_files", F.lit("")),
    )
    return files.select(F.inline(F.array_compact(kinds))).groupBy("counter", "value").agg(F.count("*").alias("n_files"))


def variants(files: DataFrame) -> DataFrame:
    """One row a table and header: its columns, first file, years and quarters."""
    rows = files.where("dataset_family != 'OTHER' and column_count > 0")
    return rows.groupBy("dataset_family", "header_signature").agg(
        F.first("column_count").alias("column_count"), F.min("relative_path").alias("example_file"), F.count("*").alias("n_files"),
        F.array_sort(F.collect_set("year")).alias("years"), F.array_sort(F.collect_set(F.concat(F.col("year").cast("string"), "quarter"))).alias("quarters"),
    )


def changes(files: DataFrame) -> DataFrame:
    """One row a table and year: files, header variants, and columns gained and lost against the table's first year."""
    by_year = files.groupBy("dataset_family", "year").agg(
        F.count("*").alias("n_files"), F.collect_set("header_signature").alias("variants"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("columns", F.lower)))).alias("columns"),
    )
    first = by_year.where(F.size("columns") > 0).groupBy("dataset_family").agg(F.min_by("columns", "year").alias("base"))
    return by_year.join(first, "dataset_family").select(
        "dataset_family", "year", "n_files", F.size("variants").alias("n_variants"),
        F.array_sort(F.array_except("columns", "base")).alias("added"), F.array_sort(F.array_except("base", "columns")).alias("removed"),
    )
