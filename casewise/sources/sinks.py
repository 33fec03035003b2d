"""Where results go: partitioned Parquet, CSV with a byte-order mark, JSON, Markdown, run folders."""

from __future__ import annotations

import contextlib
import hashlib
import json
import tempfile
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import store

RESULT_ROWS = 100_000  # result tables go through the driver; larger ones belong in Parquet


def write_dataset(df: DataFrame, folder: str, name: str) -> str:
    """A relation partitioned by year and quarter; only the partitions at hand are replaced."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter").parquet(path)
    return path


def read_dataset(spark: SparkSession, folder: str, name: str, year: int | None = None) -> DataFrame:
    """All quarters by column name, or one year by partition pruning."""
    df = spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}")
    return df if year is None else df.where(df["year"] == year)


def bucket_count(spark: SparkSession, folder: str, wanted: int | None = None) -> int:
    """Buckets of the relations below ``folder``: as many as the session's shuffle partitions when the first one is written there.

    They stay as they are, since joins without an exchange need equal counts.
    """
    kept = f"{folder}/buckets"
    if not store.exists(spark, kept):
        store.write_line(spark, kept, str(wanted or spark.conf.get("spark.sql.shuffle.partitions")))
    return int(store.first_line(spark, kept))


def _bucketed(spark: SparkSession, folder: str, name: str, schema: StructType) -> str:
    """The catalog's name of a relation by year and quarter whose rows are dealt to buckets by case id; files belong to ``folder``."""
    table = f"casewise_{name}_{hashlib.sha256(f'{folder}|{schema.simpleString()}'.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(table):
        parts = ("year", "quarter")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*(f for f in schema if f.name not in parts), *(schema[p] for p in parts)])
        n = bucket_count(spark, folder)
        spark.sql(f"create table {table} ({columns}) using parquet partitioned by (year, quarter) clustered by (caseid) sorted by (caseid) into {n} buckets location '{folder}/{name}'")
    return table


def write_bucketed(df: DataFrame, folder: str, name: str) -> str:
    """A relation partitioned by year and quarter and bucketed by case id; only the partitions at hand are replaced."""
    spark, key = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    table = _bucketed(spark, folder, name, df.schema)
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        df.repartition(bucket_count(spark, folder), "caseid").select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(key, before)
    return f"{folder}/{name}"


def read_bucketed(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A relation as ``write_bucketed`` left it: joins on the case id with another one need no exchange.

    Its files tell the schema unless it is given, as for a relation that may have no rows yet.
    """
    schema = schema or spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}").schema
    table = _bucketed(spark, folder, name, schema)
    if store.exists(spark, f"{folder}/{name}"):
        spark.sql(f"alter table {table} recover partitions")  # the catalog keeps them, and others may have written some
    spark.catalog.refreshTable(table)
    return spark.table(table)


@contextlib.contextmanager
def joined_by_bucket(spark: SparkSession):
    """While relations are joined on the case id and more: buckets by case id alone are enough, and small sides are not sent round."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write_csv(df: DataFrame, path: str | Path) -> None:
    """A small result table as one file that spreadsheet programs read as UTF-8."""
    frame = df.limit(RESULT_ROWS + 1).toPandas()
    if len(frame) > RESULT_ROWS:
        raise ValueError(f"more than {RESULT_ROWS} rows: write Parquet instead")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    frame.to_csv(path, index=False, encoding="utf-8-sig")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_json(values: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(values, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def write_text(text: str, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only if it is unset and Spark runs in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="casewise-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, for what several plans or passes read; later reads cost no joins."""
    path = f"{shared_folder(df.sparkSession)}/casewise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_folder(root: str | Path, name: str) -> Path:
    path = Path(root) / f"{name}_{datetime.now():%Y%m%d_%H%M%S}"
    path.mkdir(parents=True, exist_ok=True)
    return path


def dataset_pairs(folder: str | Path, left: str = "signal", right: str = "feature") -> dict[str, tuple[str, str]]:
    """period token -> (signal path, feature path) for tokens that both have, like signal_dataset_2004_2025."""
    paths = {side: {p.stem.rpartition("dataset_")[2]: str(p) for p in Path(folder).glob(f"{side}_dataset_*")} for side in (left, right)}
    return {t: (paths[left][t], paths[right][t]) for t in sorted(paths[left].keys() & paths[right].keys())}


def one_pair(folder: str | Path, token: str | None = None, widest: bool = False) -> tuple[str, str]:
    """The pair of a token; without a token the only one, or with ``widest`` the one that spans most years."""
    pairs = dataset_pairs(folder)
    if token:
        return pairs[token]
    if not pairs:
        raise FileNotFoundError(f"no pair of datasets in {folder}")
    if len(pairs) > 1 and not widest:
        raise ValueError(f"several periods, give a token: {sorted(pairs)}")

    def span(t: str) -> int:
        years = [int(y) for y in t.split("_") if y.isdigit() and len(y) == 4]
        return max(years) - min(years) if years else -1

    return pairs[max(pairs, key=lambda t: (span(t), t))]
