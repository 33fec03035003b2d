"""Keeps a partitioned dataset up to date from a folder in which quarterly Parquet files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import write_dataset


def follow_quarters(spark: SparkSession, arriving: str, schema, folder: str, name: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the (year, quarter) partitions it holds, so a repeated batch changes nothing."""

    def store(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write_dataset(batch, folder, name)

    stream = spark.readStream.schema(schema).parquet(arriving)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
