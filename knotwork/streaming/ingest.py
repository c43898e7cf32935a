"""Streaming ingest: versions of vertices from a stream of events, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knotwork.operators.temporal import FOREVER


def versions(events: DataFrame, vid: Column, moment: Column, columns: dict[str, Column]) -> DataFrame:
    """events as versions: vid, columns, valid_from = tx = moment, valid for ever, not deleted."""
    return events.select(vid.alias("vid"), *[c.alias(n) for n, c in columns.items()], moment.cast("long").alias("valid_from"), F.lit(FOREVER).cast("long").alias("valid_to"), moment.cast("long").alias("tx"), F.lit(False).alias("deleted"))


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of versions to a folder; a batch that is repeated after a failure replaces its own files."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).drop("batch")
