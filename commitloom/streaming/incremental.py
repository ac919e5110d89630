"""Incremental refresh as a stream: new files of records are merged into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import fresh, row_hash


def stream_records(spark: SparkSession, folder: str, schema: str, at: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """Rows of Parquet files as they arrive, late by at most ``delay``."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def arrivals(stream: DataFrame, key: str, at: str = "ingested_at", window: str = "30 days") -> DataFrame:
    """Rows per window of arrival and key."""
    return stream.groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("rows"))


def merge_new(stream: DataFrame, table: str, key: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Appends rows whose key the table does not have yet, batch by batch (what was there wins).

    Of several rows of a key in one batch the one with the greatest ``order``
    counts, ties (and all of them without ``order``) by a hash of the row.
    """

    def add(batch: DataFrame, _epoch: int) -> None:
        # the row_number of 1 is kept in each map task before the shuffle
        by = [F.col(order).desc_nulls_last()] if order else []
        rank = fresh(batch.columns, "_rank")
        new = batch.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*by, row_hash(batch)))).filter(F.col(rank) == 1).drop(rank)
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(table).select(key)
            new = new.join(known, key, "left_anti")
        except Exception as e:  # noqa: BLE001 - no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
