"""Incremental loading: new files as a stream, upserts by batch, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dokuma.operators.stored import StoredTable


def file_stream(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    """Parquet files as they arrive, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def upsert_stream(rows: DataFrame, table: str, keys: list[str], checkpoint: str, order: str, slices: int = 64, keep: int = 8) -> StreamingQuery:
    """Keep the newest row, by ``order``, of every key in a ``StoredTable``: late rows do not replace newer ones. A batch is a
    merge that bears its number, so a batch that runs twice changes the table once; of old versions ``keep`` stay."""
    stored = StoredTable(rows.sparkSession, table)

    def put(batch: DataFrame, number: int) -> None:
        if stored.manifest() is None:
            stored.create(batch.limit(0), keys, slices=slices)
        stored.merge(batch, order=order, newest=True, mark=f"{checkpoint}#{number}")
        stored.vacuum(keep)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, schema) -> DataFrame:
    """The rows of the last version, or none where there is no table yet."""
    stored = StoredTable(spark, table)
    return spark.createDataFrame([], schema) if stored.manifest() is None else stored.read()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; on a stream, windows close ``late`` after their end."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
