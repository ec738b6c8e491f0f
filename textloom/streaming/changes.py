"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.relations import delta


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "20 minutes", time_col: str = "ts", by: str = "event_type") -> DataFrame:
    """Events per window and kind; later events than the watermark allows are dropped. Works on streams and on tables."""
    rows = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time_col, late)
    out = rows.groupBy(F.window(time_col, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def apply_snapshots(stream: DataFrame, target: str, key: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is a snapshot: its difference to the last one is appended to ``target`` (Parquet: key, change, batch).

    The snapshot itself is kept beside it, in ``<target>-last/<batch>``; a batch
    that is run again writes the same folders again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            last = spark.read.schema(rows.schema).parquet(f"{target}-last/batch={number - 1}") if number else rows.limit(0)
            delta(last, rows, key).write.mode("overwrite").parquet(f"{target}/batch={number}")
            rows.write.mode("overwrite").parquet(f"{target}-last/batch={number}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def newest_stream(stream: DataFrame, key: str, version: str, payload: list[str], late: str = "1 hour") -> DataFrame:
    """The newest payload of each key so far (complete or update mode)."""
    rows = stream.withColumn(version, F.col(version).cast("timestamp"))
    rows = rows.withWatermark(version, late) if stream.isStreaming else rows
    return rows.groupBy(key).agg(F.max_by(F.struct(*payload), version).alias("p")).select(key, "p.*")
