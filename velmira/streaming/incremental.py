"""Incremental processing: only what is new, sessions over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform=lambda df: df, file_format: str = "parquet"):
    """Process the files that arrived since the last call, once each, and stop; returns the finished query."""
    stream = transform(spark.readStream.schema(schema).format(file_format).load(source))
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sessions(events: DataFrame, by: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event counts per session; works on tables and streams (with a watermark)."""
    return events.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def record_progress(spark: SparkSession, table: str, step: str, stats: dict[str, float], error: str | None = None) -> None:
    """Append what a step did to the progress table at ``table``; every call adds rows, none is rewritten."""
    rows = [(step, name, float(value), error) for name, value in stats.items()] or [(step, None, None, error)]
    spark.createDataFrame(rows, "step string, name string, value double, error string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(table)


def progress(spark: SparkSession, table: str) -> DataFrame:
    """``step, name, value, n_errors, at``: the last value of each figure of each step."""
    rows = spark.read.parquet(table)
    return rows.groupBy("step", "name").agg(F.max_by("value", "at").alias("value"), F.count("error").alias("n_errors"), F.max("at").alias("at"))


def finished_steps(spark: SparkSession, table: str) -> list[str]:
    """Steps that a resumed run may skip: those whose last entry has no error (one row per step, a handful)."""
    last = spark.read.parquet(table).groupBy("step").agg(F.max_by(F.coalesce("error", F.lit("")), "at").alias("error"))
    return sorted(r.step for r in last.where("error = ''").select("step").limit(10_000).collect())


def first_seen(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark; on a stream the keys seen are kept as state that the watermark
    bounds, on a table it is one row per key."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.groupBy(key).agg(F.min(ts).alias(ts))
