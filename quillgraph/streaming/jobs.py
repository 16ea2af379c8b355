"""Job status as an event table, and a landing folder as a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, ts: str, *columns: str) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max(F.struct(ts, *columns)).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in (ts, *columns)])


def durations(events: DataFrame, key: str, ts: str, *ties: str) -> DataFrame:
    """Microseconds from the event before of the same key."""
    before = F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(Window.partitionBy(key).orderBy(ts, *ties))
    return events.withColumn("micros", F.unix_micros(F.col(ts).cast("timestamp")) - before)


def run_stream(spark: SparkSession, landing: str, schema: str, checkpoint: str, batch: Callable[[DataFrame, int], None]):
    """Each new file of the landing folder goes through `batch` once; documents need no state across batches."""
    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
