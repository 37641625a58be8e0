"""Incremental ingest and windowed counts on streams; each has a batch twin that tests compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinolake.operators.tables import Store, last_by_key, only_new
from kinolake.session import cut_lineage


def stream_parquet(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def incremental_ingest(stream: DataFrame, store: Store, name: str, key: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Adds rows with unseen keys to a stored table, batch by batch.

    Within a batch the row with the greatest content counts. New rows are appended; stored
    ones are read for their keys only. A batch that runs again after
    a failure adds nothing twice, since its keys are known by then.
    """

    def run(batch: DataFrame, _: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows = last_by_key(rows.filter(F.col(key).isNotNull()), key, [c for c in rows.columns if c != key])
        fresh = cut_lineage(only_new(rows, store.read(name, rows.schema), key))
        if not fresh.isEmpty():
            store.append(name, fresh)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_event_time(events: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Event time as TIMESTAMP (watermarks need it) with a watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling_counts(events: DataFrame, column: str = "ts", width: str = "1 day", kind: str = "event_type") -> DataFrame:
    """``window_start, event_type, n, total`` for batch or stream."""
    one = events.groupBy(F.window(F.col(column).cast("timestamp") if not events.isStreaming else F.col(column), width).alias("w"), kind)
    return one.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, column: str = "ts", user: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """``user_id, session_start, session_end, n``."""
    time = F.col(column).cast("timestamp") if not events.isStreaming else F.col(column)
    one = events.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return one.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once within the watermark on a stream, once at all in batch."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def unanswered(questions: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Questions that have no answer yet; blank answers count as none."""
    return questions.join(answers.filter(F.trim(F.coalesce("answer", F.lit(""))) != "").select(*key), key, "left_anti")
