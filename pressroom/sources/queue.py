"""Message queue as files of JSON envelopes, one per line, and the delay before a message comes again."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import ENVELOPE

MAX_RECEIVES = 5  # fixed value: receives before a message is set aside
REDELIVERY_SECONDS = 900  # fixed value: time a failed message stays out of sight
HELD = "message_id string, body string, receives int, sent_at timestamp, due timestamp"


def envelopes(lines: DataFrame, column: str = "value") -> DataFrame:
    """All records of each envelope: message_id, body, receives, sent_at."""
    records = F.explode_outer(F.from_json(column, T.StructType.fromDDL(ENVELOPE))["Records"])
    r = lines.select(F.col(column).alias("_line"), records.alias("r"))
    fallback = F.concat(F.lit("bad-"), F.md5("_line"))  # an unreadable envelope keeps an identity
    return r.select(
        F.coalesce("r.messageId", fallback).alias("message_id"), F.coalesce("r.body", "_line").alias("body"),
        F.coalesce(F.expr("try_cast(r.attributes.ApproximateReceiveCount as int)"), F.lit(1)).alias("receives"),
        F.timestamp_millis(F.coalesce(F.expr("try_cast(r.attributes.SentTimestamp as bigint)"), F.lit(0))).alias("sent_at"))


def read_queue(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of messages from a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch) \
        .option("recursiveFileLookup", True).text(path)
    return envelopes(lines)


def as_envelopes(messages: DataFrame) -> DataFrame:
    """Envelope lines to put (back) on a queue, one record each."""
    record = F.struct(F.col("message_id").alias("messageId"), "body", F.struct(
        F.col("receives").cast("string").alias("ApproximateReceiveCount"),
        F.unix_millis("sent_at").cast("string").alias("SentTimestamp")).alias("attributes"))
    return messages.select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("value"))


def send(messages: DataFrame, queue: str, batch: str) -> None:
    """Put messages on a queue. Delivery is at least once: a replayed batch replaces its own folder."""
    as_envelopes(messages).write.mode("overwrite").text(f"{queue}/{batch}")


def hold(messages: DataFrame, held: str, batch: str, delay: float = REDELIVERY_SECONDS, failed_at: Column | None = None) -> None:
    """Set failed messages aside until ``delay`` seconds after they failed; see ``redeliver``."""
    at = F.current_timestamp() if failed_at is None else failed_at
    due = F.timestamp_millis(F.unix_millis(at) + F.lit(round(delay * 1000)))
    messages.select("message_id", "body", F.col("receives").cast("int").alias("receives"), "sent_at", due.alias("due")) \
        .write.mode("overwrite").parquet(f"{held}/{batch}")


def _wait(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep one message until its time. Of copies the one received most often counts."""
    best: Any = state.get if state.exists else None
    for batch in batches:
        for row in zip(batch["body"], batch["receives"], batch["sent_ms"], batch["due_ms"], strict=True):
            row = (row[0], *map(int, row[1:]))
            best = row if best is None else max(best, row, key=lambda r: (r[1], r[3], r[2], r[0]))
    left = best[3] - state.getCurrentProcessingTimeMs()
    if left > 0:
        state.update(best)
        state.setTimeoutDuration(left)
    else:
        if state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *best[:3])], columns=["message_id", "body", "receives", "sent_ms"])


def redeliver(spark: SparkSession, held: str, queue: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Put held messages back on the queue once they are due.

    Only failed messages pass here. Each waits in state of its own under a processing-time timer, so the wait
    survives a restart and needs no further message to end. ``every`` is the pace at which timers are looked
    at; with None what is due now is released and the query ends (a job run from time to time).
    """
    # a restarted query looks at its timers only from its first batch on, and an empty file is enough for one
    spark.createDataFrame([], HELD).write.mode("overwrite").parquet(f"{held}/start")
    kind = "body string, receives int, sent_ms long, due_ms long"
    messages = spark.readStream.schema(HELD).option("recursiveFileLookup", True).parquet(held).select(
        "message_id", "body", "receives", F.unix_millis("sent_at").alias("sent_ms"), F.unix_millis("due").alias("due_ms"))
    due = messages.groupBy("message_id").applyInPandasWithState(
        _wait, "message_id string, body string, receives int, sent_ms long", kind, "append", GroupStateTimeout.ProcessingTimeTimeout)

    def release(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            send(batch.withColumn("sent_at", F.timestamp_millis("sent_ms")), queue, f"again-{batch_id}")

    writer = due.writeStream.foreachBatch(release).option("checkpointLocation", checkpoint)
    # timers make a stream that never runs dry, so "all that is available" would not end: one batch is a run
    return (writer.trigger(once=True) if every is None else writer.trigger(processingTime=every)).start()
