"""The event fold as a stream."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexline.operators.chat import fold_events, kept_events

#: Setting, and the value it needs, for state with timers.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MILLISECONDS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def fold_stream(
    events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> DataStreamWriter:
    """Writer that hands each batch's changed conversations to ``sink(df, batch_id)``.

    State is one row per conversation, held by the state store for as long as the checkpoint lasts; for
    conversations without end see ``fold_stream_with_expiry``. The sink gets whole replies, so it may
    write them over what it has; a batch that is run again gives the same rows.
    """
    return (
        fold_events(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
    )


def milliseconds(duration: str) -> int:
    """Of a duration such as ``10 minutes``."""
    found = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", duration)
    if not found:
        raise ValueError(f"not a duration in seconds, minutes, hours or days: {duration}")
    return int(found[1]) * _MILLISECONDS[found[2]]


def require_timers(spark: SparkSession) -> None:
    if spark.conf.get(STATE_STORE, "") != ROCKS_DB:
        raise ValueError(f"set {STATE_STORE} to {ROCKS_DB}")


class LastReply(StatefulProcessor):
    """Keeps the last reply of a conversation until ``idle`` milliseconds of event time after its newest
    event, when its state goes."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, content string, agent string, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        seq, content, agent, until = held if held is not None else (None, None, None, 0)
        before = until
        for row in rows:
            until = max(until, row["at"] + self.idle)
            if seq is None or row["seq"] >= seq:
                seq, content, agent = row["seq"], row["content"], row["agent"]
        if until != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        self.last.update((seq, content, agent, until))
        yield Row(conv_id=key[0], content=content, agent=agent, closed=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, content, agent, _ = self.last.get()
        self.last.clear()
        yield Row(conv_id=key[0], content=content, agent=agent, closed=True)

    def close(self) -> None:
        pass


def fold_with_expiry(events: DataFrame, idle: str = "1 hour", lateness: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(conv_id, content, agent, closed) of a stream of step events with an event time ``ts``.

    A row comes whenever a conversation's reply may have changed, and a last one, ``closed``, when the
    watermark has passed ``idle`` after its newest reply; its state is gone then, so state is bounded by
    the conversations of that span. A reply that comes afterwards opens the conversation anew, whatever
    its ``seq``. Events later than ``lateness`` are dropped.
    """
    require_timers(events.sparkSession)
    kept = kept_events(events, ts).withWatermark(ts, lateness)
    rows = kept.withColumn("at", F.unix_millis(F.col(ts).cast("timestamp"))).withColumn("seq", F.col("seq").cast("long"))
    key = events.schema["conv_id"].dataType.simpleString()
    return rows.groupBy("conv_id").transformWithState(
        statefulProcessor=LastReply(milliseconds(idle)),
        outputStructType=f"conv_id {key}, content string, agent string, closed boolean",
        outputMode="Update",
        timeMode="EventTime",
    )
