"""Digest windows as a stream: a timer per mailbox and window, and late mail as rows of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mailframe import fixed
from mailframe.functions.timing import next_week_start, week_start

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
# A window of one mailbox is counted in so many parts, so that a hot mailbox is no single task.
SHARDS = 16
_KEY = ["mailbox", "start_us", "end_us", "shard"]
_OUT = "kind string, mailbox string, start_us long, end_us long, uid_validity long, uid long, email_count long"


class _WindowCounter(StatefulProcessor):
    """Counts the mail of one part of a window until the watermark passes the window's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mailbox, start_us, end_us, _ = key
        closed = timerValues.getCurrentWatermarkInMs() * 1000 >= end_us
        n = 0
        for frame in rows:
            in_time = (frame["processed_us"] <= end_us) & (not closed)
            n += int(in_time.sum())
            late = frame[~in_time]
            if len(late):
                yield _rows("late", mailbox, start_us, end_us, late["uid_validity"].tolist(), late["uid"].tolist(), None)
        if n:
            if self.count.exists():
                n += self.count.get()[0]
            else:
                self.handle.registerTimer(end_us // 1000)
            self.count.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mailbox, start_us, end_us, _ = key
        yield _rows("digest", mailbox, start_us, end_us, [None], [None], self.count.get()[0])
        self.count.clear()

    def close(self) -> None:
        pass


def _rows(kind: str, mailbox: str, start: int, end: int, epochs: list, uids: list, count: int | None) -> pd.DataFrame:
    n = len(uids)
    frame = pd.DataFrame({"kind": [kind] * n, "mailbox": [mailbox] * n, "start_us": [start] * n, "end_us": [end] * n})
    for name, values in (("uid_validity", epochs), ("uid", uids), ("email_count", [count] * n)):
        frame[name] = pd.array(values, dtype="Int64")
    return frame


def digest_stream(
    messages: DataFrame, delay: str, zone: str = fixed.DEFAULT_ZONE, shards: int = SHARDS
) -> DataFrame:
    """(kind, mailbox, window_start, window_end, uid_validity, uid, email_count) of a stream of messages.

    A message belongs to the weekly window of its ``received_at``. The clock of the stream is
    ``processed_at``: when everything processed up to ``delay`` before the newest message is
    taken as seen, a window that ended before then is closed, and its parts give ``digest`` rows
    whose ``email_count`` add up. A message processed after its window's end, or arriving once
    the window is closed, gives a ``late`` row: no message is lost, whatever order files come in.
    """
    clock = messages.select(
        "mailbox", "uid_validity", "uid", F.col("received_at").cast("timestamp").alias("received_at"),
        F.col("processed_at").cast("timestamp").alias("processed_at"),
    ).withWatermark("processed_at", delay)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    # Times go on as numbers. Without its clock column a row cannot be dropped for being late.
    placed = clock.select(
        "mailbox", "uid_validity", "uid",
        micros(week_start("received_at", zone)).alias("start_us"), micros(next_week_start("received_at", zone)).alias("end_us"),
        micros(F.col("processed_at")).alias("processed_us"), F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"),
    )
    counted = placed.groupBy(*_KEY).transformWithStateInPandas(
        statefulProcessor=_WindowCounter(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )
    return counted.select(
        "kind", "mailbox", F.timestamp_micros("start_us").alias("window_start"), F.timestamp_micros("end_us").alias("window_end"),
        "uid_validity", "uid", "email_count",
    )


def write_digests(
    digests: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, partitions: int | None = None
) -> StreamingQuery:
    """Append the rows of ``digest_stream`` to Parquet files; a batch that runs again adds nothing.

    ``partitions`` is how many parts the state has, for the life of the checkpoint; the session's
    number of shuffle partitions unless given.
    """
    spark = digests.sparkSession
    # Timers need this state store. A query keeps the settings that it started with.
    wanted = {PROVIDER: ROCKSDB, PARTITIONS: str(partitions or spark.conf.get(PARTITIONS))}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return (
            digests.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def window_totals(written: DataFrame) -> DataFrame:
    """Per mailbox and window: ``email_count`` of its digest so far and ``late_count``."""
    late: Column = F.count(F.when(F.col("kind") == "late", 1))
    return written.groupBy("mailbox", "window_start", "window_end").agg(
        F.coalesce(F.sum("email_count"), F.lit(0)).alias("email_count"), late.alias("late_count")
    )
