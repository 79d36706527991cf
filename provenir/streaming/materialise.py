"""Materialising items from a stream of attempts: retried for some failures, three times at most, until a deadline."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import shared_folder

#: Failures that are tried again, and how often an item is tried in all.
RETRYABLE, MOST = ("empty", "parse-error"), 3
#: The store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _columns(id_type: str) -> str:
    return f"item {id_type}, attempts int, outcome string, at timestamp"


class Attempts(StatefulProcessor):
    """One item: its attempts so far, when it must have been tried again, and whether it is closed."""

    def __init__(self, wait: timedelta):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "attempts int, due_ms long, closed boolean")

    def _now(self) -> tuple[int, int, bool]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, False)

    def _row(self, key: tuple, attempts: int, outcome: str, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"item": [key[0]], "attempts": [attempts], "outcome": [outcome], "at": [datetime.fromtimestamp(ms / 1000, timezone.utc)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, due, closed = self._now()
        if closed:
            return
        before, out = due, None
        tried = pd.concat(list(rows)).sort_values(["ms", "attempt_id"], kind="stable")
        for ms, kind in zip(tried["ms"].tolist(), tried["kind"].tolist()):
            if attempts and ms > due:
                out = self._row(key, attempts, "expired", due)
                break
            attempts, due = attempts + 1, ms + int(self.wait.total_seconds() * 1000)
            if kind not in RETRYABLE or attempts == MOST:
                out = self._row(key, attempts, f"gave up: {kind}" if kind in RETRYABLE else kind, ms)
                break
        if before:
            self.handle.deleteTimer(before)
        self.state.update((attempts, due, out is not None))
        if out is None:
            self.handle.registerTimer(due)
        else:
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, due, closed = self._now()
        if not closed and due:
            self.state.update((attempts, due, True))
            yield self._row(key, attempts, "expired", due)

    def close(self) -> None:
        pass


def materialised(attempts: DataFrame, wait: timedelta, late: str = "0 seconds") -> DataFrame:
    """(item, attempts, outcome, at) of every item once it is closed.

    ``attempts`` is a stream of (item, attempt_id, ts, kind). An attempt whose kind is no failure
    that is tried again closes its item with that kind; so does the third failure (``gave up``), and
    the deadline after a failure, in event time (``expired``). What comes for a closed item changes
    nothing. Attempts count in the order of time, then id; those later than ``late`` are dropped.
    An item's state is three numbers.
    """
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    d = attempts.where("item is not null").withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return d.groupBy("item").transformWithStateInPandas(Attempts(wait), _columns(attempts.schema["item"].dataType.simpleString()), "Append", "EventTime")


def in_batches(spark: SparkSession, parts: list[DataFrame], wait: timedelta) -> DataFrame:
    """What comes of attempts that arrive part by part: each part is written and the stream run over what is new."""
    folder = shared_folder(spark)
    known = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
            q = materialised(stream, wait).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", known)
    return spark.read.schema(_columns(parts[0].schema["item"].dataType.simpleString())).parquet(f"{folder}/out")
