"""The event ledger as a stream: totals by stage, sessions, tails, and a fold of progress per run."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, on one machine a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (known or "file://" + tempfile.mkdtemp(prefix="spark-stream-")).rstrip("/") + "/" + uuid4().hex


def ledger(spark: SparkSession, path: str, name: str = "events") -> DataFrame:
    """Parquet files of the ledger as a stream (new files are new events)."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{path}/{name}*.parquet")


def drained(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and give what it has written.

    In update mode a batch holds only what it has changed: of each ``key`` the row of its newest batch counts.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    else:

        def write(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")

        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    if mode == "append":
        return out
    if mode == "update":
        every = spark.read.parquet(f"{folder}/out")
        newest = every.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
        return newest.select("row.*")
    latest = spark.read.parquet(f"{folder}/out").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{folder}/out/batch={latest}")


def stage_totals(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Items and seconds by stage and window of event time."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("items"), F.sum("value").alias("seconds"))
    return by.select(F.col("window.start").alias("start"), "event_type", "items", "seconds")


def progress(events: DataFrame) -> DataFrame:
    """A fold of each run's events: (user_id, done, last_event) once a batch, state kept between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, last = state.get if state.exists else (0, -1)
        for frame in frames:
            done, last = done + len(frame), max(last, int(frame["event_id"].max()))
        state.update((done, last))
        yield pd.DataFrame({"user_id": [key[0]], "done": [done], "last_event": [last]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, done long, last_event long", "done long, last_event long", "update", GroupStateTimeout.NoTimeout)
