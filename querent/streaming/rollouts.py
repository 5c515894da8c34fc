"""Growing logs as streams: running reward figures with expiring state, new ids only, windowed events with late data.

Streams end in file sinks: what a stream has finished is on disk, exactly once, and no table grows in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampType

from querent.sources.records import ROLLOUT


def rollout_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Rollout records of JSON files as they arrive, without error records."""
    return spark.readStream.schema(ROLLOUT).option("maxFilesPerTrigger", files).json(folder).where("error is null")


def running_stats(rollouts: DataFrame) -> DataFrame:
    """Running figures by split: for complete or update mode; the state is one row a split."""
    mean = lambda c: F.avg(c.cast("double"))
    return rollouts.groupBy("split").agg(
        F.count("*").alias("n"), F.avg("reward").alias("mean_reward"), mean(F.col("correct")).alias("strict_acc"), mean(F.col("official")).alias("official_acc"),
        mean((F.col("reward") > 0) & ~F.col("correct")).alias("hack_rate"),
    )


_SUMS = ("n", "reward", "correct", "official", "hack")
_STATE = StructType([StructField("first", TimestampType()), StructField("last", TimestampType()), StructField("n", LongType()), *[StructField(c, DoubleType()) for c in _SUMS[1:]]])


class RewardFigures(StatefulProcessor):
    """Sums of a key's rollouts, given out and forgotten once the watermark is idle seconds past its last rollout."""

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.sums.get() if self.sums.exists() else None
        first, last, sums = (old[0], old[1], [float(x) for x in old[2:]]) if old else (None, None, [0.0] * len(_SUMS))
        for part in rows:
            correct, official = part["correct"].astype(bool), part["official"].astype(bool)
            more = (len(part), part["reward"].sum(), correct.sum(), official.sum(), ((part["reward"] > 0) & ~correct).sum())
            sums = [a + float(b) for a, b in zip(sums, more, strict=True)]
            low, high = part["ts"].min().to_pydatetime(), part["ts"].max().to_pydatetime()
            first, last = (low if first is None else min(first, low)), (high if last is None else max(last, high))
        self.sums.update((first, last, int(sums[0]), *sums[1:]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(round(pd.Timestamp(last).timestamp() * 1000 + 1000 * self.idle)))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, last, n, *sums = self.sums.get()
        self.sums.clear()
        means = {f"{c}_mean": [s / n] for c, s in zip(_SUMS[1:], sums, strict=True)}
        yield pd.DataFrame({"key": [key[0]], "first": [first], "last": [last], "n": [n], **means})

    def close(self) -> None:
        pass


def reward_periods(rollouts: DataFrame, key: str, idle: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """key, first, last, n and means of a key's rollouts (ts, reward, correct, official) up to a pause of idle seconds: append mode.

    State is a row a key and goes with its timer; rollouts before the watermark are dropped. It needs the state
    store that keep_state sets.
    """
    keep_state(rollouts.sparkSession)
    kind = rollouts.schema[key].dataType.simpleString()
    shape = f"key {kind}, first timestamp, last timestamp, n long, " + ", ".join(f"{c}_mean double" for c in _SUMS[1:])
    own = rollouts.select(F.col(key).alias("key"), "ts", "reward", "correct", "official").withWatermark("ts", delay)
    return own.groupBy("key").transformWithStateInPandas(statefulProcessor=RewardFigures(idle), outputStructType=shape, outputMode="Append", timeMode="EventTime")


def keep_state(spark: SparkSession) -> None:
    """State stores on disk, as arbitrary state needs them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_seen(records: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Records whose key wasn't seen before; the state forgets keys older than the watermark."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def event_stream(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A folder of Parquet files of events as a stream."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling or sliding event-time windows; in append mode a window comes once, when the watermark has passed its end, and rows of windows that have are dropped."""
    own = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", delay).groupBy(own, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each user, apart by gap or more; in append mode each once the watermark has passed its end. run_sessions joins those that a late row was let through to."""
    # Spark's sessions also hold rows that are exactly their gap apart, so it is less by the least difference.
    apart = F.session_window("ts", f"{gap} -1 microseconds")
    return events.withWatermark("ts", delay).groupBy(apart, "user_id").agg(F.count("*").alias("n"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All input that is there through the stream, in append mode, into Parquet files under path, and these read; the checkpoint goes on where the run before ended."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_sessions(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All input that is there through a stream of sessions; those that ended, as if each had been made of all its rows at once.

    A row up to a gap behind the watermark is let through, and a session it belongs to may have come already: the row then
    starts another, which is joined to it here. What is joined to a session still in the state hasn't ended.
    """
    ended = run_to_files(stream, path, checkpoint)
    state = stream.sparkSession.read.format("statestore").load(checkpoint).select("value.*")
    # Only where these lie counts.
    still = state.select("session_window", "user_id", F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))
    found = ended.select("session_window", "user_id", "n", F.lit(False).alias("open")).unionByName(still)
    by_start = Window.partitionBy("user_id").orderBy("session_window.start")
    before = F.max("session_window.end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("session_window.start") > before, F.lit(True)).cast("int")
    numbered = found.withColumn("new", new).withColumn("k", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.struct(F.min("session_window.start").alias("start"), F.max("session_window.end").alias("end")).alias("session_window")
    return numbered.groupBy("user_id", "k").agg(whole, F.sum("n").alias("n"), F.max("open").alias("open")).where("not open").select(*ended.columns)


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All input that is there through an aggregate in complete mode; the newest result stands under path as Parquet."""
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
