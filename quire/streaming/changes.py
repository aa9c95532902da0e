"""Change events as streams: the same functions take batch and streaming DataFrames where Spark allows it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def ingest(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream, schema given."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def coalesce_changes(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The latest change of each resource (user_id) in each interval, and how many there were; later rows than the watermark go."""
    latest = F.max(F.struct("ts", "event_id", "event_type"))
    out = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "user_id").agg(latest.alias("x"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("since"), "user_id", F.col("x.event_type").alias("event_type"), F.col("x.event_id").alias("event_id"), "n")


def subscribe(events: DataFrame, names: list[str], own: int | None = None) -> DataFrame:
    """Chosen event names; events of one's own origin are hidden, if one is given."""
    out = events.where(F.col("event_type").isin(names))
    return out if own is None else out.where(F.col("user_id") != own)


def revisions(events: DataFrame) -> DataFrame:
    """Batch: the events of each resource numbered in order of time."""
    return events.withColumn("revision", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


def stream_revisions(events: DataFrame) -> DataFrame:
    """Stream: a counter for each resource in keyed state, without waiting: in order of time within a micro-batch only, see ``ordered_revisions``."""

    def count(key, frames, state):
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        state.update((n + len(rows),))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "revision": range(n + 1, n + len(rows) + 1)})

    return events.groupBy("user_id").applyInPandasWithState(count, "event_id long, user_id long, revision long", "n long", "append", "NoTimeout")


class Numbering(StatefulProcessor):
    """Numbers the events of a key in order of time, over all micro-batches: each waits until the watermark has passed it.

    The state of a key is a counter and the events between the watermark and the latest, so late that none can come before them. A timer at the earliest one
    that waits calls; batches are appended piece by piece.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.waiting = handle.getListState("waiting", "us long, event_id long")

    def handleInputRows(self, key, rows, timerValues):
        passed, first = 1000 * timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            frame = frame[frame["us"] > passed]
            if len(frame):
                self.waiting.appendList([(int(u), int(e)) for u, e in zip(frame["us"], frame["event_id"], strict=True)])
                low = int(frame["us"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        every = list(self.waiting.get()) if self.waiting.exists() else []
        ready, later = sorted(x for x in every if x[0] <= passed), [x for x in every if x[0] > passed]
        if ready:
            n = self.count.get()[0] if self.count.exists() else 0
            self.count.update((n + len(ready),))
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(-(-min(later)[0] // 1000))
            else:
                self.waiting.clear()
            yield pd.DataFrame({"event_id": [e for _, e in ready], "user_id": key[0], "revision": range(n + 1, n + len(ready) + 1)})

    def close(self) -> None:
        pass


def ordered_revisions(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Stream: event_id, user_id, revision; the events of each resource numbered in order of time and event_id, across micro-batches.

    An event comes out when the watermark, ``late`` behind the latest event, has passed it; rows that arrive later than that go. What has come out equals
    ``revisions`` of the rows that came in time. Rows without a time, resource or id are left out. Start it under ``state_store``.
    """
    rows = events.where("ts is not null and user_id is not null and event_id is not null").select("ts", "user_id", "event_id", F.unix_micros(F.col("ts")).alias("us")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Numbering(), "event_id long, user_id long, revision long", "append", "eventtime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session's streams keep state in RocksDB, beyond the executors' heap; as before afterwards."""
    key, value = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Editing sessions: events of a resource with no longer gap between them."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), "user_id", "n")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it gave, from a table in memory (for tests and small reports)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
