"""Streams that keep little: drafts saved after a silence, and counts that follow each change.

State lies in RocksDB (``with_timers`` sets it for a session's streams) and in the folder of the checkpoint, so a lost executor or a
restart goes on from the last batch.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanforge.sources import shared
from spanforge.streaming.machines import event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def with_timers(spark: SparkSession):
    """Streams started inside keep their state where timers work."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Debounce(StatefulProcessor):
    """Holds a key's drafts until the watermark is ``silence`` behind them, which is when no earlier or nearer one can come."""

    def __init__(self, key: str, silence: int):
        self.key, self.silence = key, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, place long, draft string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        # By their places: the engine gives the columns names of its own.
        new = [row for frame in rows for row in frame.iloc[:, -3:].itertuples(index=False, name=None) if row[0] > mark]
        if new:
            self.waiting.appendList([(int(at), int(place), draft) for at, place, draft in new])
            for at in {-(-(row[0] + self.silence) // 1000) for row in new}:
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(tuple, self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        done = sum(row[0] + self.silence <= mark for row in rows)
        saved = [(key[0], *row) for row, then in zip(rows[:done], [*rows[1:], None]) if then is None or then[0] - row[0] >= self.silence]
        if done == len(rows):
            self.waiting.clear()
        elif done:
            self.waiting.put(rows[done:])
        if saved:
            yield pd.DataFrame(saved, columns=[self.key, "_at", "_place", "_draft"])

    def close(self) -> None:
        pass


def saved_after_silence(drafts: DataFrame, *, key: str, time: str, place: str, draft: str, silence: str = "900 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The drafts of each key that no other follows within ``silence``, each once: (key, time, place, draft).  Of drafts at one
    time the last place counts.  Rows later than ``late`` are dropped; a key holds what came within ``late`` and ``silence``, and
    nothing after that.  Start it inside ``with_timers``."""
    kind = drafts.schema[key].dataType
    micros = int(pd.Timedelta(silence).total_seconds() * 1_000_000)
    rows = event_time(drafts, time).withWatermark(time, late)
    rows = rows.select(key, time, F.unix_micros(time).alias("_at"), F.col(place).cast("long").alias("_place"), F.col(draft).cast("string").alias("_draft"))
    out = T.StructType([T.StructField(key, kind), T.StructField("_at", T.LongType()), T.StructField("_place", T.LongType()), T.StructField("_draft", T.StringType())])
    found = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Debounce(key, micros), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.select(key, F.timestamp_micros("_at").alias(time), F.col("_place").alias(place), F.col("_draft").alias(draft))


def count_changes(changes: DataFrame, *, job: str, old: str, new: str) -> DataFrame:
    """(job, status, delta): one less for the state an item leaves (none: null), one more for the one it takes."""
    steps = F.array(F.struct(F.col(old).alias("status"), F.lit(-1).alias("delta")), F.struct(F.col(new).alias("status"), F.lit(1).alias("delta")))
    return changes.select(job, F.inline(steps)).where("status is not null")


def live_counts(changes: DataFrame, *, job: str, old: str, new: str) -> DataFrame:
    """How many items of each job are in each state; a stream of it in update mode gives the counts that a batch changed.  State is
    a number per job and state, however many items there are and however often they change."""
    return count_changes(changes, job=job, old=old, new=new).groupBy(job, "status").agg(F.sum("delta").cast("long").alias("n"))


def run_to_table(stream: DataFrame, path: str, *, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table of files at ``path`` and reads it; progress is kept beside it."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_upserted(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Runs a stream of updates into a table with the newest row of each key: a version of it per batch that changes anything.

    A batch that runs again writes its own version again, from the version before it, so each counts once.
    """
    spark = stream.sparkSession

    def newer(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(stream.schema).parquet(f"{path}/version-{number - 1}") if number else batch.limit(0)
        kept = before.join(batch.select(*keys), keys, "left_anti")
        kept.unionByName(batch).write.mode("overwrite").parquet(f"{path}/version-{number}")
        if number > 1:
            shared.drop(spark, f"{path}/version-{number - 2}")

    query = stream.writeStream.foreachBatch(newer).option("checkpointLocation", f"{path}/progress").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    return spark.read.schema(stream.schema).parquet(f"{path}/version-{last['batchId'] if isinstance(last, dict) else last.batchId}")
