"""The same machines and change detection on streams, and windows over event time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; times without one are taken as UTC by the session."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def changes(progress: DataFrame, *, key: str, columns: list[str], order: str) -> DataFrame:
    """Emits a key's row when its ``columns`` differ from the last emitted, until a final ``status``."""
    schema = progress.schema[key].dataType.simpleString()
    out = f"{key} {schema}, snapshot string"

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done = state.get if state.exists else (None, False)
        found = []
        for frame in frames:
            for row in frame.sort_values(order)[columns].to_dict("records"):
                text = json.dumps(row, ensure_ascii=False, default=str, sort_keys=True)
                if not done and text != last:
                    found.append((keys[0], text))
                    last, done = text, row.get("status") in ("completed", "failed", "cancelled")
        state.update((last, done))
        yield pd.DataFrame(found, columns=[key, "snapshot"])

    return progress.groupBy(key).applyInPandasWithState(step, out, "last string, done boolean", "append", GroupStateTimeout.NoTimeout)


def limited(calls: DataFrame, *, key: str, time: str, id_col: str, most: int, window: float) -> DataFrame:
    """Sliding-window limit per key; state is the times of the calls allowed last, ``most`` at most."""
    kinds = dict(calls.dtypes)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        out = []
        for frame in frames:
            for now, name in frame.sort_values([time, id_col])[[time, id_col]].itertuples(index=False):
                seen = [t for t in seen if t > now - window]
                if allowed := len(seen) < most:
                    seen.append(float(now))
                out.append((keys[0], name, allowed))
        state.update((seen,))
        yield pd.DataFrame(out, columns=[key, id_col, "allowed"])

    return calls.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, allowed boolean", "seen array<double>", "append", GroupStateTimeout.NoTimeout)


def first_of_key(calls: DataFrame, *, key: str, time: str, ttl: str = "1 hour") -> DataFrame:
    """The first call of a key in a time to live; later ones are dropped, and state goes with the watermark."""
    return event_time(calls, time).withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, *, time: str, size: str, late: str, by: list[str]) -> DataFrame:
    own = event_time(events, time).withWatermark(time, late)
    return own.groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, *, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    own = event_time(events, time).withWatermark(time, late)
    return own.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def drain(df: DataFrame, name: str, *, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now into a table in memory; for tests and small results."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
