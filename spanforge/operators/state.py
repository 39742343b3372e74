"""Machines with a state per key, over ordered calls: limits, caches, locks, breakers.

A call's outcome depends on the outcomes before it, so a key's calls are read in order by one fold.  The calls of a partition
come sorted and stream through; only the current key's state is held, so a frequent key needs time but no memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Machine = Callable[[], Callable[..., Any]]


def fold(calls: DataFrame, machine: Machine, *, key: str, time: str, id_col: str, inputs: list[str], out: str) -> DataFrame:
    """``id_col``, ``key`` and what the key's machine answers (``out``: name and type) to its calls in order of time, then id."""
    name, kind = out.split()
    arrow = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, answer = object(), None
        for batch in batches:
            said = []
            for own, *values in zip(*(batch.column(c).to_pylist() for c in (key, time, *inputs))):
                if answer is None or own != last:
                    last, answer = own, machine()
                said.append(answer(*values))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(key), pa.array(said, arrow)], [id_col, key, name])

    rows = calls.select(id_col, key, F.col(time).cast("double").alias(time), *inputs).repartition(key).sortWithinPartitions(key, time, id_col)
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"{id_col} {types[id_col]}, {key} {types[key]}, {name} {kind}")


def sliding_limit(most: int, window: float) -> Machine:
    """Allows a call if fewer than ``most`` were allowed in the last ``window`` seconds; refused calls don't count."""

    def make():
        seen: deque[float] = deque()

        def call(now: float) -> bool:
            while seen and seen[0] <= now - window:
                seen.popleft()
            if len(seen) >= most:
                return False
            seen.append(now)
            return True

        return call

    return make


def first_result(ttl: float) -> Machine:
    """The result stored for a key for ``ttl`` seconds from when it was stored; the call that stores one gives its own."""

    def make():
        stored: list[tuple[float, Any]] = []

        def call(now: float, result: Any) -> Any:
            if stored and now - stored[0][0] < ttl:
                return stored[0][1]
            stored[:] = [(now, result)]
            return result

        return call

    return make


def lockout(threshold: int, ttl: float) -> Machine:
    """ok, failed or locked: ``threshold`` failures lock a key for ``ttl`` seconds; success and the lock's end forget them."""

    def make():
        state = {"failures": 0, "until": None}

        def call(now: float, success: bool) -> str:
            if state["until"] is not None:
                if now < state["until"]:
                    return "locked"
                state.update(failures=0, until=None)
            if success:
                state["failures"] = 0
                return "ok"
            state["failures"] += 1
            if state["failures"] >= threshold:
                state["until"] = now + ttl
            return "failed"

        return call

    return make


def breaker(threshold: int, recovery: float) -> Machine:
    """The state in which a call finds its circuit: closed, open (refused), or half_open, one trial after more than ``recovery`` seconds."""

    def make():
        state = {"failures": 0, "opened": None}

        def call(now: float, success: bool) -> str:
            found = "closed" if state["opened"] is None else "half_open" if now - state["opened"] > recovery else "open"
            if found == "open":
                return found
            if success:
                state.update(failures=0, opened=None)
            else:
                state["failures"] += 1
                if found == "half_open" or state["failures"] >= threshold:
                    state["opened"] = now
            return found

        return call

    return make


def changed(log: DataFrame, *, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` differ from the key's row before; the first of a key counts as a change."""
    w = Window.partitionBy(key).orderBy(*order)
    sign = F.xxhash64(*columns)
    return log.withColumns({"_s": sign, "_n": F.row_number().over(w)}).withColumn("_l", F.lag("_s").over(w)).where((F.col("_n") == 1) | (F.col("_s") != F.col("_l"))).drop("_s", "_l", "_n")


def until_done(log: DataFrame, *, key: str, order: list[str], status_col: str = "status") -> DataFrame:
    """A key's rows up to and with the first that ends it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.col(status_col).isin("completed", "failed", "cancelled").cast("int")).over(w)
    return log.withColumn("_e", F.coalesce(ended, F.lit(0))).where("_e = 0").drop("_e")


def address(ip: Column) -> Column:
    """An IPv4 address as a number, or null."""
    parts = F.split(ip, r"\.")
    part = lambda k: F.get(parts, F.lit(k)).try_cast("long")
    return F.when(ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def in_networks(ip: Column, networks: list[str]) -> Column:
    """Whether an address is in one of the networks ``a.b.c.d/n``."""
    import ipaddress

    own, found = address(ip), F.lit(False)
    for text in networks:
        net = ipaddress.ip_network(text, strict=False)
        found = found | own.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(found, F.lit(False))


def client_ip(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The first address of X-Forwarded-For if the peer is a trusted proxy, else the peer."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(in_networks(peer, trusted) & (F.length(first) > 0), first).otherwise(F.coalesce(peer, F.lit("unknown")))


def revoked(tokens: DataFrame, revocations: DataFrame, now: Column) -> DataFrame:
    """Tokens (jti) that are on the list; entries count once and until they expire."""
    return tokens.join(live(revocations, now).select("jti"), "jti", "left_semi")


def live(revocations: DataFrame, now: Column) -> DataFrame:
    return revocations.groupBy("jti").agg(F.min("exp").alias("exp")).where(F.col("exp") >= now)
