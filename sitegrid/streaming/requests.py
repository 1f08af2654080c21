"""Requests, results and plans as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.verify import MOST_TIMEOUT

#: Watchdogs.
GRACE_MS, START_MS = 5_000, 60_000
TRANSITIONS = "client_id bigint, ts timestamp, generation bigint, request_id bigint, transition string"


def verify_stream(requests: DataFrame, verify: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Verify the plans whose requests arrive, against static tables.

    ``verify`` maps a batch of requests to verification rows. A batch writes its own folder of
    ``sink``, so a batch that is run again replaces what it wrote before. Returns the query.
    """

    def batch(rows: DataFrame, number: int) -> None:
        verify(rows).write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_outcomes(requests: DataFrame, results: DataFrame, most_ms: int = MOST_TIMEOUT, lateness: str = "10 minutes") -> DataFrame:
    """Streams (key, ts, request_id, timeout_ms) and (key, ts, result_id, status) -> every request
    with each result that came within its own timeout_ms + GRACE_MS, or one row without a result
    once the watermark passes.

    Late results fall outside the interval; the watermarks and ``most_ms``, which no timeout_ms
    may exceed (it raises), bound the state.
    """
    known = F.when(F.col("timeout_ms") > most_ms, F.raise_error(F.lit(f"a request's timeout_ms exceeds {most_ms}"))).otherwise(F.col("timeout_ms"))
    left = requests.withColumn("_limit", known.cast("long") + GRACE_MS).withWatermark("ts", lateness)
    right = results.select(F.col("key").alias("_key"), F.col("ts").alias("_ts"), "result_id", "status").withWatermark("_ts", lateness)
    # the first bound is a constant, from which the state's watermark follows
    when = (F.col("key") == F.col("_key")) & (F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= F.col("ts") + F.expr(f"interval {most_ms + GRACE_MS} milliseconds"))
    own = F.unix_micros("_ts") - F.unix_micros("ts") <= F.col("_limit") * 1000
    return left.join(right, when & own, "leftOuter").select("key", "request_id", "ts", "result_id", F.col("_ts").alias("result_ts"), "status")


def first_outcomes(joined: DataFrame) -> DataFrame:
    """(key, request_id, outcome, result_id): the earliest result, or timeout. A batch table."""
    first = joined.groupBy("key", "request_id").agg(F.min(F.when(F.col("result_id").isNotNull(), F.struct("result_ts", "result_id", "status"))).alias("m"))
    return first.select("key", "request_id", F.coalesce("m.status", F.lit("timeout")).alias("outcome"), "m.result_id")


class Client:
    """Life cycle of one client: generation, readiness, the request in flight and its deadline (ms), and
    the newest generation heard of, which the one in force is ahead of after a restart."""

    def __init__(self, generation: int = -1, ready: bool = False, request: int = -1, deadline: int = -1, heard: int = -1):
        self.generation, self.ready, self.request, self.deadline, self.heard = generation, ready, request, deadline, heard

    def state(self) -> tuple:
        return self.generation, self.ready, self.request, self.deadline, self.heard

    def expire(self, now: int) -> list[tuple[int, int, int, str]]:
        """Watchdogs that went off by ``now``: (ms, generation, request, transition)."""
        if self.deadline < 0 or self.deadline > now:
            return []
        at, out = self.deadline, (self.request, "timeout") if self.request >= 0 else (-1, "start_error")
        generation = self.generation
        self.generation, self.ready, self.request, self.deadline = generation + 1, False, -1, -1
        return [(at, generation, *out)]

    def take(self, now: int, generation: int, request: int, kind: str, timeout_ms: int) -> list[tuple[int, int, int, str]]:
        out = self.expire(now)
        new, self.heard = generation > self.heard, max(generation, self.heard)
        if kind == "init" and new:
            self.generation, self.ready, self.request, self.deadline = generation, False, -1, now + START_MS
            return [*out, (now, generation, -1, "starting")]
        if generation < self.generation:
            return [*out, (now, generation, request, "stale")]
        if generation > self.generation:
            self.generation, self.ready, self.request, self.deadline = generation, False, -1, -1
        if kind == "ready":
            self.ready, self.deadline = True, -1 if self.request < 0 else self.deadline
            return [*out, (now, generation, -1, "ready")]
        if kind == "solve":
            if not self.ready or self.request >= 0:
                return [*out, (now, generation, request, "rejected")]
            self.request, self.deadline = request, now + timeout_ms + GRACE_MS
            return [*out, (now, generation, request, "solving")]
        if kind in ("result", "progress"):
            if request != self.request or self.request < 0:
                return [*out, (now, generation, request, "ignored")]
            if kind == "progress":
                return [*out, (now, generation, request, "progress")]
            self.request, self.deadline = -1, -1
            return [*out, (now, generation, request, "finished")]
        if kind == "cancel":
            if self.request < 0:
                return [*out, (now, generation, request, "ignored")]
            out.append((now, generation, self.request, "cancelled"))
            self.generation, self.ready, self.request, self.deadline = generation + 1, False, -1, -1
        return out


def _rows(key: Any, found: list[tuple[int, int, int, str]]) -> pd.DataFrame:
    at, generation, request, what = zip(*found, strict=True)
    return pd.DataFrame({"client_id": np.full(len(at), key), "ts": np.array(at, "datetime64[ms]").astype("datetime64[ns]"), "generation": np.array(generation), "request_id": np.array(request), "transition": list(what)})


def _apply(client: Client, batches: list[pd.DataFrame]) -> list[tuple[int, int, int, str]]:
    column = lambda name: np.concatenate([b[name].to_numpy() for b in batches])
    ts, number = column("ts"), column("event_id")
    order = np.lexsort((number, ts))
    values = [c[order].tolist() for c in (ts.astype("datetime64[ms]").astype(np.int64), *map(column, ("generation", "request_id", "type", "timeout_ms")))]
    out: list = []
    for at, generation, request, kind, timeout in zip(*values, strict=True):
        out += client.take(at, int(generation), int(request), kind, int(timeout))
    return out


class Lifecycle(StatefulProcessor):
    """Keyed state of a client, with an event-time timer as its watchdog."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("client", "generation bigint, ready boolean, request bigint, deadline bigint, heard bigint")

    def _load(self) -> tuple[Client, tuple | None]:
        before = self.kept.get()
        return Client(*(before or ())), before

    def _save(self, client: Client, before: tuple | None, expired: int | None = None) -> None:
        """Only what changed is asked of the store. A client's one timer is its deadline."""
        if before is not None and tuple(before) == client.state():
            return
        was = -1 if before is None else before[3]
        if was != client.deadline:
            if was >= 0 and was != expired:
                self.handle.deleteTimer(was)
            if client.deadline >= 0:
                self.handle.registerTimer(client.deadline)
        self.kept.update(client.state())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        client, before = self._load()
        found = _apply(client, list(rows))
        self._save(client, before)
        if found:
            yield _rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        client, before = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        found = client.expire(now)
        self._save(client, before, now)
        if found:
            yield _rows(key[0], found)

    def close(self) -> None:
        pass


def messages_of(events: DataFrame) -> DataFrame:
    """(client_id, at, event_id, generation, request_id, type, timeout_ms) of the events without a null; at in ms."""
    whole = [F.col(c).cast("long").alias(c) for c in ("client_id", "event_id", "generation", "request_id", "timeout_ms")]
    return events.select(*whole, F.unix_millis("ts").alias("at"), "type").na.drop()


def request_lifecycle(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """State transitions of every client, from a stream (client_id, ts, event_id, generation,
    request_id, type, timeout_ms). Rows with a null in one of these are no messages. Needs the RocksDB
    state store."""
    known = events.na.drop(subset=["client_id", "ts", "event_id", "generation", "request_id", "type", "timeout_ms"])
    keyed = known.withWatermark("ts", lateness).groupBy("client_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Lifecycle(), outputStructType=TRANSITIONS, outputMode="append", timeMode="eventTime")
