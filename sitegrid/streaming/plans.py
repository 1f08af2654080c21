"""Plans that arrive in pieces on a stream: assembled by keyed state, verified once, or flagged.

A piece is one row of a plan: its announcement with the number of all other pieces, a site, a cell's
assignment, a supply or an outage. Pieces come in any order and over any number of batches. The state
of a plan holds the pieces that have come; when there are as many as announced, the plan leaves
the state whole, and what is left is a mark that it is done. A plan that is not whole when the
watermark passes its first piece by the waiting time leaves as ``incomplete``, without its pieces.
A plan is one key: its own pieces, and no more, pass one task. They are kept as they come, a chunk of
columns for each of the batches in which Spark hands them over, so the store is asked once a chunk and not once a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PLAN = ["region_id", "plan_id"]
BODY = "kind string, pos bigint, site_kind string, x bigint, y bigint, outage_depot bigint, n bigint"
PIECE = f"region_id bigint, plan_id bigint, {BODY}"
#: Columns of the plan tables and the columns of a piece that hold them.
TABLES = {
    "plan_sites": ("site", {"kind": "site_kind", "pos": "pos", "site_id": "x"}),
    "plan_cells": ("cell", {"pos": "pos", "cell_id": "x", "locker_id": "y"}),
    "plan_supply": ("supply", {"pos": "pos", "outage_depot": "outage_depot", "locker_id": "x", "depot_id": "y"}),
    "plan_outages": ("outage", {"pos": "pos", "depot_id": "x"}),
}
NAMES = [c.split()[0] for c in BODY.split(", ")]
_KINDS = {"pos": "bigint", "site_kind": "string", "x": "bigint", "y": "bigint", "outage_depot": "bigint", "n": "bigint"}


#: The columns of a chunk of pieces.
CHUNK = pa.schema([(c, pa.string() if kind == "string" else pa.int64()) for c, kind in (x.split() for x in BODY.split(", "))])


def pieces(requests: DataFrame, **tables: DataFrame) -> DataFrame:
    """The pieces of plans: one announcement for each of ``requests(region_id, plan_id)``, and all rows of the plan tables."""
    parts = []
    for name, (kind, columns) in TABLES.items():
        back = {piece: own for own, piece in columns.items()}
        parts.append(tables[name].select(*PLAN, F.lit(kind).alias("kind"), *[(F.col(back[c]) if c in back else F.lit(None)).cast(t).alias(c) for c, t in _KINDS.items()]))
    rows = reduce(DataFrame.unionByName, parts)
    n = rows.groupBy(*PLAN).agg(F.count(F.lit(1)).alias("n"))
    named = requests.select(*PLAN).join(n, PLAN, "left").select(*PLAN, F.lit("announced").alias("kind"), *[(F.coalesce("n", F.lit(0)) if c == "n" else F.lit(None)).cast(t).alias(c) for c, t in _KINDS.items()])
    return rows.unionByName(named)


def plan_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The plan tables that whole plans' pieces hold."""
    return {name: rows.where(F.col("kind") == kind).select(*PLAN, *[F.col(piece).alias(own) for own, piece in columns.items()]) for name, (kind, columns) in TABLES.items()}


class Assembly(StatefulProcessor):
    """Keyed state of a plan: its pieces, the number announced and whether it is done."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("pieces", "chunk binary")
        self.progress = handle.getValueState("progress", "announced bigint, here bigint, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, first = not self.progress.exists(), []
        announced, here, done = (-1, 0, False) if new else self.progress.get()
        for batch in rows:
            if new:
                first.append(batch["ts"].min().value)
            if done:
                continue
            told = batch["kind"] == "announced"
            if told.any():
                n = batch.loc[told, "n"].iloc[-1]
                announced = None if pd.isna(n) else int(n)
            own = batch.loc[~told, NAMES]
            if len(own):
                self.held.appendValue((pa.RecordBatch.from_pandas(own, CHUNK, preserve_index=False).serialize().to_pybytes(),))
                here += len(own)
        if new:
            self.handle.registerTimer(int(min(first) // 1_000_000) + self.wait_ms)
        if not done and announced == here:
            done = True
            yield from self._whole(key)
            self.held.clear()
        self.progress.update((announced, here, done))

    def _whole(self, key) -> Iterator[pd.DataFrame]:
        for (chunk,) in self.held.get():
            yield self._named(key, pa.ipc.read_record_batch(pa.py_buffer(chunk), CHUNK).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get))
        yield self._named(key, pd.DataFrame([("whole", *[None] * (len(NAMES) - 1))], columns=NAMES))

    def _named(self, key, found: pd.DataFrame) -> pd.DataFrame:
        found.insert(0, "region_id", key[0])
        found.insert(1, "plan_id", key[1])
        return found.astype({c: "Int64" for c, t in _KINDS.items() if t == "bigint"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, done = self.progress.get()
        self.held.clear()
        self.progress.clear()
        if not done:
            yield self._named(key, pd.DataFrame([("incomplete", *[None] * (len(NAMES) - 1))], columns=NAMES))

    def close(self) -> None:
        pass


def assembled(arriving: DataFrame, wait_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """A stream of pieces with ``ts`` -> the pieces of whole plans, each with a row ``whole``, and a row
    ``incomplete`` for each plan that did not become whole in time. Needs the RocksDB state store."""
    keyed = arriving.withWatermark("ts", lateness).groupBy(*PLAN)
    return keyed.transformWithStateInPandas(statefulProcessor=Assembly(wait_ms), outputStructType=PIECE, outputMode="append", timeMode="eventTime")


#: What a verification writes: the columns of ``Audit.verification``.
RESULT = "region_id bigint, plan_id bigint, valid boolean, errors array<string>, parcel_total bigint, worst_walk_mm bigint, longest_flight_mm bigint, routes_checked bigint"


def verify_plan_stream(arriving: DataFrame, verify: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], sink: str, checkpoint: str, wait_ms: int, lateness: str = "10 minutes"):
    """Verify every plan that becomes whole, in the batch in which it does.

    ``verify(plans, tables)`` maps the whole plans' keys and plan tables to the rows of RESULT; incomplete
    plans get a row of nulls, not valid, with the one error ``incomplete``. A batch writes its own folder
    of ``sink``, so a batch that is run again replaces what it wrote: a verification is keyed by (plan_id,
    batch). A batch without either writes nothing. Returns the query.
    """
    names = [c.strip().split(" ") for c in RESULT.split(", ")]
    known = {"valid": F.lit(False), "errors": F.array(F.lit("incomplete"))}

    def batch(rows: DataFrame, number: int) -> None:
        kept = rows.persist()
        try:
            plans, lost = kept.where("kind = 'whole'").select(*PLAN), kept.where("kind = 'incomplete'").select(*PLAN)
            parts = [] if lost.isEmpty() else [lost.select(*PLAN, *[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in names[2:]])]
            if not plans.isEmpty():
                parts.append(verify(plans, plan_tables(kept)).select(*[F.col(c).cast(t) for c, t in names]))
            if parts:
                reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")
        finally:
            kept.unpersist()

    found = assembled(arriving, wait_ms, lateness)
    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
