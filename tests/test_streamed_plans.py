"""Plans that arrive in pieces: whole once, over any batches, or flagged in time."""

from collections import Counter
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from sitegrid.queries_io import _rocks
from sitegrid.streaming import plans as streams

PIECES = "region_id long, plan_id long, kind string, pos long, site_kind string, x long, y long, outage_depot long, n long, minute int"


def test_plans_become_whole_once(spark, tmp_path):
    at = lambda plan, kind, pos, minute, n=None: (0, plan, kind, pos, "locker" if kind == "site" else None, 7 + pos, 3, None, n, minute)
    batches = [
        # 1 is split over three batches, its announcement in the middle; 2 comes at once; 4 is never announced
        [at(1, "site", 0, 0), (0, 2, "announced", None, None, None, None, None, 2, 0), at(2, "site", 0, 0), at(2, "cell", 1, 0), at(4, "cell", 0, 0)],
        [(0, 1, "announced", None, None, None, None, None, 3, 1), at(1, "supply", 1, 1), (0, 3, "announced", None, None, None, None, None, 2, 1), at(3, "cell", 0, 1), (0, 5, "announced", None, None, None, None, None, 0, 1)],
        [at(1, "outage", 2, 2), at(2, "cell", 1, 2)],  # a piece of a plan that is done is dropped
        [(0, -1, "announced", None, None, None, None, None, 9, 10_000)],
    ]
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    session, seen = _rocks(spark), []

    def verify(plans, tables):
        seen.append({name: sorted((r.plan_id, r.pos) for r in t.join(plans, ["region_id", "plan_id"]).collect()) for name, t in tables.items()})
        values = {"valid": F.lit(True), "errors": F.array().cast("array<string>")}
        return plans.select("region_id", "plan_id", *[values.get(c.split()[0], F.lit(0)).alias(c.split()[0]) for c in streams.RESULT.split(", ")[2:]])

    for rows in batches:
        df = spark.createDataFrame(rows, PIECES).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60)).drop("minute")
        df.coalesce(1).write.mode("append").parquet(source)
        arriving = session.readStream.schema(df.schema).parquet(source)
        run = streams.verify_plan_stream(arriving, verify, sink, check, wait_ms=600_000, lateness="1 minute")
        run.awaitTermination()
    out = spark.read.schema(streams.RESULT + ", batch int").parquet(sink).collect()
    assert Counter((r.plan_id, r.valid, tuple(r.errors)) for r in out) == Counter([(1, True, ()), (2, True, ()), (5, True, ()), (3, False, ("incomplete",)), (4, False, ("incomplete",))])
    assert {r.plan_id: r.batch for r in out}[2] < {r.plan_id: r.batch for r in out}[1]
    parts = [s for s in seen if any(s.values())]
    assert [s["plan_sites"] for s in parts] == [[(2, 0)], [(1, 0)]] and [s["plan_supply"] for s in parts] == [[], [(1, 1)]] and [s["plan_outages"] for s in parts] == [[], [(1, 2)]]
    # only the last batch's plan is still held
    assert sum(o["numRowsTotal"] for o in run.lastProgress["stateOperators"]) <= 4


def test_pieces_hold_the_tables(spark):
    make = spark.createDataFrame
    tables = {
        "plan_sites": make([(0, 1, "locker", 5, 50), (0, 1, "depot", 6, 60)], "region_id long, plan_id long, kind string, pos long, site_id long"),
        "plan_cells": make([(0, 1, 0, 9, 50)], "region_id long, plan_id long, pos long, cell_id long, locker_id long"),
        "plan_supply": make([(0, 1, 0, None, 50, 60), (0, 1, 1, 60, 50, 61)], "region_id long, plan_id long, pos long, outage_depot long, locker_id long, depot_id long"),
        "plan_outages": make([(0, 1, 0, 60)], "region_id long, plan_id long, pos long, depot_id long"),
    }
    rows = streams.pieces(make([(0, 1), (0, 2)], "region_id long, plan_id long"), **tables)
    assert {(r.plan_id, r.n) for r in rows.where("kind = 'announced'").collect()} == {(1, 6), (2, 0)}
    back = streams.plan_tables(rows)
    for name, t in tables.items():
        assert sorted(map(tuple, back[name].select(*t.columns).collect()), key=repr) == sorted(map(tuple, t.collect()), key=repr)


class Held:
    """State without a store, and how often it is written to."""

    def __init__(self):
        self.values, self.writes = [], 0
        self.exists, self.get = lambda: bool(self.values), lambda: self.values

    def appendValue(self, value):
        self.values, self.writes = [*self.values, value], self.writes + 1

    def clear(self):
        self.values = []


class Progress(Held):
    def update(self, value):
        self.values, self.get = [value], lambda: value


def test_pieces_are_kept_by_the_chunk():
    """The store of a plan is written to once for a batch of pieces, whatever their number, and gives them back as they came."""
    held, progress, timers = Held(), Progress(), []
    handle = SimpleNamespace(getListState=lambda *_: held, getValueState=lambda *_: progress, registerTimer=timers.append)
    machine = streams.Assembly(60_000)
    machine.init(handle)
    at = pd.Timestamp("2023-11-14 22:13:20")
    rows = [("cell", i, None, 2**40 + i, 3, None if i % 2 else i, None, at) for i in range(500)]
    batch = lambda rows: pd.DataFrame(rows, columns=[*streams.NAMES, "ts"])
    assert not list(machine.handleInputRows((0, 1), iter([batch(rows[:200])]), None)) and held.writes == 1 and timers == [1_700_000_060_000]
    announced = ("announced", None, None, None, None, None, 500, at)
    out = pd.concat(list(machine.handleInputRows((0, 1), iter([batch([*rows[200:], announced])]), None)))
    assert held.writes == 2 and not held.values and len(timers) == 1
    got = [tuple(None if pd.isna(v) else v for v in r) for r in out[out.kind != "whole"][streams.NAMES].itertuples(index=False)]
    assert got == [r[:-1] for r in rows] and list(out.kind).count("whole") == 1
    # what comes after is dropped
    assert not list(machine.handleInputRows((0, 1), iter([batch(rows[:1])]), None)) and not held.values
