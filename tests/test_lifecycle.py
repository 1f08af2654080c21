"""The batch life cycle against the client's own state machine, message by message."""

import datetime
import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from sitegrid.functions.numbering import running
from sitegrid.streaming.lifecycle import lifecycle_table
from sitegrid.streaming.requests import Client, Lifecycle

SCHEMA = "client_id bigint, ts timestamp, event_id bigint, generation bigint, request_id bigint, type string, timeout_ms bigint, at string, last int"
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def one_by_one(rows, until):
    out = []
    for key in {r[0] for r in rows if None not in r[:7]}:
        client = Client()
        for r in sorted((r for r in rows if r[0] == key and None not in r[:7]), key=lambda r: r[1:3]):
            out += [(key, *t) for t in client.take(round((r[1] - EPOCH).total_seconds() * 1000), r[3], r[4], r[5], r[6])]
        out += [(key, *t) for t in client.expire(until)]
    return sorted(out)


def both(spark, rows, until):
    moved = until + int(EPOCH.timestamp() * 1000)
    got = lifecycle_table(spark.createDataFrame(rows, SCHEMA), moved).withColumn("ms", F.unix_millis("ts") - int(EPOCH.timestamp() * 1000))
    return sorted(tuple(r) for r in got.select("client_id", "ms", "generation", "request_id", "transition").collect()), one_by_one(rows, until)


def message(key, ms, event, generation, request, kind, timeout):
    return (key, EPOCH + datetime.timedelta(milliseconds=ms), event, generation, request, kind, timeout, "clash", 1)


def test_random_lives(spark):
    rng = random.Random(3)
    rows, event = [], 0
    for key, n in [(0, 1500), *((k, 40) for k in range(1, 40))]:
        ms, generation = 0, 0
        for _ in range(n):
            event += 1
            ms += rng.choice((0, 1, 1000, 1000, 4000, 30_000) if key % 2 else (0, 1, 10, 500))
            if rng.random() < (0.03 if key else 0.004):
                generation += rng.choice((1, 1, 2))
            kind = rng.choice(("init", "ready", "solve", "solve", "result", "result", "progress", "other", *(("cancel",) if rng.random() < 0.3 else ())))
            own = max(0, generation - (rng.random() < 0.1))
            rows.append(message(key, ms, event, own, rng.randrange(2), kind, rng.choice((0, 1, 5_000, 200_000))))
    rng.shuffle(rows)
    got, want = both(spark, rows, 200_000_000)
    assert got == want
    assert {x[4] for x in got} == {"starting", "start_error", "stale", "ready", "rejected", "solving", "ignored", "progress", "finished", "cancelled", "timeout"}


def test_a_restart_is_watched(spark):
    """After a cancel the next generation's init starts its watchdog, though the restart counts already."""
    rows = [message(1, k, k, g, 7, kind, 1000) for k, (g, kind) in enumerate([(0, "init"), (0, "ready"), (0, "solve"), (0, "cancel"), (1, "init"), (0, "result")])]
    got, want = both(spark, rows, 60_004)
    assert got == want and [x[4] for x in sorted(got, key=lambda x: x[1])] == ["starting", "ready", "solving", "cancelled", "starting", "stale", "start_error"]
    assert both(spark, rows, 60_003)[0] == [x for x in got if x[4] != "start_error"]


def test_a_long_chain_of_one_client(spark):
    """Many requests one after the other in one life; a null is no message; no messages, no transitions."""
    rows = [message(5, 0, 0, 2, 0, "ready", 0)]
    for k in range(1, 400):
        rows += [message(5, 10 * k, 10 * k, 2, k % 3, "solve", 10), message(5, 10 * k + 5, 10 * k + 1, 2, k % 3, "result", 0)]
    rows += [(None, *rows[0][1:]), (5, None, *rows[0][2:]), (*rows[0][:5], None, *rows[0][6:])]
    got, want = both(spark, rows, 10**6)
    assert got == want and sum(x[4] == "finished" for x in got) == 399
    assert both(spark, rows[-1:], 10**6) == ([], []) and lifecycle_table(spark.createDataFrame([], SCHEMA), 0).isEmpty()


def test_one_client_is_spread_over_tasks(spark):
    """Half of all messages are one client's: no task gets more than a part of them."""
    df = spark.range(8000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    out = running(df, ["k"], ["v"], {"n": ("count", F.lit(1)), "top": ("max", F.col("v") % 1000), "low": ("min", -F.col("v"))})
    most = out.where("k = 0").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 2000
    rows = out.where("k = 0").orderBy("v").collect()
    assert [r.n for r in rows] == list(range(1, 4001)) and [r.low for r in rows] == [-v for v in range(4000)]
    assert [r.top for r in rows] == [min(v, 999) for v in range(4000)]


def test_clients_ask_the_store_for_what_changed():
    """A batch reads a client's state once, and touches timers only where the deadline moves."""
    said, state, timers = [], [None], set()
    kept = SimpleNamespace(exists=lambda: said.append("exists") or state[0] is not None, get=lambda: said.append("get") or state[0], update=lambda v: (said.append("update"), state.__setitem__(0, v)))
    handle = SimpleNamespace(getValueState=lambda *_: kept, listTimers=lambda: said.append("list") or list(timers), deleteTimer=lambda at: (said.append("delete"), timers.remove(at)), registerTimer=lambda at: (said.append("register"), timers.add(at)))
    machine = Lifecycle()
    machine.init(handle)

    def told(*rows):
        said.clear()
        batch = pd.DataFrame([(pd.Timestamp(s, unit="s"), n, 1, 5, kind, 60_000) for s, n, kind in rows], columns=["ts", "event_id", "generation", "request_id", "type", "timeout_ms"])
        out = list(machine.handleInputRows((7,), iter([batch.iloc[:1], batch.iloc[1:]] if len(batch) > 1 else [batch]), None))
        return [(r.ts.value // 10**9, r.transition) for x in out for r in x.itertuples()]

    assert told((20, 2, "solve"), (10, 1, "ready")) == [(10, "ready"), (20, "solving")] and said == ["get", "register", "update"] and timers == {85_000}
    assert told((30, 3, "progress")) == [(30, "progress")] and said == ["get"]
    assert told((40, 4, "result")) == [(40, "finished")] and said == ["get", "delete", "update"] and not timers
    assert told((50, 5, "solve")) == [(50, "solving")] and timers == {115_000}
    out = list(machine.handleExpiredTimer((7,), None, SimpleNamespace(getExpiryTimeInMs=lambda: 115_000)))
    assert [r.transition for x in out for r in x.itertuples()] == ["timeout"] and state[0][3] == -1
