"""The life cycle of requests from a table of messages, without going through them one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import running
from ..functions.staging import staged
from .requests import GRACE_MS, START_MS, messages_of

LIFE = ["client_id", "generation"]


def _when(kind: str, *columns: Column | str) -> Column:
    return F.when(F.col("type") == kind, F.struct(*columns) if len(columns) > 1 else F.col(columns[0]))


def _reached(heads: DataFrame, jumps: DataFrame) -> DataFrame:
    """The places (client_id, pos) that chains of ``jumps`` (client_id, pos, to) reach from ``heads``: jumps
    double in length every round, so rounds grow with the logarithm of the longest chain."""
    found = new = staged(heads, "life-heads")
    while not new.isEmpty():
        new = staged(found.join(jumps, ["client_id", "pos"]).select("client_id", F.col("to").alias("pos")), "life-new")
        found = staged(found.unionByName(new), "life-found")
        far = jumps.select("client_id", F.col("pos").alias("to"), F.col("to").alias("_far"))
        jumps = staged(jumps.join(far, ["client_id", "to"]).select("client_id", "pos", F.col("_far").alias("to")), "life-jumps")
    return found


def lifecycle_table(events: DataFrame, until_ms: int) -> DataFrame:
    """The batch twin of ``request_lifecycle``: the same transitions from a table of all events, watchdogs run to
    ``until_ms``, which is not before the last message.

    The newest generation so far splits a client's messages into lives; what is of an older one is
    stale. In a life, a solve that is taken ends with the first result of its id, cancel, deadline or
    message of a newer life behind it, whichever comes first, and the next solve that is
    taken is the first one behind a result. So the solves taken are a chain from the first one behind
    ``ready``; a life ends with the chain's last solve where that is cancelled or out of time. Orders are
    distributed sorts: neither a client nor a life with a third of all messages is one task's.

    As in the stream, rows with a null are no messages, unknown types change nothing, and identifiers of messages
    are unique within a client; generations, request ids and timeouts are not negative.
    """
    raw = messages_of(events).withColumn("own", F.col("generation"))
    m = running(raw, ["client_id"], ["at", "event_id"], {"pos": ("count", F.lit(1)), "generation": ("max", F.col("own"))})
    m = staged(m, "life-messages")
    fresh = F.col("own") == F.col("generation")
    lives = m.groupBy(*LIFE).agg(
        F.max("pos").alias("last"), F.min(F.struct("pos", "at", "type")).alias("first"), F.min(F.when(fresh, _when("ready", "pos", "at"))).alias("ready")
    )
    lives = staged(lives, "life-lives")
    after = lives.select("client_id", (F.col("first.pos") - 1).alias("last"), F.struct("first.pos", "first.at").alias("after"))
    unready = F.coalesce("ready.at", "after.at", F.lit(until_ms))
    lives = lives.join(after, ["client_id", "last"], "left").withColumn("start", F.when(F.col("first.type") == "init", F.col("first.at") + START_MS))
    lives = staged(lives.withColumn("start", F.when(F.col("start") <= unready, F.col("start"))), "life-lives")

    back = [F.col("pos").desc()]
    mine = running(m.where(fresh).drop("own"), LIFE, back, {"cancel": ("min", _when("cancel", "pos", "at")), "solve": ("min", _when("solve", "pos"))})
    mine = staged(running(mine, [*LIFE, "request_id"], back, {"result": ("min", _when("result", "pos", "at"))}), "life-mine")
    end = lambda c, name: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.pos").alias("pos"), F.col(f"{c}.at").alias("at"), F.lit(name).alias("how")))
    solves = mine.where("type = 'solve'").join(lives.select(*LIFE, "after"), LIFE).withColumn("deadline", F.col("at") + F.col("timeout_ms") + GRACE_MS)
    solves = solves.withColumn("end", F.least(end("result", "finished"), end("cancel", "cancelled"), end("after", "over")))
    late = F.coalesce("end.at", F.lit(until_ms)) >= F.col("deadline")
    solves = staged(solves.select(*LIFE, "pos", "request_id", "deadline", F.col("end.pos").alias("end"), F.when(late, "timeout").otherwise(F.col("end.how")).alias("how")), "life-solves")

    behind = mine.where("solve is not null").select("client_id", F.col("pos").alias("end"), F.col("solve").alias("to"))
    jumps = staged(solves.where("how = 'finished'").join(behind, ["client_id", "end"]).select("client_id", "pos", "to"), "life-jumps")
    heads = lives.where("start is null").select("client_id", F.col("ready.pos").alias("end")).join(behind, ["client_id", "end"]).select("client_id", F.col("to").alias("pos"))
    taken = staged(solves.join(_reached(heads, jumps), ["client_id", "pos"], "left_semi"), "life-taken")

    died = taken.where("how in ('timeout', 'cancelled')").select(*LIFE, F.when(F.col("how") == "timeout", F.col("deadline")).alias("out_at"), F.when(F.col("how") == "cancelled", F.col("end")).alias("cut"))
    ends = lives.join(died, LIFE, "left").select(*LIFE, F.col("first.pos").alias("first"), F.coalesce("start", "out_at").alias("out_at"), "cut")
    gone = (F.col("at") >= F.col("out_at")) | (F.col("pos") > F.col("cut"))
    told = lambda rows, at, request, what: rows.select("client_id", F.timestamp_millis(at).alias("ts"), "generation", request.cast("long").alias("request_id"), what.alias("transition"))
    out = told(m.where(~fresh).drop("generation").withColumnRenamed("own", "generation"), F.col("at"), F.col("request_id"), F.lit("stale"))
    out = out.unionByName(told(lives.where("start is not null"), F.col("start"), F.lit(-1), F.lit("start_error")))
    out = out.unionByName(told(taken.where("how = 'timeout'"), F.col("deadline"), F.col("request_id"), F.lit("timeout")))

    marks = taken.select("client_id", "pos", F.struct("pos", "request_id", F.when(F.col("how") == "finished", F.col("end")).alias("end")).alias("taken"))
    mine = mine.select(*LIFE, "pos", "at", "request_id", "type").join(marks, ["client_id", "pos"], "left")
    mine = running(mine, LIFE, ["pos"], {"flight": ("max", F.col("taken"))}).join(ends, LIFE)
    flying = F.coalesce((F.col("flight.pos") < F.col("pos")) & (F.coalesce("flight.end", "pos") >= F.col("pos")), F.lit(False))
    same = flying & (F.col("flight.request_id") == F.col("request_id"))
    kind = lambda name: F.col("type") == name
    what = (
        F.when(F.coalesce(gone, F.lit(False)), "stale")
        .when(kind("init") & (F.col("pos") == F.col("first")), "starting")
        .when(kind("ready"), "ready")
        .when(kind("solve"), F.when(F.col("taken").isNotNull(), "solving").otherwise("rejected"))
        .when(kind("result"), F.when(same, "finished").otherwise("ignored"))
        .when(kind("progress"), F.when(same, "progress").otherwise("ignored"))
        .when(kind("cancel"), F.when(flying, "cancelled").otherwise("ignored"))
    )
    request = F.when(F.col("what").isin("starting", "ready"), F.lit(-1)).when(F.col("what") == "cancelled", F.col("flight.request_id")).otherwise(F.col("request_id"))
    return out.unionByName(told(mine.withColumn("what", what).where("what is not null"), F.col("at"), request, F.col("what")))
