"""Registered queries on sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .bindings import KEY, Blocks, City, Plans
from .functions.staging import shared_dir, staged
from .oracles import sql
from .plans.verify import Audit
from .queries_plans import v3_plans  # noqa: F401  the stream has the batch audit's oracle
from .registry import SQL, query
from .sources import tables
from .streaming import plans as plan_streams
from .streaming import requests as streams
from .streaming.lifecycle import lifecycle_table

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fresh(spark, label: str) -> str:
    return f"{shared_dir(spark)}/sitegrid/{label}-{uuid.uuid4().hex}"


@query(
    "s1_read_network",
    sql("bl bc bw", """select 'node' as kind, region_id, site_id::varchar as id, x_mm as first, y_mm as second from bl
     union all select 'edge', region_id, cell_id || '-' || locker_id, distance_mm, locker_id from bw
     union all select 'cell', region_id, cell_id::varchar, population, parcels from bc where region_id in (select region_id from bl)"""),
)
def s1(spark, d):
    """Blocks, with an edge for each walk, written as one document a region, gzipped JSON lines, and
    read back as nodes, edges and cells."""
    b = Blocks(spark, d)
    text = lambda c: F.col(c).cast("string").alias(c)
    zero = F.lit(0).cast("double")
    nodes = b.lockers().groupBy(KEY).agg(F.collect_list(F.struct(F.col("site_id").cast("string").alias("node_id"), zero.alias("lon"), zero.alias("lat"), "x_mm", "y_mm")).alias("nodes"))
    cells = b.cells().groupBy(KEY).agg(F.collect_list(F.struct(text("cell_id"), "population", "parcels", text("node_id"), "x_mm", "y_mm", F.lit(0).cast("long").alias("connector_mm"))).alias("cells"))
    end = F.struct(F.col("locker_id").cast("double").alias("lon"), zero.alias("lat"))
    way = F.struct(F.concat_ws("-", "cell_id", "locker_id").alias("edge_id"), F.col("cell_id").cast("string").alias("src"), F.col("locker_id").cast("string").alias("dst"), F.col("distance_mm").alias("length_mm"), F.array(end).alias("coordinates"))
    edges = b.walks().groupBy(KEY).agg(F.collect_list(way).alias("edges"))
    path = _fresh(spark, "network")
    nodes.join(cells, KEY, "left").join(edges, KEY, "left").write.json(path, compression="gzip")
    back = tables.read_network(spark, path)
    rows = lambda name, key, first, second: back[name].select(F.lit(name[:-1]).alias("kind"), KEY, F.col(key).alias("id"), first.cast("long").alias("first"), second.cast("long").alias("second"))
    out = rows("nodes", "node_id", F.col("x_mm"), F.col("y_mm")).unionByName(rows("cells", "cell_id", F.col("population"), F.col("parcels")))
    return out.unionByName(rows("edges", "edge_id", F.col("length_mm"), F.element_at("coordinates", 1)["lon"]))


@query("s2_read_geojson", sql("cells", "select 'grid-' || cell_id as cell_id, population, cell_id % 7 as lon_steps from cells"))
def s2(spark, d):
    """Cells written as GeoJSON collections, one per line and file part, and read back."""
    c = City(spark, d).cells()
    ring = F.array(F.array(F.array((F.col("cell_id") % 7).cast("double"), F.lit(60.0)), F.array(F.lit(25.0), F.lit(61.0))))
    one = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("cell_id").alias("index"), "population").alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    docs = c.groupBy((F.col("cell_id") % 16).alias("part")).agg(F.collect_list(one).alias("features")).select(F.lit("FeatureCollection").alias("type"), "features")
    path = _fresh(spark, "geojson")
    docs.write.json(path)
    back = tables.read_geojson(spark, path, "index", {"index": "bigint", "population": "bigint"}, "grid-", "jsonl")
    return back.select("cell_id", "population", F.element_at(F.element_at("polygon", 1), 1)["lon"].cast("long").alias("lon_steps"))


@query("s4_verify_sources", "select 'customer.parquet' as name, true as expected_missing, false as found_missing union all select 'ghost.parquet', false, true union all select 'orders.parquet', false, false")
def s4(spark, d):
    """The tables, files or folders of files, against a manifest with a wrong digest, a missing line and a ghost."""
    path = f"{d}/*.parquet"
    files = tables.source_digests(spark, path)
    bent = files.where("name <> 'customer.parquet'").withColumn("sha256", F.when(F.col("name") == "orders.parquet", F.lit("0")).otherwise(F.col("sha256")))
    ghost = files.where("name = 'orders.parquet'").select(F.lit("ghost.parquet").alias("name"), F.lit("1").alias("sha256"))
    out = tables.verify_sources(spark, path, bent.unionByName(ghost))
    return out.select("name", F.col("expected").isNull().alias("expected_missing"), F.col("found").isNull().alias("found_missing"))


@query("s5_write_snapshot", sql("bw bl", "select 'walks' as name, region_id, count(*) as rows from bw group by 2 union all select 'lockers', region_id, count(*) from bl group by 2"))
def s5(spark, d):
    b = Blocks(spark, d)
    path = _fresh(spark, "snapshot")
    tables.write_snapshot({"walks": b.walks(), "lockers": b.lockers()}, path)
    n = lambda t: spark.read.parquet(f"{path}/{t}").groupBy(F.col(KEY).cast("long").alias(KEY)).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("name"), KEY, "rows")
    return n("walks").unionByName(n("lockers"))


@query("s6_fingerprint", "select (select count(*) from lineitem) as rows, true as order_free, true as change_seen")
def s6(spark, d):
    """Whether the address survives reordering and notices one changed row."""
    t = City(spark, d).table("lineitem")
    bent = t.withColumn("l_tax", F.when((F.col("l_orderkey") == 1), F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    a, b, c = (tables.fingerprint(x).withColumnsRenamed({"snapshot_id": f"i{k}", "rows": f"r{k}"}) for k, x in enumerate((t, t.select(*reversed(t.columns)).repartition("l_partkey"), bent)))
    both = a.join(b, F.lit(True)).join(c, F.lit(True))
    return both.select(F.col("r0").alias("rows"), (F.col("i0") == F.col("i1")).alias("order_free"), (F.col("i0") != F.col("i2")).alias("change_seen"))


@query(
    "s7_diff_snapshots",
    "with a as (select o_orderkey, o_custkey from orders union all select o_orderkey, o_custkey from orders where o_orderkey % 100 = 1), b as (select o_orderkey, case when o_orderkey % 50 = 7 then -1 else o_custkey end as o_custkey from orders) select *, 'left' as side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)",
)
def s7(spark, d):
    o = City(spark, d).table("orders").select("o_orderkey", "o_custkey")
    changed = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 == 7, F.lit(-1)).otherwise(F.col("o_custkey")))
    return tables.diff_snapshots(o.unionByName(o.where("o_orderkey % 100 = 1")), changed)


@query("s8_street_layer", sql("edges", """select '{"type":"Feature","properties":{"edge_id":"' || edge_id || '"},"geometry":{"type":"LineString","coordinates":[[' || src || '.0,' || dst || '.0],[' || dst || '.0,' || src || '.0]]}}' as feature from edges where dst % 3 <> 0"""))
def s8(spark, d):
    e = City(spark, d).edges()
    p = lambda a, b: F.struct(F.col(a).cast("double").alias("lon"), F.col(b).cast("double").alias("lat"))
    twins = e.withColumns({"edge_id": F.when(F.col("dst") % 3 == 0, F.concat("edge_id", F.lit("-r"))).otherwise(F.col("edge_id")), "coordinates": F.array(p("src", "dst"), p("dst", "src"))})
    return tables.street_layer(twins).select("feature")


@query("s8_cell_layer", sql("cells chosen", """select '{"type":"Feature","properties":{"cell_id":' || cell_id || ',"covered":' || (cell_id in (select cell_id from chosen)) || '},"geometry":{"type":"Polygon","coordinates":[[[' || cell_id || '.0,1.0],[2.0,' || cell_id || '.0]]]}}' as feature from cells"""))
def s8_cells(spark, d):
    from .operators.coverage import coverage_flags

    c = City(spark, d)
    k = F.col("cell_id").cast("double")
    p = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    flags = coverage_flags(c.cells(), c.walks(), c.selection()).withColumn("polygon", F.array(F.array(p(k, F.lit(1.0)), p(F.lit(2.0), k))))
    return tables.to_geojson(flags, "Polygon", "polygon", ["cell_id", "covered"]).select("feature")


@query("y1_verify_stream")
def y1(spark, d):
    """Requests replayed as a stream, a few files at a time; the rows of the batch audit."""
    p = Plans(spark, d)
    a = p.audit()
    source, sink = _fresh(spark, "y1-in"), _fresh(spark, "y1-out")
    a.requests.repartition(3).write.parquet(source)

    def check(batch):
        mine = Audit(a.cells, a.lockers, a.depots, p.measured_walks(), batch, *(t.join(batch.select(KEY, "plan_id"), [KEY, "plan_id"], "left_semi") for t in (a.sites, p_cells, p_supply, a.outages)), a.limit)
        return mine.verification(mine.errors()).withColumn("errors", F.array_join("errors", ","))

    from .bindings import once

    p_cells, p_supply = once(spark, d, "plan_cells", p.plan_cells), once(spark, d, "plan_supply", p.plan_supply)
    arriving = spark.readStream.schema(a.requests.schema).option("maxFilesPerTrigger", 2).parquet(source)
    streams.verify_stream(arriving, check, sink, _fresh(spark, "y1-check")).awaitTermination()
    return spark.read.parquet(sink).drop(KEY, "batch")


SQL["y1_verify_stream"] = SQL["v3_verify_plans"]


def _rocks(spark):
    """A session for keyed state: the store of its settings, with the caller's partitions."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    return session


#: Batches over which the pieces of a plan arrive, an hour apart.
SPREAD = 3


@query(
    "y1_plan_stream",
    f"""select plan_id, valid, errors, parcel_total, worst_walk_mm, longest_flight_mm, routes_checked from ({SQL['v3_verify_plans']}) where plan_id % 7 <> 3
    union all select distinct p, false, 'incomplete', null::bigint, null::bigint, null::bigint, null::bigint from (select o_orderkey % greatest(1, (select count(*) from customer) // 50) as p from orders) where p % 7 = 3""",
)
def y1_plans(spark, d):
    """Plans arrive in pieces over several batches, and every seventh one never becomes whole."""
    from .bindings import once

    p = Plans(spark, d)
    a, keep = p.audit(), lambda name, make: once(spark, d, name, make)
    mine = {"plan_sites": a.sites, "plan_cells": keep("plan_cells", p.plan_cells), "plan_supply": keep("plan_supply", p.plan_supply), "plan_outages": a.outages}
    rows = plan_streams.pieces(a.requests, **mine)
    lost = (F.col("plan_id") % 7 == 3) & (F.col("kind") == "announced")
    turn = F.pmod(F.xxhash64("plan_id", "kind", "x", "pos"), F.lit(SPREAD))
    rows = staged(rows.where(~lost).withColumn("turn", turn).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 3600)), "y1-pieces")
    # a late piece of a plan of its own lets the watermark pass the others
    tail = rows.limit(1).withColumns({"plan_id": F.lit(-1).cast("long"), "kind": F.lit("announced"), "n": F.lit(1).cast("long"), "ts": F.timestamp_seconds(F.lit(1_800_000_000))})
    source, sink, check, session = _fresh(spark, "y1p-in"), _fresh(spark, "y1p-out"), _fresh(spark, "y1p-check"), _rocks(spark)

    def verify(plans, tables):
        asked = a.requests.join(plans, [KEY, "plan_id"], "left_semi")
        audit = Audit(a.cells, a.lockers, a.depots, p.measured_walks(), asked, walk_limit_mm=a.limit, **tables)
        return audit.verification(audit.errors())

    parts = [part.drop("turn") for part in (*(rows.where(F.col("turn") == i) for i in range(SPREAD)), tail)]
    arriving = _arriving(session, source, parts[0].schema, _written(parts, source))
    plan_streams.verify_plan_stream(arriving, verify, sink, check, wait_ms=10 * 3_600_000).awaitTermination()
    found = spark.read.schema(plan_streams.RESULT).parquet(sink).where("plan_id >= 0")
    return found.withColumn("errors", F.array_join("errors", ",")).drop(KEY, "batch")


#: Slices of time in which events arrive.
SLICES = 4


def _written(parts, source) -> int:
    """Write the parts into ``source`` one after another, each by parallel tasks as equally many files, and give that
    number: a stream that takes so many files a batch takes a part a batch, in order. Only
    the last part may have fewer rows than that."""
    spark = parts[0].sparkSession
    # rows are dealt out in turn by each task: with so many rows one of the tasks at least has a row for every file
    most = min(p.count() // max(1, p.rdd.getNumPartitions()) for p in parts[:-1])
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), most))
    for part in parts:
        part.repartition(files).write.mode("append").parquet(source)
    return files


def _slices(events, tail) -> list:
    """The events' slices of time, and ``tail``. Batches follow the slices, so no row comes after a
    watermark that has passed it."""
    at = F.unix_micros("ts")
    cuts = sorted({int(x) for x in events.select(at.cast("double").alias("at")).approxQuantile("at", [i / SLICES for i in range(1, SLICES)], 0.01)})
    out = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        rows = events if high is None else events.where((at < high) | (at.isNull() if low is None else F.lit(False)))
        out.append(rows if low is None else rows.where(at >= low))
    return [*out, tail]


def _arriving(session, source, schema, files: int):
    return session.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)


@query(
    "y2_request_outcomes",
    """with q as (select * from events where event_type = 'view'), r as (select * from events where event_type = 'purchase'),
    j as (select q.event_id as request_id, r.event_id as result_id, r.ts, row_number() over (partition by q.event_id order by r.ts, r.event_id) as n from q left join r on r.user_id = q.user_id and r.ts >= q.ts and r.ts <= q.ts + interval 1 hour)
    select request_id, case when result_id is null then 'timeout' else 'feasible' end as outcome, result_id from j where n = 1""",
)
def y2(spark, d):
    e = City(spark, d).table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    # the events have no limit of their own: each request's is the hour of the SQL
    limit = 3_600_000 - streams.GRACE_MS
    source, sink, check = _fresh(spark, "y2-in"), _fresh(spark, "y2-out"), _fresh(spark, "y2-check")
    # a trailing pair of another key, in a later batch, lets the watermark pass the last request
    last = e.agg(F.max("ts").alias("ts"))
    tail = last.select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.explode(F.array(F.lit("view"), F.lit("purchase"))).alias("event_type"))
    arriving = _arriving(spark, source, e.schema, _written(_slices(staged(e, "y2-all"), tail), source))
    asked = arriving.where("event_type = 'view'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("request_id"), F.lit(limit).alias("timeout_ms"))
    given = arriving.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("result_id"), F.lit("feasible").alias("status"))
    joined = streams.request_outcomes(asked, given, limit)
    joined.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return streams.first_outcomes(spark.read.parquet(sink).where("key >= 0")).drop("key")


#: Events as messages: a client for each user, a generation every three days, every seventh message
#: from the one before. SQL goes through each client's messages one by one.
LIFECYCLE = """with recursive e as (
      select user_id as client_id, epoch_ms(date_trunc('second', ts)) as ms, event_id, epoch_ms(ts) // 259200000 - (event_id % 7 = 3)::bigint as generation,
        event_id % 3 as request_id, event_id % 30 * 3600000 as timeout_ms,
        case event_type when 'signup' then case when event_id % 4 = 0 then 'init' else 'ready' end when 'view' then 'solve' when 'purchase' then 'result' when 'click' then 'progress' when 'error' then case when event_id % 3 = 0 then 'cancel' else 'ready' end end as type
      from events),
    n as (select *, row_number() over (partition by client_id order by ms, event_id) as pos from e where client_id is not null and ms is not null and event_id is not null and type is not null),
    life as (
      select distinct client_id, 0::bigint as pos, -1::bigint as g, false as ready, -1::bigint as req, -1::bigint as dl, -1::bigint as heard,
        null::bigint as ms, null::bigint as own, null::bigint as request_id, -1::bigint as dl0, -1::bigint as g0, -1::bigint as req0, null::varchar as what from n
      union all
      select client_id, pos,
        case when what in ('timeout', 'start_error', 'cancelled') then g + 1 else g end,
        case when what = 'ready' then true when what in ('starting', 'cancelled') then false else ready end,
        case when what = 'solving' then request_id when what in ('finished', 'cancelled', 'starting') then -1 else req end,
        case what when 'starting' then ms + 60000 when 'solving' then ms + timeout_ms + 5000 when 'finished' then -1 when 'cancelled' then -1 when 'ready' then case when req < 0 then -1 else dl end else dl end,
        greatest(heard, own), ms, own, case when what = 'cancelled' then req when what in ('ready', 'starting') then -1 else request_id end, dl0, g0, req0, what
      from (select *, case when starting then 'starting' when stale then 'stale' when type = 'ready' then 'ready'
            when type = 'solve' then case when ready and req < 0 then 'solving' else 'rejected' end
            when type = 'result' then case when req >= 0 and req = request_id then 'finished' else 'ignored' end
            when type = 'progress' then case when req >= 0 and req = request_id then 'progress' else 'ignored' end
            when type = 'cancel' then case when req >= 0 then 'cancelled' else 'ignored' end end as what
          from (select client_id, pos, ms, own, request_id, type, timeout_ms, heard, dl0, g0, req0, starting, own < g and not starting as stale,
              case when starting or own > g then own else g end as g, ready and not starting and own <= g as ready, case when starting or own > g then -1 else req end as req, case when starting or own > g then -1 else dl end as dl
            from (select n.client_id, n.pos, n.ms, n.generation as own, n.request_id, n.type, n.timeout_ms, l.heard, n.type = 'init' and n.generation > l.heard as starting,
                case when x then l.dl else -1 end as dl0, l.g as g0, l.req as req0, case when x then l.g + 1 else l.g end as g, l.ready and not x as ready, case when x then -1 else l.req end as req, case when x then -1 else l.dl end as dl
              from life l join n on n.client_id = l.client_id and n.pos = l.pos + 1, lateral (select l.dl >= 0 and l.dl <= n.ms as x))))),
    told as (
      select client_id, ms, own as generation, request_id, what as transition from life where what is not null
      union all select client_id, dl0, g0, req0, case when req0 >= 0 then 'timeout' else 'start_error' end from life where dl0 >= 0
      union all select client_id, dl, g, req, case when req >= 0 then 'timeout' else 'start_error' end from life l where dl >= 0 and pos = (select max(pos) from life k where k.client_id = l.client_id))
    select client_id, make_timestamp_ms(ms) as ts, generation, request_id, transition from told"""


def messages(spark, d):
    """Events as messages of the life cycle, as in LIFECYCLE."""
    e = City(spark, d).table("events")
    kind, number = F.col("event_type"), F.col("event_id")
    kinds = F.when(kind == "signup", F.when(number % 4 == 0, "init").otherwise("ready")).when(kind == "view", "solve").when(kind == "purchase", "result")
    kinds = kinds.when(kind == "click", "progress").when(kind == "error", F.when(number % 3 == 0, "cancel").otherwise("ready"))
    stamp = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").alias("client_id"), F.date_trunc("second", stamp).alias("ts"), "event_id",
        (F.floor(F.unix_millis(stamp) / 259_200_000) - F.when(number % 7 == 3, 1).otherwise(0)).cast("long").alias("generation"),
        (number % 3).alias("request_id"), kinds.alias("type"), (number % 30 * 3_600_000).alias("timeout_ms"),
    )


@query("y3_lifecycle_batch", LIFECYCLE)
def y3_batch(spark, d):
    e = messages(spark, d)
    until = e.agg((F.unix_millis(F.max("ts")) + 10**9).alias("u")).first().u
    return lifecycle_table(e, until or 0)


@query("y3_request_lifecycle", LIFECYCLE)
def y3(spark, d):
    e = staged(messages(spark, d), "y3-in")
    source, sink, check = _fresh(spark, "y3-src"), _fresh(spark, "y3-out"), _fresh(spark, "y3-check")
    tail = e.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(F.lit(-1).cast("long").alias("client_id"), "ts", F.lit(-1).cast("long").alias("event_id"), F.lit(0).cast("long").alias("generation"), F.lit(0).cast("long").alias("request_id"), F.lit("progress").alias("type"), F.lit(0).cast("long").alias("timeout_ms"))
    session = _rocks(spark)
    out = streams.request_lifecycle(_arriving(session, source, e.schema, _written(_slices(e, tail), source)))
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).where("client_id >= 0")
