"""Directed road graphs: integrity, bounded shortest paths, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_safe_integer
from ..functions.staging import Bucketed, Grown, staged

KEY = "region_id"


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_id, check, entity): repeated ids, dangling ends, lengths that are not positive integers."""
    row = lambda df, check, entity: df.select(KEY, F.lit(check).alias("check"), F.col(entity).cast("string").alias("entity"))
    twice = lambda df, c: df.groupBy(KEY, c).count().where("count > 1")
    ends = nodes.select(KEY, "node_id")
    loose = lambda c: edges.join(ends.withColumnRenamed("node_id", c), [KEY, c], "left_anti")
    bad = edges.where(F.col("length_mm").isNull() | (F.col("length_mm") <= 0) | ~is_safe_integer(F.col("length_mm")))
    return (
        row(twice(nodes, "node_id"), "duplicate_node", "node_id")
        .unionByName(row(twice(edges, "edge_id"), "duplicate_edge", "edge_id"))
        .unionByName(row(loose("src"), "dangling_src", "edge_id"))
        .unionByName(row(loose("dst"), "dangling_dst", "edge_id"))
        .unionByName(row(bad, "bad_length", "edge_id"))
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """(region_id, src, out): outgoing edges of a node in collation order of their ids."""
    link = F.struct(F.collate(F.col("edge_id"), "UNICODE").alias("k"), "edge_id", "dst", "length_mm")
    out = edges.groupBy(KEY, "src").agg(F.sort_array(F.collect_list(link)).alias("l"))
    return out.select(KEY, "src", F.transform("l", lambda x: F.struct(x["edge_id"].alias("edge_id"), x["dst"].alias("dst"), x["length_mm"].alias("length_mm"))).alias("out"))


def bounded_paths(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """(region_id, origin, node_id, dist_mm, pred_edge, pred_src): all nodes within each origin's budget, with the
    last edge of a shortest path and where that edge starts.

    ``origins(region_id, origin, node_id, budget_mm)``; the budget is inclusive, unreachable
    nodes are absent. The frontier moves one edge a round; only strict improvements are written and
    go on (lengths are positive, see ``check_graph``), so rounds are bounded by the hops that a budget allows and a round writes and shuffles no
    more than its frontier: distances found before lie in buckets by (origin, node). Of predecessors that give the same
    distance, the smallest edge id is kept.
    """
    key = [KEY, "origin", "node_id"]
    fresh = origins.where(F.col("budget_mm") >= 0).groupBy(*key).agg(F.max("budget_mm").alias("budget_mm"))
    fresh = staged(fresh.withColumn("dist_mm", F.lit(0).cast("long")), "path-frontier")
    # an edge longer than every budget is on no path
    most = fresh.agg(F.max("budget_mm")).first()[0]
    links = staged(edges.where(F.col("length_mm") <= F.lit(most)).select(KEY, "edge_id", "src", "dst", "length_mm"), "path-links")
    found = Bucketed(edges.sparkSession, "path_found", key)
    while True:
        found.add(fresh.select(*key, "dist_mm"))
        if fresh.isEmpty():
            break
        fresh = staged(_next_hop(fresh, links, found), "path-frontier")
    best = staged(found.all().groupBy(*key).agg(F.min("dist_mm").alias("dist_mm")), "path-best")
    found.close()
    near = best.select(KEY, "origin", F.col("node_id").alias("src"), F.col("dist_mm").alias("_d"))
    into = near.join(links, [KEY, "src"]).select(KEY, "origin", F.col("dst").alias("node_id"), (F.col("_d") + F.col("length_mm")).alias("dist_mm"), "edge_id", "src")
    pred = into.where(F.col("dist_mm") <= F.lit(most)).groupBy(KEY, "origin", "node_id", "dist_mm").agg(F.min(F.struct("edge_id", "src")).alias("p"))
    moved = F.col("dist_mm") > 0
    out = best.join(pred, [KEY, "origin", "node_id", "dist_mm"], "left")
    return out.select(*key, "dist_mm", F.when(moved, F.col("p.edge_id")).alias("pred_edge"), F.when(moved, F.col("p.src")).alias("pred_src"))


def _next_hop(fresh: DataFrame, links: DataFrame, found: Bucketed) -> DataFrame:
    """What one more edge reaches, where it is shorter than all distances found so far: these are dealt out by
    their key already, so only the frontier moves."""
    key = [KEY, "origin", "node_id"]
    step = fresh.join(links, (fresh[KEY] == links[KEY]) & (fresh["node_id"] == links["src"])).select(fresh[KEY], "origin", F.col("dst").alias("node_id"), "budget_mm", (F.col("dist_mm") + F.col("length_mm")).alias("dist_mm"))
    step = step.where(F.col("dist_mm") <= F.col("budget_mm")).groupBy(*key).agg(F.max("budget_mm").alias("budget_mm"), F.min("dist_mm").alias("dist_mm"))
    old = found.all().select(*[F.col(c).alias(f"_{c}") for c in (*key, "dist_mm")])
    known = (F.col(KEY) == F.col(f"_{KEY}")) & (F.col("origin") == F.col("_origin")) & (F.col("node_id") == F.col("_node_id")) & (F.col("_dist_mm") <= F.col("dist_mm"))
    return step.join(old, known, "left_anti").select(*fresh.columns)


def route_edges(paths: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(region_id, origin, target, edge_ids, ok): the edges from an origin to each target node,
    followed back over the predecessors of all targets at once. ``targets(region_id, origin,
    target)``; a target that the paths do not reach has a null route and ok = false."""
    back = paths.select(KEY, "origin", F.col("node_id").alias("at"), "dist_mm", "pred_edge", *[F.col(c).alias("_src") for c in ("pred_src",) if c in paths.columns])
    if "_src" not in back.columns:
        link = edges.select(KEY, F.col("edge_id").alias("pred_edge"), F.col("src").alias("_src"))
        back = back.join(link, [KEY, "pred_edge"], "left")
    back = staged(back, "route-back")
    steps, hop = Grown(paths.sparkSession, "route-steps"), 0
    at = targets.select(KEY, "origin", "target", F.col("target").alias("at"))
    while True:
        # a row for each route and hop, whatever its length
        here = at.join(back, [KEY, "origin", "at"], "left")
        here = steps.add(here.select(KEY, "origin", "target", F.lit(hop).alias("hop"), "dist_mm", "pred_edge", "_src"))
        going = here.where("pred_edge is not null")
        if going.isEmpty():
            break
        at, hop = going.select(KEY, "origin", "target", F.col("_src").alias("at")), hop + 1
    edge = F.when(F.col("pred_edge").isNotNull(), F.struct((-F.col("hop")).alias("back"), F.col("pred_edge").alias("edge_id")))
    routes = steps.all().groupBy(KEY, "origin", "target").agg(F.sort_array(F.collect_list(edge)).alias("l"), F.bool_or(F.col("pred_edge").isNull() & F.coalesce(F.col("dist_mm") == 0, F.lit(False))).alias("ok"))
    return routes.select(KEY, "origin", "target", F.when(F.col("ok"), F.transform("l", lambda e: e["edge_id"])).alias("edge_ids"), "ok")


def measure_routes(walks: DataFrame, cells: DataFrame, lockers: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_id, cell_id, locker_id, measured_mm, ok): supplied routes recomputed.

    A route must start at the cell's node, follow directed edges without a gap and end at the
    locker's node; its length is the connector and its edges. An empty route is one node.
    """
    start = cells.select(KEY, "cell_id", F.col("node_id").alias("_from"), "connector_mm")
    end = lockers.select(KEY, F.col("site_id").alias("locker_id"), F.col("node_id").alias("_to"))
    base = walks.select(KEY, "cell_id", "locker_id", "edge_ids").join(start, [KEY, "cell_id"], "left").join(end, [KEY, "locker_id"], "left")
    steps = base.select(KEY, "cell_id", "locker_id", "_from", "_to", "connector_mm", F.posexplode_outer("edge_ids").alias("pos", "edge_id"))
    steps = steps.join(edges.select(KEY, "edge_id", "src", "dst", "length_mm"), [KEY, "edge_id"], "left")
    order = Window.partitionBy(KEY, "cell_id", "locker_id").orderBy("pos")
    before = F.when(F.col("pos") == 0, F.col("_from")).otherwise(F.lag("dst").over(order))
    steps = steps.withColumn("_joins", F.col("pos").isNull() | F.coalesce(F.col("src") == before, F.lit(False)))
    seen = steps.groupBy(KEY, "cell_id", "locker_id", "_from", "_to", "connector_mm").agg(
        F.bool_and("_joins").alias("_whole"), F.coalesce(F.sum("length_mm"), F.lit(0)).alias("_length"), F.max_by("dst", "pos").alias("_last"), F.count("pos").alias("_n")
    )
    arrived = F.when(F.col("_n") == 0, F.col("_from")).otherwise(F.col("_last")).eqNullSafe(F.col("_to")) & F.col("_to").isNotNull()
    return seen.select(KEY, "cell_id", "locker_id", (F.col("connector_mm") + F.col("_length")).alias("measured_mm"), (F.col("_whole") & arrived & F.col("_from").isNotNull()).alias("ok"))


def catchments(cells: DataFrame, edges: DataFrame, limit_mm: int) -> DataFrame:
    """(region_id, node_id, cell_id, distance_mm): the cells that reach a node within the limit,
    connector included. Paths run once from each distinct snap node, on its largest budget."""
    starts = cells.groupBy(KEY, "node_id").agg((F.lit(limit_mm) - F.min("connector_mm")).cast("long").alias("budget_mm"))
    paths = bounded_paths(edges, starts.withColumn("origin", F.col("node_id")))
    own = cells.select(KEY, F.col("node_id").alias("origin"), "cell_id", "connector_mm")
    out = paths.join(own.hint("merge"), [KEY, "origin"]).select(KEY, "node_id", "cell_id", (F.col("dist_mm") + F.col("connector_mm")).alias("distance_mm"))
    return out.where(F.col("distance_mm") <= limit_mm)


def route_geometry(walks: DataFrame, cells: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_id, cell_id, locker_id, line): cell point, node point, then the edges' points."""
    point = F.array(F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat")))
    cell = cells.select(KEY, "cell_id", "node_id", point.alias("_cell"))
    node = nodes.select(KEY, "node_id", point.alias("_node"))
    steps = walks.select(KEY, "cell_id", "locker_id", F.posexplode_outer("edge_ids").alias("pos", "edge_id")).join(edges.select(KEY, "edge_id", "coordinates"), [KEY, "edge_id"], "left")
    parts = steps.groupBy(KEY, "cell_id", "locker_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "coordinates")))).alias("_parts"))
    out = parts.join(cell, [KEY, "cell_id"]).join(node, [KEY, "node_id"])
    return out.select(KEY, "cell_id", "locker_id", F.concat("_cell", "_node", F.flatten(F.transform("_parts", lambda p: F.coalesce(p["coordinates"], F.array().cast("array<struct<lon:double,lat:double>>"))))).alias("line"))
