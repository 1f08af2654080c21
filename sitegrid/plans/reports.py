"""Reconciling two methods' answers, and the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.scalars import choose
from ..operators.coverage import assignment_space, choice_counts, coverage_masks, degree_summary
from ..operators.shortlist import greedy_shortlist, label_sites
from ..operators.spatial import bbox, nearest_nodes, pair_matrix
from .whatif import REQ, best_coverage, combinations, cover_within, resilience_audit, selection_space


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """(request, status_a, status_b, conclusion): agrees or disagrees where both are conclusive,
    inconclusive where either is not, or is missing."""
    left, right = a.select(*REQ, F.col("status").alias("status_a")), b.select(*REQ, F.col("status").alias("status_b"))
    sure = lambda c: F.coalesce(F.col(c).isin("feasible", "unsat"), F.lit(False))
    verdict = F.when(~sure("status_a") | ~sure("status_b"), "inconclusive").when(F.col("status_a") == F.col("status_b"), "agrees").otherwise("disagrees")
    return left.join(right, REQ, "full").withColumn("conclusion", verdict)


def complexity_report(cells, lockers, depots, walks, flights, limits: DataFrame) -> DataFrame:
    """One row for each region: sizes, degrees of choice, spaces, and the resilience boundary.

    ``limits(region_id, max_lockers, max_depots, flight_limit_mm)`` has a row for each region; the
    boundary is the audit of one depot less than its ``max_depots``.
    """
    count = lambda t, name: t.groupBy("region_id").agg(F.count(F.lit(1)).alias(name))
    near = flights.join(limits.select("region_id", "flight_limit_mm"), "region_id").where(F.col("return_mm") <= F.col("flight_limit_mm"))
    own = lockers.select("region_id", F.col("site_id").alias("locker_id"))
    degrees = lambda items, pairs, item, tag: (
        degree_summary(choice_counts(items, pairs, item)).select("region_id", *[F.col(c).alias(f"{tag}_{c}") for c in ("min", "median", "max", "total")])
        .join(assignment_space(choice_counts(items, pairs, item)).withColumnRenamed("log10_size", f"{tag}_log10_space"), "region_id")
    )
    sizes = count(cells, "cells").join(count(lockers, "lockers"), "region_id").join(count(depots, "depots"), "region_id")
    space = selection_space(sizes.join(limits, "region_id")).withColumnRenamed("size", "selections")
    out = sizes.join(space, "region_id").join(degrees(cells, walks, "cell_id", "walk"), "region_id").join(degrees(own, near, "locker_id", "supply"), "region_id")
    fewer = limits.select("region_id", (F.col("max_depots") - 1).alias("k"))
    edge = best_coverage(resilience_audit(cells, lockers, depots, walks, flights, fewer, limits))
    return out.join(edge.select("region_id", F.col("sets").alias("reduced_sets"), F.col("full_sets").alias("reduced_full"), F.col("best").alias("reduced_best")), "region_id", "left")


#: Extra depots of an expansion: name, and offset in mm from the centre of the demand.
TARGETS = (("Central-West", -300_000, 0), ("Central-East", 300_000, 0))


def expansion_report(cells, nodes, depots, reach, walk_need: int, spacing_mm: int, flight_limit_mm: int, budget: int, targets=TARGETS, kept: DataFrame | None = None, sizes=(3, 4)) -> dict:
    """An expansion of every region, as tables.

    ``lockers``: the shortlist with labels, cells and depots in reach. ``depots``: the existing ones
    (those in ``kept(region_id, site_id)``, if given) and the ``extra`` ones, the free nodes
    nearest to ``targets``. For each number of depots in ``sizes``: ``audit``, ``witness`` (a cover of
    all cells within the budget by lockers that keep two depots in range, or null) and
    ``selections``, how many exact selections of that size and of ``budget`` lockers there are.
    """
    steps, status = greedy_shortlist(reach, nodes, cells, walk_need, spacing_mm)
    at = nodes.select("region_id", "node_id", "x_mm", "y_mm")
    lockers = label_sites(steps).join(at, ["region_id", "node_id"]).withColumn("site_id", F.col("node_id"))
    place = cells.select("region_id", "cell_id", "node_id").join(at, ["region_id", "node_id"])
    if kept is not None:
        depots = depots.join(kept.select("region_id", "site_id"), ["region_id", "site_id"], "left_semi")
    sides = F.array(*[F.struct(F.lit(name).alias("t"), F.lit(i).alias("o"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (name, dx, dy) in enumerate(targets)])
    wanted = bbox(place).select("region_id", "centre_x", "centre_y", F.explode(sides).alias("s"))
    wanted = wanted.select("region_id", F.col("s.t").alias("target_id"), F.col("s.o").alias("ord"), F.floor(F.col("centre_x") + F.col("s.dx")).alias("x_mm"), F.floor(F.col("centre_y") + F.col("s.dy")).alias("y_mm"))
    extra = nearest_nodes(wanted, nodes, depots).join(at, ["region_id", "node_id"])
    both = depots.select("region_id", "site_id", "x_mm", "y_mm").unionByName(extra.select("region_id", (F.lit(1_000_000) + F.col("ord")).cast("long").alias("site_id"), "x_mm", "y_mm"))
    both = numbered(both, "region_id", ["site_id"], "ord").withColumn("ord", F.col("ord").cast("int"))
    flights = pair_matrix(lockers, both)
    walks = reach.join(lockers.select("region_id", "node_id", F.col("site_id").alias("locker_id")), ["region_id", "node_id"]).select("region_id", "cell_id", "locker_id", "distance_mm")
    reachable = flights.where(F.col("return_mm") <= flight_limit_mm).groupBy("region_id", "locker_id").agg(F.count(F.lit(1)).alias("depots_in_reach"))
    walked = walks.groupBy("region_id", "locker_id").agg(F.countDistinct("cell_id").alias("cells_in_reach"))
    listed = lockers.join(reachable.join(walked, ["region_id", "locker_id"], "full").withColumnRenamed("locker_id", "site_id"), ["region_id", "site_id"], "left").na.fill(0, ["depots_in_reach", "cells_in_reach"])
    n = lambda t, name: t.groupBy("region_id").agg(F.count(F.lit(1)).alias(name))
    spaces = n(lockers, "lockers").join(n(both, "depots"), "region_id").withColumns({"max_lockers": F.lit(budget), "max_depots": F.explode(F.array(*[F.lit(k) for k in sizes]))})
    c = lambda a, b: choose(F.col(a).cast("long"), F.col(b).cast("long"))
    spaces = spaces.select("region_id", F.col("max_depots").alias("k"), (c("lockers", "max_lockers") * c("depots", "max_depots")).alias("size"))
    return {
        "lockers": listed, "status": status, "depots": both, "extra": extra, "selections": spaces,
        "audit": {k: resilience_audit(cells, lockers, both, walks, flights, k, flight_limit_mm) for k in sizes},
        "witness": {k: witnesses(cells, lockers, both, walks, flights, k, flight_limit_mm, budget) for k in sizes},
    }


def witnesses(cells, lockers, depots, walks, flights, k: int, limit_mm: int, budget: int) -> DataFrame:
    """(region_id, ordinal, depots, witness): for every k-subset of depots a cover of all cells by
    at most ``budget`` lockers that keep two of the depots in range, or null."""
    near = flights.where(F.col("return_mm") <= limit_mm).select("region_id", "locker_id", "depot_id")
    sets = combinations(depots, k).select("region_id", "ordinal", F.col("members").alias("depots"))
    robust = sets.select("region_id", "ordinal", F.explode("depots").alias("depot_id")).join(near, ["region_id", "depot_id"]).groupBy("region_id", "ordinal", "locker_id").count().where("count >= 2").drop("count")
    placed = numbered(cells.select("region_id", "cell_id"), "region_id", ["cell_id"], "ord")
    masks = coverage_masks(walks, cells)
    # every depot set is a region of its own to the cover search
    as_region = F.concat_ws("|", F.col("region_id").cast("string"), F.col("ordinal").cast("string"))
    own = sets.select("region_id", "ordinal").withColumn("_k", as_region)
    cover = cover_within(
        robust.join(masks, ["region_id", "locker_id"]).select(as_region.alias("region_id"), F.col("locker_id").alias("site_id"), "word", "mask"),
        own.join(placed, "region_id").select(F.col("_k").alias("region_id"), "ord"),
        budget,
    )
    return sets.withColumn("_k", as_region).join(cover.withColumnRenamed("region_id", "_k"), "_k").drop("_k")


def result_summary(results: DataFrame, verification: DataFrame, plan_sites: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, status, summary): sites, parcels and scope in words."""
    key = ["region_id", "plan_id"]
    n = plan_sites.groupBy(*key).agg(F.count_if(F.col("kind") == "locker").alias("lockers"), F.count_if(F.col("kind") == "depot").alias("depots"))
    v = verification.select(*key, "parcel_total", "routes_checked").join(n.hint("merge"), key).withColumnRenamed("plan_id", "request_id")
    scope = F.when(F.col("fixed_lockers").isNotNull() | F.col("fixed_depots").isNotNull(), "this selection").otherwise("any selection of the candidates")
    rows = results.join(requests.select(*REQ, scope.alias("scope")).hint("merge"), REQ).join(v.hint("merge"), REQ, "left")
    done = F.concat_ws(" · ", F.format_string("%d lockers", "lockers"), F.format_string("%d depots", "depots"), F.format_string("%d parcels", "parcel_total"), F.format_string("%d walks checked", "routes_checked"))
    text = (
        F.when(F.col("status") == "feasible", done)
        .when(F.col("status") == "unsat", F.concat(F.lit("no network with "), F.col("scope")))
        .when(F.col("status").isin("timeout", "cancelled"), F.lit("no conclusion"))
        .otherwise(F.lit("not verified"))
    )
    return rows.select(*REQ, "status", text.alias("summary"))
