"""Distances and ranges between sites. Range joins are equi-joins on grid buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up, return_mm
from ..functions.numbering import numbered
from ..functions.staging import staged

KEY = "region_id"


def _named(sites: DataFrame, side: str) -> DataFrame:
    return sites.select(KEY, F.col("site_id").alias(f"{side}_id"), F.col("x_mm").alias(f"{side}_x"), F.col("y_mm").alias(f"{side}_y"))


def pair_matrix(lockers: DataFrame, depots: DataFrame) -> DataFrame:
    """Every locker with every depot of its region, and the return distance: the full matrix is
    the result, so its size is the product of the two lists."""
    both = _named(lockers, "locker").join(_named(depots, "depot"), KEY)
    return both.select(KEY, "locker_id", "depot_id", return_mm(F.col("locker_x"), F.col("locker_y"), F.col("depot_x"), F.col("depot_y")).alias("return_mm"))


def _cells(x: str, y: str, width: int) -> tuple[Column, Column]:
    return F.floor(F.col(x) / F.lit(width)), F.floor(F.col(y) / F.lit(width))


def _near(df: DataFrame, x: str, y: str, width: int) -> DataFrame:
    """Each row at its bucket and the eight around it."""
    gx, gy = _cells(x, y, width)
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    return df.withColumns({"_gx": F.explode(F.transform(step, lambda k: gx + k))}).withColumns({"_gy": F.explode(F.transform(step, lambda k: gy + k))})


def pairs_within(a: DataFrame, b: DataFrame, limit_mm: int) -> DataFrame:
    """Pairs whose return distance is at most the limit (inclusive)."""
    width = limit_mm // 2 + 1  # the limit is there and back
    left = _near(_named(a, "locker"), "locker_x", "locker_y", width)
    gx, gy = _cells("depot_x", "depot_y", width)
    right = _named(b, "depot").withColumns({"_gx": gx, "_gy": gy})
    far = return_mm(F.col("locker_x"), F.col("locker_y"), F.col("depot_x"), F.col("depot_y"))
    return _met(left, right).select(KEY, "locker_id", "depot_id", far.alias("return_mm")).where(F.col("return_mm") <= limit_mm)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that share a bucket. Both sides are dealt out: a table's estimated size knows neither of the
    copies around a bucket nor of its compression, and must not make a broadcast of it."""
    return left.hint("merge").join(right, [KEY, "_gx", "_gy"])


def spacing_conflicts(sites: DataFrame, spacing_mm: int) -> DataFrame:
    """Pairs of sites strictly closer than the spacing, in exact integers. Of two buckets that touch one
    looks into the other, so a pair is met once."""
    gx, gy = _cells("a_x", "a_y", spacing_mm)
    ahead = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = _named(sites, "a").withColumn("_step", F.explode(ahead))
    left = left.select(KEY, "a_id", "a_x", "a_y", (gx + F.col("_step.x")).alias("_gx"), (gy + F.col("_step.y")).alias("_gy"), ((F.col("_step.x") == 0) & (F.col("_step.y") == 0)).alias("_own"))
    gx, gy = _cells("b_x", "b_y", spacing_mm)
    right = _named(sites, "b").withColumns({"_gx": gx, "_gy": gy})
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    once = (F.col("a_id") < F.col("b_id")) | (~F.col("_own") & (F.col("a_id") > F.col("b_id")))
    near = _met(left, right).where(once & (dx * dx + dy * dy < F.lit(spacing_mm) * F.lit(spacing_mm).cast("long")))
    return near.select(KEY, F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))


def nearest_nodes(targets: DataFrame, nodes: DataFrame, exclude: DataFrame, width: int = 200_000) -> DataFrame:
    """(region_id, target_id, ord, node_id, offset_mm): each target's nearest free node.

    Ties go to the smaller rounded offset, then the smaller node. Targets of a region are served
    in the order of ``ord``, each taking its node away from the later ones; where there are fewer
    nodes than targets, the last ones get none. All targets ask at once: a node goes to the
    first of those who ask, the others ask again for one that no earlier target holds. So the
    rounds follow the length of such chains, not the number of targets.
    """
    free = staged(nodes.join(exclude.select(KEY, "node_id"), [KEY, "node_id"], "left_anti").select(KEY, "node_id", "x_mm", "y_mm"), "near-free")
    n = free.groupBy(KEY).agg(F.count(F.lit(1)).alias("_nodes"))
    turns = numbered(targets.select(KEY, "target_id", "ord", "x_mm", "y_mm"), KEY, ["ord", "target_id"], "_turn").withColumn("_turn", (F.col("_turn") + 1).cast("int"))
    asked = turns.join(n, KEY).where(F.col("_turn") <= F.col("_nodes")).drop("_nodes")
    asked = staged(asked, "near-targets")
    out = [KEY, "target_id", "ord", "_turn", "node_id", "offset_mm"]
    held, open_ = None, asked
    while not open_.isEmpty():
        holders = free.select(KEY, "node_id", F.lit(None).cast("int").alias("_by")).limit(0) if held is None else held.select(KEY, "node_id", F.col("_turn").alias("_by"))
        found = _nearest(open_, free.join(holders, [KEY, "node_id"], "left"), width)
        both = staged(found if held is None else held.unionByName(found), "near-asked")
        best = both.groupBy(KEY, "node_id").agg(F.min(F.struct("_turn", "target_id", "ord", "offset_mm")).alias("m"))
        held = staged(best.select(KEY, "m.target_id", "m.ord", "m._turn", "node_id", "m.offset_mm").select(*out), "near-held")
        open_ = staged(asked.join(held.select(KEY, "_turn"), [KEY, "_turn"], "left_anti").select(*asked.columns), "near-open")
    if held is None:
        return asked.join(free.select(KEY, "node_id"), KEY).select(KEY, "target_id", "ord", "node_id", F.lit(0).cast("long").alias("offset_mm")).limit(0)
    return held.drop("_turn")


def _nearest(targets: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Each target's nearest node of those that no earlier one holds (``_by``). A target looks into
    its grid bucket and the eight around it, of a width that doubles until the best offset found
    is below it."""
    turn, done = targets, None
    while True:
        gx, gy = _cells("x_mm", "y_mm", width)
        bucketed = nodes.select(KEY, "node_id", "_by", F.col("x_mm").alias("_nx"), F.col("y_mm").alias("_ny"), gx.alias("_gx"), gy.alias("_gy"))
        dx, dy = (F.col("x_mm") - F.col("_nx")).cast("double"), (F.col("y_mm") - F.col("_ny")).cast("double")
        offset = half_up(F.sqrt(dx * dx + dy * dy))
        met = _met(_near(turn, "x_mm", "y_mm", width), bucketed).where(F.col("_by").isNull() | (F.col("_by") > F.col("_turn")))
        best = met.groupBy(KEY, "target_id", "ord", "_turn").agg(F.min(F.struct(offset.alias("offset_mm"), "node_id")).alias("m"))
        # nothing outside the nine buckets is nearer than one width
        sure = staged(best.where(F.col("m.offset_mm") < width).select(KEY, "target_id", "ord", "_turn", "m.node_id", "m.offset_mm"), "near-sure")
        done = sure if done is None else done.unionByName(sure)
        turn = staged(turn.join(sure.select(KEY, "_turn"), [KEY, "_turn"], "left_anti").select(*turn.columns), "near-turn")
        if turn.isEmpty():
            return done
        width *= 2


def bbox(cells: DataFrame) -> DataFrame:
    """Extent and centre of each region's demand."""
    e = cells.groupBy(KEY).agg(F.min("x_mm").alias("min_x"), F.max("x_mm").alias("max_x"), F.min("y_mm").alias("min_y"), F.max("y_mm").alias("max_y"))
    return e.withColumns({"centre_x": (F.col("min_x") + F.col("max_x")) / 2, "centre_y": (F.col("min_y") + F.col("max_y")) / 2})
