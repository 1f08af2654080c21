"""Greedy multi-cover shortlists with spacing, in parallel rounds, and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.scalars import letters
from ..functions.staging import dealt as staged

KEY = "region_id"


def _scores(reach: DataFrame, counts: DataFrame, need: int) -> DataFrame:
    """Per node: -gain and worst useful walk over the cells that still need a choice."""
    short = counts.where(F.col("have") < need).select(KEY, "cell_id")
    useful = reach.join(short, [KEY, "cell_id"], "left_semi")
    return useful.groupBy(KEY, "node_id").agg((-F.count(F.lit(1))).alias("loss"), F.max("distance_mm").alias("worst"))


def best_site(reach: DataFrame, counts: DataFrame, need: int, nodes: DataFrame | None = None, selected: DataFrame | None = None, spacing_mm: int = 0) -> DataFrame:
    """The next pick of each region: most cells helped, then shortest worst walk, then node id.

    ``counts(region_id, cell_id, have)``; nodes strictly closer than the spacing to a selected
    one are out.
    """
    scores = _scores(reach, counts, need)
    if selected is not None:
        at = scores.join(nodes.select(KEY, "node_id", "x_mm", "y_mm"), [KEY, "node_id"])
        scores = at.join(_too_close(at, selected.join(nodes, [KEY, "node_id"]), spacing_mm), [KEY, "node_id"], "left_anti")
    best = scores.groupBy(KEY).agg(F.min(F.struct("loss", "worst", "node_id")).alias("m"))
    return best.select(KEY, "m.node_id", (-F.col("m.loss")).alias("gain"), F.col("m.worst").alias("worst_mm"))


def _bucket(c: str, width: int):
    return F.floor(F.col(c) / F.lit(max(1, width)))


def _around(df: DataFrame, width: int) -> DataFrame:
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return df.withColumn("_bx", F.explode(F.transform(step, lambda k: _bucket("x_mm", width) + k))).withColumn("_by", F.explode(F.transform(step, lambda k: _bucket("y_mm", width) + k)))


def _too_close(at: DataFrame, selected: DataFrame, spacing_mm: int) -> DataFrame:
    chosen = _around(selected.select(KEY, "x_mm", "y_mm"), spacing_mm).select(KEY, "_bx", "_by", F.col("x_mm").alias("_sx"), F.col("y_mm").alias("_sy"))
    here = at.select(KEY, "node_id", "x_mm", "y_mm", _bucket("x_mm", spacing_mm).alias("_bx"), _bucket("y_mm", spacing_mm).alias("_by"))
    dx, dy = F.col("x_mm") - F.col("_sx"), F.col("y_mm") - F.col("_sy")
    near = here.join(chosen, [KEY, "_bx", "_by"]).where(dx * dx + dy * dy < F.lit(spacing_mm).cast("long") * F.lit(spacing_mm))
    return near.select(KEY, "node_id").distinct()


def greedy_shortlist(reach: DataFrame, nodes: DataFrame, cells: DataFrame, need: int, spacing_mm: int) -> tuple[DataFrame, DataFrame]:
    """(steps, status): the picks in order, and for each region whether every cell has ``need``.

    A pick changes the keys (gain, worst walk, id) only of nodes that share a cell with it or
    lie within the spacing, and keys only get worse. So every node that beats all its
    conflict neighbours would be the next pick among them one at a time too: a round picks
    all such local winners, and sorting by key gives the one-at-a-time order. Dominance is two
    minima, by shared cell and by spacing neighbourhood; node pairs are never formed.
    """
    counts = staged(cells.select(KEY, "cell_id").distinct().withColumn("have", F.lit(0).cast("long")), "greedy-have")
    nodes = staged(nodes.select(KEY, "node_id", "x_mm", "y_mm"), "greedy-nodes")
    alive = staged(reach.join(nodes, [KEY, "node_id"]), "greedy-alive")
    steps = None
    while True:
        key = F.struct("loss", "worst", "node_id")
        scores = staged(_scores(alive, counts, need).join(nodes, [KEY, "node_id"]).withColumn("key", key), "greedy-score")
        if scores.isEmpty():
            break
        # a picked node raises the count of every cell it reaches, so all shared cells conflict
        by_cell = alive.select(KEY, "node_id", "cell_id").join(scores.select(KEY, "node_id", "key"), [KEY, "node_id"])
        cell_best = by_cell.groupBy(KEY, "cell_id").agg(F.min("key").alias("c"))
        beaten = by_cell.join(cell_best, [KEY, "cell_id"]).where(F.col("c") < F.col("key")).select(KEY, "node_id")
        spots = _around(scores.select(KEY, "x_mm", "y_mm", "key"), spacing_mm).groupBy(KEY, "_bx", "_by").agg(F.min("key").alias("s"))
        here = scores.select(KEY, "node_id", "key", _bucket("x_mm", spacing_mm).alias("_bx"), _bucket("y_mm", spacing_mm).alias("_by"))
        close = here.join(spots, [KEY, "_bx", "_by"]).where(F.col("s") < F.col("key")).select(KEY, "node_id")
        won = staged(scores.join(beaten.union(close).distinct(), [KEY, "node_id"], "left_anti"), "greedy-won")
        picks = won.select(KEY, "loss", "worst", "node_id")
        steps = picks if steps is None else steps.unionByName(picks)
        more = alive.join(picks.select(KEY, "node_id"), [KEY, "node_id"], "left_semi").groupBy(KEY, "cell_id").agg(F.count(F.lit(1)).alias("_more"))
        counts = staged(counts.join(more, [KEY, "cell_id"], "left").select(KEY, "cell_id", (F.col("have") + F.coalesce("_more", F.lit(0))).alias("have")), "greedy-have")
        gone = _too_close(alive.select(KEY, "node_id", "x_mm", "y_mm").distinct(), won, spacing_mm).union(picks.select(KEY, "node_id"))
        alive = staged(alive.join(gone.distinct(), [KEY, "node_id"], "left_anti"), "greedy-alive")
    status = counts.groupBy(KEY).agg(F.min("have").alias("fewest")).withColumn("complete", F.col("fewest") >= need)
    if steps is None:
        empty = reach.select(KEY, F.lit(0).alias("ord"), "node_id", F.lit(0).cast("long").alias("gain"), F.col("distance_mm").alias("worst_mm")).limit(0)
        return empty, status
    placed = numbered(steps, KEY, ["loss", "worst", "node_id"], "ord")
    return placed.select(KEY, F.col("ord").cast("int").alias("ord"), "node_id", (-F.col("loss")).alias("gain"), F.col("worst").alias("worst_mm")), status


def diff_shortlist(steps: DataFrame, stored: DataFrame) -> DataFrame:
    """Positions at which the replayed and the stored shortlist differ."""
    a = steps.select(KEY, "ord", F.col("node_id").alias("replayed"))
    b = stored.select(KEY, "ord", F.col("node_id").alias("stored"))
    return a.join(b, [KEY, "ord"], "full").where(~F.col("replayed").eqNullSafe(F.col("stored")))


def label_sites(steps: DataFrame) -> DataFrame:
    return steps.withColumn("label", letters(F.col("ord") + 1))


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """A stable order by identifiers in collation order."""
    return df.orderBy(*[F.collate(F.col(k).cast("string"), "UNICODE") for k in keys])
