"""Normalising source tables: filters, integer millimetres, demand, referential joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import demand, straight_mm, to_mm, utm

KEY = "region_id"


def filter_edges(raw: DataFrame, mode: str = "walking") -> DataFrame:
    """Edges whose ``permissions`` allow ``mode``; other columns stay."""
    return raw.where(F.col(f"permissions.{mode}")).drop("permissions")


def lengths_to_mm(edges: DataFrame, metres: str = "length_m") -> DataFrame:
    return edges.withColumn("length_mm", to_mm(F.col(metres))).drop(metres)


def project_utm(df: DataFrame, lon: str = "lon", lat: str = "lat", zone: int = 35) -> DataFrame:
    """Adds x_mm and y_mm, projected and rounded."""
    east, north = utm(F.col(lon), F.col(lat), zone)
    return df.withColumns({"x_mm": to_mm(east), "y_mm": to_mm(north)})


def derive_demand(cells: DataFrame, per: int = 10) -> DataFrame:
    return cells.withColumn("parcels", demand(F.col("population"), per))


def connectors(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds connector_mm, the straight line from a cell's point to its node."""
    n = nodes.select(KEY, "node_id", F.col("x_mm").alias("_x"), F.col("y_mm").alias("_y"))
    return cells.join(n, [KEY, "node_id"], "left").withColumn("connector_mm", straight_mm(F.col("x_mm"), F.col("y_mm"), F.col("_x"), F.col("_y"))).drop("_x", "_y")


def attach_nodes(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds x_mm, y_mm of each site's node and ``missing``; sites keep their own coordinates
    under frozen_x, frozen_y if they bring x_mm and y_mm, with ``moved`` telling whether they differ."""
    n = nodes.select(KEY, "node_id", F.col("x_mm").alias("_x"), F.col("y_mm").alias("_y"))
    out = sites.join(n, [KEY, "node_id"], "left").withColumn("missing", F.col("_x").isNull())
    if "x_mm" in sites.columns:
        out = out.withColumnsRenamed({"x_mm": "frozen_x", "y_mm": "frozen_y"})
        out = out.withColumn("moved", ~(F.col("frozen_x").eqNullSafe(F.col("_x")) & F.col("frozen_y").eqNullSafe(F.col("_y"))))
    return out.withColumnsRenamed({"_x": "x_mm", "_y": "y_mm"})


def reconcile_population(cells: DataFrame, source: DataFrame) -> DataFrame:
    """Cells whose population is not the source's, or that the source lacks."""
    s = source.select(KEY, "cell_id", F.col("population").alias("source_population"), F.lit(True).alias("_in"))
    both = cells.select(KEY, "cell_id", "population").join(s, [KEY, "cell_id"], "left")
    return both.where(F.col("_in").isNull() | ~F.col("population").eqNullSafe(F.col("source_population"))).drop("_in")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(KEY, F.col("src").alias("node_id")).union(edges.select(KEY, F.col("dst").alias("node_id"))).distinct()


def prune_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge touches."""
    return nodes.join(endpoints(edges), [KEY, "node_id"], "left_semi")


def check_ids(df: DataFrame, column: str) -> DataFrame:
    """(region_id, id, problem): repeated ids and ids that are not words of A-Z a-z 0-9 _ -."""
    ids = df.select(KEY, F.col(column).cast("string").alias("id"))
    twice = ids.groupBy(KEY, "id").count().where("count > 1").select(KEY, "id", F.lit("duplicate").alias("problem"))
    odd = ids.where(F.col("id").isNull() | ~F.col("id").rlike("^[A-Za-z0-9_-]+$")).select(KEY, "id", F.lit("format").alias("problem")).distinct()
    return twice.unionByName(odd)


def explode_site_list(recipe: DataFrame) -> DataFrame:
    """(region_id, kind, ord, site_id, node_id) of ``recipe(region_id, lockers, depots)``, two
    ordered lists of [site_id, node_id]."""
    one = lambda kind: recipe.select(KEY, F.lit(kind).alias("kind"), F.posexplode(f"{kind}s").alias("ord", "pair"))
    both = one("locker").unionByName(one("depot"))
    return both.select(KEY, "kind", "ord", F.element_at("pair", 1).alias("site_id"), F.element_at("pair", 2).alias("node_id"))
