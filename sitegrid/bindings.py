"""The domain's tables as views over the test tables; the only dataset-specific file.

City: one region; nodes from ``part``, edges from ``lineitem``, cells from ``customer``, lockers
from ``supplier``, depots from ``nation``, plans from ``orders``. Blocks: many small regions of
four lockers, three depots and six cells for the combinatorial operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalars import demand
from .functions.staging import staged
from .operators.coverage import eligible_walks
from .operators.graph import catchments

WALK_MM, FLIGHT_MM = 60_000, 2_000_000
KEY = "region_id"

_kept: dict = {}


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A derived table, staged once for an application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = staged(make(), f"bind-{name}")
    return _kept[key]


class City:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def n(self) -> int:
        return self.table("part").count()

    def nodes(self) -> DataFrame:
        k = F.col("p_partkey")
        x, y = k * 7919 % 10007 * 400, k * 104729 % 10009 * 400
        return self.table("part").select(F.lit(0).alias(KEY), k.alias("node_id"), x.alias("x_mm"), y.alias("y_mm"), (24 + x / 1e7).alias("lon"), (60 + y / 1e7).alias("lat"))

    def raw_edges(self) -> DataFrame:
        """Consecutive parts of an order; repeated edges stay."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        rows = self.table("lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), "l_quantity", "l_returnflag")
        return rows.where("dst is not null and src <> dst")

    def edges(self, most_mm: int | None = None) -> DataFrame:
        """Between two nodes the shortest of the repeated edges; ``most_mm`` leaves out longer ones."""
        rows = self.raw_edges().select("src", "dst", (F.col("l_quantity") * 10000).cast("long").alias("length_mm"))
        rows = (rows if most_mm is None else rows.where(F.col("length_mm") <= most_mm)).groupBy("src", "dst").agg(F.min("length_mm").alias("length_mm"))
        return rows.select(F.lit(0).alias(KEY), F.concat_ws("-", "src", "dst").alias("edge_id"), "src", "dst", "length_mm")

    def cells(self) -> DataFrame:
        k = F.col("c_custkey")
        rows = self.table("customer").select(F.lit(0).alias(KEY), k.alias("cell_id"), (k * 31 % self.n()).alias("node_id"), (1 + k * 37 % 400).alias("population"), (k % 7 * 5000).alias("connector_mm"))
        return rows.withColumn("parcels", demand(F.col("population")))

    def _sites(self, table: str, key: str, step: int) -> DataFrame:
        k = F.col(key).cast("long")
        rows = self.table(table).select(F.lit(0).alias(KEY), k.alias("site_id"), (k * step % self.n()).alias("node_id"))
        return rows.join(self.nodes().select("node_id", "x_mm", "y_mm", "lon", "lat"), "node_id")

    def lockers(self) -> DataFrame:
        return self._sites("supplier", "s_suppkey", 17)

    def depots(self) -> DataFrame:
        return self._sites("nation", "n_nationkey", 101)

    def origins(self) -> DataFrame:
        """One origin for each snap node, with the walking limit as its budget."""
        return self.cells().select(KEY, F.col("node_id").alias("origin"), "node_id").distinct().withColumn("budget_mm", F.lit(WALK_MM).cast("long"))

    def near_edges(self) -> DataFrame:
        """The edges that a walk within the limit may use."""
        return once(self.spark, self.dir, "near-edges", lambda: self.edges(WALK_MM))

    def reach(self) -> DataFrame:
        return once(self.spark, self.dir, "reach", lambda: catchments(self.cells(), self.near_edges(), WALK_MM))

    def walks(self) -> DataFrame:
        return once(self.spark, self.dir, "walks", lambda: eligible_walks(self.reach(), self.lockers()))

    def selection(self) -> DataFrame:
        """Every third locker."""
        return self.lockers().where("site_id % 3 = 0")

    def depot_selection(self) -> DataFrame:
        return self.depots().where("site_id % 3 = 0")


class Plans(City):
    """Plans of the city: orders are assignments, dealt to one plan for every 50 customers."""

    def count(self) -> int:
        return max(1, self.table("customer").count() // 50)

    def measured_walks(self) -> DataFrame:
        """Advertised walks; every 37th cell's are a millimetre off, every 41st's route is broken."""
        c = F.col("cell_id")
        return self.walks().withColumns({"measured_mm": F.col("distance_mm") + F.when(c % 37 == 0, 1).otherwise(0), "route_ok": c % 41 != 0})

    def plan_cells(self) -> DataFrame:
        order = Window.partitionBy("cell_id").orderBy("locker_id")
        ranked = self.walks().select("cell_id", F.col("locker_id").alias("_l"), F.row_number().over(order).alias("_r"))
        n = self.walks().groupBy("cell_id").agg(F.count(F.lit(1)).alias("_n"))
        o = self.table("orders").select((F.col("o_orderkey") % self.count()).alias("plan_id"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("cell_id"))
        o = o.join(n, "cell_id", "left").withColumn("_r", F.when(F.col("_n").isNotNull(), 1 + F.col("pos") % F.col("_n")))
        o = o.join(ranked, ["cell_id", "_r"], "left")
        return o.select(F.lit(0).alias(KEY), "plan_id", "pos", "cell_id", F.coalesce("_l", F.col("pos") % self.table("supplier").count()).alias("locker_id"))

    def kept(self, name: str) -> DataFrame:
        """A table of the plans, staged once: the others are derived from it as it lies, not from its orders and walks again."""
        return once(self.spark, self.dir, name, getattr(self, name))

    def plan_sites(self) -> DataFrame:
        used = self.kept("plan_cells").select("plan_id", F.col("locker_id").alias("site_id")).distinct().where("(site_id + plan_id) % 11 <> 0")
        lockers = used.select("plan_id", F.lit("locker").alias("kind"), F.col("site_id").alias("pos"), "site_id")
        again = lockers.where("(site_id + plan_id) % 29 = 3").withColumn("pos", F.col("pos") + 1_000_000)
        plans = F.sequence(F.lit(0).cast("long"), F.lit(self.count() - 1).cast("long"))
        depots = self.table("nation").select(F.explode(plans).alias("plan_id"), F.lit("depot").alias("kind"), F.col("n_nationkey").cast("long").alias("pos"), F.col("n_nationkey").cast("long").alias("site_id"))
        depots = depots.where("(site_id + plan_id) % 5 = 0")
        odd = depots.where("plan_id % 12 = 7 and site_id < 5").withColumn("site_id", F.col("site_id") + 1000)
        return lockers.unionByName(again).unionByName(depots).unionByName(odd).withColumn(KEY, F.lit(0))

    def plan_outages(self) -> DataFrame:
        d = self.kept("plan_sites").where("kind = 'depot' and ((plan_id % 2 = 1 and (plan_id + site_id) % 13 <> 0) or (plan_id % 9 = 4 and plan_id % 2 = 0 and site_id < 5))")
        extra = d.where("plan_id % 14 = 9").withColumn("site_id", F.when(F.col("site_id") % 2 == 0, F.col("site_id")).otherwise(F.col("site_id") + 1))
        return d.unionByName(extra).select(KEY, "plan_id", "pos", F.col("site_id").alias("depot_id"))

    def plan_supply(self) -> DataFrame:
        d = self.kept("plan_sites").where("kind = 'depot' and site_id < 1000").groupBy("plan_id").agg(F.sort_array(F.collect_set("site_id")).alias("ds"))
        rows = self.kept("plan_sites").where("kind = 'locker'").select("plan_id", F.col("pos").alias("_pos"), F.col("site_id").alias("locker_id")).join(d, "plan_id")
        scopes = F.when(F.col("plan_id") % 2 == 1, F.sequence(F.lit(0), F.size("ds"))).otherwise(F.array(F.lit(0)))
        rows = rows.withColumn("k", F.explode(scopes)).where("(locker_id + plan_id * 3 + k) % 97 <> 0")
        j = (F.col("locker_id") + F.col("plan_id")) % F.size("ds")
        j = F.when((j == F.col("k") - 1) & (F.col("plan_id") % 3 == 0), (j + 1) % F.size("ds")).otherwise(j)
        out = F.when(F.col("k") > 0, F.get("ds", F.col("k") - 1))
        return rows.select(F.lit(0).alias(KEY), "plan_id", (F.col("_pos") * 100 + F.col("k")).alias("pos"), out.alias("outage_depot"), "locker_id", F.get("ds", j.cast("int")).alias("depot_id"))

    def requests(self) -> DataFrame:
        p = F.col("plan_id")
        chosen = self.kept("plan_sites").where("kind = 'locker'").groupBy("plan_id").agg(F.sort_array(F.collect_set("site_id")).alias("ls"))
        out = self.spark.range(self.count()).withColumnRenamed("id", "plan_id").join(chosen, "plan_id", "left")
        few = F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(1)))
        return out.select(
            F.lit(0).alias(KEY),
            "plan_id",
            (F.lit(20) + p % 3 * 20).alias("max_lockers"),
            (F.lit(4) + p % 3).alias("max_depots"),
            (F.lit(40) + p % 4 * 40).alias("locker_capacity"),
            F.when(p % 16 == 11, F.lit(20_000)).otherwise(F.lit(400) + p % 5 * 400).alias("depot_capacity"),
            (F.lit(2_000_000) + p % 3 * 500_000).alias("flight_limit_mm"),
            F.when(p % 6 == 0, F.lit(None)).otherwise(p % 2).cast("int").alias("outage_tolerance"),
            F.when(p % 10 == 1, F.col("ls")).when(p % 10 == 2, few).alias("fixed_lockers"),
            F.when(p % 8 == 5, F.array().cast("array<bigint>")).when(p % 8 == 6, F.array(F.lit(3), F.lit(4000), F.lit(3)).cast("array<bigint>")).alias("fixed_depots"),
            F.when(p % 15 == 14, F.lit(0)).otherwise(F.lit(1000) + p).alias("timeout_ms"),
        )

    def audit(self):
        from .plans.verify import Audit

        names = ("requests", "plan_sites", "plan_cells", "plan_supply", "plan_outages")
        return Audit(self.cells(), self.lockers(), self.depots(), self.measured_walks(), *map(self.kept, names), WALK_MM)


class Blocks(City):
    """Small regions: four lockers and three depots from ``supplier``, six cells of ten customers."""

    WALK_MM, FLIGHT_MM = 2_200_000, 6_000_000

    def _sites(self, step: int, most: int) -> DataFrame:  # noqa: D401
        k = F.col("s_suppkey").cast("long")
        rows = self.table("supplier").where(F.col("s_suppkey") % 4 < most)
        rows = rows.select(F.floor(k / 4).alias(KEY), k.alias("site_id"), (k % 4).cast("int").alias("ord"), (k * step % self.n()).alias("node_id"))
        return rows.join(self.nodes().select("node_id", "x_mm", "y_mm"), "node_id")

    def lockers(self) -> DataFrame:
        return self._sites(17, 4)

    def depots(self) -> DataFrame:
        return self._sites(101, 3)

    def cells(self) -> DataFrame:
        cell = F.floor(F.col("c_custkey") / 10)
        people = self.table("customer").select(cell.alias("cell_id"), (1 + F.col("c_custkey") * 37 % 400).alias("p"))
        rows = people.groupBy("cell_id").agg(F.sum("p").alias("population"))
        rows = rows.withColumns({KEY: F.floor(F.col("cell_id") / 6), "parcels": demand(F.col("population")), "node_id": F.col("cell_id") * 313 % self.n()})
        rows = rows.join(self.lockers().select(KEY).distinct(), KEY, "left_semi")
        return rows.join(self.nodes().select("node_id", "x_mm", "y_mm"), "node_id")

    def walks(self) -> DataFrame:
        from .functions.scalars import straight_mm

        c = self.cells().select(KEY, "cell_id", F.col("x_mm").alias("_x"), F.col("y_mm").alias("_y"))
        both = c.join(self.lockers().select(KEY, F.col("site_id").alias("locker_id"), "x_mm", "y_mm"), KEY)
        return both.select(KEY, "cell_id", "locker_id", straight_mm(F.col("_x"), F.col("_y"), F.col("x_mm"), F.col("y_mm")).alias("distance_mm")).where(F.col("distance_mm") <= self.WALK_MM)

    def flights(self) -> DataFrame:
        from .operators.spatial import pair_matrix

        return pair_matrix(self.lockers(), self.depots())

    def streets(self) -> DataFrame:
        """Edges from the node of each cell to those of the lockers within the walking limit."""
        from .functions.scalars import straight_mm

        at = lambda rows, name: rows.select(KEY, F.col("node_id").alias(name), F.col("x_mm").alias(f"_x{name}"), F.col("y_mm").alias(f"_y{name}")).distinct()
        both = at(self.cells(), "src").join(at(self.lockers(), "dst"), KEY).where("src <> dst")
        length = straight_mm(F.col("_xsrc"), F.col("_ysrc"), F.col("_xdst"), F.col("_ydst"))
        return both.select(KEY, F.concat_ws(">", "src", "dst").alias("edge_id"), "src", "dst", length.alias("length_mm")).where(F.col("length_mm") <= self.WALK_MM)

    def routes(self) -> DataFrame:
        """The walks with the edges of a shortest route along the streets."""
        from .operators.graph import bounded_paths, route_edges

        streets = once(self.spark, self.dir, "block-streets", self.streets)
        cells, lockers, _, walks, _ = self.dealt_world()
        origins = cells.select(KEY, F.col("node_id").alias("origin"), "node_id").distinct().withColumn("budget_mm", F.lit(self.WALK_MM).cast("long"))
        ends = walks.join(cells.select(KEY, "cell_id", F.col("node_id").alias("origin")), [KEY, "cell_id"]).join(lockers.select(KEY, F.col("site_id").alias("locker_id"), F.col("node_id").alias("target")), [KEY, "locker_id"])
        found = route_edges(bounded_paths(streets, origins), streets, ends.select(KEY, "origin", "target").distinct())
        return ends.join(found, [KEY, "origin", "target"]).select(KEY, "cell_id", "locker_id", "distance_mm", "edge_ids")

    def measured_walks(self, routes: DataFrame | None = None) -> DataFrame:
        """The walks with what their routes measure, edge by edge."""
        from .operators.graph import measure_routes

        streets = once(self.spark, self.dir, "block-streets", self.streets)
        cells, lockers, _, walks, _ = self.dealt_world()
        routes = once(self.spark, self.dir, "block-routes", self.routes) if routes is None else routes
        found = measure_routes(routes, cells.withColumn("connector_mm", F.lit(0).cast("long")), lockers, streets.hint("merge"))
        return walks.join(found.withColumnRenamed("ok", "route_ok"), [KEY, "cell_id", "locker_id"], "left").withColumn("route_ok", F.coalesce("route_ok", F.lit(False)))

    def found_plans(self, measured: DataFrame | None = None):
        """The audit of every plan that the search of the grid found, its walks measured along their routes."""
        from .plans.verify import Audit

        cells, lockers, depots, _, _ = self.dealt_world()
        _, plans = self.sweep()
        plans = {name: t.hint("merge") for name, t in plans.items()}
        requests = self.requests().hint("merge").withColumnRenamed("request_id", "plan_id").join(plans["plan_sites"].select(KEY, "plan_id").distinct(), [KEY, "plan_id"], "left_semi")
        measured = once(self.spark, self.dir, "block-measured", self.measured_walks) if measured is None else measured
        return Audit(cells, lockers, depots, measured.hint("merge"), requests.hint("merge"), walk_limit_mm=self.WALK_MM, **plans)

    def limits(self) -> DataFrame:
        """One request for each region."""
        none = F.lit(None).cast("array<bigint>")
        return self.lockers().select(KEY).distinct().select(
            KEY, F.lit(0).cast("long").alias("request_id"), F.lit(3).alias("max_lockers"), F.lit(2).alias("max_depots"), F.lit(600).alias("locker_capacity"), F.lit(1000).alias("depot_capacity"),
            F.lit(self.FLIGHT_MM).alias("flight_limit_mm"), F.lit(1).alias("outage_tolerance"), none.alias("fixed_lockers"), none.alias("fixed_depots"), F.lit(1000).alias("timeout_ms"),
        )

    AXES = {"max_lockers": [2, 4], "max_depots": [2, 3], "locker_capacity": [450, 800], "outage_tolerance": [0, 1]}

    def grid(self) -> DataFrame:
        from .plans.whatif import request_grid

        return request_grid(self.limits(), self.AXES)

    def world(self) -> tuple[DataFrame, ...]:
        """cells, lockers, depots, walks, flights."""
        keep = lambda name: once(self.spark, self.dir, f"block-{name}", getattr(self, name))
        return tuple(keep(x) for x in ("cells", "lockers", "depots", "walks", "flights"))

    def dealt_world(self) -> list[DataFrame]:
        """``world``, joined by dealing out both sides: its files are small and its rows many."""
        return [t.hint("merge") for t in self.world()]

    def requests(self) -> DataFrame:
        return once(self.spark, self.dir, "block-grid", self.grid)

    def search(self):
        """The search of the whole grid, done once."""
        from .plans.whatif import search_requests

        key = (self.spark.sparkContext.applicationId, self.dir, "sweep")
        if key not in _kept:
            _kept[key] = search_requests(*self.world(), self.requests())
        return _kept[key]

    def sweep(self):
        """Results and plans of the whole grid."""
        found = self.search()
        return found.results, found.plans
