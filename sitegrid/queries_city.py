"""Registered queries on the city: normalising, spatial, graph, coverage, shortlist."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import FLIGHT_MM, KEY, WALK_MM, City
from .functions import scalars
from .operators import coverage, graph, normalize, shortlist, spatial
from .oracles import sql
from .registry import query

# -- normalising --------------------------------------------------------------------------


@query("p1_filter_edges", sql("raw_edges", "select src, dst, l_quantity as length_m from raw_edges where l_returnflag <> 'R'"))
def p1(spark, d):
    raw = City(spark, d).raw_edges().select("src", "dst", F.col("l_quantity").alias("length_m"), F.struct((F.col("l_returnflag") != "R").alias("walking")).alias("permissions"))
    return normalize.filter_edges(raw)


@query("p2_to_mm", "select l_orderkey, l_linenumber, floor((l_extendedprice - 30000) / 7 * 1000 + 0.5)::bigint as mm from lineitem")
def p2(spark, d):
    return City(spark, d).table("lineitem").select("l_orderkey", "l_linenumber", scalars.to_mm((F.col("l_extendedprice") - 30000) / 7).alias("mm"))


def _utm_sql() -> str:
    radius, alpha, e = scalars.krueger()
    east = " + ".join(["eta", *[f"{a!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1)]])
    north = " + ".join(["xi", *[f"{a!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1)]])
    scale = repr(scalars.UTM_SCALE * radius)
    return f""", a as (select node_id, radians(lat) as phi, radians(lon - 27.0) as lam from nodes),
      b as (select node_id, lam, sinh(atanh(sin(phi)) - {e!r}::double * atanh({e!r}::double * sin(phi))) as t from a),
      c as (select node_id, atan2(t, cos(lam)) as xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) as eta from b)
      select node_id, floor((({east}) * {scale}::double + 500000.0) + 0.5)::bigint as east_m, floor((({north}) * {scale}::double) + 0.5)::bigint as north_m from c"""


@query("p3_project_utm", sql("nodes", _utm_sql()))
def p3(spark, d):
    out = normalize.project_utm(City(spark, d).nodes().drop("x_mm", "y_mm"))
    # metres: two libraries' trigonometry may differ in the last bit of a millimetre
    east, north = scalars.utm(F.col("lon"), F.col("lat"))
    return out.select("node_id", scalars.half_up(east).alias("east_m"), scalars.half_up(north).alias("north_m"))


@query("p4_demand", sql("cells", "select cell_id, population, parcels from cells"))
def p4(spark, d):
    return City(spark, d).cells().select("cell_id", "population", "parcels")


@query("p5_connectors", sql("cells nodes", "select cell_id, floor(sqrt(3.0::double * 3 * (cell_id % 5) * (cell_id % 5) * 1000000 + 16.0::double * (cell_id % 11) * (cell_id % 11) * 1000000) + 0.5)::bigint as connector_mm from cells join nodes using (node_id)"))
def p5(spark, d):
    c = City(spark, d)
    at = c.nodes().select("node_id", "x_mm", "y_mm")
    cells = c.cells().drop("connector_mm").join(at, "node_id").withColumns({"x_mm": F.col("x_mm") + F.col("cell_id") % 5 * 3000, "y_mm": F.col("y_mm") + F.col("cell_id") % 11 * 4000})
    return normalize.connectors(cells, c.nodes()).select("cell_id", "connector_mm")


@query("p6_return_distance", "select o_orderkey, floor(2 * sqrt((o_totalprice - 1000) * (o_totalprice - 1000) + (o_custkey - 7)::double * (o_custkey - 7)::double) + 0.5)::bigint as return_mm from orders")
def p6(spark, d):
    return City(spark, d).table("orders").select("o_orderkey", scalars.return_mm(F.col("o_totalprice"), F.col("o_custkey"), F.lit(1000), F.lit(7)).alias("return_mm"))


@query("j1_attach_nodes", sql("np nodes", "select s_suppkey as site_id, s_suppkey * 23 as node_id, x_mm, y_mm, x_mm is null as missing from supplier left join nodes on node_id = s_suppkey * 23"))
def j1(spark, d):
    c = City(spark, d)
    sites = c.table("supplier").select(F.lit(0).alias(KEY), F.col("s_suppkey").alias("site_id"), (F.col("s_suppkey") * 23).alias("node_id"))
    return normalize.attach_nodes(sites, c.nodes()).select("site_id", "node_id", "x_mm", "y_mm", "missing")


@query("j2_reconcile_population", sql("cells", "select cell_id, population, case when cell_id % 13 = 0 then population + 1 else population end as source_population from cells where cell_id % 13 = 0 and cell_id % 17 <> 0 union all select cell_id, population, null from cells where cell_id % 17 = 0"))
def j2(spark, d):
    cells = City(spark, d).cells()
    source = cells.where("cell_id % 17 <> 0").withColumn("population", F.when(F.col("cell_id") % 13 == 0, F.col("population") + 1).otherwise(F.col("population")))
    return normalize.reconcile_population(cells, source).select("cell_id", "population", "source_population")


@query("j3_prune_nodes", sql("nodes edges", "select node_id, x_mm, y_mm from nodes where node_id in (select src from edges where length_mm < 50000 union select dst from edges where length_mm < 50000)"))
def j3(spark, d):
    c = City(spark, d)
    return normalize.prune_nodes(c.nodes(), c.edges().where("length_mm < 50000")).select("node_id", "x_mm", "y_mm")


@query("u1_endpoints", sql("edges", "select src as node_id from edges union select dst from edges"))
def u1(spark, d):
    return normalize.endpoints(City(spark, d).edges()).select("node_id")


@query("u3_check_ids", "select id, 'duplicate' as problem from (select o_clerk as id from (select replace(c_name, '#', case when c_custkey % 50 = 0 then '#' else '_' end) as o_clerk from customer) union all select 'again' from customer where c_custkey < 2) group by id having count(*) > 1 union all select distinct replace(c_name, '#', '#'), 'format' from customer where c_custkey % 50 = 0")
def u3(spark, d):
    c = City(spark, d).table("customer")
    ids = c.select(F.lit(0).alias(KEY), F.when(F.col("c_custkey") % 50 == 0, F.col("c_name")).otherwise(F.replace(F.col("c_name"), F.lit("#"), F.lit("_"))).alias("id"))
    again = c.where("c_custkey < 2").select(F.lit(0).alias(KEY), F.lit("again").alias("id"))
    return normalize.check_ids(ids.unionByName(again), "id").select("id", "problem")


@query("s3_site_list", "select o_custkey % 40 as region_id, 'locker' as kind, (row_number() over (partition by o_custkey % 40 order by o_orderkey) - 1)::int as ord, o_orderkey::varchar as site_id, o_custkey::varchar as node_id from orders")
def s3(spark, d):
    o = City(spark, d).table("orders")
    # one list for each of many regions; a list is one recipe document
    pair = F.struct("o_orderkey", "o_custkey")
    lists = o.groupBy((F.col("o_custkey") % 40).alias(KEY)).agg(F.sort_array(F.collect_list(pair)).alias("l"))
    recipe = lists.select(KEY, F.transform("l", lambda p: F.array(p["o_orderkey"].cast("string"), p["o_custkey"].cast("string"))).alias("lockers"), F.array().cast("array<array<string>>").alias("depots"))
    return normalize.explode_site_list(recipe)


# -- spatial ------------------------------------------------------------------------------


@query("j5_pair_matrix", sql("flights", "select locker_id, depot_id, return_mm from flights"))
def j5(spark, d):
    c = City(spark, d)
    return spatial.pair_matrix(c.lockers(), c.depots()).select("locker_id", "depot_id", "return_mm")


@query("j6_pairs_within", sql("flights", f"select locker_id, depot_id, return_mm from flights where return_mm <= {FLIGHT_MM}"))
def j6(spark, d):
    c = City(spark, d)
    return spatial.pairs_within(c.lockers(), c.depots(), FLIGHT_MM).select("locker_id", "depot_id", "return_mm")


@query("j10_spacing_conflicts", sql("nodes", "select a.node_id as a_id, b.node_id as b_id from nodes a join nodes b on a.node_id < b.node_id and (a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm) < 40000::bigint * 40000"))
def j10(spark, d):
    return spatial.spacing_conflicts(City(spark, d).nodes().withColumnRenamed("node_id", "site_id"), 40_000).select("a_id", "b_id")


@query(
    "j11_nearest_nodes",
    sql(
        "nodes depots",
        """, b as (select (min(x_mm) + max(x_mm)) // 2 as cx, (min(y_mm) + max(y_mm)) // 2 as cy from nodes),
        free as (select * from nodes where node_id not in (select node_id from depots)),
        near1 as (select node_id, floor(sqrt((x_mm - cx + 300000)::double ** 2 + (y_mm - cy)::double ** 2) + 0.5)::bigint as off from free, b order by off, node_id limit 1),
        near2 as (select node_id, floor(sqrt((x_mm - cx - 300000)::double ** 2 + (y_mm - cy)::double ** 2) + 0.5)::bigint as off from free, b where node_id not in (select node_id from near1) order by off, node_id limit 1)
        select 'west' as target_id, node_id, off as offset_mm from near1 union all select 'east', node_id, off from near2""",
    ),
)
def j11(spark, d):
    c = City(spark, d)
    box = spatial.bbox(c.nodes()).select(KEY, F.floor("centre_x").alias("cx"), F.floor("centre_y").alias("cy"))
    sides = F.array(F.struct(F.lit("west").alias("target_id"), F.lit(0).alias("ord"), F.lit(-300_000).alias("dx")), F.struct(F.lit("east").alias("target_id"), F.lit(1).alias("ord"), F.lit(300_000).alias("dx")))
    targets = box.select(KEY, "cx", "cy", F.explode(sides).alias("s")).select(KEY, "s.target_id", "s.ord", (F.col("cx") + F.col("s.dx")).alias("x_mm"), F.col("cy").alias("y_mm"))
    return spatial.nearest_nodes(targets, c.nodes(), c.depots()).select("target_id", "node_id", "offset_mm")


@query("a11_bbox", sql("nodes cells", "select min(x_mm) as min_x, max(x_mm) as max_x, min(y_mm) as min_y, max(y_mm) as max_y, (min(x_mm) + max(x_mm)) / 2.0::double as centre_x, (min(y_mm) + max(y_mm)) / 2.0::double as centre_y from cells join nodes using (node_id)"))
def a11(spark, d):
    c = City(spark, d)
    return spatial.bbox(c.cells().join(c.nodes().drop(KEY), "node_id")).drop(KEY)


# -- graph --------------------------------------------------------------------------------


@query(
    "g1_check_graph",
    sql(
        "nodes edges",
        """, e as (select edge_id, src, case when dst % 97 = 0 then dst + 1000000 else dst end as dst, case when src % 89 = 0 then 0 else length_mm end as length_mm from edges
          union all select edge_id, src, dst, length_mm from edges where src % 101 = 0 and dst % 97 <> 0 and src % 89 <> 0)
        select 'duplicate_edge' as "check", edge_id as entity from e group by edge_id having count(*) > 1
        union all select 'dangling_dst', edge_id from e where dst not in (select node_id from nodes)
        union all select 'bad_length', edge_id from e where length_mm <= 0""",
    ),
)
def g1(spark, d):
    c = City(spark, d)
    e = c.edges()
    bent = e.withColumn("length_mm", F.when(F.col("src") % 89 == 0, 0).otherwise(F.col("length_mm"))).withColumn("dst", F.when(F.col("dst") % 97 == 0, F.col("dst") + 1_000_000).otherwise(F.col("dst")))
    return graph.check_graph(c.nodes(), bent.unionByName(e.where("src % 101 = 0 and dst % 97 <> 0 and src % 89 <> 0"))).select("check", "entity")


@query("g2_adjacency", sql("edges", "select src, string_agg(edge_id || '>' || dst || ':' || length_mm, ',' order by edge_id) as out from edges group by src"))
def g2(spark, d):
    out = graph.adjacency(City(spark, d).edges())
    return out.select("src", F.array_join(F.transform("out", lambda e: F.concat(e["edge_id"], F.lit(">"), e["dst"].cast("string"), F.lit(":"), e["length_mm"].cast("string"))), ",").alias("out"))


@query("g3_bounded_paths", sql("paths", "select o as origin, n as node_id, dist as dist_mm from paths"))
def g3(spark, d):
    c = City(spark, d)
    return graph.bounded_paths(c.near_edges(), c.origins()).select("origin", "node_id", "dist_mm")


def _routes(spark, d):
    """Walks with their routes, rebuilt from the predecessors."""
    from .bindings import once

    def make():
        c = City(spark, d)
        paths = graph.bounded_paths(c.near_edges(), c.origins())
        ends = c.walks().join(c.cells().select("cell_id", F.col("node_id").alias("origin")), "cell_id").join(c.lockers().select(F.col("site_id").alias("locker_id"), F.col("node_id").alias("target")), "locker_id")
        routes = graph.route_edges(paths, c.near_edges(), ends.select(KEY, "origin", "target").distinct())
        return ends.join(routes.select(KEY, "origin", "target", "edge_ids", "ok"), [KEY, "origin", "target"]).select(KEY, "cell_id", "locker_id", "distance_mm", "edge_ids", "ok")

    return once(spark, d, "routes", make)


@query("g4_route_edges", sql("walks", "select cell_id, locker_id, distance_mm as length_mm, true as ok from walks"))
def g4(spark, d):
    c = City(spark, d)
    m = graph.measure_routes(_routes(spark, d), c.cells(), c.lockers(), c.edges())
    return m.select("cell_id", "locker_id", F.col("measured_mm").alias("length_mm"), "ok")


@query(
    "g5_measure_routes",
    sql(
        "walks cells lockers",
        """, w as (select w.*, c.node_id <> l.node_id as moves from walks w join cells c using (cell_id) join lockers l on l.site_id = w.locker_id)
        select cell_id, locker_id, not (locker_id % 5 = 0 and moves) as ok from w""",
    ),
)
def g5(spark, d):
    c = City(spark, d)
    # every fifth locker's routes lose their last edge, so they end short
    cut = F.when(F.col("locker_id") % 5 == 0, F.slice("edge_ids", F.lit(1), F.greatest(F.size("edge_ids") - 1, F.lit(0)))).otherwise(F.col("edge_ids"))
    return graph.measure_routes(_routes(spark, d).withColumn("edge_ids", cut), c.cells(), c.lockers(), c.edges()).select("cell_id", "locker_id", "ok")


@query("g6_catchments", sql("reach", "select node_id, count(*) as cells, min(distance_mm) as nearest_mm, max(distance_mm) as farthest_mm, (select count(distinct node_id) from reach) as nodes from reach group by node_id"))
def g6(spark, d):
    c = City(spark, d)
    r = graph.catchments(c.cells(), c.near_edges(), WALK_MM)
    per = r.groupBy("node_id").agg(F.count(F.lit(1)).alias("cells"), F.min("distance_mm").alias("nearest_mm"), F.max("distance_mm").alias("farthest_mm"))
    return per.join(F.broadcast(per.agg(F.count(F.lit(1)).alias("nodes"))), F.lit(True))


@query("g7_route_geometry")
def g7(spark, d):
    c = City(spark, d)
    at = c.nodes().select("node_id", F.struct("lon", "lat").alias("p"))
    edges = c.near_edges().join(at.withColumnsRenamed({"node_id": "src", "p": "a"}), "src").join(at.withColumnsRenamed({"node_id": "dst", "p": "b"}), "dst").withColumn("coordinates", F.array("a", "b"))
    cells = c.cells().join(c.nodes().select("node_id", "lon", "lat"), "node_id").withColumns({"lon": F.col("lon") + 1e-5})
    return graph.route_geometry(_routes(spark, d), cells, c.nodes(), edges).select("cell_id", "locker_id", F.size("line").alias("points"), F.to_json("line").alias("line"))


# -- coverage -----------------------------------------------------------------------------


@query("j4_eligible_walks", sql("walks", "select cell_id, locker_id, distance_mm from walks"))
def j4(spark, d):
    c = City(spark, d)
    return coverage.eligible_walks(graph.catchments(c.cells(), c.near_edges(), WALK_MM), c.lockers()).select("cell_id", "locker_id", "distance_mm")


@query("j7_uncovered_cells", sql("cells chosen", "select cell_id, node_id, parcels from cells where cell_id not in (select cell_id from chosen)"))
def j7(spark, d):
    c = City(spark, d)
    return coverage.uncovered_cells(c.cells(), c.walks(), c.selection()).select("cell_id", "node_id", "parcels")


@query("j8_coverage_flags", sql("cells chosen", "select cell_id, cell_id in (select cell_id from chosen) as covered from cells"))
def j8(spark, d):
    c = City(spark, d)
    return coverage.coverage_flags(c.cells(), c.walks(), c.selection()).select("cell_id", "covered")


@query("j9_sites_without_backup", sql("flights sel dsel", f"select s.site_id as locker_id, count(f.depot_id) as depots from sel s left join flights f on f.locker_id = s.site_id and f.return_mm <= {FLIGHT_MM} and f.depot_id in (select site_id from dsel) group by 1 having count(f.depot_id) < 2"))
def j9(spark, d):
    c = City(spark, d)
    flights = spatial.pairs_within(c.selection(), c.depot_selection(), FLIGHT_MM)
    return coverage.sites_without_backup(c.selection(), c.depot_selection(), flights, FLIGHT_MM, 1).select("locker_id", "depots")


@query("a6_choice_counts", sql("counts", "select cell_id, choices from counts"))
def a6(spark, d):
    c = City(spark, d)
    return coverage.choice_counts(c.cells(), c.walks()).select("cell_id", "choices")


@query("a7_degree_summary", sql("counts", "select min(choices) as min, list_sort(list(choices))[count(*) // 2 + 1] as median, max(choices) as max, sum(choices)::bigint as total, count(*) as items from counts"))
def a7(spark, d):
    c = City(spark, d)
    return coverage.degree_summary(coverage.choice_counts(c.cells(), c.walks())).drop(KEY, "mean")


@query("a8_min_choices", sql("counts", "select min(choices) as fewest, min(choices) >= 3 as enough from counts"))
def a8(spark, d):
    c = City(spark, d)
    return coverage.min_choices(coverage.choice_counts(c.cells(), c.walks()), 3).drop(KEY)


@query(
    "a9_assignment_space",
    sql("counts", """, h as (select choices, count(*) as n from counts group by choices)
     select 'all' as cells, case when min(choices) > 0 then round(sum(n * log10(greatest(choices, 1))), 6) end as log10_size from h
     union all select 'reached', round(sum(n * log10(choices)), 6) from h where choices > 0"""),
)
def a9(spark, d):
    """Of all cells, none of which is left out, and of those with a choice."""
    c = City(spark, d)
    counts = coverage.choice_counts(c.cells(), c.walks())
    size = lambda rows, name: coverage.assignment_space(rows).select(F.lit(name).alias("cells"), F.round("log10_size", 6).alias("log10_size"))
    return size(counts, "all").unionByName(size(counts.where("choices > 0"), "reached"))


@query("a12_coverage_masks", sql("cells walks", ", o as (select cell_id, row_number() over (order by cell_id) - 1 as ord from cells) select locker_id, ord // 63 as word, bit_or(1::bigint << (ord % 63)::int) as mask from walks join o using (cell_id) group by 1, 2"))
def a12(spark, d):
    c = City(spark, d)
    return coverage.coverage_masks(c.walks(), c.cells()).drop(KEY)


@query("a14_covered_count", sql("chosen", "select count(distinct cell_id) as covered from chosen"))
def a14(spark, d):
    c = City(spark, d)
    return coverage.covered_count(c.selection(), c.walks()).drop(KEY)


@query("w1_nearest_choice", sql("chosen", "select cell_id, locker_id, distance_mm from (select *, row_number() over (partition by cell_id order by distance_mm, locker_id) as r from chosen) where r = 1"))
def w1(spark, d):
    c = City(spark, d)
    return coverage.nearest_choice(c.walks(), c.selection()).drop(KEY)


@query("w2_constrained_order", sql("cells chosen", ", n as (select c.cell_id, c.parcels, count(w.locker_id) as choices from cells c left join chosen w using (cell_id) group by 1, 2) select cell_id, parcels, choices, row_number() over (order by choices, parcels desc, cell_id::varchar)::int as pos from n"))
def w2(spark, d):
    c = City(spark, d)
    return coverage.constrained_order(c.cells(), c.walks(), c.selection()).drop(KEY)


@query("w4_ranked_choices", sql("walks", "select cell_id, locker_id, distance_mm, row_number() over (partition by cell_id order by distance_mm, locker_id)::int as rank from walks"))
def w4(spark, d):
    return coverage.ranked_choices(City(spark, d).walks()).drop(KEY)


@query("u4_eligible_choices", sql("chosen", "select cell_id, locker_id from chosen"))
def u4(spark, d):
    c = City(spark, d)
    return coverage.eligible_choices(c.walks(), c.selection()).select("cell_id", "locker_id")


@query("q1_uncovered_demand", sql("cells chosen", "select count(*) as cells, coalesce(sum(parcels), 0)::bigint as parcels, coalesce(sum(population), 0)::bigint as people from cells where cell_id not in (select cell_id from chosen)"))
def q1(spark, d):
    """Demand that a chosen set of lockers leaves uncovered: paths, walks, anti-join, totals."""
    c = City(spark, d)
    walks = coverage.eligible_walks(graph.catchments(c.cells(), c.near_edges(), WALK_MM), c.lockers())
    left = coverage.uncovered_cells(c.cells(), walks, c.selection())
    return left.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("parcels"), F.lit(0)).alias("parcels"), F.coalesce(F.sum("population"), F.lit(0)).alias("people"))


# -- shortlist ----------------------------------------------------------------------------


def _served(c: City):
    """Cells that some node reaches."""
    return c.cells().join(c.reach().select(KEY, "cell_id").distinct(), [KEY, "cell_id"], "left_semi")


@query("t1_best_site", sql("reach", ", k as (select cell_id, cell_id % 4 as have from (select distinct cell_id from reach)), s as (select node_id, count(*) as gain, max(distance_mm) as worst_mm from reach join k using (cell_id) where have < 3 group by 1) select node_id, gain, worst_mm from s order by gain desc, worst_mm, node_id limit 1"))
def t1(spark, d):
    c = City(spark, d)
    counts = _served(c).select(KEY, "cell_id", (F.col("cell_id") % 4).alias("have"))
    return shortlist.best_site(c.reach(), counts, 3).drop(KEY)


def _steps(spark, d):
    from .bindings import once

    c = City(spark, d)
    return once(spark, d, "shortlist", lambda: shortlist.greedy_shortlist(c.reach(), c.nodes(), _served(c), 1, 40_000)[0])


@query("t2_greedy_shortlist")
def t2(spark, d):
    c = City(spark, d)
    return shortlist.greedy_shortlist(c.reach(), c.nodes(), _served(c), 1, 40_000)[0].drop(KEY)


@query("t3_diff_shortlist")
def t3(spark, d):
    steps = _steps(spark, d)
    stored = steps.withColumn("node_id", F.when(F.col("ord") % 10 == 3, -F.col("node_id")).otherwise(F.col("node_id"))).where("ord % 25 <> 7")
    return shortlist.diff_shortlist(steps, stored).drop(KEY)


@query("t6_ordered", sql("cells", "select cell_id, population, (row_number() over (order by cell_id::varchar) - 1)::bigint as pos from cells"))
def t6(spark, d):
    from .functions.numbering import numbered

    # the place in the output order, which a comparison of sets of rows would not see
    rows = City(spark, d).cells().select(KEY, "cell_id", "population").withColumn("_id", F.collate(F.col("cell_id").cast("string"), "UNICODE"))
    placed = numbered(rows, KEY, ["_id"], "pos").withColumn("pos", F.col("pos").cast("long"))
    return shortlist.ordered(placed.drop("_id", KEY), ["cell_id"])


@query("w6_label_sites", "select s_suppkey as site_id, case when s_suppkey < 26 then chr((65 + s_suppkey)::int) else chr((65 + (s_suppkey - 26) // 26 % 26)::int) || chr((65 + (s_suppkey - 26) % 26)::int) end as label from supplier where s_suppkey < 702")
def w6(spark, d):
    sites = City(spark, d).table("supplier").where("s_suppkey < 702").select(F.col("s_suppkey").alias("site_id"), F.col("s_suppkey").alias("ord"))
    return shortlist.label_sites(sites).drop("ord")


_LETTER = "chr((65 + ({0}))::int)"
_EVERY = f"case when k < 26 then {_LETTER.format('k')} when k < 702 then {_LETTER.format('(k - 26) // 26')} || {_LETTER.format('(k - 26) % 26')} else {_LETTER.format('(k - 702) // 676 % 26')} || {_LETTER.format('(k - 702) // 26 % 26')} || {_LETTER.format('(k - 702) % 26')} end"


@query("w6_label_every", f"select k as row_id, {_EVERY} as label from (select (o_orderkey % 18278)::bigint as k from orders)")
def w6_every(spark, d):
    """Labels of one, two and three letters."""
    rows = City(spark, d).table("orders").select((F.col("o_orderkey") % 18_278).alias("row_id"), (F.col("o_orderkey") % 18_278).alias("ord"))
    return shortlist.label_sites(rows).drop("ord")


@query(
    "t3_diff_lists",
    "with a as (select s_suppkey as ord, s_suppkey * 17 % 1000 as node_id from supplier), b as (select ord, case when ord % 10 = 3 then -node_id else node_id end as node_id from a where ord % 25 <> 7 union all select ord + 100000, node_id from a where ord % 40 = 1)"
    " select ord, a.node_id as replayed, b.node_id as stored from a full join b using (ord) where a.node_id is distinct from b.node_id",
)
def t3_lists(spark, d):
    """A list of sites against one with changed, missing and added places."""
    k = F.col("s_suppkey").cast("long")
    steps = City(spark, d).table("supplier").select(F.lit(0).alias(KEY), k.alias("ord"), (k * 17 % 1000).alias("node_id"))
    changed = steps.withColumn("node_id", F.when(F.col("ord") % 10 == 3, -F.col("node_id")).otherwise(F.col("node_id"))).where("ord % 25 <> 7")
    return shortlist.diff_shortlist(steps, changed.unionByName(steps.where("ord % 40 = 1").withColumn("ord", F.col("ord") + 100_000))).drop(KEY)


_LINE = "(s.x_mm + 100) || ':' || s.y_mm || ',' || s.x_mm || ':' || s.y_mm"


@query("g7_edge_geometry", sql("nodes edges", f"select e.edge_id as route, {_LINE} || ',' || s.x_mm || ':' || s.y_mm || ',' || t.x_mm || ':' || t.y_mm as line from edges e join nodes s on s.node_id = e.src join nodes t on t.node_id = e.dst union all select 'none-' || s.node_id, {_LINE} from nodes s"))
def g7_edges(spark, d):
    """Lines of the routes of one edge, from a cell beside each edge's start, and of empty routes."""
    c = City(spark, d)
    at = c.nodes().select("node_id", F.struct("lon", "lat").alias("p"))
    edges = c.edges().join(at.withColumnsRenamed({"node_id": "src", "p": "a"}), "src").join(at.withColumnsRenamed({"node_id": "dst", "p": "b"}), "dst").withColumn("coordinates", F.array("a", "b"))
    cells = c.nodes().select(KEY, F.col("node_id").alias("cell_id"), "node_id", (F.col("lon") + 1e-5).alias("lon"), "lat")
    walks = edges.select(KEY, F.col("src").alias("cell_id"), F.col("dst").alias("locker_id"), F.array("edge_id").alias("edge_ids"))
    stay = cells.select(KEY, "cell_id", F.lit(-1).cast("long").alias("locker_id"), F.array().cast("array<string>").alias("edge_ids"))
    mm = lambda v, base: scalars.half_up((v - base) * 1e7).cast("string")
    line = F.array_join(F.transform("line", lambda p: F.concat(mm(p["lon"], 24), F.lit(":"), mm(p["lat"], 60))), ",")
    route = F.when(F.col("locker_id") < 0, F.concat(F.lit("none-"), F.col("cell_id").cast("string"))).otherwise(F.concat_ws("-", "cell_id", "locker_id"))
    return graph.route_geometry(walks.unionByName(stay), cells, c.nodes(), edges).select(route.alias("route"), line.alias("line"))
