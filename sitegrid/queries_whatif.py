"""Registered queries on what-if sweeps and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import KEY, Blocks, City, Plans
from .functions.scalars import choose
from .functions.staging import staged
from .oracles import sql
from .plans import reports, whatif
from .plans.search import Reach
from .registry import query

LIST = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query("e1_combinations", sql("lsets", "select region_id, row_number() over (partition by region_id order by places) - 1 as ordinal, array_to_string(members, ',') as members, m::bigint as mask from lsets where k = 2"))
def e1(spark, d):
    return whatif.combinations(Blocks(spark, d).lockers(), 2).select(KEY, "ordinal", LIST("members"), F.get("mask", F.lit(0)).alias("mask"))


@query("e2_selections", sql("lsel", "select region_id, request_id, ordinal, array_to_string(members, ',') as members, m::bigint as mask from lsel"))
def e2(spark, d):
    b = Blocks(spark, d)
    return whatif.selections(b.requests(), b.world()[1], "locker").select(KEY, "request_id", "ordinal", LIST("members"), F.get("mask", F.lit(0)).alias("mask"))


@query("e3_screen", sql("screened", "select region_id, request_id, l_ordinal, d_ordinal, array_to_string(lockers, ',') as lockers, array_to_string(depots, ',') as depots, stage from screened"))
def e3(spark, d):
    b = Blocks(spark, d)
    return whatif.screen(b.requests(), *b.world()[:3], *b.world()[3:]).select(KEY, "request_id", "l_ordinal", "d_ordinal", LIST("lockers"), LIST("depots"), "stage")


@query("e4_plausible", sql("lsets dsets cm dm", """select a.region_id, array_to_string(a.members, ',') as lockers, array_to_string(b.members, ',') as depots from lsets a join dsets b using (region_id) where a.k = 3 and b.k = 2
 and not exists (select 1 from cm where cm.region_id = a.region_id and cm.m & a.m = 0) and not exists (select 1 from dm where dm.region_id = a.region_id and (a.m >> dm.l_ord) & 1 = 1 and dm.dm & b.m = 0)"""))
def e4(spark, d):
    b = Blocks(spark, d)
    return whatif.plausible_selections(*b.world(), 3, 2, b.FLIGHT_MM).select(KEY, LIST("lockers"), LIST("depots"))


_ROBUST = """, r as (select s.region_id, s.m, row_number() over (partition by s.region_id order by places) - 1 as ordinal, array_to_string(members, ',') as depots,
   (select list(l.site_id) from bl l join dm on dm.region_id = l.region_id and dm.l_ord = l.ord where l.region_id = s.region_id and bit_count(dm.dm & s.m) >= 2) as rl from dsets s where k = 2),
  v as (select r.*, coalesce(len(rl), 0) as robust_lockers, (select count(distinct cell_id) from bw where bw.region_id = r.region_id and list_contains(rl, locker_id)) as covered, (select count(*) from bc where bc.region_id = r.region_id) as n from r)"""


@query("e5_resilience_audit", sql("dsets bl dm bw bc", _ROBUST + " select region_id, ordinal, depots, robust_lockers, covered, covered = n as \"full\" from v"))
def e5(spark, d):
    b = Blocks(spark, d)
    return whatif.resilience_audit(*b.world(), 2, b.FLIGHT_MM).select(KEY, "ordinal", LIST("depots"), F.col("robust_lockers").cast("long"), "covered", "full")


@query("t5_best_coverage", sql("dsets bl dm bw bc", _ROBUST + " select region_id, count(*) as sets, count(*) filter (covered = n) as full_sets, max(covered) as best, arg_min(ordinal, -covered * 1000 + ordinal) as best_ordinal from v group by 1"))
def t5(spark, d):
    b = Blocks(spark, d)
    return whatif.best_coverage(whatif.resilience_audit(*b.world(), 2, b.FLIGHT_MM))


@query(
    "e6_cover_within",
    sql("lsets cm", """, full_ as (select a.region_id, min(k) as fewest from lsets a where not exists (select 1 from cm where cm.region_id = a.region_id and cm.m & a.m = 0) group by 1)
     select r.region_id, coalesce(fewest <= 3, false) as covered, case when fewest <= 3 then fewest end as sites, case when fewest <= 3 then 0 end::bigint as uncovered from (select distinct region_id from lsets) r left join full_ using (region_id)"""),
)
def e6(spark, d):
    """Whether three lockers cover a block; what the witness leaves uncovered is counted from the walks."""
    from .functions.numbering import numbered
    from .operators.coverage import coverage_masks, uncovered_cells

    b = Blocks(spark, d)
    cells, lockers, _, walks, _ = b.world()
    places = numbered(cells.select(KEY, "cell_id"), KEY, ["cell_id"], "ord")
    masks = coverage_masks(walks, cells).select(KEY, F.col("locker_id").alias("site_id"), "word", "mask")
    # the search goes level by level, so a witness is as small as any cover
    found = staged(whatif.cover_within(masks, places, 3), "e6-found")
    sites = found.where("witness is not null").select(KEY, F.explode("witness").alias("site_id"))
    known = cells.join(found.where("witness is not null").select(KEY), KEY, "left_semi")
    left = uncovered_cells(known, walks, sites).groupBy(KEY).agg(F.count(F.lit(1)).alias("uncovered"))
    covered = F.col("witness").isNotNull()
    out = found.join(left, KEY, "left")
    return out.select(KEY, covered.alias("covered"), F.when(covered, F.size("witness")).alias("sites"), F.when(covered, F.coalesce("uncovered", F.lit(0))).alias("uncovered"))


def _walked(start: str, most: str, used: str) -> str:
    """Every assignment of items ``io`` to bins along ``ch``, one item after another; ``fin`` are the
    complete ones."""
    return f"""st(sel, pos, loads, path) as ({start}
      union all select s.sel, s.pos + 1, list_transform(s.loads, lambda x, i: x + case when i = c.bin + 1 then c.w else 0 end), list_append(s.path, c.rank)
      from st s join ch c on c.sel = s.sel and c.pos = s.pos where s.loads[c.bin + 1] + c.w <= {most}),
    fin as (select sel, loads, min(path) as path from st join (select sel, count(*) as items from io group by 1) using (sel) where pos = items and ({used}) group by 1, 2)"""


_LISTED = lambda c: f"array_to_string({c}, ',') as {c}"
_CELLS = """, it as (select c.region_id as sel, c.cell_id, c.parcels as w, count(w.locker_id) as nc from bc c left join bw w using (region_id, cell_id) group by 1, 2, 3),
    io as (select *, row_number() over (partition by sel order by nc, w desc, cell_id::varchar) - 1 as pos from it),
    ch as (select sel, pos, io.w, row_number() over (partition by sel, io.cell_id order by ord) - 1 as rank, ord as bin from io join bw on bw.region_id = sel and bw.cell_id = io.cell_id), """
_FLOWN = """, it as (select region_id, locker_id, 200 + locker_id * 37 % 300 as w from bf group by 1, 2),
    ou as ({0}),
    nc as (select sel, f.locker_id, any_value(w) as w, count(*) filter (return_mm <= 6000000 and f.depot_id is distinct from gone) as nc from ou join bf f using (region_id) join it on it.locker_id = f.locker_id group by 1, 2),
    io as (select *, row_number() over (partition by sel order by nc, w desc, locker_id::varchar) - 1 as pos from nc),
    ch as (select sel, pos, w, row_number() over (partition by sel, f.locker_id order by d_ord) - 1 as rank, d_ord as bin from ou join bf f using (region_id) join io using (sel, locker_id) where return_mm <= 6000000 and f.depot_id is distinct from gone), """
_BINS = "select sel, 0::bigint, list_transform(range({n}), lambda x: 0::bigint), []::bigint[] from {t}"


@query("e7_assign_units", sql("bl bc bw", _CELLS + _walked(_BINS.format(n="count(*)", t="(select region_id as sel from bl) group by 1"), "600", "len(list_filter(loads, lambda x: x = 0)) = 0") + f" select sel as region_id, {_LISTED('loads')}, {_LISTED('path')} from fin"))
def e7(spark, d):
    """Load vectors of every region's full locker set under a capacity of 600."""
    b = Blocks(spark, d)
    cells, lockers, _, walks, _ = b.world()
    sel = whatif.site_lists(lockers).select(F.col(KEY).cast("string").alias("sel"), KEY, F.col("ids").alias("members"), F.lit(600).alias("capacity"))
    final, _, _ = whatif.cell_assignments(sel, cells, lockers, walks, None)
    return final.select(F.col("sel").cast("long").alias(KEY), LIST("loads"), LIST("path"))


def _loads(b: Blocks):
    """Lockers loaded with ten parcels more each, and all depots of their region."""
    cells, lockers, depots, _, flights = b.world()
    ids = whatif.site_lists(lockers).withColumnRenamed("ids", "members").join(whatif.site_lists(depots).withColumnRenamed("ids", "depots"), KEY)
    loads = F.transform("members", lambda m: (F.lit(200) + m * 37 % 300).cast("long"))
    return ids.select(KEY, "members", "depots", loads.alias("loads"), F.lit(Blocks.FLIGHT_MM).alias("flight_limit_mm"), F.lit(800).alias("capacity")), flights, depots


@query("e8_assign_suppliers", sql("bf bd", _FLOWN.format("select distinct region_id, region_id as sel, null::bigint as gone from bf") + _walked(_BINS.format(n="count(*)", t="ou join bd using (region_id) group by 1"), "800", "len(list_filter(loads, lambda x: x = 0)) = 0") + " select sel as region_id, count(*) as load_vectors, array_to_string(min(path), ',') as path from fin group by 1"))
def e8(spark, d):
    states, flights, depots = _loads(Blocks(spark, d))
    rows = states.withColumns({"sel": F.col(KEY).cast("string"), "outage_depot": F.lit(None).cast("long")})
    final, _, _ = whatif.supplier_assignments(rows, flights, depots, None)
    return final.groupBy("sel").agg(F.count(F.lit(1)).alias("load_vectors"), F.min("path").alias("path")).select(F.col("sel").cast("long").alias(KEY), "load_vectors", LIST("path"))


@query("e9_outage_plans", sql("bf bd", _FLOWN.format("select distinct region_id, region_id || '|' || depot_id as sel, depot_id as gone from bf") + _walked(_BINS.format(n="count(*)", t="ou join bd using (region_id) group by 1"), "800", "true") + " select region_id, gone as outage_depot, count(fin.sel) > 0 as served, array_to_string(min(path), ',') as path from ou left join fin using (sel) group by 1, 2"))
def e9(spark, d):
    states, flights, depots = _loads(Blocks(spark, d))
    rows = states.withColumn("outage_depot", F.explode("depots")).withColumn("sel", F.concat_ws("|", KEY, "outage_depot"))
    final, _, _ = whatif.supplier_assignments(rows, flights, depots, None)
    got = final.groupBy("sel").agg(F.min("path").alias("path"))
    return rows.select(KEY, "outage_depot", "sel").join(got, "sel", "left").select(KEY, "outage_depot", F.col("path").isNotNull().alias("served"), LIST("path"))


@query("e10_feasibility", sql("decided", "select region_id, request_id, status, l_ordinal, d_ordinal from decided"))
def e10(spark, d):
    return Blocks(spark, d).search().results


@query("e10_verified_plans")
def e10_plans(spark, d):
    """Independent verification of every plan that the search found, routes included."""
    audit = Blocks(spark, d).found_plans()
    return audit.verification(audit.errors()).withColumn("errors", F.array_join("errors", ","))


@query(
    "e11_selection_outcomes",
    sql("pairs_11 served_11", """select p.region_id, array_to_string(lockers, ',') as lockers, array_to_string(depots, ',') as depots,
      case when exists (select 1 from served_11 v where v.region_id = p.region_id and v.m = p.lm and v.dmask = p.dmask and v.normal and v.outages = bit_count(p.dmask)) then 'feasible' else 'unsat' end as status from pairs_11 p"""),
)
def e11(spark, d):
    b = Blocks(spark, d)
    plausible = whatif.plausible_selections(*b.world(), 3, 2, b.FLIGHT_MM)
    return whatif.selection_outcomes(*b.world(), b.limits(), plausible).select(KEY, LIST("lockers"), LIST("depots"), "status")


@query("a15_outcome_counts", "select o_custkey % 40 as region_id, count(*) filter (o_orderstatus = 'F') as feasible, count(*) filter (o_orderstatus = 'O') as unsat, count(*) filter (o_orderstatus not in ('F', 'O')) as other from orders group by 1")
def a15(spark, d):
    o = City(spark, d).table("orders")
    status = F.when(F.col("o_orderstatus") == "F", "feasible").when(F.col("o_orderstatus") == "O", "unsat").otherwise("timeout")
    return whatif.outcome_counts(o.select((F.col("o_custkey") % 40).alias(KEY), status.alias("status")))


@query("e12_request_grid", sql("breq", "select region_id, request_id, max_lockers, max_depots, locker_capacity, outage_tolerance from breq"))
def e12(spark, d):
    return Blocks(spark, d).grid().select(KEY, "request_id", "max_lockers", "max_depots", "locker_capacity", "outage_tolerance")


@query("e13_funnel", sql("screened lstage", "select region_id, request_id, stage, count(*) as rows from screened group by 1, 2, 3 union all select region_id, request_id, 'lockers_' || stage, count(*) from lstage group by 1, 2, 3"))
def e13(spark, d):
    b = Blocks(spark, d)
    cells, lockers, depots, walks, flights = b.world()
    reach = Reach(cells, lockers, walks)
    first = whatif.screen_lockers(b.requests(), cells, lockers, walks, reach).withColumn("stage", F.concat(F.lit("lockers_"), "stage"))
    return whatif.funnel(whatif.screen(b.requests(), *b.world(), reach)).unionByName(whatif.funnel(first))


@query(
    "e13_search_counters",
    sql("decided lstage lsel dsel_", """, sizes as (select r.region_id, r.request_id, (select count(*) from lsel s where s.region_id = r.region_id and s.request_id = r.request_id) as l_space,
      (select count(*) from dsel_ s where s.region_id = r.region_id and s.request_id = r.request_id) as d_space from breq r),
    ahead as (select d.region_id, d.request_id, count(*) as n from decided d join lstage s on s.region_id = d.region_id and s.request_id = d.request_id and s.stage = 'passes' and (d.l_ordinal is null or s.ordinal < d.l_ordinal) group by 1, 2)
    select d.region_id, d.request_id, status, case status when 'feasible' then l_ordinal + 1 when 'unsat' then l_space else 0 end as locker_sets_checked,
      case status when 'feasible' then coalesce(a.n, 0) * d_space + d_ordinal + 1 when 'unsat' then coalesce(a.n, 0) * d_space else 0 end as site_selections_checked
    from decided d join sizes using (region_id, request_id) left join ahead a using (region_id, request_id)"""),
)
def e13_counters(spark, d):
    """How many selections the search of each request tries, in enumeration order."""
    return whatif.search_counters(Blocks(spark, d).search())


@query("e14_blocking_rules")
def e14(spark, d):
    b = Blocks(spark, d)
    results, _ = b.sweep()
    stuck = b.requests().join(results.where("status = 'unsat'"), whatif.REQ, "left_semi")
    return whatif.blocking_rules(*b.world(), stuck)


@query("t4_first_feasible", sql("screened", "select region_id, request_id, array_to_string(arg_min(lockers, l_ordinal), ',') as members, min(l_ordinal) as ordinal from screened where stage = 'passes' group by 1, 2"))
def t4(spark, d):
    b = Blocks(spark, d)
    kept = whatif.screen(b.requests(), *b.world()).where("stage = 'passes'")
    return whatif.first_feasible(kept.select(KEY, "request_id", F.col("lockers").alias("members"), F.col("l_ordinal").alias("ordinal"))).select(KEY, "request_id", LIST("members"), "ordinal")


@query("w3_supply_order", sql("bf", "select region_id, locker_id, n_choices, weight, (row_number() over (partition by region_id order by n_choices, weight desc, locker_id::varchar) - 1)::int as pos from (select region_id, locker_id, count(*) filter (return_mm <= 6000000) as n_choices, 200 + locker_id * 37 % 300 as weight from bf group by 1, 2)"))
def w3(spark, d):
    b = Blocks(spark, d)
    n = b.flights().groupBy(KEY, "locker_id").agg(F.count_if(F.col("return_mm") <= b.FLIGHT_MM).alias("n_choices"))
    rows = n.select(F.col(KEY).alias("sel"), F.col("locker_id").alias("item"), (F.lit(200) + F.col("locker_id") * 37 % 300).alias("weight"), "n_choices")
    return whatif.supply_order(rows).select(F.col("sel").alias(KEY), F.col("item").alias("locker_id"), "n_choices", "weight", "pos")


def _fact(n: str) -> str:
    return f"(factorial(({n})::int))::hugeint"


@query("a10_selection_space", f"select s_suppkey as region_id, ({_fact('8 + s_suppkey % 16')} / {_fact('3 + s_suppkey % 5')} / {_fact('5 + s_suppkey % 16 - s_suppkey % 5')})::bigint * 15 as size from supplier where s_suppkey % 16 + 5 >= s_suppkey % 5".replace(" / ", " // "))
def a10(spark, d):
    k = F.col("s_suppkey")
    regions = City(spark, d).table("supplier").select(k.alias(KEY), (8 + k % 16).alias("lockers"), (3 + k % 5).alias("max_lockers"), F.lit(6).alias("depots"), F.lit(4).alias("max_depots"))
    return whatif.selection_space(regions)


@query("a10_choose", "select p_size as n, 7 as k, case when p_size < 7 then 0 else (factorial(p_size)::hugeint // factorial(7)::hugeint // factorial(p_size - 7)::hugeint)::bigint end as size from (select distinct p_size from part where p_size <= 33)")
def a10b(spark, d):
    n = City(spark, d).table("part").where("p_size <= 33").select(F.col("p_size").alias("n")).distinct()
    return n.select("n", F.lit(7).alias("k"), choose(F.col("n").cast("long"), F.lit(7).cast("long")).alias("size"))


_RUNNING = "p_size::bigint"
for _i in range(1, 7):
    _RUNNING = f"({_RUNNING} * (p_size - {_i}) // {_i + 1})"


@query("a10_choose_every", f"select p_size as n, 7 as k, case when p_size < 7 then 0 else {_RUNNING} end as size from (select distinct p_size from part)")
def a10_every(spark, d):
    """Every size; the SQL of ``a10_choose`` ends at 33, where its factorials leave hugeint."""
    n = City(spark, d).table("part").select(F.col("p_size").alias("n")).distinct()
    return n.select("n", F.lit(7).alias("k"), choose(F.col("n").cast("long"), F.lit(7).cast("long")).alias("size"))


_STATUS = "case {0} % 5 when 0 then 'feasible' when 1 then 'unsat' when 2 then 'timeout' when 3 then 'cancelled' else 'error' end"


@query(
    "r1_reconcile",
    f"""with a as (select o_orderkey as request_id, {_STATUS.format('o_orderkey')} as status_a from orders where o_orderkey % 11 <> 0),
    b as (select o_orderkey as request_id, {_STATUS.format('(o_orderkey // 5)')} as status_b from orders where o_orderkey % 13 <> 0)
    select request_id, status_a, status_b, case when coalesce(status_a in ('feasible', 'unsat'), false) and coalesce(status_b in ('feasible', 'unsat'), false) then case when status_a = status_b then 'agrees' else 'disagrees' end else 'inconclusive' end as conclusion
    from a full join b using (request_id)""",
)
def r1(spark, d):
    o = City(spark, d).table("orders").select(F.lit(0).alias(KEY), F.col("o_orderkey").alias("request_id"))
    names = F.array(*[F.lit(s) for s in ("feasible", "unsat", "timeout", "cancelled", "error")])
    a = o.where("request_id % 11 <> 0").withColumn("status", F.get(names, (F.col("request_id") % 5).cast("int")))
    b = o.where("request_id % 13 <> 0").withColumn("status", F.get(names, (F.floor(F.col("request_id") / 5) % 5).cast("int")))
    return reports.reconcile(a, b).drop(KEY)


_DEG = "(select region_id, min(c) as {0}_min, list_sort(list(c))[count(*) // 2 + 1] as {0}_median, max(c) as {0}_max, sum(c)::bigint as {0}_total from {1} group by 1)"


@query(
    "r2_complexity_report",
    sql(
        "bc bl bd bw bf dsets dm",
        ", wd as (select c.region_id, c.cell_id, count(w.locker_id) as c from bc c left join bw w using (region_id, cell_id) group by 1, 2), sd as (select l.region_id, l.site_id, count(f.depot_id) filter (f.return_mm <= 6000000) as c from bl l left join bf f on f.region_id = l.region_id and f.locker_id = l.site_id group by 1, 2)"
        + f""" select region_id, cells, lockers, depots, selections, walk_min, walk_median, walk_max, walk_total, supply_min, supply_median, supply_max, supply_total, reduced_sets from
        (select region_id, count(*) as cells from bc group by 1) join (select region_id, count(*) as lockers from bl group by 1) using (region_id) join (select region_id, count(*) as depots from bd group by 1) using (region_id)
        join (select l.region_id, case when l.n >= 3 and d.n >= 2 then (case l.n when 3 then 1 else 4 end) * (case d.n when 2 then 1 else 3 end) else 0 end::bigint as selections from (select region_id, count(*) as n from bl group by 1) l join (select region_id, count(*) as n from bd group by 1) d using (region_id)) using (region_id)
        join {_DEG.format('walk', 'wd')} using (region_id) join {_DEG.format('supply', 'sd')} using (region_id) left join (select region_id, count(*) as reduced_sets from dsets where k = 1 group by 1) using (region_id)""",
    ),
)
def r2(spark, d):
    b = Blocks(spark, d)
    out = reports.complexity_report(*b.world(), b.limits().select(KEY, "max_lockers", "max_depots", "flight_limit_mm"))
    return out.drop("walk_log10_space", "supply_log10_space", "reduced_full", "reduced_best")


@query("r3_expansion_report")
def r3(spark, d):
    """Every block's own expansion: shortlist from its walks, extra depots, witnesses for three and four."""
    b = Blocks(spark, d)
    cells, lockers, depots, walks, _ = b.world()
    nodes = lockers.select(KEY, "node_id", "x_mm", "y_mm").dropDuplicates([KEY, "node_id"]).unionByName(cells.select(KEY, "node_id", "x_mm", "y_mm")).dropDuplicates([KEY, "node_id"])
    reach = walks.join(lockers.select(KEY, F.col("site_id").alias("locker_id"), "node_id"), [KEY, "locker_id"]).groupBy(KEY, "node_id", "cell_id").agg(F.min("distance_mm").alias("distance_mm"))
    report = reports.expansion_report(cells, nodes, depots, reach, 1, 80_000, b.FLIGHT_MM, 3)
    n = report["lockers"].groupBy(KEY).agg(F.count(F.lit(1)).alias("lockers"), F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"), F.sum("depots_in_reach").alias("flights_in_reach"), F.sum("cells_in_reach").alias("walks_in_reach"))
    sets = [report["witness"][k].groupBy(KEY).agg(F.count(F.lit(1)).alias(f"{name}_sets"), F.count("witness").alias(f"{name}_with_cover")) for k, name in ((3, "three"), (4, "four"))]
    best = whatif.best_coverage(report["audit"][3]).select(KEY, F.col("best").alias("three_best"))
    size = report["selections"].where("k = 4").select(KEY, F.col("size").alias("selections"))
    out = report["status"].join(n, KEY, "left").join(report["extra"].groupBy(KEY).agg(F.sum("offset_mm").alias("offset_mm")), KEY, "left")
    for t in (*sets, best, size):
        out = out.join(t, KEY, "left")
    return out


@query(
    "r4_result_summary",
    sql("decided screened bc", """select d.region_id, d.request_id, d.status, case d.status when 'unsat' then 'no network with any selection of the candidates' when 'error' then 'not verified'
      else bit_count(s.lm) || ' lockers · ' || bit_count(s.dmask) || ' depots · ' || c.parcels || ' parcels · ' || c.cells || ' walks checked' end as summary
      from decided d left join screened s on s.region_id = d.region_id and s.request_id = d.request_id and s.l_ordinal = d.l_ordinal and s.d_ordinal = d.d_ordinal
      left join (select region_id, sum(parcels)::bigint as parcels, count(*) as cells from bc group by 1) c on c.region_id = d.region_id"""),
)
def r4(spark, d):
    b = Blocks(spark, d)
    audit = b.found_plans()
    return reports.result_summary(b.search().results, audit.verification(audit.errors()), audit.sites, b.requests())


_SUMMARY = """select plan_id as request_id, case plan_id % 5 when 0 then 'unsat' when 1 then 'timeout' when 2 then 'error' else 'feasible' end as status,
  case when plan_id % 5 = 0 then 'no network with ' || case when fixed_lockers is not null or fixed_depots is not null then 'this selection' else 'any selection of the candidates' end when plan_id % 5 = 1 then 'no conclusion' when plan_id % 5 = 2 then 'not verified'
  else (select count(*) from plan_sites s where s.plan_id = r.plan_id and kind = 'locker') || ' lockers · ' || (select count(*) from plan_sites s where s.plan_id = r.plan_id and kind = 'depot') || ' depots · '
    || coalesce((select sum(parcels) from judged j where j.plan_id = r.plan_id and good), 0)::bigint || ' parcels · ' || (select count(*) from judged j where j.plan_id = r.plan_id and good) || ' walks checked' end as summary from requests r"""


@query("r4_plan_summary", sql("requests plan_sites judged", _SUMMARY))
def r4_plans(spark, d):
    """Summaries of the city's plans, with a status for each."""
    a = Plans(spark, d).audit()
    p = F.col("plan_id") % 5
    status = F.when(p == 0, "unsat").when(p == 1, "timeout").when(p == 2, "error").otherwise("feasible")
    requests = a.requests.withColumnRenamed("plan_id", "request_id")
    results = a.requests.select(KEY, F.col("plan_id").alias("request_id"), status.alias("status"))
    return reports.result_summary(results, a.verification(a.errors()), a.sites, requests).drop(KEY)
