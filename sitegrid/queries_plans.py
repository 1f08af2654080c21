"""Registered queries on plans: loads, conservation, validation, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import KEY, WALK_MM, Plans
from .operators import spatial
from .oracles import sql
from .plans import verify
from .registry import query


@query("w5_first_valid", sql("judged", "select plan_id, pos, cell_id, locker_id, good from judged"))
def w5(spark, d):
    return Plans(spark, d).audit().judged.select("plan_id", "pos", "cell_id", "locker_id", "good")


@query("a1_locker_loads", sql("loads", "select plan_id, locker_id, load from loads"))
def a1(spark, d):
    return Plans(spark, d).audit().loads.drop(KEY)


@query("a2_depot_loads", sql("sloads", "select plan_id, depot_id, load from sloads where outage_depot is null"))
def a2(spark, d):
    a = Plans(spark, d).audit()
    return verify.depot_loads(a.sites, a.supplies, a.loads).drop(KEY)


@query("a3_outage_loads", sql("sloads", "select plan_id, outage_depot, depot_id, load from sloads where outage_depot is not null and outage_depot <> depot_id"))
def a3(spark, d):
    a = Plans(spark, d).audit()
    return verify.outage_loads(a.sites, a.supplies, a.loads, a.scopes).drop(KEY)


@query(
    "a4_conservation",
    sql(
        "requests cells judged sloads",
        """, g as (select plan_id, sum(parcels)::bigint as assigned from judged where good group by 1),
        s as (select plan_id, outage_depot, sum(load)::bigint as s from sloads group by 1, 2)
        select r.plan_id, (select sum(parcels)::bigint from cells) as demanded, coalesce(assigned, 0)::bigint as assigned,
        coalesce((select s from s where s.plan_id = r.plan_id and outage_depot is null), 0)::bigint as supplied,
        coalesce((select bool_and(s = coalesce(assigned, 0)) from s where s.plan_id = r.plan_id and outage_depot is not null), true) as outages_balanced
        from requests r left join g using (plan_id)""",
    ),
)
def a4(spark, d):
    a = Plans(spark, d).audit()
    return verify.conservation(a.requests, a.cells, a.judged, a.scope_loads).drop(KEY)


@query(
    "a5_plan_extremes",
    sql(
        "requests judged supplies",
        """select r.plan_id, coalesce((select max(measured_mm) from judged j where j.plan_id = r.plan_id and good), 0)::bigint as worst_walk_mm,
        (select count(*) from judged j where j.plan_id = r.plan_id and good) as routes_checked,
        coalesce((select max(return_mm) from supplies j where j.plan_id = r.plan_id and good), 0)::bigint as longest_flight_mm from requests r""",
    ),
)
def a5(spark, d):
    a = Plans(spark, d).audit()
    return verify.plan_extremes(a.requests, a.judged, a.supplies).drop(KEY)


@query(
    "a13_utilisation",
    sql(
        "loads supplies sloads requests",
        """select plan_id, 'locker' as kind, null::bigint as outage_depot, l.locker_id as site_id, s.depot_id as supplier, l.load, case when locker_capacity > 0 then l.load / locker_capacity end as share
        from loads l left join (select * from supplies where good and outage_depot is null) s using (plan_id, locker_id) join requests using (plan_id)
        union all select plan_id, 'depot', outage_depot, depot_id, null, load, case when depot_capacity > 0 then load / depot_capacity end from sloads join requests using (plan_id)""",
    ),
)
def a13(spark, d):
    a = Plans(spark, d).audit()
    return verify.utilisation(a.requests, a.loads, a.supplies, a.scope_loads).drop(KEY)


_MATCH = """select r.plan_id, case when f is not null then len(c) = len(f) and len(list_filter(f, lambda x: not list_contains(c, x))) = 0 end as matches from
 (select r.plan_id, any_value(fixed_lockers) as f, coalesce(list(s.site_id) filter (s.site_id is not null), []) as c from requests r left join plan_sites s on s.plan_id = r.plan_id and s.kind = 'locker' group by 1) r"""


@query("u2_selection_matches", sql("requests plan_sites", _MATCH))
def u2(spark, d):
    a = Plans(spark, d).audit()
    return verify.selection_matches(a.sites, a.requests, "locker").drop(KEY)


@query("u5_unknown_sites", sql("plan_sites depots", "select plan_id, site_id from plan_sites where kind = 'depot' and site_id not in (select site_id from depots)"))
def u5(spark, d):
    a = Plans(spark, d).audit()
    return verify.unknown_sites(a.sites.where("kind = 'depot'"), a.depots).select("plan_id", "site_id")


@query("v2_validate_requests", sql("invalid", "select plan_id, problem from invalid"))
def v2(spark, d):
    a = Plans(spark, d).audit()
    return verify.validate_requests(a.requests, a.lockers, a.depots).drop(KEY)


@query("v3_plan_errors", sql("errors", "select plan_id, code, scope, n from errors"))
def v3(spark, d):
    return Plans(spark, d).audit().errors().drop(KEY)


@query(
    "v3_verify_plans",
    sql(
        "errors requests judged supplies",
        """select r.plan_id, not exists (select 1 from errors e where e.plan_id = r.plan_id) as valid,
        coalesce((select string_agg(code, ',' order by code) from (select distinct code from errors e where e.plan_id = r.plan_id)), '') as errors,
        coalesce((select sum(parcels) from judged j where j.plan_id = r.plan_id and good), 0)::bigint as parcel_total,
        coalesce((select max(measured_mm) from judged j where j.plan_id = r.plan_id and good), 0)::bigint as worst_walk_mm,
        coalesce((select max(return_mm) from supplies j where j.plan_id = r.plan_id and good), 0)::bigint as longest_flight_mm,
        (select count(*) from judged j where j.plan_id = r.plan_id and good) as routes_checked from requests r""",
    ),
)
def v3_plans(spark, d):
    a = Plans(spark, d).audit()
    return a.verification(a.errors()).withColumn("errors", F.array_join("errors", ",")).drop(KEY)


@query(
    "v5_rule_groups",
    sql(
        "requests",
        """, g as (select plan_id, unnest([
        {'i': 0, 'rule_id': 'collection', 'label': 'Each cell is served by one open locker within 500 m on foot.'},
        {'i': 1, 'rule_id': 'locker_budget', 'label': 'At most ' || max_lockers || ' lockers are open.'},
        {'i': 2, 'rule_id': 'locker_capacity', 'label': 'No locker handles more than ' || locker_capacity || ' parcels a day.'},
        {'i': 3, 'rule_id': 'supply', 'label': 'Each open locker has one open depot within a return flight of ' || printf('%.1f', flight_limit_mm / 1e6::double) || ' km.'},
        {'i': 4, 'rule_id': 'depot_budget', 'label': 'At most ' || max_depots || ' depots are open.'},
        {'i': 5, 'rule_id': 'depot_capacity', 'label': 'No depot supplies more than ' || depot_capacity || ' parcels a day.'},
        {'i': 6, 'rule_id': case when outage_tolerance = 1 then 'depot_outage_supply' end, 'label': 'After any one depot fails, each open locker has another open depot in range.'},
        {'i': 7, 'rule_id': case when outage_tolerance = 1 then 'depot_outage_capacity' end, 'label': 'After any one depot fails, no other supplies more than ' || depot_capacity || ' parcels a day.'},
        {'i': 8, 'rule_id': case when fixed_lockers is not null then 'fixed_lockers' end, 'label': 'Exactly these lockers are open: ' || case when len(fixed_lockers) > 0 then array_to_string(fixed_lockers, ', ') else 'none' end || '.'},
        {'i': 9, 'rule_id': case when fixed_depots is not null then 'fixed_depots' end, 'label': 'Exactly these depots are open: ' || case when len(fixed_depots) > 0 then array_to_string(fixed_depots, ', ') else 'none' end || '.'}]) as g from requests)
        select plan_id, (row_number() over (partition by plan_id order by g.i) - 1)::int as ord, g.rule_id as rule_id, g.label as label from g where g.rule_id is not null""",
    ),
)
def v5(spark, d):
    return verify.rule_groups(Plans(spark, d).audit().requests).drop(KEY)


_WALK_PROBLEMS = """, s as (select cell_id, locker_id, case when cell_id % 7 = 0 then distance_mm - 1 else distance_mm end as distance_mm from walks where cell_id % 5 <> 0
    union all select cell_id, locker_id, distance_mm from walks where cell_id % 11 = 1 and cell_id % 5 <> 0 and cell_id % 7 <> 0
    union all select cell_id + 10000000, locker_id, distance_mm from walks where cell_id % 13 = 0
    union all select cell_id, 0, 1 from cells where cell_id % 50 = 3),
  t as (select cell_id, locker_id, count(*) as n, min(distance_mm) as low, max(distance_mm) as high from s group by 1, 2),
  b as (select coalesce(w.cell_id, t.cell_id) as cell_id, coalesce(w.locker_id, t.locker_id) as locker_id, w.distance_mm as want, n, low, high from walks w full join t on w.cell_id = t.cell_id and w.locker_id = t.locker_id),
  f as (select b.*, b.cell_id not in (select cell_id from cells) or b.locker_id not in (select site_id from lockers) as strange from b)
  select cell_id, locker_id, 'missing' as problem from f where n is null union all select cell_id, locker_id, 'unknown' from f where n is not null and strange
  union all select cell_id, locker_id, 'ineligible' from f where want is null and not strange union all select cell_id, locker_id, 'distance' from f where low <> want or high <> want
  union all select cell_id, locker_id, 'duplicate' from f where n > 1"""


def _bent_walks(p: Plans):
    w, c = p.walks(), F.col("cell_id")
    out = w.where(c % 5 != 0).withColumn("distance_mm", F.when(c % 7 == 0, F.col("distance_mm") - 1).otherwise(F.col("distance_mm")))
    out = out.unionByName(w.where((c % 11 == 1) & (c % 5 != 0) & (c % 7 != 0))).unionByName(w.where(c % 13 == 0).withColumn("cell_id", c + 10_000_000))
    return out.unionByName(p.cells().where(c % 50 == 3).select(KEY, "cell_id", F.lit(0).cast("long").alias("locker_id"), F.lit(1).cast("long").alias("distance_mm")))


@query("j12_check_walks", sql("walks cells lockers", _WALK_PROBLEMS))
def j12(spark, d):
    p = Plans(spark, d)
    return verify.check_walks(p.walks(), _bent_walks(p), p.cells(), p.lockers()).drop(KEY)


@query(
    "j13_check_flights",
    sql(
        "flights",
        """, s as (select locker_id, depot_id, case when locker_id % 7 = 0 then return_mm // 2 else return_mm end as return_mm from flights where (locker_id + depot_id) % 5 <> 0
        union all select locker_id, depot_id, return_mm from flights where (locker_id + depot_id) % 5 = 1 and locker_id % 7 <> 0 union all select locker_id, depot_id + 1000, 1 from flights where depot_id = 3),
      t as (select locker_id, depot_id, count(*) as n, min(return_mm) as low, max(return_mm) as high from s group by 1, 2),
      b as (select coalesce(w.locker_id, t.locker_id) as locker_id, coalesce(w.depot_id, t.depot_id) as depot_id, w.return_mm as want, n, low, high from flights w full join t on w.locker_id = t.locker_id and w.depot_id = t.depot_id)
      select locker_id, depot_id, 'missing' as problem from b where n is null union all select locker_id, depot_id, 'unknown' from b where want is null
      union all select locker_id, depot_id, 'distance' from b where low <> want or high <> want union all select locker_id, depot_id, 'duplicate' from b where n > 1""",
    ),
)
def j13(spark, d):
    p = Plans(spark, d)
    m = spatial.pair_matrix(p.lockers(), p.depots())
    s, k = F.col("locker_id"), (F.col("locker_id") + F.col("depot_id")) % 5
    bent = m.where(k != 0).withColumn("return_mm", F.when(s % 7 == 0, F.floor(F.col("return_mm") / 2)).otherwise(F.col("return_mm")))
    bent = bent.unionByName(m.where((k == 1) & (s % 7 != 0))).unionByName(m.where("depot_id = 3").withColumns({"depot_id": F.col("depot_id") + 1000, "return_mm": F.lit(1).cast("long")}))
    return verify.check_flights(m, bent).drop(KEY)


@query(
    "v4_check_starter",
    sql(
        "cells walks chosen",
        """, s as (select cell_id, locker_id from (select *, row_number() over (partition by cell_id order by distance_mm, locker_id) as r from chosen) where r = 1 and cell_id % 9 <> 0
          union all select cell_id, 1 from cells where cell_id % 45 = 1 union all select cell_id, 0 from cells where cell_id % 90 = 1),
        l as (select locker_id, sum(parcels) as load from s join cells using (cell_id) group by 1)
        select 'unserved' as problem, count(*) as n from cells where cell_id not in (select cell_id from s) having count(*) > 0
        union all select 'repeated', count(*) from (select cell_id from s group by 1 having count(*) > 1) having count(*) > 0
        union all select 'unreachable', count(*) from s where not exists (select 1 from walks w where w.cell_id = s.cell_id and w.locker_id = s.locker_id) having count(*) > 0
        union all select 'load', count(*) from l where load <= 0 or load > 60 having count(*) > 0""",
    ),
)
def v4(spark, d):
    from .operators.coverage import nearest_choice

    p = Plans(spark, d)
    starter = nearest_choice(p.walks(), p.selection()).where("cell_id % 9 <> 0").select(KEY, "cell_id", "locker_id")
    bad = p.cells().where("cell_id % 45 = 1").select(KEY, "cell_id", F.lit(1).cast("long").alias("locker_id")).unionByName(p.cells().where("cell_id % 90 = 1").select(KEY, "cell_id", F.lit(0).cast("long").alias("locker_id")))
    return verify.check_starter(p.cells(), p.walks(), starter.unionByName(bad), 60).drop(KEY)


@query(
    "v1_validate_regions",
    sql(
        "walks cells lockers nodes edges",
        _WALK_PROBLEMS.split("\n  select")[0]
        + """, pr as (select 'walks' as "check", cell_id || '>' || locker_id as entity, problem as detail from (select cell_id, locker_id, 'missing' as problem from f where n is null
          union all select cell_id, locker_id, 'unknown' from f where n is not null and strange union all select cell_id, locker_id, 'ineligible' from f where want is null and not strange
          union all select cell_id, locker_id, 'distance' from f where low <> want or high <> want union all select cell_id, locker_id, 'duplicate' from f where n > 1))
        select * from pr union all select 'graph', edge_id, 'bad_length' from edges where src % 89 = 0
        union all select 'coordinates', node_id::varchar, '' from nodes where node_id % 100 = 17
        union all select 'demand', cell_id::varchar, '' from cells where cell_id % 31 = 0 union all select 'connector', cell_id::varchar, '' from cells where cell_id % 71 = 0
        union all select 'site_node', site_id::varchar, '' from lockers where site_id % 10 = 4""",
    ),
)
def v1(spark, d):
    p = Plans(spark, d)
    nodes = p.nodes().withColumn("lon", F.when(F.col("node_id") % 100 == 17, F.lit(200.0)).otherwise(F.col("lon")))
    edges = p.edges().withColumn("length_mm", F.when(F.col("src") % 89 == 0, F.lit(-1).cast("long")).otherwise(F.col("length_mm")))
    cells = p.cells().withColumns({"parcels": F.col("parcels") + F.when(F.col("cell_id") % 31 == 0, 1).otherwise(0), "connector_mm": F.when(F.col("cell_id") % 71 == 0, F.lit(-5).cast("long")).otherwise(F.col("connector_mm"))})
    lockers = p.lockers().withColumn("x_mm", F.col("x_mm") + F.when(F.col("site_id") % 10 == 4, 1).otherwise(0))
    m = spatial.pair_matrix(p.lockers(), p.depots())
    return verify.validate_regions(nodes, edges, cells, lockers, p.depots(), p.walks(), _bent_walks(p), m, m, WALK_MM).drop(KEY)


