"""DuckDB SQL for the registered queries, put together from named common table expressions."""

from __future__ import annotations

from .bindings import FLIGHT_MM, WALK_MM

#: name -> (SQL, names it builds on)
PIECES: dict[str, tuple[str, tuple[str, ...]]] = {
    "np": ("np as (select count(*)::bigint as n from part)", ()),
    "nodes": (
        """nodes as (select 0 as region_id, p_partkey as node_id, p_partkey * 7919 % 10007 * 400 as x_mm, p_partkey * 104729 % 10009 * 400 as y_mm,
        24 + (p_partkey * 7919 % 10007 * 400) / 1e7::double as lon, 60 + (p_partkey * 104729 % 10009 * 400) / 1e7::double as lat from part)""",
        (),
    ),
    "raw_edges": (
        """raw_edges as (select * from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey
        order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as dst, l_quantity, l_returnflag from lineitem) where dst is not null and src <> dst)""",
        (),
    ),
    "edges": ("edges as (select 0 as region_id, src || '-' || dst as edge_id, src, dst, min((l_quantity * 10000)::bigint) as length_mm from raw_edges group by src, dst)", ("raw_edges",)),
    "cells": (
        """cells as (select 0 as region_id, c_custkey as cell_id, c_custkey * 31 % n as node_id, 1 + c_custkey * 37 % 400 as population,
        c_custkey % 7 * 5000 as connector_mm, ceil((1 + c_custkey * 37 % 400) / 10.0)::bigint as parcels from customer, np)""",
        ("np",),
    ),
    "lockers": ("lockers as (select 0 as region_id, s_suppkey as site_id, d.node_id, x_mm, y_mm, lon, lat from supplier, np, nodes d where d.node_id = s_suppkey * 17 % n)", ("np", "nodes")),
    "depots": ("depots as (select 0 as region_id, n_nationkey::bigint as site_id, d.node_id, x_mm, y_mm, lon, lat from nation, np, nodes d where d.node_id = n_nationkey * 101 % n)", ("np", "nodes")),
    "paths": (
        f"""paths(o, n, dist) using key (o, n) as (
        select distinct node_id, node_id, 0::bigint from cells
        union
        select d.o, e.dst, min(d.dist + e.length_mm) from paths d join edges e on e.src = d.n
        left join recurring.paths r on r.o = d.o and r.n = e.dst
        where d.dist + e.length_mm <= {WALK_MM} and (r.dist is null or d.dist + e.length_mm < r.dist) group by 1, 2)""",
        ("cells", "edges"),
    ),
    "reach": (f"reach as (select 0 as region_id, n as node_id, cell_id, dist + connector_mm as distance_mm from paths join cells on o = node_id where dist + connector_mm <= {WALK_MM})", ("paths", "cells")),
    "walks": ("walks as (select 0 as region_id, cell_id, site_id as locker_id, distance_mm from reach join lockers using (node_id))", ("reach", "lockers")),
    "sel": ("sel as (select * from lockers where site_id % 3 = 0)", ("lockers",)),
    "dsel": ("dsel as (select * from depots where site_id % 3 = 0)", ("depots",)),
    "chosen": ("chosen as (select * from walks where locker_id in (select site_id from sel))", ("walks", "sel")),
    "flights": (
        """flights as (select 0 as region_id, l.site_id as locker_id, d.site_id as depot_id,
        floor(2 * sqrt((l.x_mm - d.x_mm)::double * (l.x_mm - d.x_mm)::double + (l.y_mm - d.y_mm)::double * (l.y_mm - d.y_mm)::double) + 0.5)::bigint as return_mm from lockers l, depots d)""",
        ("lockers", "depots"),
    ),
    "counts": ("counts as (select c.region_id, c.cell_id, count(w.locker_id) as choices from cells c left join walks w using (cell_id) group by 1, 2)", ("cells", "walks")),
    # -- plans of the city
    "pn": ("pn as (select greatest(1, count(*) // 50)::bigint as p from customer)", ()),
    "mwalks": ("mwalks as (select *, distance_mm + (cell_id % 37 = 0)::int as measured_mm, cell_id % 41 <> 0 as route_ok from walks)", ("walks",)),
    "plan_cells": (
        """plan_cells as (
        select 0 as region_id, o_orderkey % p as plan_id, o_orderkey as pos, o_custkey as cell_id, coalesce(r.locker_id, o_orderkey % (select count(*) from supplier)) as locker_id
        from orders cross join pn
        left join (select cell_id, count(*) as k from walks group by 1) c on c.cell_id = o_custkey
        left join (select *, row_number() over (partition by cell_id order by locker_id) as r from walks) r on r.cell_id = o_custkey and r.r = 1 + o_orderkey % k)""",
        ("pn", "walks"),
    ),
    "plan_sites": (
        """plan_sites as (
        with l as (select distinct plan_id, 'locker' as kind, locker_id as pos, locker_id as site_id from plan_cells where (locker_id + plan_id) % 11 <> 0),
        d as (select unnest(range(p)) as plan_id, 'depot' as kind, n_nationkey::bigint as pos, n_nationkey::bigint as site_id from nation, pn),
        e as (select * from d where (site_id + plan_id) % 5 = 0)
        select 0 as region_id, * from (select * from l union all select plan_id, kind, pos + 1000000, site_id from l where (site_id + plan_id) % 29 = 3
        union all select * from e union all select plan_id, kind, pos, site_id + 1000 from e where plan_id % 12 = 7 and site_id < 5))""",
        ("plan_cells", "pn"),
    ),
    "plan_outages": (
        """plan_outages as (
        with d as (select * from plan_sites where kind = 'depot' and ((plan_id % 2 = 1 and (plan_id + site_id) % 13 <> 0) or (plan_id % 9 = 4 and plan_id % 2 = 0 and site_id < 5)))
        select plan_id, pos, site_id as depot_id from d union all select plan_id, pos, site_id + site_id % 2 from d where plan_id % 14 = 9)""",
        ("plan_sites",),
    ),
    "plan_supply": (
        """plan_supply as (
        with ds as (select plan_id, list_sort(list(distinct site_id)) as ds from plan_sites where kind = 'depot' and site_id < 1000 group by 1),
        r as (select s.plan_id, s.pos, s.site_id as locker_id, ds, unnest(case when s.plan_id % 2 = 1 then range(len(ds) + 1) else [0] end) as k from plan_sites s join ds using (plan_id) where kind = 'locker'),
        j as (select *, (locker_id + plan_id) % len(ds) as j0 from r where (locker_id + plan_id * 3 + k) % 97 <> 0),
        m as (select *, case when j0 = k - 1 and plan_id % 3 = 0 then (j0 + 1) % len(ds) else j0 end as j from j)
        select plan_id, pos * 100 + k as pos, case when k > 0 then ds[k] end as outage_depot, locker_id, ds[j + 1] as depot_id from m)""",
        ("plan_sites",),
    ),
    "requests": (
        """requests as (
        with ls as (select plan_id, list_sort(list(distinct site_id)) as ls from plan_sites where kind = 'locker' group by 1),
        q as (select unnest(range(p)) as plan_id from pn)
        select plan_id, 20 + plan_id % 3 * 20 as max_lockers, 4 + plan_id % 3 as max_depots, 40 + plan_id % 4 * 40 as locker_capacity,
        case when plan_id % 16 = 11 then 20000 else 400 + plan_id % 5 * 400 end as depot_capacity, 2000000 + plan_id % 3 * 500000 as flight_limit_mm,
        case when plan_id % 6 <> 0 then plan_id % 2 end as outage_tolerance,
        case when plan_id % 10 = 1 then ls when plan_id % 10 = 2 then ls[2:] end as fixed_lockers,
        case when plan_id % 8 = 5 then []::bigint[] when plan_id % 8 = 6 then [3, 4000, 3]::bigint[] end as fixed_depots,
        case when plan_id % 15 = 14 then 0 else 1000 + plan_id end as timeout_ms from q left join ls using (plan_id))""",
        ("plan_sites", "pn"),
    ),
    "pl": ("pl as (select distinct plan_id, site_id as locker_id from plan_sites where kind = 'locker')", ("plan_sites",)),
    "pd": ("pd as (select distinct plan_id, site_id as depot_id from plan_sites where kind = 'depot')", ("plan_sites",)),
    "judged": (
        """judged as (
        with v as (select a.*, c.parcels, w.distance_mm, w.measured_mm, w.route_ok, c.parcels is not null and pl.locker_id is not null and w.distance_mm is not null as valid
          from plan_cells a left join cells c using (cell_id) left join pl on pl.plan_id = a.plan_id and pl.locker_id = a.locker_id
          left join mwalks w on w.cell_id = a.cell_id and w.locker_id = a.locker_id)
        select *, valid and row_number() over (partition by plan_id, cell_id, valid order by pos) = 1 as good from v)""",
        ("plan_cells", "cells", "pl", "mwalks"),
    ),
    "loads": ("loads as (select pl.plan_id, pl.locker_id, coalesce(sum(parcels) filter (good), 0)::bigint as load from pl left join judged j on j.plan_id = pl.plan_id and j.locker_id = pl.locker_id group by 1, 2)", ("pl", "judged")),
    "scopes": (
        """scopes as (select distinct o.plan_id, o.depot_id as outage_depot from plan_outages o join pd using (plan_id, depot_id) join requests r using (plan_id) where r.outage_tolerance = 1)""",
        ("plan_outages", "pd", "requests"),
    ),
    "supplies": (
        """supplies as (
        with s as (select * from plan_supply where outage_depot is null union all select p.* from plan_supply p join scopes using (plan_id, outage_depot)),
        v as (select s.*, floor(2 * sqrt((l.x_mm - d.x_mm)::double * (l.x_mm - d.x_mm)::double + (l.y_mm - d.y_mm)::double * (l.y_mm - d.y_mm)::double) + 0.5)::bigint as return_mm,
          l.site_id is not null and d.site_id is not null and pl.locker_id is not null and pd.depot_id is not null and s.depot_id is distinct from s.outage_depot as valid
          from s left join lockers l on l.site_id = s.locker_id left join depots d on d.site_id = s.depot_id
          left join pl on pl.plan_id = s.plan_id and pl.locker_id = s.locker_id left join pd on pd.plan_id = s.plan_id and pd.depot_id = s.depot_id)
        select *, valid and row_number() over (partition by plan_id, outage_depot, locker_id, valid order by pos) = 1 as good from v)""",
        ("plan_supply", "scopes", "lockers", "depots", "pl", "pd"),
    ),
    "sloads": (
        """sloads as (
        with e as (select plan_id, null::bigint as outage_depot, depot_id from pd union all select plan_id, outage_depot, depot_id from pd join scopes using (plan_id))
        select e.plan_id, e.outage_depot, e.depot_id, coalesce(sum(l.load), 0)::bigint as load, count(l.load) as lockers from e
        left join supplies s on s.plan_id = e.plan_id and s.outage_depot is not distinct from e.outage_depot and s.depot_id = e.depot_id and s.good
        left join loads l on l.plan_id = s.plan_id and l.locker_id = s.locker_id group by 1, 2, 3)""",
        ("pd", "scopes", "supplies", "loads"),
    ),
    "invalid": (
        """invalid as (
        with r as (select *, (select count(*) from supplier) as nl, (select count(*) from nation) as nd from requests),
        u as (select plan_id, unnest(fixed_lockers) as id, 'locker' as kind from requests union all select plan_id, unnest(fixed_depots), 'depot' from requests)
        select distinct plan_id, 'unknown_' || kind as problem from u where (kind = 'locker' and id not in (select site_id from lockers)) or (kind = 'depot' and id not in (select site_id from depots))
        union all select plan_id, 'max_lockers' from r where max_lockers not between 0 and nl union all select plan_id, 'max_depots' from r where max_depots not between 0 and nd
        union all select plan_id, 'locker_capacity' from r where locker_capacity not between 0 and 10000 union all select plan_id, 'depot_capacity' from r where depot_capacity not between 0 and 10000
        union all select plan_id, 'flight_limit' from r where flight_limit_mm not between 0 and 10000000 union all select plan_id, 'timeout' from r where timeout_ms not between 1 and 30000
        union all select plan_id, 'tolerance' from r where outage_tolerance is not null and outage_tolerance not in (0, 1)
        union all select plan_id, 'repeated_locker' from r where len(list_distinct(fixed_lockers)) < len(fixed_lockers)
        union all select plan_id, 'repeated_depot' from r where len(list_distinct(fixed_depots)) < len(fixed_depots))""",
        ("requests", "lockers", "depots"),
    ),
    "errors": (
        """errors as (
        with req as (select *, coalesce(outage_tolerance, 0) as tol from requests),
        lists as (select r.plan_id, k.kind, coalesce(list(s.site_id) filter (s.site_id is not null), []) as chosen,
            case when k.kind = 'locker' then any_value(r.max_lockers) else any_value(r.max_depots) end as most,
            case when k.kind = 'locker' then any_value(r.fixed_lockers) else any_value(r.fixed_depots) end as fixed
          from req r cross join (values ('locker'), ('depot')) k(kind) left join plan_sites s on s.plan_id = r.plan_id and s.kind = k.kind group by 1, 2),
        strange as (select distinct plan_id, kind from plan_sites where (kind = 'locker' and site_id not in (select site_id from lockers)) or (kind = 'depot' and site_id not in (select site_id from depots))
          union select plan_id, kind from lists where len(chosen) > len(list_distinct(chosen))),
        got as (select plan_id, sum(parcels)::bigint as got, count(*) as n from judged where good group by 1),
        every as (select plan_id, null::bigint as outage_depot from req union all select plan_id, outage_depot from scopes),
        per as (select e.plan_id, e.outage_depot, count(s.locker_id) as supplied, count(distinct s.depot_id) as used,
            (select coalesce(sum(load), 0) from sloads x where x.plan_id = e.plan_id and x.outage_depot is not distinct from e.outage_depot) as carried,
            (select count(*) from plan_sites x where x.plan_id = e.plan_id and kind = 'locker') as nl, (select count(*) from plan_sites x where x.plan_id = e.plan_id and kind = 'depot') as nd,
            coalesce((select got from got g where g.plan_id = e.plan_id), 0) as got
          from every e left join supplies s on s.plan_id = e.plan_id and s.outage_depot is not distinct from e.outage_depot and s.good group by 1, 2),
        tout as (select o.* from plan_outages o join req using (plan_id) where tol = 1),
        missing as (select plan_id from req r where tol = 1 and (select count(*) from tout t where t.plan_id = r.plan_id) <> (select count(*) from plan_sites s where s.plan_id = r.plan_id and kind = 'depot')
          union select plan_id from pd join req using (plan_id) where tol = 1 and not exists (select 1 from tout t where t.plan_id = pd.plan_id and t.depot_id = pd.depot_id)),
        z(plan_id, code, scope, n) as (
          select plan_id, 'invalid_request', '', count(*) from invalid group by 1
          union all select plan_id, 'site_unknown_or_dup', kind, 1 from strange
          union all select plan_id, 'too_many', kind, 1 from lists where len(chosen) > most
          union all select plan_id, 'exact_changed', kind, 1 from lists where fixed is not null and (len(chosen) <> len(fixed) or len(list_filter(fixed, lambda x: not list_contains(chosen, x))) > 0)
          union all select plan_id, 'bad_assignment', '', count(*) from judged where not good group by 1
          union all select plan_id, 'walk_limit', '', count(*) from judged where good and (measured_mm > WALK_LIMIT or measured_mm <> distance_mm) group by 1
          union all select plan_id, 'broken_route', '', count(*) from judged where good and not route_ok group by 1
          union all select r.plan_id, 'demand_not_covered', '', 1 from req r left join got g using (plan_id) where coalesce(n, 0) <> (select count(*) from cells) or coalesce(got, 0) <> (select sum(parcels) from cells)
          union all select plan_id, 'locker_capacity_or_use', '', count(*) from loads join req using (plan_id) where load <= 0 or load > locker_capacity group by 1
          union all select plan_id, 'bad_supply', coalesce('outage:' || outage_depot, 'normal'), count(*) from supplies where not good group by 1, 3
          union all select plan_id, 'flight_limit', coalesce('outage:' || outage_depot, 'normal'), count(*) from supplies join req using (plan_id) where good and return_mm > flight_limit_mm group by 1, 3
          union all select plan_id, 'supply_incomplete', coalesce('outage:' || outage_depot, 'normal'), 1 from per where supplied <> nl
          union all select plan_id, 'unused_depot', '', 1 from per where outage_depot is null and used <> nd
          union all select plan_id, 'depot_capacity_or_use', coalesce('outage:' || outage_depot, 'normal'), count(*) from sloads join req using (plan_id) where load > depot_capacity or (outage_depot is null and load <= 0) group by 1, 3
          union all select plan_id, 'supply_not_conserved', coalesce('outage:' || outage_depot, 'normal'), 1 from per where carried <> got
          union all select plan_id, 'unexpected_outage', '', count(*) from plan_outages join req using (plan_id) where tol = 0 group by 1
          union all select plan_id, 'outage_unknown_or_dup', '', 1 from (select distinct plan_id from (select plan_id, depot_id, count(*) as c from tout group by 1, 2) t where c > 1 or not exists (select 1 from pd where pd.plan_id = t.plan_id and pd.depot_id = t.depot_id))
          union all select plan_id, 'outage_missing', '', 1 from missing)
        select * from z)""".replace("WALK_LIMIT", str(WALK_MM)),
        ("requests", "plan_sites", "lockers", "depots", "judged", "scopes", "supplies", "sloads", "loads", "plan_outages", "pd", "invalid", "cells"),
    ),
    # -- blocks
    "bl": ("bl as (select s_suppkey // 4 as region_id, s_suppkey as site_id, (s_suppkey % 4)::int as ord, node_id, x_mm, y_mm from supplier, np join nodes on node_id = s_suppkey * 17 % n)", ("np", "nodes")),
    "bd": ("bd as (select s_suppkey // 4 as region_id, s_suppkey as site_id, (s_suppkey % 4)::int as ord, node_id, x_mm, y_mm from supplier, np join nodes on node_id = s_suppkey * 101 % n where s_suppkey % 4 < 3)", ("np", "nodes")),
    "bc": (
        """bc as (with g as (select c_custkey // 10 as cell_id, sum(1 + c_custkey * 37 % 400)::bigint as population from customer group by 1)
        select cell_id // 6 as region_id, cell_id, population, ceil(population / 10.0)::bigint as parcels, node_id, x_mm, y_mm from g, np join nodes on node_id = cell_id * 313 % n where cell_id // 6 in (select region_id from bl))""",
        ("bl", "np", "nodes"),
    ),
    "bw": (
        """bw as (select * from (select c.region_id, c.cell_id, l.site_id as locker_id, l.ord, floor(sqrt((c.x_mm - l.x_mm)::double * (c.x_mm - l.x_mm)::double + (c.y_mm - l.y_mm)::double * (c.y_mm - l.y_mm)::double) + 0.5)::bigint as distance_mm
        from bc c join bl l using (region_id)) where distance_mm <= 2200000)""",
        ("bc", "bl"),
    ),
    "bf": (
        """bf as (select l.region_id, l.site_id as locker_id, d.site_id as depot_id, l.ord as l_ord, d.ord as d_ord, floor(2 * sqrt((l.x_mm - d.x_mm)::double * (l.x_mm - d.x_mm)::double + (l.y_mm - d.y_mm)::double * (l.y_mm - d.y_mm)::double) + 0.5)::bigint as return_mm
        from bl l join bd d using (region_id))""",
        ("bl", "bd"),
    ),
    "breq": (
        """breq as (select region_id, row_number() over (partition by region_id order by max_lockers, max_depots, locker_capacity, outage_tolerance) - 1 as request_id, max_lockers, max_depots, locker_capacity,
        1000 as depot_capacity, 6000000 as flight_limit_mm, outage_tolerance from (select distinct region_id from bl), (values (2), (4)) a(max_lockers), (values (2), (3)) b(max_depots), (values (450), (800)) c(locker_capacity), (values (0), (1)) d(outage_tolerance))""",
        ("bl",),
    ),
    # subsets of up to four places: mask, size and rank among those of the same size
    "subs": ("subs as (select m, bit_count(m)::int as k, list_filter([0, 1, 2, 3], lambda i: (m >> i) & 1 = 1) as places from (select unnest(range(16))::int as m))", ()),
    "lsets": (
        """lsets as (select n.region_id, m, k, places, list_transform(places, lambda p: list_extract(ids, p + 1)) as members from subs,
        (select region_id, list(site_id order by ord) as ids, count(*) as n from bl group by 1) n where m < (1 << n::int))""",
        ("subs", "bl"),
    ),
    "dsets": (
        """dsets as (select n.region_id, m, k, places, list_transform(places, lambda p: list_extract(ids, p + 1)) as members from subs,
        (select region_id, list(site_id order by ord) as ids, count(*) as n from bd group by 1) n where m < (1 << n::int))""",
        ("subs", "bd"),
    ),
    "lsel": ("lsel as (select r.region_id, r.request_id, row_number() over (partition by r.region_id, r.request_id order by k desc, places) - 1 as ordinal, members, m, k from breq r join lsets s on s.region_id = r.region_id and k <= max_lockers)", ("breq", "lsets")),
    "dsel_": ("dsel_ as (select r.region_id, r.request_id, row_number() over (partition by r.region_id, r.request_id order by k desc, places) - 1 as ordinal, members, m, k from breq r join dsets s on s.region_id = r.region_id and k <= max_depots)", ("breq", "dsets")),
    "cm": ("cm as (select c.region_id, c.cell_id, coalesce(bit_or(1 << w.ord), 0)::int as m from bc c left join bw w using (region_id, cell_id) group by 1, 2)", ("bc", "bw")),
    "lstage": (
        """lstage as (select s.*, total, case when k = 0 or total > k * locker_capacity then 'locker_capacity'
        when exists (select 1 from cm where cm.region_id = s.region_id and cm.m & s.m = 0) then 'coverage' when s.m & ~useful <> 0 then 'idle_locker' else 'passes' end as stage
        from lsel s join breq using (region_id, request_id) join (select region_id, bit_or(m) as useful from cm group by 1) using (region_id) join (select region_id, sum(parcels) as total from bc group by 1) using (region_id))""",
        ("lsel", "breq", "cm", "bc"),
    ),
    "dm": ("dm as (select l.region_id, l.ord as l_ord, coalesce(bit_or(1 << f.d_ord) filter (f.return_mm <= 6000000), 0)::int as dm from bl l left join bf f on f.region_id = l.region_id and f.locker_id = l.site_id group by 1, 2)", ("bl", "bf")),
    "screened": (
        """screened as (with x as (select a.region_id, a.request_id, a.ordinal as l_ordinal, a.members as lockers, a.m as lm, b.ordinal as d_ordinal, b.members as depots, b.m as dmask, b.k as dk, a.total, depot_capacity, outage_tolerance,
          (select list(dm.dm & b.m) from dm where dm.region_id = a.region_id and (a.m >> dm.l_ord) & 1 = 1) as own
          from lstage a join dsel_ b using (region_id, request_id) join breq using (region_id, request_id) where a.stage = 'passes')
        select *, case when dk = 0 or total > dk * depot_capacity then 'depot_capacity' when outage_tolerance = 1 and (dk < 2 or total > (dk - 1) * depot_capacity) then 'outage_capacity'
          when list_contains(own, 0) then 'out_of_range' when outage_tolerance = 1 and len(list_filter(own, lambda o: bit_count(o) < 2)) > 0 then 'second_supplier'
          when list_bit_or(own) <> dmask then 'idle_depot' else 'passes' end as stage from x)""",
        ("lstage", "dsel_", "breq", "dm"),
    ),
    "decided": (
        """decided as (with won as (select s.region_id, s.request_id, s.l_ordinal, s.d_ordinal, row_number() over (partition by s.region_id, s.request_id order by s.l_ordinal, s.d_ordinal) as n
          from screened s join breq r using (region_id, request_id) where s.stage = 'passes' and exists (select 1 from served_10 v where v.region_id = s.region_id and v.m = s.lm and v.cap = r.locker_capacity and v.dmask = s.dmask
            and v.normal and (r.outage_tolerance = 0 or v.outages = bit_count(s.dmask))))
        select r.region_id, r.request_id, case when r.max_lockers > l.n or r.max_depots > coalesce(d.n, 0) then 'error' when w.n is not null then 'feasible' else 'unsat' end as status,
          case when r.max_lockers <= l.n and r.max_depots <= d.n then w.l_ordinal end as l_ordinal, case when r.max_lockers <= l.n and r.max_depots <= d.n then w.d_ordinal end as d_ordinal
        from breq r join (select region_id, count(*) as n from bl group by 1) l using (region_id) left join (select region_id, count(*) as n from bd group by 1) d using (region_id)
        left join (select * from won where n = 1) w using (region_id, request_id))""",
        ("screened", "breq", "served_10", "bl", "bd"),
    ),
    # pairs of selections with the limits that they are tried under
    "pairs_10": ("pairs_10 as (select distinct region_id, lm, locker_capacity as cap, dmask, outage_tolerance as tol from screened join breq using (region_id, request_id, outage_tolerance) where stage = 'passes')", ("screened", "breq")),
    "pairs_11": (
        """pairs_11 as (select a.region_id, a.m as lm, 600 as cap, b.m as dmask, 1 as tol, a.members as lockers, b.members as depots from lsets a join dsets b using (region_id) where a.k = 3 and b.k = 2
        and not exists (select 1 from cm where cm.region_id = a.region_id and cm.m & a.m = 0) and not exists (select 1 from dm where dm.region_id = a.region_id and (a.m >> dm.l_ord) & 1 = 1 and dm.dm & b.m = 0))""",
        ("lsets", "dsets", "cm", "dm"),
    ),
}


def _assigned(n: str) -> dict:
    """Pieces with every load vector of the lockers of ``pairs_n``, one cell after another, and of their depots, one
    locker after another: ``served_n`` has those that serve normal operation, and how many outages."""
    return {
        f"asg_{n}": (
            f"""asg_{n}(region_id, m, cap, pos, loads) as (select distinct region_id, lm, cap, 0::bigint, [0, 0, 0, 0]::bigint[] from pairs_{n}
            union select a.region_id, a.m, a.cap, a.pos + 1, list_transform(a.loads, lambda x, i: x + case when i = w.ord + 1 then c.parcels else 0 end)
            from asg_{n} a join (select *, row_number() over (partition by region_id order by cell_id) - 1 as pos from bc) c on c.region_id = a.region_id and c.pos = a.pos
            join bw w on w.region_id = a.region_id and w.cell_id = c.cell_id and (a.m >> w.ord) & 1 = 1 where a.loads[w.ord + 1] + c.parcels <= a.cap)""",
            (f"pairs_{n}", "bc", "bw"),
        ),
        f"fin_{n}": (
            f"""fin_{n} as (select region_id, m, cap, loads from asg_{n} join (select region_id, count(*) as cells from bc group by 1) using (region_id)
            where pos = cells and len(list_filter(loads, lambda x, i: (m >> (i - 1)::int) & 1 = 1 and x = 0)) = 0)""",
            (f"asg_{n}", "bc"),
        ),
        f"sup_{n}": (
            f"""sup_{n}(region_id, m, cap, loads, dmask, gone, pos, sums) as (select distinct f.region_id, f.m, f.cap, f.loads, s.dmask, g.gone, 0, [0, 0, 0]::bigint[]
            from fin_{n} f join pairs_{n} s on s.region_id = f.region_id and s.lm = f.m and s.cap = f.cap
            join (values (-1), (0), (1), (2)) g(gone) on g.gone = -1 or (s.tol = 1 and (s.dmask >> g.gone) & 1 = 1)
            union select x.region_id, x.m, x.cap, x.loads, x.dmask, x.gone, x.pos + 1, list_transform(x.sums, lambda v, i: v + case when i = o.d_ord + 1 then x.loads[x.pos + 1] else 0 end)
            from sup_{n} x join (select region_id, l_ord, d_ord from bf where return_mm <= 6000000 union all select distinct region_id, p, -1 from bl, (values (0), (1), (2), (3)) t(p)) o on o.region_id = x.region_id and o.l_ord = x.pos
            where case when (x.m >> x.pos) & 1 = 0 then o.d_ord = -1 else o.d_ord >= 0 and o.d_ord <> x.gone and (x.dmask >> greatest(o.d_ord, 0)) & 1 = 1 and x.sums[o.d_ord + 1] + x.loads[x.pos + 1] <= 1000 end)""",
            (f"fin_{n}", f"pairs_{n}", "bf", "bl"),
        ),
        f"served_{n}": (
            f"""served_{n} as (select region_id, m, cap, dmask, loads, bool_or(gone = -1) as normal, count(distinct gone) filter (gone >= 0) as outages from sup_{n}
            where pos = 4 and (gone >= 0 or len(list_filter(sums, lambda v, i: (dmask >> (i - 1)::int) & 1 = 1 and v = 0)) = 0) group by 1, 2, 3, 4, 5)""",
            (f"sup_{n}",),
        ),
    }


PIECES |= _assigned("10") | _assigned("11")


def sql(needs: str, body: str) -> str:
    """``body`` with the pieces it needs, and theirs, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in PIECES[name][1]:
            add(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    return f"with recursive {', '.join(PIECES[n][0] for n in order)} {body}" if order else body


FLIGHT = FLIGHT_MM
