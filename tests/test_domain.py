"""Golden scenes, brute force and mutations for the domain operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sitegrid.operators import graph, shortlist, spatial
from sitegrid.plans import reports, whatif
from sitegrid.plans.verify import Audit
from sitegrid.streaming.lifecycle import lifecycle_table
from sitegrid.streaming.requests import Client

REQUEST = "region_id long, request_id long, max_lockers int, max_depots int, locker_capacity int, depot_capacity int, flight_limit_mm int, outage_tolerance int, fixed_lockers array<long>, fixed_depots array<long>, timeout_ms int"


@pytest.fixture(scope="module")
def scene(spark):
    """Two nodes 400 m apart, each with a cell of two parcels, a locker and a depot."""
    make = spark.createDataFrame
    cells = make([(0, c, 20, 2, c, 0) for c in (0, 1)], "region_id long, cell_id long, population long, parcels long, node_id long, connector_mm long")
    site = "region_id long, site_id long, ord int, node_id long, x_mm long, y_mm long"
    sites = make([(0, s, s, s, 400_000 * s, 0) for s in (0, 1)], site)
    walks = make([(0, c, s, 400_000 * (c != s)) for c in (0, 1) for s in (0, 1)], "region_id long, cell_id long, locker_id long, distance_mm long")
    flights = make([(0, s, d, 800_000 * (s != d)) for s in (0, 1) for d in (0, 1)], "region_id long, locker_id long, depot_id long, return_mm long")
    return cells, sites, sites, walks, flights


def brute(r):
    """Status by trying every selection and assignment."""
    if not (0 <= r[2] <= 2 and 0 <= r[3] <= 2) or r[7] not in (None, 0, 1):
        return "error"
    subsets = lambda n, fixed: [tuple(fixed)] if fixed is not None else [s for k in range(n + 1) for s in itertools.combinations((0, 1), k)]
    for ls in subsets(r[2], r[8]):
        for ds in subsets(r[3], r[9]):
            if len(ls) > r[2] or len(ds) > r[3] or not ls or not ds:
                continue
            for to in itertools.product(ls, repeat=2):
                load = {s: 2 * to.count(s) for s in ls}
                if any(v == 0 or v > r[4] for v in load.values()):
                    continue

                def served(alive, all_used):
                    for by in itertools.product(alive, repeat=len(ls)):
                        sums = {d: sum(load[s] for s, b in zip(ls, by, strict=True) if b == d) for d in alive}
                        if all(800_000 * (s != b) <= r[6] for s, b in zip(ls, by, strict=True)) and max(sums.values(), default=0) <= r[5] and (not all_used or all(sums.values())):
                            return True
                    return False

                if served(ds, True) and (r[7] != 1 or all(served([d for d in ds if d != gone], False) for gone in ds)):
                    return "feasible"
    return "unsat"


def requests():
    rows = [(a, b, c, d, f, None, None, None) for a in (1, 2) for b in (1, 2) for c in (3, 4) for d in (2, 4) for f in (600_000, 800_000)]
    rows += [(2, 2, 4, 4, 600_000, None, fl, fd) for fl, fd in (([], None), ([0], None), (None, [0]), ([1], [0]))]
    rows += [(2, 2, 4, 4, 800_000, 1, [0, 1], [0, 1]), (2, 2, 4, 4, 600_000, 1, [0, 1], [0, 1]), (2, 2, 4, 3, 800_000, 1, [0, 1], [0, 1])]
    rows += [(2, 2, 4, 4, 800_000, t, None, None) for t in (2, -1)]
    return [(0, i, *r, 1000) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def swept(spark, scene):
    df = spark.createDataFrame(requests(), REQUEST)
    results, plans = whatif.feasibility_sweep(*scene, df)
    return df, results, plans


def test_sweep_matches_brute_force(swept):
    got = {r.request_id: r.status for r in swept[1].collect()}
    assert got == {r[1]: brute(r) for r in requests()}
    assert [got[i] for i in (36, 37, 38, 39, 40)] == ["feasible", "unsat", "unsat", "error", "error"]


def audit(scene, df, plans, **change):
    tables = plans | change
    known = tables["plan_sites"].select("region_id", "plan_id").distinct()
    req = df.withColumnRenamed("request_id", "plan_id").join(known, ["region_id", "plan_id"], "left_semi")
    cells, lockers, depots, walks, _ = scene
    a = Audit(cells, lockers, depots, walks.withColumns({"measured_mm": F.col("distance_mm"), "route_ok": F.lit(True)}), req, **tables)
    return {r.plan_id: (r.valid, r.errors) for r in a.verification(a.errors()).collect()}


def test_found_plans_verify_and_mutations_do_not(scene, swept):
    df, _, plans = swept
    plans = {k: v.where("plan_id = 36") for k, v in plans.items()}
    assert audit(scene, df, plans) == {36: (True, [])}
    drop = lambda name, cond: {name: plans[name].where(cond)}
    again = lambda name: {name: plans[name].unionByName(plans[name].withColumn("pos", F.col("pos") + 10))}
    failed = plans["plan_supply"].withColumn("depot_id", F.coalesce("outage_depot", "depot_id"))
    for change, code in (
        (drop("plan_cells", "cell_id <> 0"), "demand_not_covered"),
        (again("plan_cells"), "bad_assignment"),
        (drop("plan_sites", "kind <> 'locker' or site_id <> 0"), "exact_changed"),
        (drop("plan_supply", "locker_id <> 0"), "supply_incomplete"),
        (again("plan_supply"), "bad_supply"),
        (drop("plan_outages", "depot_id <> 0"), "outage_missing"),
        ({"plan_supply": failed}, "bad_supply"),
        ({"plan_supply": plans["plan_supply"].withColumn("depot_id", F.lit(0).cast("long"))}, "unused_depot"),
    ):
        valid, errors = audit(scene, df, plans, **change)[36]
        assert not valid and code in errors
    for change, code in (({"locker_capacity": 1}, "locker_capacity_or_use"), ({"depot_capacity": 1}, "depot_capacity_or_use"), ({"flight_limit_mm": 1}, "flight_limit"), ({"outage_tolerance": 0}, "unexpected_outage")):
        bent = df.withColumns({k: F.lit(v) for k, v in change.items()})
        valid, errors = audit(scene, bent, plans)[36]
        assert not valid and code in errors


def test_state_cap_is_no_conclusion(spark, scene):
    df = spark.createDataFrame([requests()[31]], REQUEST)
    assert whatif.feasibility_sweep(*scene, df, max_states=0)[0].first().status == "timeout"


def test_blocking_rules(spark, scene):
    row = (0, 7, 2, 2, 4, 1, 800_000, None, None, None, 1000)
    got = whatif.blocking_rules(*scene, spark.createDataFrame([row], REQUEST)).collect()
    # nothing carried or nobody supplied is no load for the depots either
    assert {(r.request_id, r.rule_id) for r in got} == {(7, "depot_capacity"), (7, "collection"), (7, "supply")}


def test_assignment_matches_depth_first_search(spark):
    rng = random.Random(5)
    items, choices, bins, want = [], [], [], {}
    for s in range(40):
        n, m, cap = rng.randint(1, 3), rng.randint(1, 5), rng.randint(4, 12)
        w = [rng.randint(1, 5) for _ in range(m)]
        ch = [sorted(rng.sample(range(n), rng.randint(1, n))) for _ in range(m)]
        items += [(str(s), i, x) for i, x in enumerate(w)]
        choices += [(str(s), i, k, b) for i, c in enumerate(ch) for k, b in enumerate(c)]
        bins.append((str(s), n, cap, s % 2 == 0))
        found: dict = {}
        for path in itertools.product(*[range(len(c)) for c in ch]):
            load = [0] * n
            for i, k in enumerate(path):
                load[ch[i][k]] += w[i]
            if max(load) <= cap and (s % 2 or min(load) > 0):
                found.setdefault(tuple(load), path)
        want[str(s)] = found
    final, _ = whatif.assign_units(
        spark.createDataFrame(items, "sel string, pos long, weight long"), spark.createDataFrame(choices, "sel string, pos long, rank long, bin long"), spark.createDataFrame(bins, "sel string, n int, capacity int, require_used boolean")
    )
    got: dict = {s: {} for s in want}
    for r in final.collect():
        got[r.sel][tuple(r.loads)] = tuple(r.path)
    assert got == want


def test_boundary_is_inclusive_and_directed(spark):
    edges = spark.createDataFrame([(0, "ab", "a", "b", 500_000), (0, "bc", "b", "c", 1)], "region_id int, edge_id string, src string, dst string, length_mm long")
    starts = spark.createDataFrame([(0, "a", "a", 500_000), (0, "b", "b", 500_000)], "region_id int, origin string, node_id string, budget_mm long")
    got = {(r.origin, r.node_id): (r.dist_mm, r.pred_edge) for r in graph.bounded_paths(edges, starts).collect()}
    assert got == {("a", "a"): (0, None), ("a", "b"): (500_000, "ab"), ("b", "b"): (0, None), ("b", "c"): (1, "bc")}


def test_graph_and_routes_report_faults(spark):
    nodes = spark.createDataFrame([(0, "a"), (0, "b"), (0, "b")], "region_id int, node_id string")
    edges = spark.createDataFrame([(0, "ab", "a", "b", 5), (0, "ab", "a", "b", 5), (0, "ax", "a", "x", 0)], "region_id int, edge_id string, src string, dst string, length_mm long")
    got = sorted((r.check, r.entity) for r in graph.check_graph(nodes, edges).collect())
    assert got == [("bad_length", "ax"), ("dangling_dst", "ax"), ("duplicate_edge", "ab"), ("duplicate_node", "b")]
    empty = edges.limit(0)
    assert graph.check_graph(nodes.limit(0), empty).count() == 0
    assert graph.bounded_paths(empty, nodes.limit(0).withColumns({"origin": F.col("node_id"), "budget_mm": F.lit(1)})).count() == 0


def sequential(reach, at, cells, need, spacing):
    have, chosen, steps = dict.fromkeys(cells, 0), [], []
    while any(v < need for v in have.values()):
        best = None
        for node, opts in reach.items():
            if any((at[node][0] - at[c][0]) ** 2 + (at[node][1] - at[c][1]) ** 2 < spacing**2 for c in chosen):
                continue
            useful = [d for c, d in opts if have[c] < need]
            if useful and (best is None or (-len(useful), max(useful), node) < best):
                best = (-len(useful), max(useful), node)
        if best is None:
            return steps, False
        chosen.append(best[2])
        steps.append((best[2], -best[0], best[1]))
        for c, _ in reach[best[2]]:
            have[c] += 1
    return steps, True


def test_parallel_greedy_equals_sequential(spark):
    rng = random.Random(11)
    reach, nodes, cells, want = [], [], [], {}
    for region in range(12):
        at = {n: (rng.randint(0, 400), rng.randint(0, 400)) for n in range(14)}
        r = {n: [(c, rng.randint(1, 9)) for c in rng.sample(range(6), rng.randint(1, 3))] for n in at}
        nodes += [(region, n, *xy) for n, xy in at.items()]
        reach += [(region, n, c, d) for n, opts in r.items() for c, d in opts]
        cells += [(region, c) for c in range(6)]
        want[region] = sequential(r, at, range(6), 2, 90)
    steps, status = shortlist.greedy_shortlist(
        spark.createDataFrame(reach, "region_id int, node_id int, cell_id int, distance_mm int"), spark.createDataFrame(nodes, "region_id int, node_id int, x_mm int, y_mm int"),
        spark.createDataFrame(cells, "region_id int, cell_id int"), 2, 90,
    )
    got: dict = {}
    for s in sorted(steps.collect(), key=lambda s: s.ord):
        got.setdefault(s.region_id, []).append((s.node_id, s.gain, s.worst_mm))
    done = {r.region_id: r.complete for r in status.collect()}
    for region, (steps_, ok) in want.items():
        assert done[region] == ok
        if ok:
            assert got[region] == steps_


def test_nearest_nodes_skips_taken(spark):
    nodes = spark.createDataFrame([(0, n, 1_000 * n, 0) for n in range(5)], "region_id int, node_id int, x_mm long, y_mm long")
    targets = spark.createDataFrame([(0, "p", 0, 2_100, 0), (0, "q", 1, 2_100, 0)], "region_id int, target_id string, ord int, x_mm long, y_mm long")
    got = {r.target_id: (r.node_id, r.offset_mm) for r in spatial.nearest_nodes(targets, nodes, nodes.where("node_id = 2"), width=500).collect()}
    assert got == {"p": (3, 900), "q": (1, 1_100)}


def test_reconcile_all_status_pairs(spark):
    names = ["feasible", "unsat", "timeout", "cancelled", "error"]
    rows = [(0, 5 * i + j, a, b) for i, a in enumerate(names) for j, b in enumerate(names)]
    make = lambda k: spark.createDataFrame([(r[0], r[1], r[k]) for r in rows], "region_id int, request_id int, status string")
    for r in reports.reconcile(make(2), make(3)).collect():
        sure = r.status_a in names[:2] and r.status_b in names[:2]
        assert r.conclusion == ("inconclusive" if not sure else "agrees" if r.status_a == r.status_b else "disagrees")


def test_client_sequences():
    c = Client()
    assert c.take(0, 0, 1, "solve", 5)[-1][3] == "rejected"
    assert c.take(1, 0, -1, "ready", 0)[-1][3] == "ready"
    assert c.take(2, 0, 1, "solve", 5)[-1][3] == "solving"
    assert c.take(3, 0, 2, "solve", 5)[-1][3] == "rejected"
    assert c.take(4, 0, 2, "result", 0)[-1][3] == "ignored"
    assert c.take(5, 0, 1, "cancel", 0)[-1][3] == "cancelled"
    assert c.take(6, 0, 1, "result", 0)[-1][3] == "stale"
    assert [x[3] for x in (*c.take(7, 1, -1, "ready", 0), *c.take(8, 1, 3, "solve", 5), *c.take(9, 1, 3, "result", 0))] == ["ready", "solving", "finished"]
    c.take(10, 1, 4, "solve", 5)
    assert c.expire(10 + 5 + 5_000 - 1) == [] and c.expire(10 + 5 + 5_000)[0][3] == "timeout"
    d = Client()
    assert d.take(0, 0, -1, "init", 0)[0][3] == "starting" and d.expire(60_000)[0][3] == "start_error"


def test_stream_gives_the_batch_transitions(spark, sf_dir):
    from sitegrid.queries_io import messages, y3

    e = messages(spark, sf_dir)
    until = e.agg((F.unix_millis(F.max("ts")) + 10**9).alias("u")).first().u
    cols = ["client_id", "ts", "generation", "request_id", "transition"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(y3(spark, sf_dir)) == rows(lifecycle_table(e, until))


def test_range_join_equals_matrix_with_filter(spark, sf_dir):
    from sitegrid.bindings import City

    c = City(spark, sf_dir)
    for limit in (999_999, 1_000_000, 3_000_001):
        a = spatial.pairs_within(c.lockers(), c.depots(), limit)
        b = spatial.pair_matrix(c.lockers(), c.depots()).where(F.col("return_mm") <= limit)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_blocking_rules_of_every_unsat_request(spark):
    """Some rules relax a request to another point of the grid, whose status says what they must."""
    from sitegrid.bindings import Blocks
    from sitegrid.queries_whatif import e14

    d = "/root/testdata/sf0.01"
    b = Blocks(spark, d)
    results, _ = b.sweep()
    status = {(r.region_id, r.request_id): r.status for r in results.collect()}
    axes = list(b.AXES)
    grid = {(r.region_id, *(r[a] for a in axes)): r.request_id for r in b.requests().collect()}
    n = {r.region_id: r["count"] for r in b.lockers().groupBy("region_id").count().collect()}
    got = {tuple(r) for r in e14(spark, d).collect()}
    wide = 0
    for (region, *point), request in grid.items():
        if status[region, request] != "unsat":
            assert not any(g[:2] == (region, request) for g in got)
            continue
        for rule, axis, value in (("locker_budget", 0, 4), ("depot_budget", 1, 3), ("depot_outage_supply", 3, 0)):
            there = [value if i == axis else x for i, x in enumerate(point)]
            if n[region] == 4:
                want = status[region, grid[region, *there]] == "feasible"
                assert ((region, request, rule) in got) == want, (region, point, rule)
                wide += want and not (point[0] == 2 and point[2] == 450)
    assert wide > 0


def test_covers_of_more_cells_than_a_word(spark):
    rng = random.Random(7)
    cells, walks, reach = [], [], {}
    for region, n in enumerate((5, 63, 64, 70, 130, 200)):
        cells += [(region, c) for c in range(n)]
        for site in range(7):
            reach[region, site] = {c for c in range(n) if rng.random() < 0.55 or c % 7 == site}
        if region == 3:  # the last cell is out of everyone's reach
            for site in range(7):
                reach[region, site].discard(n - 1)
        if region in (2, 4):  # two sites share the cells
            reach[region, 2], reach[region, 5] = set(range(0, n, 2)), set(range(1, n, 2))
        walks += [(region, site, c) for (r, site), cs in reach.items() if r == region for c in cs]
    sites = [(region, site, site) for region in range(6) for site in range(4)]
    make = spark.createDataFrame
    cells, walks = make(cells, "region_id long, cell_id long"), make(walks, "region_id long, locker_id long, cell_id long")
    flights = make([(region, l, d, 10) for region in range(6) for l in range(7) for d in range(4) if (l + d) % 4 or l == 5], "region_id long, locker_id long, depot_id long, return_mm long")
    n = {r.region_id: r["count"] for r in cells.groupBy("region_id").count().collect()}
    depots = make(sites, "region_id long, site_id long, ord int")
    seen = set()
    for budget in (2, 3, 5):
        got = reports.witnesses(cells, depots, depots, walks, flights, 4, 100, budget).collect()
        assert len(got) == 6
        for r in got:
            covers = [s for k in range(budget + 1) for s in itertools.combinations(range(7), k) if set().union(*(reach[r.region_id, x] for x in s)) == set(range(n[r.region_id]))]
            assert (r.witness is not None) == bool(covers), (r.region_id, budget)
            if covers:
                assert tuple(sorted(r.witness)) in covers and len(r.witness) == len(covers[0])
            seen.add((n[r.region_id] > 63, bool(covers)))
    assert seen >= {(True, True), (True, False)}


def test_outcomes_within_each_requests_own_limit(spark, tmp_path):
    from sitegrid.streaming import requests as streams

    sec = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    # limits of 1 and 30 s, results just within and just beyond the limit and five seconds
    rows = [(1, 0.0, "q", 1000), (1, 6.0, "r", 0), (2, 0.0, "q", 1000), (2, 6.001, "r", 0), (3, 0.0, "q", 30_000), (3, 34.0, "r", 0), (4, 0.0, "q", 30_000), (4, 35.001, "r", 0), (5, 0.0, "q", 20_000), (6, 3.0, "q", 9000), (6, 2.0, "r", 0)]
    late = [(7, 4000.0, "q", 30_000), (7, 4001.0, "r", 0)]
    tail = [(-1, 1e6, "q", 1), (-1, 1e6, "r", 0)]
    schema = "key long, s double, kind string, timeout_ms int"
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    make = lambda rows: spark.createDataFrame(rows, schema).select("key", sec(F.col("s")).alias("ts"), "kind", "timeout_ms")
    make(rows).write.parquet(source)
    arriving = spark.readStream.schema(make(rows).schema).parquet(source)
    asked = arriving.where("kind = 'q'").select("key", "ts", F.col("key").alias("request_id"), "timeout_ms")
    given = arriving.where("kind = 'r'").select("key", "ts", F.col("key").alias("result_id"), F.lit("feasible").alias("status"))
    left = []
    for more in (late, tail, []):
        run = streams.request_outcomes(asked, given).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start()
        run.awaitTermination()
        left.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
        if more:
            make(more).write.mode("append").parquet(source)
    got = {r.request_id: r.outcome for r in streams.first_outcomes(spark.read.parquet(sink).where("key > 0")).collect()}
    assert got == {1: "feasible", 2: "timeout", 3: "feasible", 4: "timeout", 5: "timeout", 6: "timeout", 7: "feasible"}
    assert left[2] <= 2  # what the watermark passed is gone
    make([(8, 2e6, "q", 30_001)]).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="exceeds"):
        streams.request_outcomes(asked, given).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def test_events_arrive_in_slices_of_time(spark, sf_dir, tmp_path):
    """A slice is several files, equally many for each, and a batch of the stream of its own."""
    from sitegrid.queries_io import SLICES, _arriving, _slices, _written, messages

    e, source, seen = messages(spark, sf_dir), str(tmp_path / "in"), []
    parts = _slices(e, e.limit(1))
    files = _written(parts, source)
    assert len(parts) == SLICES + 1 and files > 1
    # the one row of the last part may come with an empty file
    assert len(spark.read.parquet(source).inputFiles()) - SLICES * files in (1, 2)

    def batch(rows, number):
        seen.append(rows.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first())

    _arriving(spark, source, e.schema, files).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert [r[2] for r in seen] == [p.count() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1 : SLICES], strict=False))
    assert sum(r[2] for r in seen) == e.count() + 1


def test_choose_of_every_size(spark, sf_dir):
    import math

    from sitegrid.queries_whatif import a10_every

    sizes = {r.p_size for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").distinct().collect()}
    assert max(sizes) > 33
    assert {r.n: r["size"] for r in a10_every(spark, sf_dir).collect()} == {n: math.comb(n, 7) for n in sizes}


def loads_of(cells, near, lockers, capacity):
    """Every load vector that whole cells can give ``lockers``, all of them used."""
    found = {(0,) * len(lockers)}
    for cell, parcels in cells:
        found = {
            tuple(x + parcels * (i == k) for i, x in enumerate(v)) for v in found for k, s in enumerate(lockers) if s in near.get(cell, ()) and v[k] + parcels <= capacity
        }
    return {v for v in found if all(v)}


def supplied(loads, reach, depots, capacity, all_used):
    found = {(0,) * len(depots)}
    for load, near in zip(loads, reach, strict=True):
        found = {tuple(x + load * (i == k) for i, x in enumerate(v)) for v in found for k, d in enumerate(depots) if d in near and v[k] + load <= capacity}
    return any(all(v) or not all_used for v in found)


def block_status(world, r, exact=None):
    """Status of a request on one region by trying selections and whole-unit assignments."""
    cells, lockers, depots, near, flights = world
    subsets = lambda ids, most: [s for k in range(most, 0, -1) for s in itertools.combinations(ids, k)]
    for ls in [exact[0]] if exact else subsets(lockers, r.max_lockers):
        for loads in loads_of(cells, near, ls, r.locker_capacity):
            for ds in [exact[1]] if exact else subsets(depots, r.max_depots):
                reach = [{d for d in ds if flights[s, d] <= r.flight_limit_mm} for s in ls]
                if supplied(loads, reach, ds, r.depot_capacity, True) and (r.outage_tolerance != 1 or all(supplied(loads, reach, [d for d in ds if d != gone], r.depot_capacity, False) for gone in ds)):
                    return "feasible"
    return "unsat"


def block_worlds(b):
    cells, lockers, depots, walks, flights = (t.collect() for t in b.world())
    out = {}
    for region in {r.region_id for r in lockers}:
        mine = lambda rows: [r for r in rows if r.region_id == region]  # noqa: B023, E731
        near: dict = {}
        for w in mine(walks):
            near.setdefault(w.cell_id, set()).add(w.locker_id)
        ids = lambda rows: [r.site_id for r in sorted(mine(rows), key=lambda r: r.ord)]
        out[region] = ([(c.cell_id, c.parcels) for c in mine(cells)], ids(lockers), ids(depots), near, {(f.locker_id, f.depot_id): f.return_mm for f in mine(flights)})
    return out


def test_sweep_and_outcomes_of_the_blocks_match_brute_force(spark):
    from sitegrid.bindings import Blocks
    from sitegrid.queries_whatif import e10, e11

    d = "/root/testdata/sf0.01"
    b = Blocks(spark, d)
    worlds = block_worlds(b)
    ask = {(r.region_id, r.request_id): r for r in b.requests().collect()}
    results, _ = b.sweep()
    got = {(r.region_id, r.request_id): r.status for r in results.collect()}
    assert e10(spark, d).columns == results.columns

    def want(r):
        n_lockers, n_depots = len(worlds[r.region_id][1]), len(worlds[r.region_id][2])
        return "error" if r.max_lockers > n_lockers or r.max_depots > n_depots else block_status(worlds[r.region_id], r)

    assert got == {k: want(r) for k, r in ask.items()}
    assert {"feasible", "unsat"} <= set(got.values())
    # the registered limits, which no selection of the test table meets, and looser ones
    loose = b.limits().withColumns({"outage_tolerance": F.lit(0), "locker_capacity": F.lit(900), "depot_capacity": F.lit(1500)})
    plausible = whatif.plausible_selections(*b.world(), 3, 2, b.FLIGHT_MM)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    seen = set()
    for limits, rows in ((b.limits(), e11(spark, d)), (loose, whatif.selection_outcomes(*b.world(), loose, plausible).select("region_id", text("lockers"), text("depots"), "status"))):
        rows, limits = rows.collect(), {r.region_id: r for r in limits.collect()}
        assert len({(r.region_id, r.lockers, r.depots) for r in rows}) == len(rows) == plausible.count() > 20
        for r in rows:
            exact = [tuple(int(x) for x in s.split(",")) for s in (r.lockers, r.depots)]
            assert r.status == block_status(worlds[r.region_id], limits[r.region_id], exact), r
            seen.add(r.status)
    assert seen == {"feasible", "unsat"}


def test_selections_of_seventy_sites(spark):
    """More sites than a word has bits: masks, screen and plausible selections against sets."""
    rng = random.Random(4)
    n, reach = 70, {c: {s for s in range(70) if rng.random() < 0.12 or s % 35 == c} for c in range(5)}
    reach[0] |= {65, 69}
    make = spark.createDataFrame
    sites = make([(0, s, s, s) for s in range(n)], "region_id long, site_id long, ord int, node_id long")
    depots = make([(0, s, s, s) for s in range(66)], "region_id long, site_id long, ord int, node_id long")
    cells = make([(0, c, 3) for c in reach], "region_id long, cell_id long, parcels long")
    walks = make([(0, s, c, 1) for c, ss in reach.items() for s in ss], "region_id long, locker_id long, cell_id long, distance_mm long")
    far = {(s, d): 10 + 100 * ((s + d) % 3 == 0) for s in range(n) for d in range(66)}
    flights = make([(0, s, d, v) for (s, d), v in far.items()], "region_id long, locker_id long, depot_id long, return_mm long")
    pairs = whatif.combinations(sites, 2).collect()
    assert [tuple(r.members) for r in pairs] == list(itertools.combinations(range(n), 2)) and len({tuple(r.mask) for r in pairs}) == len(pairs)
    assert all(sum(x << 63 * w for w, x in enumerate(r["mask"])) == sum(1 << m for m in r.members) for r in pairs)
    covers = [p for p in itertools.combinations(range(n), 2) if all(set(p) & ss for ss in reach.values())]
    got = {(tuple(r.lockers), tuple(r.depots)) for r in whatif.plausible_selections(cells, sites, depots, walks, flights, 2, 1, 50).collect()}
    assert covers and got == {(p, (d,)) for p in covers for d in range(66) if all(far[s, d] <= 50 for s in p)}
    request = make([(0, 0, 2, 1, 100, 100, 50, None, None, None, 1000)], REQUEST)
    stages = {tuple(r.members): r.stage for r in whatif.screen_lockers(request, cells, sites, walks).collect()}
    useful = set().union(*reach.values())
    for p in itertools.combinations(range(n), 2):
        want = "coverage" if p not in covers else "idle_locker" if set(p) - useful else "passes"
        assert stages[p] == want, p
    held = make([(0, i, 2, 1, 100, 100, 50, None, list(p), [d], 1000) for i, (p, d) in enumerate((p, d) for p in covers[:6] for d in (0, 64, 65))], REQUEST)
    status = {r.request_id: r.status for r in whatif.feasibility_sweep(cells, sites, depots, walks, flights, held)[0].collect()}
    for r in held.collect():
        ok = all(far[s, r.fixed_depots[0]] <= 50 for s in r.fixed_lockers) and any(len({s for s in ss}) for ss in [set(r.fixed_lockers)])
        used = all(any(s in ss for ss in reach.values()) for s in r.fixed_lockers)
        assert status[r.request_id] == ("feasible" if ok and used else "unsat")


def test_labels_of_any_length(spark):
    from sitegrid.functions.scalars import letters

    def label(n):
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(65 + k) + out
        return out

    ns = [1, 26, 27, 702, 703, 704, 18_278, 18_279, 475_254, 475_255, 2**53, 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", letters(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in got} == {n: label(n) for n in ns}


def test_nearest_nodes_are_served_in_order(spark):
    """Many targets that want the same nodes, against one at a time."""
    rng = random.Random(9)
    nodes = [(g, n, rng.randint(0, 900), rng.randint(0, 900)) for g in range(3) for n in range((25, 6, 0)[g])]
    targets = [(g, f"t{k}", k, rng.randint(200, 260), rng.randint(200, 260)) for g in range(3) for k in range(12)] + [(0, "far", 20, 90_000, -70_000)]
    want = {}
    for g, t, _, x, y in sorted(targets, key=lambda t: (t[0], t[2])):
        left = [(int(((x - nx) ** 2 + (y - ny) ** 2) ** 0.5 + 0.5), n) for r, n, nx, ny in nodes if r == g and n != 3 and (g, n) not in {(a, b[0]) for (a, _), b in want.items()}]
        if left:
            d, n = min(left)
            want[g, t] = (n, d)
    df = spark.createDataFrame(nodes, "region_id int, node_id int, x_mm long, y_mm long")
    got = spatial.nearest_nodes(spark.createDataFrame(targets, "region_id int, target_id string, ord int, x_mm long, y_mm long"), df, df.where("node_id = 3"), width=40).collect()
    assert {(r.region_id, r.target_id): (r.node_id, r.offset_mm) for r in got} == want


def test_complexity_report_takes_each_regions_limits(spark, scene):
    cells, lockers, depots, walks, flights = scene
    both = lambda t: t.unionByName(t.withColumn("region_id", F.lit(1).cast("long")))
    limits = spark.createDataFrame([(0, 2, 2, 600_000), (1, 2, 3, 800_000)], "region_id long, max_lockers int, max_depots int, flight_limit_mm int")
    got = {r.region_id: r for r in reports.complexity_report(both(cells), both(lockers), both(depots), both(walks), both(flights), limits).collect()}
    # one depot of two keeps no locker supplied after an outage; both do, where the range allows it
    assert (got[0].reduced_sets, got[0].reduced_best, got[1].reduced_sets, got[1].reduced_best) == (2, 0, 1, 2)
    assert (got[0].supply_total, got[1].supply_total) == (2, 4)


def test_routes_of_found_plans_are_measured(spark):
    """Plans are valid along their routes; a route with a missing, turned or foreign edge shows, and so does a wrong length."""
    from sitegrid.bindings import Blocks

    b = Blocks(spark, "/root/testdata/sf0.01")
    codes = lambda a: {(r.region_id, r.plan_id): set(r.errors) for r in a.verification(a.errors()).collect()}
    whole = codes(b.found_plans())
    assert whole and not any(whole.values())
    used = b.sweep()[1]["plan_cells"]
    at = used.orderBy("region_id", "plan_id", "cell_id").first()
    mine = (F.col("cell_id") == at.cell_id) & (F.col("locker_id") == at.locker_id) & (F.col("region_id") == at.region_id)
    touched = {(r.region_id, r.plan_id) for r in used.where(mine).collect()}
    routes = b.routes()
    other = routes.where(~mine).where(F.size("edge_ids") > 0).first().edge_ids
    turned = F.transform("edge_ids", lambda e: F.concat_ws(">", F.element_at(F.split(e, ">"), 2), F.element_at(F.split(e, ">"), 1)))
    key = ["region_id", "cell_id", "locker_id"]
    for change in (F.array().cast("array<string>"), F.array(*[F.lit(x) for x in other]), F.lit(None).cast("array<string>")):
        bent = b.measured_walks(routes.withColumn("edge_ids", F.when(mine, change).otherwise(F.col("edge_ids"))))
        assert {tuple(r) for r in bent.where("not route_ok").select(key).collect()} == {(at.region_id, at.cell_id, at.locker_id)}
    found = codes(b.found_plans(b.measured_walks(routes.withColumn("edge_ids", F.when(mine, turned).otherwise(F.col("edge_ids"))))))
    assert {k for k, v in found.items() if "broken_route" in v} == {k for k, v in found.items() if v} == touched
    longer = codes(b.found_plans(b.measured_walks().withColumn("distance_mm", F.col("distance_mm") + F.when(mine, 1).otherwise(0))))
    assert {k for k, v in longer.items() if v} == {k for k, v in longer.items() if v == {"walk_limit"}} == touched


def test_a_hop_moves_the_frontier_only(spark, monkeypatch):
    """The distances found so far are read in their buckets, without an exchange; distances are those of relaxation."""
    rng = random.Random(6)
    edges = {(rng.randrange(30), rng.randrange(30)): rng.randint(1, 9) for _ in range(90)}
    table = spark.createDataFrame([(0, f"e{a}-{b}", a, b, n) for (a, b), n in edges.items() if a != b], "region_id long, edge_id string, src long, dst long, length_mm long")
    origins = spark.createDataFrame([(0, o, o, 20) for o in range(0, 30, 4)], "region_id long, origin long, node_id long, budget_mm long")
    plans, real = [], graph._next_hop
    monkeypatch.setattr(graph, "_next_hop", lambda *a: (plans.append((df := real(*a))._jdf.queryExecution().executedPlan().toString()), df)[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.origin, r.node_id): r.dist_mm for r in graph.bounded_paths(table, origins).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {}
    for o in range(0, 30, 4):
        dist = {o: 0}
        for _ in range(30):
            for (a, b), n in edges.items():
                if a != b and a in dist and dist[a] + n <= 20:
                    dist[b] = min(dist.get(b, 99), dist[a] + n)
        want |= {(o, n): d for n, d in dist.items()}
    assert got == want
    assert len(plans) > 2
    for plan in plans:
        assert "Bucketed: true" in plan and "Exchange hashpartitioning(_region_id" not in plan and plan.count("Exchange ") == 3


def test_route_geometry_is_cell_node_and_edges(spark):
    make, point = spark.createDataFrame, "struct<lon: double, lat: double>"
    walks = make([(0, 1, 7, ["e1", "e2"]), (0, 1, 8, []), (0, 2, 7, ["e2"])], "region_id long, cell_id long, locker_id long, edge_ids array<string>")
    cells = make([(0, 1, 10, 1.0, 2.0), (0, 2, 11, 3.0, 4.0)], "region_id long, cell_id long, node_id long, lon double, lat double")
    nodes = make([(0, 10, 1.5, 2.5), (0, 11, 3.5, 4.5)], "region_id long, node_id long, lon double, lat double")
    edges = make([(0, "e1", [(5.0, 5.0), (6.0, 6.0), (7.0, 7.0)]), (0, "e2", [(7.0, 7.0), (8.0, 8.0)])], f"region_id long, edge_id string, coordinates array<{point}>")
    got = {(r.cell_id, r.locker_id): [tuple(p) for p in r.line] for r in graph.route_geometry(walks, cells, nodes, edges).collect()}
    first, second = [(5.0, 5.0), (6.0, 6.0), (7.0, 7.0)], [(7.0, 7.0), (8.0, 8.0)]
    assert got == {(1, 7): [(1.0, 2.0), (1.5, 2.5), *first, *second], (1, 8): [(1.0, 2.0), (1.5, 2.5)], (2, 7): [(3.0, 4.0), (3.5, 4.5), *second]}


def test_shortlists_differ_by_position(spark):
    schema = "region_id long, ord int, node_id long"
    steps = spark.createDataFrame([(0, 0, 5), (0, 1, 6), (0, 2, 7), (1, 0, 5)], schema)
    stored = spark.createDataFrame([(0, 0, 5), (0, 1, 9), (0, 3, 8), (1, 0, 5)], schema)
    got = {tuple(r) for r in shortlist.diff_shortlist(steps, stored).select("region_id", "ord", "replayed", "stored").collect()}
    assert got == {(0, 1, 6, 9), (0, 2, 7, None), (0, 3, None, 8)}
    assert shortlist.diff_shortlist(steps, steps).count() == 0
