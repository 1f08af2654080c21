"""Plans and whole jobs on tables that are larger, or laid out otherwise, than the given ones."""

import gzip
import hashlib
import random
import re

from pyspark.sql import functions as F

from sitegrid import bindings, registry
from sitegrid.functions import staging
from sitegrid.operators import graph, shortlist, spatial
from sitegrid.plans import reports, verify, whatif
from sitegrid.plans.verify import Audit
from sitegrid.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spacing_without_broadcast(spark):
    """Small as the table is, its copies around a bucket do not go through the driver."""
    at = spark.range(400).select(F.lit(0).alias("region_id"), F.col("id").alias("site_id"), (F.col("id") * 37 % 101 - 50).alias("x_mm"), (F.col("id") * 53 % 97 - 50).alias("y_mm"))
    found = spatial.spacing_conflicts(at, 7)
    assert "Broadcast" not in plan(found)
    rows = at.collect()
    near = {(a.site_id, b.site_id) for a in rows for b in rows if a.site_id < b.site_id and (a.x_mm - b.x_mm) ** 2 + (a.y_mm - b.y_mm) ** 2 < 49}
    got = [(r.a_id, r.b_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == near


def test_sources_that_are_folders(spark, tmp_path):
    """A table may be a file or a folder of files; its name is that of the table."""
    spark.range(4).repartition(2).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "customer.parquet"))
    (tmp_path / "part.parquet").write_bytes(b"one file")
    found = registry.QUERIES["s4_verify_sources"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("customer.parquet", True, False), ("ghost.parquet", False, True), ("orders.parquet", False, False)]
    by = {r.name: r.sha256 for r in tables.source_digests(spark, f"file://{tmp_path}/*.parquet").collect()}
    assert set(by) == {"customer.parquet", "orders.parquet", "part.parquet"} and by["part.parquet"] == hashlib.sha256(b"one file").hexdigest()
    next((tmp_path / "orders.parquet").glob("part-*")).rename(tmp_path / "orders.parquet" / "part-moved.parquet")
    assert {r.name for r in tables.verify_sources(spark, f"{tmp_path}/*.parquet", spark.createDataFrame(list(by.items()), "name string, sha256 string")).collect()} == {"orders.parquet"}


def test_large_sources_are_hashed_by_lines(spark, tmp_path, monkeypatch):
    """A file longer than the bound is never one row; its digest is that of its bytes, whatever they are."""
    bytes_ = random.Random(5).randbytes
    odd = {
        "ended": b"one\n\ntwo\r\n" * 30, "open": b"one\n" * 80 + b"two", "marked": b"\xef\xbb\xbf" + b"a\n" * 900, "marked open": b"\xef\xbb\xbf" + b"a\n" * 900 + b"b", "random+1%2B.parquet": bytes_(70_000),
        "line": bytes_(9_000).replace(b"\n", b"x") + b"\n\n", "short": b"a\n", "folder.parquet/part": bytes_(20_000), "zeros": bytes(12_288), "packed.gz": gzip.compress(bytes_(500)), "ends": b"\n" * 300,
    }
    for name, content in odd.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(tables, "WHOLE", 200)
    monkeypatch.setattr(tables, "PIECE", 1024)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        found = tables.source_digests(spark, f"{tmp_path}/*")
        got = {r.name: r.sha256 for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {n: hashlib.sha256(b).hexdigest() for n, b in odd.items()}
    folder = "part:" + want.pop("folder.parquet/part")
    assert got == want | {"folder.parquet": hashlib.sha256(folder.encode()).hexdigest()}
    lengths = tables._large_digests(spark, f"{tmp_path}/*")
    assert "binaryFile" not in plan(lengths) and lengths.count() == 9


def test_paths_take_edges_within_the_budget(spark, monkeypatch):
    """Edges longer than every budget are neither dealt out in a round nor asked for predecessors."""
    rows = {}

    def counted(df, label):
        rows.setdefault(label, []).append(df.count())
        return staging.staged(df, label)

    monkeypatch.setattr(graph, "staged", counted)
    edges = spark.range(200).selectExpr("0L as region_id", "'e' || id as edge_id", "id % 20 as src", "(id * 7 + 1) % 20 as dst", "if(id % 10 = 0, 3L, 500 + id) as length_mm")
    starts = spark.range(5).selectExpr("0L as region_id", "id * 4 as origin", "id * 4 as node_id", "9L as budget_mm")
    paths = graph.bounded_paths(edges, starts)
    assert rows["path-links"] == [20]
    ends = {r.edge_id: (r.src, r.dst, r.length_mm) for r in edges.collect()}
    got = {(r.origin, r.node_id): r for r in paths.collect()}
    assert len(got) > 5
    for (origin, node), r in got.items():
        if r.dist_mm:
            src, dst, length = ends[r.pred_edge]
            assert (src, dst) == (r.pred_src, node) and got[origin, src].dist_mm + length == r.dist_mm
    assert graph.route_edges(paths, edges, paths.selectExpr("region_id", "origin", "node_id as target")).where("not ok").count() == 0
    assert graph.bounded_paths(edges, starts.limit(0)).count() == 0


def test_search_tries_first_pairs_first_and_equal_pairs_once(spark, monkeypatch):
    """Equal pairs of requests are tried once; a request whose first pair holds tries no other."""
    tried, make = [], spark.createDataFrame
    real = whatif.supplier_assignments

    def counted(states, *rest):
        tried.append(states.count())
        return real(states, *rest)

    monkeypatch.setattr(whatif, "supplier_assignments", counted)
    cells = make([(0, c, 2) for c in (0, 1)], "region_id long, cell_id long, parcels long")
    sites = make([(0, s, s) for s in (0, 1, 2)], "region_id long, site_id long, ord int")
    walks = make([(0, c, s, 1) for c in (0, 1) for s in (0, 1, 2)], "region_id long, cell_id long, locker_id long, distance_mm long")
    flights = make([(0, s, d, 1) for s in (0, 1, 2) for d in (0, 1, 2)], "region_id long, locker_id long, depot_id long, return_mm long")
    request = "region_id long, request_id long, max_lockers int, max_depots int, locker_capacity int, depot_capacity int, flight_limit_mm int, outage_tolerance int, fixed_lockers array<long>, fixed_depots array<long>, timeout_ms int"
    asked = make([(0, r, 1, 1, 4, 4 + r % 2, 10, 0, None, None, 1000) for r in range(6)], request)
    results = whatif.search_requests(cells, sites, sites, walks, flights, asked).results
    assert {(r.status, r.l_ordinal) for r in results.collect()} == {("feasible", 0)}
    assert len(tried) == 1 and tried[0] <= 2
    joined = staging.dealt(spark.range(3), "small").join(staging.dealt(spark.range(3), "small"), "id")
    assert "Broadcast" not in plan(joined)


def test_shortlist_rounds_broadcast_no_nodes(spark, monkeypatch):
    """The nodes of a region, however small their file, do not go through the driver in each round."""
    plans = {}

    def seen(df, label):
        plans.setdefault(label, []).append(plan(df))
        return staging.dealt(df, label)

    monkeypatch.setattr(shortlist, "staged", seen)
    nodes = spark.range(12).selectExpr("0L as region_id", "id as node_id", "id * 10 as x_mm", "0L as y_mm")
    reach = spark.range(24).selectExpr("0L as region_id", "id % 12 as node_id", "id % 5 as cell_id", "id as distance_mm").dropDuplicates(["node_id", "cell_id"])
    steps, status = shortlist.greedy_shortlist(reach, nodes, spark.range(5).selectExpr("0L as region_id", "id as cell_id"), 1, 15)
    assert steps.count() >= 3 and status.first().complete
    assert len(plans["greedy-score"]) >= 2 and not any("Broadcast" in p for p in (*plans["greedy-score"], *plans["greedy-alive"][:1]))


def test_plan_tables_are_derived_once(spark, sf_dir, monkeypatch):
    """The tables of the plans are made from each other as they lie; none goes back to the orders and walks again."""
    made, real = [], {name: getattr(bindings.Plans, name) for name in ("plan_cells", "plan_sites")}
    monkeypatch.setattr(bindings, "_kept", {k: v for k, v in bindings._kept.items() if k[2] in ("near-edges", "reach", "walks")})
    for name, make in real.items():
        monkeypatch.setattr(bindings.Plans, name, lambda self, name=name, make=make: (made.append(name), make(self))[1])
    bindings.Plans(spark, sf_dir).audit()
    assert sorted(made) == ["plan_cells", "plan_sites"]


def test_snapshot_is_written_by_many_tasks(spark, tmp_path):
    """However few bytes they are, many regions are dealt out to tasks, a small one as a whole; so is a region with all the rows."""
    many = spark.range(400, numPartitions=1).selectExpr("id % 40 as region_id", "id", "array(id) as l")
    tables.write_snapshot({"many": many, "one": many.withColumn("region_id", F.lit(0))}, str(tmp_path))
    files = {t: [f.relative_to(tmp_path) for f in (tmp_path / t).rglob("part-*.parquet")] for t in ("many", "one")}
    tasks = {t: {f.name.split("-")[1] for f in fs} for t, fs in files.items()}
    assert len(tasks["many"]) > 4 and len(tasks["one"]) > 4
    assert {f.parts[1] for f in files["many"]} == {f"region_id={k}" for k in range(40)} and len(files["many"]) < 40 + 8
    for t in files:
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / t)).collect()) == list(range(400))


def test_fingerprint_moves_sums_only(spark):
    """No hash of a row travels, and the address knows how often a row is there."""
    rows = spark.range(300).selectExpr("id % 90 as a", "if(id % 7 = 0, null, 'x' || id % 90) as b", "array(id % 3) as c")
    address = lambda df: tuple(tables.fingerprint(df).first())
    assert "hashpartitioning(h#" not in plan(tables.fingerprint(rows)) and "hashpartitioning(b#" in plan(tables.fingerprint(rows))
    own = address(rows)
    assert own[1] == 300 and own == address(rows.select("c", "b", "a").repartition(5, "a"))
    assert len({own[0], *[address(df)[0] for df in (rows.unionByName(rows), rows.unionByName(rows.limit(1)), rows.distinct(), rows.fillna("x", "b"), rows.withColumnsRenamed({"a": "d"}), rows.limit(0))]}) == 7
    assert address(rows.limit(0))[1] == 0


def test_screen_enumerates_selections_once_and_by_many_tasks(spark):
    """What is screened is read where the selections were staged; few bytes of requests are many tasks' work."""
    make = spark.createDataFrame
    cells = make([(0, c, 2) for c in (0, 1)], "region_id long, cell_id long, parcels long")
    sites = make([(0, s, s) for s in range(5)], "region_id long, site_id long, ord int")
    walks = make([(0, c, s, 1) for c in (0, 1) for s in range(4)], "region_id long, cell_id long, locker_id long, distance_mm long")
    asked = make([(0, r, 3, 2 + r, None) for r in range(9)], "region_id long, request_id long, max_lockers int, locker_capacity int, fixed_lockers array<long>")
    tasks = whatif.selections(asked, sites, "locker").groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 4
    screened = whatif.screen_lockers(asked, cells, sites, walks)
    assert "Generate" not in plan(screened)
    got = {(r.request_id, r.stage): r["count"] for r in screened.groupBy("request_id", "stage").count().collect()}
    assert got[0, "locker_capacity"] == 6 and got[0, "passes"] == 10 and got[0, "idle_locker"] == 10 and sum(got.values()) == 9 * 26


def _small_world(spark):
    """cells, lockers, depots, walks, flights and requests of two small regions."""
    make = spark.createDataFrame
    cells = make([(r, c, 2) for r in (0, 1) for c in (0, 1)], "region_id long, cell_id long, parcels long")
    sites = make([(r, s, s) for r in (0, 1) for s in (0, 1, 2)], "region_id long, site_id long, ord int")
    walks = make([(r, c, s, 1) for r in (0, 1) for c in (0, 1) for s in (0, 1, 2)], "region_id long, cell_id long, locker_id long, distance_mm long")
    flights = make([(r, s, d, 1) for r in (0, 1) for s in (0, 1, 2) for d in (0, 1, 2)], "region_id long, locker_id long, depot_id long, return_mm long")
    request = "region_id long, request_id long, max_lockers int, max_depots int, locker_capacity int, depot_capacity int, flight_limit_mm int, outage_tolerance int, fixed_lockers array<long>, fixed_depots array<long>, timeout_ms int"
    asked = make([(r, i, 1 + i % 2, 1 + i % 2, 2 + i, 4 + i, 10, i % 2, None, None, 1000) for r in (0, 1) for i in range(6)], request)
    # as files: what a table of the session has is too large by its estimate
    return [staging.staged(t, "small-world") for t in (cells, sites, sites, walks, flights, asked)]


def _plans_of(monkeypatch, module):
    """The plans of what ``module`` stages, by label."""
    plans = {}

    def seen(df, label):
        plans.setdefault(label, []).append(plan(df))
        return staging.dealt(df, label)

    monkeypatch.setattr(module, "staged", seen)
    return plans


def test_blocking_rules_broadcast_no_rows_of_a_region(spark, monkeypatch):
    """Selections of depots are many rows of few bytes: neither they nor the requests' rows go through the driver."""
    plans, world = _plans_of(monkeypatch, whatif), _small_world(spark)
    got = {tuple(r) for r in whatif.blocking_rules(*world[:5], world[5].where("request_id = 0")).collect()}
    assert got == {(r, 0, rule) for r in (0, 1) for rule in ("locker_budget", "locker_capacity", "collection")}
    # a row for each region, joined by the region alone, may
    for label in ("relaxed", "sweep-kept", "cell-ranked", "supply-ranked", "sweep-results"):
        assert plans[label] and not any(re.search(r"BroadcastHashJoin \[\w+#\d+L?, ", p) for p in plans[label]), label


def _joined_by_rows(df):
    """Joins by more than the region whose one side goes through the driver."""
    return re.findall(r"BroadcastHashJoin \[\w+#\d+L?, .*", plan(df))


def test_pairs_of_selections_without_broadcast(spark):
    """A row for each request and selection of depots is made by exploding few bytes, and is dealt out."""
    cells, lockers, depots, _, flights, asked = _small_world(spark)
    terms = staging.dealt(whatif._spaces(whatif.terms(asked, lockers, depots), cells), "terms")
    left = staging.dealt(asked.selectExpr("region_id", "request_id", "0L as l_ordinal", "array(0L) as lockers", "4L as total"), "left")
    found = whatif.screen_pairs(left, terms, depots, flights)
    assert not _joined_by_rows(found)
    assert found.groupBy("request_id").count().orderBy("request_id").collect()[:2] == [(0, 8), (1, 14)]


def _found(spark):
    """The audit of a plan for each of two regions, as that of found plans is made."""
    cells, lockers, depots, walks, _, asked = (t.hint("merge") for t in _small_world(spark))
    lockers, depots = (t.withColumns({"x_mm": F.lit(0).cast("long"), "y_mm": F.lit(0).cast("long")}) for t in (lockers, depots))
    walks = walks.withColumns({"measured_mm": F.col("distance_mm"), "route_ok": F.lit(True)})
    make = lambda rows, kind: staging.dealt(spark.createDataFrame([(r, 0, *x) for r in (0, 1) for x in rows], f"region_id long, plan_id long, {kind}"), "found")
    plans = {
        "plan_sites": make([("locker", 0, 0), ("depot", 0, 1)], "kind string, pos long, site_id long"), "plan_cells": make([(0, 0, 0), (1, 1, 0)], "pos long, cell_id long, locker_id long"),
        "plan_supply": make([(0, None, 0, 1)], "pos long, outage_depot long, locker_id long, depot_id long"), "plan_outages": make([(0, 1)], "pos long, depot_id long").limit(0),
    }
    requests = asked.where("request_id = 0").withColumns({"request_id": F.lit(0).cast("long"), "locker_capacity": F.lit(4)}).withColumnRenamed("request_id", "plan_id")
    return Audit(cells, lockers, depots, walks, requests, walk_limit_mm=5, **plans), requests


def test_found_plans_are_verified_without_broadcast(spark, monkeypatch):
    """Sums by plan, of which there are as many as requests, are dealt out."""
    plans, (audit, _) = _plans_of(monkeypatch, verify), _found(spark)
    found = audit.verification(audit.errors())
    assert not _joined_by_rows(found)
    assert len(plans) == 5 and not [p for ps in plans.values() for p in ps if re.search(r"BroadcastHashJoin \[\w+#\d+L?, ", p)]
    assert [(r.valid, r.errors, r.parcel_total) for r in found.collect()] == [(True, [], 4)] * 2


def test_summaries_broadcast_no_requests(spark):
    """Results, requests and what was verified are rows of requests, dealt out."""
    audit, requests = _found(spark)
    results = staging.staged(spark.range(2).selectExpr("id as region_id", "0L as request_id", "'feasible' as status"), "results")
    seen = staging.staged(audit.verification(audit.errors()), "seen")
    found = reports.result_summary(results, seen, staging.staged(audit.sites, "sites"), staging.staged(requests.withColumnRenamed("plan_id", "request_id"), "asked"))
    assert not _joined_by_rows(found)
    assert [r.summary for r in found.collect()] == ["1 lockers · 1 depots · 4 parcels · 2 walks checked"] * 2
