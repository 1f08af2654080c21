"""Pruned enumeration, ranges of ordinals, counters and rules taken away, against brute force."""

import itertools
import random
from math import comb

import pytest
from pyspark.sql import functions as F

from sitegrid.plans import search, whatif
from sitegrid.plans.verify import rule_groups

from .test_domain import REQUEST, block_worlds

SITE = "region_id long, site_id long, ord int, node_id long, x_mm long, y_mm long"


def region(spark, cells: dict[int, dict[int, set[int]]], n: int):
    """Tables of regions with sites 0 .. n-1 and the sites that each cell reaches."""
    make = spark.createDataFrame
    sites = make([(r, 100 + s, s, s, 0, 0) for r in cells for s in range(n)], SITE)
    rows = make([(r, c, 1) for r, x in cells.items() for c in x], "region_id long, cell_id long, parcels long")
    walks = make([(r, c, 100 + s, 1) for r, x in cells.items() for c, ss in x.items() for s in ss], "region_id long, cell_id long, locker_id long, distance_mm long")
    return rows, sites, walks


def test_covering_sets_are_pruned_and_whole(spark):
    rng = random.Random(3)
    n, worlds = 12, {}
    for r in range(4):
        worlds[r] = {c: set(rng.sample(range(n - (r == 1)), rng.randint(1, 4))) for c in range(9 + 40 * r)}
    worlds[3][999] = set()  # a cell that nobody reaches
    reach = search.Reach(*(lambda c, s, w: (c, s, w))(*region(spark, worlds, n)))
    ks = (1, 3, 5, 7)
    for lo, hi in ((0, 10**6), (100, 300)):
        log: list[int] = []
        asks = spark.createDataFrame([(r, k, lo, hi) for r in worlds for k in ks], "region_id long, k int, lo long, hi long")
        for idle in (False, True):
            got = {(x.region_id, x.k, x.ordinal, tuple(x.places)) for x in search.covering_sets(reach, asks, idle, log).collect()}
            want, every = set(), 0
            for r, k in itertools.product(worlds, ks):
                useful = set().union(*worlds[r].values())
                for i, p in enumerate(itertools.combinations(range(n), k)):
                    every += 1
                    if lo <= i < hi and all(set(p) & ss for ss in worlds[r].values()) and (idle or set(p) <= useful):
                        want.add((r, k, i, p))
            assert got == want
        assert got and sum(log) < every / 4


def test_a_region_of_many_cells(spark):
    """Five thousand cells of as many classes: masks of eighty words, and far fewer rows than subsets."""
    rng = random.Random(8)
    n, k = 26, 6
    cells = {c: {s for s in range(n) if rng.random() < 0.5} | {c % n} for c in range(5000)}
    for c in range(3):
        cells[c] = {c, c + 3}
    reach = search.Reach(*region(spark, {0: cells}, n))
    assert reach.regions.first().words > 70
    log: list[int] = []
    got = search.covering_sets(reach, spark.createDataFrame([(0, k, 0, comb(n, k))], "region_id long, k int, lo long, hi long"), log=log)
    masks = [sum(1 << c for c, ss in cells.items() if s in ss) for s in range(n)]
    full = (1 << 5000) - 1
    some = rng.sample(list(itertools.combinations(range(n), k)), 4000)
    found = {tuple(r.places) for r in got.collect()}
    for p in some:
        both = 0
        for s in p:
            both |= masks[s]
        assert (p in found) == (both == full)
    assert sum(log) < comb(n, k) / 10


def test_ranges_close_requests_early(spark):
    """The same results and counters for ranges of any width; fewer rows where winners come first."""
    rng = random.Random(5)
    n, cells = 9, {c: set(rng.sample(range(9), 5)) for c in range(6)}
    tables, sites, walks = region(spark, {0: cells}, n)
    flights = sites.select("region_id", F.col("site_id").alias("locker_id"), F.lit(100).cast("long").alias("depot_id"), F.lit(1).cast("long").alias("return_mm"))
    depots = sites.where("ord = 0")
    rows = [(0, i, most, 1, cap, 100, 5, None, fixed, None, 1000) for i, (most, cap, fixed) in enumerate([(6, 6, None), (4, 2, None), (3, 6, None), (2, 1, None), (5, 2, [101, 104, 108]), (2, 9, None), (1, 9, [100, 101])])]
    ask = spark.createDataFrame(rows, REQUEST)
    world = (tables, sites, depots, walks, flights)
    whole = whatif.search_requests(*world, ask, first_range=10**6)
    parts = whatif.search_requests(*world, ask, first_range=2)
    assert len(whole.rounds) == 1 < len(parts.rounds)
    assert sum(r["rows"] for r in parts.rounds) < sum(r["rows"] for r in whole.rounds)
    listed = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert listed(whole.results) == listed(parts.results)
    for name in whole.plans:
        assert listed(whole.plans[name]) == listed(parts.plans[name])
    counted = listed(whatif.search_counters(whole))
    assert counted == listed(whatif.search_counters(parts))
    assert {r[2] for r in counted} == {"feasible", "unsat"}


def tried(world, r):
    """(status, locker sets, site selections) of a request, one selection after another."""
    cells, lockers, depots, near, flights = world
    sized = lambda ids, most, fixed: ([tuple(fixed)] if len(fixed) <= most else []) if fixed is not None else [s for k in range(most, -1, -1) for s in itertools.combinations(ids, k)]
    if r.max_lockers > len(lockers) or r.max_depots > len(depots):
        return "error", 0, 0
    total, sets, pairs = sum(w for _, w in cells), 0, 0
    for ls in sized(lockers, r.max_lockers, r.fixed_lockers):
        sets += 1
        if not ls or total > len(ls) * r.locker_capacity or not all(near.get(c, set()) & set(ls) for c, _ in cells) or not all(any(s in ss for ss in near.values()) for s in ls):
            continue
        for ds in sized(depots, r.max_depots, r.fixed_depots):
            pairs += 1
            if whole(world, r, ls, ds, None):
                return "feasible", sets, pairs
    return "unsat", sets, pairs


def whole(world, r, ls, ds, off):
    """Whether two selections have assignments that hold every rule but one."""
    cells, _, _, near, flights = world
    tolerant = r.outage_tolerance == 1 and off != "depot_outage_supply"
    most = lambda rule, cap: float("inf") if off == rule else cap
    loads = {(0,) * len(ls)}
    if off != "collection":
        for c, w in cells:
            loads = {tuple(x + w * (i == k) for i, x in enumerate(v)) for v in loads for k, s in enumerate(ls) if s in near.get(c, ()) and v[k] + w <= most("locker_capacity", r.locker_capacity)}
        loads = {v for v in loads if all(v)}

    def served(v, alive, cap, used):
        for to in itertools.product(alive, repeat=len(ls)):
            sums = {d: sum(x for x, t in zip(v, to, strict=True) if t == d) for d in alive}
            if all(flights[s, t] <= r.flight_limit_mm for s, t in zip(ls, to, strict=True)) and max(sums.values(), default=0) <= cap and (not used or set(to) == set(alive)):
                return True
        return False

    for v in loads:
        if off != "supply" and not served(v, ds, most("depot_capacity", r.depot_capacity), True):
            continue
        if not tolerant or all(served(v, [d for d in ds if d != gone], most("depot_outage_capacity", r.depot_capacity), False) for gone in ds):
            return True
    return False


def feasible_without(world, r, off):
    _, lockers, depots, _, _ = world
    subsets = lambda ids: [s for k in range(len(ids) + 1) for s in itertools.combinations(ids, k)]
    for ls in subsets(lockers):
        if (len(ls) > r.max_lockers and off != "locker_budget") or (r.fixed_lockers is not None and off != "fixed_lockers" and set(ls) != set(r.fixed_lockers)):
            continue
        for ds in subsets(depots):
            if (len(ds) > r.max_depots and off != "depot_budget") or (r.fixed_depots is not None and off != "fixed_depots" and set(ds) != set(r.fixed_depots)):
                continue
            if (not ls and off != "collection") or (not ds and off not in ("supply", "collection")):
                continue
            if whole(world, r, ls, ds, off):
                return True
    return False


@pytest.fixture(scope="module")
def small(spark):
    """Regions of three lockers, three depots and three cells; one with more parcels than a request may allow."""
    rng = random.Random(12)
    cells, lockers, depots, walks, flights = [], [], [], [], []
    for r in range(5):
        for i in range(3):
            lockers.append((r, 10 + i, i, 0, 0, 0))
            depots.append((r, 20 + i, i, 0, 0, 0))
            cells.append((r, i, 12_000 if r == 4 and i == 0 else rng.randint(1, 4), 0, 0, 0))
            walks += [(r, i, 10 + s, 1) for s in range(3) if rng.random() < 0.7 or s == i]
            flights += [(r, 10 + i, 20 + d, rng.choice([5, 10, 15])) for d in range(3)]
    make = spark.createDataFrame
    return (
        make(cells, "region_id long, cell_id long, parcels long, node_id long, x_mm long, y_mm long"), make(lockers, SITE), make(depots, SITE),
        make(walks, "region_id long, cell_id long, locker_id long, distance_mm long"), make(flights, "region_id long, locker_id long, depot_id long, return_mm long"),
    )


class World:
    def __init__(self, tables):
        self.tables = tables

    def world(self):
        return self.tables


def test_every_rule_taken_away(spark, small):
    rng = random.Random(2)
    rows = []
    for r in range(5):
        for i in range(24):
            fixed = lambda base: rng.choice([None, None, sorted(rng.sample([base, base + 1, base + 2], rng.randint(0, 3)))])  # noqa: B023, E731
            cap = 10_000 if r == 4 else rng.choice([2, 4, 6, 9])
            rows.append((r, i, rng.randint(0, 3), rng.randint(0, 3), cap, 10_000 if r == 4 else rng.choice([3, 6, 12]), rng.choice([4, 10, 15]), rng.choice([None, 0, 1]), fixed(10), fixed(20), 1000))
    # a budget that is too small for the fixed sites, and a rule that only the large region needs
    rows += [(0, 90, 1, 3, 9, 12, 15, 0, [10, 11, 12], None, 1000), (0, 92, 3, 3, 9, 12, 15, 0, None, [], 1000), (4, 91, 3, 3, 10_000, 10_000, 15, 0, None, None, 1000)]
    ask = spark.createDataFrame(rows, REQUEST)
    worlds = block_worlds(World(small))
    results = {(r.region_id, r.request_id): r.status for r in whatif.feasibility_sweep(*small, ask)[0].collect()}
    got = {tuple(r) for r in whatif.blocking_rules(*small, ask).collect()}
    named = {(r.region_id, r.plan_id, r.rule_id) for r in rule_groups(ask.withColumnRenamed("request_id", "plan_id")).collect()}
    want, seen = set(), set()
    for r in ask.collect():
        world = worlds[r.region_id]
        assert results[r.region_id, r.request_id] == ("feasible" if feasible_without(world, r, None) else "unsat"), r
        for rule in whatif.RULES:
            if (r.region_id, r.request_id, rule) in named and feasible_without(world, r, rule):
                want.add((r.region_id, r.request_id, rule))
                if results[r.region_id, r.request_id] == "unsat":
                    seen.add(rule)
    assert got == want
    assert seen == set(whatif.RULES)


def test_counters_of_every_request(spark):
    from sitegrid.bindings import Blocks
    from sitegrid.queries_whatif import e13_counters

    d = "/root/testdata/sf0.01"
    b = Blocks(spark, d)
    worlds = block_worlds(b)
    want = {(r.region_id, r.request_id): tried(worlds[r.region_id], r) for r in b.requests().collect()}
    got = {(r.region_id, r.request_id): tuple(r)[2:] for r in e13_counters(spark, d).collect()}
    assert got == want
    assert {s for s, _, _ in want.values()} >= {"feasible", "unsat"}


def test_snapshots_differ_by_buckets(spark, monkeypatch):
    """The rows of two exceptAll, and no row moves where the sides are equal."""
    from datetime import datetime

    from sitegrid.sources import tables

    monkeypatch.setattr(tables, "DIFF_BUCKETS", 8)
    schema = "a int, b string, t timestamp, c array<int>"
    at = datetime(2024, 1, 1, 0, 0, 0, 1)
    left = [(i % 7, f"x{i % 5}", at, [i % 2]) for i in range(60)] + [(None, "n", None, None), (1, None, at, [None])]
    right = left[3:] + [(1, "x1", at.replace(microsecond=2), [1])] * 2 + [(None, None, at, [])]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    rows = lambda df: sorted(map(repr, df.collect()))
    want = a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    assert rows(tables.diff_snapshots(a, b)) == rows(want) and want.count() > 3
    assert rows(tables.diff_snapshots(a, b.withColumn("a", F.col("a").cast("long")).toDF("p", "q", "r", "s")))
    assert tables.diff_snapshots(a, a.repartition(5)).count() == 0
    kept = []
    real = tables.staged
    monkeypatch.setattr(tables, "staged", lambda df, label: (kept.append(real(df, label)), kept[-1])[1])
    tables.diff_snapshots(a, a)
    tables.diff_snapshots(a, b)
    assert kept[0].count() == 0 < kept[1].count() <= 8
