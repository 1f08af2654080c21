"""Plan verification in one batch: any number of plans, every rule, all violations.

Tables are keyed by (region_id, plan_id). ``requests`` has one row for each plan: budgets,
capacities, flight_limit_mm, outage_tolerance and the fixed selections (null: free choice; an
empty array: exactly none). ``walks`` are the eligible pairs with the advertised distance_mm,
the recomputed measured_mm and route_ok.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import return_mm
from ..functions.staging import staged

PLAN = ["region_id", "plan_id"]
WALK_LIMIT_MM = 500_000
#: Largest capacities, range and time limit of a request.
MOST_CAPACITY, MOST_RANGE, MOST_TIMEOUT = 10_000, 10_000_000, 30_000


def open_sites(plan_sites: DataFrame, kind: str) -> DataFrame:
    """Distinct chosen sites of a kind."""
    return plan_sites.where(F.col("kind") == kind).select(*PLAN, "site_id").distinct()


# -- assignments and loads ----------------------------------------------------------------


def first_valid(rows: DataFrame, valid: str, item: str) -> DataFrame:
    """Adds ``good``: of the valid rows of an item, the first by ``pos``; all others are errors."""
    order = Window.partitionBy(*PLAN, item, valid).orderBy("pos")
    return rows.withColumn("good", F.col(valid) & (F.row_number().over(order) == 1))


def judged_assignments(plan_sites: DataFrame, plan_cells: DataFrame, cells: DataFrame, walks: DataFrame) -> DataFrame:
    """Plan rows with parcels, distances and ``good``."""
    known = cells.select("region_id", "cell_id", "parcels")
    opened = open_sites(plan_sites, "locker").withColumnRenamed("site_id", "locker_id").withColumn("_open", F.lit(True))
    pairs = walks.select("region_id", "cell_id", "locker_id", "distance_mm", "measured_mm", "route_ok")
    rows = plan_cells.join(known, ["region_id", "cell_id"], "left").join(opened, [*PLAN, "locker_id"], "left").join(pairs, ["region_id", "cell_id", "locker_id"], "left")
    rows = rows.withColumn("valid", F.col("parcels").isNotNull() & F.col("_open").isNotNull() & F.col("distance_mm").isNotNull())
    return first_valid(rows, "valid", "cell_id").drop("_open")


def locker_loads(plan_sites: DataFrame, judged: DataFrame) -> DataFrame:
    """(plan, locker_id, load): every open locker, unused ones with 0."""
    sums = judged.where("good").groupBy(*PLAN, "locker_id").agg(F.sum("parcels").alias("load"))
    opened = open_sites(plan_sites, "locker").withColumnRenamed("site_id", "locker_id")
    return opened.join(sums, [*PLAN, "locker_id"], "left").withColumn("load", F.coalesce("load", F.lit(0).cast("long")))


def outage_scopes(plan_sites: DataFrame, plan_outages: DataFrame, requests: DataFrame) -> DataFrame:
    """(plan, outage_depot): the outages that are evaluated, those of chosen depots under tolerance 1."""
    tolerant = requests.where("outage_tolerance = 1").select(*PLAN)
    named = plan_outages.select(*PLAN, F.col("depot_id").alias("site_id")).distinct()
    return named.join(open_sites(plan_sites, "depot"), [*PLAN, "site_id"], "left_semi").join(tolerant, PLAN, "left_semi").withColumnRenamed("site_id", "outage_depot")


def judged_supplies(plan_sites: DataFrame, plan_supply: DataFrame, scopes: DataFrame, lockers: DataFrame, depots: DataFrame) -> DataFrame:
    """Supply rows of normal operation (outage_depot null) and of the evaluated outages, with
    return_mm and ``good``."""
    normal = plan_supply.where("outage_depot is null")
    failed = plan_supply.join(scopes, [*PLAN, "outage_depot"], "left_semi")
    rows = normal.unionByName(failed)
    site = lambda t, s: t.select("region_id", F.col("site_id").alias(f"{s}_id"), F.col("x_mm").alias(f"_{s}x"), F.col("y_mm").alias(f"_{s}y"))
    opened = lambda s: open_sites(plan_sites, s).select(*PLAN, F.col("site_id").alias(f"{s}_id"), F.lit(True).alias(f"_{s}"))
    rows = rows.join(site(lockers, "locker"), ["region_id", "locker_id"], "left").join(site(depots, "depot"), ["region_id", "depot_id"], "left")
    rows = rows.join(opened("locker"), [*PLAN, "locker_id"], "left").join(opened("depot"), [*PLAN, "depot_id"], "left")
    valid = F.col("_lockerx").isNotNull() & F.col("_depotx").isNotNull() & F.col("_locker").isNotNull() & F.col("_depot").isNotNull() & ~F.col("depot_id").eqNullSafe(F.col("outage_depot"))
    rows = rows.withColumn("valid", valid).withColumn("return_mm", return_mm(F.col("_lockerx"), F.col("_lockery"), F.col("_depotx"), F.col("_depoty")))
    order = Window.partitionBy(*PLAN, "outage_depot", "locker_id", "valid").orderBy("pos")
    rows = rows.withColumn("good", F.col("valid") & (F.row_number().over(order) == 1))
    return rows.select(*PLAN, "outage_depot", "pos", "locker_id", "depot_id", "return_mm", "good")


def _scope_loads(plan_sites: DataFrame, supplies: DataFrame, loads: DataFrame, scopes: DataFrame) -> DataFrame:
    """(plan, outage_depot, depot_id, load, lockers) for every chosen depot in every scope."""
    carried = supplies.where("good").join(loads.hint("merge"), [*PLAN, "locker_id"]).groupBy(*PLAN, "outage_depot", "depot_id").agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("lockers"))
    own = open_sites(plan_sites, "depot").withColumnRenamed("site_id", "depot_id")
    # a plan without any depot still has its normal scope, but no depot row
    every = own.withColumn("outage_depot", F.lit(None).cast("long")).unionByName(own.join(scopes, PLAN))
    carried = carried.withColumnsRenamed({"region_id": "_r", "plan_id": "_p", "outage_depot": "_o", "depot_id": "_d"})
    same = (F.col("region_id") == F.col("_r")) & (F.col("plan_id") == F.col("_p")) & F.col("outage_depot").eqNullSafe(F.col("_o")) & (F.col("depot_id") == F.col("_d"))
    out = every.join(carried.hint("merge"), same, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*PLAN, "outage_depot", "depot_id", zero("load"), zero("lockers"))


def depot_loads(plan_sites: DataFrame, supplies: DataFrame, loads: DataFrame) -> DataFrame:
    """(plan, depot_id, load) in normal operation; unused depots with 0."""
    none = supplies.select(*PLAN, "outage_depot").limit(0)
    return _scope_loads(plan_sites, supplies.where("outage_depot is null"), loads, none).select(*PLAN, "depot_id", "load")


def outage_loads(plan_sites: DataFrame, supplies: DataFrame, loads: DataFrame, scopes: DataFrame) -> DataFrame:
    """(plan, outage_depot, depot_id, load) of the surviving depots, unused ones with 0."""
    out = _scope_loads(plan_sites, supplies, loads, scopes).where("outage_depot is not null and depot_id <> outage_depot")
    return out.select(*PLAN, "outage_depot", "depot_id", "load")


def conservation(requests: DataFrame, cells: DataFrame, judged: DataFrame, scope_loads: DataFrame) -> DataFrame:
    """(plan, demanded, assigned, supplied, outages_balanced)."""
    demanded = cells.groupBy("region_id").agg(F.sum("parcels").alias("demanded"))
    assigned = judged.where("good").groupBy(*PLAN).agg(F.sum("parcels").alias("assigned"))
    per = scope_loads.groupBy(*PLAN, "outage_depot").agg(F.sum("load").alias("s"))
    both = per.join(assigned, PLAN, "left").groupBy(*PLAN).agg(
        F.max(F.when(F.col("outage_depot").isNull(), F.col("s"))).alias("supplied"),
        F.bool_and(F.when(F.col("outage_depot").isNotNull(), F.col("s") == F.coalesce("assigned", F.lit(0)))).alias("outages_balanced"),
    )
    out = requests.select(*PLAN).join(demanded, "region_id", "left").join(assigned, PLAN, "left").join(both, PLAN, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*PLAN, zero("demanded"), zero("assigned"), zero("supplied"), F.coalesce("outages_balanced", F.lit(True)).alias("outages_balanced"))


def plan_extremes(requests: DataFrame, judged: DataFrame, supplies: DataFrame) -> DataFrame:
    """(plan, worst_walk_mm, routes_checked, longest_flight_mm), outages included."""
    walks = judged.where("good").groupBy(*PLAN).agg(F.max("measured_mm").alias("worst_walk_mm"), F.count(F.lit(1)).alias("routes_checked"))
    flights = supplies.where("good").groupBy(*PLAN).agg(F.max("return_mm").alias("longest_flight_mm"))
    out = requests.select(*PLAN).join(walks.hint("merge"), PLAN, "left").join(flights.hint("merge"), PLAN, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*PLAN, zero("worst_walk_mm"), zero("routes_checked"), zero("longest_flight_mm"))


def utilisation(requests: DataFrame, loads: DataFrame, supplies: DataFrame, scope_loads: DataFrame) -> DataFrame:
    """(plan, kind, outage_depot, site_id, supplier, load, share of the capacity)."""
    limits = requests.select(*PLAN, "locker_capacity", "depot_capacity")
    by = supplies.where("good and outage_depot is null").select(*PLAN, "locker_id", F.col("depot_id").alias("supplier"))
    share = lambda cap: F.when(F.col(cap) > 0, F.col("load") / F.col(cap)).alias("share")
    none = F.lit(None).cast("long")
    lockers = loads.join(by, [*PLAN, "locker_id"], "left").join(limits, PLAN).select(*PLAN, F.lit("locker").alias("kind"), none.alias("outage_depot"), F.col("locker_id").alias("site_id"), "supplier", "load", share("locker_capacity"))
    depots = scope_loads.join(limits, PLAN).select(*PLAN, F.lit("depot").alias("kind"), "outage_depot", F.col("depot_id").alias("site_id"), none.alias("supplier"), "load", share("depot_capacity"))
    return lockers.unionByName(depots)


# -- selections and requests --------------------------------------------------------------


def selection_lists(plan_sites: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    """(plan, chosen): the chosen identifiers of a kind, repeats kept; empty if there are none."""
    got = plan_sites.where(F.col("kind") == kind).groupBy(*PLAN).agg(F.collect_list("site_id").alias("chosen"))
    return requests.join(got, PLAN, "left").withColumn("chosen", F.coalesce("chosen", F.array().cast("array<long>")))


def selection_matches(plan_sites: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    """(plan, matches): null where the request leaves the choice free."""
    fixed = F.col(f"fixed_{kind}s")
    same = (F.size("chosen") == F.size(fixed)) & (F.size(F.array_except(fixed, "chosen")) == 0)
    return selection_lists(plan_sites, requests, kind).select(*PLAN, F.when(fixed.isNotNull(), same).alias("matches"))


def unknown_sites(selection: DataFrame, sites: DataFrame) -> DataFrame:
    return selection.join(sites.select("region_id", "site_id"), ["region_id", "site_id"], "left_anti")


def validate_requests(requests: DataFrame, lockers: DataFrame, depots: DataFrame) -> DataFrame:
    """(plan, problem): each broken range or selection of a request."""
    out = None
    for kind, sites in (("locker", lockers), ("depot", depots)):
        n = sites.groupBy("region_id").agg(F.count(F.lit(1)).alias(f"_{kind}s"))
        requests = requests.join(n, "region_id", "left").withColumn(f"_{kind}s", F.coalesce(f"_{kind}s", F.lit(0)))
        listed = requests.where(F.col(f"fixed_{kind}s").isNotNull()).select(*PLAN, F.explode(f"fixed_{kind}s").alias("site_id"))
        strange = unknown_sites(listed, sites).select(*PLAN, F.lit(f"unknown_{kind}").alias("problem")).distinct()
        out = strange if out is None else out.unionByName(strange)
    outside = lambda c, low, high: F.col(c).isNull() | (F.col(c) < low) | (F.col(c) > high)
    twice = lambda c: F.col(c).isNotNull() & (F.size(F.array_distinct(c)) < F.size(c))
    tests = {
        "max_lockers": outside("max_lockers", 0, F.col("_lockers")),
        "max_depots": outside("max_depots", 0, F.col("_depots")),
        "locker_capacity": outside("locker_capacity", 0, MOST_CAPACITY),
        "depot_capacity": outside("depot_capacity", 0, MOST_CAPACITY),
        "flight_limit": outside("flight_limit_mm", 0, MOST_RANGE),
        "timeout": outside("timeout_ms", 1, MOST_TIMEOUT),
        "tolerance": F.col("outage_tolerance").isNotNull() & ~F.col("outage_tolerance").isin(0, 1),
        "repeated_locker": twice("fixed_lockers"),
        "repeated_depot": twice("fixed_depots"),
    }
    found = requests.select(*PLAN, F.explode(F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))).alias("problem"))
    return out.unionByName(found)


def rule_groups(requests: DataFrame) -> DataFrame:
    """(plan, ord, rule_id, label) of the rules that a request brings."""
    ids = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ", ")).otherwise("none")
    km = F.format_string("%.1f", F.col("flight_limit_mm") / 1e6)
    rule = lambda name, label, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("rule_id"), label.alias("label")))
    tolerant = F.coalesce("outage_tolerance", F.lit(0)) == 1
    rules = F.array(
        rule("collection", F.lit("Each cell is served by one open locker within 500 m on foot.")),
        rule("locker_budget", F.format_string("At most %d lockers are open.", "max_lockers")),
        rule("locker_capacity", F.format_string("No locker handles more than %d parcels a day.", "locker_capacity")),
        rule("supply", F.concat(F.lit("Each open locker has one open depot within a return flight of "), km, F.lit(" km."))),
        rule("depot_budget", F.format_string("At most %d depots are open.", "max_depots")),
        rule("depot_capacity", F.format_string("No depot supplies more than %d parcels a day.", "depot_capacity")),
        rule("depot_outage_supply", F.lit("After any one depot fails, each open locker has another open depot in range."), tolerant),
        rule("depot_outage_capacity", F.format_string("After any one depot fails, no other supplies more than %d parcels a day.", "depot_capacity"), tolerant),
        rule("fixed_lockers", F.concat(F.lit("Exactly these lockers are open: "), ids("fixed_lockers"), F.lit(".")), F.col("fixed_lockers").isNotNull()),
        rule("fixed_depots", F.concat(F.lit("Exactly these depots are open: "), ids("fixed_depots"), F.lit(".")), F.col("fixed_depots").isNotNull()),
    )
    return requests.select(*PLAN, F.posexplode(F.array_compact(rules)).alias("ord", "r")).select(*PLAN, "ord", "r.rule_id", "r.label")


# -- the whole audit ----------------------------------------------------------------------


def _listed(errors: list[tuple]) -> Column:
    """One struct (code, scope, n) for every (code, scope, n) whose n is above 0."""
    one = lambda code, scope, n: F.when(n > 0, F.struct(F.lit(code).alias("code"), scope.alias("scope"), n.cast("long").alias("n")))
    return F.explode(F.array_compact(F.array(*[one(*e) for e in errors])))


class Audit:
    """All pieces of a batch of plans, and the violations they give.

    What several answers need is staged when it is first asked for.
    """

    def __init__(self, cells, lockers, depots, walks, requests, plan_sites, plan_cells, plan_supply, plan_outages, walk_limit_mm: int = WALK_LIMIT_MM):
        self.cells, self.lockers, self.depots, self.requests, self.sites, self.outages = cells, lockers, depots, requests, plan_sites, plan_outages
        self.limit, self._walks, self._plan_cells, self._plan_supply = walk_limit_mm, walks, plan_cells, plan_supply

    @cached_property
    def judged(self) -> DataFrame:
        return staged(judged_assignments(self.sites, self._plan_cells, self.cells, self._walks), "audit-judged")

    @cached_property
    def loads(self) -> DataFrame:
        return staged(locker_loads(self.sites, self.judged), "audit-loads")

    @cached_property
    def scopes(self) -> DataFrame:
        return staged(outage_scopes(self.sites, self.outages, self.requests), "audit-scopes")

    @cached_property
    def supplies(self) -> DataFrame:
        return staged(judged_supplies(self.sites, self._plan_supply, self.scopes, self.lockers, self.depots), "audit-supplies")

    @cached_property
    def scope_loads(self) -> DataFrame:
        return staged(_scope_loads(self.sites, self.supplies, self.loads, self.scopes), "audit-scope-loads")

    def errors(self) -> DataFrame:
        """(plan, code, scope, n): each broken rule of a plan, and how many rows break it. Scope is
        ``locker``, ``depot``, ``normal`` or ``outage:<depot>``; empty where there is only one.

        Each child table is summed once, by plan or by plan and scope; the sums meet in one row,
        whose broken rules are listed.
        """
        limits = self.requests.select(*PLAN, "locker_capacity", "depot_capacity", "flight_limit_mm", F.coalesce("outage_tolerance", F.lit(0)).alias("tolerance"))
        judged, total = self._assignments(), self._demand()
        plans = self._by_plan(limits, judged, total)
        scopes = self._by_scope(limits, judged.select(*PLAN, F.col("got_n").alias("_n"), F.col("got")))
        invalid = validate_requests(self.requests, self.lockers, self.depots).groupBy(*PLAN).agg(F.count(F.lit(1)).alias("n"))
        out = invalid.select(*PLAN, F.lit("invalid_request").alias("code"), F.lit("").alias("scope"), "n")
        return out.unionByName(plans).unionByName(scopes)

    def _demand(self) -> DataFrame:
        return self.cells.groupBy("region_id").agg(F.sum("parcels").alias("parcels"), F.count(F.lit(1)).alias("cells"))

    def _assignments(self) -> DataFrame:
        good = F.col("good")
        return self.judged.groupBy(*PLAN).agg(
            F.count_if(~good).alias("bad"), F.count_if(good & ((F.col("measured_mm") > self.limit) | (F.col("measured_mm") != F.col("distance_mm")))).alias("far"), F.count_if(good & ~F.col("route_ok")).alias("broken"),
            F.sum(F.when(good, F.col("parcels"))).alias("got"), F.count_if(good).alias("got_n"),
        )

    def _by_plan(self, limits: DataFrame, judged: DataFrame, total: DataFrame) -> DataFrame:
        yes = lambda c: F.when(c, 1).otherwise(0)
        heavy = self.loads.join(limits.select(*PLAN, "locker_capacity"), PLAN).groupBy(*PLAN).agg(F.count_if((F.col("load") <= 0) | (F.col("load") > F.col("locker_capacity"))).alias("heavy"))
        rows = self.requests.select(*PLAN, "max_lockers", "max_depots", "fixed_lockers", "fixed_depots", F.coalesce("outage_tolerance", F.lit(0)).alias("tolerance"))
        errors = []
        for kind, sites in (("locker", self.lockers), ("depot", self.depots)):
            known = sites.select("region_id", "site_id").distinct().withColumn("_known", F.lit(True))
            mine = self.sites.where(F.col("kind") == kind).join(known, ["region_id", "site_id"], "left")
            mine = mine.groupBy(*PLAN).agg(F.collect_list("site_id").alias(f"_{kind}s"), F.bool_or(F.col("_known").isNull()).alias(f"_odd_{kind}"))
            rows = rows.join(mine, PLAN, "full").withColumn(f"_{kind}s", F.coalesce(f"_{kind}s", F.array().cast("array<long>")))
            chosen, fixed = F.col(f"_{kind}s"), F.col(f"fixed_{kind}s")
            same = (F.size(chosen) == F.size(fixed)) & (F.size(F.array_except(fixed, chosen)) == 0)
            twice = F.size(chosen) > F.size(F.array_distinct(chosen))
            errors += [("site_unknown_or_dup", F.lit(kind), yes(F.coalesce(f"_odd_{kind}", F.lit(False)) | twice)), ("too_many", F.lit(kind), yes(F.size(chosen) > F.col(f"max_{kind}s"))), ("exact_changed", F.lit(kind), yes(fixed.isNotNull() & ~same))]
        named = self.outages.groupBy(*PLAN).agg(F.collect_list("depot_id").alias("_named"))
        rows = rows.join(named, PLAN, "left").withColumn("_named", F.coalesce("_named", F.array().cast("array<long>"))).join(judged, PLAN, "full").join(heavy.hint("merge"), PLAN, "left").join(total, "region_id", "left")
        asked, own, tolerant = F.col("_named"), F.array_distinct("_depots"), F.col("tolerance") == 1
        odd = (F.size(asked) > F.size(F.array_distinct(asked))) | (F.size(F.array_except(asked, own)) > 0)
        lacking = (F.size(asked) != F.size("_depots")) | (F.size(F.array_except(own, asked)) > 0)
        one = F.lit("")
        short = F.col("tolerance").isNotNull() & F.col("cells").isNotNull() & ((F.coalesce("got_n", F.lit(0)) != F.col("cells")) | (F.coalesce("got", F.lit(0)) != F.col("parcels")))
        errors += [
            ("bad_assignment", one, F.col("bad")), ("walk_limit", one, F.col("far")), ("broken_route", one, F.col("broken")), ("demand_not_covered", one, yes(short)), ("locker_capacity_or_use", one, F.col("heavy")),
            ("unexpected_outage", one, F.when(F.col("tolerance") == 0, F.size(asked))), ("outage_unknown_or_dup", one, yes(tolerant & odd)), ("outage_missing", one, yes(tolerant & lacking)),
        ]
        return rows.select(*PLAN, _listed(errors).alias("e")).select(*PLAN, "e.*")

    def _by_scope(self, limits: DataFrame, got: DataFrame) -> DataFrame:
        keyed = lambda t: t.withColumn("_o", F.coalesce("outage_depot", F.lit(-1).cast("long"))).drop("outage_depot")
        key, zero = [*PLAN, "_o"], lambda c: F.coalesce(c, F.lit(0))
        good, yes = F.col("good"), lambda c: F.when(c, 1).otherwise(0)
        flown = self.supplies.join(limits.select(*PLAN, "flight_limit_mm"), PLAN, "left")
        done = keyed(flown).groupBy(*key).agg(
            F.count_if(~good).alias("bad"), F.count_if(good & (F.col("return_mm") > F.col("flight_limit_mm"))).alias("far"), F.count_if(good).alias("supplied"), F.countDistinct(F.when(good, F.col("depot_id"))).alias("used")
        )
        over = (F.col("load") > F.col("depot_capacity")) | (F.col("outage_depot").isNull() & (F.col("load") <= 0))
        sums = keyed(self.scope_loads.join(limits.select(*PLAN, "depot_capacity"), PLAN, "left").withColumn("over", over)).groupBy(*key).agg(F.sum("load").alias("carried"), F.count_if("over").alias("over"))
        every = keyed(self.requests.select(*PLAN).withColumn("outage_depot", F.lit(None).cast("long")).unionByName(self.scopes.select(*PLAN, "outage_depot"))).withColumn("_asked", F.lit(True))
        n_sites = self.sites.groupBy(*PLAN).agg(F.count_if(F.col("kind") == "locker").alias("n_lockers"), F.count_if(F.col("kind") == "depot").alias("n_depots"))
        per = every.join(done, key, "full").join(sums, key, "full").join(n_sites.hint("merge"), PLAN, "left").join(got.drop("_n").hint("merge"), PLAN, "left")
        scope, normal, asked = F.when(F.col("_o") == -1, F.lit("normal")).otherwise(F.concat(F.lit("outage:"), F.col("_o").cast("string"))), F.col("_o") == -1, F.col("_asked").isNotNull()
        errors = [
            ("bad_supply", scope, F.col("bad")), ("flight_limit", scope, F.col("far")), ("supply_incomplete", scope, yes(asked & (zero("supplied") != zero("n_lockers")))),
            ("unused_depot", F.lit(""), yes(asked & normal & (zero("used") != zero("n_depots")))), ("depot_capacity_or_use", scope, F.col("over")), ("supply_not_conserved", scope, yes(asked & (zero("carried") != zero("got")))),
        ]
        return per.select(*PLAN, _listed(errors).alias("e")).select(*PLAN, "e.*")

    def verification(self, errors: DataFrame) -> DataFrame:
        """One row for each plan: valid, error codes, totals and extremes."""
        codes = errors.groupBy(*PLAN).agg(F.sort_array(F.collect_set("code")).alias("errors"))
        got = self.judged.where("good").groupBy(*PLAN).agg(F.sum("parcels").alias("parcel_total"))
        out = plan_extremes(self.requests, self.judged, self.supplies).join(got.hint("merge"), PLAN, "left").join(codes.hint("merge"), PLAN, "left")
        out = out.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
        return out.select(*PLAN, (F.size("errors") == 0).alias("valid"), "errors", F.coalesce("parcel_total", F.lit(0).cast("long")).alias("parcel_total"), "worst_walk_mm", "longest_flight_mm", "routes_checked")


# -- region data --------------------------------------------------------------------------


def check_walks(expected: DataFrame, supplied: DataFrame, cells: DataFrame, lockers: DataFrame) -> DataFrame:
    """(region_id, cell_id, locker_id, problem): the walk table against the recomputed pairs."""
    key = ["region_id", "cell_id", "locker_id"]
    twice = supplied.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("distance_mm").alias("_low"), F.max("distance_mm").alias("_high"))
    known_cell = cells.select("region_id", "cell_id").withColumn("_cell", F.lit(True))
    known_site = lockers.select("region_id", F.col("site_id").alias("locker_id")).withColumn("_site", F.lit(True))
    both = expected.select(*key, F.col("distance_mm").alias("_want")).join(twice, key, "full")
    both = both.join(known_cell, ["region_id", "cell_id"], "left").join(known_site, ["region_id", "locker_id"], "left")
    unknown = F.col("_cell").isNull() | F.col("_site").isNull()
    problem = F.array_compact(
        F.array(
            F.when(F.col("_n").isNull(), F.lit("missing")),
            F.when(F.col("_n").isNotNull() & unknown, F.lit("unknown")),
            F.when(F.col("_want").isNull() & ~unknown, F.lit("ineligible")),
            F.when((F.col("_low") != F.col("_want")) | (F.col("_high") != F.col("_want")), F.lit("distance")),
            F.when(F.col("_n") > 1, F.lit("duplicate")),
        )
    )
    return both.select(*key, F.explode(problem).alias("problem"))


def check_flights(matrix: DataFrame, supplied: DataFrame) -> DataFrame:
    """(region_id, locker_id, depot_id, problem): the flight table against the full matrix."""
    key = ["region_id", "locker_id", "depot_id"]
    got = supplied.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("return_mm").alias("_low"), F.max("return_mm").alias("_high"))
    both = matrix.select(*key, F.col("return_mm").alias("_want")).join(got, key, "full")
    problem = F.array_compact(
        F.array(
            F.when(F.col("_n").isNull(), F.lit("missing")),
            F.when(F.col("_want").isNull(), F.lit("unknown")),
            F.when((F.col("_low") != F.col("_want")) | (F.col("_high") != F.col("_want")), F.lit("distance")),
            F.when(F.col("_n") > 1, F.lit("duplicate")),
        )
    )
    return both.select(*key, F.explode(problem).alias("problem"))


def check_starter(cells: DataFrame, walks: DataFrame, starter: DataFrame, capacity: int) -> DataFrame:
    """(region_id, problem, n): a starter assignment must serve every cell once, along eligible
    pairs, and load each of its lockers within (0, capacity]."""
    here = ["region_id"]
    n = starter.groupBy("region_id", "cell_id").count()
    unserved = cells.join(n, ["region_id", "cell_id"], "left_anti").groupBy(*here).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("unserved"))
    twice = n.where("count > 1").groupBy(*here).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("repeated"))
    lost = starter.join(walks.select("region_id", "cell_id", "locker_id"), ["region_id", "cell_id", "locker_id"], "left_anti").groupBy(*here).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("unreachable"))
    loads = starter.join(cells.select("region_id", "cell_id", "parcels"), ["region_id", "cell_id"]).groupBy("region_id", "locker_id").agg(F.sum("parcels").alias("load"))
    heavy = loads.where((F.col("load") <= 0) | (F.col("load") > capacity)).groupBy(*here).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("load"))
    out = unserved.unionByName(twice).unionByName(lost).unionByName(heavy)
    return out.select("region_id", "problem", "n")


def validate_regions(nodes, edges, cells, lockers, depots, expected_walks, walks, matrix, flights, limit_mm: int, schema_version: int = 1, per: int = 10, starter: DataFrame | None = None, capacity: int = 0) -> DataFrame:
    """(region_id, check, entity, detail): every violation of a region's data."""
    from ..operators.graph import check_graph
    from ..operators.normalize import check_ids

    text = lambda c: F.col(c).cast("string")
    row = lambda df, check, entity, detail: df.select("region_id", F.lit(check).alias("check"), entity.alias("entity"), detail.alias("detail"))
    out = [row(check_graph(nodes, edges), "graph", F.col("entity"), F.col("check"))]
    for name, table, column in (("node", nodes, "node_id"), ("cell", cells, "cell_id"), ("locker", lockers, "site_id"), ("depot", depots, "site_id")):
        out.append(row(check_ids(table, column), "id", F.concat(F.lit(f"{name}:"), F.col("id")), F.col("problem")))
    far = (F.abs(F.col("lon")) > 180) | (F.abs(F.col("lat")) > 90) | F.isnan("lon") | F.isnan("lat") | F.col("lon").isNull() | F.col("lat").isNull()
    out.append(row(nodes.where(far), "coordinates", text("node_id"), F.lit("")))
    at = nodes.select("region_id", "node_id", F.col("x_mm").alias("_x"), F.col("y_mm").alias("_y"))
    for sites in (lockers, depots):
        moved = sites.join(at, ["region_id", "node_id"], "left").where(~(F.col("x_mm").eqNullSafe(F.col("_x")) & F.col("y_mm").eqNullSafe(F.col("_y"))))
        out.append(row(moved, "site_node", text("site_id"), F.lit("")))
    out.append(row(cells.where(~F.col("parcels").eqNullSafe(F.ceil(F.col("population") / per))), "demand", text("cell_id"), F.lit("")))
    out.append(row(cells.where(F.col("connector_mm").isNull() | (F.col("connector_mm") < 0) | (F.col("connector_mm") > limit_mm)), "connector", text("cell_id"), F.lit("")))
    out.append(row(check_walks(expected_walks, walks, cells, lockers), "walks", F.concat_ws(">", text("cell_id"), text("locker_id")), F.col("problem")))
    out.append(row(check_flights(matrix, flights), "flights", F.concat_ws(">", text("locker_id"), text("depot_id")), F.col("problem")))
    if schema_version != 1:
        out.append(row(cells.select("region_id").distinct(), "schema_version", F.lit(""), F.lit(str(schema_version))))
    if starter is not None:
        out.append(row(check_starter(cells, walks, starter, capacity), "starter", F.lit(""), F.col("problem")))
    found = out[0]
    for t in out[1:]:
        found = found.unionByName(t)
    return found
