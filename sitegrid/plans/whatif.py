"""What-if sweeps: enumerating selections, screening them, assigning whole units, feasibility.

Sites of a region are numbered by ``ord`` from 0; a selection is a list of identifiers and a mask
over the sites: an array of words of WORD bits each, as many as the region's sites need. Requests
are keyed by (region_id, request_id).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.scalars import choose
from ..functions.staging import dealt as staged
from . import search

REQ = ["region_id", "request_id"]
CHUNK = 10_000
#: Bits that are used of a word of a mask.
WORD = 63
LONG = "bigint"


def _bit(ord_: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), ord_.cast("int"))


def _and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def _words(sites: Column) -> Column:
    """Words of a mask over so many sites."""
    return F.greatest(F.ceil(sites / F.lit(WORD)).cast("int"), F.lit(1))


def _mask(places: Column, words: Column) -> Column:
    """The mask of a list of places."""
    none = F.array_repeat(F.lit(0).cast("long"), words)
    put = lambda acc, p: F.transform(acc, lambda x, w: F.when(w == F.floor(p / F.lit(WORD)), x.bitwiseOR(_bit(p % WORD))).otherwise(x))
    return F.aggregate(places, none, put)


def _both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def _either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def _some(a: Column) -> Column:
    """Whether a mask has any site."""
    return F.exists(a, lambda x: x != 0)


def _sites_in(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def _dealt(*tables: DataFrame) -> list[DataFrame]:
    """``tables``, joined by dealing out both sides: their sizes as files, or as estimated, know nothing of rows
    that repeat each other or are made by exploding."""
    return [t.hint("merge") for t in tables]


# -- enumeration --------------------------------------------------------------------------


def site_lists(sites: DataFrame) -> DataFrame:
    """(region_id, ids): identifiers in order."""
    return sites.groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("ord", "site_id"))).alias("l")).select("region_id", F.transform("l", lambda s: s["site_id"]).alias("ids"))


def _unrank(n: Column, k: Column, ordinal: Column) -> Column:
    """Places 0 .. n-1 of the ``ordinal``-th k-subset in lexicographic order."""
    start = F.struct(ordinal.cast("long").alias("r"), k.cast("long").alias("left"), F.array().cast("array<int>").alias("got"))

    def step(acc, i):
        here = choose(n.cast("long") - 1 - i, acc["left"] - 1)
        take = (acc["left"] > 0) & (acc["r"] < here)
        return F.struct(
            F.when(take | (acc["left"] == 0), acc["r"]).otherwise(acc["r"] - here).alias("r"),
            F.when(take, acc["left"] - 1).otherwise(acc["left"]).alias("left"),
            F.when(take, F.concat(acc["got"], F.array(i.cast("int")))).otherwise(acc["got"]).alias("got"),
        )

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1), start, step)["got"]).otherwise(F.array().cast("array<int>"))


def _expand(df: DataFrame, size: Column) -> DataFrame:
    """A row for each ordinal 0 .. size-1, exploded in two steps so that no array is long. In between rows are dealt out to as
    many tasks as the session shuffles into: their bytes are few and say nothing of the work that follows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / CHUNK))
    out = df.withColumn("_n", size).where("_n > 0").withColumn("_c", F.explode(chunks)).repartition(parts)
    last = F.least(F.col("_n"), (F.col("_c") + 1) * CHUNK) - 1
    return out.withColumn("ordinal", F.explode(F.sequence(F.col("_c") * CHUNK, last))).drop("_n", "_c")


def _named(df: DataFrame) -> DataFrame:
    """members and mask from ids and places."""
    return df.withColumns({"members": F.transform("places", lambda p: F.get("ids", p)), "mask": _mask(F.col("places"), _words(F.size("ids")))})


def combinations(sites: DataFrame, k: int | DataFrame, max_rows: int | None = None) -> DataFrame:
    """(region_id, ordinal, members, mask): all k-subsets of each region's sites, in lexicographic
    order. ``k`` is one number or (region_id, k). Raises if a region has more than ``max_rows``
    of them."""
    lists = site_lists(sites)
    lists = lists.join(k.select("region_id", "k"), "region_id") if isinstance(k, DataFrame) else lists.withColumn("k", F.lit(k))
    lists = lists.withColumn("_size", choose(F.size("ids").cast("long"), F.col("k").cast("long")))
    if max_rows is not None and not lists.where(F.col("_size") > max_rows).isEmpty():
        raise ValueError(f"a region has more than {max_rows} selections")
    rows = _expand(lists, F.col("_size"))
    return _named(rows.withColumn("places", _unrank(F.size("ids"), F.col("k"), F.col("ordinal")))).select("region_id", "ordinal", "members", "mask")


def selections(requests: DataFrame, sites: DataFrame, kind: str) -> DataFrame:
    """(region_id, request_id, ordinal, members, mask): every selection a request allows, larger
    ones first. A fixed selection within the budget is the only one; beyond it there is none."""
    fixed, most = F.col(f"fixed_{kind}s"), F.col(f"max_{kind}s")
    base = requests.select(*REQ, most.cast("int").alias("most"), fixed.alias("fixed")).join(site_lists(sites), "region_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    n = F.size("ids").cast("long")
    sizes = F.sequence(F.col("most"), F.lit(0))
    free = base.where("fixed is null").withColumn("k", F.explode(sizes))
    larger = F.aggregate(F.filter(sizes, lambda s: s > F.col("k")), F.lit(0).cast("long"), lambda acc, s: acc + choose(n, s.cast("long")))
    free = _expand(free.withColumn("_before", larger), choose(n, F.col("k").cast("long")))
    free = free.withColumn("places", _unrank(n, F.col("k"), F.col("ordinal"))).withColumn("ordinal", F.col("ordinal") + F.col("_before"))
    held = base.where(F.col("fixed").isNotNull() & (F.size("fixed") <= F.col("most")))
    held = held.withColumn("places", F.transform("fixed", lambda s: F.array_position("ids", s).cast("int") - 1)).withColumn("ordinal", F.lit(0).cast("long"))
    cols = [*REQ, "ordinal", "members", "mask"]
    return _named(free).select(*cols).unionByName(_named(held.where(~F.exists("places", lambda p: p < 0))).select(*cols)).hint("merge")


def request_grid(base: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes' values over every base request; ``point`` numbers them."""
    out = base
    for name, values in axes.items():
        kind = base.schema[name].dataType
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
    return numbered(out.drop("request_id"), "region_id", list(axes), "request_id").withColumn("request_id", F.col("request_id").cast("long"))


def selection_space(regions: DataFrame) -> DataFrame:
    """(region_id, size): C(lockers, max_lockers) * C(depots, max_depots), exact below 2**63."""
    c = lambda n, k: choose(F.col(n).cast("long"), F.col(k).cast("long"))
    return regions.select("region_id", (c("lockers", "max_lockers") * c("depots", "max_depots")).alias("size"))


# -- masks and screens --------------------------------------------------------------------


def depot_reach(requests: DataFrame, depots: DataFrame, flights: DataFrame) -> DataFrame:
    """(request, locker_id, m): the mask of the depots within the request's range, where there is one."""
    near = requests.select(*REQ, "flight_limit_mm").join(flights, "region_id").where(F.col("return_mm") <= F.col("flight_limit_mm"))
    near = near.join(depots.select("region_id", F.col("site_id").alias("depot_id"), F.col("ord").alias("_d")).hint("merge"), ["region_id", "depot_id"])
    n = depots.groupBy("region_id").agg(_words(F.count(F.lit(1))).alias("words"))
    found = near.groupBy(*REQ, "locker_id").agg(F.collect_set("_d").alias("o")).join(n, "region_id")
    return found.select(*REQ, "locker_id", _mask(F.col("o"), F.col("words")).alias("m"))


def screen_lockers(requests: DataFrame, cells: DataFrame, lockers: DataFrame, walks: DataFrame, reach: search.Reach | None = None) -> DataFrame:
    """Locker selections with ``stage``: the first necessary condition that fails, or ``passes``.

    Every selection is a row, made once; which of them cover all cells is found level by level and joined."""
    rows = selections(requests, lockers, "locker").join(requests.select(*REQ, "locker_capacity"), REQ)
    reach = reach or search.Reach(cells, lockers, walks)
    total = cells.groupBy("region_id").agg(F.sum("parcels").alias("total"))
    rows = rows.join(total, "region_id").withColumn("k", F.size("members")).join(site_lists(lockers), "region_id", "left")
    rows = rows.withColumn("places", F.sort_array(F.transform("members", lambda m: (F.array_position("ids", m) - 1).cast("int"))))
    rows = staged(rows.drop("ids"), "screen-lockers")
    sizes = rows.where("k > 0").select("region_id", "k").distinct().join(reach.regions.select("region_id", "n"), "region_id")
    asks = sizes.select("region_id", "k", F.lit(0).cast("long").alias("lo"), choose(F.col("n"), F.col("k").cast("long")).alias("hi"))
    covers = search.covering_sets(reach, asks, idle=True).select("region_id", "places", F.lit(True).alias("covers"))
    useful = walks.join(lockers.select("region_id", F.col("site_id").alias("locker_id")), ["region_id", "locker_id"], "left_semi").join(cells.select("region_id", "cell_id"), ["region_id", "cell_id"], "left_semi")
    useful = useful.groupBy("region_id").agg(F.collect_set("locker_id").alias("useful"))
    rows = rows.join(covers, ["region_id", "places"], "left").join(useful, "region_id", "left")
    stage = (
        F.when((F.col("k") == 0) | (F.col("total") > F.col("k") * F.col("locker_capacity")), "locker_capacity")
        .when(F.col("covers").isNull(), "coverage")
        .when(F.size(F.array_except("members", F.coalesce("useful", F.array().cast("array<bigint>")))) > 0, "idle_locker")
        .otherwise("passes")
    )
    return rows.withColumn("stage", stage).select(*REQ, "ordinal", "members", "mask", "stage", "total")


def screen(requests: DataFrame, cells: DataFrame, lockers: DataFrame, depots: DataFrame, walks: DataFrame, flights: DataFrame, reach: search.Reach | None = None) -> DataFrame:
    """Pairs of a surviving locker selection and a depot selection, with ``stage``."""
    asked = staged(_spaces(terms(requests, lockers, depots), cells), "screen-terms")
    left = _lockers_in(asked, reach or search.Reach(cells, lockers, walks), 0, 2**63 - 1, lockers, cells, walks, None)
    return screen_pairs(left, asked, depots, flights)


def _spaces(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """``asked`` with the numbers of selections and the demand."""
    total = cells.groupBy("region_id").agg(F.sum("parcels").alias("total"))
    l_space, d_space = search.spaces(F.col("n_lockers"), F.col("l_most"), F.col("l_fixed")), search.spaces(F.col("n_depots"), F.col("d_most"), F.col("d_fixed"))
    return asked.join(total, "region_id", "left").withColumns({"l_space": l_space, "d_space": d_space, "total": F.when(F.col("collect"), F.coalesce("total", F.lit(0))).otherwise(0)})


def screen_pairs(left: DataFrame, asked: DataFrame, depots: DataFrame, flights: DataFrame) -> DataFrame:
    """``left(request, l_ordinal, lockers, total)`` with every depot selection, and ``stage``. A row
    carries the depots in reach of its own lockers only."""
    seen = left.select(*REQ, "l_ordinal", F.posexplode("lockers").alias("_p", "locker_id")).join(depot_reach(asked, depots, flights), [*REQ, "locker_id"], "left")
    seen = seen.groupBy(*REQ, "l_ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "m"))), lambda s: s["m"]).alias("near"))
    right = selections(asked.withColumnsRenamed({"d_most": "max_depots", "d_fixed": "fixed_depots"}), depots, "depot").select(*REQ, F.col("ordinal").alias("d_ordinal"), F.col("members").alias("depots"), F.col("mask").alias("d_mask"))
    rules = asked.select(*REQ, "d_capacity", "o_capacity", "tolerance", "normal", "collect")
    rows = left.join(seen, [*REQ, "l_ordinal"], "left").join(right, REQ).join(rules, REQ)
    k, d_mask = F.size("depots"), F.col("d_mask")
    none = F.transform(d_mask, lambda x: F.lit(0).cast("long"))
    own = F.transform(F.coalesce("near", F.array().cast("array<array<bigint>>")), lambda m: F.when(m.isNull(), none).otherwise(_both(m, d_mask)))
    reached = F.aggregate("own", none, _either)
    collect, normal, tolerant = F.col("collect"), F.col("normal"), (F.col("tolerance") == 1) & (k > 0)
    stage = (
        F.when(collect & normal & ((k == 0) | (F.col("total") > k * F.col("d_capacity"))), "depot_capacity")
        .when(collect & tolerant & ((k < 2) | (F.col("total") > (k - 1) * F.col("o_capacity"))), "outage_capacity")
        .when(normal & F.exists("own", lambda m: ~_some(m)), "out_of_range")
        .when(tolerant & F.exists("own", lambda m: _sites_in(m) < 2), "second_supplier")
        .when(normal & (reached != d_mask), "idle_depot")
        .otherwise("passes")
    )
    return rows.withColumn("own", own).withColumn("stage", stage).select(*REQ, "l_ordinal", "lockers", "d_ordinal", "depots", "stage")


def funnel(screened: DataFrame) -> DataFrame:
    return screened.groupBy(*REQ, "stage").agg(F.count(F.lit(1)).alias("rows"))


def plausible_selections(cells: DataFrame, lockers: DataFrame, depots: DataFrame, walks: DataFrame, flights: DataFrame, k: int, m: int, limit_mm: int) -> DataFrame:
    """(region_id, lockers, depots): exact-budget selections that cover every cell and keep every
    locker in range of a depot; nothing else is tested."""
    req = cells.select("region_id").distinct().select("region_id", F.lit(0).cast("long").alias("request_id"), F.lit(limit_mm).alias("flight_limit_mm"))
    reach = search.Reach(cells, lockers, walks)
    asks = reach.regions.select("region_id", F.lit(k).alias("k"), F.lit(0).cast("long").alias("lo"), choose(F.col("n"), F.lit(k).cast("long")).alias("hi"))
    left = search.covering_sets(reach, asks, idle=True).join(site_lists(lockers), "region_id")
    left = left.select("region_id", "ordinal", F.transform("places", lambda p: F.get("ids", p)).alias("lockers"))
    seen = left.select("region_id", "ordinal", F.explode("lockers").alias("locker_id")).join(depot_reach(req, depots, flights).drop("request_id"), ["region_id", "locker_id"])
    seen = seen.groupBy("region_id", "ordinal").agg(F.collect_list("m").alias("own")).where(F.size("own") == k)
    right = combinations(depots, m).select("region_id", F.col("members").alias("depots"), F.col("mask").alias("d_mask"))
    rows = left.join(seen, ["region_id", "ordinal"]).join(right, "region_id")
    return rows.where(F.forall("own", lambda x: _some(_both(x, F.col("d_mask"))))).select("region_id", "lockers", "depots")


def resilience_audit(cells: DataFrame, lockers: DataFrame, depots: DataFrame, walks: DataFrame, flights: DataFrame, k: int | DataFrame, limit_mm: int | DataFrame) -> DataFrame:
    """(region_id, depots, robust_lockers, covered, full): for every k-subset of depots, lockers
    with two or more of them in range, and the cells that those reach. ``k`` and ``limit_mm``
    are numbers, or tables (region_id, k) and (region_id, flight_limit_mm)."""
    limit = F.col("flight_limit_mm") if isinstance(limit_mm, DataFrame) else F.lit(limit_mm)
    flights = flights.join(limit_mm.select("region_id", "flight_limit_mm"), "region_id") if isinstance(limit_mm, DataFrame) else flights
    near = flights.where(F.col("return_mm") <= limit).select("region_id", "locker_id", "depot_id")
    sets = combinations(depots, k).select("region_id", "ordinal", F.col("members").alias("depots"))
    robust = sets.select("region_id", "ordinal", F.explode("depots").alias("depot_id")).join(near, ["region_id", "depot_id"]).groupBy("region_id", "ordinal", "locker_id").count().where("count >= 2")
    seen = robust.join(walks.select("region_id", "locker_id", "cell_id"), ["region_id", "locker_id"], "left").groupBy("region_id", "ordinal").agg(F.countDistinct("locker_id").alias("robust_lockers"), F.countDistinct("cell_id").alias("covered"))
    n = cells.groupBy("region_id").agg(F.count(F.lit(1)).alias("cells"))
    out = sets.join(seen, ["region_id", "ordinal"], "left").na.fill(0, ["robust_lockers", "covered"]).join(n, "region_id")
    return out.select("region_id", "ordinal", "depots", "robust_lockers", "covered", (F.col("covered") == F.col("cells")).alias("full"))


def best_coverage(audit: DataFrame) -> DataFrame:
    """(region_id, sets, full_sets, best, best_ordinal)."""
    return audit.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("sets"), F.count_if("full").alias("full_sets"), F.max("covered").alias("best"), F.min_by("ordinal", F.struct(-F.col("covered"), "ordinal")).alias("best_ordinal")
    )


def cover_within(masks: DataFrame, cells: DataFrame, budget: int) -> DataFrame:
    """(region_id, witness): a set of at most ``budget`` sites that covers every cell, or null.

    ``masks(region_id, site_id, word, mask)`` over cells numbered by ``cells(region_id, ord)``:
    bit i of word w is cell 63 w + i, for any number of words. A state is the set of cells
    covered, an array of words; of the ways to reach it the least is kept. Each round
    branches on the uncovered cell with the fewest useful sites, so there are at most
    ``budget`` rounds.
    """
    bits = cells.select("region_id", F.floor(F.col("ord") / WORD).cast("int").alias("word"), _bit(F.col("ord") % WORD).alias("b"))
    masks = masks.withColumn("word", F.col("word").cast("int"))
    useful = masks.join(bits, ["region_id", "word"]).where(_and(F.col("mask"), F.col("b")) != 0).select("region_id", "word", "b", "site_id").distinct()
    degree = bits.join(useful.groupBy("region_id", "word", "b").count(), ["region_id", "word", "b"], "left").na.fill(0, ["count"])
    none = F.lit(0).cast("long")
    # the words of a list of (word, bits), in order and without gaps
    words = lambda of: F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda w: F.aggregate(F.filter(of, lambda s: s["word"] == w), none, lambda acc, s: acc.bitwiseOR(s["b"])))
    order = degree.groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("count", "word", "b"))).alias("cells"), (F.max("word") + 1).alias("words"))
    order = staged(order.withColumn("all", words(F.col("cells"))), "cover-order")
    sites = masks.groupBy("region_id", "site_id").agg(F.collect_list(F.struct("word", F.col("mask").alias("b"))).alias("m")).join(order.select("region_id", "words"), "region_id")
    useful = staged(useful.join(sites.select("region_id", "site_id", words(F.col("m")).alias("mask")), ["region_id", "site_id"]), "cover-useful")
    state = order.select("region_id", F.array_repeat(none, F.col("words")).alias("covered"), F.array().cast("array<bigint>").alias("path"))
    found = None
    for level in range(budget + 1):
        now = staged(state.join(order, "region_id"), "cover-state")
        done = now.where(F.col("covered") == F.col("all")).groupBy("region_id").agg(F.min("path").alias("witness"))
        found = staged(done if found is None else found.unionByName(done.join(found, "region_id", "left_anti")), "cover-found")
        if level == budget:
            break
        going = now.join(found, "region_id", "left_anti").withColumn("c", F.get(F.filter("cells", lambda c: _and(F.get("covered", c["word"]), c["b"]) == 0), F.lit(0)))
        going = going.select("region_id", "covered", "path", "c.word", "c.b")
        both = F.zip_with("covered", "mask", lambda x, y: x.bitwiseOR(y))
        state = going.join(useful, ["region_id", "word", "b"]).select("region_id", both.alias("covered"), F.concat("path", F.array("site_id")).alias("path"))
        state = state.groupBy("region_id", "covered").agg(F.min("path").alias("path"))
    return order.select("region_id").join(found, "region_id", "left")


# -- whole-unit assignment ----------------------------------------------------------------


def assign_units(items: DataFrame, choices: DataFrame, bins: DataFrame, max_states: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All load vectors that whole-unit assignments can reach, each with its least path.

    ``items(sel, pos, weight)`` with pos from 0; ``choices(sel, pos, rank, bin)`` with bins
    numbered from 0; ``bins(sel, n, capacity, require_used)``. Every completion depends only
    on the loads so far, so one path is kept for each distinct vector: the least in rank
    order, which is the one that a depth-first search meets first. A null capacity is none. One
    join per item, for all selections at once. Returns (final: sel, loads, path) and (capped: sel), selections with
    more than ``max_states`` vectors at some item, which are abandoned without conclusion.
    """
    n_items = items.groupBy("sel").agg(F.count(F.lit(1)).alias("items"))
    ahead = Window.partitionBy("sel").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    rest = items.withColumn("rest", F.sum("weight").over(ahead))
    steps = staged(rest.join(choices, ["sel", "pos"]).select("sel", "pos", "weight", "rest", "rank", "bin"), "assign-steps")
    zero = F.array_repeat(F.lit(0).cast("long"), F.col("n").cast("int"))
    state = staged(bins.join(n_items, "sel", "left").na.fill(0, ["items"]).withColumns({"loads": zero, "path": F.array().cast("array<int>")}), "assign-state")
    final = capped = None
    level = 0
    while True:
        over = state.where(F.col("items") == level)
        over = over.where(~F.col("require_used") | F.forall("loads", lambda x: x > 0)).select("sel", "loads", "path")
        final = over if final is None else final.unionByName(over)
        going = state.where(F.col("items") > level)
        if going.isEmpty():
            break
        here = steps.where(F.col("pos") == level)
        b = F.col("bin").cast("int")
        new = going.join(here, "sel").where(F.col("capacity").isNull() | (F.get("loads", b) + F.col("weight") <= F.col("capacity")))
        # what is left must fit into what is free, and reach every bin that is still empty
        free = F.aggregate("loads", F.lit(0).cast("long"), lambda acc, x: acc + F.col("capacity") - x)
        empty = F.size(F.filter("loads", lambda x: x == 0)) - F.when((F.get("loads", b) == 0) & (F.col("weight") > 0), 1).otherwise(0)
        new = new.where((F.col("capacity").isNull() | (F.col("rest") <= free)) & (~F.col("require_used") | (empty <= F.col("items") - level - 1)))
        loads = F.transform("loads", lambda x, i: F.when(i == b, x + F.col("weight")).otherwise(x))
        new = new.select("sel", "n", "capacity", "require_used", "items", loads.alias("loads"), F.concat("path", F.array(F.col("rank").cast("int"))).alias("path"))
        state = new.groupBy("sel", "n", "capacity", "require_used", "items", "loads").agg(F.min("path").alias("path"))
        state = staged(state, "assign-state")
        if max_states is not None:
            many = staged(state.groupBy("sel").count().where(F.col("count") > max_states).select("sel"), "assign-capped")
            capped = many if capped is None else capped.unionByName(many)
            state = state.join(many, "sel", "left_anti")
        level += 1
    if capped is None:
        capped = bins.select("sel").limit(0)
    return staged(final, "assign-final"), capped.distinct()


def supply_order(rows: DataFrame) -> DataFrame:
    """Adds ``pos``: lockers of a ``sel`` by fewest choices, largest load, id in collation order."""
    order = Window.partitionBy("sel").orderBy("n_choices", F.desc("weight"), F.collate(F.col("item").cast("string"), "UNICODE"))
    return rows.withColumn("pos", F.row_number().over(order) - 1)


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def cell_assignments(selected: DataFrame, cells: DataFrame, lockers: DataFrame, walks: DataFrame, max_states: int | None):
    """``selected(sel, region_id, members, capacity)`` -> (final, capped, order): load vectors of the
    lockers, in the order of ``members``; ``order(sel, pos, cell_id, rank, locker_id)``."""
    places = selected.select("sel", "region_id", F.posexplode("members").alias("bin", "locker_id"))
    ords = lockers.select("region_id", F.col("site_id").alias("locker_id"), "ord")
    pairs = places.join(walks.select("region_id", "locker_id", "cell_id"), ["region_id", "locker_id"]).join(ords, ["region_id", "locker_id"])
    all_ = selected.select("sel", "region_id").join(cells.select("region_id", "cell_id", "parcels"), "region_id")
    n = pairs.groupBy("sel", "cell_id").agg(F.count(F.lit(1)).alias("n_choices"))
    items = supply_order(all_.join(n.hint("merge"), ["sel", "cell_id"], "left").na.fill(0, ["n_choices"]).select("sel", F.col("cell_id").alias("item"), F.col("parcels").alias("weight"), "n_choices"))
    by = Window.partitionBy("sel", "cell_id").orderBy("ord")
    ranked = pairs.withColumn("rank", F.row_number().over(by) - 1).join(items.select("sel", F.col("item").alias("cell_id"), "pos").hint("merge"), ["sel", "cell_id"])
    ranked = staged(ranked.select("sel", "pos", "cell_id", "rank", "bin", "locker_id"), "cell-ranked")
    bins = selected.select("sel", F.size("members").alias("n"), "capacity", F.lit(True).alias("require_used"))
    final, capped = assign_units(items.select("sel", "pos", "weight"), ranked, bins, max_states)
    return final, capped, ranked


def supplier_assignments(states: DataFrame, flights: DataFrame, depots: DataFrame, max_states: int | None):
    """Suppliers for lockers with known loads. ``states(sel, region_id, members, loads, depots,
    flight_limit_mm, capacity, outage_depot)``; in normal operation (outage_depot null) every
    depot must be used, after an outage the failed one is no choice. Returns (final, capped, order)."""
    items = states.select("sel", "region_id", "depots", "flight_limit_mm", "outage_depot", F.posexplode(F.arrays_zip(F.col("members").alias("m"), F.col("loads").alias("w"))).alias("_i", "z"))
    items = items.select("sel", "region_id", "depots", "flight_limit_mm", "outage_depot", F.col("z.m").alias("locker_id"), F.col("z.w").alias("weight"))
    ords = depots.select("region_id", F.col("site_id").alias("depot_id"), "ord")
    near = items.join(flights, ["region_id", "locker_id"]).where((F.col("return_mm") <= F.col("flight_limit_mm")) & F.array_contains("depots", F.col("depot_id")) & ~F.col("depot_id").eqNullSafe(F.col("outage_depot")))
    near = near.join(ords.hint("merge"), ["region_id", "depot_id"]).withColumn("bin", F.array_position("depots", F.col("depot_id")) - 1)
    n = near.groupBy("sel", "locker_id").agg(F.count(F.lit(1)).alias("n_choices"))
    listed = supply_order(items.join(n, ["sel", "locker_id"], "left").na.fill(0, ["n_choices"]).select("sel", F.col("locker_id").alias("item"), "weight", "n_choices"))
    by = Window.partitionBy("sel", "locker_id").orderBy("ord")
    ranked = near.withColumn("rank", F.row_number().over(by) - 1).join(listed.select("sel", F.col("item").alias("locker_id"), "pos").hint("merge"), ["sel", "locker_id"])
    ranked = staged(ranked.select("sel", "pos", "locker_id", "rank", "bin", "depot_id"), "supply-ranked")
    bins = states.select("sel", F.size("depots").alias("n"), "capacity", F.col("outage_depot").isNull().alias("require_used"))
    final, capped = assign_units(listed.select("sel", "pos", "weight"), ranked, bins, max_states)
    return final, capped, ranked


# -- feasibility --------------------------------------------------------------------------


#: Rules of a request that can be taken away, by the ids of ``plans.verify.rule_groups``.
RULES = (
    "collection", "locker_budget", "locker_capacity", "supply", "depot_budget", "depot_capacity", "depot_outage_supply", "depot_outage_capacity", "fixed_lockers", "fixed_depots",
)
#: Ordinals of locker selections in the first round of a search, and how many times as many in the next one.
FIRST_RANGE, WIDER = 4096, 8


def terms(requests: DataFrame, lockers: DataFrame, depots: DataFrame) -> DataFrame:
    """What each request demands, without the rule that its column ``off`` names (if there is one).

    l_most, l_fixed, d_most, d_fixed are budgets and fixed selections; l_capacity, d_capacity, o_capacity
    capacities of lockers, of depots in normal operation and after an outage, null for none; ``collect``
    whether cells are served, ``normal`` whether lockers are supplied in normal operation.

    Where a rule is away, some choices cannot help and are left out. Without ``collection`` nothing is
    carried, so free lockers serve only to use fixed depots: as many as these are enough, and none of
    either where nothing is fixed. Without ``supply`` free depots serve only for outages of themselves:
    none is enough.
    """
    count = lambda t, name: t.groupBy("region_id").agg(F.count(F.lit(1)).cast("int").alias(name))
    rows = requests if "off" in requests.columns else requests.withColumn("off", F.lit(None).cast("string"))
    rows = rows.join(count(lockers, "_l"), "region_id", "left").join(count(depots, "_d"), "region_id", "left").na.fill(0, ["_l", "_d"])
    on = lambda rule: ~F.col("off").eqNullSafe(rule)
    l_fixed, d_fixed = F.when(on("fixed_lockers"), F.col("fixed_lockers")), F.when(on("fixed_depots"), F.col("fixed_depots"))
    rows = rows.withColumns({"l_fixed": l_fixed, "d_fixed": d_fixed, "collect": on("collection"), "normal": on("supply")})
    free_l, free_d = F.col("l_fixed").isNull(), F.col("d_fixed").isNull()
    l_most = F.when(on("locker_budget"), F.col("max_lockers")).otherwise(F.col("_l")).cast("int")
    d_most = F.when(on("depot_budget"), F.col("max_depots")).otherwise(F.col("_d")).cast("int")
    l_most = F.when(~F.col("collect") & free_l, F.least(l_most, F.when(free_d, 0).otherwise(F.size("d_fixed")))).otherwise(l_most)
    d_most = F.when(free_d & (~F.col("normal") | (~F.col("collect") & free_l)), 0).otherwise(d_most)
    cap = lambda rule, c: F.when(F.col("collect") & on(rule), F.col(c))
    return rows.select(
        *REQ, "flight_limit_mm", l_most.alias("l_most"), d_most.alias("d_most"), "l_fixed", "d_fixed", "collect", "normal", F.col("_l").alias("n_lockers"), F.col("_d").alias("n_depots"),
        cap("locker_capacity", "locker_capacity").alias("l_capacity"), cap("depot_capacity", "depot_capacity").alias("d_capacity"), cap("depot_outage_capacity", "depot_capacity").alias("o_capacity"),
        F.when(on("depot_outage_supply"), F.coalesce("outage_tolerance", F.lit(0))).otherwise(0).alias("tolerance"),
    )


class Search(NamedTuple):
    """What a search found: ``results`` and ``plans`` of ``feasibility_sweep``; the ``survivors(request,
    ordinal)``, locker selections that passed their own tests up to the range of the winner; ``space(request,
    l_space, d_space)``; and for each round its open requests, rows enumerated and pairs kept."""

    results: DataFrame
    plans: dict[str, DataFrame]
    survivors: DataFrame
    space: DataFrame
    rounds: list[dict]


def feasibility_sweep(cells: DataFrame, lockers: DataFrame, depots: DataFrame, walks: DataFrame, flights: DataFrame, requests: DataFrame, max_states: int | None = None, **options):
    """(results, plans): status of every request and the first feasible plan.

    Status is ``feasible``, ``unsat``, ``timeout`` (with ``max_states``: a selection was abandoned
    and none is feasible; never unsat) or ``error`` (invalid request). Without ``max_states``, the
    default, every request is decided. ``results`` also has the ordinals of
    the winning selections. ``plans`` is a dict of the plan tables of ``plans.verify``.
    """
    found = search_requests(cells, lockers, depots, walks, flights, requests, max_states, **options)
    return found.results, found.plans


def search_requests(cells: DataFrame, lockers: DataFrame, depots: DataFrame, walks: DataFrame, flights: DataFrame, requests: DataFrame, max_states: int | None = None, first_range: int = FIRST_RANGE) -> Search:
    """The search of every request in the order of its selections, in ranges of ordinals.

    A round takes the next range of every open request; equal ranges of a region are enumerated once for
    all requests. A request is closed by its first feasible pair or the end of its selections, so
    what lies behind a winner's range is never enumerated. Ranges grow WIDER-fold, so the
    number of rounds grows with the logarithm of the selections.
    """
    from .verify import validate_requests

    as_plan = requests.withColumnRenamed("request_id", "plan_id")
    broken = staged(validate_requests(as_plan, lockers, depots).select("region_id", F.col("plan_id").alias("request_id")).distinct(), "sweep-broken")
    good = staged(_spaces(terms(requests.join(broken, REQ, "left_anti"), lockers, depots), cells), "sweep-terms")
    # what is joined by the region alone before this is a row for each region; from here on it is rows of a region
    cells, lockers, walks, flights = _dealt(cells, lockers, walks, flights)
    reach = search.Reach(cells, lockers, walks)
    world, at, width, rounds = (cells, lockers, depots, walks, flights), 0, first_range, []
    open_, results, plans, survivors, undecided = good.where("l_space > 0"), [], [], [], []
    while not open_.isEmpty():
        log: list[int] = []
        first = staged(_lockers_in(open_, reach, at, at + width, lockers, cells, walks, log), "sweep-survivors")
        survivors.append(first.select(*REQ, F.col("l_ordinal").alias("ordinal")))
        won, tables, capped = _decided(world, first, open_, max_states)
        rounds.append({"requests": open_.count(), "rows": sum(log), "survivors": first.count()})
        results.append(won)
        plans.append(tables)
        undecided.append(capped)
        at, width = at + width, width * WIDER
        open_ = staged(open_.where(F.col("l_space") > at).join(won.select(*REQ), REQ, "left_anti"), "sweep-open")
    union = lambda parts, empty: reduce(DataFrame.unionByName, parts) if parts else empty
    nothing = requests.select(*REQ).limit(0)
    win = union(results, nothing.withColumns({"l_ordinal": F.lit(0).cast(LONG), "d_ordinal": F.lit(0).cast(LONG)}))
    many = union(undecided, nothing).distinct().withColumn("_open", F.lit(True))
    win, many = _dealt(win, many)
    out = requests.select(*REQ).join(broken.withColumn("_bad", F.lit(True)), REQ, "left").join(win.withColumn("_won", F.lit(True)), REQ, "left").join(many, REQ, "left")
    status = F.when(F.col("_bad"), "error").when(F.col("_won"), "feasible").when(F.col("_open"), "timeout").otherwise("unsat")
    out = staged(out.select(*REQ, status.alias("status"), "l_ordinal", "d_ordinal"), "sweep-results")
    found = {name: reduce(DataFrame.unionByName, [p[name] for p in plans]) for name in plans[0]} if plans else _no_plans(requests)
    return Search(out, found, union(survivors, nothing.withColumn("ordinal", F.lit(0).cast(LONG))), good.select(*REQ, "l_space", "d_space"), rounds)


def _lockers_in(open_: DataFrame, reach: search.Reach, start: int, end: int, lockers: DataFrame, cells: DataFrame, walks: DataFrame, log: list[int] | None) -> DataFrame:
    """(request, l_ordinal, lockers, total): locker selections with ordinals in [start, end) that pass their own tests."""
    base = open_.select(*REQ, "l_most", "l_fixed", "l_capacity", "collect", "total", "n_lockers").join(site_lists(lockers), "region_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    named = F.transform("places", lambda p: F.get("ids", p)).alias("lockers")
    enough = lambda k: F.col("l_capacity").isNull() | (F.col("total") <= k * F.col("l_capacity"))
    ranged = search.asked(base.where("l_fixed is null and collect").select("*", F.col("n_lockers").alias("n"), F.col("l_most").alias("most"), F.lit(start).cast(LONG).alias("at"), F.lit(end).cast(LONG).alias("until")))
    ranged = staged(ranged.where((F.col("k") > 0) & enough(F.col("k"))).select(*REQ, "ids", "total", "k", "before", "lo", "hi"), "sweep-ranges")
    key = ["region_id", "k", "lo", "hi"]
    sets = search.covering_sets(reach, ranged.select(*key).distinct(), log=log)
    free = ranged.join(sets, key).select(*REQ, (F.col("before") + F.col("ordinal")).alias("l_ordinal"), named, "total")
    # a fixed selection is the only one, and the first
    fixed = base.where(F.col("l_fixed").isNotNull() & F.lit(start == 0)).select(*REQ, "l_fixed", "l_capacity", "collect", "total")
    met = fixed.select(*REQ, F.explode("l_fixed").alias("locker_id")).join(walks.select("region_id", "locker_id", "cell_id"), ["region_id", "locker_id"]).join(cells.select("region_id", "cell_id"), ["region_id", "cell_id"], "left_semi")
    met = met.groupBy(*REQ).agg(F.countDistinct("cell_id").alias("_cells"), F.countDistinct("locker_id").alias("_used"))
    n = cells.groupBy("region_id").agg(F.count(F.lit(1)).alias("_n"))
    fixed = fixed.join(met, REQ, "left").join(n, "region_id", "left")
    k = F.size("l_fixed")
    passes = ~F.col("collect") | ((k > 0) & enough(k) & (F.col("_cells") == F.col("_n")) & (F.col("_used") == k))
    held = fixed.where(passes).select(*REQ, F.lit(0).cast(LONG).alias("l_ordinal"), F.col("l_fixed").alias("lockers"), "total")
    # without collection every selection passes; terms() leaves few of them
    idle = selections(open_.where("not collect and l_fixed is null").withColumnsRenamed({"l_most": "max_lockers", "l_fixed": "fixed_lockers"}), lockers, "locker").where((F.col("ordinal") >= start) & (F.col("ordinal") < end))
    return free.unionByName(held).unionByName(idle.select(*REQ, F.col("ordinal").alias("l_ordinal"), F.col("members").alias("lockers"), F.lit(0).cast(LONG).alias("total")))


def _decided(world: tuple, first: DataFrame, asked: DataFrame, max_states: int | None):
    """(won, plans, capped): the first feasible pair of each request among ``first``, its plan tables, and
    the requests with an abandoned selection. Each request's first pair is tried by itself: where it is feasible, the
    others are not."""
    _, _, depots, _, flights = world
    kept = staged(screen_pairs(first, asked, depots, flights).where("stage = 'passes'").drop("stage"), "sweep-kept")
    place = F.struct("l_ordinal", "d_ordinal")
    leading = kept.groupBy(*REQ).agg(F.min(place).alias("p")).select(*REQ, "p.l_ordinal", "p.d_ordinal")
    place = [*REQ, "l_ordinal", "d_ordinal"]
    won, tables, capped = _tried(world, kept.join(leading, place), asked, max_states)
    rest = staged(kept.join(leading, place, "left_anti").join(won.select(*REQ), REQ, "left_anti").select(*kept.columns), "sweep-rest")
    if rest.isEmpty():
        return won, tables, capped
    more, others, gone = _tried(world, rest, asked, max_states)
    return won.unionByName(more), {name: t.unionByName(others[name]) for name, t in tables.items()}, capped.unionByName(gone)


def _tried(world: tuple, kept: DataFrame, asked: DataFrame, max_states: int | None):
    """(won, plans, capped) as in ``_decided``, of all pairs ``kept``."""
    cells, lockers, depots, walks, flights = world
    caps = asked.select(*REQ, "l_capacity", "d_capacity", "o_capacity", "flight_limit_mm", "tolerance", "normal", "collect")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    # the cells' assignments depend on the lockers and their capacity only, the suppliers' on these, the depots, the
    # range and the capacities: once for all requests. What they make many rows of has numbers for keys
    with_cap = kept.join(caps, REQ).withColumn("lkey", _key(F.col("region_id"), text("l_capacity"), text("collect"), listed("lockers")))
    with_cap = staged(with_cap.withColumn("pkey", _key(F.col("lkey"), listed("depots"), F.col("flight_limit_mm"), text("d_capacity"), text("o_capacity"), text("normal"))), "sweep-pairs")
    any_ = lambda *names: [F.first(c).alias(c) for c in names]
    chosen = with_cap.where("collect").groupBy("lkey").agg(*any_("region_id", "lockers", "l_capacity"))
    chosen = staged(chosen.withColumn("lsel", F.monotonically_increasing_id()), "sweep-lockers")
    selected = chosen.select(F.col("lsel").alias("sel"), "region_id", F.col("lockers").alias("members"), F.col("l_capacity").alias("capacity"))
    loads, capped_cells, cell_order = cell_assignments(selected, cells, lockers, walks, max_states)
    loads = loads.select(F.col("sel").alias("lsel"), "loads", F.col("path").alias("cell_path"))
    pairs = with_cap.groupBy("pkey").agg(*any_("lkey", "region_id", "lockers", "depots", "flight_limit_mm", "d_capacity", "o_capacity", "normal", "collect"), F.max("tolerance").alias("tolerance"))
    pairs = staged(pairs.join(chosen.select("lkey", "lsel"), "lkey", "left").drop("lkey").withColumn("psel", F.monotonically_increasing_id()), "sweep-distinct")
    # where nothing is collected, each locker counts as one, and only whether depots are used matters
    ones = F.transform("lockers", lambda x: F.lit(1).cast(LONG))
    idle = pairs.where("not collect").withColumns({"loads": ones, "cell_path": F.array().cast("array<int>")})
    cases = pairs.where("collect").join(loads, "lsel").unionByName(idle).drop("lsel", "pkey", "collect")
    cases = staged(cases.withColumn("dsel", F.monotonically_increasing_id()), "sweep-cases")
    normal = F.when(F.col("normal"), F.array(F.lit(None).cast(LONG))).otherwise(F.array().cast("array<bigint>"))
    scopes = F.when(F.col("tolerance") == 1, F.concat(normal, "depots")).otherwise(normal)
    capacity = F.when(F.col("outage_depot").isNull(), F.col("d_capacity")).otherwise(F.col("o_capacity")).alias("capacity")
    each = cases.select("dsel", "region_id", F.col("lockers").alias("members"), "loads", "depots", "flight_limit_mm", "d_capacity", "o_capacity", F.explode(scopes).alias("outage_depot"))
    each = each.select("dsel", "region_id", "members", "loads", "depots", "flight_limit_mm", "outage_depot", capacity)
    each = staged(each.withColumn("sel", F.monotonically_increasing_id()), "sweep-scopes")
    served, capped_supply, supply_order_ = supplier_assignments(each, flights, depots, max_states)
    best = served.groupBy("sel").agg(F.min("path").alias("supply_path"))
    per = each.select("sel", "dsel", "outage_depot").join(best, "sel", "left").join(capped_supply.withColumn("_capped", F.lit(True)), "sel", "left")
    per = staged(per.withColumn("_capped", F.coalesce("_capped", F.lit(False))), "sweep-per")
    ok, usual = F.col("supply_path").isNotNull(), F.col("outage_depot").isNull()
    counts = per.groupBy("dsel").agg(F.bool_and(F.when(usual, ok)).alias("ok_0"), F.bool_and(ok).alias("ok_1"), F.bool_or(usual & F.col("_capped")).alias("capped_0"), F.bool_or("_capped").alias("capped_1"))
    # a case without any scope, as where nothing need be supplied, holds
    judged = cases.select("psel", "cell_path", "dsel").join(counts, "dsel", "left")
    judged = judged.groupBy("psel").agg(
        *[F.min(F.when(F.coalesce(f"ok_{t}", F.lit(True)), F.struct("cell_path", "dsel"))).alias(f"w_{t}") for t in (0, 1)], *[F.bool_or(F.coalesce(f"capped_{t}", F.lit(False))).alias(f"capped_{t}") for t in (0, 1)]
    )
    judged = staged(pairs.select("pkey", "psel", "lsel").join(judged, "psel", "left").drop("psel"), "sweep-judged")
    mine = lambda name: F.when(F.col("tolerance") == 1, F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    verdict = with_cap.select(*REQ, "l_ordinal", "d_ordinal", "pkey", "tolerance").join(judged, "pkey").withColumns({"w": mine("w"), "capped": mine("capped")})
    win = verdict.where("w is not null").groupBy(*REQ).agg(F.min(F.struct("l_ordinal", "d_ordinal", "w.cell_path", "w.dsel", "lsel")).alias("w"))
    win = staged(win.select(*REQ, "w.*"), "sweep-winners")
    capped_cells = chosen.join(capped_cells.withColumnRenamed("sel", "lsel"), "lsel", "left_semi").select("lkey")
    capped = with_cap.join(capped_cells, "lkey", "left_semi").select(*REQ).union(verdict.where("capped").select(*REQ)).distinct()
    return win.select(*REQ, "l_ordinal", "d_ordinal"), _plans(win, with_cap, cell_order, per, supply_order_), staged(capped, "sweep-undecided")


def _no_plans(requests: DataFrame) -> dict[str, DataFrame]:
    none = requests.select("region_id", F.col("request_id").alias("plan_id")).limit(0)
    put = lambda **c: none.withColumns({k: F.lit(None).cast(v) for k, v in c.items()})
    return {
        "plan_sites": put(kind="string", pos=LONG, site_id=LONG), "plan_cells": put(pos=LONG, cell_id=LONG, locker_id=LONG),
        "plan_supply": put(pos=LONG, outage_depot=LONG, locker_id=LONG, depot_id=LONG), "plan_outages": put(pos=LONG, depot_id=LONG),
    }


def _plans(results, with_cap, cell_order, per, supplies) -> dict[str, DataFrame]:
    won = results.join(with_cap.drop("collect"), [*REQ, "l_ordinal", "d_ordinal"]).withColumnRenamed("request_id", "plan_id")
    won = staged(won.select("region_id", "plan_id", "lockers", "depots", "lsel", "dsel", "cell_path", "tolerance"), "sweep-won")
    key = ["region_id", "plan_id"]
    site = lambda kind: won.select(*key, F.lit(kind).alias("kind"), F.posexplode(f"{kind}s").alias("pos", "site_id"))
    steps = won.select(*key, F.col("lsel").alias("sel"), F.posexplode("cell_path").alias("pos", "rank"))
    plan_cells = steps.join(cell_order, ["sel", "pos", "rank"]).select(*key, F.col("pos").cast("long"), "cell_id", "locker_id")
    scopes = won.select(*key, "dsel", "tolerance").join(per.where("supply_path is not null"), "dsel").where(F.col("outage_depot").isNull() | (F.col("tolerance") == 1))
    rows = scopes.select(*key, "sel", "outage_depot", F.posexplode("supply_path").alias("pos", "rank")).join(supplies, ["sel", "pos", "rank"])
    return {
        "plan_sites": site("locker").unionByName(site("depot")).withColumn("pos", F.col("pos").cast("long")),
        "plan_cells": plan_cells,
        "plan_supply": rows.select(*key, F.col("pos").cast("long"), "outage_depot", "locker_id", "depot_id"),
        "plan_outages": won.where("tolerance = 1").select(*key, F.posexplode("depots").alias("pos", "depot_id")).withColumn("pos", F.col("pos").cast("long")),
    }


def first_feasible(survivors: DataFrame) -> DataFrame:
    """(request, members, ordinal): the first in enumeration order."""
    return survivors.groupBy(*REQ).agg(F.min_by("members", "ordinal").alias("members"), F.min("ordinal").alias("ordinal"))


def selection_outcomes(cells, lockers, depots, walks, flights, limits: DataFrame, plausible: DataFrame, max_states: int | None = None) -> DataFrame:
    """(region_id, lockers, depots, status): the outcome of each exact selection.

    ``limits(region_id, ...)`` has one row of limits for each region."""
    fixed = numbered(plausible, "region_id", ["lockers", "depots"], "request_id").withColumn("request_id", F.col("request_id").cast("long"))
    fixed = staged(fixed.withColumnsRenamed({"lockers": "fixed_lockers", "depots": "fixed_depots"}), "outcome-fixed")
    requests = limits.drop("request_id", "fixed_lockers", "fixed_depots").join(fixed, "region_id")
    results, _ = feasibility_sweep(cells, lockers, depots, walks, flights, requests, max_states)
    return results.join(fixed, REQ).select("region_id", F.col("fixed_lockers").alias("lockers"), F.col("fixed_depots").alias("depots"), "status")


def outcome_counts(results: DataFrame) -> DataFrame:
    """(region_id, feasible, unsat, other)."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    s = F.col("status")
    return results.groupBy("region_id").agg(n(s == "feasible", "feasible"), n(s == "unsat", "unsat"), n(~s.isin("feasible", "unsat"), "other"))


def blocking_rules(cells, lockers, depots, walks, flights, requests: DataFrame, max_states: int | None = None) -> DataFrame:
    """(request, rule_id): rules that alone, taken away, make an unsatisfiable request feasible.

    Only rules that the request brings are tried, by the ids of ``plans.verify.rule_groups``: a rule is
    switched off in the screens and assignments, no limit is replaced by a larger number."""
    from .verify import rule_groups

    (requests,) = _dealt(requests)
    brought = rule_groups(requests.withColumnRenamed("request_id", "plan_id")).select("region_id", F.col("plan_id").alias("_of"), "rule_id")
    place = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule_id")) - 1
    relaxed = requests.withColumnRenamed("request_id", "_of").join(brought, ["region_id", "_of"])
    relaxed = staged(relaxed.withColumns({"off": F.col("rule_id"), "request_id": (F.col("_of") * len(RULES) + place).cast("long")}), "relaxed")
    results, _ = feasibility_sweep(cells, lockers, depots, walks, flights, relaxed.drop("rule_id", "_of"), max_states)
    return results.where("status = 'feasible'").join(relaxed.select(*REQ, "rule_id", "_of"), REQ).select("region_id", F.col("_of").alias("request_id"), "rule_id")


def search_counters(found: Search) -> DataFrame:
    """(region_id, request_id, status, locker_sets_checked, site_selections_checked) of a search."""
    return search.counters(found.survivors, found.results, found.space)
