"""Enumeration of covering selections without their whole product, and the search over them.

Cells that the same sites reach are one class of cells. A prefix of a selection carries the classes
that it covers; it is dropped when the sites behind its last one cannot cover the rest, together or
with as many as are still to be chosen. A prefix stands for an interval of ordinals of the
lexicographic order, so any range of ordinals is enumerated by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.scalars import choose
from ..functions.staging import dealt as staged

#: Bits that are used of a word of a mask.
WORD = 63


def _long(c: Column) -> Column:
    return c.cast("long")


class Reach:
    """Which classes of cells each site covers, by region.

    ``sites``: a row for each site with its own classes, those of the sites behind it, and the most
    classes that one of these has, all as masks of as many words as the region's classes need.
    ``regions``: sites, words and all classes; a region with a cell that no site reaches has none.
    """

    def __init__(self, cells: DataFrame, lockers: DataFrame, walks: DataFrame):
        cells, lockers, walks = (t.hint("merge") for t in (cells, lockers, walks))
        ords = lockers.select("region_id", F.col("site_id").alias("locker_id"), F.col("ord").cast("int").alias("ord"))
        near = walks.select("region_id", "cell_id", "locker_id").join(ords, ["region_id", "locker_id"])
        of_cell = cells.select("region_id", "cell_id").join(near.groupBy("region_id", "cell_id").agg(F.sort_array(F.collect_set("ord")).alias("o")), ["region_id", "cell_id"], "left")
        classes = numbered(of_cell.where("o is not null").select("region_id", "o").distinct(), "region_id", ["o"], "class")
        classes = classes.select("region_id", F.col("class").cast("long"), "o")
        lost = of_cell.where("o is null").select("region_id").distinct().withColumn("lost", F.lit(True))
        n = lockers.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
        sizes = classes.groupBy("region_id").agg((F.floor(F.max("class") / F.lit(WORD)) + 1).cast("int").alias("words"))
        known = cells.select("region_id").distinct().join(n, "region_id", "left").join(sizes, "region_id", "left").join(lost, "region_id", "left")
        self.regions = staged(known.select("region_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("words", F.lit(1)).alias("words"), F.coalesce("lost", F.lit(False)).alias("lost")), "reach-regions")
        self.sites = staged(self._masks(classes, lockers), "reach-sites")

    def _masks(self, classes: DataFrame, lockers: DataFrame) -> DataFrame:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("class") % WORD).cast("int"))
        some = classes.select("region_id", F.explode("o").alias("ord"), F.floor(F.col("class") / F.lit(WORD)).cast("int").alias("word"), bit.alias("b"))
        some = some.groupBy("region_id", "ord", "word").agg(F.bit_or("b").alias("b"))
        # a row for each site and word, so that one word of all later sites is a running sum
        every = lockers.select("region_id", F.col("ord").cast("int").alias("ord")).join(self.regions.select("region_id", "words"), "region_id")
        every = every.withColumn("word", F.explode(F.sequence(F.lit(0), F.col("words") - 1))).join(some.hint("merge"), ["region_id", "ord", "word"], "left")
        none = F.lit(0).cast("long")
        behind = Window.partitionBy("region_id", "word").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
        every = every.withColumn("b", F.coalesce("b", none)).withColumn("after", F.coalesce(F.bit_or("b").over(behind), none))
        rows = every.groupBy("region_id", "ord").agg(F.sort_array(F.collect_list(F.struct("word", "b", "after"))).alias("w"))
        rows = rows.select("region_id", "ord", F.transform("w", lambda x: x["b"]).alias("own"), F.transform("w", lambda x: x["after"]).alias("after"))
        rows = rows.withColumn("size", _bits(F.col("own")))
        later = Window.partitionBy("region_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("widest", F.coalesce(F.max("size").over(later), F.lit(0)))


def _bits(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def _either(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def covering_sets(reach: Reach, asks: DataFrame, idle: bool = False, log: list | None = None) -> DataFrame:
    """(region_id, k, lo, hi, ordinal, places): the k-subsets of a region's sites that cover every cell.

    ``asks(region_id, k, lo, hi)`` wants those whose ordinal among all k-subsets, in lexicographic
    order, is in [lo, hi). With ``idle`` sites that reach no cell may be among them. ``log`` gets
    the number of rows of every level.
    """
    none = F.lit(0).cast("long")
    all_ = reach.sites.groupBy("region_id").agg(F.max_by(_either("own", "after"), -F.col("ord")).alias("all"))
    start = asks.select("region_id", F.col("k").cast("int").alias("k"), _long(F.col("lo")).alias("lo"), _long(F.col("hi")).alias("hi"))
    start = start.join(reach.regions.where("not lost"), "region_id").join(all_, "region_id").where("k between 1 and n and lo < hi")
    state = start.withColumns({"base": none, "last": F.lit(-1), "covered": F.array_repeat(none, F.col("words")), "places": F.array().cast("array<int>")}).drop("words", "lost")
    found, depth, most = [], 0, asks.agg(F.max("k")).first()[0] or 0
    while depth < most:
        depth += 1
        going = state.where(F.col("k") >= depth)
        left = F.col("k") - depth
        sites = F.sequence(F.col("last") + 1, (F.col("n") - left - 1).cast("int"))
        going = going.withColumn("ord", F.explode(F.when(F.col("last") + 1 <= F.col("n") - left - 1, sites)))
        # subsets that begin with the prefix and an earlier site come before
        before = choose(F.col("n") - 1 - F.col("last"), _long(left + 1)) - choose(F.col("n") - F.col("ord"), _long(left + 1))
        going = going.withColumn("base", F.col("base") + before).withColumn("_size", choose(F.col("n") - 1 - F.col("ord"), _long(left)))
        going = going.where("base < hi and base + _size > lo").join(reach.sites, ["region_id", "ord"])
        if not idle:
            going = going.where("size > 0")
        going = going.withColumn("covered", _either("covered", "own"))
        missing = F.zip_with("all", "covered", lambda x, y: x.bitwiseAND(F.bitwise_not(y)))
        going = going.withColumn("_missing", missing)
        hidden = F.exists(F.zip_with("_missing", "after", lambda x, y: x.bitwiseAND(F.bitwise_not(y))), lambda x: x != 0)
        kept = going.where(F.when(left > 0, ~hidden & (_bits(F.col("_missing")) <= left * F.col("widest"))).otherwise(~F.exists("_missing", lambda x: x != 0)))
        state = staged(kept.select("region_id", "k", "lo", "hi", "n", "all", "base", F.col("ord").alias("last"), "covered", F.concat("places", F.array("ord")).alias("places")), "cover-prefixes")
        if log is not None:
            log.append(state.count())
        found.append(state.where(F.col("k") == depth))
    out = found[0] if found else state.where("false")
    for t in found[1:]:
        out = out.unionByName(t)
    return out.select("region_id", "k", "lo", "hi", F.col("base").alias("ordinal"), "places")


def spaces(n: Column, most: Column, fixed: Column) -> Column:
    """Number of selections of a request: of all sizes up to its budget, or the fixed one within it."""
    sizes = F.sequence(F.lit(0), F.greatest(most, F.lit(0)).cast("int"))
    free = F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, k: acc + choose(_long(n), _long(k)))
    return F.when(fixed.isNotNull(), F.when(F.size(fixed) <= most, 1).otherwise(0)).when(most < 0, 0).otherwise(free).cast("long")


def asked(open_: DataFrame) -> DataFrame:
    """``open_`` with a row for each size whose ordinals meet [at, until): k, lo, hi and ``before``, the number of
    larger selections. ``open_(n, most, at, until, ...)``."""
    sizes = F.sequence(F.col("most").cast("int"), F.lit(0))
    rows = open_.withColumn("k", F.explode(sizes))
    larger = F.aggregate(F.filter(sizes, lambda s: s > F.col("k")), F.lit(0).cast("long"), lambda acc, s: acc + choose(_long(F.col("n")), _long(s)))
    rows = rows.withColumn("before", larger)
    lo = F.greatest(F.col("at") - F.col("before"), F.lit(0).cast("long"))
    hi = F.least(F.col("until") - F.col("before"), choose(_long(F.col("n")), _long(F.col("k"))))
    return rows.withColumns({"lo": lo, "hi": hi}).where("lo < hi")


def counters(survivors: DataFrame, results: DataFrame, space: DataFrame) -> DataFrame:
    """(region_id, request_id, status, locker_sets_checked, site_selections_checked): how far the search
    of each request goes in enumeration order, up to its first feasible pair or to the end.

    ``survivors(request, ordinal)`` are locker selections that pass their own tests, ``space(request,
    l_space, d_space)`` the numbers of selections. Invalid requests are not searched; where a
    search ended without conclusion both are null.
    """
    req = ["region_id", "request_id"]
    rows = results.join(space, req, "left")
    before = survivors.join(results.select(*req, "l_ordinal"), req).where("l_ordinal is null or ordinal < l_ordinal").groupBy(*req).agg(F.count(F.lit(1)).alias("_before"))
    rows = rows.join(before.hint("merge"), req, "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    found, s = F.col("status") == "feasible", F.col("status")
    sets = F.when(found, F.col("l_ordinal") + 1).when(s == "unsat", F.col("l_space")).when(s == "error", 0)
    pairs = F.when(found, F.col("_before") * F.col("d_space") + F.col("d_ordinal") + 1).when(s == "unsat", F.col("_before") * F.col("d_space")).when(s == "error", 0)
    return rows.select(*req, "status", sets.cast("long").alias("locker_sets_checked"), pairs.cast("long").alias("site_selections_checked"))
