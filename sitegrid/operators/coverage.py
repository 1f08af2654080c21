"""Who can walk where: eligible pairs, coverage, choice counts and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered

KEY = "region_id"


def eligible_walks(reach: DataFrame, lockers: DataFrame) -> DataFrame:
    """(region_id, cell_id, locker_id, distance_mm) from catchments at the lockers' nodes."""
    sites = lockers.select(KEY, F.col("site_id").alias("locker_id"), "node_id")
    return reach.join(sites, [KEY, "node_id"]).select(KEY, "cell_id", "locker_id", "distance_mm")


def _chosen(walks: DataFrame, selection: DataFrame) -> DataFrame:
    """Walks to selected lockers; ``selection(region_id, site_id)``."""
    return walks.join(selection.select(KEY, F.col("site_id").alias("locker_id")).distinct(), [KEY, "locker_id"], "left_semi")


def uncovered_cells(cells: DataFrame, walks: DataFrame, selection: DataFrame) -> DataFrame:
    return cells.join(_chosen(walks, selection).select(KEY, "cell_id"), [KEY, "cell_id"], "left_anti")


def coverage_flags(cells: DataFrame, walks: DataFrame, selection: DataFrame) -> DataFrame:
    seen = _chosen(walks, selection).select(KEY, "cell_id").distinct().withColumn("_c", F.lit(True))
    return cells.join(seen, [KEY, "cell_id"], "left").withColumn("covered", F.col("_c").isNotNull()).drop("_c")


def sites_without_backup(lockers: DataFrame, depots: DataFrame, flights: DataFrame, limit_mm: int, tolerance: int) -> DataFrame:
    """Selected lockers with at most ``tolerance`` selected depots in range, and that count."""
    near = flights.where(F.col("return_mm") <= limit_mm).join(depots.select(KEY, F.col("site_id").alias("depot_id")), [KEY, "depot_id"], "left_semi")
    own = lockers.select(KEY, F.col("site_id").alias("locker_id"))
    return own.join(near, [KEY, "locker_id"], "left").groupBy(KEY, "locker_id").agg(F.count("depot_id").alias("depots")).where(F.col("depots") < tolerance + 1)


def choice_counts(items: DataFrame, pairs: DataFrame, item: str = "cell_id") -> DataFrame:
    """(region_id, item, choices), zero included."""
    n = pairs.groupBy(KEY, item).agg(F.count(F.lit(1)).alias("choices"))
    return items.select(KEY, item).distinct().join(n, [KEY, item], "left").withColumn("choices", F.coalesce("choices", F.lit(0).cast("long")))


def degree_histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy(KEY, "choices").agg(F.count(F.lit(1)).alias("n"))


def degree_summary(counts: DataFrame) -> DataFrame:
    """min, upper median, max and mean (sum and count, and to two decimals) of the choices.

    The median is the first degree whose running count exceeds half of all: a window over the
    histogram, which has one row for each different degree.
    """
    run = Window.partitionBy(KEY).orderBy("choices")
    h = degree_histogram(counts).withColumns({"_run": F.sum("n").over(run), "_all": F.sum("n").over(Window.partitionBy(KEY))})
    past = F.when(F.col("_run") > F.floor(F.col("_all") / 2), F.col("choices"))
    total = F.sum(F.col("choices") * F.col("n"))
    return h.groupBy(KEY).agg(
        F.min("choices").alias("min"), F.min(past).alias("median"), F.max("choices").alias("max"), total.alias("total"), F.sum("n").alias("items"), F.round(total / F.sum("n"), 2).alias("mean")
    )


def min_choices(counts: DataFrame, required: int) -> DataFrame:
    return counts.groupBy(KEY).agg(F.min("choices").alias("fewest")).withColumn("enough", F.col("fewest") >= required)


def assignment_space(counts: DataFrame) -> DataFrame:
    """Size of the raw assignment space as log10; null (none) if some item has no choice."""
    h = degree_histogram(counts)
    return h.groupBy(KEY).agg(F.when(F.min("choices") > 0, F.sum(F.col("n") * F.log10(F.greatest("choices", F.lit(1))))).alias("log10_size"))


def coverage_masks(walks: DataFrame, cells: DataFrame) -> DataFrame:
    """(region_id, locker_id, word, mask): bit i of word w stands for the region's cell 63 w + i."""
    placed = numbered(cells.select(KEY, "cell_id"), KEY, ["cell_id"], "_ord")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_ord") % 63).cast("int"))
    joined = walks.join(placed, [KEY, "cell_id"])
    return joined.groupBy(KEY, "locker_id", F.floor(F.col("_ord") / 63).alias("word")).agg(F.bit_or(bit).alias("mask"))


def covered_count(selection: DataFrame, walks: DataFrame) -> DataFrame:
    """Exact number of distinct cells that the selected lockers reach, by region."""
    return _chosen(walks, selection).groupBy(KEY).agg(F.countDistinct("cell_id").alias("covered"))


def eligible_choices(pairs: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected lockers that each cell can reach: the rows, not a list."""
    return _chosen(pairs, selection)


def ranked_choices(walks: DataFrame) -> DataFrame:
    order = Window.partitionBy(KEY, "cell_id").orderBy("distance_mm", "locker_id")
    return walks.withColumn("rank", F.row_number().over(order))


def nearest_choice(walks: DataFrame, selection: DataFrame) -> DataFrame:
    """Each cell's nearest selected locker: a minimum, which Spark folds map-side."""
    best = _chosen(walks, selection).groupBy(KEY, "cell_id").agg(F.min(F.struct("distance_mm", "locker_id")).alias("m"))
    return best.select(KEY, "cell_id", "m.locker_id", "m.distance_mm")


def constrained_order(cells: DataFrame, walks: DataFrame, selection: DataFrame) -> DataFrame:
    """Cells by fewest selected choices, most parcels, then id in collation order."""
    n = choice_counts(cells, _chosen(walks, selection)).join(cells.select(KEY, "cell_id", "parcels"), [KEY, "cell_id"])
    order = ["choices", F.desc("parcels"), F.collate(F.col("cell_id").cast("string"), "UNICODE")]
    return numbered(n, KEY, order, "pos").withColumn("pos", (F.col("pos") + 1).cast("int"))
