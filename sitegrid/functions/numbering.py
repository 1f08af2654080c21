"""Places of rows in an order, by a distributed sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def numbered(df: DataFrame, key: str, order: list[Column | str], name: str) -> DataFrame:
    """Adds ``name``: the place (from 0) of a row among those of its ``key``, in ``order``.

    Rows are range-partitioned by key and order, so that a key with all the rows is spread over
    the cluster; only counts by range and key are added up in one place for each key.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, key, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n")).select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_range").orderBy(*order)
    # there are as many starts as keys at least: they are dealt out as the windows want the rows
    return ranged.join(starts.hint("merge"), [key, "_range"]).withColumn(name, F.row_number().over(inside) - 1 + F.col("_before")).drop("_range", "_before")


_RUNNING = {"max": (F.max, F.greatest), "min": (F.min, F.least), "count": (F.count, lambda inside, before: inside + F.coalesce(before, F.lit(0)))}


def running(df: DataFrame, keys: list[str], order: list[Column | str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds running values: ``columns`` gives for each name ``max``, ``min`` or ``count`` and what it runs over, from
    the first row of ``keys`` (none of them null) in ``order`` to the row itself; nulls are passed over.

    Ranges as in ``numbered``: a key with all the rows is spread, only a value for each range and key is
    added up in one place for each key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = df.withColumns({f"_of_{name}": value for name, (_, value) in columns.items()}).drop(*columns)
    ranged = staged(given.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "running")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy(*keys, "_range").agg(*[_RUNNING[how][0](f"_of_{name}").alias(f"_all_{name}") for name, (how, _) in columns.items()])
    add = {"count": F.sum, "max": F.max, "min": F.min}
    sums = sums.select(*keys, "_range", *[add[how](f"_all_{name}").over(before).alias(f"_before_{name}") for name, (how, _) in columns.items()])
    own = {f"_own_{name}": _RUNNING[how][0](f"_of_{name}").over(inside) for name, (how, _) in columns.items()}
    out = ranged.withColumns(own).join(sums, [*keys, "_range"])
    out = out.withColumns({name: _RUNNING[how][1](F.col(f"_own_{name}"), F.col(f"_before_{name}")) for name, (how, _) in columns.items()})
    return out.drop("_range", *[f"_{part}_{name}" for name in columns for part in ("of", "own", "before")])
