"""Helpers shared by the corpus operators: shared-folder tables, running totals, key filters, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a regular-expression class body.
WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local master may fall back to a temporary folder: there driver and executors
    are one process. On a cluster without ``spark.checkpoint.dir`` this raises.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(place)
    return place


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, order: list, values: dict, label: str = "ranged", spread_ties: bool = False) -> DataFrame:
    """Inclusive running sums over a global sort, without a one-task window.

    Rows are range-partitioned on ``order``, each range is summed, the few range sums (one per
    partition) are accumulated and added to the running sums inside each range. ``values`` maps
    new columns to the expressions that are summed. ``order`` should end in tie-breakers that
    make it total. With ``spread_ties`` rows that tie all the same are spread over ranges by
    their place in the scan, so no number of equal keys lands in one task; ``df`` must then
    read files, whose places a task that is run again finds unchanged.
    """
    spark = df.sparkSession
    tie = F.monotonically_increasing_id() if spread_ties else F.lit(0).cast("long")
    ranged = written(
        df.select("*", *[F.coalesce(v, F.lit(0)).cast("long").alias(f"_v_{k}") for k, v in values.items()], tie.alias("_tie"))
        .repartitionByRange(shuffle_partitions(spark), *order, "_tie")
        .withColumn("_range", F.spark_partition_id()),
        label,
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
        .select("_range", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    )
    inside = Window.partitionBy("_range").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    # one row for each range partition: a bound that the configuration sets, so it may be broadcast
    return (
        ranged.join(F.broadcast(starts), "_range")
        .select(*df.columns, *[(F.sum(f"_v_{k}").over(inside) + F.col(f"_b_{k}")).alias(k) for k in values])
    )


# -- key filters --------------------------------------------------------------------------

#: Bits of a Bloom filter: BITS_A_KEY for each key, at most MOST_BITS (what is broadcast, in bits).
BITS_A_KEY, MOST_BITS, CHUNK = 10, 28, 1 << 16
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def merged_chunks(parts: DataFrame, unite, finish=None, dtype=np.uint32) -> dict[int, bytes]:
    """Chunks of fixed-size tables that tasks emitted as (chunk, body), united chunk by chunk.

    ``unite(held, x)`` folds one more body, as an array of ``dtype``, into the chunk held so far
    (``None`` at first) and ``finish`` turns the result into what is sent. A chunk is united by one task as its bodies
    stream by; the whole result has the size of one table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        out = lambda at, held: pa.RecordBatch.from_pydict({"chunk": [at], "body": [(finish(held) if finish else held).tobytes()]})
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(b.as_buffer(), dtype)
                if i != at and at is not None:
                    yield out(at, held)
                    held = None
                at, held = i, unite(held, x)
        if at is not None:
            yield out(at, held)

    rows = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk bigint, body binary").collect()
    return {r.chunk: bytes(r.body) for r in rows}


class Bloom:
    """Membership of 64-bit keys, sized for their number: no key that was added is missed, others
    pass at about one in a hundred, or more where MOST_BITS is too small for the keys."""

    def __init__(self, table: np.ndarray):
        self.table, self.last = table, _U(len(table) * 32 - 1)

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        one = mixed(keys.astype(np.int64).view(np.uint64) + _U(0x5851F42D4C957F2D))
        two = mixed(one) | _U(1)
        for k in range(4):
            yield ((one + _U(k) * two) & self.last).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.table, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
        return out


def bloom_of(keys: DataFrame) -> Bloom:
    """The filter of a table with one bigint column. Tasks fill bits, Spark unites them; what
    reaches the driver is the filter, not the keys."""
    n = keys.count()
    bits = min(MOST_BITS, max(10, int(BITS_A_KEY * n).bit_length()))
    words = (1 << bits) // 32

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(np.zeros(words, np.uint32))
        for batch in batches:
            own.add(np.asarray(batch.column(0).drop_null()))
        for k, i in enumerate(range(0, words, CHUNK)):
            if own.table[i : i + CHUNK].any():
                yield pa.RecordBatch.from_pydict({"chunk": [k], "body": [own.table[i : i + CHUNK].tobytes()]})

    table = np.zeros(words, np.uint32)
    for k, body in merged_chunks(keys.mapInArrow(fill, "chunk bigint, body binary"), lambda held, x: x.copy() if held is None else held | x).items():
        x = np.frombuffer(body, np.uint32)
        table[k * CHUNK : k * CHUNK + len(x)] = x
    return Bloom(table)


def may_be(bloom: Bloom, key: Column, spark: SparkSession) -> Column:
    """Whether a bigint key may be in the filter. Only the key goes to Python."""
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(keys.to_numpy()))

    return test(key)


def hashed(*keys: Column | str) -> Column:
    """A bigint for keys of any types; nulls count."""
    return F.xxhash64(*keys)


def without(df: DataFrame, names: list[str], gone: DataFrame, at: list[Column] | None = None) -> DataFrame:
    """``df`` without the rows whose keys are in ``gone(names)``; null keys are never in it.

    A filter sized for ``gone`` travels to the rows; those that are surely not in it stay where
    they are, and only the others move to an exact anti-join. ``at`` are the keys' expressions
    over ``df`` where they are not columns of the same names.
    """
    at = at or [F.col(f"`{n}`") for n in names]
    keys = written(gone.select(*names, hashed(*names).alias("_h")), "gone")
    maybe = may_be(bloom_of(keys.select("_h")), hashed(*at), df.sparkSession)
    rows = df.withColumns({"__maybe": maybe} | {f"__k{i}": c for i, c in enumerate(at)})
    same = keys.select(*[F.col(n).alias(f"__g{i}") for i, n in enumerate(names)])
    cond = F.lit(True)
    for i in range(len(names)):
        cond = cond & (F.col(f"__k{i}") == F.col(f"__g{i}"))
    left = rows.where("__maybe").join(same, cond, "left_anti")
    return rows.where("not __maybe").unionByName(left).select(*[F.col(f"`{c}`") for c in df.columns])


def connected_components(links: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component = its smallest node.

    Alternates large-star and small-star contraction, so the number of rounds grows with the
    logarithm of the longest path, and a node with very many links is pre-aggregated by a
    map-side minimum before any shuffle. Each round is a written table.
    """
    edges = written(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        label,
    )
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour points to the smallest one
        big = written(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        # small star: every neighbour that is not larger, and the node itself, point to the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            big.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        new = written(small, label)
        # stars: no centre has a centre of its own
        if new.join(new.select(F.col("u").alias("w")), new.v == F.col("w"), "left_semi").isEmpty() and not _doubled(new):
            edges = new
            break
        edges = new
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _doubled(edges: DataFrame) -> bool:
    """Whether some node points to more than one centre."""
    return not edges.groupBy("u").count().where("count > 1").isEmpty()
