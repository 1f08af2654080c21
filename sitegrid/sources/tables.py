"""Reading nested documents and GeoJSON, manifests, snapshots, fingerprints, GeoJSON layers."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import staged

#: Scheme and authority of a path.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
#: Fixed format: the fields of a network document.
NETWORK = """region_id bigint,
  nodes array<struct<node_id: string, lon: double, lat: double, x_mm: bigint, y_mm: bigint>>,
  edges array<struct<edge_id: string, src: string, dst: string, length_mm: bigint, coordinates: array<struct<lon: double, lat: double>>>>,
  cells array<struct<cell_id: string, population: bigint, parcels: bigint, node_id: string, x_mm: bigint, y_mm: bigint, connector_mm: bigint>>"""
FINGERPRINT_BUCKETS = 4096
#: Bytes up to which a file is read as one row. Of a longer one lines are read, and of these pieces of so many bytes.
WHOLE, PIECE = 16 << 20, 4096
#: Names of files that readers of lines decompress; these are read as one row, whatever their size.
_PACKED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$"
_BOM = b"\xef\xbb\xbf"
#: Buckets of a comparison: the sums that travel.
DIFF_BUCKETS = 1 << 14


def read_network(spark: SparkSession, path: str, layout: str = "jsonl") -> dict[str, DataFrame]:
    """nodes, edges and cells of network documents, keyed by region_id.

    ``json`` is one document per file (gzip is transparent, but such a file is one task);
    ``jsonl`` is one per line and splits; ``parquet`` has the same columns.
    """
    reader = spark.read.schema(NETWORK)
    docs = reader.parquet(path) if layout == "parquet" else reader.json(path, multiLine=layout == "json")
    return {name: docs.select("region_id", F.inline(name)) for name in ("nodes", "edges", "cells")}


def read_geojson(spark: SparkSession, path: str, key: str, props: dict[str, str], prefix: str = "", layout: str = "json") -> DataFrame:
    """Features of GeoJSON collections: (cell_id, the named properties, polygon rings).

    ``props`` gives the type of each property; the identifier is ``prefix`` and ``key``'s value.
    ``json`` is one collection per file, ``jsonl`` one per line.
    """
    fields = ", ".join(f"`{n}`: {t}" for n, t in props.items())
    schema = f"features array<struct<properties: struct<{fields}>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    f = spark.read.schema(schema).json(path, multiLine=layout == "json").select(F.explode("features").alias("f"))
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return f.select(F.concat(F.lit(prefix), F.col(f"f.properties.{key}").cast("string")).alias("cell_id"), *[F.col(f"f.properties.{n}").alias(n) for n in props if n != key], F.transform("f.geometry.coordinates", ring).alias("polygon"))


def source_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256): a row for each source that the pattern ``path`` matches, by its own name. A file has its
    SHA-256; a folder of files, as Spark writes a table, that of its files' places in it and SHA-256s, by place."""
    bare = re.sub(_SCHEME, "", path)
    depth = len([p for p in (bare if path.startswith("/") or bare != path else f"{os.getcwd()}/{path}").split("/") if p])
    parts = F.filter(F.split(F.regexp_replace("path", _SCHEME, ""), "/"), lambda p: p != "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = files.where(F.col("length") <= WHOLE).select("path", F.sha2("content", 256).alias("own"))
    large, packed = files.where(F.col("length") > WHOLE).select("path", "length"), F.lower("path").rlike(_PACKED)
    if not large.where(~packed).isEmpty():
        own = own.unionByName(_large_digests(spark, path))
    if not large.where(packed).isEmpty():
        own = own.unionByName(files.where((F.col("length") > WHOLE) & F.lower("_metadata.file_name").rlike(_PACKED)).select("path", F.sha2("content", 256).alias("own")))
    # staged: what reads the digests does not read the files again
    files = staged(own.select(F.element_at(parts, depth).alias("name"), F.array_join(F.slice(parts, depth + 1, F.size(parts)), "/").alias("place"), "own"), "source-digests")
    both = files.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("place", "own"))).alias("l"))
    listed = F.array_join(F.transform("l", lambda f: F.concat(f["place"], F.lit(":"), f["own"])), "\n")
    return both.select("name", F.when(F.element_at("l", 1)["place"] == "", F.element_at("l", 1)["own"]).otherwise(F.sha2(listed, 256)).alias("sha256"))


def _large_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, own): the SHA-256s of the files longer than WHOLE. Tasks read lines, whatever the bytes mean, and deal their pieces
    out by file; there they are sorted by place and hashed one after another, so no task holds a file, only its longest line."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("v"), F.col("_metadata.file_name").alias("_n"),
    )
    lines = lines.where((F.col("size") > WHOLE) & ~F.lower("_n").rlike(_PACKED))
    last = F.floor(F.greatest(F.length("v") - 1, F.lit(0)) / F.lit(PIECE)).cast("int")
    pieces = lines.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    bytes_ = F.substring("v", F.col("piece") * PIECE + 1, F.lit(PIECE))
    pieces = pieces.select("path", "size", "start", "line", "piece", F.when(F.col("piece") == last, F.concat(bytes_, F.lit(b"\n"))).otherwise(bytes_).alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "path").sortWithinPartitions("path", "start", "line", "piece").select("path", "size", "v")
    found = dealt.mapInArrow(_hashed, "path string, own string")
    # paths of this kind are encoded as in an URL, those of whole files are not
    return found.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), "own")


def _hashed(batches):
    """Digests of files whose bytes come in order, each line with its end. Whether the last line has one, and whether a byte order
    mark that readers of lines skip comes first, is known by the size."""
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc

    now, size, total, held, sums = None, 0, 0, b"", ()

    def ended():
        for sum_, more in zip(sums, (0, len(_BOM)), strict=True):
            if total + more == size:
                sum_.update(held)
            elif total + more != size + 1:
                continue
            return pa.RecordBatch.from_pydict({"path": [now], "own": [sum_.hexdigest()]})
        raise ValueError(f"{now}: {size} bytes, but its lines have {total}")

    for batch in batches:
        runs, begin = pc.run_end_encode(batch.column("path")), 0
        for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if path != now:
                if now is not None:
                    yield ended()
                now, size, total, held, sums = path, batch.column("size")[begin].as_py(), 0, b"", (hashlib.sha256(), hashlib.sha256(_BOM))
            rows = batch.column("v").slice(begin, end - begin)
            _, places, data = rows.buffers()
            at = memoryview(places).cast("i")[rows.offset : rows.offset + len(rows) + 1]
            some = memoryview(data)[at[0] : at[-1]] if data is not None else b""
            for sum_ in sums if len(some) else ():
                sum_.update(held)
                sum_.update(some[:-1])
            total, held, begin = total + len(some), bytes(some[-1:]) or held, end
    if now is not None:
        yield ended()


def verify_sources(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, expected, found): sources under ``path`` whose SHA-256 is not the manifest's, or that
    only one side has. ``manifest(name, sha256)``, as ``source_digests`` gives them."""
    both = manifest.select("name", F.col("sha256").alias("expected")).join(source_digests(spark, path).withColumnRenamed("sha256", "found"), "name", "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet, partitioned by region.

    A region costs a file, however few its rows, so the tasks are as many as the session shuffles into and not as few
    as the bytes need. Rows are dealt out by ranges of regions, and of their hashes within one: a small region is one file
    (two where a range ends), and a region with all the rows is written by all tasks.
    """
    for name, df in tables.items():
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        df.repartitionByRange(parts, "region_id", row).write.partitionBy("region_id").mode("overwrite").parquet(f"{path}/{name}")


def fingerprint(df: DataFrame, prefix: str = "parcel-") -> DataFrame:
    """(snapshot_id, rows): a content address that depends on neither row nor column order.

    Rows are hashed and hashes put into a fixed number of buckets; a bucket's content is sums of eight 48-bit numbers
    drawn from each row's SHA-256, as whole numbers, so repeated rows count. Tasks add up their own rows: only sums of
    buckets travel, no hash of a row does. The buckets' sums are hashed in order.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    drawn = [F.xxhash64(F.lit(i), "h").alias(f"d{i}") for i in range(8)]
    rows = df.select(row.alias("h")).select(F.pmod(F.xxhash64("h"), F.lit(FINGERPRINT_BUCKETS)).alias("b"), *drawn)
    # a number is added up in halves of 24 bits, which 2^39 rows of one bucket do not overflow
    halves = [F.sum(F.shiftright(f"d{i}", by).bitwiseAND(F.lit((1 << 24) - 1))).cast("string") for i in range(8) for by in (40, 16)]
    buckets = rows.groupBy("b").agg(F.sha2(F.concat_ws(",", *halves), 256).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = buckets.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "s"))), lambda x: x["s"]), ","), 256).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return whole.select(F.concat(F.lit(prefix), F.substring("s", 1, 24)).alias("snapshot_id"), "rows")


def _buckets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` with the bucket of each row, and (bucket, n, s, t): a bucket's rows and the sums of two hashes of
    them, which stand for its content."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    # hashes skip nulls: which columns are null is hashed too, and nested ones as text
    nested = [F.to_json(F.struct(F.col(f"`{f.name}`")), {"ignoreNullFields": "false"}) for f in df.schema if f.dataType.typeName() in ("array", "struct")]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    one, two = (F.xxhash64(F.lit(seed), nulls, *columns, *nested) for seed in (1, 2))
    rows = df.withColumn("_h", one).withColumn("_bucket", F.pmod("_h", F.lit(DIFF_BUCKETS)))
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    return rows.drop("_h"), rows.withColumn("_g", two).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), total(F.col("_h")).alias("s"), total(F.col("_g")).alias("t"))


def diff_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has more of them, with ``side``.

    Both sides are first compared by buckets of rows, of which sums travel; only rows of
    buckets that differ are compared themselves, so equal snapshots move no row.
    """
    kinds = a.union(b).schema  # columns are matched by place, as their wider type
    same = lambda df: df.toDF(*kinds.names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds])
    (left, mine), (right, theirs) = _buckets(same(a)), _buckets(same(b))
    both = mine.join(theirs.withColumnsRenamed({c: f"_{c}" for c in "nst"}), "_bucket", "full")
    # no more buckets than there are, so they may be broadcast
    unlike = F.broadcast(staged(both.where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("s").eqNullSafe(F.col("_s")) & F.col("t").eqNullSafe(F.col("_t")))).select("_bucket"), "diff-buckets"))
    left, right = (t.join(unlike, "_bucket", "left_semi").select(*[F.col(f"`{c}`") for c in kinds.names]) for t in (left, right))
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def feature(geometry: Column, props: list[str]) -> Column:
    """One GeoJSON feature as text; ``geometry`` is a struct of type and coordinates."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry")))


def _points(line: Column) -> Column:
    return F.transform(line, lambda p: F.array(p["lon"], p["lat"]))


def to_geojson(df: DataFrame, kind: str, geometry: str, props: list[str]) -> DataFrame:
    """(region_id, feature) from a column of points (LineString) or of rings (Polygon)."""
    at = F.transform(F.col(geometry), _points) if kind == "Polygon" else _points(F.col(geometry))
    return df.select("region_id", feature(F.struct(F.lit(kind).alias("type"), at.alias("coordinates")), props).alias("feature"))


def street_layer(edges: DataFrame, twin: str = "-r") -> DataFrame:
    """Streets once: edges without the reverse twins, whose ids end in ``twin``."""
    return to_geojson(edges.where(~F.col("edge_id").endswith(twin)), "LineString", "coordinates", ["edge_id"])


def write_geojson(features: DataFrame, path: str) -> None:
    """Features as text lines, a folder for each region."""
    features.select("region_id", F.col("feature").alias("value")).write.partitionBy("region_id").mode("overwrite").text(path)
