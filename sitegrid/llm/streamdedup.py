"""Exact deduplication with keyed streaming state.

A narrow row of every document (digest of the normalised text, identifier, content locator) is
read as a stream and folded into one state entry for each digest. A locator is the file and the
place in it where the document's bytes lie. The state lives in RocksDB on
the executors' disks, is committed to the shared folder, and has no watermark, so entries
never expire: a later run with the same ``store`` finds copies of what earlier ones saw. Spark
folds a batch's rows map-side first, so a digest with very many copies is no hot key.

A digest that was hit is not believed: the full normalised bytes of its documents are fetched by
their locators and compared, and digests that stand for different texts are split by the bytes
themselves. Only texts of hits move; equal ones fold before they do.

Defined results: a null text is an empty one; all empty texts are copies of each other; a very
long text is digested and compared whole; of
rows that tie in length, the smaller doc_id and then the earlier row stays; a null doc_id
loses every tie; repeated rows are copies; an empty table gives an empty one; other columns
are not read, so their names may clash with those of the result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, bloom_of, fresh_path, hashed, may_be, shuffle_partitions, without, written

BATCH_BYTES = 16 << 30


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{WHITE}]+", "")


def sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def fold(stream: DataFrame) -> DataFrame:
    """digest -> the best row so far (longest, smallest id, first row; with its locator) and the
    number of rows. Works on a stream as on a table."""
    best = F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"), "file", "place")
    return stream.groupBy("digest").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n"))


def run_stream(spark: SparkSession, source: str, schema, checkpoint: str, sink: str) -> None:
    """Fold all files under ``source`` that the checkpoint has not seen; changed entries go to ``sink``."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", shuffle_partitions(spark))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    # many small stores: no preallocated logs
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    session.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    rows = session.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    query = fold(rows).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


#: Content locator of a row of a table of files.
LOCATOR = ["file", "place"]


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, place) of a table that reads files as they lie."""
    return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def reads_files(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` has a place of its own in the files that it reads."""
    try:
        places = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return False
    return places.groupBy(*LOCATOR).count().where("count > 1").isEmpty()


def _points(text: str = "text") -> Column:
    return F.coalesce(F.char_length(text), F.lit(0)).cast("long")


def _runs(spark: SparkSession, store: str) -> int:
    """How many runs a store has seen."""
    try:
        return (spark.read.parquet(f"{store}/rows").agg(F.max("run")).first()[0] or 0) + 1
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def deduplicate(docs: DataFrame, digest=sha256, store: str | None = None, as_files: bool | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, file, place), one row for each row of ``docs``.

    ``store`` is a folder in the shared file system that keeps the state: with the one of earlier
    runs, the rows of ``docs`` are judged against all rows seen so far, whose files must still
    be there. ``as_files`` says that ``docs`` reads files as they lie, so that its rows have
    locators; any other table is written first.
    """
    spark = docs.sparkSession
    if not as_files:
        docs = written(docs.select(F.col("doc_id"), F.col("text")), "dedup-docs")
    base = store or fresh_path(spark, "dedup")
    run = _runs(spark, base) if store else 0
    # rows of later runs follow those of earlier ones
    row = F.lit(run).cast("long") * (1 << 52) + F.monotonically_increasing_id().bitwiseAND((1 << 52) - 1)
    narrow = located(docs).select("doc_id", digest(normalised()).alias("digest"), _points().alias("points"), *LOCATOR, row.alias("row"), F.lit(run).alias("run"))
    narrow.write.mode("append").parquet(f"{base}/rows")
    every = spark.read.schema(narrow.schema).parquet(f"{base}/rows")
    rows = every.where(F.col("run") == run)
    out = ["doc_id", "keep_id", "group_size", "kept", "digest", *LOCATOR]
    if rows.isEmpty():
        return rows.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).select(*out)
    run_stream(spark, f"{base}/rows", narrow.schema, f"{base}/checkpoint", f"{base}/state")
    # the last update of an entry has its largest count
    state = spark.read.parquet(f"{base}/state").groupBy("digest").agg(F.max(F.struct("n", "best")).alias("s")).select("digest", "s.n", "s.best")
    state = written(state, "dedup-state")
    hit = state.where("n > 1").select("digest")
    hits = every.join(hit.join(rows.select("digest"), "digest", "left_semi") if run else hit, "digest", "left_semi")
    split = split_by_bytes(fetched(hits) if run else located(docs), hits, digest)
    won = {"keep_id": F.bitwise_not("best.id"), "group_size": F.col("n"), "kept": F.bitwise_not("best.row") == F.col("row")}
    best = rows.join(state, "digest").withColumns(won)
    if split is None:
        return best.select(*out)
    texts, clash = split
    # the rows of a digest that stands for several texts, told apart by their bytes
    found = texts.select("doc_id", "digest", "bytes", _points().alias("points"), *LOCATOR).join(every.select(*LOCATOR, "row", "run"), LOCATOR)
    found = written(found, "dedup-split")
    groups = found.groupBy("digest", "bytes").agg(F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))).alias("best"), F.count(F.lit(1)).alias("n"))
    told = found.where(F.col("run") == run).join(groups, ["digest", "bytes"]).withColumns(won)
    return best.join(clash, "digest", "left_anti").select(*out).unionByName(told.select(*out))


def fetched(rows: DataFrame) -> DataFrame:
    """(doc_id, text, file, place) of the files that ``rows`` of a store are located in."""
    files = [r.file for r in rows.select("file").distinct().toLocalIterator()]
    return located(rows.sparkSession.read.parquet(*files)) if files else rows.select("doc_id", F.lit("").alias("text"), *LOCATOR).limit(0)


def split_by_bytes(texts: DataFrame, hits: DataFrame, digest) -> tuple[DataFrame, DataFrame] | None:
    """Compare the full texts behind digests that were hit, found by their locators; None if each
    stands for one text, else (their texts with digest and bytes, the digests that do not)."""
    keys = written(hits.select(hashed(*LOCATOR).alias("key")), "dedup-hits")
    if keys.isEmpty():
        return None
    # the filter lets a few other rows through: they are alone with their digests
    fetched_ = texts.where(may_be(bloom_of(keys), hashed(*LOCATOR), texts.sparkSession)).withColumn("bytes", normalised())
    fetched_ = fetched_.withColumn("digest", digest(F.col("bytes")))
    # equal texts fold to one row before they move; two for a digest are a collision
    clash = written(fetched_.groupBy("digest", "bytes").count().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-clash")
    return None if clash.isEmpty() else (fetched_.join(clash, "digest", "left_semi"), clash)


def without_copies(docs: DataFrame, as_files: bool | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts. The rows that go are found again by
    their locators; the others stay where they are."""
    if not (reads_files(docs) if as_files is None else as_files):
        docs = written(docs, "dedup-docs")
    gone = deduplicate(docs, as_files=True).where("not kept").select(*LOCATOR)
    at = {"__file": F.col("_metadata.file_path"), "__place": F.col("_metadata.row_index")}
    return without(docs.withColumns(at), LOCATOR, gone, [F.col("__file"), F.col("__place")]).select(*[F.col(f"`{c}`") for c in docs.columns])
