"""The whole n-gram Jaccard join: every link between different sets, with its overlap.

``jaccard_components`` looks for links until nothing more can be connected; here all are found. Equal
sets are one class, named by its smallest doc_id, and each class takes part once. Two classes over the
threshold share a shingle of their rare-first prefixes, so the members of each prefix shingle meet in a
grid of blocks of BLOCK; the length and positional filters hold before a pair leaves its task, each pair
is tried once, with the suffix filter, and what passes is counted on 128-bit digests of the word sequences
themselves. Copies are never expanded into pairs, but different texts that are all alike are: k of
them have k(k - 1)/2 links, and that many rows are the result.

Defined results: null texts, empty texts and texts without words are classes of their own without links; a
null doc_id has no class and no links; very long texts are read whole; of rows that share a doc_id each has
the class of its own set, and a link of one of the sets is a link of the doc_id, with the larger overlap share
if there are two; an empty table gives empty ones; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import bloom_of, without, written

DIGEST = 16


def members(text: bytes, words: int) -> bytes:
    """The distinct shingles of a text as ascending digests, one after another."""
    w = text.lower().split()
    spans = [w[i : i + words] for i in range(len(w) - words + 1)] or ([w] if w else [])
    return b"".join(sorted({blake2b(b" ".join(s), digest_size=DIGEST).digest() for s in spans}))


def exact_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(doc, members) of the ``wanted(doc)`` documents and a few more, which the joins that follow drop."""
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(bloom.value.has(np.asarray(batch.column(0)))))
            for i in range(batch.num_rows):
                sets = [members(batch.column(1)[i].as_py() or b"", words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array(sets, pa.binary())], ["doc", "members"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc bigint, members binary")


def all_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """(x, y), each once: the members of ``posted(token, doc, at)`` that share a token and pass the filters."""
    sizes = written(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "links-runs")
    own = posted.join(sizes, "token").withColumn("blocks", F.ceil(F.col("n") / jaccard.BLOCK).cast("int"))
    own = own.withColumn("place", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    right = own.select("token", "doc", "at", F.explode(F.sequence(F.lit(0), "place")).alias("row"), F.col("place").alias("col"))
    left = own.select("token", F.col("doc").alias("_doc"), F.col("at").alias("_at"), F.col("place").alias("row"), F.explode(F.sequence("place", F.col("blocks") - 1)).alias("col"))
    once = (F.col("row") < F.col("col")) | (F.col("_doc") < F.col("doc"))
    met = left.join(right, ["token", "row", "col"]).where(once & (F.col("_doc") != F.col("doc")) & jaccard._fit(F.col("at"), F.col("_at"), percent))
    return met.select(F.least("doc", "_doc").alias("x"), F.greatest("doc", "_doc").alias("y")).distinct()


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap, total) of the ``pairs(a, b)`` whose members reach the threshold; total is the union's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, total = [], []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), f"S{DIGEST}") for v in (left, right))
                both.append(len(np.intersect1d(a, b, assume_unique=True)))
                total.append(len(a) + len(b) - both[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "overlap", "total"])

    left = sets.select(F.col("doc").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("doc").alias("b"), F.col("members").alias("right"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint, overlap bigint, total bigint")
    best = found.where(F.col("overlap") * 100 >= F.col("total") * percent).groupBy("a", "b").agg(F.max(F.struct(F.col("overlap") / F.col("total"), "overlap", "total")).alias("m"))
    return best.select("a", "b", "m.overlap", "m.total")


def similarity_join(docs: DataFrame, words: int = jaccard.WORDS, percent: int = jaccard.PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of ``docs(doc_id, text)``.

    ``classes``: doc_id, class_id, n_shingles and n_links, the number of other documents that a document is
    linked to, copies among them; a row for each document. ``links``: a < b (classes), overlap, total and
    jaccard; a row for each pair of classes that reaches ``percent``.
    """
    spark, bits = docs.sparkSession, jaccard.sketch_bits(docs.count())
    profile = written(jaccard.profiles(docs, words, bits), "links-profile")
    rows = profile.where("chunk is null").select("doc_id", "n", "k1", "k2")
    levels = spark.sparkContext.broadcast(jaccard._levels(profile.where("chunk is not null").select("chunk", "body"), bits))
    same = rows.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    same = written(same.where("copies > 1"), "links-same")
    known = F.col("doc_id").isNotNull()
    named = rows.join(same, ["n", "k1", "k2"], "left").select(
        "doc_id", F.when(known, F.coalesce("first", "doc_id")).alias("class_id"), F.col("n").alias("n_shingles"), F.coalesce(F.when(known, F.col("copies")), F.lit(1)).alias("copies")
    )
    named = written(named, "links-named")

    # a doc_id goes where every one of its rows has a copy with a smaller one
    copies = named.groupBy("doc_id").agg(F.max(F.col("class_id") == F.col("doc_id")).alias("own")).where("not own").select(F.col("doc_id").alias("__gone"))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    posted = written(jaccard.prefixes(without(one, ["__gone"], copies, [F.col("doc_id")]), levels, words, percent, bits), "links-posted")
    pairs = written(all_pairs(posted, percent), "links-pairs")
    likely = written(jaccard.verified(pairs, jaccard.wanted_sets(one, pairs, words), percent).distinct(), "links-likely")
    wanted = written(likely.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "links-wanted")
    links = written(measured(likely, written(exact_sets(one, wanted, words), "links-sets"), percent), "links")

    ends = links.select(F.col("a").alias("class_id"), F.col("b").alias("_to")).unionByName(links.select(F.col("b").alias("class_id"), F.col("a").alias("_to")))
    sizes = same.groupBy(F.col("first").alias("_to")).agg(F.max("copies").alias("_n"))
    linked = ends.join(sizes, "_to", "left").groupBy("class_id").agg(F.sum(F.coalesce("_n", F.lit(1))).alias("_links"))
    classes = named.join(linked, "class_id", "left")
    classes = classes.select("doc_id", "class_id", "n_shingles", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return classes, links.withColumn("jaccard", F.col("overlap") / F.col("total"))
