"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier reads the words of a text and their pairs (lower-cased, hashed), its outward form (how
runs of lower case, upper case, digits and other characters follow each other) and its repetition (words
that repeat the one before, distinct words). It is fitted on at most SAMPLE labelled
documents. All labels are then added up by site and by path within the site: a site's
posterior is its labelled share shrunk toward the global share, a path's is its share shrunk
toward its site's, each by a prior strength that the spread between groups of a parent, around
that parent's own share, gives. The
document's evidence and its path's posterior are added as log odds. A labelled document's own
label is left out of the posteriors of its site and path, from all rows of its identifier.

Defined results: a null or empty text has the evidence of an empty document; a very long text is
read whole; a null site or
path is a group of its own; documents without labels in their group get the prior of the
level above; a document with several labels counts with their mean; null labels are left
out; any number of labels of one identifier is averaged; of rows that share a labelled identifier one, the
same in every run, is fitted, and all count for their groups, but none of them for another one; without labels of both kinds the classifier is silent (p = 1/2) and the
prior is 1/2; a quality of exactly 1/2 is kept;
repeated rows are returned as often as they come; an empty table gives an empty one; other
columns are not read, so their names may clash with those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SAMPLE, WIDTH, TERMS, ROUNDS, RIDGE = 8_000, 256, 256, 300, 1e-3
WEAKEST, STRONGEST = 2.0, 1_000.0
#: Places of a feature vector: form pairs, words, pairs of words, repetition, a constant.
PLACES = WIDTH + 2 * TERMS + 4

_FORM = np.arange(256, dtype=np.int64)
_FORM[97:123], _FORM[65:91], _FORM[48:58], _FORM[128:] = 1, 2, 3, 1
_FORM[[32, 9, 10, 11, 12, 13]] = 0


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of form pairs, hashed to WIDTH places, and of words and pairs of words,
    hashed to TERMS places each; repetition; a constant."""
    out = np.zeros(PLACES, np.float32)
    out[-1] = 1
    x = _FORM[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    if len(x) > 1:
        length = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), [len(x)]]))
        runs = x[np.concatenate([[True], x[1:] != x[:-1]])]
        code = runs * 3 + np.minimum(length, 3) - 1
        pairs = (code[:-1] * 1_000_003 + code[1:] * 7_919) % WIDTH if len(code) > 1 else code % WIDTH
        out[:WIDTH] = np.sqrt(np.bincount(pairs, minlength=WIDTH) / len(pairs))
    words = (text or "").lower().split()
    if words:
        again = sum(map(eq, words, islice(words, 1, None))) / len(words)
        out[-4:-1] = again, again**0.5, len(set(words)) / len(words)
        codes = {w: crc32(w.encode("utf-8", "replace")) for w in set(words)}
        code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
        pairs = ((code[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
        for at, x in ((WIDTH, code), (WIDTH + TERMS, pairs)):
            if len(x):
                out[at : at + TERMS] = np.sqrt(np.bincount((x % np.uint64(TERMS)).astype(np.int64), minlength=TERMS) / len(x))
    return out


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    # SAMPLE rows at most, so they may be broadcast to the texts
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), b.column(1), b.column(2)], ["x", "y", "doc_id"])

    kind = labels.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "y", "doc_id").mapInArrow(run, f"x binary, y double, doc_id {kind}")
    # identifiers that repeat give one row, whatever the order
    return rows.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).orderBy("doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of the classifier, by accelerated gradient steps on the bounded sample."""
    rows = _labelled(docs, labels).collect()
    if not rows:
        return np.zeros(PLACES)
    x, y = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64), np.array([r.y for r in rows])
    if y.min() == y.max():
        return np.zeros(PLACES)
    w = ahead = np.zeros(PLACES)
    rate = 4.0 / np.linalg.eigvalsh(x.T @ x)[-1] * len(x)
    for k in range(ROUNDS):
        slope = x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) / len(x) + RIDGE * ahead
        new = ahead - rate * slope
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def evidence(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns and p, the classifier's probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["p double"])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [float(1 / (1 + np.exp(-np.clip(features(t.as_py()) @ shared.value, -30, 30)))) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(at)], pa.array(p, pa.float64())], [*keep, "p"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def _strength(groups: DataFrame, around) -> float:
    """Prior strength of groups (good, n) from the spread of their shares around the parent's,
    beyond what chance gives."""
    chance = around * (1 - around)
    away = F.col("n") * (F.col("good") / F.col("n") - around) ** 2
    row = groups.agg(F.sum(away).alias("spread"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(chance).alias("chances"), F.sum(F.col("n") * chance).alias("chance")).first()
    if not row.n or row.groups < 2:
        return STRONGEST
    between = (row.spread - row.chances) / row.n
    return float(np.clip(row.chance / row.n / between - 1, WEAKEST, STRONGEST)) if between > 0 else STRONGEST


def _repeats(rows: DataFrame) -> DataFrame:
    """How many labelled rows an identifier has in a path and in its host, where it has several in the host."""
    paths = rows.where("y is not null").groupBy("doc_id", "host", "path").agg(F.count(F.lit(1)).alias("_own_path"))
    hosts = paths.groupBy(F.col("doc_id").alias("_rdoc_id"), F.col("host").alias("_rhost")).agg(F.sum("_own_path").alias("_own_host")).where("_own_host > 1")
    each = hosts.join(paths, (F.col("doc_id") == F.col("_rdoc_id")) & F.col("host").eqNullSafe(F.col("_rhost")))
    return written(each.select("_rdoc_id", "_rhost", F.col("path").alias("_rpath"), "_own_host", "_own_path"), "quality-repeats")


def logit(p):
    return F.log(p / (1 - p))


def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, quality, keep)."""
    named = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    rows = written(evidence(named, fit(docs, labels), ["doc_id", "host", "path"]), "quality-rows")
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y")).withColumnRenamed("doc_id", "_marked")
    rows = written(rows.join(marks, F.col("doc_id") == F.col("_marked"), "left").drop("_marked"), "quality-marked")
    paths = written(rows.where("y is not null").groupBy("host", "path").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    good, n = hosts.agg(F.sum("good"), F.sum("n")).first()
    prior = (good + 1) / (n + 2) if n else 0.5
    s_host = _strength(hosts, F.lit(prior))
    hosts = hosts.select(F.col("host").alias("_h"), F.col("good").alias("_hg"), F.col("n").alias("_hn"))
    within = paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).withColumn("around", (F.col("_hg") + s_host * prior) / (F.col("_hn") + s_host))
    s_path = _strength(within, F.col("around"))
    paths = paths.select(F.col("host").alias("_ph"), F.col("path").alias("_pp"), F.col("good").alias("_pg"), F.col("n").alias("_pn"))
    out = rows.join(hosts, F.col("host").eqNullSafe(F.col("_h")), "left").join(paths, F.col("host").eqNullSafe(F.col("_ph")) & F.col("path").eqNullSafe(F.col("_pp")), "left")
    # counts of the group without the labels of the document's own identifier
    there = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in ("doc_id", "host", "path")]
    out = out.join(_repeats(rows), there[0] & there[1] & there[2], "left")
    y, zero = F.coalesce("y", F.lit(0.0)), lambda c: F.coalesce(c, F.lit(0))
    copies = lambda c: F.when(F.col("y").isNotNull(), F.coalesce(c, F.lit(1))).otherwise(0)
    # sums of means may leave a little less than nothing
    shrunk = lambda good, n, own, strength, around: (F.greatest(zero(good) - y * copies(own), F.lit(0.0)) + strength * around) / (zero(n) - copies(own) + strength)
    out = out.withColumn("host_posterior", shrunk("_hg", "_hn", "_own_host", s_host, F.lit(prior)))
    out = out.withColumn("path_posterior", shrunk("_pg", "_pn", "_own_path", s_path, F.col("host_posterior")))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    odds = logit(p) + logit(F.col("path_posterior")) - float(np.log(prior / (1 - prior)))
    quality = 1 / (1 + F.exp(-odds))
    return out.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_posterior", "path_posterior", quality.alias("quality"), (quality >= 0.5).alias("keep"))
