"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (one to three letters,
words padded with a blank), by rank. A document's own list is compared with each: every
n-gram adds the distance between its two ranks, or the longest distance where the profile
lacks it. The language with the least sum wins.

Training counts every n-gram of every training text: tasks add them up by language, Spark sums
them, and only the top ranks of each language are gathered (PROFILE * languages rows).

Defined results: a text that is null or has no letter is ``und`` with score 0; a very long text
is read whole; ties between languages go to the one that comes first, ties between n-grams of
one count to the smaller code; rows with a null language or text do not train; without any
profile every document is ``und``; repeated rows count and are returned as often as they
come; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE, SALTS, UNKNOWN = 400, 8, "und"
#: A score below this is no learned language's: most of the n-grams are in no profile, or far off.
LEAST_SCORE = 0.2
HOLD = 3_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank."""
    table = np.full(0x110000, 32, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of ``text``, one to three letters; 21 bits a letter."""
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = x == 32
    x = np.concatenate([[32], x[~(blank & np.concatenate([[True], blank[:-1]]))], [32]])
    if len(x) <= 2:
        return np.zeros(0, np.int64)
    if x[-2] == 32:
        x = x[:-1]
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.concatenate([x[x != 32], two, three])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, commonest first, equal counts by code."""
    kinds, counts = np.unique(codes, return_counts=True)
    if len(kinds) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        kinds, counts = kinds[counts >= least], counts[counts >= least]
    return kinds[np.argsort(-counts, kind="stable")][:size]


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n) of ``training(lang, text)``, added up inside each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def settle():
            for lang, parts in held.items():
                kinds, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in totals:
                    kinds, at = np.unique(np.concatenate([totals[lang][0], kinds]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([totals[lang][1], counts])).astype(np.int64)
                totals[lang] = (kinds, counts)
            held.clear()

        def flush():
            for lang, (kinds, counts) in totals.items():
                for i in range(0, len(kinds), 50_000):
                    n = len(kinds[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(kinds[i : i + n]), pa.array(counts[i : i + n].astype(np.int64))], ["lang", "gram", "n"])
            totals.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                codes = grams(text.as_py())
                held.setdefault(lang.as_py(), []).append(codes)
                size += len(codes)
                if size > HOLD:
                    settle()
                    size = 0
                    if sum(len(k) for k, _ in totals.values()) > HOLD:
                        yield from flush()
        settle()
        yield from flush()

    rows = training.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(training: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """language -> its top n-gram codes. What reaches the driver has at most size * SALTS rows a language."""
    top = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    rows = gram_counts(training).withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    rows = rows.withColumn("r", F.row_number().over(top)).where(F.col("r") <= size).select("lang", "gram", "n").collect()
    found: dict[str, list] = {}
    for r in rows:
        found.setdefault(r.lang, []).append((-r.n, r.gram))
    return {lang: np.array([g for _, g in sorted(v)[:size]], np.int64) for lang, v in sorted(found.items())}


class Model:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.languages = size, list(profiles)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int64)
        for k, codes in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.codes, codes), k] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - its distance over the longest possible one."""
        own = ranked(grams(text), self.size) if text else ()
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), self.size).sum(0)
        best = int(apart.argmin())
        return self.languages[best], 1.0 - float(apart[best]) / (self.size * len(own))


def identify(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns and, under ``names``, the language and the score; they replace columns of
    the same names. Only ``text`` is read by the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PROFILE codes a language
    keep = [c for c in keep if c.lower() not in {n.lower() for n in names}]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{names[0]} string", f"{names[1]} double"])
    # a text that is kept is sent once
    at = keep.index("text") if "text" in keep else len(keep)
    sent = [F.col(f"`{c}`") for c in keep] + ([] if at < len(keep) else [F.col("text").alias("__text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [*keep, *names])

    return docs.select(*sent).mapInArrow(run, schema)


def held_out() -> Column:
    """Whether a document stays out of training; a null doc_id does."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(True))


def trained(docs: DataFrame, size: int = PROFILE) -> Model:
    return Model(train(docs.where(~held_out()).select("lang", "text"), size), size)


def recognised(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without those in no learned language: texts without letters (``und``), and texts
    that are far from every profile."""
    seen = identify(docs, model, docs.columns, ("__lang_pred", "__score"))
    return seen.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
