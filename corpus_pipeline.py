"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokenising.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet in
the shared folder and read again as the next stage's documents. All but the last return the columns
of documents, whatever further ones there are and whatever their names.

Defined results: documents with null or empty texts, or texts without letters, go in the first
stage; very long texts are handled whole; a null doc_id loses ties in deduplication, is never
linked to near copies and is mixed like any other; repeated rows are copies, of which one stays;
ties go to the smaller doc_id, between sources and documents of the mix as in its operator;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegrid.llm import bpe, jaccard, langid, mixing, streamdedup
from sitegrid.llm.common import table, written
from sitegrid.llm.queries import TOKENIZER

#: Near copies of the pipeline; op8's contract has its own, stricter values.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Rows that Spark hands to Python at a time, at most: whole texts, so few of them.
HANDED = 1_000


def _handed(spark: SparkSession) -> None:
    """Bounds the batches of texts that go to Python, where the session allows larger ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= HANDED:
        spark.conf.set(key, HANDED)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: those without letters, and those far from every profile."""
    _handed(spark)
    return langid.recognised(docs, langid.trained(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return streamdedup.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, the one with the smallest doc_id stays."""
    _handed(spark)
    return jaccard.one_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the sources' target weights."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts and of what they decode to."""
    _handed(spark)
    return bpe.digests(bpe.round_trip(docs, TOKENIZER, keep=["doc_id"]))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", tokenise),
]

#: Shuffled hashing order apart, SQL has no byte-pair encoding; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
