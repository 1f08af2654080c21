"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every shuffled document gets a virtual finish time: the words its source has served up to
and including it, over the source's target. Copies of a document (epochs) queue behind all
of its source's documents. The queue is sorted globally by finish time and truncated where
the total budget is spent.

Defined results: a null text has size 0; a null source is a source of its own, last in the
order; documents of size 0 are returned with taken = 0; repeated rows, and rows that share an
identifier, are separate documents, ordered by size where all else ties; a very long text is
counted whole, and may be the one that the budget cuts; an empty table gives an empty table;
further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hashed, running_totals, written

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, 17


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the total budget.

    The water level L makes sum(min(epochs * size, L * weight)) the total; it is raised by
    re-sharing the excess of capped sources until none is above its cap. Each round is one
    grouped sum of two numbers.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(totals, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "mix-sources")
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", share.alias("weight")), "mix-weights")
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, cap = (total / weight if weight else 0.0), F.col("source_size") * epochs
    while total:
        over = F.col("weight") * F.lit(level) > cap
        held, weights_held = ranked.where(over).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        new = (total - held) / (weight - weights_held)
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    return ranked.select("source", "source_size", target.alias("target")), int(total)


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words of each document in the mix, and
    the columns that ``keep`` names.

    ``taken`` counts repeats and is at most ``epochs`` times the size; the document at which
    the budget ends is taken in part. All sums are exact integers, so reruns agree whatever
    the partitioning.
    """
    sizes = written(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 16).alias("u"),
            *[c.alias(n) for n, c in (keep or {}).items()],
        ),
        "mix-sizes",
    )
    targets, budget = source_targets(sizes, weights, epochs)
    order = [F.col("source").asc_nulls_last(), F.col("u"), F.col("doc_id"), F.col("size")]
    queue = running_totals(sizes, order, {"seen": F.col("size"), "row": F.lit(1)}, "mix-queue", spread_ties=True)
    starts = running_totals(targets, [F.col("source").asc_nulls_last()], {"end": F.col("source_size")}, "mix-starts")
    starts = starts.select(F.col("source").alias("_source"), "source_size", "target", (F.col("end") - F.col("source_size")).alias("start"))
    queue = queue.join(starts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    served = F.col("seen") - F.col("start") + F.col("epoch") * F.col("source_size")
    items = queue.withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(epochs)]))).withColumn(
        "finish", F.when(F.col("target") > 0, served / F.col("target")).otherwise(F.lit(0.0))
    )
    spent = running_totals(items, [F.col("finish"), F.col("u"), F.col("row"), F.col("epoch")], {"spent": F.col("size")}, "mix-finish")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("spent") + F.col("size")))
    return spent.groupBy("row", "doc_id", "source", "size", "source_size", "target", *(keep or ())).agg(F.sum(part).cast("long").alias("taken")).drop("row")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a document appears once for each full
    repeat taken, the last one cut to the words that the budget left.

    Documents are told apart by identifier, source and text; equal ones share their repeats out.
    Texts move to meet what is taken of them.
    """
    text = F.xxhash64("text")
    taken = mix(docs, keep={"_text": text}, **options)
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    # of all documents one at most is cut
    sums = taken.groupBy("doc_id", "source", "_text").agg(F.sum(full).alias("_full"), F.sum(rest).alias("_rest"), F.max("size").alias("_size"), F.count(F.lit(1)).alias("_n"))
    changed = sums.where("_full <> _n or _rest > 0").select(F.struct(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_text", "_full", "_rest", "_size", "_n").alias("c"), hashed("doc_id", "source", "_text").alias("_h"))
    # one row a hash, so that texts are dealt out once, by the hash alone; a row finds its own among those that share it
    changed = written(changed.groupBy("_h").agg(F.collect_list("c").alias("_c")), "mix-changed")
    rows = docs.withColumn("__h", hashed("doc_id", "source", text))
    own = lambda c: c["_id"].eqNullSafe(F.col("doc_id")) & c["_source"].eqNullSafe(F.col("source")) & (c["_text"] == text)
    met = rows.join(changed, F.col("__h") == F.col("_h"), "left").withColumn("__c", F.get(F.filter("_c", own), F.lit(0)))
    met = met.select(*[F.col(f"`{c}`") for c in docs.columns], "__h", *[F.col(f"__c.{c}").alias(c) for c in ("_full", "_rest", "_n")])
    # equal documents: the first ones repeat once more, the first is the one that is cut
    own = [F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])]
    nth = F.row_number().over(Window.partitionBy("__h", "doc_id", "source").orderBy(*own))
    met = met.withColumn("__nth", nth)
    times = F.floor(F.col("_full") / F.col("_n")) + F.when(F.col("__nth") <= F.col("_full") % F.col("_n"), 1).otherwise(0)
    cut = F.when((F.col("__nth") == 1) & (F.col("_rest") > 0), F.array(F.col("_rest"))).otherwise(F.array().cast("array<bigint>"))
    lengths = F.when(F.col("_n").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.concat(F.array_repeat(F.lit(None).cast("long"), times.cast("int")), cut))
    met = met.withColumn("__words", F.explode(lengths))
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("__words").cast("int")), " ")
    met = met.withColumn("text", F.when(F.col("__words").isNotNull(), short).otherwise(F.col("text")))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns])
