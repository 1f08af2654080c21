"""Phrase collocation mining over a weighted de Bruijn graph of words.

1. A first pass counts pairs and triples of neighbouring words in a sketch of bounded size that never
   counts too little. No phrase of ``least`` occurrences holds a pair or triple that has fewer. A
   crowded sketch rules out less and changes no result.
2. A second pass emits for each place of a piece the longest gram that begins there, up to LONGEST
   words, and ends with the piece or before what the sketch rules out. Grams of LONGEST words are
   the edges of the graph, shorter ones are places where the flow stops: piece ends, above all. Tasks sum
   equal ones, then Spark does. An edge leads from its first LONGEST - 1 words to its last ones,
   its weight is its number of occurrences.
3. Paths through nodes with one edge in and one out, of the same weight, are compacted: a junction
   that comes before both neighbouring ones by hash joins its two paths, round by round, until a
   round finds less than a SLOW-th of all paths to join. A path has one weight for all of its edges.
4. Shorter counts follow from the flow: a gram occurs as often as the grams of one more word that
   begin with it, and once more for each place where the flow stops with it.
5. Candidates meet the counts of their parts in joins; the score of each cut is exact decimal
   arithmetic. A phrase is dropped for one that holds it and is as frequent; such a phrase of more
   words exists only if one of one more word does, so those are what is compared.

Defined results: a null text is empty and has no words; a null lang is ``und``; a text of any length
is cut at piece ends into slices of about SLICE bytes, so only the longest piece is ever held whole;
ties go by the stated order, down to the phrase's bytes; repeated rows count as often as they occur;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import merged_chunks, mixed, written

LONGEST, LEAST, SHOWN = 5, 100, 2000
#: Counters of the sketch: COUNTERS_A_DOC for each document, 2**bits in all, within these bounds.
COUNTERS_A_DOC, LEAST_BITS, MOST_BITS, CHUNK = 128, 16, 27, 1 << 16
SLICE = 1_000_000
#: Compaction ends at a round that joins less than a SLOW-th of the paths.
SLOW = 20
PIECE_END = b".,;:!?\n\x0b\x0c\r"
_U = np.uint64


# -- words of whole Arrow slices ----------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: in a word; ends a piece; in lower case; a random value."""
    ends = np.zeros(256, bool)
    ends[list(PIECE_END)] = True
    word = ~ends
    word[[0x20, 0x09]] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return word, ends, lower, np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 2**64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Slice:
    """Words of some bytes: where they are, which begin a piece, their hashes.

    ``body`` is the bytes in lower case, every word followed by one blank, so that words in a row
    are a span of it.
    """

    def __init__(self, data: np.ndarray, breaks: np.ndarray, salt: int):
        word, ends, lower, values = _tables()
        inside, stop = word[data], ends[data]
        gap = np.zeros(len(data), bool)
        gap[breaks] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | gap[1:]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | gap[1:]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        stops = np.concatenate([[0], np.cumsum(stop)])
        # a piece begins where a separator, or the beginning of a text, lies between two words
        starts = np.searchsorted(breaks, a, "right")
        self.opens = np.ones(len(a), bool)
        self.opens[1:] = (stops[a[1:]] != stops[a[:-1]]) | (starts[1:] != starts[:-1])
        small = lower[data]
        up, down = _powers(1 << max(16, int(len(data)).bit_length()))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[small] * up[: len(data)], out=total[1:])
        self.hashes = mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)) ^ _U(salt)
        sizes = b - a
        self.at = np.zeros(len(a) + 1, np.int64)
        np.cumsum(sizes + 1, out=self.at[1:])
        self.body = np.full(int(self.at[-1]), 0x20, np.uint8)
        # a word's bytes move left by what was left out before it
        self.body[np.arange(len(small))[inside] - np.repeat(a - self.at[:-1], sizes)] = small[inside]

    def pairs(self) -> np.ndarray:
        """Hashes of each word with the one before it, from the second word on."""
        return mixed(self.hashes[:-1] * _U(0x9E3779B97F4A7C15) + self.hashes[1:])

    def triples(self) -> np.ndarray:
        """Hashes of each word with the two before it, from the third word on."""
        return mixed((self.pairs()[:-1] ^ _U(0x94D049BB133111EB)) * _U(0x9E3779B97F4A7C15) + self.hashes[2:])

    def spans(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words from ``first`` to ``last``, both included, as strings."""
        start, size = self.at[first], self.at[last + 1] - self.at[first] - 1
        ends = np.zeros(len(first) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        places = np.arange(int(ends[-1])) + np.repeat(start - ends[:-1], size)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), pa.py_buffer(self.body[places].tobytes()))


def _cuts(body: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Slices of a text that end where pieces do."""
    while end - start > SLICE:
        at = start + SLICE
        while at < end:
            stop = np.flatnonzero(_tables()[1][body[at : min(end, at + SLICE)]])
            if len(stop):
                at += int(stop[0]) + 1
                break
            at = min(end, at + SLICE)
        yield start, at
        start = at
    yield start, end


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Slice]]:
    """(lang, words) for slices of (lang, text) rows, texts of one language together."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode() if not pa.types.is_dictionary(batch.column(0).type) else batch.column(0)
        codes = np.asarray(langs.indices)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pa.array(codes == code)).cast(pa.large_string())
            _, at, raw = texts.buffers()
            at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
            salt = zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 % 2**64
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
                for a, b in _cuts(raw, int(at[i]), int(at[j])) if j == i + 1 else [(int(at[i]), int(at[j]))]:
                    breaks = at[i:j] - a
                    data = raw[a:b]
                    if len(data):
                        yield lang, Slice(data, np.unique(breaks[(breaks > 0) & (breaks < len(data))]), salt)
                i = j


# -- passes over the texts ----------------------------------------------------------------


def sketch_bits(docs: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (COUNTERS_A_DOC * docs).bit_length()))


def _frequent(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """Whether a counter of word pairs and triples has reached ``least``: a bit for each counter.

    A task's counters end at ``least``, which is enough to tell.
    """
    shift, kind = _U(64 - bits), np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, held = np.zeros(1 << bits, kind), [], 0

        def settle() -> None:
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            own[at] = np.minimum(least, own[at] + n)

        for _, s in slices(batches):
            inside = ~s.opens
            both = np.concatenate([s.pairs()[inside[1:]], s.triples()[inside[1:-1] & inside[2:]]])
            waiting.append((both >> shift).astype(np.int64))
            held += len(both)
            if held > 2_000_000:
                settle()
                waiting, held = [], 0
        if held:
            settle()
        for k, i in enumerate(range(0, 1 << bits, CHUNK)):
            if own[i : i + CHUNK].any():
                yield pa.RecordBatch.from_pydict({"chunk": [k], "body": [zlib.compress(own[i : i + CHUNK].tobytes(), 1)]})

    def unite(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        part = np.frombuffer(zlib.decompress(x.tobytes()), kind).astype(np.int64)
        return part if held is None else held + part

    out = np.zeros(1 << bits, bool)
    for k, body in merged_chunks(texts.mapInArrow(run, "chunk bigint, body binary"), unite, lambda held: np.packbits(held >= least), np.uint8).items():
        own = out[k * CHUNK : (k + 1) * CHUNK]
        own[:] = np.unpackbits(np.frombuffer(body, np.uint8))[: len(own)]
    return np.packbits(out)


def grams(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, gram, words, n): edges of ``longest`` words and shorter grams with which the flow stops, with their
    numbers; the number of all words of a language has a null gram."""
    bits = sketch_bits(texts.count())
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, bits, least))
    shift = _U(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        waiting, held, total = [], 0, {}

        def known(codes: np.ndarray) -> np.ndarray:
            code = (codes >> shift).astype(np.int64)
            return (table[code >> 3] >> (7 - (code & 7)).astype(np.uint8)) & 1 == 1

        def settle() -> Iterator[pa.RecordBatch]:
            both = pa.concat_tables(waiting).group_by(["lang", "gram", "words"]).aggregate([("n", "sum")])
            both = both.select(["lang", "gram", "words", "n_sum"]).rename_columns(["lang", "gram", "words", "n"])
            yield from both.cast(GRAMS).to_batches(50_000)

        for lang, s in slices(batches):
            n = len(s.opens)
            total[lang] = total.get(lang, 0) + n
            if not n:
                continue
            # whether a word may follow the one before it, and the two before it
            pair, triple = np.zeros(n + longest, bool), np.zeros(n + longest, bool)
            pair[1:n] = ~s.opens[1:] & known(s.pairs())
            triple[2:n] = pair[1 : n - 1] & pair[2:n] & known(s.triples())
            size, alive = np.ones(n, np.int64), np.ones(n, bool)
            for k in range(1, longest):
                alive &= (pair if k == 1 else triple)[k : n + k]
                size += alive
            first = np.arange(n)
            t = pa.table({"gram": s.spans(first, first + size - 1), "words": pa.array(size.astype(np.int32))}).group_by(["gram", "words"]).aggregate([([], "count_all")])
            waiting.append(pa.table({"lang": pa.array([lang] * len(t)), "gram": t["gram"], "words": t["words"], "n": t["count_all"]}))
            held += len(t)
            if held > 400_000:
                yield from settle()
                waiting, held = [], 0
        if held:
            yield from settle()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.nulls(len(total), pa.string()), pa.nulls(len(total), pa.int32()), pa.array(list(total.values()))], schema=GRAMS)

    found = texts.mapInArrow(run, "lang string, gram string, words int, n bigint")
    return written(found.groupBy("lang", "gram", "words").agg(F.sum("n").alias("n")), "grams")


GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


# -- the graph ----------------------------------------------------------------------------


def _first(gram: str | Column, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def _last(gram: str | Column, k: int) -> Column:
    return F.substring_index(gram, " ", -k)


def compacted(edges: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, path, n): maximal or nearly maximal unary paths of edges (lang, gram, n), each once.

    ``path`` is its words; all of its grams of ``longest`` words are edges of weight n.
    """
    k = longest - 1
    out_of = edges.groupBy("lang", _first("gram", k).alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.sum("n").alias("out_n"))
    into = edges.groupBy("lang", _last("gram", k).alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.sum("n").alias("in_n"))
    unary = written(out_of.join(into, ["lang", "node"]).where("outs = 1 and ins = 1 and out_n = in_n").select("lang", "node"), "unary")
    # a node's place in the order of junctions; null where paths cannot be joined
    order = F.when(F.col("node").isNotNull(), F.xxhash64("lang", "node"))
    paths = edges.select("lang", F.col("gram").alias("path"), "n")
    for side, node in (("a", _first("path", k)), ("b", _last("path", k))):
        own = unary.select(F.col("lang").alias("_l"), "node")
        paths = paths.join(own, (F.col("_l") == F.col("lang")) & (F.col("node") == node), "left").withColumn(side, order).drop("_l", "node")
    paths, count = written(paths, "paths"), edges.count()
    while True:
        low = F.least("a", "b")  # nulls aside
        # both sides at once only where a path leads to its own beginning: such a ring stays as it is
        at_end = F.col("b").isNotNull() & (F.col("b") == low) & ~F.col("a").eqNullSafe(F.col("b"))
        at_start = F.col("a").isNotNull() & (F.col("a") == low) & ~F.col("a").eqNullSafe(F.col("b"))
        junction = F.when(at_end, _last("path", k)).when(at_start, _first("path", k))
        open_ = paths.withColumn("junction", junction).withColumn("left", at_end)
        joined = (
            open_.where("junction is not null")
            .groupBy("lang", "junction", "n")
            .agg(
                F.max(F.when(F.col("left"), F.struct("path", "a"))).alias("l"),
                F.max(F.when(~F.col("left"), F.struct("path", "b"))).alias("r"),
                F.max(F.when(F.col("left"), F.col("b")).otherwise(F.col("a"))).alias("at"),
            )
        )
        whole = F.concat(F.col("l.path"), F.lit(" "), F.expr(f"substring(r.path, length(junction) + 2)"))
        both = F.col("l").isNotNull() & F.col("r").isNotNull()
        parts = F.when(both, F.array(F.struct(whole.alias("path"), F.col("l.a").alias("a"), F.col("r.b").alias("b")))).otherwise(
            F.array(F.struct(F.coalesce("l.path", "r.path").alias("path"), F.when(F.col("l").isNotNull(), F.col("l.a")).otherwise(F.col("at")).alias("a"), F.when(F.col("l").isNotNull(), F.col("at")).otherwise(F.col("r.b")).alias("b")))
        )
        met = joined.select("lang", "n", F.explode(parts).alias("p")).select("lang", "p.path", "n", "p.a", "p.b")
        paths = written(met.unionByName(open_.where("junction is null").select("lang", "path", "n", "a", "b")), "paths")
        left = paths.count()
        if count - left < max(1, count / SLOW):
            return paths.select("lang", "path", "n")
        count = left


def phrase_counts(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases with ``least`` occurrences or more, and (lang, n) of all words.

    ``texts`` has (lang, text), without nulls.
    """
    found = grams(texts, least, longest)
    totals = found.where("gram is null").groupBy("lang").agg(F.sum("n").alias("n"))
    paths = compacted(found.where(F.col("words") == longest).select("lang", "gram", "n"), longest)
    # the edges of a path are its spans of ``longest`` words
    words = F.split("path", " ")
    spans = F.transform(F.sequence(F.lit(1), F.size(words) - (longest - 1)), lambda i: F.array_join(F.slice(words, i, longest), " "))
    flow = paths.select("lang", F.explode(spans).alias("gram"), "n")
    levels = [flow.where(F.col("n") >= least).select("lang", F.col("gram").alias("phrase"), F.lit(longest).alias("words"), "n")]
    for k in range(longest - 1, 0, -1):
        ended = found.where(F.col("words") == k).select("lang", "gram", "n")
        flow = flow.select("lang", _first("gram", k).alias("gram"), "n").unionByName(ended)
        flow = written(flow.groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"flow{k}")
        levels.append(flow.where(F.col("n") >= least).select("lang", F.col("gram").alias("phrase"), F.lit(k).alias("words"), "n"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return written(out, "phrases"), totals


# -- collocations -------------------------------------------------------------------------


def collocations(docs: DataFrame, least: int = LEAST, shown: int = SHOWN, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-bound phrases of every language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts, totals = phrase_counts(texts, least, longest)
    candidates = counts.where("words > 1").withColumnRenamed("n", "a")
    held = candidates.where("words > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    left = candidates.join(held, ["lang", "phrase"], "left").where("inside is null or inside < a").drop("inside")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda name: counts.select("lang", F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(name))
    cuts = cuts.withColumn("l_phrase", F.expr("substring_index(phrase, ' ', k)")).withColumn("r_phrase", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(part("l"), ["lang", "l_phrase"]).join(part("r"), ["lang", "r_phrase"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("over", (F.lit(1000).cast("decimal(4,0)") * big("a") * F.col("n").cast("decimal(15,0)")).cast("decimal(38,0)")).withColumn("under", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("over div under").cast("long"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    rows = best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= shown).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) as piece from documents),
runs as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from runs),
spans as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k from places, (values (1), (2), (3), (4), (5)) t(k) where i + k - 1 <= len(w)),
f as (select lang, phrase, k, count(*) as n from spans group by all having count(*) >= 100),
totals as (select lang, sum(len(w))::bigint as n from runs group by lang),
inside as (
  select lang, regexp_replace(phrase, ' [^ ]+$', '') as phrase, n from f where k > 2
  union all select lang, regexp_replace(phrase, '^[^ ]+ ', ''), n from f where k > 2),
held as (select lang, phrase, max(n) as most from inside group by all),
kept as (select c.* from f c left join held h on c.lang = h.lang and c.phrase = h.phrase where c.k > 1 and (h.most is null or 100 * h.most::hugeint < 100 * c.n::hugeint)),
cuts as (select lang, phrase, n as a, string_split(phrase, ' ') as w, k, unnest(range(1, k)) as c from kept),
scored as (
  select x.lang, x.phrase, x.a, x.c, l.n as l, r.n as r, t.n, (1000::hugeint * x.a * t.n // (l.n::hugeint * r.n))::bigint as score
  from cuts x join totals t on x.lang = t.lang
  join f l on l.lang = x.lang and l.phrase = array_to_string(x.w[1:x.c], ' ') join f r on r.lang = x.lang and r.phrase = array_to_string(x.w[x.c + 1:], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000"""
