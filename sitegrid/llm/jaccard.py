"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters.

1. One pass hashes every document's word shingles and counts them in a sketch whose size follows
   the number of documents. A counter's logarithm is a shingle's frequency level; with the
   hash it orders all shingles, rare ones first. Any such order gives right results; the
   sketch decides only how few candidates there are.
2. A second pass emits each set's prefix: two sets over the threshold share a shingle in
   their prefixes. Sets seen before in the same task are left out; equal sets are linked
   through their digests, which Spark groups with map-side sums.
3. Prefixes are dealt out by shingle and sorted. Members of a short run are paired; in a
   longer one the members with the commonest prefixes are pivots, paired with all others.
   Shingles that the sketch finds in more than HOT documents are dealt out by document as
   well, and meet their pivot in a salted join. The length and positional filters hold for
   each pair before it leaves the task.
4. Distinct pairs meet their full sets, pass the suffix filter and are verified exactly, once.
5. In long runs, members whose components still differ are paired: those outside the run's
   largest component against all, in a grid of blocks of BLOCK members, at first one member for
   each component, then all. Pairs verified before are left out. So no link between components
   is lost, no group of copies is expanded into all its pairs, and no run is one task's.

Defined results: null texts, empty texts and texts without words have no shingles and are
linked with nothing; a very long text is shingled whole; rows that share a doc_id are one node
(of their sets, each may link it); a null doc_id takes no part
and gets a null component; of a component the smallest doc_id names it, so ties cannot arise;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, connected_components, merged_chunks, mixed, without, written
from .shingles import shingle_sets

WORDS, PERCENT = 4, 85
#: Counters of the sketch: about COUNTERS_A_DOC for each document, 2**bits in all, within these bounds.
COUNTERS_A_DOC, LEAST_BITS, MOST_BITS, CHUNK = 64, 16, 26, 1 << 16
#: Runs up to SHORT_RUN are paired whole; shingles of more than HOT documents are spread over SALTS.
SHORT_RUN, PIVOTS, HOT, SALTS, BLOCK = 4, 1, 244, 16, 512
_U = np.uint64


def need(total, percent: int):
    """Least overlap of two sets with ``total`` members together at the threshold."""
    return -(-percent * total // (100 + percent))


# -- the frequency sketch -----------------------------------------------------------------


def sketch_bits(docs: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (COUNTERS_A_DOC * docs).bit_length()))


def level(count):
    """Logarithm of a count, one byte."""
    return np.minimum(255, np.round(8 * np.log2(1.0 + count))).astype(np.uint8)


def _levels(parts: DataFrame, bits: int) -> np.ndarray:
    """The frequency level of every counter: one byte each, 2**bits in all."""
    out = np.zeros(1 << bits, np.uint8)
    part = lambda b: np.frombuffer(zlib.decompress(b), np.uint8)
    total = lambda held, x: part(x).astype(np.int64) if held is None else held + part(x)
    for i, body in merged_chunks(parts, total, level, np.uint8).items():
        x = np.frombuffer(body, np.uint8)
        out[i * CHUNK : i * CHUNK + len(x)] = x
    return out


def _chunks(table: np.ndarray) -> list[tuple[int, bytes]]:
    """Mostly small counts, so they are packed."""
    return [(k, zlib.compress(table[i : i + CHUNK].tobytes(), 1)) for k, i in enumerate(range(0, len(table), CHUNK)) if table[i : i + CHUNK].any()]


# -- passes over the texts ----------------------------------------------------------------

PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])


def _sums(hashes: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([[_U(0)], np.cumsum(mixed(hashes ^ _U(salt)))])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def profiles(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """A row for each document (size and 128-bit digest of its set) and the sketch's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a byte for each counter: a task's larger counts are frequent enough to tell
        sketch, waiting, held = np.zeros(1 << bits, np.uint8), [], 0

        def settle() -> None:
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            sketch[at] = np.minimum(255, sketch[at] + n)

        for batch in batches:
            for i, hashes, bounds in shingle_sets(batch.column(1), words):
                n = len(bounds) - 1
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.diff(bounds)), pa.array(_sums(hashes, bounds, 1)), pa.array(_sums(hashes, bounds, 2)), none, pa.nulls(n, pa.binary())],
                    schema=PROFILE,
                )
                waiting.append((hashes >> _U(64 - bits)).astype(np.int64))
                held += len(hashes)
                if held > 2_000_000:
                    settle()
                    waiting.clear()
                    held = 0
        if waiting:
            settle()
        for k, body in _chunks(sketch):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, k, body), PROFILE.types, strict=True)], schema=PROFILE)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, chunk bigint, body binary")


def _tokens(hashes: np.ndarray, bounds: np.ndarray, levels: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Each set as ascending tokens: frequency level, then 56 bits of the hash."""
    codes = (levels[(hashes >> _U(64 - bits)).astype(np.int64)].astype(np.uint64) << _U(56)) | (hashes >> _U(8))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.sort(codes[a:b])


def prefixes(docs: DataFrame, levels, words: int, percent: int, bits: int) -> DataFrame:
    """(token, doc, at) of every prefix member; at = rarity << 56 | position << 32 | set size.

    The rarity of a set's prefix is the same at all its members, so the runs of a group of
    copies agree on their pivots: the sets with the fewest shingles of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            if len(seen) > 100_000:
                seen.clear()  # it only saves work
            ids = batch.column(0).to_pylist()
            for i, hashes, bounds in shingle_sets(batch.column(1), words):
                digest = list(zip(_sums(hashes, bounds, 1).tolist(), _sums(hashes, bounds, 2).tolist(), strict=True))
                tokens, owners, ats = [], [], []
                for k, t in enumerate(_tokens(hashes, bounds, levels.value, bits)):
                    if len(t) and ids[i + k] is not None and digest[k] not in seen:
                        seen.add(digest[k])
                        p = len(t) - (percent * len(t) + 99) // 100 + 1
                        tokens.append(t[:p])
                        owners.append(np.full(p, ids[i + k], np.int64))
                        rarity = 127 - int((t[:p] >> _U(56)).mean()) // 2
                        ats.append((np.arange(p, dtype=np.int64) << 32) | len(t) | (rarity << 56))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(ats))], ["token", "doc", "at"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "token bigint, doc bigint, at bigint")


def _packed(hashes: np.ndarray) -> bytes:
    """A sorted set as 56-bit hashes: those that tell tokens apart, seven bytes each."""
    return (hashes >> _U(8)).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpacked(body: pa.Buffer) -> np.ndarray:
    out = np.zeros((len(body) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(body, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(doc, tokens) of the ``wanted(doc)`` documents.

    A filter sized for them travels to the texts instead of the texts to a join; what it
    lets through wrongly is removed by the joins that follow.
    """
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(bloom.value.has(np.asarray(batch.column(0)))))
            if not batch.num_rows:
                continue
            column = pa.concat_arrays([batch.column(1)])
            for i, hashes, bounds in shingle_sets(column, words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(bounds) - 1), pa.array([_packed(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["doc", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(run, "doc bigint, tokens binary")


# -- candidates ---------------------------------------------------------------------------


def _fits(at1: np.ndarray, at2: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filters for two members of one run."""
    n1, n2, p1, p2 = at1 & 0xFFFFFFFF, at2 & 0xFFFFFFFF, at1 >> 32 & 0xFFFFFF, at2 >> 32 & 0xFFFFFF
    close = np.minimum(n1, n2) * 100 >= percent * np.maximum(n1, n2)
    return close & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= need(n1 + n2, percent))


def _fit(at1: Column, at2: Column, percent: int) -> Column:
    """The same as a column expression."""
    size = lambda at: at.bitwiseAND(F.lit(0xFFFFFFFF))
    left = lambda at: size(at) - F.shiftright(at, 32).bitwiseAND(F.lit(0xFFFFFF))
    n1, n2 = size(at1), size(at2)
    close = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    return close & (F.least(left(at1), left(at2)) * (100 + percent) >= (n1 + n2) * percent)


def is_hot(token: Column) -> Column:
    """Whether the sketch counts a shingle in more than HOT documents. A task's counts end at 255,
    so no run of the others is longer than that."""
    return F.shiftrightunsigned(token, 56) > int(level(HOT))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted rows again, cut so that a token's rows are never split unless there
    are more than BLOCK of them; the last column is the rank of a row within its token."""
    held, last, base = None, None, 0
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        token = held[0]
        if not len(token):
            continue
        cut = len(token) - int((token[::-1] == token[-1]).argmin()) if token[0] != token[-1] else 0
        if len(token) - cut > BLOCK:
            cut = len(token)
        if cut:
            out = [c[:cut] for c in held]
            rank, last, base = _ranks(out[0], last, base)
            yield (*out, rank)
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        rank, last, base = _ranks(held[0], last, base)
        yield (*held, rank)


def _ranks(token: np.ndarray, last, base: int) -> tuple[np.ndarray, int, int]:
    """Rank within each token's run, going on from the rows before; the run that is open at the end."""
    new = np.concatenate([[True], token[1:] != token[:-1]])
    start = np.flatnonzero(new)
    rank = np.arange(len(token)) - np.repeat(start, np.diff(np.concatenate([start, [len(token)]])))
    if last is not None and token[0] == last:
        rank[: start[1] if len(start) > 1 else len(token)] += base
    return rank, token[-1], int(rank[-1]) + 1


def candidates(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) with token null, and the members of long runs (token, x = doc, y = at): all but
    the pivots of those that one task sees whole, all of the hot ones."""
    schema = "token bigint, x bigint, y bigint"
    hot_level = int(level(HOT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_token, pivots = None, []
        for token, doc, at, rank in _runs(batches):
            x, y, rows = [], [], []
            hot = (token.view(np.uint64) >> _U(56)) > hot_level
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[hot]), pa.array(doc[hot]), pa.array(at[hot])], ["token", "x", "y"])
                token, doc, at, rank = token[~hot], doc[~hot], at[~hot], rank[~hot]
                if not len(token):
                    continue
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.concatenate([start, [len(token)]]))
            length = np.repeat(size, size)
            # a run that began in earlier rows, or has many members, is a long one
            long = length > SHORT_RUN
            if token[0] == open_token and pivots:
                long[: size[0]] = True
            short = np.flatnonzero(~long & (length > 1))
            t, d, a = token[short], doc[short], at[short]
            for k in range(1, SHORT_RUN):
                same = np.flatnonzero(t[k:] == t[:-k]) if k < len(t) else np.zeros(0, np.int64)
                same = same[_fits(a[same], a[same + k], percent)]
                x.append(d[same])
                y.append(d[same + k])
            for s, n in zip(start[long[start]], size[long[start]], strict=True):
                if token[s] != open_token:
                    open_token, pivots = token[s], []
                for i in range(s, s + n):
                    if len(pivots) >= PIVOTS:
                        break
                    for pd, pat in pivots:
                        if _fits(np.array([pat]), at[i : i + 1], percent)[0]:
                            x.append(np.array([pd]))
                            y.append(doc[i : i + 1])
                    pivots.append((doc[i], at[i]))
                else:
                    i = s + n
                for pd, pat in pivots:
                    ok = np.flatnonzero(_fits(np.full(s + n - i, pat), at[i : s + n], percent)) + i
                    x.append(np.full(len(ok), pd))
                    y.append(doc[ok])
                rest = np.arange(s, s + n)[rank[s : s + n] >= PIVOTS]
                rows.append(rest)
            if not long[-1]:
                open_token, pivots = None, []
            x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (x, y))
            apart = x != y
            x, y = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            both = np.unique(np.stack([x, y], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            rest = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["token", "x", "y"])
            if len(rest):
                yield pa.RecordBatch.from_arrays([pa.array(token[rest]), pa.array(doc[rest]), pa.array(at[rest])], ["token", "x", "y"])

    spread = F.when(is_hot(F.col("token")), F.pmod(F.xxhash64("doc"), F.lit(1 << 20))).otherwise(0)
    return posted.repartition("token", spread).sortWithinPartitions("token", "at", "doc").mapInArrow(run, schema)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def hot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(x, y): the members of hot runs with their run's pivot, one for each run, in a salted join."""
    hot = members.where(is_hot(F.col("token")))
    pivots = hot.groupBy("token").agg(F.min(F.struct("at", "doc")).alias("p")).select("token", F.col("p.at").alias("_at"), F.col("p.doc").alias("_doc"))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = hot.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(pivots, ["token", "salt"])
    return met.where((F.col("doc") != F.col("_doc")) & _fit(F.col("at"), F.col("_at"), percent)).select(*_ordered("doc", "_doc"))


def unresolved(members: DataFrame, components: DataFrame, percent: int, one_each: bool) -> tuple[DataFrame, DataFrame]:
    """((x, y), (token)): pairs of a long run's members in different components, and the runs of
    more than BLOCK members among them. The members outside the run's largest component meet all
    of the run, dealt out as a grid of blocks; with ``one_each``, in the runs over BLOCK, only one
    member for each of their components does."""
    named = members.join(components.withColumnRenamed("node", "doc"), "doc", "left")
    named = written(named.select("token", "doc", "at", F.coalesce("component", "doc").alias("comp")), "jac-named")
    counts = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "doc")).alias("head"))
    runs = counts.groupBy("token").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("big"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    heads_only = (F.col("size") > BLOCK) & F.lit(one_each)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    apart = F.when(heads_only, F.col("comps") - 1).otherwise(F.col("size") - F.col("big.n"))
    runs = written(runs.select("token", "size", F.col("big.comp").alias("_big"), heads_only.alias("_heads"), blocks(F.col("size")).alias("rows_"), blocks(apart).alias("cols_")), "jac-runs")
    own = named.join(runs, "token")
    place = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    heads = counts.join(runs.where("_heads"), "token").select("token", F.col("head.doc").alias("doc"), F.col("head.at").alias("at"), "comp", "_big", "rows_", "cols_")
    lead = own.where("not _heads").select("token", "doc", "at", "comp", "_big", "rows_", "cols_").unionByName(heads)
    pivots = lead.where(F.col("comp") != F.col("_big")).select("token", F.col("doc").alias("_doc"), F.col("at").alias("_at"), F.col("comp").alias("_comp"), place("cols_").alias("col"), every("rows_").alias("row"))
    rest = own.select("token", "doc", "at", "comp", place("rows_").alias("row"), every("cols_").alias("col"))
    met = rest.join(pivots, ["token", "row", "col"]).where((F.col("comp") != F.col("_comp")) & _fit(F.col("at"), F.col("_at"), percent))
    return met.select(*_ordered("doc", "_doc")).distinct(), runs.where("_heads").select("token")


# -- verification -------------------------------------------------------------------------


def _suffix_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Upper bound of the overlap: both sets are split at eight pivots of the larger one, and
    in each part no more than the smaller count can agree."""
    cuts = a[:: max(1, len(a) // 8)]
    return int(np.minimum(np.diff(np.concatenate([[0], np.searchsorted(a, cuts), [len(a)]])), np.diff(np.concatenate([[0], np.searchsorted(b, cuts), [len(b)]]))).sum())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for k in range(batch.num_rows):
                a, b = _unpacked(left[k].as_buffer()), _unpacked(right[k].as_buffer())
                if len(a) < len(b):
                    a, b = b, a
                least = need(len(a) + len(b), percent)
                if len(b) < least or _suffix_bound(a, b) < least:
                    continue
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    left = sets.select(F.col("doc").alias("x"), F.col("tokens").alias("left"))
    right = sets.select(F.col("doc").alias("y"), F.col("tokens").alias("right"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "left", "right").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    bits = bits or sketch_bits(docs.count())
    profile = written(profiles(docs, words, bits), "jac-profile")
    rows = profile.where("chunk is null").select("doc_id", "n", "k1", "k2")
    levels = spark.sparkContext.broadcast(_levels(profile.where("chunk is not null").select("chunk", "body"), bits))
    same = rows.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # written, so that a join with one very large group can be split
    same = written(same.where("copies > 1").drop("copies"), "jac-same")
    equal = rows.join(same, ["n", "k1", "k2"]).where("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))

    found = written(candidates(prefixes(docs, levels, words, percent, bits), percent), "jac-found")
    members = found.where("token is not null").select("token", F.col("x").alias("doc"), F.col("y").alias("at"))
    pairs = written(found.where("token is null").select("x", "y").unionByName(hot_pairs(members, percent)).distinct(), "jac-pairs")
    tried = pairs
    links = written(verified(pairs, wanted_sets(docs, pairs, words), percent).union(equal), "jac-links")
    components = written(connected_components(links, "jac-cc"), "jac-cc")
    for one_each in (True, False):
        if members.isEmpty():
            break
        more, large = unresolved(members, components, percent, one_each)
        more = written(more.join(tried, ["x", "y"], "left_anti"), "jac-more")
        # in the other runs all pairs have been tried
        members = members.join(large, "token", "left_semi")
        if more.isEmpty():
            continue
        tried = tried.unionByName(more)
        links = written(links.union(verified(more, wanted_sets(docs, more, words), percent)), "jac-links")
        components = written(connected_components(links, "jac-cc"), "jac-cc")
    named = rows.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def wanted_sets(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    wanted = written(pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct(), "jac-wanted")
    return written(sets_of(docs, wanted, words), "jac-sets")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are linked, directly or not, to one with a smaller id."""
    found = jaccard_components(docs, **options).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return without(docs, ["__gone"], found, [F.col("doc_id").cast("long")])
