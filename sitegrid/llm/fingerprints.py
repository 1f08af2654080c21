"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo two primes, the polynomial of its first i code points for
every i. Two look-ups give the hash of any span, wherever it lies, so spans are compared at once, and
the longest common extension of two places is found by binary search over lengths.

A fingerprint keeps the array's values at few places:

- heads and tails: the first and the last m * step code points, step the least power of two that
  leaves at most MARKS of them. Steps of two texts are multiples of each other, so their common
  beginning and end are found by binary search over the heads and tails that both have;
- cuts: places where the hash of the WINDOW code points before ends in ``level`` zero bits, the
  least level that leaves at most CUTS. A coarser text's cuts are among a finer one's, so the spans
  between cuts of the same level are compared wherever they were moved to.

The likeness of two fingerprints is the share of the longer text that they show to be common: the
common beginning and end, and between them the spans between cuts that both have. Equal texts have
equal fingerprints, different ones differ in the hash of the whole but for a chance of about n / 2**62.

Each document's neighbour is the next one by identifier. Places of a distributed sort of
(identifier, hash, place in the scan) become the bounds of buckets; texts move to their bucket
once, the first one of a bucket to the bucket before it as well, and a bucket is read in order, two
texts at a time.

Defined results: a null text counts as empty; two empty texts have likeness 1, an empty and another 0; a
text of any length is hashed whole, at 16 bytes a code point while it is at hand; null identifiers come
first, rows of one identifier are ordered by the hash of their texts, so equal rows neighbour each other; the
only row of a table is its own next one; an empty table gives an empty one; other columns are not
read. Equal rows are told apart by their place in the scan, so the input must read files.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, shuffle_partitions

#: The two primes below 2**31, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245 % PRIMES[0], 1664525001 % PRIMES[1])
MARKS, CUTS, WINDOW = 32, 24, 8
#: Powers are products of a low and a high part, of this many bits each.
HALF = 16
_U = np.uint64


@lru_cache(maxsize=4)
def _tables(which: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. 2**HALF - 1 of the base, and of its 2**HALF-th power."""
    p = PRIMES[which]
    base = pow(BASES[which], -1, p) if inverse else BASES[which]
    out = []
    for b in (base, pow(base, 1 << HALF, p)):
        x = np.ones(1, np.uint64)
        while len(x) < 1 << HALF:
            x = np.concatenate([x, x * _U(pow(b, len(x), p)) % _U(p)])
        out.append(x)
    return out[0], out[1]


def powers(which: int, at: np.ndarray, inverse: bool = False) -> np.ndarray:
    low, high = _tables(which, inverse)
    return low[at & ((1 << HALF) - 1)] * high[at >> HALF] % _U(PRIMES[which])


class Prefixes:
    """The prefix arrays of a text."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays, self.n = arrays, len(arrays[0]) - 1

    @classmethod
    def of(cls, text: str) -> Prefixes:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
        arrays = []
        for k, p in enumerate(PRIMES):
            low, high = _tables(k, False)
            out, carry = np.zeros(len(codes) + 1, np.uint64), _U(0)
            for b, i in enumerate(range(0, len(codes), 1 << HALF)):
                part = codes[i : i + (1 << HALF)]
                sums = np.cumsum(part * low[: len(part)] % _U(p)) % _U(p)
                out[i + 1 : i + 1 + len(part)] = (sums * high[b] + carry) % _U(p) if b else sums
                carry = out[i + len(part)]
            arrays.append(out)
        return cls(arrays)

    def joined(self, end: int, other: Prefixes, take: int) -> Prefixes:
        """The arrays of the first ``end`` code points followed by the first ``take`` of another text."""
        out = []
        for k, p in enumerate(PRIMES):
            own, more = self.arrays[k][: end + 1], other.arrays[k][1 : take + 1]
            out.append(np.concatenate([own, (more * powers(k, np.array([end]))[0] + own[-1]) % _U(p)]))
        return Prefixes(out)

    def spans(self, i, j) -> np.ndarray:
        """Hashes of spans [i, j), of any places and lengths, in 62 bits."""
        i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
        a, b = ((self.arrays[k][j] + _U(p) - self.arrays[k][i]) % _U(p) * powers(k, i, True) % _U(p) for k, p in enumerate(PRIMES))
        return (a << _U(31)) | b

    def same(self, i: int, other: Prefixes, j: int, size: int) -> bool:
        """Whether the spans of that size at place i here and at place j there are equal."""
        return _equal(self, i, other, j, *_shifts(i, j))(i + size, j + size)

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of place i here and place j there, to the right."""
        if i >= self.n or j >= other.n:
            return 0
        equal = _equal(self, i, other, j, *_shifts(i, j))
        return _last(min(self.n - i, other.n - j), lambda size: equal(i + size, j + size))

    def extension_left(self, i: int, other: Prefixes, j: int) -> int:
        # a span that ends here is compared from its end, where both are at the same distance
        equal = _equal(self, i, other, j, *_shifts(i, j))
        return _last(min(i, j), lambda size: equal(i - size, j - size))


def _shifts(i: int, j: int) -> tuple[list[int], list[int]]:
    """For each prime, the powers that bring sums from place i and from place j to one place."""
    low = min(i, j)
    return [pow(b, j - low, p) for b, p in zip(BASES, PRIMES, strict=True)], [pow(b, i - low, p) for b, p in zip(BASES, PRIMES, strict=True)]


def _equal(x: Prefixes, i: int, y: Prefixes, j: int, up: list[int], down: list[int]):
    """A test whether the spans between i and u here and between j and v there are equal, u - i = v - j."""
    from_x, from_y = [int(a[i]) for a in x.arrays], [int(a[j]) for a in y.arrays]

    def test(u: int, v: int) -> bool:
        return all(
            (int(x.arrays[k][u]) - from_x[k]) * up[k] % p == (int(y.arrays[k][v]) - from_y[k]) * down[k] % p for k, p in enumerate(PRIMES)
        )

    return test


def _last(most: int, holds) -> int:
    """The largest size up to ``most`` for which ``holds``, which holds up to some size."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if holds(mid) else (low, mid - 1)
    return low


# -- fingerprints -------------------------------------------------------------------------


class Print(NamedTuple):
    n: int
    step: int
    level: int
    whole: int
    heads: np.ndarray
    tails: np.ndarray
    #: places, trailing zero bits, and the two arrays' values at the places
    cuts: np.ndarray
    bits: np.ndarray
    values: np.ndarray


def print_of(x: Prefixes) -> Print:
    n, step = x.n, 1
    while n > MARKS * step:
        step *= 2
    marks = np.arange(step, n + 1, step)
    p = _U(PRIMES[0])
    if n >= WINDOW:
        s = x.arrays[0]
        at = np.arange(n - WINDOW + 1)
        inverse = _tables(0, True)[0][: len(at)] if n < 1 << HALF else powers(0, at, True)
        code = mixed((s[WINDOW:] + p - s[:-WINDOW]) * inverse % p)
        zeros = np.bitwise_count((code & (~code + _U(1))) - _U(1))
        most = np.bincount(zeros, minlength=65)[::-1].cumsum()[::-1]
        level = int(np.argmax(most <= CUTS))
        cuts = np.flatnonzero(zeros >= level)
        bits, cuts = zeros[cuts].astype(np.int64), cuts + WINDOW
    else:
        level, cuts, bits = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = np.stack([a[cuts] for a in x.arrays])
    return Print(n, step, level, int(x.spans([0], [n])[0]), x.spans(np.zeros_like(marks), marks), x.spans(n - marks, np.full_like(marks, n)), cuts, bits, values)


def text_of(f: Print) -> str:
    """The fingerprint as a string: numbers in hexadecimal, 16 digits a hash, 8 + 2 + 16 a cut."""
    packed = lambda a, kind: a.astype(kind).tobytes().hex()
    both = (f.values[0] << _U(31)) | f.values[1]
    return f"{f.n:x}.{f.step:x}.{f.level:x}.{f.whole:x}.{packed(f.heads, '>u8')}.{packed(f.tails, '>u8')}.{packed(f.cuts, '>u4')}.{packed(f.bits, '>u1')}.{packed(both, '>u8')}"


def print_from(text: str) -> Print:
    n, step, level, whole, *rest = text.split(".")
    heads, tails, cuts, bits, both = (np.frombuffer(bytes.fromhex(x), kind) for x, kind in zip(rest, (">u8", ">u8", ">u4", ">u1", ">u8"), strict=True))
    both = both.astype(np.uint64)
    values = np.stack([both >> _U(31), both & _U((1 << 31) - 1)])
    return Print(int(n, 16), int(step, 16), int(level, 16), int(whole, 16), heads.astype(np.uint64), tails.astype(np.uint64), cuts.astype(np.int64), bits.astype(np.int64), values)


def _run(a: np.ndarray, b: np.ndarray, a_step: int, b_step: int) -> int:
    """Code points that marks show to be common from one end."""
    step = max(a_step, b_step)
    a, b = a[step // a_step - 1 :: step // a_step], b[step // b_step - 1 :: step // b_step]
    return step * _last(min(len(a), len(b)), lambda m: a[m - 1] == b[m - 1])


def _inner(f: Print, level: int, start: int, end: int) -> Counter:
    """Spans between cuts of the level inside [start, end), by hash and length."""
    keep = (f.bits >= level) & (f.cuts >= start) & (f.cuts <= end)
    at, values = f.cuts[keep], f.values[:, keep]
    if len(at) < 2:
        return Counter()
    hashes = [(values[k, 1:] + _U(p) - values[k, :-1]) % _U(p) * powers(k, at[:-1], True) % _U(p) for k, p in enumerate(PRIMES)]
    return Counter(zip(hashes[0].tolist(), hashes[1].tolist(), np.diff(at).tolist(), strict=True))


def alike(a: Print, b: Print) -> float:
    """Share of the longer text that two fingerprints show to be common, 0 to 1."""
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    short, long = sorted((a.n, b.n))
    if not short:
        return 0.0
    level = max(a.level, b.level)
    before = min(short, _run(a.heads, b.heads, a.step, b.step))
    # a cut with equal prefixes shows a longer common beginning than the marks may do
    shared = set(zip(a.cuts.tolist(), *a.values.tolist(), strict=True)) & set(zip(b.cuts.tolist(), *b.values.tolist(), strict=True))
    before = max([before, *(x[0] for x in shared)])
    after = min(short - before, _run(a.tails, b.tails, a.step, b.step))
    inner = _inner(a, level, before, a.n - after) & _inner(b, level, before, b.n - after)
    return min(1.0, (before + after + sum(size * k for (_, _, size), k in inner.items())) / long)


# -- columns and tables -------------------------------------------------------------------


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_of(print_of(Prefixes.of(t or ""))) for t in texts])

    return of(text)


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprint columns; null where one is."""

    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else alike(print_from(x), print_from(y)) for x, y in zip(left, right, strict=True)], dtype="float64")

    return of(a, b)


def common_extension(a: Column, i: Column, b: Column, j: Column) -> Column:
    """Code points from place i of a text on that are those from place j of the other on; a place
    outside its text has none."""

    @F.pandas_udf("bigint")
    def of(left: pd.Series, at: pd.Series, right: pd.Series, to: pd.Series) -> pd.Series:
        out = []
        for x, p, y, q in zip(left, at, right, to, strict=True):
            x, y = Prefixes.of(x or ""), Prefixes.of(y or "")
            out.append(x.extension(p, y, q) if 0 <= p <= x.n and 0 <= q <= y.n else 0)
        return pd.Series(out)

    return of(a, i, b, j)


EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_prefix", pa.int64()), ("next_prefix", pa.int64()),
])
_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_prefix bigint, next_prefix bigint"
SHARE = 4


class _Doc:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.prefixes = Prefixes.of(text)
        self.print = print_of(self.prefixes)

    def edited(self, after: _Doc, share: int) -> tuple:
        """The row of this document and the next one."""
        cut = len(self.text) // share
        kept, take = len(self.text) - cut, min(cut, len(after.text))
        text = self.text[:kept] + after.text[:take]
        prefixes = self.prefixes.joined(kept, after.prefixes, take)
        new = print_of(prefixes)
        return (
            self.doc_id, len(self.text), sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), text_of(self.print), text_of(new), alike(self.print, new), alike(self.print, after.print),
            self.prefixes.extension(0, prefixes, 0), self.prefixes.extension(0, after.prefixes, 0),
        )


def _keys(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))


def _bounds(keyed: DataFrame) -> list[tuple]:
    """The least keys of the ranges of a distributed sort: as many as the configured partitions at most."""
    order = ["id", "hash", "place"]
    ranged = keyed.select(*order).repartitionByRange(shuffle_partitions(keyed.sparkSession), *order)
    least = ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*order)).alias("least")).collect()
    return sorted((_order(*r.least) for r in least))


def _order(doc_id: int | None, code: int, place: int) -> tuple:
    return doc_id is not None, doc_id or 0, code, place


def edited_pairs(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """Every document against its edited text, whose last ``1 / share`` is the next document's beginning, and
    against the next document: fingerprints, likeness, and the lengths of the common beginnings."""
    keyed = _keys(docs)
    bounds = _bounds(keyed)

    @F.pandas_udf("struct<own: int, guest: int>")
    def bucket(ids: pd.Series, codes: pd.Series, places: pd.Series) -> pd.DataFrame:
        own, guest = [], []
        for i, c, p in zip(ids, codes, places, strict=True):
            key = _order(None if pd.isna(i) else int(i), c, p)
            own.append(bisect_right(bounds, key) - 1)
            # the first row of a bucket is the next one of the last row of the bucket before
            guest.append((own[-1] - 1) % len(bounds) if bounds[own[-1]] == key else None)
        return pd.DataFrame({"own": own, "guest": pd.array(guest, "Int32")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for i, text, guest in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                doc = _Doc(i, text)
                if held is not None:
                    out.append(held.edited(doc, share))
                held = None if guest else doc
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), EDITED, strict=True)], schema=EDITED)

    # as strings, since nullable numbers would reach pandas as doubles
    placed = keyed.withColumn("at", bucket(F.col("id").cast("string"), "hash", "place"))
    copies = F.array_compact(F.array(F.struct(F.col("at.own").alias("part"), F.lit(False).alias("guest")), F.when(F.col("at.guest").isNotNull(), F.struct(F.col("at.guest").alias("part"), F.lit(True).alias("guest")))))
    rows = placed.select("id", "text", "hash", "place", F.explode(copies).alias("to")).select("id", "text", "hash", "place", "to.*")
    dealt = rows.repartitionById(max(1, len(bounds)), F.col("part")).sortWithinPartitions("guest", "id", "hash", "place")
    return dealt.select("id", "text", "guest").mapInArrow(run, _DDL)
