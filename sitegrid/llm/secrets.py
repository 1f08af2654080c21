"""Secret scanning with multipart credential linking. DataFrame functions only.

Base kinds (assign, access, hex) are strong on their own. Weak kinds are not: a short or
temporary access identifier, a bare key of 20 characters or more, an endpoint of any length.
They are reported only when parts
that complete them lie in the same scope: an identifier and a key within SCOPE code points,
or an endpoint with either of both.

Each pattern goes over a text once; what a match must hold besides (its length, a digit and a
capital) is tested on the match afterwards. Positions are prefix sums of the lengths of the
matches and of the texts between them, added up by doubling steps, so the cost of a text with
n matches grows with n log n. Weak parts are
few; they are exploded with the strong ones of their document and interval-joined on the scope
cells of their starts and ends, so the gap between two parts counts and not their lengths. At
most SCOPE divided by a part's least length parts of a kind start or end in a cell, so no cell,
however long its document, makes more than a bounded number of pairs.

Defined results: a null text is empty; documents without spans have zero counts, empty
``spans`` and the digest of the empty string; a very long text is scanned whole; spans that
start together are ordered by kind; rows that repeat give the same result each; an
empty table gives an empty one; a null doc_id passes through; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the contract: kind, pattern, the group that is measured, its least length.
BASE = (
    # the first look skips letters with which no name begins
    ("assign", r"""(?=[AaPpSsTt])(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    # a run shorter than the least length cannot match, and a longer one matches whole
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Weak kinds, the part of a credential that each is, and its pattern.
WEAK = (
    # AKIA of the base length is the base kind's
    ("weak_access", r"\b(?:AKIA[A-Z0-9]{8,13}|(?:ASIA|AIDA|AROA)[A-Z0-9]{8,})\b"),
    # whole runs; which of them are keys is tested on the match
    ("weak_secret", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+"),
    ("endpoint", r"\b(?:https?|s3|jdbc|amqp|mongodb|postgres|redis)://[^\x20\x09-\x0D\"'<>]{4,}"),
)
#: Strings of which each match holds one: a text without them needs no search.
HOLDS = {"access": ("AKIA",), "weak_access": ("AKIA", "ASIA", "AIDA", "AROA"), "endpoint": ("://",)}
PART = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "access", "weak_access": "access", "endpoint": "endpoint"}
KINDS = [k for k, *_ in BASE] + [k for k, _ in WEAK]
SCOPE = 512


SPAN = "struct<start:int,no:int,kind:string,end:int>"


def is_key(match: Column) -> Column:
    """A digit and a capital; a run that is an identifier as a whole is no key."""
    return match.rlike("[0-9]") & match.rlike("[A-Z]") & ~match.rlike("^(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}$")


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array<int>, by steps that double."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int"))
    before = lambda k: F.call_function("shiftleft", F.lit(1), k)
    # an element and the one 2**k before it: after step k each holds the sum of 2**(k + 1) values
    add = lambda acc, k: F.transform(acc, lambda v, i: v + F.when(i >= before(k), F.get(acc, i - before(k))).otherwise(0))
    return F.when(F.size(values) > 1, F.aggregate(steps, values, add)).otherwise(values)


def _at_least(least: int):
    return lambda n: n >= least


def _span(kind: str):
    return lambda m: F.struct((m["end"] - m["n"]).alias("start"), F.lit(KINDS.index(kind)).alias("no"), F.lit(kind).alias("kind"), m["end"].alias("end"))


def with_spans(rows: DataFrame, kinds: list[tuple]) -> DataFrame:
    """Adds, for every (kind, pattern, group, least) of ``kinds``, a column of the kind's name with
    the matches in ``t``: array<struct<start, no, kind, end>>, positions in code points.

    A column builds on those of the step before, so each pattern runs once; texts without a
    match (most) are done after one search. Bare keys complete identifiers and endpoints only:
    they are searched for in texts that have one.
    """
    t, n = F.col("t"), lambda kind: F.col(f"_n_{kind}")
    has = lambda kind: reduce(or_, [t.contains(x) for x in HOLDS[kind]]) if kind in HOLDS else F.lit(True)
    found = lambda kind, pattern, group, when: {f"_w_{kind}": F.when(when & t.rlike(pattern), F.regexp_extract_all(t, F.lit(f"({pattern})" if group == 0 else pattern), F.lit(0)))}
    bare = [k for k in kinds if k[0] == "weak_secret"]
    rows = rows.withColumns(reduce(or_, [found(*k[:3], has(k[0])) for k in kinds if k not in bare]))
    others = [F.col(f"_w_{k[0]}").isNotNull() for k in kinds if PART[k[0]] != "secret"]
    rows = rows.withColumns(reduce(or_, [found(*k[:3], reduce(or_, others)) for k in bare]))
    made = {}
    for kind, pattern, group, least in kinds:
        whole = F.col(f"_w_{kind}")
        own = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else whole
        good = F.transform(own, is_key) if kind == "weak_secret" else F.transform(F.transform(own, lambda m: F.length(m)), _at_least(least))
        gaps = F.slice(F.split(t, pattern, -1), F.lit(1), F.size(whole))
        made |= {f"_g_{kind}": F.when(whole.isNotNull(), good), f"_n_{kind}": F.when(whole.isNotNull(), F.transform(whole, lambda m: F.length(m))), f"_s_{kind}": F.when(whole.isNotNull(), F.zip_with(gaps, whole, lambda g, w: F.coalesce(F.length(g) + F.length(w), F.lit(0))))}
    rows = rows.withColumns(made)
    rows = rows.withColumns({f"_e_{kind}": prefix_sums(F.col(f"_s_{kind}")) for kind, *_ in kinds})
    out = {}
    for kind, *_ in kinds:
        each = F.filter(F.arrays_zip(F.col(f"_e_{kind}").alias("end"), n(kind).alias("n"), F.col(f"_g_{kind}").alias("good")), lambda m: m["good"])
        out[kind] = F.when(n(kind).isNotNull(), F.transform(each, _span(kind)).cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))
    return rows.withColumns(out)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, weak): all spans of each row, in one pass over the texts."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))
    rows = with_spans(rows, [*BASE, *((kind, pattern, 0, 0) for kind, pattern in WEAK)])
    both = lambda kinds: F.sort_array(F.concat(*[F.col(k) for k, *_ in kinds]))
    return rows.select("doc_id", "row", both(BASE).alias("base"), both(WEAK).alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, confirmed): the weak spans that a complementary part completes."""
    some = found.where(F.size("weak") > 0)
    part = F.create_map(*[F.lit(x) for kv in PART.items() for x in kv])
    parts = some.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s", part[F.col("s.kind")].alias("part"))
    cell = lambda at: F.floor(at / scope).cast("int")
    at = lambda edge, at: F.struct(F.lit(edge).alias("edge"), at.alias("cell"))
    # parts that do not overlap lie within scope if one's start is near the other's end, however
    # long they are: parts stand in the cells of their edges, a weak part looks beyond its own
    near = parts.select(
        F.col("row").alias("_row"), F.explode(F.array(at("start", cell(F.col("s.start"))), at("end", cell(F.col("s.end"))))).alias("_at"), F.col("part").alias("_part"), F.col("s.start").alias("_start"), F.col("s.end").alias("_end")
    )
    first, last = cell(F.col("s.start")), cell(F.col("s.end"))
    looks = F.array(at("start", last), at("start", last + 1), at("end", first - 1), at("end", first))
    weak = parts.where(F.col("s.no") >= len(BASE)).withColumn("at", F.explode(looks))
    met = weak.join(
        near,
        (F.col("row") == F.col("_row")) & (F.col("at.edge") == F.col("_at.edge")) & (F.col("at.cell") == F.col("_at.cell")) & (F.col("part") != F.col("_part"))
        & (F.col("_start") < F.col("s.end") + scope) & (F.col("_end") > F.col("s.start") - scope)
        & ((F.col("_start") >= F.col("s.end")) | (F.col("_end") <= F.col("s.start"))),
    )
    return met.select("row", "s").distinct().groupBy("row").agg(F.collect_list("s").alias("confirmed"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, confirmed): arrays of spans (start, no, kind, end)."""
    found = written(scan(docs), "secrets")
    return found.join(linked(found, scope), "row", "left").select("doc_id", "base", F.coalesce("confirmed", F.array().cast(f"array<{SPAN}>")).alias("confirmed"))


def report(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k, *_ in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "confirmed"))).alias("spans")
    )
