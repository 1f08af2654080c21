"""A Merkle manifest of a dataset: a tree for each source, one over the sources' roots, and a proof a row.

1. One pass hashes every row to a leaf, with SQL functions. From here on only digests move.
2. Leaves are numbered within their tree by a distributed sort; WIDE consecutive ones are a
   superblock, so no source, however large, is one task's.
3. Up: each superblock is reduced to one node, these are the next level's leaves, until every
   tree has a single node. A level is a WIDE-th of the one below.
4. The trees' roots are the leaves of one more tree, reduced the same way.
5. Down: the nodes of a level are cogrouped by superblock with the nodes that they need from
   outside it, the proof of the superblock itself. One pass over a group finishes its local
   reduction, joins the inner siblings to the outer ones and, for leaves, folds.

Every FAN consecutive nodes of a level become the digest of their concatenated digests, the last
run as well when it is shorter, even of one node. A level of a proof is what stands left of a node
in its run and what stands right of it.

Defined results: a null column enters a leaf as ``-``; an empty text as ``0:``; a very long text is
hashed whole; leaves of one doc_id are ordered by their digests, a null doc_id comes first, and
rows that are equal in all five columns are leaves of their own, at neighbouring places; a null source is
a tree of its own, the first; a lone row is its own root, its proof the digest of nothing; an empty
table gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

FAN = 3
#: Levels that a superblock spans, and its leaves.
DEPTH = 6
WIDE = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, place bigint, digest string"
OUTER = "tree string, place bigint, lefts array<string>, rights array<string>, subroot string, root string"
PROVED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row: each field by its length in bytes and its value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def drop_newlines(doc_id: Column, text: Column) -> Column:
    """The contract's tampering: rows with an even checksum of their identifier lose line ends."""
    even = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.translate(text, "\n", "")).otherwise(text)


def numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` with ``place``, from 0 within each ``tree``, in the order of ``order``.

    Ranges of one global sort are counted by tree; a tree that began in earlier ranges carries its
    count into the next one. A range has one such tree at most, its first.
    """
    ranged = written(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(df.sparkSession), "tree", *order, "_tie")
        .withColumn("_range", F.spark_partition_id()),
        label,
    )
    counts = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each range at most: a bound that the configuration sets, so it may be broadcast
    carried = counts.select("tree", "_range", before.alias("_before")).where("_before > 0")
    inside = F.row_number().over(Window.partitionBy("_range", "tree").orderBy(*order, "_tie"))
    placed = ranged.withColumn("_nth", inside).join(F.broadcast(carried), ["tree", "_range"], "left")
    return placed.select(*df.columns, (F.col("_nth") - 1 + F.coalesce(F.col("_before"), F.lit(0))).cast("long").alias("place"))


# -- one superblock -----------------------------------------------------------------------


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels(leaves: list[str], block: int) -> list[list[str]]:
    """The levels of a superblock, its leaves first, its one node last.

    The only superblock of a tree ends as soon as one node remains; one of several spans DEPTH levels,
    as the tree goes on above it. A first superblock that isn't full is an only one, and a full one
    has DEPTH levels in either case.
    """
    out, alone = [leaves], block == 0 and len(leaves) < WIDE
    while len(out[-1]) > 1 or (not alone and len(out) <= DEPTH):
        out.append([_digest("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(grown: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a leaf and of the nodes above it, level by level."""
    lefts, rights = [], []
    for level in grown[:-1]:
        first = at - at % FAN
        lefts.append("".join(level[first:at]))
        rights.append("".join(level[at + 1 : first + FAN]))
        at //= FAN
    return lefts, rights


def folded(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in zip(lefts, rights, strict=True):
        digest = _digest(left + digest + right)
    return digest


def _reduced(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    tree, block = key
    top = levels(nodes.sort_values("place").digest.tolist(), block)[-1]
    return pd.DataFrame({"tree": [tree], "place": [block], "digest": top})


def _exchanged(nodes: pd.DataFrame, outer: pd.DataFrame, emit: Callable) -> list[tuple]:
    """``emit(node, lefts, rights, above)`` for the nodes of a superblock, whose own proof is ``above``."""
    if nodes.empty:
        return []
    nodes = nodes.sort_values("place")
    above = next(outer.itertuples(index=False))
    grown = levels(nodes.digest.tolist(), int(nodes.place.iat[0]) // WIDE)
    out = []
    for at, node in enumerate(nodes.itertuples(index=False)):
        lefts, rights = siblings(grown, at)
        out.append(emit(node, lefts + list(above.lefts), rights + list(above.rights), above))
    return out


def _inner(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    emit = lambda n, lefts, rights, above: (n.tree, n.place, lefts, rights, above.subroot, above.root)
    return pd.DataFrame(_exchanged(nodes, outer, emit), columns=["tree", "place", "lefts", "rights", "subroot", "root"])


def _proved(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    def emit(n, lefts, rights, above):
        proof = _digest("".join(x + y for x, y in zip(lefts, rights, strict=True)))
        root = folded(n.now, lefts, rights)
        return n.id, n.digest, above.subroot, above.root, proof, root, root == above.root

    out = pd.DataFrame(_exchanged(leaves, outer, emit), columns=[x.split()[0] for x in PROVED.split(", ")])
    return out.astype({"doc_id": "Int64"})


# -- whole trees --------------------------------------------------------------------------



def _block() -> Column:
    return F.expr(f"place div {WIDE}").alias("block")


def grown(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The levels of all trees by superblocks, the given nodes first; the last has one node a tree."""
    out = [nodes]
    while True:
        out.append(written(out[-1].select("tree", "place", "digest").groupBy("tree", _block()).applyInPandas(_reduced, NODE), label))
        if out[-1].where("place > 0").isEmpty():
            return out


def _met(nodes: DataFrame, outer: DataFrame, finish: Callable, schema: str) -> DataFrame:
    above = outer.withColumn("block", F.col("place"))
    return nodes.withColumn("block", _block()).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(finish, schema)


def manifest(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``now`` is the text that is checked against the manifest of the given ones; where it isn't given,
    that is the text itself, and every row is verified.
    """
    fields = [F.col(c) for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # "-" sorts before "="
    checked = leaf_digest([*fields[:-1], now if now is not None else fields[-1]])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), tree.alias("tree"), leaf_digest(fields).alias("digest"), checked.alias("now"))
    leaves = written(numbered(written(rows, "merkle-rows"), ["id", "digest"], "merkle-ranged"), "merkle-leaves")
    up = grown(leaves, "merkle-level")
    roots = up[-1].select(F.lit("all").alias("tree"), F.col("tree").alias("of"), "digest")
    heads = written(numbered(roots, ["of"], "merkle-roots"), "merkle-heads")
    over = grown(heads, "merkle-over")
    none = F.array().cast("array<string>")
    outer = over[-1].select("tree", "place", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in over[-2::-1]:
        outer = written(_met(nodes.select("tree", "place", "digest"), outer, _inner, OUTER), "merkle-outer")
    named = heads.select(F.col("of"), F.col("place").alias("at"), F.col("digest").alias("own"))
    outer = outer.join(named, F.col("place") == F.col("at")).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", F.col("own").alias("subroot"), "root")
    for nodes in up[-2:0:-1]:
        outer = written(_met(nodes.select("tree", "place", "digest"), outer, _inner, OUTER), "merkle-outer")
    return _met(leaves.select("tree", "place", "digest", "id", "now"), outer, _proved, PROVED)


SQL = r"""
with recursive rows as (
  select doc_id, source, lang, n_chars, text,
    list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)) as crc from documents),
fields as (
  select *, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head,
    case when crc is not null and xor(crc, 4294967295::bigint) % 2 = 0 then replace(text, chr(10), '') else text end as now from rows),
leaves as (
  select doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(octet_length(encode(now)) || ':' || now, '-')) as now from fields),
places as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from leaves),
tree as (
  select source, 0 as lvl, place, leaf as digest, count(*) over (partition by source) as n from places
  union all
  select source, lvl + 1, p, d, count(*) over (partition by source) from (
    select source, lvl, place // 3 as p, sha256(string_agg(digest, '' order by place)) as d from tree where n > 1 group by source, lvl, place // 3)),
subroots as (select source, digest as subroot, lvl as height, row_number() over (order by source nulls first) - 1 as place from tree where n = 1),
top as (
  select 0 as lvl, place, subroot as digest, count(*) over () as n from subroots
  union all
  select lvl + 1, p, d, count(*) over () from (select lvl, place // 3 as p, sha256(string_agg(digest, '' order by place)) as d from top where n > 1 group by lvl, place // 3)),
root as (select digest as root, lvl as height from top where n = 1),
sides as (
  select l.source, l.place as leaf_place, t.lvl, coalesce(string_agg(t.digest, '' order by t.place) filter (t.place < l.place // (3 ** t.lvl)::bigint), '') as lft,
    coalesce(string_agg(t.digest, '' order by t.place) filter (t.place > l.place // (3 ** t.lvl)::bigint), '') as rgt
  from places l join tree t on l.source is not distinct from t.source and t.n > 1 and t.place // 3 = l.place // (3 ** (t.lvl + 1))::bigint group by all),
over_sides as (
  select s.source, t.lvl, coalesce(string_agg(t.digest, '' order by t.place) filter (t.place < s.place // (3 ** t.lvl)::bigint), '') as lft,
    coalesce(string_agg(t.digest, '' order by t.place) filter (t.place > s.place // (3 ** t.lvl)::bigint), '') as rgt
  from subroots s join top t on t.n > 1 and t.place // 3 = s.place // (3 ** (t.lvl + 1))::bigint group by all),
steps as (
  select source, leaf_place, lvl, lft, rgt from sides
  union all
  select l.source, l.place, s.height + o.lvl, o.lft, o.rgt from places l join subroots s on l.source is not distinct from s.source join over_sides o on l.source is not distinct from o.source),
proofs as (select source, leaf_place, list(lft order by lvl) as lefts, list(rgt order by lvl) as rights, sha256(string_agg(lft || rgt, '' order by lvl)) as proof_sha256 from steps group by all),
folds as (
  select p.source, p.place, 0 as done, p.now as digest, coalesce(q.lefts, []) as lefts, coalesce(q.rights, []) as rights, coalesce(q.proof_sha256, sha256('')) as proof_sha256
  from places p left join proofs q on p.source is not distinct from q.source and p.place = q.leaf_place
  union all
  select source, place, done + 1, sha256(lefts[done + 1] || digest || rights[done + 1]), lefts, rights, proof_sha256 from folds where done < len(lefts))
select p.doc_id, p.leaf, s.subroot, r.root, f.proof_sha256, f.digest as folded_root, f.digest = r.root as verified
from places p join subroots s on p.source is not distinct from s.source join folds f on p.source is not distinct from f.source and p.place = f.place and f.done = len(f.lefts), root r"""
