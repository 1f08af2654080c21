"""Exact top-k inner products by dual-tree search over cover trees.

Rows are assigned to the nearest of a bounded number of pivots, whose cells have covering radii,
and packed into blocks of a bounded size; a cell with many rows (say, copies of one vector) is
spread over several blocks by identifier. Each block is indexed by a cover tree: every point
below a node lies within its covering radius, the children's radii are at most half the node's,
and their centres are farther apart than that; a node has as many children as that takes. In many
dimensions that is most of its points. Queries are packed and indexed in the same way.

A query block first searches one data block of its own cell; the k-th scores found there let
whole cells be dropped by their radii. The blocks of the other cells are met by query blocks that
are sent to them, each data block once; a pair of blocks is searched tree against tree: a pair
of nodes is pruned when the product of the centres, widened by both radii, stays below the
worst k-th score of the query node's queries. Of the children of a node those that are left and have
none themselves are compared together, in one product of matrices.

Defined results: vectors that are null, hold null or non-finite components, or have a null
vec_id take no part; missing components of shorter vectors count as 0; every row is a vector of
its own, so rows that share a query's vec_id are queries and candidates too, and only the row
itself is left out; ties go to the smaller vec_id; a query with fewer than k candidates gets
all; an empty table gives an empty one; other columns are not read; a vector's length is
bounded by what a row may hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

TOP, MOST_PIVOTS, MOST_ROWS, LEAST_ROWS, LEAF, TILE = 10, 256, 4096, 64, 8, 512
#: Blocks of a cell have its number, times this, and their own.
PARTS = 1_000_000
BLOCK = "block bigint, cell bigint, centre binary, radius double, rows binary, ids binary, points binary, nodes binary"


# -- cover tree ---------------------------------------------------------------------------


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the points, nodes): a node is (centre, radius, first, last, child, children);
    its points are order[first:last], its children follow each other in the list. A child's
    radius is at most half its parent's; a node without children holds its points themselves."""
    norms = (points * points).sum(1)

    def from_point(i: int, among: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, norms[among] + norms[i] - 2 * points[among] @ points[i]))

    order = np.arange(len(points))
    middle = int(from_point(0, order).argmin()) if len(points) else 0
    nodes = [[middle, from_point(middle, order).max(initial=0.0), 0, len(points), 0, 0]]
    at = 0
    while at < len(nodes):
        centre, radius, first, last, _, _ = nodes[at]
        among = order[first:last]
        if len(among) > LEAF and radius > 0:
            centres, apart = [centre], from_point(centre, among)
            owner = np.zeros(len(among), np.int64)
            while apart.max() > radius / 2:
                far = int(apart.argmax())
                new = from_point(among[far], among)
                owner[new < apart] = len(centres)
                apart = np.minimum(apart, new)
                centres.append(int(among[far]))
            if len(centres) > 1:
                nodes[at][4:] = [len(nodes), len(centres)]
                by = np.argsort(owner, kind="stable")
                order[first:last] = among[by]
                ends = first + np.cumsum(np.bincount(owner, minlength=len(centres)))
                for k, c in enumerate(centres):
                    begin = first if k == 0 else int(ends[k - 1])
                    nodes.append([c, apart[owner == k].max(initial=0.0), begin, int(ends[k]), 0, 0])
        at += 1
    return order, np.array(nodes, np.float64)


class Side:
    """One block, unpacked: points in tree order."""

    def __init__(self, rows: bytes, ids: bytes, points: bytes, nodes: bytes):
        self.rows, self.ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
        self.points = np.frombuffer(points, np.float64).reshape(len(self.ids), -1)
        self.nodes = np.frombuffer(nodes, np.float64).reshape(-1, 6)
        self.span = self.nodes[:, 2:].astype(np.int64)
        self.radius = self.nodes[:, 1]
        self.leaf = self.span[:, 3] == 0
        # whether a node has children that have children
        deep = np.concatenate([[0], np.cumsum(~self.leaf)])
        self.deep = ~self.leaf & (deep[self.span[:, 2] + self.span[:, 3]] > deep[self.span[:, 2]])
        # nodes hold the centre's place in the block's first order; packing turned it into a vector
        self.centres = self.points[self.nodes[:, 0].astype(np.int64)]
        self.lengths = np.sqrt((self.centres**2).sum(1))
        self.most = float(abs(self.points).max(initial=0))


def bound(product, length1, radius1, length2, radius2):
    """No two points of the two balls have a larger inner product; a hair wider, for rounding."""
    most = product + length1 * radius2 + length2 * radius1 + radius1 * radius2
    return most + 1e-9 * (abs(most) + length1 * length2) + 1e-6


def _places(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The places of several spans."""
    size = last - first
    return np.arange(int(size.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size)


class Search:
    """Top-k of every query of one block so far."""

    def __init__(self, queries: Side, top: int, floor: np.ndarray):
        self.q, self.top = queries, top
        n = len(queries.ids)
        self.scores = np.full((n, top), -np.inf)
        self.found = np.full((n, top), np.iinfo(np.int64).max)
        self.floor = floor.copy()  # a score that k candidates are known to reach
        self.met = self.pruned = 0  # pairs of nodes

    def run(self, data: Side) -> None:
        self.d = data
        self.exact = max(self.q.most, 1) * max(data.most, 1) * self.q.points.shape[1] < 2**53
        pairs = [(0, np.array([0]))]
        while pairs:
            a, some = pairs.pop()
            good = self.most(a, some) >= self.floor[self.q.span[a, 0] : self.q.span[a, 1]].min(initial=np.inf)
            self.met, self.pruned = self.met + len(some), self.pruned + len(some) - int(good.sum())
            some = some[good]
            if not self.q.deep[a] and len(some):
                some = some[self.reached(a, some)]
            leaves, inner = some[self.d.leaf[some]], some[~self.d.leaf[some]]
            if self.q.deep[a] and len(some) and self.q.radius[a] > self.d.radius[some].max():
                first, n = self.q.span[a, 2:]
                pairs += [(c, some) for c in range(first, first + n)]
                continue
            if len(leaves):
                self.compare(a, _places(self.d.span[leaves, 0], self.d.span[leaves, 1]))
            if len(inner):
                # the most promising is taken first, as its scores may prune the others
                for c in inner[np.argsort(self.most(a, inner), kind="stable")]:
                    first, n = self.d.span[c, 2:]
                    pairs.append((a, np.arange(first, first + n)))

    def reached(self, a: int, some: np.ndarray) -> np.ndarray:
        """Which nodes some query below a node may need, each query a node of radius 0."""
        rows = slice(*self.q.span[a, :2])
        x = self.q.points[rows]
        good = bound(x @ self.d.centres[some].T, np.sqrt((x**2).sum(1))[:, None], 0.0, self.d.lengths[some], self.d.radius[some]) >= self.floor[rows][:, None]
        self.met, self.pruned = self.met + good.size, self.pruned + good.size - int(good.sum())
        return good.any(0)

    def most(self, a: int, b: np.ndarray) -> np.ndarray:
        q, d = self.q, self.d
        return bound(d.centres[b] @ q.centres[a], q.lengths[a], q.radius[a], d.lengths[b], d.radius[b])

    def compare(self, a: int, cols: np.ndarray) -> None:
        """All queries of one node with some points, a tile of them at a time: what
        stays below a query's k-th score is left out before anything is sorted."""
        first, last = self.q.span[a, :2]
        for i in range(first, last, TILE):
            for j in range(0, len(cols), 4 * TILE):
                self.tile(slice(i, min(i + TILE, last)), cols[j : j + 4 * TILE])

    def tile(self, rows: slice, cols: np.ndarray) -> None:
        x, y = self.q.points[rows], self.d.points[cols]
        scores = x @ y.T if self.exact else (x.astype(np.int64) @ y.astype(np.int64).T).astype(np.float64)
        good = scores >= self.floor[rows][:, None]
        if scores.shape[1] > 4 * self.top:
            # no more than the k best of this tile and what ties with the last of them
            kth = np.partition(scores, scores.shape[1] - self.top - 1, axis=1)[:, -self.top - 1]
            good &= scores >= kth[:, None]
        good &= self.d.rows[cols][None, :] != self.q.rows[rows][:, None]
        for i in np.flatnonzero(good.any(1)):
            k, at = rows.start + i, np.flatnonzero(good[i])
            all_scores = np.concatenate([self.scores[k], scores[i, at]])
            ids = np.concatenate([self.found[k], self.d.ids[cols][at]])
            best = np.lexsort((ids, -all_scores))[: self.top]
            self.scores[k], self.found[k] = all_scores[best], ids[best]
        self.floor[rows] = np.maximum(self.floor[rows], self.scores[rows, -1])

    def found_rows(self) -> pa.RecordBatch:
        i, k = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(self.q.rows[i]), pa.array(self.q.ids[i]), pa.array(self.found[i, k]), pa.array(self.scores[i, k].astype(np.int64))], ["row", "query_id", "vec_id", "score"])


# -- blocks -------------------------------------------------------------------------------


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part, each component x as floor(1024 * x)."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), wide.alias("v")).where(F.forall("v", good))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda x: F.floor(x * 1024).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def placed(rows: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """``rows(row, vec_id, v)`` with the nearest pivot's ``cell`` and the distance to it."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            apart = (pivots**2).sum(1) - 2 * x @ pivots.T
            cell = apart.argmin(1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return written(rows.mapInArrow(nearest, "row bigint, vec_id bigint, v array<double>, cell bigint, far double"), "cover-cells")


def blocks(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """``rows(row, vec_id, v, cell)`` in blocks of about ``size`` rows at most, each with its tree."""

    def pack(key, table):
        table = table.combine_chunks()
        column = table.column("v").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.float64()))
        x, ids, own = _matrix(column, dim), np.asarray(table.column("vec_id")), np.asarray(table.column("row"))
        order, nodes = build(x)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes[:, 0] = place[nodes[:, 0].astype(np.int64)]
        centre = x[order[int(nodes[0, 0])]]
        cell, part = (k.as_py() for k in key)
        values = [[cell * PARTS + part], [cell], [centre.tobytes()], [float(nodes[0, 1])], *([v.tobytes()] for v in (own[order], ids[order], x[order], nodes))]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), *[pa.binary()] * 4)
        return pa.table([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["block", "cell", "centre", "radius", "rows", "ids", "points", "nodes"])

    # one count for each pivot
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    spread = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    return written(spread.select("cell", "part", "row", "vec_id", "v").groupBy("cell", "part").applyInArrow(pack, BLOCK), "cover-blocks")


def reachable(queries: DataFrame, floors: DataFrame, pivots: np.ndarray, reach: np.ndarray) -> DataFrame:
    """(q, cell): the cells that may hold a candidate at or over a query block's worst k-th score."""
    lengths = np.sqrt((pivots**2).sum(1))
    filled = np.flatnonzero(reach >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, centre, radius, floor in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = np.frombuffer(centre, np.float64)
                most = bound(pivots[filled] @ c, np.sqrt(c @ c), radius, lengths[filled], reach[filled])
                cells = filled[most >= (-np.inf if floor is None else floor)]
                yield pa.RecordBatch.from_pydict({"q": np.full(len(cells), q), "cell": cells})

    rows = queries.select(F.col("block").alias("q"), "centre", "radius").join(floors.select("q", "floor"), "q", "left")
    return rows.mapInArrow(run, "q bigint, cell bigint")


def search(pairs: DataFrame, queries: DataFrame, data: DataFrame, floors: DataFrame | None, top: int) -> DataFrame:
    """(row, query_id, vec_id, score): the best candidates of every pair (q, d) of blocks. A data
    block goes to one task, where the query blocks that it is paired with stream past it."""
    left = queries.select(F.col("block").alias("q"), "rows", "ids", "points", "nodes")
    left = left.join(floors.select("q", "floors"), "q", "left") if floors is not None else left.withColumn("floors", F.lit(None).cast("map<bigint,bigint>"))
    sent = pairs.select("q", "d").join(left, "q").select("d", F.lit(1).alias("side"), "q", "rows", "ids", "points", "nodes", "floors")
    held = data.select(F.col("block").alias("d"), F.lit(0).alias("side"), F.lit(-1).cast("long").alias("q"), "rows", "ids", "points", "nodes", F.lit(None).cast("map<bigint,bigint>").alias("floors"))
    held = held.join(pairs.select("d").distinct(), "d", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            for row in range(b.num_rows):
                side, _, own, ids, points, nodes, floors = (b.column(i)[row].as_py() for i in range(1, 8))
                now = Side(own, ids, points, nodes)
                if side == 0:
                    block = now
                    continue
                known = dict(floors or ())
                one = Search(now, top, np.array([known.get(i, -np.inf) for i in now.rows.tolist()], np.float64))
                one.run(block)
                yield one.found_rows()

    # the data block comes before its query blocks
    both = held.unionByName(sent).repartition("d").sortWithinPartitions("d", "side", "q")
    return both.select("d", "side", "q", "rows", "ids", "points", "nodes", "floors").mapInArrow(run, "row bigint, query_id bigint, vec_id bigint, score bigint")


def top_products(vectors: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, the rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors), "cover-rows")
    total, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, 1)
    size = max(LEAST_ROWS, min(MOST_ROWS, total // (4 * shuffle_partitions(spark)) + 1))
    # a bounded sample, only to place the rows
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(min(MOST_PIVOTS, total // size + 1)).collect()
    pivots = np.zeros((max(1, len(sample)), dim))
    for i, r in enumerate(sample):
        pivots[i, : len(r.v)] = r.v
    cells = placed(rows, pivots, dim)
    # one radius for each pivot, a hair wider for rounding
    reach = np.full(len(pivots), -1.0)
    for r in cells.groupBy("cell").agg(F.max("far").alias("far")).collect():
        reach[r.cell] = r.far * (1 + 1e-9) + 1e-6
    data, queries = blocks(cells, dim, size), blocks(cells.where(F.col("vec_id") % every == 0), dim, size)

    own = data.groupBy("cell").agg(F.min("block").alias("d"))
    start = written(queries.select(F.col("block").alias("q"), "cell").join(own, "cell").select("q", "d"), "cover-start")
    first = written(search(start, queries, data, None, top), "cover-first")
    # the k-th score of every query, where its first block has k candidates
    kth = first.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == top)
    members = queries.select(F.col("block").alias("q"), F.explode(_longs()(F.col("rows"))).alias("row"))
    floors = written(
        members.join(kth, "row", "left").groupBy("q").agg(
            F.map_from_entries(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("row", "score")))).alias("floors"),
            F.min(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))).alias("floor"),
        ),
        "cover-floors",
    )
    listed = data.select("cell", F.col("block").alias("d"))
    rest = written(reachable(queries, floors, pivots, reach).join(listed, "cell").select("q", "d").join(start, ["q", "d"], "left_anti"), "cover-pairs")
    more = search(rest, queries, data, floors, top)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return first.union(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _longs():
    """Packed identifiers as an array."""

    @F.pandas_udf("array<bigint>")
    def unpack(packed: pd.Series) -> pd.Series:
        return packed.map(lambda b: np.frombuffer(b, np.int64))

    return unpack
