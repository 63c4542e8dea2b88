"""Exact top-k inner products by KD-trees, one for each shard of the vectors.

A tree splits a shard at the median of its widest dimension down to small leaves; each
node has the tight bounding box of its points. The largest inner product that a box can
hold with a query is the sum of each dimension's better corner. A query visits the leaves
of a tree best bound first, which is the order that a queue of nodes would give, as no
child's bound exceeds its parent's, and stops at the first bound below its kth score so
far. Queries of a block go through a tree together: in each round every query that is not
done visits its next leaf, and those at one leaf are one product of matrices.

Trees are built once and written. Queries search their home shard's first; the kth score
of that goes along, and a query is sent only to shards whose root box reaches it, which
blocks of queries and of root boxes find out. Shards and blocks are of fixed size, so
neither all vectors nor all queries ever meet in a task or at the driver.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import reachable
from ._common import written

#: Vectors of a shard, queries of a block, root boxes of a block, points of a leaf.
SHARD, QUERIES, BOXES, LEAF = 8192, 2048, 4096, 256
NONE = -(2**63)
FOUND = "query_id long, vec_id long, score long"


class Tree:
    """Points in order of leaves, their ids, each leaf's span and box."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int):
        # Equal vectors score alike and ties go to the least ids, so more than k + 1 of them (one may be the query) never count.
        order = np.lexsort((ids, *points.T[::-1]))
        new = np.ones(len(order), bool)
        new[1:] = (points[order[1:]] != points[order[:-1]]).any(1)
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[np.arange(len(order)) - first <= k]
        spans = []

        def split(a: int, b: int) -> None:
            own = points[order[a:b]]
            reach = own.max(0) - own.min(0)
            widest = int(reach.argmax())
            if b - a > LEAF and reach[widest] > 0:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, widest], half)]
                split(a, a + half)
                split(a + half, b)
            else:
                spans.append((a, b))

        split(0, len(order))
        self.points, self.ids, self.spans = points[order], ids[order], np.array(spans)
        self.low = np.array([self.points[a:b].min(0) for a, b in spans])
        self.high = np.array([self.points[a:b].max(0) for a, b in spans])

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, ids=self.ids, spans=self.spans, low=self.low, high=self.high)
        return out.getvalue()

    @classmethod
    def unpacked(cls, blob: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as held:
            tree.__dict__.update({name: held[name] for name in held.files})
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the k best of each query, its own id left out, that reach its least score."""
        exact = _exact(queries, self.points)
        queries, points, low, high = (x.astype(exact) for x in (queries, self.points, self.low, self.high))
        none = -np.inf if exact is float else NONE
        kth = np.where(least == NONE, none, least.astype(exact))
        limits = bounds(queries, low, high)
        visits = np.argsort(-limits, 1, kind="stable")
        best = np.full((len(queries), k), none, exact)
        active, hits = np.arange(len(queries)), []
        for turn in range(len(self.spans)):
            leaf = visits[active, turn]
            on = limits[active, leaf] >= kth[active]
            active, leaf = active[on], leaf[on]
            if not len(active):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by_leaf], prepend=-1))
            for x, y in zip(cuts, [*cuts[1:], len(by_leaf)], strict=True):
                rows = active[by_leaf[x:y]]
                a, b = self.spans[leaf[by_leaf[x]]]
                scores = queries[rows] @ points[a:b].T
                scores[own[rows][:, None] == self.ids[a:b]] = none
                best[rows] = np.partition(np.concatenate((best[rows], scores), 1), -k, 1)[:, -k:]
                kth[rows] = np.maximum(kth[rows], best[rows].min(1))
                r, c = np.nonzero((scores >= kth[rows][:, None]) & (scores > none))
                hits.append((rows[r], self.ids[a + c], scores[r, c]))
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        row, ids, scores = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((ids, -scores, row))
        order = order[scores[order] >= kth[row[order]]]
        row = row[order]
        first = np.searchsorted(row, row)
        order = order[np.arange(len(row)) - first < k]
        found = np.concatenate([x[0] for x in hits])[order]
        return found, ids[order], scores[order].astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each query and box, no less than the query's score with any point of the box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _exact(queries: np.ndarray, points: np.ndarray) -> type:
    """A type in which all sums are exact."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return float if queries.shape[1] * most(queries) * most(points) < 2**52 else np.int64


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(np.ascontiguousarray(matrix).ravel()))


def _build(k: int):
    def run(key, group):
        points = _matrix(group["vector"])
        tree = Tree(points, group["id"].to_numpy(), k)
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), _lists(points.min(0)[None]), _lists(points.max(0)[None]), pa.array([tree.packed()], pa.binary())]
        return pa.table(columns, ["size", "shard", "low", "high", "tree"])

    return run


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            own = left["id"].to_numpy()
            tree = Tree.unpacked(right["tree"][0].as_py())
            row, ids, scores = tree.search(_matrix(left["vector"]), own, k, left["least"].to_numpy())
            out = (own[row], ids, scores)
        return pa.table([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    return run


def _reach(left: pa.Table, right: pa.Table) -> pa.Table:
    """A row for each query and each shard but its own whose root box its kth score does not rule out."""
    names = ["id", "vector", "least", "size", "block", "shard"]
    if left.num_rows and right.num_rows:
        q, least, home = _matrix(left["vector"]), left["least"].to_numpy(), left["shard"].to_numpy()
        low, high, shards = _matrix(right["low"]), _matrix(right["high"]), right["shard"].to_numpy()
        exact = _exact(q, np.concatenate((low, high)))
        reached = bounds(*(x.astype(exact) for x in (q, low, high)))
        row, box = np.nonzero(((least == NONE)[:, None] | (reached >= least.astype(exact)[:, None])) & (home[:, None] != shards))
        both = [pa.array(np.full(len(row), left[c][0].as_py(), np.int32)) for c in ("size", "block")]
        return pa.table([pa.array(left["id"].to_numpy()[row]), _lists(q[row]), pa.array(least[row]), *both, pa.array(shards[box])], names)
    types = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.table([pa.array([], t) for t in types], names)


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id, vector array<long>: floor(scale * x) of each component as double; rows that take part."""
    x = F.col(vector_col)
    usable = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table.where(F.col(id_col).isNotNull()).where(usable)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def top_k(table: DataFrame, is_query, k: int = 20, **columns) -> DataFrame:
    """query_id, rank, vec_id, score of the k best inner products of each query with every other vector.

    is_query is a condition on id. Ties go to the lesser id. Vectors that are null, empty
    or hold a null or non-finite component take no part; null ids neither. Rows that share
    an id count as one, with the least vector. Vectors are compared with those of equal
    length only. Fewer than k candidates give fewer rows; an empty table none. Components
    so large that a score might not fit 64 bits are an error.
    """
    spark = table.sparkSession
    reachable(spark)
    points = written(vectors(table, **columns))
    most = F.max(F.greatest(F.array_max("vector"), -F.greatest(F.array_min("vector"), F.lit(NONE + 1))))
    n, queries, size, most = points.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("vector")), most).first()
    if n and size * most * most >= 2**63:
        raise OverflowError("scores may not fit 64 bits")
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-queries // QUERIES))
    home, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    rows = points.select("id", "vector", F.size("vector").alias("size"), home.alias("shard"))
    trees = written(rows.groupBy("size", "shard").applyInArrow(_build(k), "size int, shard int, low array<long>, high array<long>, tree binary"))
    asked = rows.where(is_query).withColumn("block", block)

    def search(q: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
        return written(q.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_search(k), FOUND))

    here = ["size", "shard"]
    near = search(asked.select("id", "vector", *here, F.lit(NONE).cast("long").alias("least")), trees.select(*here, "tree"), here)
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    others = asked.join(kth.select(F.col("query_id").alias("id"), "least"), "id", "left").withColumn("least", F.coalesce("least", F.lit(NONE)).cast("long"))
    others = others.withColumn("boxes", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // BOXES))))
    boxes = trees.select("size", "shard", "low", "high", F.floor(F.col("shard") / BOXES).cast("int").alias("boxes"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    where = ["size", "block", "boxes"]
    pairs = others.groupBy(*where).cogroup(boxes.groupBy(*where)).applyInArrow(_reach, "id long, vector array<long>, least long, size int, block int, shard int")
    pairs, there = written(pairs), ["size", "shard", "block"]
    wanted = pairs.select(*(F.col(c).alias(f"to_{c}") for c in there)).distinct()
    needed = trees.join(wanted, (F.col("size") == F.col("to_size")) & (F.col("shard") == F.col("to_shard"))).select(*here, F.col("to_block").alias("block"), "tree")
    far = search(pairs, needed, there)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
