"""Connected components of an edge table by alternating large-star and small-star steps.

No edge leaves the executors. Each round is two aggregations and two joins whose
exchanges Spark can split when one node has very many edges, and ends in a table in the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small, written

#: Edges from which a node's are joined by a broadcast of the node's row, and such rows that are broadcast at most. Tables
#: of fewer than FEW edges are not searched for such nodes.
HOT, BROADCAST_HOT, FEW = 2_000, 1_000_000, 10_000


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    up = both.where("v > u")
    out = up.join(least.drop("c"), "u")
    hot = written(least.where(F.col("c") > HOT).drop("c")) if edges >= FEW else None
    if hot is not None and hot.limit(1).count():  # a node with very many edges is not one task's work
        held = small(hot, BROADCAST_HOT)
        out = up.join(held, "u").unionByName(up.join(held.select("u"), "u", "left_anti").join(least.where(F.col("c") <= HOT).drop("c"), "u"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node that has an edge (u, v) to a smaller one; root is its component's least node.

    The least nodes themselves, loops and nulls give no row. Repeated edges count once.
    """
    e = written(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(e)
    while state[0]:
        e = written(_small_star(_large_star(e, state[0])))
        last, state = state, _state(e)
        if last == state:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
