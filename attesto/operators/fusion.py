"""Reciprocal rank fusion and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import RRF_K, reciprocal
from ..functions.text import head_snippet
from .ranking import global_rank
from .tables import written


def rrf_fuse(rankings: list[DataFrame], k: int = RRF_K, digits: int | None = None) -> DataFrame:
    """id, score: the sum of 1 / (k + rank) over rankings (id, rank from 1); absent ids add nothing."""
    if k <= 0:
        raise ValueError("k must be positive")
    union = reduce(DataFrame.unionByName, [r.select("id", "rank") for r in rankings])
    score = F.sum(reciprocal(F.col("rank"), k))
    return union.groupBy("id").agg((F.round(score, digits) if digits else score).alias("score"))


#: Results up to which a hybrid search counts ranks instead of sorting all hits.
COUNTED = 500


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int, depth: int | None = None, digits: int | None = None) -> DataFrame:
    """The k best of two scored rankings (id, score), fused; rank from 1, ties by id.

    depth bounds both arms before the fusion, which is an approximation; None is exact.
    """
    k = max(0, k)
    if depth is None and 0 < k <= COUNTED:
        return _counted(lexical, semantic, k, digits)
    arms = []
    for arm in (lexical, semantic):
        order = [F.desc("score"), F.col("id")]
        if depth is None:
            arms.append(global_rank(arm.select("id", "score"), order).select("id", "rank"))
        else:  # the limit bounds what the window sorts
            best = arm.orderBy(*order).limit(max(k, depth))
            arms.append(best.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank")))
    fused = rrf_fuse(arms, digits=digits).orderBy(F.desc("score"), "id").limit(k)
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


#: Bins of an arm's histogram of scores.
BINS = 4096


def _binned(arm: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """The arm's hits with their bin, and bin, before (hits of better bins) and held (hits of the bin): BINS rows at most.

    Bins are of equal width from the greatest score down; any that never put a better score behind a worse one would do.
    """
    low, high = arm.agg(F.min("score"), F.max("score")).first()
    scale = (BINS - 1) / (high - low) if low is not None and high > low else 0.0
    hits = arm.withColumn(f"bin{i}", F.least(F.floor((F.lit(float(high or 0.0)) - F.col("score")) * F.lit(scale)), F.lit(BINS - 1)).cast("int"))
    counts = sorted((r[0], r[1]) for r in hits.groupBy(f"bin{i}").count().collect())
    rows, before = [], 0
    for bin_, n in counts:
        rows.append((bin_, before, n))
        before += n
    bins = arm.sparkSession.createDataFrame(rows, f"bin{i} int, before{i} long, held{i} long")
    return hits, F.broadcast(bins)


def filtered_hybrid(lexical: DataFrame, semantic: DataFrame, kept: DataFrame, k: int, by_date: bool = False) -> DataFrame:
    """id, date and fused score of the k best of kept (id, date) by their ranks over all hits of two scored rankings; no arm is sorted.

    by_date sorts by day, newest first, before the score; ties are by id. A histogram of each arm's scores says between
    which ranks a hit lies, and so between which scores it is fused: the k best lower bounds of kept documents cut off
    all whose upper bound is below. Only for the bins of those that are left are hits put in order, each bin by itself.
    """
    arms = [_binned(written(arm.select("id", "score")), i) for i, arm in enumerate((lexical, semantic))]
    # A bin's first rank bounds a fused score from above, its last from below; nothing is added by an arm without the document.
    share = lambda rank: F.coalesce(reciprocal(rank), F.lit(0.0))
    parts = []
    for i, (hits, bins) in enumerate(arms):
        held = hits.join(bins, f"bin{i}").join(kept.select("id", "date"), "id").select("id", "date", F.col(f"bin{i}"), F.col(f"before{i}"), F.col(f"held{i}"))
        parts.append(held.select("id", "date", *(F.col(f"{c}{j}") if i == j else F.lit(None).cast("int" if c == "bin" else "long").alias(f"{c}{j}") for j in (0, 1) for c in ("bin", "before", "held"))))
    both = parts[0].unionByName(parts[1]).groupBy("id").agg(F.max("date").alias("date"), *(F.max(f"{c}{j}").alias(f"{c}{j}") for j in (0, 1) for c in ("bin", "before", "held")))
    day = F.coalesce("date", F.lit("")) if by_date else F.lit("")
    least = share(F.col("before0") + F.col("held0")) + share(F.col("before1") + F.col("held1"))
    most = share(F.col("before0") + 1) + share(F.col("before1") + 1)
    bounded = written(both.withColumns({"day": day, "least": least, "most": most}))
    last = bounded.orderBy(F.desc("day"), F.desc("least")).limit(k).agg(F.count("*"), F.min(F.struct("day", "least"))).first()
    left = bounded
    if last[0] >= k:
        left = bounded.where((F.col("day") > last[1]["day"]) | ((F.col("day") == last[1]["day"]) & (F.col("most") >= last[1]["least"] * (1 - 1e-12))))
    left = written(left.select("id", "date", "day", "bin0", "before0", "bin1", "before1"))
    fused = left
    for i, (hits, _) in enumerate(arms):
        wanted = F.broadcast(left.select(f"bin{i}").where(F.col(f"bin{i}").isNotNull()).distinct())  # BINS rows at most
        place = F.row_number().over(Window.partitionBy(f"bin{i}").orderBy(F.desc("score"), "id"))
        placed = hits.join(wanted, f"bin{i}", "left_semi").select("id", place.alias(f"place{i}"))
        fused = fused.join(placed, "id", "left")
    score = share(F.col("before0") + F.col("place0")) + share(F.col("before1") + F.col("place1"))
    return fused.withColumn("score", score).orderBy(F.desc("day"), F.desc("score"), "id").limit(k).select("id", "date", "score")


def _counted(lexical: DataFrame, semantic: DataFrame, k: int, digits: int | None) -> DataFrame:
    """hybrid() in full, without sorting all hits.

    The k first of an arm have 1 / (RRF_K + k) each at least, so whoever is not among the
    first 2 * (RRF_K + k) of either arm, with 2 / (RRF_K + that) at most, is not among the
    k best. The candidates, twice as many at most, are collected; where one is deep in the
    other arm, its rank is the count of hits above it, and one pass over the arm counts all.
    """
    spark = lexical.sparkSession
    reach = 2 * (RRF_K + k)
    arms = [written(arm.select("id", "score")) for arm in (lexical, semantic)]
    ranks: list[dict[str, int]] = []
    for arm in arms:
        best = arm.orderBy(F.desc("score"), "id").limit(reach).collect()
        ranks.append({r.id: i + 1 for i, r in enumerate(best)})
    for own, other, arm in ((ranks[0], ranks[1], arms[0]), (ranks[1], ranks[0], arms[1])):
        deep = arm.where(F.col("id").isin([x for x in other if x not in own])).collect() if len(own) >= reach and len(other) else []
        deep.sort(key=lambda r: (-r.score, r.id))
        if deep:
            above = F.lit(len(deep))
            for i, r in reversed(list(enumerate(deep))):  # the first candidate that a hit is above of
                above = F.when((F.col("score") > F.lit(r.score)) | ((F.col("score") == F.lit(r.score)) & (F.col("id") < F.lit(r.id))), i).otherwise(above)
            counts = {r.above: r.n for r in arm.groupBy(above.alias("above")).agg(F.count("*").alias("n")).collect()}
            total = 0
            for i, r in enumerate(deep):
                total += counts.get(i, 0)
                own[r.id] = total + 1
    fused = {i: sum(1.0 / (RRF_K + r[i]) for r in ranks if i in r) for i in {*ranks[0], *ranks[1]}}
    fused = spark.createDataFrame(list(fused.items()), "id string, score double")
    fused = fused.withColumn("score", F.round("score", digits)) if digits else fused
    best = fused.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def hybrid_rows(fused: DataFrame, docs: DataFrame, lexical: DataFrame | None = None) -> DataFrame:
    """fused with each document's snippet, that of its lexical hit (id, snippet) if it has one, else its head."""
    rows = fused.join(docs.select("id", head_snippet(F.col("text")).alias("__head")), "id")
    if lexical is not None:
        rows = rows.join(lexical.select("id", F.col("snippet").alias("__hit")), "id", "left")
    return rows.select("id", "score", "rank", F.coalesce("__hit", "__head").alias("snippet") if lexical is not None else F.col("__head").alias("snippet"))


def require_identity_chunks(chunks: DataFrame) -> DataFrame:
    """chunks; an error if one stands for anything but the one document of its id."""
    bad = chunks.where((F.size("doc_ids") != 1) | (F.col("doc_ids")[0] != F.col("chunk_id"))).limit(1).collect()
    if bad:
        raise ValueError(f"chunk {bad[0].chunk_id!r} is not one document")
    return chunks


def project_to_docs(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Each hit on a chunk as a hit on its first document; unknown ones are dropped."""
    rows = hits.join(chunks.select("chunk_id", F.get("doc_ids", F.lit(0)).alias("id")), "chunk_id")
    return rows.join(docs.select("id"), "id", "left_semi")
