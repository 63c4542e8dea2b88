"""Vectors: hashes, exact cosine top-k, guarded semantic search, embedding with call-level dedupe."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scoring import dot, norm, normalised
from ..functions.text import content_hash
from ..functions.udf import in_arrow

INPUT_CHARS = 24_000


#: Vectors of a packed block.
BLOCK = 4096


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an Arrow column of lists, and which rows have one: of this width, all components finite."""
    n = len(column)
    sizes = np.zeros(n, np.int64)
    sizes[:] = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten()  # without what null rows may cover
    flat = (pc.fill_null(values, float("nan")) if values.null_count else values).to_numpy(zero_copy_only=False)
    fits = sizes == width
    if not fits.all():
        flat = flat[np.repeat(fits, sizes)]
    matrix = flat.reshape(-1, width)
    good = np.isfinite(matrix).all(1)
    fits[np.flatnonzero(fits)[~good]] = False
    return matrix[good], fits


def _cosines(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row by itself, so that equal vectors score the same; 0 for a vector of length 0."""
    out = np.zeros(len(matrix))
    for a in range(0, len(matrix), 1024):
        part = matrix[a : a + 1024].astype(np.float64)
        lengths = np.sqrt(np.einsum("ij,ij->i", part, part)) * math.sqrt(float(query @ query))
        np.divide(np.einsum("ij,j->i", part, query), lengths, out=out[a : a + 1024], where=lengths > 0)
    return out


def _rounded(scores: np.ndarray, digits: int) -> np.ndarray:
    """Half up on the decimal text, as SQL rounds."""
    values, at = np.unique(scores, return_inverse=True)
    step = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(float(x))).quantize(step, ROUND_HALF_UP)) for x in values] or [0.0])[at]


def _best_rows(matrix: np.ndarray, query: np.ndarray, order: list, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows, ties by order. One product in the vectors' own precision says which rows can be among them."""
    if not len(matrix) or k <= 0:
        return np.zeros(0, np.int64), np.zeros(0)
    near = np.arange(len(matrix))
    if len(matrix) > 4 * k:
        with np.errstate(all="ignore"):
            squares = np.einsum("ij,ij->i", matrix, matrix)
            rough = (matrix @ query.astype(matrix.dtype)) / (np.sqrt(squares).astype(np.float64) * math.sqrt(float(query @ query)))
            odd = ~((squares > 1e-30) & (squares < 1e30) & np.isfinite(rough))  # beyond this precision: looked at again
        rough[odd] = -np.inf
        slack = 2 * (np.finfo(matrix.dtype).eps * (matrix.shape[1] + 8)) + (0 if digits is None else 10.0**-digits)
        near = np.flatnonzero(odd | (rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack))
    scores = _cosines(matrix[near], query)
    if digits is not None:
        scores = _rounded(scores, digits)
    ranked = sorted(range(len(near)), key=lambda i: (-scores[i], order[near[i]]))[:k] if len(near) <= 8 * k + 1024 else _by_cut(scores, [order[i] for i in near], k)
    return near[ranked], scores[ranked]


def _by_cut(scores: np.ndarray, order: list, k: int) -> list[int]:
    """The k first by score and order where many tie: only those that reach the kth score are sorted."""
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    return sorted(np.flatnonzero(scores >= cut).tolist(), key=lambda i: (-scores[i], order[i]))[:k]


def _partial(query: np.ndarray, k: int, order: str, vec: str, digits: int | None):
    """The best rows of a task, batch by batch; the running ones go through the next batch's cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            matrix, fits = _matrix(batch.column(vec), len(query))
            rows = batch.filter(pa.array(fits))
            at, scores = _best_rows(matrix, query, rows.column(order).to_pylist(), k, digits)
            new = pa.Table.from_batches([rows.take(pa.array(at))]).append_column("score", pa.array(scores, pa.float64()))
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows > k:
                keys = list(zip((-held.column("score").to_numpy()).tolist(), held.column(order).to_pylist()))
                held = held.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__)[:k]))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def cosine_top_k(store: DataFrame, query: list[float], k: int, order: str = "row", vec: str = "vec", digits: int | None = None) -> DataFrame:
    """The k rows of greatest cosine with query, ties by order; score and rank.

    Vectors of the store are of length 1, or of any length: the cosine divides by it. Each Arrow batch is one matrix,
    a task gives its k best rows, and these meet in one small merge. Rows whose vector is null, of another width, or
    holds a component that is null or not finite take no part.
    """
    kept = store.drop("score")
    best = in_arrow(kept, _partial(np.array(query, np.float64), max(0, k), order, vec, digits), T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))
    return _top(best, k, order)


def cosines(store: DataFrame, query: list[float], vec: str = "vec", digits: int | None = None) -> DataFrame:
    """The store's other columns with the score of each row, batch by batch; rows without a whole vector take no part."""
    asked = np.array(query, np.float64)
    others = [c for c in store.columns if c not in (vec, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, fits = _matrix(batch.column(vec), len(asked))
            scores = _cosines(matrix, asked)
            kept = batch.select(others).filter(pa.array(fits))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores if digits is None else _rounded(scores, digits), pa.float64())], [*others, "score"])

    schema = T.StructType([*(store.schema[c] for c in others), T.StructField("score", T.DoubleType())])
    return in_arrow(store.select(*others, vec), run, schema)


def packed(store: DataFrame, order: str = "row", vec: str = "vec", size: int = BLOCK, half: bool = False) -> DataFrame:
    """Blocks of vectors: ids (the order column), width, and the vectors as packed floats of four bytes, or two (half), row after row.

    Half precision is for vectors of length 1; a component beyond it is an error.

    A block is what a task reads next to each other, size rows at most and of one width. Vectors that are null, or hold a
    component that is null or not finite, are left out; so a packed store answers as cosine_top_k() does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.fill_null(pc.list_value_length(batch.column(vec)), 0).to_numpy(zero_copy_only=False)
            for width in np.unique(widths[widths > 0]).tolist():
                matrix, fits = _matrix(batch.column(vec), width)
                ids = batch.column(order).filter(pa.array(fits))
                for a in range(0, len(matrix), size):
                    part = np.ascontiguousarray(matrix[a : a + size], "<f4")
                    if half:
                        if (np.abs(part) > HALF_MAX).any():
                            raise ValueError("component beyond half precision")
                        part = part.astype("<f2")
                    mine = ids.slice(a, size)
                    lists = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine)
                    yield pa.RecordBatch.from_arrays([lists, pa.array([width], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["ids", "width", "vectors"])

    kind = store.schema[order].dataType
    return in_arrow(store.select(order, vec), run, T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("width", T.IntegerType()), T.StructField("vectors", T.BinaryType())]))


def packed_top_k(blocks: DataFrame, query: list[float], k: int, order: str = "row", digits: int | None = None) -> DataFrame:
    """cosine_top_k() over packed blocks: order, score and rank. A block is one product; bytes go through as they are."""
    asked = np.array(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            for i in range(len(batch)):
                if batch.column("width")[i].as_py() != len(asked):
                    continue
                ids, raw = batch.column("ids")[i].values, batch.column("vectors")[i].as_buffer()
                kind_ = "<f2" if len(raw) == 2 * len(asked) * len(ids) else "<f4"
                matrix = np.frombuffer(raw, kind_).reshape(-1, len(asked)).astype("<f4", copy=False)
                at, scores = _best_rows(matrix, asked, _Lazy(ids), k, digits)
                best = sorted([*best, *zip((-scores).tolist(), ids.take(pa.array(at)).to_pylist())])[:k]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in best], kind), pa.array([-x[0] for x in best], pa.float64())], [order, "score"])

    element = blocks.schema["ids"].dataType.elementType
    kind = to_arrow_type(element)
    best = in_arrow(blocks.select("ids", "width", "vectors"), run, T.StructType([T.StructField(order, element), T.StructField("score", T.DoubleType())]))
    return _top(best, k, order)


class _Lazy:
    """Values of an Arrow array, made one by one where they are asked for."""

    def __init__(self, values: pa.Array):
        self.values = values

    def __getitem__(self, i):
        return self.values[int(i)].as_py()


def cosine(x, y):
    """The cosine of two columns of vectors, for where both differ by row; one query goes through cosine_top_k() or cosines()."""
    lengths = norm(x) * norm(y)
    return F.when(lengths > 0, dot(x, y) / lengths).otherwise(0.0)


def _top(rows: DataFrame, k: int, order: str) -> DataFrame:
    best = rows.orderBy(F.desc("score"), order).limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), order)))


def covered_top_k(store: DataFrame, chunks: DataFrame, query: list[float], k: int, digits: int | None = None) -> DataFrame:
    """cosine_top_k among vectors that have a chunk: the semi-join comes before the cut."""
    return cosine_top_k(store.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), query, k, order="chunk_id", digits=digits)


def semantic_search(store: DataFrame, chunks: DataFrame, query: list[float], k: int, digits: int | None = None) -> DataFrame:
    """chunk_id, score, rank and the chunk of the best chunks; with digits, by rounded scores, so that ties go by chunk_id.

    Every chunk must have a vector, and each row that is returned the hash of its chunk's
    text; otherwise an error says so. Only returned rows are hashed.
    """
    if k <= 0:
        return chunks.limit(0)
    missing = chunks.join(store, "chunk_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} chunks have no embedding")
    hits = covered_top_k(store, chunks, query, k, digits).join(chunks, "chunk_id")
    good = content_hash(F.col("model"), F.col("dim"), F.col("text")) == F.col("content_hash")
    return hits.withColumn("score", F.when(good, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("stale embedding of "), F.col("chunk_id")))))


def check_store(store: DataFrame, model: str, dim: int) -> None:
    """Errors for repeated ids, vectors of another width, foreign model or dimension, components that are not finite."""
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    row = store.agg(
        F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_if(F.size("vec") != dim).alias("width"),
        F.count_if((F.col("model") != model) | (F.col("dim") != dim)).alias("foreign"), F.count_if(bad).alias("bad"),
    ).first()
    for wrong, what in ((row.n != row.ids, "repeated chunk ids"), (row.width, "vectors of another width"), (row.foreign, "another model or dimension"), (row.bad, "components that are not finite")):
        if wrong:
            raise ValueError(f"embedding store: {what}")


def embed_corpus(pairs: DataFrame, provider: Callable[[list[str]], list[list[float]]], model: str, dim: int, existing: DataFrame | None = None, batch: int = 512) -> DataFrame:
    """Rows for the store: (chunk_id, content_hash, vec, model, dim, truncated) of pairs (chunk_id, text) it lacks.

    The hash is of the full text, the provider gets its first INPUT_CHARS characters and
    each distinct hash once; equal texts share the vector. Runs again after a stop: what
    is in existing is skipped.
    """
    twice = pairs.groupBy("chunk_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated chunk id {twice[0].chunk_id!r}")
    rows = pairs.withColumn("content_hash", content_hash(F.lit(model), F.lit(dim), F.col("text")))
    if existing is not None:
        rows = rows.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    distinct = rows.groupBy("content_hash").agg(F.first(F.substring("text", 1, INPUT_CHARS)).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield pd.DataFrame({"content_hash": part.content_hash, "vec": provider(part.text.tolist())})

    vectors = distinct.mapInPandas(run, "content_hash string, vec array<float>").withColumn("vec", normalised(F.col("vec")))
    return rows.join(vectors, "content_hash").select(
        "chunk_id", "content_hash", "vec", F.lit(model).alias("model"), F.lit(dim).alias("dim"), (F.length("text") > INPUT_CHARS).alias("truncated")
    )


HALF_MAX = 65504.0


def half(x):
    """A vector rounded to half precision, as a store of two bytes a component would hold it; still floats."""
    mantissa = lambda v: F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14.0)) - 10)
    one = lambda v: F.when(v == 0, v).otherwise(F.bround(v.cast("double") / mantissa(v), 0) * mantissa(v))
    return F.transform(x, lambda v: F.when(F.abs(v) > HALF_MAX, F.raise_error(F.lit("component beyond half precision"))).otherwise(one(v)).cast("float"))


def _embedded(provider: Callable[[list[str]], list[list[float]]], batch: int):
    """Vectors of rows in order of their texts' hash: one call for each text without one, however many rows and frames it spans."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = made = None
        for f in frames:
            asked = f[f["_vec"].isna() & (f["content_hash"] != last)].drop_duplicates("content_hash")
            found = {} if last is None else {last: made}
            for a in range(0, len(asked), batch):
                part = asked.iloc[a : a + batch]
                found.update(zip(part["content_hash"], provider(part["text"].fillna("").tolist())))
            out = f.drop(columns="text")
            out["vec"] = [None if known is not None else found[h] for h, known in zip(f["content_hash"], f["_vec"])]
            if len(f) and f["_vec"].iloc[-1] is None:
                last = f["content_hash"].iloc[-1]
                made = found[last]
            yield out

    return run


def embed_in_steps(pairs: DataFrame, provider: Callable[[list[str]], list[list[float]]], model: str, dim: int, path: str, every: int = 50_000, batch: int = 512) -> DataFrame:
    """embed_corpus() by steps of about every pairs, each in the store below path as soon as it is done.

    What the store lacks is found once and dealt once: a step is a task of one job, so steps run side by side, and its file
    moves to the store when the task commits, not when the job does. Equal texts fall into one step, as steps go by the
    text's hash, and a text whose vector the store has takes that one. A run that was stopped goes on with what is missing.
    """
    from .tables import exists

    spark = pairs.sparkSession
    twice = pairs.groupBy("chunk_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated chunk id {twice[0].chunk_id!r}")
    due = pairs.select("chunk_id", F.substring("text", 1, INPUT_CHARS).alias("text"), content_hash(F.lit(model), F.lit(dim), F.col("text")).alias("content_hash"), (F.length("text") > INPUT_CHARS).alias("truncated"))
    held = spark.read.parquet(path) if exists(spark, path) else None
    if held is not None:
        known = held.select("content_hash", F.col("vec").alias("_vec")).dropDuplicates(["content_hash"])
        due = due.join(held.select("chunk_id"), "chunk_id", "left_anti").join(known, "content_hash", "left")
    else:
        due = due.withColumn("_vec", F.lit(None).cast("array<float>"))
    steps = max(1, -(-pairs.count() // every))
    dealt = due.select("chunk_id", "content_hash", "truncated", "_vec", "text").repartition(steps, "content_hash").sortWithinPartitions("content_hash")
    made = dealt.mapInPandas(_embedded(provider, batch), "chunk_id string, content_hash string, truncated boolean, _vec array<float>, vec array<float>")
    rows = made.select("chunk_id", "content_hash", F.coalesce("_vec", normalised(F.col("vec"))).alias("vec"), F.lit(model).alias("model"), F.lit(dim).alias("dim"), "truncated")
    # Hadoop's second way to commit: a finished task's file is there at once, and one that is made again has the same name.
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return spark.read.parquet(path)


Provider = Callable[[list[str]], list[list[float]]]
PROVIDERS: dict[str, Callable[..., Provider]] = {}


def register_provider(name: str):
    """Decorates a factory of providers; provider(name) finds it."""

    def add(factory: Callable[..., Provider]) -> Callable[..., Provider]:
        PROVIDERS[name] = factory
        return factory

    return add


def provider(name: str, **options) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known are {', '.join(sorted(PROVIDERS)) or 'none'}")
    return PROVIDERS[name](**options)


def limited(call: Provider, texts: int = 512, chars: int = 1_000_000, retries: int = 4, wait: float = 1.0) -> Provider:
    """call with at most so many texts and characters at once, tried again after a growing wait when it fails or returns too few vectors."""

    def once(part: list[str]) -> list[list[float]]:
        for attempt in range(retries + 1):
            try:
                found = call(part)
                if len(found) == len(part):
                    return found
                error: Exception = ValueError(f"{len(found)} vectors for {len(part)} texts")
            except Exception as failed:  # the last failure is raised below
                error = failed
            if attempt < retries:
                time.sleep(wait * 2**attempt)
        raise error

    def run(batch: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        part: list[str] = []
        for t in batch:
            if part and (len(part) >= texts or sum(map(len, part)) + len(t) > chars):
                out += once(part)
                part = []
            part.append(t)
        return out + (once(part) if part else [])

    return run


def entry_for(store: DataFrame, chunk_id: str) -> DataFrame:
    """The row of one chunk; an error if there is none."""
    found = store.where(F.col("chunk_id") == chunk_id)
    if not found.limit(1).count():
        raise KeyError(chunk_id)
    return found


def rows_for(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("chunk_id"), "chunk_id", "left_semi")
