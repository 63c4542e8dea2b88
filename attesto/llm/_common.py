"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udf import reachable
from ..operators.tables import cleared, shared_dir, small, written

__all__ = ["WORD", "blocks", "chars", "cleared", "in_arrow", "partitions", "shared_dir", "shielding", "small", "table", "utf8", "written"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, where a session has Spark's own 64 MB: a worker and its executor hold a few batches each.
BATCH, SPARKS_BATCH = "8m", ("64m", "64MB", "67108864", "67108864b")


def in_arrow(df: DataFrame, f: Callable, ddl) -> DataFrame:
    """df.mapInArrow() by workers that can import this package, in batches of BATCH bytes."""
    spark = df.sparkSession
    reachable(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", SPARKS_BATCH[0]) in SPARKS_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df.mapInArrow(f, ddl)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20):
    """(first, last) row ranges of about limit bytes each; a longer row is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def chars(text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))


def _shield(columns: list[str]) -> dict[str, str]:
    """Other names for columns that begin as an operator's own do."""
    return {c: f"kept_{i}_of_{len(columns)}" + "_" * max(map(len, columns)) for i, c in enumerate(columns) if c.startswith("__")}


def shielding(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Decorates an operator whose own columns begin with two underscores, and that keeps its first argument's: these may have any name."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        others = _shield(docs.columns)
        if not others:
            return f(docs, *args, **named)
        args = tuple([others.get(c, c) for c in a] if isinstance(a, list) else a for a in args)
        return f(docs.withColumnsRenamed(others), *args, **named).withColumnsRenamed({v: k for k, v in others.items()})

    return run
