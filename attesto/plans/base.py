"""What the modules of queries share: the registry, the tables as a corpus, its index, and the SQL of both.

Documents stand for the corpus: lang is the source type, source the jurisdiction and the
ticker, and the day follows from the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..operators.tables import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ASKED, PHRASE, ALL = "that with from that", "of the", "the and that"
TERMS = "('that', 2), ('with', 1), ('from', 1)"
MARKERS = ("the the", "of the", "de la")
DIGITS = 6

DOCS = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, lang AS source_type, 'public' AS venue_type, source AS jurisdiction, source AS ticker,
  CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) AS date, 'link:' || doc_id AS deep_link, doc_id AS ord FROM documents)"""
TOKENS = r"""tok AS (SELECT id, ts, len(ts) AS length FROM (SELECT id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}]+') AS ts FROM docs)),
pos AS (SELECT id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM tok),
post AS (SELECT term, id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM pos GROUP BY term, id),
stat AS (SELECT count(*) AS n, avg(length) AS average FROM tok)"""
BASE = f"WITH {DOCS}, {TOKENS}"


def bm25_sql(terms: str = TERMS, k1: str = "1.5", b: str = "0.75", idf: str = "ln(1 + (n - df + 0.5) / (df + 0.5))") -> str:
    return f"""q AS (SELECT * FROM (VALUES {terms}) x(term, times)),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT id, round(sum(times * {idf} * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / average))), {DIGITS}) AS score
  FROM post JOIN q USING (term) JOIN df USING (term) JOIN tok USING (id) CROSS JOIN stat GROUP BY id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) x({names})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("source_type"), F.lit("public").alias("venue_type"), F.col("source").alias("jurisdiction"), F.col("source").alias("ticker"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("string").alias("date"), F.concat(F.lit("link:"), "doc_id").alias("deep_link"), F.col("doc_id").alias("ord"),
    )


_saved: dict[tuple[str, str], str] = {}


def build_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """Builds and saves the corpus' index, and loads it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = f"{shared_dir(spark)}/index-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    index.build(corpus(spark, sf_dir)).save(path)
    _saved[key] = path
    return index.Index.load(spark, path)


def built(spark: SparkSession, sf_dir: str) -> index.Index:
    """The saved index, built once an application and folder; searches read it."""
    path = _saved.get((spark.sparkContext.applicationId, sf_dir))
    return index.Index.load(spark, path) if path else build_index(spark, sf_dir)


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that follows from a folder's, written once an application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#{name}")
    if key not in _saved:
        path = f"{shared_dir(spark)}/{name}-{hashlib.md5(sf_dir.encode()).hexdigest()}"
        make().write.mode("overwrite").parquet(path)
        _saved[key] = path
    return spark.read.parquet(_saved[key])
