"""The engine from SQL: views of an index and functions for texts.

After register(), for instance:

    SELECT id, sum(bm25) FROM hits WHERE term IN ('substation', 'permit') GROUP BY id ORDER BY 2 DESC LIMIT 10
    SELECT d.id, q.* FROM docs d, LATERAL quantities(d.text) q
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import extract, scoring, text
from ..functions.udf import reachable
from ..operators.index import Index


def register(spark: SparkSession, index: Index | None = None) -> None:
    """Registers analyze, claims and verdict as functions, quantities as a table function, and an index' tables as views; workers get the package."""
    reachable(spark)

    def analyze(x: pd.Series) -> pd.Series:
        return x.map(text.analyze_text)

    def claims(x: pd.Series) -> pd.Series:
        return x.map(extract.claims_of)

    def verdict(x: pd.Series) -> pd.Series:
        return x.map(lambda said: extract.verdict_of(said)[0])

    for name, f, kind in (("analyze", analyze, "array<string>"), ("claims", claims, "array<string>"), ("verdict", verdict, "string")):
        f.__annotations__ = {"x": pd.Series, "return": pd.Series}
        spark.udf.register(name, F.pandas_udf(f, kind))

    class Quantities:
        def eval(self, body: str) -> Iterator[tuple]:
            for q in extract.quantities_of(body):
                yield q["kind"], q["value"], q["unit"], q["cadence"], q["raw_span"]

    spark.udtf.register("quantities", F.udtf(Quantities, returnType="kind string, value double, unit string, cadence string, raw_span string"))
    if index is not None:
        for name in ("docs", "postings", "term_stats", "doc_stats", "corpus_stats"):
            getattr(index, name).createOrReplaceTempView(name)
        rows = index.postings.join(index.term_stats, "term").crossJoin(F.broadcast(index.corpus_stats))
        rows.select("id", "term", "tf", scoring.bm25(*(F.col(c) for c in ("tf", "df", "n", "length", "average"))).alias("bm25")).createOrReplaceTempView("hits")
