"""python -m attesto build DOCS INDEX | search QUERY --index INDEX [...] | demo --index INDEX"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import search
from .operators.index import Index, assert_unique, build
from .sources.documents import read_snapshot

DEMO = ("substation permit", "water usage", "tax abatement")


def found(index: Index, query: str, k: int, op: str, phrase: bool, source: str | None) -> DataFrame:
    """The k best documents; a phrase's documents come in order of id."""
    filters = {"source_type": source} if source else {}
    if not phrase:
        return search.search(index, query, k, op, **filters)
    hits = search.phrase_search(index, query).join(search.filtered(index.docs, **filters), "id")
    return hits.selectExpr("id", "0.0 as score", "substring(text, 1, 160) as snippet").orderBy("id").limit(k)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="attesto")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("build")
    one.add_argument("docs")
    one.add_argument("index")
    for name in ("search", "demo"):
        one = commands.add_parser(name)
        if name == "search":
            one.add_argument("query")
        one.add_argument("--index", required=True)
        one.add_argument("--op", choices=("AND", "OR"), default="OR")
        one.add_argument("--phrase", action="store_true")
        one.add_argument("--k", type=int, default=10)
        one.add_argument("--source")
    args = parser.parse_args(argv)
    if args.command != "build" and args.k < 1:
        parser.error("--k must be at least 1")
    spark = spark or SparkSession.builder.appName("attesto").getOrCreate()
    if args.command == "build":
        build(assert_unique(read_snapshot(spark, args.docs))).save(args.index)
        return 0
    index = Index.load(spark, args.index)
    for query in [args.query] if args.command == "search" else DEMO:
        print(f"# {query}")
        for r in found(index, query, args.k, args.op, args.phrase, args.source).collect():
            print(f"{r.score:.4f}\t{r.id}\t{' '.join((r.snippet or '').split())}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
