"""Boolean, phrase and ranked search, filters and the result's tail."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import B, K1, bm25
from ..functions.text import analyze_text, centred_snippet, given, head_snippet, tokens
from .fusion import filtered_hybrid, hybrid, project_to_docs
from .index import Index, of_terms
from .tables import written
from .vectors import cosines


def _terms(df: DataFrame, query: str, schema: str, rows) -> DataFrame:
    """The query's terms; bounded by the query's own length, so broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(rows(analyze_text(query)), schema))


def boolean_search(index: Index, query: str, op: str = "OR") -> DataFrame:
    """id of the documents that hold every term (AND) or any (OR), in order of id; no terms, no documents."""
    if op not in ("AND", "OR"):
        raise ValueError(f"unknown operator {op!r}")
    words = sorted(set(analyze_text(query)))
    hits = index.of_terms(words)
    found = hits.groupBy("id").agg(F.count("*").alias("n"))  # a row for each term and document
    need = len(words) if op == "AND" else 1
    return found.where(F.col("n") >= need).select("id").orderBy("id")


def boolean_scan(docs: DataFrame, query: str, op: str = "OR") -> DataFrame:
    """boolean_search without an index: one pass, no shuffle."""
    if op not in ("AND", "OR"):
        raise ValueError(f"unknown operator {op!r}")
    words = F.array(*(F.lit(w) for w in sorted(set(analyze_text(query)))))
    held = tokens(F.col("text"))
    test = F.arrays_overlap(held, words) if op == "OR" else (F.size(F.array_except(words, held)) == 0) & (F.size(words) > 0)
    return docs.where(test).select("id")


def phrase_search(index: Index, phrase: str) -> DataFrame:
    """id of the documents that hold the words next to each other, in order; repeated words are no matter.

    Each position less the word's place is where the phrase would start; a start that all
    places agree on is a match. One aggregation of a row for each word of a document, with its
    starts as an array; no join of postings with each other.
    """
    words = analyze_text(phrase)
    places = _terms(index.postings, phrase, "term string, place int", lambda ws: [(w, i) for i, w in enumerate(ws)])
    starts = index.of_terms(words).join(places, "term").select("id", F.transform("positions", lambda x: x - F.col("place")).alias("starts"))
    full = starts.groupBy("id").agg(F.collect_list("starts").alias("s")).where(F.size("s") == len(words))
    common = F.reduce(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.get("s", F.lit(0)), F.array_intersect)
    return full.where(F.size(common) > 0).select("id").orderBy("id")


def phrase_scan(docs: DataFrame, phrase: str) -> DataFrame:
    """phrase_search without an index: one pass, no shuffle. Tokens hold no space, so the text of tokens between
    spaces holds the phrase between spaces where its words follow each other."""
    words = analyze_text(phrase)
    if not words:
        return docs.select("id").limit(0)
    return docs.where(F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" ")).contains(f" {' '.join(words)} ")).select("id")


def scores(index: Index, query: str, k1: float = K1, b: float = B, weight=None, ranges: DataFrame | None = None) -> DataFrame:
    """id, score of every document that holds a term; a repeated term counts as often as it is asked. ranges: as Index.of_terms()."""
    asked = _terms(index.postings, query, "term string, times int", lambda ws: sorted(Counter(ws).items()))
    extra = {"weight": weight} if weight else {}
    words = analyze_text(query)
    hits = index.of_terms(words, ranges).join(asked, "term").select("term", "id", "tf", "length", "times")
    # One row of corpus statistics, and one row a query term: both bounded, both broadcast.
    stats = F.broadcast(of_terms(index.term_stats, words).crossJoin(index.corpus_stats))
    hits = hits.join(stats, "term")
    score = F.col("times") * bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"), k1, b, **extra)
    return hits.groupBy("id").agg(F.sum(score).alias("score"))


def scan_scores(docs: DataFrame, query: str, k1: float = K1, b: float = B, weight=None, keep: list[str] | None = None) -> DataFrame:
    """scores() without an index: term counts are taken from each text, once; nothing is exploded.

    What the one pass finds of a document, a few numbers, is written; the corpus statistics
    are one row of it and cross to every document.
    """
    asked = sorted(Counter(analyze_text(query)).items())
    extra = {"weight": weight} if weight else {}
    times_in = lambda t, word: F.size(F.filter(t, lambda x: x == word))
    # A lambda's variable is evaluated once; a column of tokens would be taken from the text again for each count.
    all_counts = lambda t: F.struct(F.size(t).cast("long").alias("length"), *(times_in(t, w).alias(f"tf{i}") for i, (w, _) in enumerate(asked)))
    counted = written(docs.select("id", *(keep or []), F.inline(F.transform(F.array(tokens(F.col("text"))), all_counts))))
    stats = counted.agg(
        F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"),
        *(F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(asked))),
    )
    total = F.lit(0.0)
    for i, (_, times) in enumerate(asked):
        total = total + times * bm25(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("length"), F.col("average"), k1, b, **extra)
    some = F.greatest(F.lit(0), F.lit(0), *(F.col(f"tf{i}") for i in range(len(asked)))) > 0
    return counted.where(some).crossJoin(F.broadcast(stats)).select("id", *(keep or []), total.alias("score"))


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Ids of both sets (and), of either (or), or of the first only (not); each once."""
    a, b = a.select("id"), b.select("id")
    if how == "and":
        return a.intersect(b)
    if how == "or":
        return a.union(b).distinct()
    if how == "not":
        return a.distinct().join(b, "id", "left_anti")
    raise ValueError(f"unknown operation {how!r}")


def top(scored: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best by score, ties by id as text; rank from 1. k of 0 or less gives none."""
    score = F.round("score", digits) if digits else F.col("score")
    best = scored.withColumn("score", score).orderBy(F.desc("score"), "id").limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


#: Postings of a query's terms from which a ranked search looks at its blocks' bounds first, and ranges that set the first score.
SKIP_FROM, FIRST_RANGES = 5_000_000, 16
#: Ranges up to which those that can reach the kth score are broadcast; beyond, all are read.
BROADCAST_RANGES = 100_000


def bounds(index: Index, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """segment, range, blocks, bound: what no document of a range can exceed, from the blocks' greatest counts and least lengths alone.

    A score grows with the count and falls with the length, and a range is the same for all terms, so the sum over
    the terms' blocks of a range is a bound of the whole score, for all k1 and b from 0 to 1.
    """
    words = analyze_text(query)
    asked = _terms(index.docs, query, "term string, times int", lambda ws: sorted(Counter(ws).items()))
    stats = F.broadcast(of_terms(index.term_stats, words).crossJoin(index.corpus_stats))
    heads = index.heads(words).withColumnRenamed("n", "held").join(asked, "term").join(stats, "term")
    most = F.col("times") * bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"), k1, b)
    return heads.groupBy("segment", "range").agg(F.count("*").alias("blocks"), F.sum("held").alias("postings"), F.sum(most).alias("bound"))


def worth_reading(index: Index, query: str, k: int, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
    """bounds(), and those ranges of it that can hold one of the k best.

    The ranges of the greatest bounds are read first, and their kth score cuts the others: what cannot reach it is not
    unpacked. Nothing but that score comes to the driver.
    """
    every = written(bounds(index, query, k1, b))
    first = every.orderBy(F.desc("bound"), "segment", "range").limit(FIRST_RANGES)
    found = scores(index, query, k1, b, ranges=first.select("segment", "range")).orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
    if k <= 0 or found[0] < k:
        return every, every
    return every, every.where(F.col("bound") >= found[1] * (1 - 1e-9) - 1e-9)


def best_scores(index: Index, query: str, k: int, k1: float = K1, b: float = B, least: int = SKIP_FROM) -> DataFrame:
    """scores() of the k best at least, and of no others that need not be read; in full where there are fewer than least postings."""
    words = sorted(set(analyze_text(query)))
    if not index.segments or not words or (of_terms(index.term_stats, words).agg(F.sum("df")).first()[0] or 0) < least:
        return scores(index, query, k1, b)
    every, kept = worth_reading(index, query, k, k1, b)
    few = kept.select("segment", "range").limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    return scores(index, query, k1, b, ranges=kept.select("segment", "range") if few else None)


def ranked_search(index: Index, query: str, k: int = 10, k1: float = K1, b: float = B, op: str = "OR", least: int = SKIP_FROM) -> DataFrame:
    """id, score, rank by BM25; with op AND only documents that hold every term are ranked.

    A saved index is read in blocks, and of queries with many postings only those blocks that can reach the kth score.
    """
    if op == "AND":
        return top(scores(index, query, k1, b).join(boolean_search(index, query, "AND"), "id", "left_semi"), k)
    return top(best_scores(index, query, k, k1, b, least), k)


def filtered(docs: DataFrame, source_type=None, venue_type=None, ticker=None, jurisdiction=None, date_from=None, date_to=None) -> DataFrame:
    """Equalities and a range of ISO dates, compared as text; a missing date is in no range."""
    for name, value in (("source_type", source_type), ("venue_type", venue_type), ("ticker", ticker), ("jurisdiction", jurisdiction)):
        if value is not None:
            docs = docs.where(F.col(name) == value)
    if date_from is not None:
        docs = docs.where(F.coalesce(given(F.col("date")), F.lit("")) >= date_from)
    if date_to is not None:
        docs = docs.where(given(F.col("date")) <= date_to)
    return docs


def _snippet(query: str):
    """Around the first of the query's words, else the head; for the few rows of a result."""
    words = sorted(set(analyze_text(query)))
    return centred_snippet(F.col("text"), F.array(*(F.lit(w) for w in words))) if words else head_snippet(F.col("text"))


FIELDS = ("source_type", "venue_type", "date", "deep_link", "ticker", "jurisdiction")


def search(index: Index, query: str, k: int = 10, op: str = "OR", sort: str = "relevance", **filters) -> DataFrame:
    """Result rows of a lexical search: id, score, snippet and the document's fields.

    Filters come before the cut, and statistics are those of the whole corpus. date_desc
    sorts by day, rows of one day by relevance. The order is a top k, so no rank over all
    hits is made.
    """
    found = scores(index, query)
    if op == "AND":
        found = found.join(boolean_search(index, query, "AND"), "id", "left_semi")
    docs = filtered(index.docs, **filters)
    order = [F.desc("score"), "id"]
    if sort == "relevance":
        best = found.join(docs.select("id"), "id", "left_semi").orderBy(*order).limit(max(0, k))
    else:
        order = [F.desc(F.coalesce("date", F.lit(""))), *order]
        best = found.join(docs.select("id", "date"), "id").orderBy(*order).limit(max(0, k)).select("id", "score")
    rows = best.join(docs, "id").select("id", "score", _snippet(query).alias("snippet"), *(c for c in FIELDS if c in docs.columns))
    return rows.orderBy(*order)


MODES, SORTS = ("lexical", "semantic", "hybrid"), ("score", "date_desc")


def find(index: Index, query: str, mode: str = "lexical", k: int = 20, op: str = "OR", sort: str = "score", store: DataFrame | None = None, chunks: DataFrame | None = None, vector=None, **filters) -> DataFrame:
    """Result rows of a search in any mode: id, score, snippet and the document's fields.

    store (chunk_id, vec) and chunks (chunk_id, doc_ids) are the vectors' side, vector the
    query's embedding. A document's score in it is that of its best chunk that begins with
    it. op narrows lexical searches only, but must be one of the two in all. Every filter,
    dates too, comes before the cut, so the depth of a ranking is the whole corpus as soon
    as anything is asked of documents; without, it is the first k.
    """
    if mode not in MODES or op not in ("AND", "OR") or sort not in SORTS or k < 1:
        raise ValueError(f"unknown mode {mode!r}, operator {op!r}, sort {sort!r} or k {k}")
    if mode == "lexical":
        return search(index, query, k, op, "relevance" if sort == "score" else sort, **filters)
    if store is None or chunks is None or vector is None:
        raise ValueError(f"{mode} search needs store, chunks and vector")
    asked = {name: x for name, x in filters.items() if x is not None}
    docs = filtered(index.docs, **asked)
    whole = bool(asked) or sort != "score"
    hits = cosines(store.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "vec"), vector)
    semantic = project_to_docs(hits, chunks, index.docs).groupBy("id").agg(F.max("score").alias("score"))
    if mode == "semantic":
        ranked = semantic
    elif whole:
        ranked = filtered_hybrid(scores(index, query), semantic, docs, k, sort != "score").select("id", "score")
    else:
        ranked = hybrid(scores(index, query), semantic, k).select("id", "score")
    order = [F.desc("score"), F.col("id")]
    if sort != "score":
        order = [F.desc(F.coalesce("date", F.lit(""))), *order]
    kept = ranked.join(docs.select("id", "date"), "id") if whole else ranked
    best = kept.orderBy(*order).limit(k).select("id", "score")
    snippet = head_snippet(F.col("text")) if mode == "semantic" else _snippet(query)
    rows = best.join(index.docs, "id").select("id", "score", snippet.alias("snippet"), *(c for c in FIELDS if c in index.docs.columns))
    return rows.orderBy(*order)
