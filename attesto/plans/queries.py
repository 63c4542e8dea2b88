"""The library's queries over the driver's tables, each with DuckDB SQL of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text
from ..operators import analytics, chunking, evaluation, fusion, index, joins, rag, search, vectors
from ..operators.tables import shared_dir, small, written
from ..sources import documents, parsers
from . import fixtures as fx
from . import lifecycle, literals  # noqa: F401  (they register their queries)
from .base import ALL, ASKED, BASE, DIGITS, DOCS, MARKERS, ORACLES, PHRASE, QUERIES, bm25_sql, build_index, built, corpus, kept, query, table, values

# ---- index and lexical search


@query(f"{BASE} SELECT n, round(average, {DIGITS}) AS average, (SELECT count(*) FROM post) AS postings, (SELECT count(DISTINCT term) FROM post) AS terms FROM stat")
def index_build(spark, sf_dir):
    """Builds, saves and loads the index that all searches by index read."""
    i = build_index(spark, sf_dir)
    sizes = i.term_stats.agg(F.sum("df").alias("postings")).crossJoin(i.term_stats.agg(F.count("*").alias("terms")))
    return i.corpus_stats.crossJoin(sizes).select("n", F.round("average", DIGITS).alias("average"), "postings", "terms")


@query(f"{BASE}, {bm25_sql()} SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc ORDER BY score DESC, id LIMIT 10")
def bm25_top10(spark, sf_dir):
    return search.top(search.scan_scores(corpus(spark, sf_dir), ASKED), 10, DIGITS).select("id", "score", "rank")


@query(ORACLES["bm25_top10"])
def bm25_index_top10(spark, sf_dir):
    return search.top(search.scores(built(spark, sf_dir), ASKED), 10, DIGITS).select("id", "score", "rank")


@query(ORACLES["bm25_top10"])
def bm25_skipping_top10(spark, sf_dir):
    """By the blocks' bounds, whatever the number of postings; ranks go by rounded scores, so one more than ten is asked."""
    return search.top(search.best_scores(built(spark, sf_dir), ASKED, 50, least=0), 10, DIGITS).select("id", "score", "rank")


@query(f"{BASE}, r AS (SELECT term, count(*) AS n FROM post WHERE term IN ('that', 'with', 'from') GROUP BY term) SELECT sum(n)::BIGINT AS postings, true AS within FROM r")
def blocks_read(spark, sf_dir):
    """Postings of the query's terms by the heads of their blocks, and that the bounds leave no more blocks to read than there are."""
    every, kept_ = search.worth_reading(built(spark, sf_dir), ASKED, 10)
    return every.agg(F.sum("postings").alias("postings"), F.sum("blocks").alias("all")).crossJoin(kept_.agg(F.sum("blocks").alias("read"))).select("postings", (F.col("read") <= F.col("all")).alias("within"))


@query(f"{BASE}, {bm25_sql()} SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc ORDER BY score DESC, id LIMIT 10".replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT CAST(doc_id AS VARCHAR), lower(text), lang, 'public', source, source, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR), 'link:' || doc_id, doc_id FROM documents WHERE doc_id % 20 = 3)"))
def segments_top10(spark, sf_dir):
    """An index that was built, lost a tenth of its documents, got half of these again as a segment, and was searched; a compaction answers alike."""
    docs, path = corpus(spark, sf_dir), f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    index.build(docs).save(path)
    index.delete_saved(spark, path, docs.where("ord % 10 = 3").select("id"))
    index.add_saved(spark, path, docs.where("ord % 20 = 3").withColumn("text", F.lower("text")))
    found = lambda: search.top(search.best_scores(index.Index.load(spark, path), ASKED, 50, least=0), 10, DIGITS).select("id", "score", "rank")
    before = written(found())
    index.compact(spark, path)
    return before.intersect(found())


@query(f"{BASE}, {bm25_sql()}, a AS (SELECT id FROM post JOIN q USING (term) GROUP BY id HAVING count(*) = 3) SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc SEMI JOIN a USING (id) ORDER BY 2 DESC, 1 LIMIT 10")
def bm25_and_top10(spark, sf_dir):
    i = built(spark, sf_dir)
    return search.top(search.scores(i, ASKED).join(search.boolean_search(i, ASKED, "AND"), "id", "left_semi"), 10, DIGITS).select("id", "score", "rank")


@query(f"{BASE} SELECT id FROM post WHERE term IN ('the', 'and', 'that') GROUP BY id HAVING count(*) = 3")
def boolean_and(spark, sf_dir):
    return search.boolean_search(built(spark, sf_dir), ALL, "AND")


@query(ORACLES["boolean_and"])
def boolean_and_scan(spark, sf_dir):
    return search.boolean_scan(corpus(spark, sf_dir), ALL, "AND")


@query(f"{BASE} SELECT DISTINCT id FROM post WHERE term IN ('the', 'and', 'that')")
def boolean_or(spark, sf_dir):
    return search.boolean_search(built(spark, sf_dir), ALL, "OR")


@query(f"{BASE} SELECT DISTINCT a.id FROM pos a JOIN pos b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def phrase(spark, sf_dir):
    return search.phrase_search(built(spark, sf_dir), PHRASE)


@query(ORACLES["phrase"])
def phrase_scan(spark, sf_dir):
    return search.phrase_scan(corpus(spark, sf_dir), PHRASE)


@query(f"{BASE} SELECT term, id, CAST(tf AS INTEGER) AS tf, list_transform(positions, lambda x: CAST(x AS INTEGER)) AS positions FROM post WHERE term = 'that'")
def index_postings(spark, sf_dir):
    return built(spark, sf_dir).posting("that").drop("length")


@query(f"{BASE} SELECT term, count(*) AS df FROM post GROUP BY term")
def index_term_stats(spark, sf_dir):
    return built(spark, sf_dir).term_stats


@query(f"{BASE} SELECT id, length FROM tok")
def index_doc_stats(spark, sf_dir):
    return built(spark, sf_dir).doc_stats


@query(f"{BASE} SELECT n, round(average, {DIGITS}) AS average FROM stat")
def index_corpus_stats(spark, sf_dir):
    return built(spark, sf_dir).corpus_stats.withColumn("average", F.round("average", DIGITS))


@query(f"{BASE} SELECT term, count(*) AS df FROM post WHERE CAST(id AS BIGINT) % 10 <> 0 GROUP BY term")
def index_delete(spark, sf_dir):
    i = built(spark, sf_dir)
    return i.delete(i.docs.where(F.col("ord") % 10 == 0).select("id")).term_stats


@query(f"{BASE} SELECT id, substr(text, 1, 160) AS snippet FROM docs")
def head_snippets(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", text.head_snippet(F.col("text")).alias("snippet"))


_BEFORE = r"'(?s)^(.*?(?:^|[^\p{L}\p{N}]))(?:that|with)(?:[^\p{L}\p{N}]|$)'"


@query(rf"WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}])(?:that|with)(?:[^\p{{L}}\p{{N}}]|$)') AS hit, length(regexp_extract(lower(text), {_BEFORE}, 1)) AS a FROM documents) SELECT id, CASE WHEN hit THEN substr(text, greatest(a - 80, 0) + 1, a + 84 - greatest(a - 80, 0)) ELSE substr(text, 1, 160) END AS snippet FROM d")
def centred_snippets(spark, sf_dir):
    terms = F.array(F.lit("that"), F.lit("with"))
    return corpus(spark, sf_dir).select("id", text.centred_snippet(F.col("text"), terms).alias("snippet"))


@query(f"{BASE} SELECT id, ts AS tokens FROM tok")
def analyzed_tokens(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", text.analyze(F.col("text")).alias("tokens"))


_FILTERED = f"{BASE}, {bm25_sql()}, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc)"


@query(f"{BASE}, {bm25_sql()} SELECT sc.id, score, date FROM sc JOIN docs USING (id) WHERE source_type = 'en' AND jurisdiction = 'src3' AND date >= '2024-03-01' AND date <= '2024-10-31' ORDER BY score DESC, sc.id LIMIT 15")
def search_filtered(spark, sf_dir):
    rows = search.search(built(spark, sf_dir), ASKED, 15, source_type="en", jurisdiction="src3", date_from="2024-03-01", date_to="2024-10-31")
    return rows.select("id", F.round("score", DIGITS).alias("score"), "date")


@query(f"{_FILTERED} SELECT r.id, score, date FROM r JOIN docs USING (id) WHERE source_type = 'en' ORDER BY date DESC, rank LIMIT 15")
def search_by_date(spark, sf_dir):
    rows = search.search(built(spark, sf_dir), ASKED, 15, sort="date_desc", source_type="en")
    return rows.select("id", F.round("score", DIGITS).alias("score"), "date")


# ---- vectors and fusion

_VECTOR = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q0 AS (SELECT e AS q FROM v WHERE vec_id = 0)"
_COSINE = f"cs AS (SELECT vec_id, round(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), {DIGITS}) AS score FROM v CROSS JOIN q0)"


def store(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"))


def _query_vector(spark, sf_dir):
    return [float(x) for x in store(spark, sf_dir).where("row = 0").first().vec]


@query(f"WITH {_VECTOR}, {_COSINE} SELECT vec_id AS \"row\", score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM cs ORDER BY score DESC, vec_id LIMIT 10")
def cosine_top10(spark, sf_dir):
    return vectors.cosine_top_k(store(spark, sf_dir), _query_vector(spark, sf_dir), 10, digits=DIGITS).select("row", "score", "rank")


@query(ORACLES["cosine_top10"])
def cosine_packed_top10(spark, sf_dir):
    """The same from a store of packed blocks, written once an application and folder."""
    return vectors.packed_top_k(kept(spark, sf_dir, "blocks", lambda: vectors.packed(store(spark, sf_dir))), _query_vector(spark, sf_dir), 10, digits=DIGITS)


@query(f"WITH {_VECTOR}, {_COSINE} SELECT CAST(vec_id AS VARCHAR) AS chunk_id, score FROM cs JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) WHERE label % 2 = 1 ORDER BY score DESC, 1 LIMIT 10")
def covered_top10(spark, sf_dir):
    """Chunks are there for vectors of odd labels only."""
    rows = table(spark, sf_dir, "embeddings")
    chunks = rows.where("label % 2 = 1").select(F.col("vec_id").cast("string").alias("chunk_id"))
    found = vectors.covered_top_k(store(spark, sf_dir).withColumnRenamed("id", "chunk_id"), chunks, _query_vector(spark, sf_dir), 10, DIGITS)
    return found.select("chunk_id", "score")


def _side(spark, sf_dir) -> dict:
    """The vectors' side of a search: each vector is its document's."""
    rows = store(spark, sf_dir).select(F.col("id").alias("chunk_id"), "vec")
    return {"store": rows, "chunks": rows.select("chunk_id", F.array("chunk_id").alias("doc_ids")), "vector": _query_vector(spark, sf_dir)}


_MEANT = f"sem AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) AS score FROM v CROSS JOIN q0 WHERE vec_id IN (SELECT doc_id FROM documents))"


@query(f"{BASE}, {_VECTOR}, {_MEANT} SELECT id, round(score, {DIGITS}) AS score FROM sem JOIN docs USING (id) WHERE source_type = 'en' AND date >= '2024-03-01' ORDER BY sem.score DESC, id LIMIT 15")
def find_semantic(spark, sf_dir):
    rows = search.find(built(spark, sf_dir), ASKED, "semantic", 15, source_type="en", date_from="2024-03-01", **_side(spark, sf_dir))
    return rows.select("id", F.round("score", DIGITS).alias("score"))


_FUSED = f"""{bm25_sql().replace(f", {DIGITS}) AS score", ", 15) AS score")}, {_MEANT}, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM sc), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sem),
fu AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)"""


@query(f"{BASE}, {_VECTOR}, {_FUSED} SELECT id, round(score, 9) AS score, date FROM fu JOIN docs USING (id) WHERE jurisdiction = 'src3' ORDER BY date DESC, score DESC, id LIMIT 15")
def find_hybrid_by_date(spark, sf_dir):
    rows = search.find(built(spark, sf_dir), ASKED, "hybrid", 15, sort="date_desc", jurisdiction="src3", **_side(spark, sf_dir))
    return rows.select("id", F.round("score", 9).alias("score"), "date")


@query(f"WITH {_VECTOR} SELECT CAST(vec_id AS VARCHAR) AS chunk_id, round(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), {DIGITS}) AS score, sha256('m' || chr(10) || '64' || chr(10) || text) AS content_hash FROM v CROSS JOIN q0 JOIN documents ON doc_id = vec_id ORDER BY 2 DESC, 1 LIMIT 8")
def semantic_search(spark, sf_dir):
    """Every vector has its document as its chunk; the hashes of those that are returned are checked."""
    pairs = corpus(spark, sf_dir).select(F.col("id").alias("chunk_id"), "text")
    rows = store(spark, sf_dir).select(F.col("id").alias("chunk_id"), "vec").join(pairs, "chunk_id")
    held = rows.select("chunk_id", "vec", F.lit("m").alias("model"), F.lit(64).alias("dim"), text.content_hash(F.lit("m"), F.lit(64), F.col("text")).alias("content_hash"))
    chunks = pairs.join(held.select("chunk_id"), "chunk_id", "left_semi")
    return vectors.semantic_search(held, chunks, _query_vector(spark, sf_dir), 8, DIGITS).select("chunk_id", F.round("score", DIGITS).alias("score"), "content_hash")


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def rows_for_labels(spark, sf_dir):
    held = store(spark, sf_dir).select(F.col("id").alias("chunk_id"), "vec")
    return vectors.rows_for(held, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))).select("chunk_id")


@query(f"{BASE}, {bm25_sql()}, {_VECTOR}, {_COSINE}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc), b AS (SELECT CAST(vec_id AS VARCHAR) AS id, row_number() OVER (ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM cs), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY id) SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM f ORDER BY score DESC, id LIMIT 20")
def hybrid_top20(spark, sf_dir):
    lexical = search.scan_scores(corpus(spark, sf_dir), ASKED).withColumn("score", F.round("score", DIGITS))
    semantic = vectors.cosines(store(spark, sf_dir).select("id", "vec"), _query_vector(spark, sf_dir), digits=DIGITS)
    return fusion.hybrid(lexical, semantic, 20, None, 9)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, sha256('m' || chr(10) || '64' || chr(10) || text) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", text.content_hash(F.lit("m"), F.lit(64), F.col("text")).alias("content_hash"))


_LETTERS = ", ".join(f"length(t) - length(replace(t, '{c}', '')) + 1" for c in "abcdefgh")


@query(f"""WITH x AS (SELECT *, CAST([{_LETTERS}] AS DOUBLE[]) AS v FROM (SELECT *, substr(text, 1, 24000) AS t FROM documents))
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha256('letters' || chr(10) || '8' || chr(10) || text) AS content_hash, list_transform(v, lambda e: CAST(e / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS FLOAT)) AS vec, 'letters' AS model, 8 AS dim, length(text) > 24000 AS truncated FROM x""")
def embed_corpus(spark, sf_dir):
    """Embeds documents with a provider that counts letters, one call for each distinct text."""
    provider = lambda texts: [[float(t.count(c)) + 1 for c in "abcdefgh"] for t in texts]
    return vectors.embed_corpus(corpus(spark, sf_dir).select(F.col("id").alias("chunk_id"), "text"), provider, "letters", 8)


# ---- evaluation

_ASKED3 = [("q1", "that with from"), ("q2", "de la que"), ("q3", "und der nicht")]
_Q3 = "qs AS (SELECT * FROM (VALUES ('q1', 'that'), ('q1', 'with'), ('q1', 'from'), ('q2', 'de'), ('q2', 'la'), ('q2', 'que'), ('q3', 'und'), ('q3', 'der'), ('q3', 'nicht')) x(query_id, term))"


def _scored3(k1: str = "1.5", b: str = "0.75") -> str:
    return f"""{_Q3}, df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
s3 AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / average))), {DIGITS}) AS score
  FROM qs JOIN post USING (term) JOIN df USING (term) JOIN tok USING (id) CROSS JOIN stat GROUP BY ALL),
r3 AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s3) WHERE rank <= 50),
gr AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS id, quality AS grade FROM labels CROSS JOIN (SELECT DISTINCT query_id FROM qs)),
ideal AS (SELECT query_id, count(*) FILTER (grade >= 1) AS relevant, sum(grade / log2(place + 1)) FILTER (place <= 10) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS place FROM gr) GROUP BY query_id),
got AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (grade >= 1), 0) AS mrr, count(*) FILTER (grade >= 1 AND rank <= 10) AS hits, sum(coalesce(grade, 0) / log2(rank + 1)) FILTER (rank <= 10) AS dcg
  FROM r3 LEFT JOIN gr USING (query_id, id) GROUP BY query_id),
met AS (SELECT query_id, CAST(mrr AS DOUBLE) AS mrr, CAST(hits / 10.0 AS DOUBLE) AS precision_10, CAST(hits AS DOUBLE) / relevant AS recall_10, dcg / best AS ndcg_10 FROM ideal JOIN got USING (query_id))"""


def _graded(spark, sf_dir):
    queries = spark.createDataFrame(_ASKED3, "query_id string, query string")
    grades = table(spark, sf_dir, "labels").crossJoin(F.broadcast(queries.select("query_id"))).select("query_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").alias("grade"))
    return queries, grades


_ROUNDED = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in ("mrr", "precision_10", "recall_10", "ndcg_10"))


@query(f"{BASE}, {_scored3()} SELECT query_id, {_ROUNDED} FROM met")
def eval_metrics(spark, sf_dir):
    queries, grades = _graded(spark, sf_dir)
    found = evaluation.ranks(evaluation.batch_scores(built(spark, sf_dir), queries), ["query_id"], 50, DIGITS).withColumnRenamed("id", "doc_id")
    rows = evaluation.metrics(found, grades, (10,), queries)
    return rows.select("query_id", *(F.round(c, DIGITS).alias(c) for c in ("mrr", "precision_10", "recall_10", "ndcg_10")))


@query(f"{BASE}, {_scored3()} SELECT {', '.join(f'round(avg({c}), {DIGITS}) AS {c}' for c in ('mrr', 'precision_10', 'recall_10', 'ndcg_10'))} FROM met")
def eval_means(spark, sf_dir):
    queries, grades = _graded(spark, sf_dir)
    found = evaluation.ranks(evaluation.batch_scores(built(spark, sf_dir), queries), ["query_id"], 50, DIGITS).withColumnRenamed("id", "doc_id")
    rows = evaluation.means(evaluation.metrics(found, grades, (10,), queries))
    return rows.select(*(F.round(c, DIGITS).alias(c) for c in ("mrr", "precision_10", "recall_10", "ndcg_10")))


_GRID = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_scored3(str(k1), str(b)).replace('<= 50', '<= 10')} SELECT CAST({k1} AS DOUBLE) AS k1, CAST({b} AS DOUBLE) AS b, round(avg(ndcg_10), {DIGITS}) AS ndcg FROM met)" for k1 in (0.9, 1.5) for b in (0.4, 0.75)
)


@query(f"{BASE} {_GRID}")
def parameter_sweep(spark, sf_dir):
    queries, grades = _graded(spark, sf_dir)
    cells = evaluation.sweep(built(spark, sf_dir), queries, grades, (0.9, 1.5), (0.4, 0.75), 10, DIGITS)
    return cells.withColumn("ndcg", F.round("ndcg", DIGITS))


_OKAPI = bm25_sql(idf="ln((n - df + 0.5) / (df + 0.5))").replace("q AS (", "q2 AS (").replace("JOIN q ", "JOIN q2 ").replace("df AS (SELECT term", "df2 AS (SELECT term").replace("JOIN df ", "JOIN df2 ").replace("sc AS", "sc2 AS")


@query(f"{BASE} SELECT * FROM ({_GRID}) ORDER BY ndcg DESC, k1, b LIMIT 1")
def sweep_best(spark, sf_dir):
    queries, grades = _graded(spark, sf_dir)
    cells = evaluation.sweep(built(spark, sf_dir), queries, grades, (0.9, 1.5), (0.4, 0.75), 10, DIGITS)
    made = evaluation.sweep_artifact(cells.withColumn("ndcg", F.round("ndcg", DIGITS)), 3, 10)
    made = spark.read.schema(made.schema).json(evaluation.save_artifact(made, f"{shared_dir(spark)}/sweep-{uuid.uuid4().hex}"))
    return made.select("best.k1", "best.b", F.col("best.ndcg10").alias("ndcg"))


_LABELS = (("P@5", "precision", 5), ("P@10", "precision", 10), ("R@10", "recall", 10), ("R@50", "recall", 50), ("MRR", "mrr", 0), ("NDCG@10", "ndcg", 10))


def _label_sql(what: str, k: int) -> str:
    hits = f"count(*) FILTER (grade >= 1 AND rank <= {k})"
    return {"precision": f"{hits} / {k}.0", "recall": f"{hits} / max(relevant)", "mrr": "coalesce(1.0 / min(rank) FILTER (grade >= 1), 0)", "ndcg": f"sum(coalesce(grade, 0) / log2(rank + 1)) FILTER (rank <= {k}) / max(best)"}[what]


_RUN = f"SELECT query_id, {', '.join(f'round(CAST({_label_sql(w, k)} AS DOUBLE), {DIGITS}) AS \"{n}\"' for n, w, k in _LABELS)} FROM r3 LEFT JOIN gr USING (query_id, id) JOIN ideal USING (query_id) GROUP BY query_id"


@query(f"{BASE}, {_scored3()} {_RUN}")
def evaluation_run(spark, sf_dir):
    """The six labels of a run; the labels' rows are judgments of three queries."""
    queries, grades = _graded(spark, sf_dir)
    found = evaluation.ranks(evaluation.batch_scores(built(spark, sf_dir), queries), ["query_id"], 50, DIGITS).withColumnRenamed("id", "doc_id")
    rows, _, _ = evaluation.evaluation_run(found, grades.withColumn("ord", F.lit(0)))
    return rows.select("query_id", *(F.round(F.col(f"`{n}`"), DIGITS).alias(n) for n, *_ in _LABELS))


@query(f"""{BASE}, b AS (SELECT item_id, array_to_string(ts[1:4], ' ') AS question, ts[1:4] AS ws, coalesce(quality = 1, false) AS answerable
  FROM (SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS ts FROM benchmark) LEFT JOIN labels ON doc_id = item_id),
qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(ws) AS term FROM b) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hit AS (SELECT item_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), {DIGITS}) AS score FROM qt JOIN post USING (term) JOIN df USING (term) JOIN tok USING (id) CROSS JOIN stat GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM hit) WHERE rank <= 5),
a AS (SELECT b.*, coalesce(n, 0) AS n, coalesce(own, 0) AS own, coalesce(n, 0) = 0 OR length(question) % 3 = 0 AS refused FROM b LEFT JOIN (SELECT item_id, count(*) AS n, max((id = CAST(item_id AS VARCHAR))::INT) AS own FROM top GROUP BY 1) USING (item_id))
SELECT count(*) AS n, round(coalesce(avg(refused::INT) FILTER (NOT answerable), 0), {DIGITS}) AS refusal_rate, round(coalesce(avg(refused::INT) FILTER (answerable), 0), {DIGITS}) AS false_refusal_rate,
  round(avg(own), {DIGITS}) AS answer_recall, round(coalesce(avg(CASE WHEN n = 1 THEN 2 / 3.0 ELSE 1 / 3.0 END) FILTER (NOT refused), 0), {DIGITS}) AS faithfulness FROM a""")
def qa_evaluation(spark, sf_dir):
    """Questions of the first words of benchmark passages through retrieval by the index, a generator, a judge and the metrics, run twice: the second run asks nobody."""
    d, i, path = corpus(spark, sf_dir), built(spark, sf_dir), f"{shared_dir(spark)}/qa-{uuid.uuid4().hex}"
    graded = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    qa = table(spark, sf_dir, "benchmark").join(graded, "item_id", "left").select(
        F.col("item_id").cast("string").alias("qa_id"), F.array_join(F.slice(text.tokens(F.col("text")), 1, 4), " ").alias("question"),
        F.array(F.col("item_id").cast("string")).alias("answer_doc_ids"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("answerable"),
    )

    def retrieve(questions):
        best = evaluation.ranks(evaluation.batch_scores(i, questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))), ["query_id"], 5, DIGITS)
        return best.join(d, "id").select(F.col("query_id").alias("question_id"), "rank", "score", F.col("id").alias("doc_id"), "source_type", "date", "text")

    def generate(rows):
        cited = F.size(F.regexp_extract_all("prompt_context", F.lit(r"(?m)^\[[1-5]\] [a-z]+ \| \d{4}-"), 0))
        said = F.concat(F.lit("It is so [1]. It is also so ["), cited, F.lit("]. And nothing else."))
        return rows.select("question_id", F.when(F.length("question") % 3 == 0, rag.SENTINEL).otherwise(said).alias("answer"))

    def judge(prompt):
        claim = prompt.split("\nCLAIM\n")[1].split("\n")[0]
        return '{"verdict": "supported", "evidence_chunk": 1}' if "[1]" in claim else '{"verdict": "unsupported", "evidence_chunk": null}'

    def nobody(_):
        raise AssertionError("asked again")

    evaluation.qa_run(qa, retrieve, generate, judge, path)
    row = evaluation.qa_run(qa, retrieve, lambda rows: rows.select("question_id", F.raise_error(F.lit("asked again")).cast("string").alias("answer")), nobody, path)
    return row.select("n", *(F.round(F.col(f"metrics.{m}"), DIGITS).alias(m) for m in ("refusal_rate", "false_refusal_rate", "answer_recall", "faithfulness")))


def _top(score: str) -> str:
    return f"list(id ORDER BY {score} DESC, id) FILTER (place_{score} <= 10)"


@query(f"{BASE}, {bm25_sql()}, {_OKAPI}, x AS (SELECT id, sc.score AS ours, sc2.score AS other FROM sc JOIN sc2 USING (id)), y AS (SELECT *, row_number() OVER (ORDER BY ours DESC, id) AS place_ours, row_number() OVER (ORDER BY other DESC, id) AS place_other FROM x) SELECT '{ASKED}' AS query, {_top('ours')} AS our_ranking, {_top('other')} AS reference_ranking, {_top('ours')} = {_top('other')} AS order_agrees FROM y")
def differential_report(spark, sf_dir):
    rows = evaluation.differential_report(built(spark, sf_dir), [ASKED], 10, DIGITS)
    return rows.select("query", "our_ranking", "reference_ranking", "order_agrees")


@query(f"{BASE}, {bm25_sql()}, {_OKAPI} SELECT id, sc.score AS ours, sc2.score AS other FROM sc JOIN sc2 USING (id)")
def bm25_differential(spark, sf_dir):
    rows = evaluation.differential(built(spark, sf_dir), ASKED)
    return rows.select("id", F.round("ours", DIGITS).alias("ours"), F.round("other", DIGITS).alias("other"))


@query(f"""{BASE}, {bm25_sql()}, {_VECTOR}, {_MEANT}, p AS (SELECT id FROM (SELECT id FROM docs WHERE contains(lower(text), 'the ') ORDER BY ord, id LIMIT 20) UNION SELECT id FROM (SELECT id FROM sc ORDER BY score DESC, id LIMIT 20) UNION SELECT id FROM (SELECT id FROM sem ORDER BY round(score, {DIGITS}) DESC, id LIMIT 20)
UNION SELECT id FROM (SELECT id FROM docs ORDER BY md5('7:' || id), id LIMIT 3)) SELECT id, CAST(row_number() OVER (ORDER BY md5('7:' || id), id) AS INTEGER) AS place FROM p""")
def pooled_candidates(spark, sf_dir):
    d = corpus(spark, sf_dir)
    lexical = search.scan_scores(d, ASKED).withColumn("score", F.round("score", DIGITS))
    semantic = vectors.cosines(store(spark, sf_dir).join(d.select("id"), "id", "left_semi").select("id", "vec"), _query_vector(spark, sf_dir), digits=DIGITS)
    return evaluation.pool_candidates(d, "The ", lexical, semantic, 20, 7)


def _chunk_sql() -> str:
    cell = lambda name, w, start: f"SELECT '{name}' AS cell, {w} AS w, {name[-1]} AS o, s.conv_id, s.i AS start, t.text, t.turn, t.i FROM w s JOIN w t ON t.conv_id = s.conv_id AND t.i >= s.i AND t.i < s.i + {w} WHERE {start}"
    return f"""WITH {_WINDOWS}, m AS ({cell("1+0", 1, "true")} UNION ALL {cell("2+0", 2, "s.i % 2 = 0")} UNION ALL {cell("2+1", 2, "s.i = 0 OR s.i + 1 < s.n")}),
c AS (SELECT cell, w, o, cell || '|yt:' || conv_id || ':seg' || lpad(CAST(min(turn) AS VARCHAR), 3, '0') || CASE WHEN count(*) > 1 THEN '+w2' ELSE '' END AS id, string_agg(text, ' ' ORDER BY i) AS text, list(turn) AS turns, conv_id FROM m GROUP BY cell, w, o, conv_id, start),
tk AS (SELECT cell, id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS ts FROM c),
st AS (SELECT cell, count(*) AS n, avg(len(ts)) AS average FROM tk GROUP BY cell),
qs AS (SELECT * FROM (VALUES ('q1', 'that'), ('q1', 'with'), ('q2', 'und'), ('q2', 'der')) x(query_id, term)),
h AS (SELECT cell, id, len(ts) AS length, query_id, term, len(list_filter(ts, lambda x: x = term)) AS tf FROM tk CROSS JOIN qs WHERE list_contains(ts, term)),
df AS (SELECT cell, query_id, term, count(*) AS df FROM h GROUP BY ALL),
sc AS (SELECT cell, query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))) AS score FROM h JOIN df USING (cell, query_id, term) JOIN st USING (cell) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell, query_id ORDER BY score DESC, id) AS rank FROM sc),
rel AS (SELECT conv_id, query_id FROM w CROSS JOIN (VALUES ('q1'), ('q2')) x(query_id) WHERE turn = 1),
tot AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
hit AS (SELECT cell, query_id, count(DISTINCT conv_id) AS hits FROM rk JOIN c USING (cell, id) JOIN rel USING (conv_id, query_id) WHERE rank <= 10 AND list_contains(turns, 1) GROUP BY ALL)
SELECT CAST(w AS INTEGER) AS "window", CAST(o AS INTEGER) AS overlap, round(avg(coalesce(hits / n, 0)), {DIGITS}) AS recall_10 FROM (SELECT DISTINCT cell, w, o FROM m) CROSS JOIN tot LEFT JOIN hit USING (cell, query_id) GROUP BY w, o"""


_WINDOWS = """w AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


@query(_chunk_sql())
def chunk_window_sweep(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.format_string("yt:%d:seg%03d", "conv_id", "turn").alias("id"), "text")
    queries = spark.createDataFrame([("q1", "that with"), ("q2", "und der")], "query_id string, query string")
    grades = c.where(F.col("id").endswith("seg001")).crossJoin(F.broadcast(queries.select("query_id"))).select("query_id", F.col("id").alias("doc_id"), F.lit(1).alias("grade"))
    return evaluation.chunk_sweep(c, queries, grades, (1, 2), (0, 1), (10,)).withColumn("recall_10", F.round("recall_10", DIGITS))


# ---- windows over conversations and events


@query(f"WITH {_WINDOWS}, s AS (SELECT conv_id, unnest(range(0, CASE WHEN n <= 3 THEN 1 ELSE CAST(ceil((n - 3) / 2.0) AS BIGINT) + 1 END)) * 2 AS start FROM (SELECT DISTINCT conv_id, n FROM w)) SELECT conv_id, CAST(start AS INTEGER) AS start, count(*) AS n, list(turn ORDER BY turn) AS turns FROM s JOIN w USING (conv_id) WHERE i >= start AND i < start + 3 GROUP BY ALL")
def chunk_windows(spark, sf_dir):
    rows = chunking.sliding(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 3, 1)
    return rows.groupBy("conv_id", F.col("start").cast("int").alias("start")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("turn")).alias("turns"))


@query("WITH l AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS c FROM conversations), g AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM l) SELECT conv_id, CAST(island AS BIGINT) AS island, role, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY ALL")
def role_islands(spark, sf_dir):
    return chunking.islands(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text")


@query(f"WITH {_WINDOWS}, s AS (SELECT conv_id, unnest(range(0, CASE WHEN n <= 2 THEN 1 ELSE CAST(ceil((n - 2) / 1.0) AS BIGINT) + 1 END)) AS start FROM (SELECT DISTINCT conv_id, n FROM w)), c AS (SELECT conv_id, start, list('yt:' || conv_id || ':seg' || lpad(CAST(turn AS VARCHAR), 3, '0') ORDER BY i) AS doc_ids, string_agg(text, ' ' ORDER BY i) AS text FROM s JOIN w USING (conv_id) WHERE i >= start AND i < start + 2 GROUP BY ALL) SELECT doc_ids[1] || CASE WHEN len(doc_ids) > 1 THEN '+w2' ELSE '' END AS chunk_id, doc_ids, text FROM c")
def chunk_corpus(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.format_string("yt:%d:seg%03d", "conv_id", "turn").alias("id"), "text")
    return chunking.chunk_corpus(c, 2, 1)


@query("SELECT event_type AS video, CAST(floor(epoch(ts) / 75) AS INTEGER) AS window, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS text FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("video"), F.col("event_id").alias("ord"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("start"), F.col("event_id").cast("string").alias("text"))
    rows = chunking.caption_windows(e.withColumn("start", F.col("start") / 1e6))
    return rows.select("video", "window", F.size(F.split("text", " ")).cast("long").alias("n"), "text")


_CLOSES = "p AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(max(value), 2) AS close FROM events WHERE event_type = 'purchase' OR event_type = 'view' GROUP BY 1, 2)"


def closes(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view"))
    return e.groupBy(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").cast("string").alias("date")).agg(F.round(F.max("value"), 2).alias("close"))


@query(f"WITH {_CLOSES}, l AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prior FROM p) SELECT ticker, date, round((close - prior) / prior * 100, {DIGITS}) AS return_pct FROM l WHERE prior <> 0 AND abs((close - prior) / prior * 100) >= 5")
def significant_moves(spark, sf_dir):
    return analytics.significant_moves(closes(spark, sf_dir)).withColumn("return_pct", F.round("return_pct", DIGITS))


@query(f"WITH {_CLOSES}, m AS (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM p) SELECT ticker, date, close FROM m WHERE CAST(date AS DATE) >= CAST(last AS DATE) - 6")
def trailing_week(spark, sf_dir):
    return analytics.trailing(closes(spark, sf_dir), 7)


_HITS = "h AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = 'click')"


def clicks(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").cast("string").alias("date"), F.col("event_id").cast("string").alias("id"))


@query(f"""WITH {_CLOSES}, {_HITS}, s AS (SELECT ticker, count(*) AS n, arg_max(close, date) AS latest FROM p GROUP BY ticker),
a AS (SELECT h.ticker, h.date, h.id, p.close AS entry FROM h ASOF JOIN p ON h.ticker = p.ticker AND h.date >= p.date WHERE h.date >= '2024-01-10'),
k AS (SELECT a.*, latest, coalesce((SELECT max(close) FROM p WHERE p.ticker = a.ticker AND p.date >= a.date), latest) AS peak FROM a JOIN s ON s.ticker = a.ticker WHERE n >= 2 AND entry > 0)
SELECT ticker, id AS doc_id, date, round(entry, 2) AS entry_close, round(latest, 2) AS latest_close, round((latest / entry - 1) * 100, 2) AS return_pct, round((peak / entry - 1) * 100, 2) AS peak_pct, count(*) OVER (PARTITION BY ticker) - 1 AS co_mentions FROM k""")
def mention_returns(spark, sf_dir):
    return analytics.mention_returns(clicks(spark, sf_dir), closes(spark, sf_dir), "2024-01-10")


@query("SELECT e.event_id, v.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left, right = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value")
    return joins.asof_backward(left, right, "user_id", "ts", "ts", "value").select("event_id", "asof_value")


@query(f"""WITH {_HITS}, m AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events WHERE event_type = 'error')
SELECT m.ticker, m.date, count(h.id) AS n, coalesce(string_agg(h.id, ',' ORDER BY h.id), '') AS ids FROM m LEFT JOIN h ON h.ticker = m.ticker AND CAST(m.date AS DATE) - CAST(h.date AS DATE) BETWEEN 0 AND 7 GROUP BY ALL""")
def range_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    moves = e.select(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").cast("string").alias("date")).distinct()
    docs = clicks(spark, sf_dir).withColumns({c: F.lit("") for c in ("source_type", "venue_type", "deep_link", "text")})
    rows = analytics.nearby_receipts(moves, docs)
    return rows.select("ticker", "date", F.size("receipts").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("receipts", lambda r: r["doc_id"])), ",").alias("ids"))


# ---- analytics


def _count_sql(phrase: str) -> str:
    return f"((length(lower(text)) - length(replace(lower(text), '{phrase}', ''))) / {len(phrase)})"


@query(f"WITH {DOCS}, r AS (SELECT jurisdiction, count(*) AS docs, CAST(sum({' + '.join(_count_sql(m) for m in MARKERS)}) AS BIGINT) AS markers FROM docs WHERE source_type = 'en' GROUP BY 1) SELECT *, round(markers / docs * 1000, 1) AS per_1000 FROM r WHERE docs >= 20")
def marker_rates(spark, sf_dir):
    return analytics.marker_rates(corpus(spark, sf_dir), MARKERS, 20, "en")


@query(f"WITH {DOCS} SELECT count(*) AS docs, count(DISTINCT nullif(jurisdiction, '')) AS jurisdictions, count(DISTINCT nullif(ticker, '')) AS tickers FROM docs")
def corpus_counts(spark, sf_dir):
    return analytics.corpus_counts(corpus(spark, sf_dir))


@query("SELECT lang AS source_type, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, sf_dir):
    return analytics.source_counts(corpus(spark, sf_dir))


@query("SELECT n_name AS symbol, CAST(n_regionkey AS VARCHAR) AS sector, count(s_suppkey) AS docs, max(s_name) AS last_receipt FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY ALL")
def ticker_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return analytics.ticker_counts(n.select(F.col("n_name").alias("symbol"), F.col("n_regionkey").cast("string").alias("sector")), s.select(F.col("n_name").alias("ticker"), F.col("s_name").alias("date")))


_FLOW = "t AS (SELECT o_orderpriority AS ticker, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CASE o_orderstatus WHEN 'O' THEN 'P' WHEN 'F' THEN 'S' ELSE 'A' END AS code, o_totalprice AS value, o_custkey AS who, o_orderkey FROM orders)"


def transactions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderstatus") == "O", "P").when(F.col("o_orderstatus") == "F", "S").otherwise("A")
    return o.select(
        F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").cast("string").alias("transaction_date"), code.alias("code"), F.col("o_totalprice").alias("value"),
        F.lit(1.0).alias("shares"), F.col("o_custkey").cast("string").alias("filer_name"), F.col("o_orderkey").alias("ord"),
    )


@query(f"""WITH {_FLOW}, f AS (SELECT ticker, count(*) AS transactions, round(coalesce(sum(value) FILTER (code = 'P'), 0), 1) AS buys_value, round(coalesce(sum(value) FILTER (code = 'S'), 0), 1) AS sells_value,
count(DISTINCT who) FILTER (code = 'S') AS insiders_selling, count(DISTINCT who) FILTER (code = 'P') AS insiders_buying, max(d) AS last_transaction_date FROM t WHERE code <> 'A' AND d >= '1997-01-01' GROUP BY ticker) SELECT * FROM f""")
def net_flow(spark, sf_dir):
    rows = analytics.net_flow(transactions(spark, sf_dir), "1997-01-01")
    return rows.select("ticker", "transactions", F.round("buys_value", 1).alias("buys_value"), F.round("sells_value", 1).alias("sells_value"), "insiders_selling", "insiders_buying", "last_transaction_date")


@query(f"WITH {_FLOW} SELECT ticker, substr(d, 1, 7) AS month, round(coalesce(sum(value) FILTER (code = 'P'), 0), 2) AS buys_value, round(coalesce(sum(value) FILTER (code = 'S'), 0), 2) AS sells_value FROM t WHERE code <> 'A' AND d >= '1997-01-01' GROUP BY ALL")
def net_flow_by_month(spark, sf_dir):
    return analytics.net_flow_by_month(transactions(spark, sf_dir), "1997-01-01")


@query(f"WITH {_FLOW} SELECT ticker, o_orderkey AS ord, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC, o_orderkey) AS place FROM t WHERE code <> 'A' AND d >= '1997-01-01') WHERE place <= 10")
def recent_transactions(spark, sf_dir):
    return analytics.recent_transactions(transactions(spark, sf_dir), "1997-01-01").select("ticker", "ord", "place")


@query("SELECT event_type AS jurisdiction, count(*) AS n, round(coalesce(sum(value) FILTER (user_id % 4 <> 0), 0), 2) AS queued_mw, round(coalesce(sum(value) FILTER (user_id % 4 = 0), 0), 2) AS withdrawn_mw FROM events GROUP BY 1")
def queue_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("jurisdiction"), F.col("value").alias("mw"), (F.col("user_id") % 4 == 0).alias("withdrawn"))
    return analytics.queue_rollup(e).withColumns({c: F.round(c, 2) for c in ("queued_mw", "withdrawn_mw")})


_KINDS = "CASE l_returnflag WHEN 'A' THEN 'power' WHEN 'N' THEN 'jobs' ELSE 'money' END"


@query(f"""WITH q AS (SELECT o_orderpriority AS jurisdiction, o_orderkey, {_KINDS} AS kind, l_quantity AS v, CASE WHEN l_linestatus = 'O' THEN 'annual' ELSE 'total' END AS cadence FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
SELECT jurisdiction, coalesce(sum(v) FILTER (kind = 'power'), 0) AS promised_mw, 0.0::DOUBLE AS promised_gpd, coalesce(sum(v) FILTER (kind = 'jobs'), 0) AS promised_jobs, coalesce(sum(v) FILTER (kind = 'money' AND cadence = 'annual'), 0) AS promised_dollars_annual,
coalesce(sum(v) FILTER (kind = 'money' AND cadence = 'total'), 0) AS promised_dollars_total, count(DISTINCT o_orderkey) FILTER (v IS NOT NULL) AS n_quantified FROM q GROUP BY jurisdiction""")
def quantity_rollup(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "power").when(F.col("l_returnflag") == "N", "jobs").otherwise("money")
    one = F.struct(kind.alias("kind"), F.col("l_quantity").alias("value"), F.lit(None).cast("string").alias("unit"), F.when(F.col("l_linestatus") == "O", "annual").otherwise("total").alias("cadence"), F.lit("").alias("raw_span"))
    items = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(one).alias("quantities"))
    rows = table(spark, sf_dir, "orders").join(items, "o_orderkey", "left").select(F.col("o_orderpriority").alias("jurisdiction"), "quantities")
    return analytics.quantity_rollup(rows, "jurisdiction")


@query("SELECT o_orderpriority AS category, count(*) AS count FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def promise_categories(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("jurisdiction"), F.col("o_orderdate").cast("string").alias("date"), F.col("o_orderkey").alias("ord"))
    return analytics.promise_list(o, 20, jurisdiction="O")[1]


@query("SELECT o_orderkey AS ord FROM orders WHERE o_orderstatus = 'O' ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey LIMIT 20")
def promise_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("jurisdiction"), F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_orderkey").alias("ord"))
    return analytics.promise_list(o, 20, jurisdiction="O")[0].select("ord")


@query("WITH h AS (SELECT n_name || ', ' || r_name AS place, 'j' || n_nationkey AS jurisdiction FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0) SELECT s_suppkey, jurisdiction FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN h ON place = n_name || ', ' || r_name")
def jurisdiction_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    mapping = n.where("n_nationkey % 2 = 0").select(F.concat_ws(", ", "n_name", "r_name").alias("place"), F.concat(F.lit("j"), "n_nationkey").alias("jurisdiction"))
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("county"), F.col("r_name").alias("state"))
    hits, misses = joins.join_jurisdictions(rows, mapping)
    return hits.select("s_suppkey", "jurisdiction").unionByName(misses.select("s_suppkey", F.lit(None).cast("string").alias("jurisdiction")))


@query("WITH o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey AS symbol, o.n AS n_events, p.n AS n_transactions, coalesce(o.n, p.n) IS NOT NULL AS on_record FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey")
def cross_with_record(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), "o_orderstatus")
    empty = o.where("o_orderstatus = 'none'")
    rows = analytics.cross_with_record(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol")), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), empty, empty)
    return rows.select("symbol", "n_events", "n_transactions", "on_record")


@query(f"WITH {DOCS}, f AS (SELECT *, sha256(text) AS accession FROM docs WHERE date >= '2024-02-01' AND source_type IN ('en', 'fr') AND sha256(text) NOT IN (SELECT sha256(text) FROM docs WHERE jurisdiction = 'src7')) SELECT arg_min(id, ord) AS id, accession FROM f GROUP BY accession")
def new_filings(spark, sf_dir):
    """Texts stand for filings: copies are one, and what one source has is known."""
    rows = corpus(spark, sf_dir).withColumn("accession", F.sha2("text", 256))
    entries = rows.select("id", "accession", F.col("source_type").alias("form"), F.col("date").alias("filing_date"), "ord")
    return joins.new_filings(entries, rows.where("jurisdiction = 'src7'").select("accession"), "2024-02-01", ("en", "fr")).select("id", "accession")


@query(f"WITH {DOCS} SELECT jurisdiction, arg_max(id, (date, -ord)) AS video_id FROM docs WHERE ord % 2 = 0 GROUP BY 1")
def newest_alive(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumns({"id": F.concat(F.lit("yt:"), "id", F.lit(":seg000")), "source_type": F.lit("county_meeting")})
    alive = corpus(spark, sf_dir).where("ord % 2 = 0").select(F.col("id").alias("video_id"))
    return joins.newest_alive(rows, alive)


@query(f"WITH {DOCS}, w AS (SELECT a.id AS promise_id, b.id AS doc_id, row_number() OVER (PARTITION BY a.id ORDER BY b.date, b.id) AS place FROM docs a JOIN docs b ON a.jurisdiction = b.jurisdiction AND b.date > a.date) SELECT promise_id, doc_id, CAST(place AS INTEGER) AS place FROM w WHERE place <= 5")
def later_trail(spark, sf_dir):
    d = corpus(spark, sf_dir)
    return analytics.later_documents(d.select(F.col("id").alias("promise_id"), "jurisdiction", "date"), d, 5)


@query("WITH a AS (SELECT doc_id AS id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id AS id FROM documents WHERE source = 'src0') SELECT 'and' AS op, id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'or', id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'not', id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set_operations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = d.where("lang = 'en'").select(F.col("doc_id").alias("id")), d.where("source = 'src0'").select(F.col("doc_id").alias("id"))
    parts = [search.combined(a, b, how).select(F.lit(how).alias("op"), "id") for how in ("and", "or", "not")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9$'']+'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "))) AS INTEGER) AS n FROM documents")
def content_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.content_tokens(F.col("text"))).alias("n"))


@query()
def page_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parsers.html_text(F.col("html")).alias("text"))


@query("SELECT lang AS jurisdiction, source AS status, count(*) AS n, GROUPING(lang) = 1 AS everyone FROM documents GROUP BY GROUPING SETS ((lang, source), (source))")
def status_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return analytics.outcome_summary(d.select(F.col("doc_id").alias("promise_id"), F.col("lang").alias("jurisdiction")), d.select(F.col("doc_id").alias("promise_id"), F.col("source").alias("status")))


@query("SELECT doc_id, o.status FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'quiet' ELSE 'followed_up' END AS status FROM labels) o USING (doc_id)")
def promise_outcomes(spark, sf_dir):
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("promise_id"), F.when(F.col("toxic") == 1, "quiet").otherwise("followed_up").alias("status"), F.lit(None).cast("string").alias("trail"))
    return analytics.with_outcomes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("promise_id")), found).select(F.col("promise_id").alias("doc_id"), "status")


@query(rf"WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(text, '(?im)^[^\S\n]*item[\s]+(\d\.\d\d)\b', 1) AS items FROM documents) SELECT id, items FROM x WHERE len(items) > 0")
def event_items_of_documents(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", extract.event_items(F.col("text")).alias("items")).where(F.size("items") > 0)


@query()
def quantities_of_documents(spark, sf_dir):
    """Every quantity of every document; its SQL twin is quantity_fixture, on literal rows."""
    return corpus(spark, sf_dir).select("id", F.inline(extract.quantities(F.col("text"))))


@query()
def names_of_documents(spark, sf_dir):
    return analytics.mine_shell_candidates(corpus(spark, sf_dir).withColumn("source_type", F.lit("county_meeting"))).select("name", "n_docs", "first_seen", "jurisdictions")


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(rf"""WITH {DOCS}, d AS (SELECT *, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9$'']+'), lambda t: t NOT IN ({_STOP})) AS ts FROM docs),
p AS (SELECT 'p' || item_id AS promise_id, d.jurisdiction, '2023-12-31' AS date, list_filter(regexp_extract_all(lower(b.text), '[a-z0-9$'']+'), lambda t: t NOT IN ({_STOP})) AS ts FROM benchmark b JOIN d ON d.ord = item_id WHERE d.jurisdiction IS NOT NULL),
g AS (SELECT DISTINCT promise_id, jurisdiction, ts[i:i + 3] AS g FROM (SELECT promise_id, jurisdiction, ts, unnest(range(1, len(ts) - 2)) AS i FROM p)),
h AS (SELECT DISTINCT promise_id, d.id, d.date FROM g JOIN d USING (jurisdiction) WHERE list_has_all(d.ts, g.g)
  AND regexp_matches(d.text, '(?i)' || array_to_string(list_transform(g.g, lambda t: replace(t, '$', '\$')), '[^\p{{L}}\p{{N}}_]+(?:[\p{{L}}\p{{N}}_]{{1,3}}[^\p{{L}}\p{{N}}_]+)*'))),
t AS (SELECT promise_id, list(id ORDER BY date, id)[1:5] AS trail FROM h GROUP BY promise_id)
SELECT promise_id, CASE WHEN trail IS NOT NULL THEN 'followed_up' WHEN datediff('day', DATE '2023-12-31', CAST((SELECT max(date) FROM docs x WHERE x.jurisdiction = p.jurisdiction) AS DATE)) > {analytics.QUIET_DAYS} THEN 'quiet' ELSE 'too_recent' END AS status,
  coalesce(trail, []::VARCHAR[]) AS trail FROM p LEFT JOIN t USING (promise_id)""")
def outcomes_of_passages(spark, sf_dir):
    """Each benchmark passage as a promise in the jurisdiction of the document of its number, followed up by the documents that echo it."""
    d = corpus(spark, sf_dir)
    promises = table(spark, sf_dir, "benchmark").join(d.select("ord", "jurisdiction"), F.col("item_id") == F.col("ord")).where("jurisdiction is not null")
    rows = analytics.outcomes(promises.select(F.concat(F.lit("p"), "item_id").alias("promise_id"), "jurisdiction", F.lit("2023-12-31").alias("date"), F.col("text").alias("quote")), d)
    return rows.select("promise_id", "status", F.transform("trail", lambda t: t["doc_id"]).alias("trail"))


@query("""WITH q AS (SELECT o_orderpriority AS jurisdiction, count(DISTINCT o_orderkey) FILTER (l_orderkey IS NOT NULL) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_quantified FROM q""")
def promised_total(spark, sf_dir):
    return analytics.promised_total(quantity_rollup(spark, sf_dir))


@query(f"""WITH {_CLOSES}, {_HITS}, t AS (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM p), u AS (SELECT * FROM t WHERE CAST(date AS DATE) >= CAST(last AS DATE) - 9), l AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prior FROM u),
m AS (SELECT ticker, date, (close - prior) / prior * 100 AS r FROM l WHERE prior <> 0 AND abs((close - prior) / prior * 100) >= 5) SELECT m.ticker, m.date, round(r, {DIGITS}) AS return_pct, count(h.id) AS n FROM m LEFT JOIN h ON h.ticker = m.ticker AND CAST(m.date AS DATE) - CAST(h.date AS DATE) BETWEEN 0 AND 3 GROUP BY ALL""")
def price_report(spark, sf_dir):
    docs = clicks(spark, sf_dir).withColumns({c: F.lit("") for c in ("source_type", "venue_type", "deep_link", "text")})
    rows = analytics.price_report(closes(spark, sf_dir), docs, 10, 5.0, 3)
    return rows.select("ticker", "date", F.round("return_pct", DIGITS).alias("return_pct"), F.size("receipts").cast("long").alias("n"))


@query(ORACLES["mention_returns"].replace("SELECT ticker, id AS doc_id", "SELECT doc_id, date, return_pct FROM (SELECT ticker, id AS doc_id") + ") WHERE CAST('2024-01-25' AS DATE) - CAST(date AS DATE) BETWEEN 0 AND 10 ORDER BY return_pct DESC, doc_id LIMIT 25")
def recent_mentions(spark, sf_dir):
    rows = analytics.mention_returns(clicks(spark, sf_dir), closes(spark, sf_dir), "2024-01-10")
    return analytics.recent_mentions(rows, "2024-01-25", 10, 25).select("doc_id", "date", "return_pct")


# ---- fixtures: parsers and extractors over literal rows


@query(values("quote_id, kind, value, unit, cadence, raw_span",
    "('q1', 'money', 1.5e9::DOUBLE, NULL, 'total', '$1.5 billion')", "('q1', 'jobs', 2, NULL, NULL, 'two hundred jobs')", "('q1', 'power', 300, 'MW', NULL, '300 megawatts')",
    "('q1', 'water', 2000, 'GPD', NULL, '2,000 gallons per day')", "('q2', 'money', 2e6, NULL, 'annual', '$2 million')", "('q2', 'jobs', 50, NULL, NULL, '50 permanent full-time positions')",
    "('q4', 'power', 1200, 'MW', NULL, '1.2 GW')", "('q4', 'money', 12e6, NULL, 'total', '12 million dollars')"))
def quantity_fixture(spark, sf_dir):
    rows = spark.createDataFrame(fx.QUOTES, "quote_id string, text string")
    return rows.select("quote_id", F.inline(extract.quantities(F.col("text"))))


@query(values("answer_id, claims", "('a1', ['The county approved it [1].', 'Acme Inc. objected.', 'U.S. rules apply! [2][3]', 'Done'])", "('a2', ['费用为五百万。', '获批准。'])", "('a3', ['It cost 3.5 million.', 'Yes?[1]', 'No'])", "('a4', [])"))
def claim_fixture(spark, sf_dir):
    return spark.createDataFrame(fx.ANSWERS, "answer_id string, text string").select("answer_id", extract.claims(F.col("text")).alias("claims"))


@query(values("id, verdict, evidence_chunk", "('v1', 'supported', NULL::BIGINT)", "('v2', 'unparseable', NULL)", "('v3', 'contradicted', 2)", "('v4', 'unparseable', NULL)", "('v5', 'unparseable', NULL)", "('v6', 'unparseable', NULL)"))
def verdict_fixture(spark, sf_dir):
    return spark.createDataFrame(fx.JUDGED, "id string, text string").select("id", extract.judged(F.col("text")).alias("j")).select("id", "j.verdict", "j.evidence_chunk")


@query(values("id, text, date, jurisdiction", "('yt:v1:seg000', 'good evening everyone', '2024-01-02', 'Alpha County, VA')", "('yt:v1:seg001', 'item & motion', '2024-01-02', 'Alpha County, VA')"))
def caption_fixture(spark, sf_dir):
    return parsers.caption_docs(spark.createDataFrame(fx.VIDEOS, "video string, upload_date string, vtt string, jurisdiction string")).select("id", "text", "date", "jurisdiction")


@query(values("id, date, starts", "('edgar:AAA:0000000001-24-000001:item1a', '2024-02-01', 'Item 1A.')", "('edgar:AAA:0000000001-24-000001:item7', '2024-02-01', 'Item 7. ')", "('edgar:AAA:0000000001-24-000002:body', '2024-03-01', 'Item 2.0')"))
def filing_fixture(spark, sf_dir):
    rows = parsers.filing_docs(spark.createDataFrame(fx.FILINGS, "ticker string, accession string, form string, filing_date string, html string"))
    return rows.select("id", "date", F.substring("text", 1, 8).alias("starts"))


@query(values("id, speaker, text", "('fmp:AAA:2024q1:turn001', 'Operator', 'Welcome. please hold Jane Q. Doe: hi')", "('fmp:AAA:2024q1:turn002', 'Jane Doe', 'Hello: all again')", "('fmp:AAA:2024q1:turn003', 'Operator', 'Bye')", "('fmp:BBB:2024q2:turn001', NULL, 'no speakers here' || chr(10) || 'at all')"))
def transcript_fixture(spark, sf_dir):
    return parsers.transcript_docs(spark.createDataFrame(fx.CALLS, "symbol string, quarter int, year int, date string, content string")).select("id", "speaker", "text")


@query(values("ticker, accession, filer_name, is_officer, code, value, shares_owned_after", "('AAA', 'acc1', 'DOE JANE', true, 'S', 1050::DOUBLE, 900::DOUBLE)"))
def form4_fixture(spark, sf_dir):
    return parsers.transactions(spark.createDataFrame(fx.XML, "ticker string, accession string, filing_url string, xml string")).select("ticker", "accession", "filer_name", "is_officer", "code", "value", "shares_owned_after")


@query(values("ticker, accession, form, filing_date", "('AAA', '0000000001-24-000009', '8-K', '2024-06-01')"))
def feed_fixture(spark, sf_dir):
    entries = parsers.feed_entries(spark.createDataFrame([("AAA", fx.ATOM)], "ticker string, xml string"))
    known = joins.corpus_accessions(spark.createDataFrame([("edgar:AAA:0000000001-24-000001:item7",)], "id string"))
    return joins.new_filings(entries, known, "2024-01-01").select("ticker", "accession", "form", "filing_date")


@query(values("accession, form, tickers, filing_date", "('0000000001-24-000011', '8-K', ['ACM', 'ACMW'], '2024-06-02')"))
def fts_fixture(spark, sf_dir):
    return parsers.fts_hits(spark.createDataFrame([(fx.FTS,)], "json string")).select("accession", "form", "tickers", "filing_date")


@query(values("iso, queue_id, county, mw, fuel, queue_date, withdrawn", "('MISO', 'J1', 'Polk', 1200.5::DOUBLE, 'Wind', '2023-01-05', false)", "('MISO', 'J2', 'Linn', 0, 'Solar', '2022-03-04', true)", "('SPP', 'G1', 'Tulsa', 100, 'Gas', '2020-01-02', false)", "('SPP', 'G2', 'Ellis', 2000, 'Wind', '2021-05-06', true)"))
def queue_fixture(spark, sf_dir):
    rows = parsers.miso_queue(spark.createDataFrame([(fx.MISO,)], "json string")).unionByName(parsers.spp_queue(spark.createDataFrame([(fx.SPP,)], "csv string")))
    return rows.select("iso", "queue_id", "county", "mw", "fuel", "queue_date", "withdrawn")


@query(values("permit_id, facility, jurisdiction", "('P1', 'Plant', 'Polk County, IA')"))
def permit_fixture(spark, sf_dir):
    rows = parsers.permit_facilities(spark.createDataFrame([(fx.PERMITS,)], "json string"))
    mapping = spark.createDataFrame([("Polk, IA", "Polk County, IA")], "place string, jurisdiction string")
    return joins.pull_jurisdictions(rows, mapping)[0].select("permit_id", "facility", "jurisdiction")


@query(values("id, text, date", "('legistar:mesa:matter:7', 'F-1 — Rezoning', '2024-01-05')"))
def legistar_fixture(spark, sf_dir):
    return parsers.legistar_docs(spark.createDataFrame(fx.MATTERS, "client string, jurisdiction string, json string"), "matter").select("id", "text", "date")


@query(values("ticker, date, close", "('csv', '2024-01-02', 10::DOUBLE)", "('csv', '2024-01-03', 11.5)", "('json', '2024-01-02', 1.5)", "('json', '2024-01-03', 2)", "('chart', '2024-01-02', 1)", "('chart', '2024-01-04', 3)"))
def price_fixture(spark, sf_dir):
    one = lambda name, body, column: spark.createDataFrame([(name, body)], f"ticker string, {column} string")
    rows = parsers.stooq_prices(one("csv", fx.STOOQ, "csv")).unionByName(parsers.fmp_prices(one("json", fx.FMP_PRICES, "json")))
    return rows.unionByName(parsers.chart_prices(one("chart", fx.CHART, "json")))


@query(values("video_id, title, status", "('abc', 'Board | Session', 'is_live')"))
def stream_fixture(spark, sf_dir):
    return parsers.hearings(parsers.stream_entries(spark.createDataFrame(fx.STREAMS, "jurisdiction string, line string"))).select("video_id", "title", "status")


@query(values("doc_id, items", "('e1', ['2.02', '9.01'])"))
def event_fixture(spark, sf_dir):
    rows = spark.createDataFrame(fx.EVENT_DOCS, "id string, text string, source_type string, ticker string, date string, deep_link string")
    return analytics.build_events(rows).select("doc_id", "items")


@query(values("name, n_docs, first_seen, jurisdictions", "('Project Falcon', 2::BIGINT, '2024-01-01', ['Alpha', 'Beta'])", "('Jade River Holdings LLC', 1, '2024-01-01', ['Alpha'])", "('Blue Partners', 1, '2024-01-01', ['Alpha'])"))
def shell_fixture(spark, sf_dir):
    rows = spark.createDataFrame(fx.SHELL_DOCS, "id string, text string, source_type string, jurisdiction string, date string, deep_link string")
    return analytics.mine_shell_candidates(rows).select("name", "n_docs", "first_seen", "jurisdictions")


@query(values("shell, ticker, n_cooccurrence_docs", "('Project Falcon', 'ACM', 1::BIGINT)"))
def evidence_fixture(spark, sf_dir):
    rows = spark.createDataFrame(fx.SHELL_DOCS, "id string, text string, source_type string, jurisdiction string, date string, deep_link string")
    terms = spark.createDataFrame([("ACM", "Acme Corp")], "ticker string, term string")
    return analytics.link_evidence(analytics.mine_names(rows), rows, terms).select("shell", "ticker", "n_cooccurrence_docs")


_THREE = r"[\p{L}\p{N}]+( [\p{L}\p{N}]+){2}"
_EDGES = r"'(^|[^\p{L}\p{N}_])' || %s || '([^\p{L}\p{N}_]|$)'"


@query(f"""WITH n AS (SELECT item_id, regexp_extract(text, '{_THREE}') AS head, regexp_extract_all(text, '{_THREE}')[-1] AS tail FROM benchmark),
a AS (SELECT DISTINCT head AS shell, doc_id FROM n JOIN documents d ON CASE WHEN contains(d.text, head) THEN regexp_matches(d.text, {_EDGES % 'head'}) ELSE false END WHERE head <> ''),
b AS (SELECT DISTINCT 'T' || item_id AS ticker, doc_id FROM n JOIN documents d ON CASE WHEN contains(d.text, tail) THEN regexp_matches(d.text, {_EDGES % 'tail'}) ELSE false END WHERE tail <> '')
SELECT shell, ticker, count(*) AS n_cooccurrence_docs FROM a JOIN b USING (doc_id) GROUP BY ALL""")
def evidence_in_documents(spark, sf_dir):
    """Names and terms are the first and the last three words of benchmark passages that stand together; all documents are looked through."""
    items = table(spark, sf_dir, "benchmark").withColumn("all", F.regexp_extract_all("text", F.lit(_THREE), F.lit(0)))
    names = items.select(F.get("all", F.lit(0)).alias("name")).where("name is not null").distinct()
    terms = items.select(F.concat(F.lit("T"), "item_id").alias("ticker"), F.get("all", F.size("all") - 1).alias("term")).where("term is not null")
    return analytics.link_evidence(names, corpus(spark, sf_dir), terms).select("shell", "ticker", "n_cooccurrence_docs")


@query(values("promise_id, status, signals", "('p1', 'followed_up', 'd1:quantity,d2:entity,d3:phrase')", "('p2', 'quiet', '')", "('p3', 'too_recent', '')", "('p4', 'too_recent', '')"))
def outcome_fixture(spark, sf_dir):
    docs = spark.createDataFrame(fx.OUTCOME_DOCS, "id string, text string, jurisdiction string, date string").withColumn("deep_link", F.lit(""))
    promises = spark.createDataFrame(fx.PROMISES, "promise_id string, jurisdiction string, date string, quote string")
    terms = spark.createDataFrame([("p1", ["Acme Corp"])], "promise_id string, terms array<string>")
    rows = analytics.outcomes(promises, docs, terms)
    return rows.select("promise_id", "status", F.array_join(F.transform("trail", lambda t: F.concat_ws(":", t["doc_id"], t["signal"])), ",").alias("signals"))


@query(values("letter_id, span, doc_id", "('l1', 'never said', 'd1')", "('l1', 'soon', 'zz')"))
def letter_fixture(spark, sf_dir):
    docs = spark.createDataFrame(fx.OUTCOME_DOCS, "id string, text string, jurisdiction string, date string")
    return rag.bad_letter_citations(spark.createDataFrame(fx.LETTERS, "letter_id string, letter string"), docs)


@query(values("question_id, refused, reason, answer, cited, status, supported_claims, total_claims", "('q1', false, NULL, 'Yes [2], no [1].', [2, 1], 'grounded', 1, 1)", f"('q2', true, '{rag.LOW_SCORE}', NULL, [], 'ungrounded', 0, 0)", f"('q3', true, '{rag.NO_RECORDS}', NULL, [], 'ungrounded', 0, 0)", f"('q4', true, '{rag.NOT_COVERED}', NULL, [], 'ungrounded', 0, 0)"))
def answer_fixture(spark, sf_dir):
    questions = spark.createDataFrame([("q1", "What happened?"), ("q2", "Which one?"), ("q3", "None?"), ("q4", "Else?")], "question_id string, question string")
    found = spark.createDataFrame([("q1", 1, 2.0, "a", "2024", "t1"), ("q1", 2, 1.0, "b", "2024", "t2"), ("q2", 1, 0.1, "a", "2024", "t"), ("q4", 1, 0.5, "a", "2024", "t")], "question_id string, rank int, score double, source_type string, date string, text string")
    generate = lambda rows: rows.withColumn("answer", F.when(F.col("question_id") == "q1", "Yes [2], no [1][9].").otherwise(F.lit(f"So: {rag.SENTINEL}.")))
    return rag.answers(questions, found, generate, 0.5).select("question_id", "refused", "reason", "answer", "cited", "grounding.status", "grounding.supported_claims", "grounding.total_claims")


@query(values("answer_id, supported, total, errors, faithfulness", "('a', 1::BIGINT, 2::BIGINT, 0::BIGINT, 0.5::DOUBLE)", "('b', 0, 1, 0, 0)", "('c', 0, 1, 1, 0)", "('d', 0, 0, 0, 0)", "('mean', NULL, NULL, NULL, 0.125)", "('all failed', NULL, NULL, NULL, NULL)"))
def faithfulness_fixture(spark, sf_dir):
    """Unparseable verdicts and calls that failed support nothing; the mean is null only where every call failed."""
    said = spark.createDataFrame([("a", "supported"), ("a", "unsupported"), ("b", "unparseable"), ("c", "error")], "answer_id string, verdict string")
    each = evaluation.faithfulness(said, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "answer_id string"))
    none = F.lit(None).cast("long")
    mean = lambda rows, name: evaluation.macro_faithfulness(rows).select(F.lit(name).alias("answer_id"), none.alias("supported"), none.alias("total"), none.alias("errors"), "faithfulness")
    return each.unionByName(mean(each, "mean")).unionByName(mean(each.where("answer_id = 'c'"), "all failed"))


@query(values("id, reason", "('ok', NULL)", "(NULL, 'missing text')", "(NULL, 'not a JSON object')", "(NULL, 'not a JSON object')"))
def document_lines_fixture(spark, sf_dir):
    good = '{"id":"ok","text":"t","source_type":"s","venue_type":"v","date":"d","deep_link":"l","extra":1}'
    lines = spark.createDataFrame([(good,), ("",), (good.replace('"t"', "null"),), ("[1]",), ("{bad",)], "value string")
    docs, bad = documents.parse_lines(lines)
    return docs.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select(F.lit(None).cast("string").alias("id"), "reason"))


@query(values("id, score", "('a', 0.032522475::DOUBLE)", "('b', 0.032522475)", "('c', 0.016129032)"))
def rrf_fixture(spark, sf_dir):
    one = spark.createDataFrame([("a", 1), ("c", 2), ("b", 3)], "id string, rank int").where("id <> 'b'")
    two = spark.createDataFrame([("b", 1), ("a", 2)], "id string, rank int")
    three = spark.createDataFrame([("b", 2)], "id string, rank int")
    return fusion.rrf_fuse([one, two, three], digits=9)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_top10(spark, sf_dir)

