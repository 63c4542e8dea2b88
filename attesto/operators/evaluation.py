"""Retrieval metrics, sweeps, reports and judge arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import claims, verdict_of
from ..functions.scoring import bm25, idf, idf_okapi
from ..functions.text import analyze_text, tokens
from ..functions.udf import reachable
from .chunking import chunk_corpus
from .index import Index, of_terms
from .ranking import global_rank
from .search import scores, top
from .tables import exists, small, written

#: Labels of an evaluation run, in order, and the metric's column of each.
LABELS = {"P@5": "precision_5", "P@10": "precision_10", "R@10": "recall_10", "R@50": "recall_50", "MRR": "mrr", "NDCG@10": "ndcg_10"}
KS = (5, 10, 50)
GATE = 0.5
#: Terms of a set of queries that are pushed into the postings' scan, and rows of a grid or of such terms that are broadcast.
PUSHED, BROADCAST_ROWS = 1000, 100_000
#: Hits of a task, a term of a query in a document each, about.
TASK_HITS = 1_000_000


def last_grades(judgments: DataFrame, order: str = "ord") -> DataFrame:
    """query_id, doc_id, grade: of repeated judgments the last counts."""
    return judgments.groupBy("query_id", "doc_id").agg(F.max_by("grade", order).alias("grade"))


def metrics(ranking: DataFrame, grades: DataFrame, ks=(10,), queries: DataFrame | None = None) -> DataFrame:
    """query_id with precision_k, recall_k, ndcg_k for each k, and mrr, of a ranking (query_id, doc_id, rank from 1).

    Grades of 1 and more are relevant; documents without a grade have 0. Precision divides
    by k whatever is returned. The ideal order is of all grades of a query. Queries
    without results, or without grades, have zeros.
    """
    asked = (queries if queries is not None else grades).select("query_id").distinct()
    graded = ranking.join(grades, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = F.col("grade") / F.log2(F.col("rank") + 1)
    hit = F.col("grade") >= 1
    parts = [F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        parts += [F.count_if(hit & (F.col("rank") <= k)).alias(f"hits_{k}"), F.coalesce(F.sum(F.when(F.col("rank") <= k, gain)), F.lit(0.0)).alias(f"dcg_{k}")]
    found = graded.groupBy("query_id").agg(*parts)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = grades.withColumn("place", place).groupBy("query_id").agg(
        F.count_if(hit).alias("relevant"), *(F.sum(F.when(F.col("place") <= k, F.col("grade") / F.log2(F.col("place") + 1))).alias(f"best_{k}") for k in ks)
    )
    rows = asked.join(found, "query_id", "left").join(ideal, "query_id", "left")
    out = [F.coalesce("mrr", F.lit(0.0)).alias("mrr")]
    for k in ks:
        hits = F.coalesce(f"hits_{k}", F.lit(0))
        out += [
            (hits / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias(f"precision_{k}"),
            F.when(F.col("relevant") > 0, hits / F.col("relevant")).otherwise(0.0).alias(f"recall_{k}"),
            F.when(F.col(f"best_{k}") > 0, F.coalesce(f"dcg_{k}", F.lit(0.0)) / F.col(f"best_{k}")).otherwise(0.0).alias(f"ndcg_{k}"),
        ]
    return rows.select("query_id", *out)


def means(per_query: DataFrame) -> DataFrame:
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names))


def gate(mean_ndcg: float | None, least: float = GATE) -> int:
    """0 passes, 1 is too low, 2 has nothing to judge by."""
    return 2 if mean_ndcg is None else int(mean_ndcg < least)


def latest_by_mode(history: DataFrame, order: str = "ord") -> DataFrame:
    """mode, ndcg of its last well-formed row."""
    return history.where("mode is not null and ndcg is not null").groupBy("mode").agg(F.max_by("ndcg", order).alias("ndcg"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times of queries (query_id, query)."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("int").alias("times"))


def batch_scores(index: Index, queries: DataFrame, grid: DataFrame | None = None, weight=idf) -> DataFrame:
    """query_id, id, score of all queries at once; with a grid (k1, b) a score for each of its cells.

    Postings are read once; the terms of few queries go into their scan and are broadcast,
    those of many are joined. The grid is a column on the rows that are left, so a sweep is
    one plan and one more shuffle.
    """
    terms = written(query_terms(queries))
    words = [r.term for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
    pushed = len(words) <= PUSHED
    postings, stats = (index.of_terms(words), of_terms(index.term_stats, words)) if pushed else (index.postings, index.term_stats)
    asked = small(terms.join(stats, "term").crossJoin(F.broadcast(index.corpus_stats)), BROADCAST_ROWS)  # corpus_stats is one row
    hits = postings.select("term", "id", "tf", "length").join(asked, "term")
    extra = []
    if grid is not None:
        hits, extra = hits.crossJoin(F.broadcast(grid)), ["k1", "b"]
    constants = (F.col("k1"), F.col("b")) if grid is not None else (F.lit(1.5), F.lit(0.75))
    score = F.col("times") * bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"), *constants, weight=weight)
    # A document's hits lie in blocks by term, so sums before the exchange would hold all hits and join few of them; a
    # task's share is bounded by the number of hits, which the frequencies say.
    many = (asked.agg(F.sum("df")).first()[0] or 0) * (grid.count() if grid is not None else 1)
    if many > TASK_HITS:
        hits = hits.select(*extra, "query_id", "id", score.alias("score")).repartition(-(-many // TASK_HITS), "query_id", "id")
        score = F.col("score")
    return hits.groupBy(*extra, "query_id", "id").agg(F.sum(score).alias("score"))


def ranks(scored: DataFrame, keys: list[str], k: int, digits: int | None = None) -> DataFrame:
    scored = scored.withColumn("score", F.round("score", digits)) if digits else scored
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sweep(index: Index, queries: DataFrame, grades: DataFrame, k1s, bs, k: int = 10, digits: int | None = None) -> DataFrame:
    """k1, b, ndcg: the mean over queries for each cell of the grid, in one plan; best_cell() picks.

    Grades meet the k best of each cell and query; the ideal orders are the same in all cells
    and taken once.
    """
    pairs = [(float(x), float(y)) for x in k1s for y in bs]
    if len(pairs) > BROADCAST_ROWS:
        raise ValueError("the grid is too large")
    grid = index.postings.sparkSession.createDataFrame(pairs, "k1 double, b double")
    cell = ["k1", "b"]
    found = ranks(batch_scores(index, queries, grid), [*cell, "query_id"], k, digits).withColumnRenamed("id", "doc_id")
    own = grades.join(queries.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id", "grade")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = own.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("place") + 1)).alias("best"))
    gain = found.join(own, ["query_id", "doc_id"]).groupBy(*cell, "query_id").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    each = gain.join(ideal, "query_id").where("best > 0").groupBy(*cell).agg(F.sum(F.col("dcg") / F.col("best")).alias("total"))
    n = queries.select("query_id").distinct().agg(F.count("*").alias("queries"))
    rows = grid.join(each, cell, "left").crossJoin(F.broadcast(n))
    return rows.select(*cell, F.when(F.col("queries") > 0, F.coalesce("total", F.lit(0.0)) / F.col("queries")).otherwise(0.0).alias("ndcg"))


def best_cell(cells: DataFrame) -> DataFrame:
    return cells.orderBy(F.desc("ndcg"), "k1", "b").limit(1)


def chunk_sweep(docs: DataFrame, queries: DataFrame, grades: DataFrame, windows, overlaps, ks=(10,), retrieve: Callable | None = None) -> DataFrame:
    """window, overlap, recall_k: the share of relevant documents that the best k chunks cover.

    The cells are one corpus: a chunk's id is led by its cell, and one plan builds all
    postings and scores them with each cell's own statistics. retrieve(chunks, queries, k),
    if given, ranks (query_id, id, rank) the chunks of all cells, whose column cell says which.
    """
    if 10 not in ks or any(w < 1 for w in windows) or any(o < 0 for o in overlaps):
        raise ValueError("windows are 1 or more, overlaps 0 or more, and ks hold 10")
    relevant = grades.where("grade >= 1").select("query_id", "doc_id")
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    made = [(w, o) for w in windows for o in overlaps if o < w]
    chunks = [chunk_corpus(docs.select("id", "text"), w, o).select(F.lit(f"{w}+{o}").alias("cell"), "chunk_id", "doc_ids", "text") for w, o in made]
    chunks = written(reduce(DataFrame.unionByName, chunks).withColumn("id", F.concat_ws("|", "cell", "chunk_id")))
    found = _cell_ranks(chunks, queries, max(ks)) if retrieve is None else retrieve(chunks, queries, max(ks))
    covered = found.join(chunks.select("id", "cell", F.explode("doc_ids").alias("doc_id")), "id").join(relevant, ["query_id", "doc_id"])
    hit = covered.groupBy("cell", "query_id", "doc_id").agg(F.min("rank").alias("rank")).groupBy("cell", "query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    cells = queries.sparkSession.createDataFrame([(f"{w}+{o}", w, o) for w, o in made], "cell string, window int, overlap int")
    rows = queries.select("query_id").distinct().crossJoin(F.broadcast(cells)).join(totals, "query_id", "left").join(hit, ["cell", "query_id"], "left")
    return rows.groupBy("window", "overlap").agg(*(F.avg(F.coalesce(F.col(f"h{k}") / F.col("n"), F.lit(0.0))).alias(f"recall_{k}") for k in ks))


def _cell_ranks(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, rank by BM25 of the k best chunks of each cell, with its own statistics."""
    counted = chunks.select("cell", "id", tokens(F.col("text")).alias("t")).withColumn("length", F.size("t"))
    terms = query_terms(queries)
    stats = counted.groupBy("cell").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    hits = counted.select("cell", "id", "length", F.explode("t").alias("term")).join(small(written(terms), BROADCAST_ROWS), "term")
    hits = hits.groupBy("cell", "query_id", "term", "times", "id", "length").agg(F.count("*").alias("tf"))
    df = hits.groupBy("cell", "query_id", "term").agg(F.count("*").alias("df"))
    scored = hits.join(df, ["cell", "query_id", "term"]).join(F.broadcast(stats), "cell")  # a row a cell
    score = F.col("times") * bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"))
    return ranks(scored.groupBy("cell", "query_id", "id").agg(F.sum(score).alias("score")), ["cell", "query_id"], k).select("query_id", "id", "rank")


def best_chunking(cells: DataFrame) -> DataFrame:
    return cells.orderBy(F.desc("recall_10"), "window", "overlap").limit(1)


def mode_report(rankings: dict[str, DataFrame], grades: DataFrame, ks=(10,)) -> DataFrame:
    """mode with the mean of each metric."""
    return reduce(DataFrame.unionByName, [means(metrics(r, grades, ks)).withColumn("mode", F.lit(m)) for m, r in rankings.items()])


def evaluation_run(ranking: DataFrame, judgments: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame, int]:
    """(a row of the six labels for each judged query, their means, exit code) of a ranking (query_id, doc_id, rank).

    All judged queries count, those without results with zeros. The code is 0 if the mean
    NDCG@10 reaches the gate, 1 if not, 2 without any judgment.
    """
    grades = last_grades(judgments, order)
    rows = metrics(ranking, grades, KS, judgments.select("query_id"))
    rows = written(rows.select("query_id", *(F.col(c).alias(label) for label, c in LABELS.items())))
    mean = means(rows)
    return rows, mean, 2 if not rows.limit(1).count() else gate(mean.first()["NDCG@10"])


def history_row(rows: DataFrame, mean: DataFrame, corpus_version: str, git_sha: str = "unversioned", timestamp: str | None = None) -> DataFrame:
    """One row for the scoreboard: timestamp, git_sha, corpus_version, metrics (per_query, mean). Queries are judged by hand, so they fit one row."""
    labels = lambda at: F.create_map(*(x for label in LABELS for x in (F.lit(label), at(label))))
    each = F.array_sort(F.collect_list(F.struct("query_id", *(F.col(f"`{x}`") for x in LABELS))))
    per_query = rows.agg(F.map_from_entries(F.transform(each, lambda r: F.struct(r["query_id"], labels(lambda x: r[x])))).alias("per_query"))
    now = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return per_query.crossJoin(mean.select(labels(lambda x: F.col(f"`{x}`")).alias("mean"))).select(
        now.alias("timestamp"), F.lit(git_sha).alias("git_sha"), F.lit(corpus_version).alias("corpus_version"), F.struct("per_query", "mean").alias("metrics")
    )


def sweep_artifact(cells: DataFrame, n_queries: int, k: int, corpus_version: str | None = None, index_dir: str | None = None) -> DataFrame:
    """One row that describes a sweep: grid, best, n_queries, k, corpus_version, index_dir."""
    grid = cells.agg(F.array_sort(F.collect_list(F.struct("k1", "b", F.col("ndcg").alias("ndcg10")))).alias("grid"))
    best = best_cell(cells).select(F.struct("k1", "b", F.col("ndcg").alias("ndcg10")).alias("best"))
    text = lambda x: F.lit(x).cast("string")
    return grid.crossJoin(best).select("grid", "best", F.lit(n_queries).alias("n_queries"), F.lit(k).alias("k"), text(corpus_version).alias("corpus_version"), text(index_dir).alias("index_dir"))


def differential_report(index: Index, queries: list[str], k: int = 10, digits: int | None = None) -> DataFrame:
    """query, terms, our_ranking, reference_ranking, order_agrees, score_transform, max_rel_score_diff for each of the queries.

    The last two are null outside the domain where a factor must relate the scores: one
    document frequency, below half of the corpus. digits rounds both scores before ranking.
    """
    parts = []
    for query in queries:
        words = sorted(set(analyze_text(query)))
        both = written(scores(index, query).withColumnRenamed("score", "ours").join(scores(index, query, weight=idf_okapi).withColumnRenamed("score", "other"), "id"))
        if digits:
            both = both.withColumns({c: F.round(c, digits) for c in ("ours", "other")})
        top_ids = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("s"), "id"))), lambda x: x["id"])
        best = [both.orderBy(F.desc(c), "id").limit(k).agg(top_ids(c).alias(name)) for c, name in (("ours", "our_ranking"), ("other", "reference_ranking"))]  # noqa: B023
        dfs = of_terms(index.term_stats, words).crossJoin(F.broadcast(index.corpus_stats))
        same = dfs.agg(((F.min("df") == F.max("df")) & (F.count("*") == len(words)) & (idf_okapi(F.max("df"), F.max("n")) > 0)).alias("ok"), (idf(F.max("df"), F.max("n")) / idf_okapi(F.max("df"), F.max("n"))).alias("c"))
        scaled = both.crossJoin(F.broadcast(same)).agg(F.max(F.abs(F.col("ours") - F.col("c") * F.col("other")) / F.when(F.col("ours") != 0, F.abs("ours")).otherwise(1.0)).alias("diff"))
        rows = best[0].crossJoin(best[1]).crossJoin(same).crossJoin(scaled)
        ok = F.coalesce(F.col("ok"), F.lit(False))
        parts.append(rows.select(
            F.lit(query).alias("query"), F.array(*(F.lit(w) for w in analyze_text(query))).cast("array<string>").alias("terms"), "our_ranking", "reference_ranking",
            (F.col("our_ranking") == F.col("reference_ranking")).alias("order_agrees"), F.when(ok, F.col("c")).alias("score_transform"), F.when(ok, F.coalesce("diff", F.lit(0.0))).alias("max_rel_score_diff"),
        ))
    return reduce(DataFrame.unionByName, parts)


def differential(index: Index, query: str) -> DataFrame:
    """id with our score and that of the other idf, their ranks and whether a constant factor must relate them.

    It must only where all terms have one document frequency below half of the corpus.
    """
    ours = scores(index, query).withColumnRenamed("score", "ours")
    other = scores(index, query, weight=idf_okapi).withColumnRenamed("score", "other")
    words = sorted(set(analyze_text(query)))
    dfs = index.term_stats.where(F.col("term").isin(words)).crossJoin(index.corpus_stats)
    flag = dfs.agg(F.coalesce((F.min("df") == F.max("df")) & (F.max("df") < F.max("n") / 2), F.lit(False)).alias("proportional"))
    both = global_rank(ours.join(other, "id"), [F.desc("ours"), F.col("id")], "our_rank")
    return global_rank(both, [F.desc("other"), F.col("id")], "other_rank").crossJoin(F.broadcast(flag))


def qa_from_judgments(judgments: DataFrame, least: int = 1, order: str = "ord") -> DataFrame:
    """qa_id, question, criterion, answer_doc_ids, origin of the queries with a document of at least this grade, in file order."""
    rows = judgments.groupBy("query_id", "doc_id").agg(F.max_by("grade", order).alias("grade"), F.min(order).alias("at"), F.min_by("query", order).alias("query"), F.min_by("criterion", order).alias("criterion"))
    ids = F.array_sort(F.collect_list(F.struct("at", "doc_id")))
    out = rows.where(F.col("grade") >= least).groupBy("query_id").agg(F.min_by("query", "at").alias("question"), F.min_by("criterion", "at").alias("criterion"), ids.alias("x"))
    return out.select(F.col("query_id").alias("qa_id"), "question", "criterion", F.col("x.doc_id").alias("answer_doc_ids"), F.lit("judgments").alias("origin"))


def refusal_rates(answers: DataFrame) -> DataFrame:
    """refusal over unanswerable questions and false refusal over answerable ones; 0 without any."""
    rate = lambda test: F.coalesce(F.avg(F.when(test, F.col("refused").cast("int"))), F.lit(0.0))
    return answers.agg(rate(~F.col("answerable")).alias("refusal_rate"), rate(F.col("answerable")).alias("false_refusal_rate"))


def answer_recall(cited: DataFrame, qa: DataFrame, chunk_doc_ids: DataFrame | None = None) -> DataFrame:
    """Mean over all questions of the share of their answer documents that are among (qa_id, doc_id).

    chunk_doc_ids (chunk_id, doc_id) says what documents a chunk stands for; without it an
    id stands for itself only.
    """
    got = cited.select("qa_id", "doc_id")
    if chunk_doc_ids is not None:
        got = got.unionByName(got.withColumnRenamed("doc_id", "chunk_id").join(chunk_doc_ids, "chunk_id").select("qa_id", "doc_id"))
    wanted = qa.select("qa_id", F.explode("answer_doc_ids").alias("doc_id")).distinct()
    hit = wanted.join(got.distinct().withColumn("hit", F.lit(1)), ["qa_id", "doc_id"], "left")
    each = hit.groupBy("qa_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    return qa.select("qa_id").join(each, "qa_id", "left").agg(F.coalesce(F.avg(F.coalesce("recall", F.lit(0.0))), F.lit(0.0)).alias("answer_recall"))


def judge_prompts(answers: DataFrame) -> DataFrame:
    """answer_id, at, claim, prompt for each claim of answers (answer_id, question, answer_text, chunk_texts): the question, the claim, the numbered chunks."""
    rows = answers.select("answer_id", "question", "chunk_texts", F.posexplode(claims(F.col("answer_text"))).alias("at", "claim"))
    blocks = F.array_join(F.transform("chunk_texts", lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")
    say = F.lit('Say whether the chunks support the claim. Reply with {"verdict": "supported", "unsupported" or "contradicted", "evidence_chunk": number or null} alone.')
    return rows.select("answer_id", "at", "claim", F.concat(say, F.lit("\n\nQUESTION\n"), "question", F.lit("\n\nCLAIM\n"), "claim", F.lit("\n\nCHUNKS\n"), blocks).alias("prompt"))


def judge_answers(answers: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """answer_id, at, claim, verdict, evidence_chunk: judge(prompt) for each claim, in Arrow batches on the executors.

    A call that fails makes the verdict error and nothing else; what cannot be read is
    unparseable. Both support nothing.
    """

    return judged_prompts(judge_prompts(answers), judge)


def judged_prompts(rows: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """rows with verdict and evidence_chunk in place of their prompt."""
    kept = [c for c in rows.columns if c != "prompt"]

    def run(frames):
        for f in frames:
            said = []
            for prompt in f.prompt:
                try:
                    said.append(verdict_of(judge(prompt)))
                except Exception:  # a judge that fails is data
                    said.append(("error", None))
            yield f[kept].assign(verdict=[v for v, _ in said], evidence_chunk=pd.array([c for _, c in said], "Int64"))

    reachable(rows.sparkSession)
    ddl = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "prompt")
    return rows.mapInPandas(run, f"{ddl}, verdict string, evidence_chunk long")


def ledgered(rows: DataFrame, key: str, call: Callable[[DataFrame], DataFrame], path: str, steps: int = 4) -> DataFrame:
    """What call says of rows, by key: only of keys that the ledger below path lacks, each key once, step by step.

    Keys are dealt to steps by their hash, and a step's results are appended when it is done; a run that was stopped, or
    that is made again with more rows, pays for nothing twice. call takes one row of each key and returns key and more.
    """
    spark = rows.sparkSession
    due = rows.dropDuplicates([key])
    if exists(spark, path):
        due = due.join(spark.read.parquet(path).select(key), key, "left_anti")
    due = written(due)
    for step in range(steps):
        call(due.where(F.pmod(F.xxhash64(key), F.lit(steps)) == step)).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(rows.select(key).distinct(), key, "left_semi")


def qa_run(
    qa: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame], judge: Callable[[str], str], path: str, corpus_version: str = "unversioned",
    git_sha: str = "unversioned", timestamp: str | None = None, min_confidence: float | None = None,
) -> DataFrame:
    """One row for the history of question answering, appended below path and returned: timestamp, git_sha, corpus_version, n, metrics.

    qa has qa_id, question, answer_doc_ids and answerable. retrieve takes (question_id, question) and gives question_id,
    rank, score, doc_id, source_type, date, text; generate and judge are as for rag.answers() and judge_answers(). metrics
    are the refusal rate of unanswerable questions, the false refusal rate of answerable ones, the answer recall of what
    was retrieved, and the faithfulness of the answers given. Both callables are asked through ledgers below path: what a
    stopped run was told is not asked again.
    """
    from . import rag

    spark = qa.sparkSession
    questions = qa.select(F.col("qa_id").alias("question_id"), "question")
    found = written(retrieve(questions).select("question_id", "rank", "score", "doc_id", "source_type", "date", "text"))

    def told(asked: DataFrame) -> DataFrame:
        keyed = asked.withColumn("key", F.sha2(F.concat_ws("\n", "question", "prompt_context"), 256))
        said = ledgered(keyed, "key", lambda rows: rows.join(generate(rows.select("question_id", "question", "prompt_context")), "question_id").select("key", "answer"), f"{path}/answers")
        return keyed.select("question_id", "key").join(said, "key")

    answered = written(rag.answers(questions, found, told, min_confidence))
    given_ = answered.where(~F.col("refused"))
    chunks = found.groupBy(F.col("question_id").alias("answer_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x")).select("answer_id", F.transform("x", lambda c: c["text"]).alias("chunk_texts"))
    rows = given_.join(questions, "question_id").select(F.col("question_id").alias("answer_id"), "question", F.col("answer").alias("answer_text")).join(chunks, "answer_id")
    prompts = written(judge_prompts(rows).withColumn("key", F.sha2("prompt", 256)))
    verdicts = prompts.drop("prompt").join(ledgered(prompts.select("key", "prompt"), "key", lambda due: judged_prompts(due, judge), f"{path}/verdicts"), "key")
    rates = refusal_rates(answered.join(qa.select(F.col("qa_id").alias("question_id"), "answerable"), "question_id"))
    recall = answer_recall(found.select(F.col("question_id").alias("qa_id"), "doc_id"), qa)
    faith = macro_faithfulness(faithfulness(verdicts, rows.select("answer_id")))
    now = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    metrics_ = F.struct("refusal_rate", "false_refusal_rate", "answer_recall", "faithfulness")
    row = rates.crossJoin(recall).crossJoin(faith).crossJoin(qa.agg(F.count("*").alias("n")))  # a row each
    row = written(row.select(now.alias("timestamp"), F.lit(git_sha).alias("git_sha"), F.lit(corpus_version).alias("corpus_version"), "n", metrics_.alias("metrics")))
    row.coalesce(1).write.mode("append").json(f"{path}/history")
    return row


def save_artifact(row: DataFrame, path: str) -> str:
    """Writes an artifact's one row as a JSON file, in place of an older one, and returns the path."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def faithfulness(verdicts: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """answer_id, supported, total, errors, faithfulness of verdicts (answer_id, verdict), for all answers if given; 0 without claims."""
    said = verdicts.groupBy("answer_id").agg(F.count_if(F.col("verdict") == "supported").alias("supported"), F.count("*").alias("total"), F.count_if(F.col("verdict") == "error").alias("errors"))
    if answers is not None:
        said = answers.select("answer_id").join(said, "answer_id", "left").na.fill(0)
    return said.withColumn("faithfulness", F.when(F.col("total") > 0, F.col("supported") / F.col("total")).otherwise(0.0))


def macro_faithfulness(per_answer: DataFrame) -> DataFrame:
    """faithfulness: the mean over answers; 0 without any, null where claims were judged and every call failed."""
    failed = (F.sum("total") > 0) & (F.sum("errors") == F.sum("total"))
    return per_answer.agg(F.when(~F.coalesce(failed, F.lit(False)), F.coalesce(F.avg("faithfulness"), F.lit(0.0))).alias("faithfulness"))


def judge_agreement(labels: DataFrame, verdicts: DataFrame, least: float = 0.8) -> DataFrame:
    """n, agreement and whether the judge may be used; labels whose id begins with example- don't count."""
    rows = labels.where(~F.col("label_id").startswith("example-")).join(verdicts, "label_id", "left")
    same = F.coalesce((F.col("verdict") == F.col("human_verdict")).cast("int"), F.lit(0))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(same), F.lit(0.0)).alias("agreement")).withColumn("passed", (F.col("n") > 0) & (F.col("agreement") >= least))


#: Model name prefixes and their families.
FAMILIES = {"gpt-": "openai", "o1": "openai", "o3": "openai", "o4": "openai", "claude-": "anthropic", "gemini": "google", "llama": "meta", "mistral": "mistral"}


def family(model: str) -> str | None:
    return next((f for p, f in FAMILIES.items() if model.lower().startswith(p)), None)


def require_other_family(generator: str, judge: str) -> None:
    """A judge must be of another family than the generator; an unknown model is an error."""
    a, b = family(generator), family(judge)
    if a is None or b is None or a == b:
        raise ValueError(f"{judge!r} may not judge {generator!r}")


def pool_candidates(docs: DataFrame, query: str, lexical: DataFrame, semantic: DataFrame | None, k: int, seed: int, random: int = 3, order: str = "ord") -> DataFrame:
    """id and place of candidates to judge: the first k documents that hold the query as it stands, whatever its case, the
    best k of each ranking (id, score) and a seeded few of all; each once, in seeded order."""
    held = docs.where(F.contains(F.lower("text"), F.lower(F.lit(query)))).orderBy(order, "id").limit(k).select("id")
    arms = [held, *(top(a, k).select("id") for a in (lexical, semantic) if a is not None)]
    key = lambda: F.md5(F.concat_ws(":", F.lit(seed), "id"))
    arms.append(docs.select("id").orderBy(key(), "id").limit(random))
    pool = reduce(DataFrame.unionByName, arms).distinct()
    return pool.join(docs.select("id"), "id", "left_semi").withColumn("place", F.row_number().over(Window.orderBy(key(), "id")))  # 3 * k + random rows at most


def pending_judgments(pool: DataFrame, judged: DataFrame, query_id: str, criterion: str) -> DataFrame:
    """pool without what is judged for the query; an error if its stored criterion differs."""
    own = judged.where(F.col("query_id") == query_id)
    first = own.orderBy("ord").select("criterion").limit(1).collect() if "ord" in judged.columns else own.select("criterion").limit(1).collect()
    if first and first[0].criterion != criterion:
        raise ValueError(f"{query_id}: the criterion has changed")
    return pool.join(own.select(F.col("doc_id").alias("id")), "id", "left_anti")
