"""Queries of operators over a few literal rows, with the result written out as SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import analytics, chunking, evaluation, fusion, joins, rag, search, vectors
from ..operators import index as indexes
from ..sources import documents, parsers
from . import fixtures as fx
from .base import query, values

_SPELLINGS = [("wide", "ＡＢＣ ﬁnance"), ("mark", "café owner"), ("greek", "ΟΔΟΣ"), ("plain", "Café finance"), ("sharp", "Straße")]
_ASKED = ("abc", "ＦＩＮＡＮＣＥ", "café", "οδος", "STRASSE")


@query(values("query, id", "('abc', 'wide')", "('ＦＩＮＡＮＣＥ', 'wide')", "('ＦＩＮＡＮＣＥ', 'plain')", "('café', 'mark')", "('café', 'plain')", "('οδος', 'greek')", "('STRASSE', 'sharp')"))
def unicode_search(spark, sf_dir):
    """Full-width letters, ligatures, combining marks, the final sigma and the sharp s are found by any spelling."""
    i = indexes.build(spark.createDataFrame(_SPELLINGS, "id string, text string"))
    parts = [search.boolean_search(i, q, "AND").select(F.lit(q).alias("query"), "id") for q in _ASKED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(values("query, id, score", "('abc', 'wide', 1.386294::DOUBLE)", "('straße', 'sharp', 1.667723)"))
def unicode_scan(spark, sf_dir):
    """ln(1 + 4.5 / 1.5) for a term of one of five documents, times 2.5 / (1 + 1.5 * (0.25 + 0.75 / 1.6)) for one word of 1.6; without an index."""
    docs = spark.createDataFrame(_SPELLINGS, "id string, text string")
    parts = [search.scan_scores(docs, q, b=0.0 if q == "abc" else 0.75).select(F.lit(q).alias("query"), "id", F.round("score", 6).alias("score")) for q in ("abc", "straße")]
    return parts[0].unionByName(parts[1])


@query(values("question_id, terms", "('q1', ['Chesterfield', 'substation', 'permit'])", "('q2', [])"))
def question_terms_fixture(spark, sf_dir):
    rows = spark.createDataFrame([("q1", "What did Chesterfield say about the substation and its permit, the Substation?"), ("q2", "what is it")], "question_id string, question string")
    return rows.select("question_id", text.question_terms(F.col("question")).alias("terms"))


@query(values("position, unit, half", "(0, 0.6::DOUBLE, 0.60009765625::DOUBLE)", "(1, 0.8, 0.7998046875)", "(2, 0, 0)"))
def vector_fixture(spark, sf_dir):
    rows = spark.createDataFrame([([3.0, 4.0, 0.0],)], "v array<double>").select(scoring.normalised(F.col("v")).alias("u"))
    rows = rows.select(F.posexplode(F.arrays_zip(F.col("u").alias("u"), vectors.half(F.col("u")).alias("h"))).alias("position", "x"))
    return rows.select("position", F.round(F.col("x.u").cast("double"), 6).alias("unit"), F.col("x.h").cast("double").alias("half"))


@query(values("id, score", "('d1', 0.9::DOUBLE)", "('d3', 0.7)"))
def projection_fixture(spark, sf_dir):
    hits = spark.createDataFrame([("c1", 0.9), ("c2", 0.8), ("c3", 0.7), ("zz", 0.6)], "chunk_id string, score double")
    chunks = spark.createDataFrame([("c1", ["d1", "d2"]), ("c2", ["gone"]), ("c3", ["d3"])], "chunk_id string, doc_ids array<string>")
    return fusion.project_to_docs(hits, chunks, spark.createDataFrame([("d1",), ("d2",), ("d3",)], "id string")).select("id", "score")


@query(values("id, snippet", "('a', 'hit')", "('b', 'head of b')"))
def hybrid_rows_fixture(spark, sf_dir):
    fused = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2)], "id string, score double, rank int")
    docs = spark.createDataFrame([("a", "head of a"), ("b", "head of b")], "id string, text string")
    return fusion.hybrid_rows(fused, docs, spark.createDataFrame([("a", "hit")], "id string, snippet string")).select("id", "snippet")


@query(values("what, message", "('identity', 'chunk ''c'' is not one document')", "('family', '''gpt-5'' may not judge ''gpt-4''')", "('unknown', '''gpt-5'' may not judge ''unheard''')", "('operator', 'unknown operator ''XOR''')", "('delete', '''9''')", "('criterion', 'q: the criterion has changed')", "('link', 'Falcon -> T: receipt is not in the corpus')", "('window', 'window must be at least 1 and overlap less than it')", "('sweep', 'windows are 1 or more, overlaps 0 or more, and ks hold 10')", "('rrf', 'k must be positive')", "('infinite', 'embedding store: components that are not finite')", "('foreign', 'embedding store: another model or dimension')", "('missing', '1 chunks have no embedding')", "('entry', '''zz''')", "('repeated id', 'repeated document id ''1''')", "('repeated chunk', 'repeated chunk id ''c''')", "('by', 'by is jurisdiction or ticker')"))
def guards_fixture(spark, sf_dir):
    """What the guards say of faults."""
    one = indexes.build(spark.createDataFrame([("1", "a")], "id string, text string"))
    links = spark.createDataFrame([("Falcon", "T", "confirmed", ["zz"])], "shell string, ticker string, confidence string, receipts array<string>")
    judged = spark.createDataFrame([("q", "old", "d", 1)], "query_id string, criterion string, doc_id string, ord int")
    held = lambda x: spark.createDataFrame([("c", "h", [x], "m", 1)], "chunk_id string, content_hash string, vec array<float>, model string, dim int")
    cases = {
        "identity": lambda: fusion.require_identity_chunks(spark.createDataFrame([("c", ["a", "b"])], "chunk_id string, doc_ids array<string>")),
        "family": lambda: evaluation.require_other_family("gpt-4", "gpt-5"), "unknown": lambda: evaluation.require_other_family("unheard", "gpt-5"),
        "operator": lambda: search.boolean_search(one, "a", "XOR"), "delete": lambda: one.delete(["9"]),
        "criterion": lambda: evaluation.pending_judgments(one.docs.select("id"), judged, "q", "new"), "link": lambda: analytics.checked_links(links, one.docs),
        "window": lambda: chunking.chunk_corpus(one.docs, 2, 2), "sweep": lambda: evaluation.chunk_sweep(one.docs, judged, judged, (1,), (0,), (5,)), "rrf": lambda: fusion.rrf_fuse([], 0),
        "infinite": lambda: vectors.check_store(held(float("inf")), "m", 1), "foreign": lambda: vectors.check_store(held(1.0), "other", 1), "entry": lambda: vectors.entry_for(held(1.0), "zz"),
        "missing": lambda: vectors.semantic_search(held(1.0), spark.createDataFrame([("c", "x"), ("d", "y")], "chunk_id string, text string"), [1.0], 1),
        "repeated id": lambda: indexes.assert_unique(one.docs.union(one.docs)), "by": lambda: analytics.quantity_rollup(one.docs, "id"),
        "repeated chunk": lambda: vectors.embed_corpus(held(1.0).union(held(2.0)).select("chunk_id", F.lit("x").alias("text")), lambda t: [[1.0]] * len(t), "m", 1),
    }
    said = []
    for name, case in cases.items():
        try:
            case()
        except (ValueError, KeyError) as error:
            said.append((name, str(error)))
    return spark.createDataFrame(said, "what string, message string")


@query(values("model, family", "('gpt-5-mini', 'openai')", "('Claude-x', 'anthropic')", "('unheard', NULL)"))
def family_fixture(spark, sf_dir):
    return spark.createDataFrame([(m, evaluation.family(m)) for m in ("gpt-5-mini", "Claude-x", "unheard")], "model string, family string")


@query(values('accession, query, forms, "window"', "('b', 'dam', ['8-K'], '2024')"))
def novel_fixture(spark, sf_dir):
    hits = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "accession string, ord int")
    rows = joins.novel_candidates(hits, spark.createDataFrame([("a",)], "accession string"), "dam", ["8-K"], "2024")
    return rows.select("accession", "provenance.query", "provenance.forms", "provenance.window")


@query(values("query_id, question, criterion, answer_doc_ids", "('q1', 'first?', 'c', ['b', 'a'])"))
def qa_fixture(spark, sf_dir):
    judged = spark.createDataFrame([("q1", "first?", "c", "b", 1, 0), ("q1", "first?", "c", "a", 2, 1), ("q1", "first?", "c", "x", 1, 2), ("q1", "first?", "c", "x", 0, 3), ("q2", "other?", "c", "y", 0, 4)], "query_id string, query string, criterion string, doc_id string, grade int, ord int")
    return evaluation.qa_from_judgments(judged).select(F.col("qa_id").alias("query_id"), "question", "criterion", "answer_doc_ids")


@query(values("id", "('b')"))
def pending_fixture(spark, sf_dir):
    pool = spark.createDataFrame([("a",), ("b",)], "id string")
    judged = spark.createDataFrame([("q", "c", "a", 1), ("other", "c", "b", 2)], "query_id string, criterion string, doc_id string, ord int")
    return evaluation.pending_judgments(pool, judged, "q", "c")


@query(values("query_id, doc_id, grade", "('q', 'd', 0)", "('q', 'e', 1)"))
def last_grades_fixture(spark, sf_dir):
    return evaluation.last_grades(spark.createDataFrame([("q", "d", 2, 1), ("q", "d", 0, 2), ("q", "e", 1, 3)], "query_id string, doc_id string, grade int, ord int"))


@query(values("refusal_rate, false_refusal_rate, plain, chunked", "(0.5::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 0.75::DOUBLE)"))
def refusal_fixture(spark, sf_dir):
    """Rates over all questions, and recall without and with what chunks stand for."""
    said = spark.createDataFrame([(False, True), (False, False), *((True, i == 0) for i in range(4))], "answerable boolean, refused boolean")
    qa = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["c"])], "qa_id string, answer_doc_ids array<string>")
    cited = spark.createDataFrame([("q1", "a"), ("q2", "chunk")], "qa_id string, doc_id string")
    chunks = spark.createDataFrame([("chunk", "c")], "chunk_id string, doc_id string")
    plain, chunked = (evaluation.answer_recall(cited, qa, x).withColumnRenamed("answer_recall", n) for x, n in ((None, "plain"), (chunks, "chunked")))
    return evaluation.refusal_rates(said).crossJoin(plain).crossJoin(chunked)


@query(values("n, agreement, passed", "(4::BIGINT, 0.75::DOUBLE, false)"))
def agreement_fixture(spark, sf_dir):
    labels = spark.createDataFrame([(f"l{i}", "supported") for i in range(4)] + [("example-1", "supported")], "label_id string, human_verdict string")
    return evaluation.judge_agreement(labels, spark.createDataFrame([(f"l{i}", "supported" if i else "unsupported") for i in range(4)], "label_id string, verdict string"))


@query(values('"at", claim, verdict, evidence_chunk', "(0, 'Yes [1].', 'supported', 1::BIGINT)", "(1, 'Nay.', 'error', NULL)", "(2, 'So?', 'unparseable', NULL)"))
def judge_fixture(spark, sf_dir):
    def judge(prompt: str) -> str:
        claim = prompt.split("CLAIM\n")[1]
        if claim.startswith("Nay."):
            raise RuntimeError("no reply")
        return '{"verdict": "supported", "evidence_chunk": 1}' if claim.startswith("Yes") else "maybe"

    answers = spark.createDataFrame([("a", "q?", "Yes [1]. Nay. So?", ["one"])], "answer_id string, question string, answer_text string, chunk_texts array<string>")
    return evaluation.judge_answers(answers, judge).select("at", "claim", "verdict", "evidence_chunk")


@query(values("mode, mrr, precision_2, recall_2", "('lexical', 0.75::DOUBLE, 0.5::DOUBLE, 1::DOUBLE)", "('semantic', 0.25, 0.25, 0.5)"))
def mode_report_fixture(spark, sf_dir):
    grades = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 2)], "query_id string, doc_id string, grade int")
    ranking = lambda rows: spark.createDataFrame(rows, "query_id string, doc_id string, rank int")
    modes = {"lexical": ranking([("q1", "a", 1), ("q2", "x", 1), ("q2", "b", 2)]), "semantic": ranking([("q1", "x", 1), ("q1", "a", 2), ("q2", "x", 1)])}
    return evaluation.mode_report(modes, grades, (2,)).select("mode", "mrr", "precision_2", "recall_2")


@query(values("query_id, mrr, precision_2, recall_2, ndcg_2", "('n', 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE)", "('q', 1, 0.5, 0.333333, 0.380094)", "('third', 0.333333, 0, 0, 0)"))
def metrics_fixture(spark, sf_dir):
    """Ranked a, b, c, d against a of 1, c of 2 and x of 1; a query without hits; a first hit at rank 3."""
    ranking = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abcd")] + [("n", "zz", 1), ("third", "x", 1), ("third", "y", 2), ("third", "z", 3)], "query_id string, doc_id string, rank int")
    grades = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("q", "x", 1), ("n", "y", 1), ("third", "z", 1)], "query_id string, doc_id string, grade int")
    return evaluation.metrics(ranking, grades, (2,)).select("query_id", *(F.round(c, 6).alias(c) for c in ("mrr", "precision_2", "recall_2", "ndcg_2")))


@query(values("question_id, rank, cited, snippet", "('q', 1, true, 'The substation')", "('q', 2, false, 'other')"))
def retrieved_fixture(spark, sf_dir):
    found = spark.createDataFrame([("q", 1, 2.0, "meeting", "2024", "The substation"), ("q", 2, 1.0, "filing", "2023", "other")], "question_id string, rank int, score double, source_type string, date string, text string")
    answered = rag.answers(spark.createDataFrame([("q", "Where?")], "question_id string, question string"), found, lambda d: d.withColumn("answer", F.lit("Here [1][7].")))
    return rag.retrieved_rows(found, answered).select("question_id", "rank", "cited", "snippet")


@query(values("question_id, prompt_context, n, best", "('q', '[1] meeting | 2024' || chr(10) || 'one' || chr(10) || chr(10) || '[2] filing' || chr(10) || 'two', 2, 2::DOUBLE)"))
def context_fixture(spark, sf_dir):
    return rag.context_blocks(spark.createDataFrame([("q", 2, 1.0, "filing", None, "two"), ("q", 1, 2.0, "meeting", "2024", "one")], "question_id string, rank int, score double, source_type string, date string, text string"))


@query(values("jurisdiction, docs, markers, per_1000, samples", "('Alpha', 4::BIGINT, 3::BIGINT, 750::DOUBLE, 'a0,a1')", "('Beta', 3, 1, 333.3, 'b0')"))
def dodge_fixture(spark, sf_dir):
    said = "we have no comment and will get back to you"
    rows = [(f"a{i}", said if i == 0 else "no comment" if i == 1 else "fine", "county_meeting", "Alpha", "l", i) for i in range(4)] + [(f"b{i}", "No Comment" if i == 0 else "fine", "county_meeting", "Beta", "l", 10 + i) for i in range(3)]
    rows += [("g", said, "county_meeting", "Gamma", "l", 20), ("f", said, "filing", "Alpha", "l", 21), ("n", said, "county_meeting", "", "l", 22)]
    found = analytics.dodge_index(spark.createDataFrame(rows, "id string, text string, source_type string, jurisdiction string, deep_link string, ord int"), 3)
    return found.select("jurisdiction", "docs", "markers", "per_1000", F.array_join(F.col("sample_receipts.doc_id"), ",").alias("samples"))


@query(values("shell, ticker", "('Project Falcon', 'T')"))
def links_fixture(spark, sf_dir):
    links = spark.createDataFrame([("Project Falcon", "T", "confirmed", ["d1"])], "shell string, ticker string, confidence string, receipts array<string>")
    return analytics.checked_links(links, spark.createDataFrame([("d1", "Project Falcon here")], "id string, text string")).select("shell", "ticker")


@query(values("symbol, quantity, market_value, currency, kind", "('AAA', 2::DOUBLE, 6::DOUBLE, 'USD', 'Stock')", "('BBB', 4, 9, 'CAD', NULL)", "('CCC', NULL, NULL, NULL, NULL)"))
def positions_fixture(spark, sf_dir):
    raw = [
        {"symbol": {"symbol": {"symbol": "AAA", "currency": {"code": "USD"}, "type": {"description": "Stock"}}}, "fractional_units": 2, "price": 3},
        {"symbol": {"symbol": "BBB", "currency": "CAD"}, "units": 4, "market_value": 9}, {"symbol": "CCC"}, {"symbol": {}}, {"units": 1},
    ]
    return analytics.normalised_positions(spark.createDataFrame([(json.dumps(r),) for r in raw], "json string"))


@query(values("ticker, cik", "('brk.b', '0001067983')", "('zz', NULL)"))
def cik_fixture(spark, sf_dir):
    mapping = spark.createDataFrame([("brk-b", 1067983, 1), ("BRK-B", 1, 2)], "ticker string, cik_str long, ord int")
    return joins.cik_for_ticker(spark.createDataFrame([("brk.b",), ("zz",)], "ticker string"), mapping).select("ticker", "cik")


@query(values("name, raw", "('xslF345X05/wk-form4_1.xml', 'wk-form4_1.xml')", "('a.xml', 'a.xml')"))
def raw_name_fixture(spark, sf_dir):
    return spark.createDataFrame([("xslF345X05/wk-form4_1.xml",), ("a.xml",)], "name string").select("name", joins.raw_document_name(F.col("name")).alias("raw"))


@query(values("place, slugs, evident", "('Wake County, NC', ['wake', 'wakecounty'], true)", "('San Antonio, TX', ['sanantonio'], false)"))
def slug_fixture(spark, sf_dir):
    rows = spark.createDataFrame([("Wake County, NC", "Welcome to Wake County, NC", "Wake County", "NC", "north carolina"), ("San Antonio, TX", "San Antonio site", "San Antonio", "TX", "texas")], "place string, page string, name string, state string, state_name string")
    return rows.select("place", joins.slugs(F.col("place")).alias("slugs"), joins.state_evidence(*(F.col(c) for c in ("page", "name", "state", "state_name"))).alias("evident"))


@query(values("county, state, n", "('Polk', 'IA', 1)"))
def county_fixture(spark, sf_dir):
    rows = joins.county_queries(spark.createDataFrame([("Polk, IA", "x"), ("Nowhere", "x"), ("A, Long", "x")], "place string, jurisdiction string"))
    return rows.select("county", "state", joins.require("state", "county").isNotNull().cast("int").alias("n"))


@query(values('"at", url', "(1, '/x/April_generator2024.xlsx')", "(2, '/x/march_generator2024.xlsx')", "(3, '/x/may_generator2023.xlsx')"))
def workbook_links_fixture(spark, sf_dir):
    page = '<a href="/x/march_generator2024.xlsx"> <a href="/x/April_generator2024.xlsx"> <a href="/x/may_generator2023.xlsx"> <a href="/x/may_generator2023.xlsx">'
    urls = [r.url for r in parsers.workbook_links(spark.createDataFrame([(page,)], "html string")).collect()]  # a page's few links, in their order
    return spark.createDataFrame(list(enumerate(urls, 1)), "at int, url string")


@query(values("page_id, text", "(1, 'Hello & welcome' || chr(10) || 'Second')"))
def html_fixture(spark, sf_dir):
    rows = spark.createDataFrame([(1, "<html><head><style>p{}</style><script>x()</script></head><body><p>Hello &amp; <b>welcome</b></p><div>Second</div></body></html>")], "page_id int, html string")
    return rows.select("page_id", parsers.html_text(F.col("html")).alias("text"))


@query(values("accession, form", "('b', '8-K')", "('a', '8-K')"))
def submissions_fixture(spark, sf_dir):
    subs = '{"cik":"5","filings":{"recent":{"accessionNumber":["a","b","c"],"filingDate":["2024-01-01","2024-03-01","2024-02-01"],"form":["8-K","8-K","4"],"primaryDocument":["x","y","z"]}}}'
    return parsers.recent_filings(spark.createDataFrame([(subs,)], "json string"), ["8-K", "10-K"], 5).select("accession", "form")


@query(values("query_id, rows", "('9', 12)"))
def permit_summary_fixture(spark, sf_dir):
    found = parsers.permit_summary(spark.createDataFrame([('{"Results":{"QueryID":"9","QueryRows":"12"}}',)], "json string"))
    return found.toDF("query_id", "rows").select("query_id", F.col("rows").cast("int").alias("rows"))


@query(values("iso, queue_id, county, mw, queue_date, withdrawn", "('ERCOT', 'I1', 'Polk', 120.5::DOUBLE, '2024-01-01', false)", "('CAISO', '7', 'Kern', 1000, '2024-01-02', true)"))
def workbook_queue_fixture(spark, sf_dir):
    files = spark.createDataFrame([(bytearray(fx.workbook(fx.SHEETS)),), (bytearray(b"junk"),)], "content binary")
    rows = parsers.ercot_queue(files).unionByName(parsers.caiso_queue(files), allowMissingColumns=True)
    return rows.select("iso", "queue_id", "county", "mw", "queue_date", "withdrawn")


@query(values("plant, mw, planned_online", "('P', 5::DOUBLE, '2026-03')", "('P2', 5, '')"))
def generator_fixture(spark, sf_dir):
    return parsers.generators(spark.createDataFrame([(bytearray(fx.workbook(fx.SHEETS)),)], "content binary"), "Planned").select("plant", "mw", "planned_online")


@query(values("kind, link", "('filing', 'https://www.sec.gov/Archives/edgar/data/')", "('transcript', 'https://financialmodelingprep.com/api/v3/')", "('caption', 'https://youtube.com/watch?v=v1&t=0s')", "('legistar', 'https://webapi.legistar.co')"))
def deep_link_fixture(spark, sf_dir):
    """How links of documents begin, by where they come from."""
    filing = parsers.filing_docs(spark.createDataFrame(fx.FILINGS[1:2], "ticker string, accession string, form string, filing_date string, html string"))
    call = parsers.transcript_docs(spark.createDataFrame(fx.CALLS[1:], "symbol string, quarter int, year int, date string, content string"))
    caption = parsers.caption_docs(spark.createDataFrame(fx.VIDEOS[:1], "video string, upload_date string, vtt string, jurisdiction string")).where("id = 'yt:v1:seg000'")
    matter = parsers.legistar_docs(spark.createDataFrame(fx.MATTERS, "client string, jurisdiction string, json string"), "matter")
    parts = [d.select(F.lit(kind).alias("kind"), F.substring("deep_link", 1, n).alias("link")) for d, kind, n in ((filing, "filing", 40), (call, "transcript", 41), (caption, "caption", 99), (matter, "legistar", 26))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(values("ticker", "('A')"))
def price_cache_fixture(spark, sf_dir):
    cache = spark.createDataFrame([("A", "2024-01-02 10:00:00"), ("B", "2024-01-01 00:00:00"), ("../C", "2024-01-02 10:00:00")], "ticker string, fetched_at string")
    return documents.fresh_prices(cache, "2024-01-02 12:00:00").select("ticker")


@query(values("kind, video_id", "('live', 'v1')", "('soon', 'v2')"))
def upcoming_fixture(spark, sf_dir):
    live, soon = analytics.upcoming(spark.createDataFrame([("j", "v1", "is_live"), ("j", "v2", "is_upcoming"), ("j", "v3", "was_live")], "jurisdiction string, video_id string, status string"))
    return live.select(F.lit("live").alias("kind"), "video_id").unionByName(soon.select(F.lit("soon").alias("kind"), "video_id"))


@query(values("sector, tickers", "('power', 'A:2,B:0')", "('water', 'C:0')"))
def sector_fixture(spark, sf_dir):
    registry = spark.createDataFrame([("A", "power"), ("B", "power"), ("C", "water")], "symbol string, sector string")
    docs = spark.createDataFrame([("A", "2024-01-01"), ("A", "2024-02-01"), (None, "2024-01-01")], "ticker string, date string")
    rows = analytics.by_sector(analytics.ticker_counts(registry, docs))
    return rows.select("sector", F.array_join(F.transform("tickers", lambda t: F.concat_ws(":", t["symbol"], t["docs"])), ",").alias("tickers"))
