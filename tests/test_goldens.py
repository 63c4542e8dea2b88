"""Hand-computed cases of the operators."""

import math
import re
import time
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesto.functions import extract, scoring, text
from attesto.operators import analytics, chunking, evaluation, fusion, index, joins, rag, search, vectors


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id string, text string" + extra)


@pytest.fixture(scope="module")
def ranked(spark):
    pad = lambda words: " ".join(words + ["filler"] * (10 - len(words)))
    s, t = "substation", "transformer"
    rows = [("a", pad([s])), ("m", pad([s])), ("z", pad([s])), ("b", pad([s] * 3)), ("c", pad([s, t])), ("d", pad([s, s, t, t])), ("e", pad([t])), ("f", pad([]))]
    return index.build(docs(spark, rows))


def test_bm25_order_and_ties(ranked):
    rows = [r.id for r in search.ranked_search(ranked, "substation transformer", 10).orderBy("rank").collect()]
    assert rows[:2] == ["d", "c"] and "f" not in rows
    assert [x for x in rows if x in "amz"] == ["a", "m", "z"]
    assert search.ranked_search(ranked, "", 5).count() == 0 and search.ranked_search(ranked, "nowhere", 5).count() == 0
    assert search.ranked_search(ranked, "substation", 0).count() == 0


def test_bm25_repeated_terms_count_twice(ranked):
    one, two = ({r.id: r.score for r in search.scores(ranked, q).collect()} for q in ("substation", "substation substation"))
    assert all(math.isclose(two[k], 2 * one[k]) for k in one)


def test_scan_and_index_agree(spark, ranked):
    for q in ("substation transformer", "filler", "substation substation filler"):
        a = {r.id: round(r.score, 9) for r in search.scores(ranked, q).collect()}
        b = {r.id: round(r.score, 9) for r in search.scan_scores(ranked.docs, q).collect()}
        assert a == b


def test_bm25_boundaries(spark):
    one = spark.range(1)
    value = lambda *x: one.select(scoring.bm25(*(F.lit(float(v)) for v in x)).alias("s")).first().s
    assert value(0, 1, 10, 5, 5) == 0 and value(2, 1, 10, 5, 0) == 0
    assert value(1, 10, 10, 5, 5) > 0
    assert one.select(scoring.bm25(F.lit(0), F.lit(1), F.lit(10), F.lit(5), F.lit(5.0), 0.0).alias("s")).first().s == 0
    assert math.isclose(value(3, 2, 10, 8, 5), math.log(1 + 8.5 / 2.5) * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 8 / 5)))


def test_boolean_and_phrase(spark):
    i = index.build(docs(spark, [("A", "Loudoun substation plan"), ("B", "the substation"), ("C", "loudoun county the the end")]))
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(search.boolean_search(i, "loudoun substation", "AND")) == ["A"] and ids(search.boolean_search(i, "loudoun substation", "OR")) == ["A", "B", "C"]
    assert ids(search.boolean_search(i, "loudoun missing", "AND")) == [] and ids(search.boolean_search(i, "", "AND")) == []
    assert ids(search.phrase_search(i, "loudoun substation plan")) == ["A"] and ids(search.phrase_search(i, "loudoun plan")) == []
    assert ids(search.phrase_search(i, "the the")) == ["C"] and ids(search.phrase_search(i, "substation")) == ["A", "B"]
    with pytest.raises(ValueError):
        search.boolean_search(i, "a", "XOR")


def test_index_lookup_delete_and_save(spark, tmp_path):
    i = index.build(docs(spark, [("1", "a b a"), ("2", "b"), ("3", "")]))
    assert i.df("a").first().df == 1 and i.df("zz").first().df == 0
    assert i.posting("a").first().positions == [0, 2]
    stats = i.corpus_stats.first()
    assert (stats.n, stats.average) == (3, 4 / 3)
    gone = i.delete(["1"])
    assert gone.df("a").first().df == 0 and gone.corpus_stats.first().n == 2
    for f in (lambda: i.delete(["9"]), lambda: i.doc("9")):
        with pytest.raises(KeyError):
            f()
    i.save(str(tmp_path / "i"))
    again = index.Index.load(spark, str(tmp_path / "i"))
    assert sorted(map(str, again.postings.collect())) == sorted(map(str, i.postings.collect()))
    with pytest.raises(ValueError):
        index.assert_unique(docs(spark, [("1", "x"), ("1", "y")]))


UNICODE = [("wide", "ＡＢＣ ﬁnance"), ("mark", "cafe\u0301 owner"), ("greek", "ΟΔΟΣ"), ("plain", "Café finance"), ("sharp", "Straße"), ("dots", "İstanbul")]


def test_texts_are_found_by_any_spelling_of_their_words(spark):
    i = index.build(docs(spark, UNICODE))
    for query, want in (("abc", {"wide"}), ("ＦＩＮＡＮＣＥ", {"wide", "plain"}), ("café", {"mark", "plain"}), ("CAFE\u0301", {"mark", "plain"}), ("οδος", {"greek"}), ("ΟΔΟΣ", {"greek"}), ("STRASSE", {"sharp"}), ("İstanbul", {"dots"})):
        for found in (search.boolean_search(i, query, "AND"), search.boolean_scan(i.docs, query, "AND"), search.scores(i, query), search.scan_scores(i.docs, query), search.phrase_search(i, query), search.phrase_scan(i.docs, query)):
            assert {r.id for r in found.collect()} == want, query
    lengths = {r.id: r.length for r in i.doc_stats.collect()}
    assert lengths == {d: len(text.analyze_text(t)) for d, t in UNICODE}


def test_native_tokens_equal_the_analyzer_on_plain_characters(spark):
    plain = [chr(c) for c in range(0x2100) if re.match(text.PLAIN, chr(c))]
    cases = [f"a{x}b {x}" for x in plain] + [x + y for x in plain[128:] for y in "aB1 "] + ["".join(plain)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").coalesce(1)
    plan = df.where(F.col("t").rlike(text.PLAIN)).select("i", text.tokens(F.col("t")).alias("a"), text.token_count(F.col("t")).alias("n"))
    for r in plan.collect():
        assert r.a == text.analyze_text(cases[r.i]) and r.n == len(r.a), cases[r.i]
    assert plan.count() == len(cases)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_tokens_equal_the_analyzer(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    assert all(r.a == text.analyze_text(texts[r.i]) for r in df.select("i", text.tokens(F.col("t")).alias("a")).collect())


def test_analyzer(spark):
    cases = ["ＦＵＬＬ ﬁne Straße _x_y 2½", "", "🙂 !!", "İstanbul"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.a for r in df.select(text.analyze(F.col("t")).alias("a")).collect()]
    assert got[0] == ["full", "fine", "strasse", "x", "y", "21", "2"] and got[1] == got[2] == []


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_analyzer_is_idempotent(t):
    once = text.analyze_text(t)
    assert text.analyze_text(" ".join(once)) == once


def test_metrics(spark):
    ranking = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abcd")] + [("n", "zz", 1)], "query_id string, doc_id string, rank int")
    grades = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("q", "x", 1), ("n", "y", 1)], "query_id string, doc_id string, grade int")
    row = {r.query_id: r for r in evaluation.metrics(ranking, grades, (2, 10)).collect()}
    assert (row["q"].precision_2, row["q"].recall_2, row["q"].mrr) == (0.5, 1 / 3, 1.0)
    assert math.isclose(row["q"].ndcg_2, 1 / (2 + 1 / math.log2(3)))
    assert (row["n"].mrr, row["n"].ndcg_2, row["n"].recall_2) == (0, 0, 0)
    assert evaluation.metrics(ranking.limit(0), grades, (2,)).where("query_id = 'q'").first().mrr == 0
    assert [evaluation.gate(x) for x in (0.6, 0.4, None)] == [0, 1, 2]


def test_ndcg_of_the_ideal_order(spark):
    grades = spark.createDataFrame([("q", "a", 1), ("q", "c", 2)], "query_id string, doc_id string, grade int")
    for order, want in (("ca", 1.0), ("ac", (1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3)))):
        r = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(order)], "query_id string, doc_id string, rank int")
        assert math.isclose(evaluation.metrics(r, grades, (2,)).first().ndcg_2, want)


def test_last_grade_and_history(spark):
    j = spark.createDataFrame([("q", "d", 2, 1), ("q", "d", 0, 2)], "query_id string, doc_id string, grade int, ord int")
    assert evaluation.last_grades(j).first().grade == 0
    h = spark.createDataFrame([("lexical", 0.5, 1), ("lexical", 0.4, 2), (None, 1.0, 3)], "mode string, ndcg double, ord int")
    assert [tuple(r) for r in evaluation.latest_by_mode(h).collect()] == [("lexical", 0.4)]


def test_judge_arithmetic(spark):
    labels = spark.createDataFrame([(f"l{i}", "supported") for i in range(4)] + [("example-1", "supported")], "label_id string, human_verdict string")
    said = spark.createDataFrame([(f"l{i}", "supported" if i else "unsupported") for i in range(4)], "label_id string, verdict string")
    assert tuple(evaluation.judge_agreement(labels, said).first()) == (4, 0.75, False)
    a = spark.createDataFrame([(True, False), (True, True), (False, True), (False, False)], "answerable boolean, refused boolean")
    assert tuple(evaluation.refusal_rates(a).first()) == (0.5, 0.5)
    qa = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["c"])], "qa_id string, answer_doc_ids array<string>")
    assert evaluation.answer_recall(spark.createDataFrame([("q1", "a")], "qa_id string, doc_id string"), qa).first()[0] == 0.25
    evaluation.require_other_family("claude-x", "gpt-4")
    for pair in (("gpt-4", "gpt-5"), ("gpt-4", "unheard")):
        with pytest.raises(ValueError):
            evaluation.require_other_family(*pair)


def test_rrf(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    got = {r.id: r.score for r in fusion.rrf_fuse([a, b]).collect()}
    assert math.isclose(got["x"], 1 / 61) and math.isclose(got["y"], 1 / 62 + 1 / 61)
    with pytest.raises(ValueError):
        fusion.rrf_fuse([a], 0)
    bad = spark.createDataFrame([("c", ["a", "b"])], "chunk_id string, doc_ids array<string>")
    with pytest.raises(ValueError):
        fusion.require_identity_chunks(bad)


def test_chunk_windows(spark):
    rows = [(f"yt:v:seg{i:03d}", f"t{i}") for i in range(5)] + [("yt:w:seg000", "a"), ("yt:w:seg001", "b"), ("other", "o")]
    got = {r.chunk_id: r.doc_ids for r in chunking.chunk_corpus(docs(spark, rows), 3, 1).collect()}
    assert got == {"yt:v:seg000+w3": [f"yt:v:seg00{i}" for i in (0, 1, 2)], "yt:v:seg002+w3": [f"yt:v:seg00{i}" for i in (2, 3, 4)], "yt:w:seg000+w3": ["yt:w:seg000", "yt:w:seg001"], "other": ["other"]}
    for w, o in ((0, 0), (2, 2), (2, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_corpus(docs(spark, rows), w, o)


def test_dodge_index(spark):
    said = "we have no comment and will get back to you"
    rows = [(f"a{i}", said if i == 0 else "no comment" if i == 1 else "fine", "county_meeting", "Alpha", "l", i) for i in range(4)]
    rows += [(f"b{i}", "No Comment" if i == 0 else "fine", "county_meeting", "Beta", "l", 10 + i) for i in range(3)]
    rows += [("g", said, "county_meeting", "Gamma", "l", 20), ("f", said, "filing", "Alpha", "l", 21), ("n", said, "county_meeting", "", "l", 22)]
    df = spark.createDataFrame(rows, "id string, text string, source_type string, jurisdiction string, deep_link string, ord int")
    got = [(r.jurisdiction, r.docs, r.markers, r.per_1000, [s.doc_id for s in r.sample_receipts]) for r in analytics.dodge_index(df, 3).collect()]
    assert got == [("Alpha", 4, 3, 750.0, ["a0", "a1"]), ("Beta", 3, 1, 333.3, ["b0"])]


def test_net_flow(spark):
    rows = [("X", "2024-02-01", "S", 100.0, 10.0, "u"), ("X", "2024-03-01", "S", 55.0, 5.0, "v"), ("X", "2024-03-02", "P", 24.0, 2.0, "u"), ("X", "2024-03-03", "A", 9.0, 1.0, "u"), ("X", "2023-01-01", "S", 9.0, 1.0, "u"), ("Y", "2024-03-01", "S", 9.0, 1.0, "u"), ("X", "", "S", 9.0, 1.0, "u")]
    df = spark.createDataFrame(rows, "ticker string, transaction_date string, code string, value double, shares double, filer_name string")
    r = analytics.net_flow(df, "2024-01-01").where("ticker = 'X'").first()
    assert (r.transactions, r.buys_value, r.sells_value, r.net_value, r.insiders_selling, r.insiders_buying, r.last_transaction_date) == (3, 24.0, 155.0, -131.0, 2, 1, "2024-03-02")


def test_mentions_moves_and_receipts(spark):
    prices = spark.createDataFrame([("V", "2024-01-05", 100.0), ("V", "2024-01-08", 110.0), ("V", "2024-01-09", 90.0), ("V", "2024-01-10", 120.0), ("N", "2024-01-05", 50.0), ("N", "2024-01-10", 40.0)], "ticker string, date string, close double")
    rows = [("d1", "x", "V", "2024-01-07"), ("d2", "x", "N", "2024-01-06"), ("d3", "x", "V", "2024-01-01"), ("d4", "x", None, "2024-01-07")]
    d = spark.createDataFrame(rows, "id string, text string, ticker string, date string")
    got = {r.doc_id: (r.entry_close, r.return_pct, r.peak_pct, r.co_mentions) for r in analytics.mention_returns(d, prices, "2023-01-01").collect()}
    assert got == {"d1": (100.0, 20.0, 20.0, 0), "d2": (50.0, -20.0, -20.0, 0)}
    moves = analytics.significant_moves(prices.where("ticker = 'V'"), 15)
    assert [(r.date, round(r.return_pct, 3)) for r in moves.orderBy("date").collect()] == [("2024-01-09", -18.182), ("2024-01-10", 33.333)]
    full = d.withColumns({c: F.lit("") for c in ("source_type", "venue_type", "deep_link")})
    near = {r.date: [x.doc_id for x in r.receipts] for r in analytics.nearby_receipts(moves, full, 2).collect()}
    assert near == {"2024-01-09": ["d1"], "2024-01-10": []}
    assert [r.date for r in analytics.trailing(prices.where("ticker = 'V'"), 2).orderBy("date").collect()] == ["2024-01-09", "2024-01-10"]


def test_asof_join_takes_the_last_at_or_before(spark):
    a = spark.createDataFrame([("k", 5), ("k", 1), ("j", 5)], "k string, t int")
    b = spark.createDataFrame([("k", 5, "five"), ("k", 3, "three"), ("j", 6, "six")], "k string, u int, v string")
    assert {(r.k, r.t): r.asof_v for r in joins.asof_backward(a, b, "k", "t", "u", "v").collect()} == {("k", 5): "five", ("k", 1): None, ("j", 5): None}


def test_asof_join_over_many_buckets(spark):
    rng = __import__("random").Random(5)
    left = [(rng.choice(["k", "j", None]), rng.randrange(10**6) if i else None, i) for i in range(300)]
    right = [(rng.choice(["k", "j"]), t, f"v{t}") for t in rng.sample(range(10**6), 200)] + [(None, 5, "null key")]
    a, b = spark.createDataFrame(left, "k string, t int, n int"), spark.createDataFrame(right, "k string, u int, v string")
    got = {r.n: r.asof_v for r in joins.asof_backward(a, b, "k", "t", "u", "v").collect()}
    want = {n: max(((u, v) for j, u, v in right if k is not None and t is not None and j == k and u <= t), default=(0, None))[1] for k, t, n in left}
    assert got == want


def test_mentions_over_many_months(spark):
    rng = __import__("random").Random(6)
    days = [f"20{20 + y}-{m:02d}-{d:02d}" for y in range(2) for m in range(1, 13) for d in (1, 11, 21)]
    prices = [(t, d, float(rng.randrange(1, 99))) for t in "AB" for d in rng.sample(days, 40)]
    hits = [(f"d{i}", "x", rng.choice("ABC"), rng.choice(days)[:8] + f"{rng.randrange(1, 29):02d}") for i in range(80)]
    d, p = spark.createDataFrame(hits, "id string, text string, ticker string, date string"), spark.createDataFrame(prices, "ticker string, date string, close double")
    got = {r.doc_id: (r.entry_close, r.latest_close, r.peak_pct) for r in analytics.mention_returns(d, p, "2020-01-01").collect()}
    want = {}
    for i, _, t, day in hits:
        own = sorted((x, c) for s, x, c in prices if s == t)
        before, after = [c for x, c in own if x <= day], [c for x, c in own if x >= day]
        if before:
            want[i] = (before[-1], own[-1][1], round((max(after, default=own[-1][1]) / before[-1] - 1) * 100 + 1e-9, 2))
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(abs(got[k][2] - want[k][2]) < 0.011 for k in want)
    moves = {(r.ticker, r.date) for r in analytics.significant_moves(p, 50).collect()}
    assert moves == {(t, y[0]) for t in "AB" for x, y in pairwise(sorted((d, c) for s, d, c in prices if s == t)) if abs(y[1] / x[1] - 1) >= 0.5}


def test_queue_join_is_exact(spark):
    rows = spark.createDataFrame([("Polk", "IA", 1.0), ("polk", "IA", 2.0), ("Polk County", "IA", 3.0), (None, "IA", 4.0)], "county string, state string, mw double")
    hits, misses = joins.join_jurisdictions(rows, spark.createDataFrame([("Polk, IA", "Polk County, IA")], "place string, jurisdiction string"))
    assert [(r.mw, r.jurisdiction) for r in hits.collect()] == [(1.0, "Polk County, IA")] and sorted(r.mw for r in misses.collect()) == [2.0, 3.0, 4.0]


@pytest.mark.parametrize("quote", ["voted 5 to 2", "Ordinance 2024-15", "at 7:30 pm", "123 Main Street", "agenda item 12", "in 2025", "Section 4.2", "served 12 years"])
def test_quantities_leave_other_numbers(quote):
    assert extract.quantities_of(quote) == []


def test_guards(spark):
    e = spark.createDataFrame([("x", "Item 1.99 odd", "filing", "T", "d", "l")], "id string, text string, source_type string, ticker string, date string, deep_link string")
    with pytest.raises(Exception, match="1.99"):
        analytics.build_events(e).collect()
    d = docs(spark, [("d1", "Project Falcon here")])
    link = lambda *r: spark.createDataFrame([r], "shell string, ticker string, confidence string, receipts array<string>")
    assert analytics.checked_links(link("Project Falcon", "T", "confirmed", ["d1"]), d).count() == 1
    for bad in (("Project Falcon", "T", "maybe", ["d1"]), ("Project Falcon", "T", "confirmed", ["zz"]), ("Other", "T", "confirmed", ["d1"]), ("Project Falcon", "T", "confirmed", []), ("", "T", "confirmed", ["d1"])):
        with pytest.raises(ValueError):
            analytics.checked_links(link(*bad), d)
    with pytest.raises(ValueError):
        analytics.quantity_rollup(e, "ticker2")


def test_vectors(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0]), ("d", [0.0, 0.0])], "chunk_id string, vec array<double>")
    got = [(r.chunk_id, round(r.score, 6)) for r in vectors.cosine_top_k(store, [1.0, 0.0], 9, order="chunk_id").orderBy("rank").collect()]
    assert got == [("a", 1.0), ("c", 0.707107), ("b", 0.0), ("d", 0.0)]
    assert vectors.cosine_top_k(store, [1.0, 0.0], -1, order="chunk_id").count() == 0
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([([float("nan")],)], "v array<double>").select(scoring.normalised(F.col("v"))).collect()


def test_embedding_lifecycle(spark):
    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    pairs = spark.createDataFrame([("c1", "same"), ("c2", "same"), ("c3", "x" * 30000)], "chunk_id string, text string")
    store = vectors.embed_corpus(pairs, provider, "m", 2).cache()
    rows = {r.chunk_id: r for r in store.collect()}
    assert calls.value == 2 and rows["c1"].vec == rows["c2"].vec and rows["c3"].truncated
    assert vectors.embed_corpus(pairs, provider, "m", 2, store).count() == 0
    vectors.check_store(store, "m", 2)
    for model, dim in (("other", 2), ("m", 3)):
        with pytest.raises(ValueError):
            vectors.check_store(store, model, dim)
    hits = vectors.semantic_search(store, pairs, [4.0, 1.0], 2).collect()
    assert {h.chunk_id for h in hits} == {"c1", "c2"}
    with pytest.raises(ValueError, match="1 chunks"):
        vectors.semantic_search(store, pairs.union(spark.createDataFrame([("c9", "y")], "a string, b string")), [1.0, 1.0], 1)
    stale = pairs.withColumn("text", F.concat("text", F.lit("!")))
    with pytest.raises(Exception, match="stale"):
        vectors.semantic_search(store, stale, [4.0, 1.0], 1).collect()


def test_filters_and_tail(spark, ranked):
    d = ranked.docs.withColumns({"date": F.when(F.col("id") == "a", None).otherwise(F.concat(F.lit("2024-01-0"), F.length("id").cast("string"))), "source_type": F.lit("s")})
    assert search.filtered(d, date_to="2025").where("id = 'a'").count() == 0 and search.filtered(d, date_from="2000").where("id = 'a'").count() == 0
    assert search.filtered(d, source_type="s").count() == 8 and search.filtered(d, source_type="t").count() == 0


@pytest.mark.parametrize("k,depth", [(1, None), (7, None), (25, None), (60, None), (5, 10)])
def test_hybrid_equals_ranks_of_all_hits(spark, k, depth):
    rng = __import__("random").Random(k)
    arms = [{f"d{i:04d}": rng.randrange(12) / 4 for i in rng.sample(range(900), n)} for n in (700, 400)]
    frames = [spark.createDataFrame(list(a.items()), "id string, score double") for a in arms]
    got = [(r.id, r.score, r["rank"]) for r in fusion.hybrid(*frames, k, depth, 9).orderBy("rank").collect()]
    total: dict = {}
    for a in arms:
        for n, d in enumerate(sorted(a, key=lambda x: (-a[x], x))[: None if depth is None else max(k, depth)]):
            total[d] = total.get(d, 0) + 1 / (61 + n)
    want = sorted(total, key=lambda d: (-round(total[d], 9), d))[:k]
    assert got == [(d, round(total[d], 9), n + 1) for n, d in enumerate(want)]


def test_search_in_every_mode(spark):
    rows = [(f"d{i}", "permit" if i % 2 else "river permit permit", "s", "v", f"2024-01-{1 + i:02d}", "l", None, "A" if i < 6 else "B") for i in range(12)]
    i = index.build(spark.createDataFrame(rows, "id string, text string, source_type string, venue_type string, date string, deep_link string, ticker string, jurisdiction string"))
    store = spark.createDataFrame([(f"d{n}", [1.0, n / 10]) for n in range(12)] + [("gone", [1.0, 0.0])], "chunk_id string, vec array<double>")
    chunks = spark.createDataFrame([(f"d{n}", [f"d{n}"]) for n in range(12)], "chunk_id string, doc_ids array<string>")
    side = {"store": store, "chunks": chunks, "vector": [1.0, 0.0]}
    ids = lambda **more: [r.id for r in search.find(i, "river permit", **more).collect()]
    assert ids(mode="semantic", k=3, **side) == ["d0", "d1", "d2"]
    assert ids(mode="semantic", k=3, jurisdiction="B", **side) == ["d6", "d7", "d8"]  # far down in the whole ranking
    assert ids(mode="semantic", k=2, date_from="2024-01-11", **side) == ["d10", "d11"]  # dates too come before the cut
    assert ids(mode="semantic", k=2, sort="date_desc", **side) == ["d11", "d10"]
    whole = ids(mode="hybrid", k=12, **side)
    assert ids(mode="hybrid", k=4, **side) == whole[:4] and ids(mode="hybrid", k=2, jurisdiction="B", **side) == [x for x in whole if int(x[1:]) >= 6][:2]
    assert ids(k=2) == ["d0", "d10"] and ids(k=1, op="AND", date_to="2024-01-01") == ["d0"]
    for bad in ({"mode": "other"}, {"mode": "semantic"}, {"op": "XOR"}, {"sort": "name"}, {"k": 0}):
        with pytest.raises(ValueError):
            search.find(i, "x", **bad)


def test_evaluation_run(spark):
    judged = spark.createDataFrame([("q1", "q", "c", "a", 2, 0), ("q1", "q", "c", "b", 1, 1), ("q2", "r", "c", "z", 1, 2)], "query_id string, query string, criterion string, doc_id string, grade int, ord int")
    ranking = spark.createDataFrame([("q1", "a", 1), ("q1", "x", 2), ("q1", "b", 3)], "query_id string, doc_id string, rank int")
    rows, mean, code = evaluation.evaluation_run(ranking, judged)
    assert rows.columns[1:] == ["P@5", "P@10", "R@10", "R@50", "MRR", "NDCG@10"]
    assert {r.query_id: (r["P@5"], r["P@10"], r["R@10"], r.MRR) for r in rows.collect()} == {"q1": (0.4, 0.2, 1.0, 1.0), "q2": (0, 0, 0, 0)}
    assert code == 1 and mean.first()["P@5"] == 0.2
    assert evaluation.evaluation_run(ranking, judged.limit(0))[2] == 2
    row = evaluation.history_row(rows, mean, "v1", timestamp="t").first()
    assert row.metrics.per_query["q1"]["MRR"] == 1.0 and row.metrics.mean["P@5"] == 0.2 and row.corpus_version == "v1"


def test_judging_answers(spark):
    answers = spark.createDataFrame([("a1", "q?", "Yes [1]. No.", ["one", "two"]), ("a2", "q?", "", ["one"])], "answer_id string, question string, answer_text string, chunk_texts array<string>")

    def judge(prompt):
        if "No." in prompt.split("CLAIM")[1]:
            raise RuntimeError("no reply")
        return 'I say {"verdict": " Supported ", "evidence_chunk": 2}'

    said = evaluation.judge_answers(answers, judge)
    assert sorted((r.at, r.claim, r.verdict, r.evidence_chunk) for r in said.collect()) == [(0, "Yes [1].", "supported", 2), (1, "No.", "error", None)]
    each = evaluation.faithfulness(said, answers)
    assert {r.answer_id: (r.supported, r.total, r.errors, r.faithfulness) for r in each.collect()} == {"a1": (1, 2, 1, 0.5), "a2": (0, 0, 0, 0.0)}
    assert evaluation.macro_faithfulness(each).first()[0] == 0.25
    failed = spark.createDataFrame([("a", "error")], "answer_id string, verdict string")
    assert evaluation.macro_faithfulness(evaluation.faithfulness(failed)).first()[0] is None
    assert evaluation.macro_faithfulness(evaluation.faithfulness(failed.limit(0))).first()[0] == 0.0


@pytest.mark.parametrize(
    "said,want",
    [('{oops} {"verdict":"supported"}', ("unparseable", None)), ('x [{"verdict":"SUPPORTED","evidence_chunk":1}]', ("supported", 1)), ('{"verdict":"contradicted","evidence_chunk":true}', ("contradicted", None)), ('{"a":"}{","verdict":"unsupported"} {"verdict":"supported"}', ("unsupported", None)), ('{"verdict":"supported"', ("unparseable", None)), ('{"a":"\\', ("unparseable", None)), (None, ("unparseable", None)), ('{"verdict":3}', ("unparseable", None)), ("[1]", ("unparseable", None))],
)
def test_verdicts(said, want):
    assert extract.verdict_of(said) == want


@pytest.mark.parametrize(
    "quote,want",
    [
        ("$1.5 billion and 300MW", [("money", 1.5e9, "$1.5 billion"), ("power", 300.0, "300MW")]), ("12 million dollars a year", [("money", 12e6, "12 million dollars")]), ("$ 2,500 now", [("money", 2500.0, "$ 2,500")]),
        ("5 million gallons per day", [("water", 5e6, "5 million gallons per day")]), ("2,000 gallons a month", [("water", 2000.0, "2,000 gallons")]), ("3 gallons a daytime", []), ("$5M", []), ("$1.5B", [("money", 1.0, "$1")]), ("$12,345,678B", [("money", 12345.0, "$12,345")]),
        ("1,23 MW", [("power", 23.0, "23 MW")]), ("1.5.2 MW", [("power", 5.2, "5.2 MW")]), ("a50 MW", []), ("50-MW", []), ("50 MWh", []), ("1.2 GW-scale", [("power", 1200.0, "1.2 GW")]), ("20 one MW jobs", [("power", 1.0, "one MW")]),
        ("fifty permanent full-time jobs", [("jobs", 50.0, "fifty permanent full-time jobs")]), ("two hundred jobs", [("jobs", 2.0, "two hundred jobs")]), ("10 new good solid jobs", []), ("3 million new good positions", [("jobs", 3e6, "3 million new good positions")]),
        ("ten kW of 10 kW", [("power", 0.01, "ten kW"), ("power", 0.01, "10 kW")]), ("twenty-five MW", [("power", 5.0, "five MW")]), ("", []),
    ],
)
def test_quantities(quote, want):
    assert [(q["kind"], q["value"], q["raw_span"]) for q in extract.quantities_of(quote)] == want


def test_cadence_of_money():
    near, far = "$5 " + "x " * 20 + "annually", "$5 " + "x " * 60 + "per year"
    assert [extract.quantities_of(t)[0]["cadence"] for t in (near, far, "a  year of $5", "$5 biannual")] == ["annual", "total", "annual", "total"]


@pytest.mark.parametrize(
    "answer,want",
    [("It cost 3.5 million. Yes?[1] [2]\n[3] No", ["It cost 3.5 million.", "Yes?[1] [2]\n[3]", "No"]), ("Acme Inc. and U.S. law. XInc. ends", ["Acme Inc. and U.S. law.", "XInc.", "ends"]), ("费用。获批准！[1]是", ["费用。", "获批准！[1]", "是"]), ("What?! [x]. Done", ["What?!", "[x].", "Done"]), ("", []), (None, [])],
)
def test_claims(answer, want):
    assert extract.claims_of(answer) == want


def test_question_terms(spark):
    q = "What did Chesterfield's Plant say about the Plant and O'Neil-Smith water WATER?"
    got = spark.createDataFrame([(q,), ("what is it",), (None,)], "q string").select(text.question_terms(F.col("q")).alias("t")).collect()
    assert [r.t for r in got] == [["Chesterfield's", "O'Neil-Smith", "Plant"], [], []]


def test_grounding_and_refusals(spark):
    questions = spark.createDataFrame([("q1", "What of Mesa County?"), ("q2", "x"), ("q3", "Which permit?"), ("q4", "Low one?")], "question_id string, question string")
    found = spark.createDataFrame([("q1", 1, 2.0, "a", "2024", "t1"), ("q1", 2, 1.0, "b", "2024", "t2"), ("q3", 1, 0.9, "a", "2024", "t"), ("q4", 1, 0.1, "a", "2024", "t")], "question_id string, rank int, score double, source_type string, date string, text string")
    say = lambda d: d.withColumn("answer", F.when(F.col("question_id") == "q1", "Yes [2]. No [9]. So [1].").otherwise("I find INSUFFICIENT_CONTEXT here"))
    got = {r.question_id: r for r in rag.answers(questions, found, say, 0.5).collect()}
    assert (got["q1"].answer, got["q1"].cited, tuple(got["q1"].grounding), got["q1"].suggestions) == ("Yes [2]. No . So [1].", [2, 1], ("partial", 2, 3), None)
    assert [got[q].reason for q in ("q2", "q3", "q4")] == [rag.NO_RECORDS, rag.NOT_COVERED, rag.LOW_SCORE]
    assert all(got[q].refused and got[q].cited == [] and tuple(got[q].grounding) == ("ungrounded", 0, 0) for q in ("q2", "q3", "q4"))
    assert "permit" in got["q3"].suggestions[0] and len(got["q2"].suggestions) == 2


def test_chunk_sweep_scores_each_cell_by_itself(spark):
    rows = [(f"yt:v:seg{i:03d}", f"w{i} common") for i in range(6)] + [("other", "w1 w1")]
    queries = spark.createDataFrame([("q", "w1 w4"), ("none", "zz")], "query_id string, query string")
    grades = spark.createDataFrame([("q", "yt:v:seg001", 1), ("q", "yt:v:seg005", 2), ("none", "other", 1)], "query_id string, doc_id string, grade int")
    got = {(r.window, r.overlap): r.recall_10 for r in evaluation.chunk_sweep(docs(spark, rows), queries, grades, (1, 2), (0, 1)).collect()}
    assert got == {(1, 0): 0.25, (2, 0): 0.5, (2, 1): 0.5}


def test_later_documents(spark):
    rng = __import__("random").Random(2)
    rows = [(f"d{i:03d}", "x", rng.choice("AB"), f"2024-01-{rng.randrange(1, 9):02d}") for i in range(60)] + [("n", "x", None, "2024-01-01"), ("m", "x", "A", None)]
    d = docs(spark, rows, ", jurisdiction string, date string")
    p = spark.createDataFrame([(f"p{i}", j, day) for i, (j, day) in enumerate([("A", "2024-01-03"), ("A", "2023-01-01"), ("B", "2024-01-08"), ("B", "2024-01-01"), ("C", "2024-01-01"), ("A", None), ("A", "2024-01-03")])], "promise_id string, jurisdiction string, date string")
    got = sorted((r.promise_id, r.place, r.doc_id) for r in analytics.later_documents(p, d, 5).collect())
    want = []
    for r in p.collect():
        later = sorted((x[3], x[0]) for x in rows if r.date and x[2] == r.jurisdiction and x[3] and x[3] > r.date)[:5]
        want += [(r.promise_id, n + 1, i) for n, (_, i) in enumerate(later)]
    assert got == sorted(want)


def test_peaks_take_linear_time(spark):
    took = []
    for n in (2000, 10_000, 40_000):
        prices = spark.range(n).select(F.lit("T").alias("ticker"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("date"), (1 + F.col("id") % 97).cast("double").alias("close"))
        d = prices.select(F.concat(F.lit("d"), "date").alias("id"), F.lit("").alias("text"), "ticker", "date")
        began = time.time()
        rows = analytics.mention_returns(d, prices, "1900-01-01").agg(F.count("*"), F.max("peak_pct")).first()
        took.append(time.time() - began)
        assert rows[0] == n and rows[1] == 9600.0
    assert took[2] < 8 * took[1]


def test_embedding_goes_on_where_it_stopped(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(f"c{i}", f"text {i % 20}" * (1 + i % 20)) for i in range(60)]
    pairs = spark.createDataFrame(rows, "chunk_id string, text string")
    path = str(tmp_path / "store")
    vectors.embed_in_steps(pairs.where("chunk_id < 'c3'"), provider, "m", 2, path, every=10)
    before = calls.value
    store = vectors.embed_in_steps(pairs, provider, "m", 2, path, every=10)
    assert store.count() == 60 and calls.value <= 20 and store.select("chunk_id").distinct().count() == 60
    assert vectors.embed_in_steps(pairs, provider, "m", 2, path, every=10).count() == 60 and calls.value >= before
    vectors.check_store(store, "m", 2)
    with pytest.raises(ValueError, match="finite"):
        vectors.check_store(spark.createDataFrame([("a", [float("inf"), 0.0], "m", 2)], "chunk_id string, vec array<float>, model string, dim int"), "m", 2)


def test_outcomes_deal_only_words_that_a_promise_asks_for(spark):
    d = [(f"d{i}", "We build the amber harbor bridge now" if i % 3 == 0 else f"other words {i} of no weight", "J", f"2024-01-{1 + i % 28:02d}", "") for i in range(40)]
    promises = spark.createDataFrame([("p1", "J", "2023-12-31", "We will build the amber harbor bridge"), ("p2", "J", "2023-12-31", "nobody says anything alike here")], "promise_id string, jurisdiction string, date string, quote string")
    rows = analytics.outcomes(promises, docs(spark, d, ", jurisdiction string, date string, deep_link string"))
    got = {r.promise_id: (r.status, [t.doc_id for t in r.trail]) for r in rows.collect()}
    assert got == {"p1": ("followed_up", ["d0", "d30", "d3", "d33", "d6"]), "p2": ("too_recent", [])}
    assert "explode(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # the words of all documents met their keys before


def test_embedding_steps_are_one_job(spark, tmp_path):
    """However many steps; a finished step is in the store although a later one fails."""
    context, path = spark.sparkContext, str(tmp_path / "store")
    pairs = spark.createDataFrame([(f"c{i}", None if i == 7 else f"text {i % 90}") for i in range(120)], "chunk_id string, text string")

    def slow(texts):
        if "text 3" in texts:
            time.sleep(4)
            raise RuntimeError("stopped")
        return [[float(len(t)) + 1, 2.0] for t in texts]

    with pytest.raises(Exception, match="stopped"):
        vectors.embed_in_steps(pairs, slow, "m", 2, path, every=4)
    assert 0 < spark.read.parquet(path).count() < 120
    context.setJobGroup("steps", "steps")
    store = vectors.embed_in_steps(pairs, lambda texts: [[float(len(t)) + 1, 2.0] for t in texts], "m", 2, path, every=4)
    jobs = len(context.statusTracker().getJobIdsForGroup("steps"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert store.count() == store.select("chunk_id").distinct().count() == 120 and jobs < 20
    with pytest.raises(ValueError, match="repeated chunk id"):
        vectors.embed_in_steps(pairs.unionByName(pairs), slow, "m", 2, path, every=4)


def test_semantic_ties_go_by_id_as_rounded(spark):
    """Scores that are equal as rounded, in the other order of their ids."""
    pairs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "chunk_id string, text string")
    store = spark.createDataFrame([("a", [1.0, 0.0003], "x"), ("b", [1.0, 0.0002], "y"), ("c", [1.0, 0.0001], "z")], "chunk_id string, vec array<double>, text string")
    store = store.select("chunk_id", "vec", F.lit("m").alias("model"), F.lit(2).alias("dim"), text.content_hash(F.lit("m"), F.lit(2), F.col("text")).alias("content_hash"))
    found = lambda *digits: [r.chunk_id for r in vectors.semantic_search(store, pairs, [1.0, 0.0], 2, *digits).orderBy("rank").collect()]
    assert found(6) == ["a", "b"] and found() == ["c", "b"]


def test_providers():
    calls = []

    @vectors.register_provider("letters")
    def letters(scale=1.0):
        def call(texts):
            calls.append(len(texts))
            if len(calls) == 2:
                raise OSError("down")
            return [[scale * len(t)] for t in texts][: -1 if len(calls) == 3 else None]

        return call

    run = vectors.limited(vectors.provider("letters", scale=2.0), texts=2, chars=10, wait=0.0)
    assert run(["a", "bb", "ccc", "d" * 9, "e"]) == [[2.0], [4.0], [6.0], [18.0], [2.0]] and calls == [2, 1, 1, 1, 2]
    with pytest.raises(ValueError, match="unknown provider"):
        vectors.provider("none")
    with pytest.raises(OSError):
        vectors.limited(lambda t: (_ for _ in ()).throw(OSError("down")), retries=1, wait=0.0)(["x"])


def test_snippets_of_results(spark):
    rows = [("a", "x " * 200 + "the Substation here" + " y" * 200), ("b", "substation first")]
    i = index.build(spark.createDataFrame([(*r, "s", "v", "2024", "l", None, None) for r in rows], "id string, text string, source_type string, venue_type string, date string, deep_link string, ticker string, jurisdiction string"))
    got = {r.id: r.snippet for r in search.search(i, "substation").collect()}
    assert got["b"] == "substation first" and "the Substation here" in got["a"] and len(got["a"]) == 170


def test_half_precision(spark):
    import numpy as np

    x = [0.0, 1.0, -0.1, 3.14159, 1e-7, 6e-8, 65504.0, 1 / 3, -2.5e-5]
    got = spark.createDataFrame([(x,)], "v array<float>").select(vectors.half(F.col("v")).alias("h")).first().h
    assert got == [float(v) for v in np.array(x, np.float32).astype(np.float16)]


def test_slugs_and_places(spark):
    one = spark.createDataFrame([("Wake County, NC",), ("San Antonio, TX",)], "j string").select(joins.slugs(F.col("j")).alias("s"))
    assert [r.s for r in one.collect()] == [["wake", "wakecounty"], ["sanantonio"]]
    pages = spark.createDataFrame([("Welcome to Wake County, NC", "Wake County", "NC", "north carolina"), ("Wake County site", "Wake County", "NC", "north carolina"), ("Wake County of North Carolina", "Wake County", "NC", "north carolina")], "p string, n string, s string, sn string")
    assert [r[0] for r in pages.select(joins.state_evidence(*(F.col(c) for c in ("p", "n", "s", "sn")))).collect()] == [True, False, True]
    q = joins.county_queries(spark.createDataFrame([("Polk, IA", "x"), ("Nowhere", "x"), ("A, Long", "x")], "place string, jurisdiction string"))
    assert [tuple(r) for r in q.collect()] == [("Polk", "IA")]
    m = spark.createDataFrame([("brk-b", 1067983, 1), ("BRK-B", 1, 2)], "ticker string, cik_str long, ord int")
    assert joins.cik_for_ticker(spark.createDataFrame([("brk.b",), ("zz",)], "ticker string"), m).orderBy("ticker").first().cik == "0001067983"


def test_context_and_grounding(spark):
    found = spark.createDataFrame([("q", 1, 2.0, "meeting", "2024", "The Substation was built"), ("q", 2, 1.0, "filing", "2023", "other")], "question_id string, rank int, score double, source_type string, date string, text string")
    block = rag.context_blocks(found).first()
    assert block.prompt_context.startswith("[1] meeting | 2024\nThe Substation") and block.n == 2
    a = rag.answers(spark.createDataFrame([("q", "Where is the substation?")], "question_id string, question string"), found, lambda d: d.withColumn("answer", F.lit("Here [1][7]")))
    assert a.first().grounding.status == "grounded" and a.first().answer == "Here [1]"
    assert [r.cited for r in rag.retrieved_rows(found, a).orderBy("rank").collect()] == [True, False]


def test_global_rank(spark):
    from attesto.operators.ranking import global_rank

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.col("id").alias("id"))
    got = {(r.x, r["rank"]) for r in global_rank(df, [F.desc("x"), F.col("id")]).collect()}
    assert got == {(x, 1000 - x) for x in range(1000)}
    assert global_rank(df.limit(0), [F.col("x")]).count() == 0


def test_filtered_hybrid_is_the_ranking_of_all(spark, monkeypatch):
    """Bounds from histograms leave the same rows, in the same order, as ranks of all hits do; ties and missing dates included."""
    import random

    r = random.Random(11)
    for n, bins in ((0, 8), (1, 8), (300, 6), (300, 500)):
        monkeypatch.setattr(fusion, "BINS", bins)
        lexical = [(f"d{i}", float(r.choice([0.5, 1.0, r.random() * 3]))) for i in range(n) if r.random() < 0.6]
        semantic = [(f"d{i}", round(r.uniform(-1, 1), 1)) for i in range(n) if r.random() < 0.8]
        kept = [(f"d{i}", r.choice([None, "2024-01-01", "2024-01-02", "2024-03-01"])) for i in range(n + 5) if r.random() < 0.3]
        ranks = [{x: p for p, (x, _) in enumerate(sorted(arm, key=lambda h: (-h[1], h[0])), 1)} for arm in (lexical, semantic)]
        dates = dict(kept)
        score = {x: sum(1.0 / (60 + rank[x]) for rank in ranks if x in rank) for x in dates if any(x in rank for rank in ranks)}
        frames = [spark.createDataFrame(x, s) for x, s in ((lexical, "id string, score double"), (semantic, "id string, score double"), (kept, "id string, date string"))]
        for k, by_date in ((5, False), (5, True), (1000, True)):
            order = sorted(score, key=lambda x: x)
            order.sort(key=lambda x: -score[x])
            if by_date:
                order.sort(key=lambda x: dates[x] or "", reverse=True)
            found = fusion.filtered_hybrid(*frames, k, by_date)
            assert [(x.id, round(x.score, 12)) for x in found.collect()] == [(x, round(score[x], 12)) for x in order[:k]]
            assert "rangepartitioning(score" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_ledger_pays_once(spark, tmp_path):
    """A run that stops half-way goes on with what is missing; more rows ask only for theirs."""
    path, broken = str(tmp_path / "ledger"), []

    def call(rows):
        if len(broken) == 2:
            raise RuntimeError("stopped")
        broken.append(1)
        return rows.select("key", F.concat(F.lit("said "), "key").alias("said"), F.lit(len(broken)).alias("call"))

    rows = spark.createDataFrame([(f"k{i % 30}", i) for i in range(60)], "key string, i int")
    with pytest.raises(RuntimeError):
        evaluation.ledgered(rows, "key", call, path)
    held = {r.key: r.call for r in spark.read.parquet(path).collect()}
    assert 0 < len(held) < 30
    broken.clear()
    broken.extend([1] * 10)
    more = rows.unionByName(spark.createDataFrame([("new", 1)], "key string, i int"))
    got = {r.key: (r.said, r.call) for r in evaluation.ledgered(more, "key", call, path).collect()}
    assert len(got) == 31 and all(said == f"said {k}" for k, (said, _) in got.items())
    assert all(got[k][1] == c for k, c in held.items()) and all(got[k][1] > 10 for k in got if k not in held)


def test_embedding_steps_go_on_and_share(spark, tmp_path):
    path = str(tmp_path / "store")
    asked = []

    def provider(texts):
        return [[float(len(t)) + 1, 2.0] for t in texts]

    pairs = spark.createDataFrame([(f"c{i}", f"text {i % 40}") for i in range(100)], "chunk_id string, text string")
    vectors.embed_in_steps(pairs.limit(30), provider, "m", 2, path, every=7)
    first = {r.chunk_id: tuple(r.vec) for r in spark.read.parquet(path).collect()}
    out = vectors.embed_in_steps(pairs, provider, "m", 2, path, every=7)
    got = {r.chunk_id: tuple(r.vec) for r in out.collect()}
    assert out.count() == len(got) == 100 and all(got[k] == v for k, v in first.items()) and not asked
    by_text = {}
    for r in pairs.collect():
        assert by_text.setdefault(r.text, got[r.chunk_id]) == got[r.chunk_id]
    size = lambda p: spark.read.parquet(str(p)).agg(F.sum(F.length("vectors"))).first()[0]
    rows = spark.createDataFrame([(i, [0.01 * ((i * j) % 97) for j in range(64)]) for i in range(500)], "row long, vec array<float>").coalesce(1)
    for half in (False, True):
        vectors.packed(rows, half=half).write.parquet(str(tmp_path / f"half{half}"))
    assert 2 * size(tmp_path / "halfTrue") == size(tmp_path / "halfFalse") == 500 * 64 * 4
    query = [float(j % 5) for j in range(64)]
    near = {half: [(r.row, round(r.score, 2)) for r in vectors.packed_top_k(spark.read.parquet(str(tmp_path / f"half{half}")), query, 5, digits=2).collect()] for half in (False, True)}
    assert [s for _, s in near[True]] == [s for _, s in near[False]]
    with pytest.raises(Exception, match="half precision"):
        vectors.packed(spark.createDataFrame([(1, [70000.0])], "row long, vec array<float>"), half=True).count()


def test_terms_by_an_automaton(spark, monkeypatch):
    """Overlapping terms, terms within words, signs at their ends, several automata: as the patterns of whole words say."""
    import random

    r = random.Random(2)
    terms = ["Acme", "Acme Corp", "Corp", "me C", "é", "Öl AG", "A.B.", "x_y", "(z)", "", None]
    pieces = ["Acme", "Corp", "Acme Corp", "Öl AG", "é", "cafés", "A.B.", "x_y", "x_yz", "(z)", " ", ", ", "-", ""]
    rows = [(f"d{i}", "".join(r.choice(pieces) + r.choice(["", " ", " "]) for _ in range(r.randrange(8)))) for i in range(200)] + [("n", None), ("e", "")]
    frame, asked = docs(spark, rows), spark.createDataFrame([(t,) for t in terms], "term string")
    want = {(i, t) for i, text_ in rows for t in terms if t and text_ and re.search(rf"\b{re.escape(t)}\b", text_)}
    assert {tuple(x) for x in analytics.term_hits(frame, asked).collect()} == want and want
    monkeypatch.setattr(analytics, "AUTOMATON_CHARS", 9)
    assert {tuple(x) for x in analytics.term_hits(frame, asked).collect()} == want
    assert analytics.term_hits(frame, asked.limit(0)).count() == 0 and analytics.term_hits(frame.limit(0), asked).count() == 0
