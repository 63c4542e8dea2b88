"""Segments of blocks: grouping within documents, bounds that skip, deletes, additions, compaction."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesto.operators import evaluation, index, search

WORDS = ["w%d" % i for i in range(40)]
SCHEMA = "id string, text string, source_type string"


def _corpus(seed, n):
    """Words of very different frequencies; a few short documents full of one of them."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [WORDS[min(39, int(r.expovariate(0.15)))] for _ in range(r.choice([0, 1, 5, 60, 300]))]
        if r.random() < 0.04:
            words = ["w17"] * r.randrange(1, 9) + ["w3"]
        rows.append((f"d{i}", " ".join(words) if words else r.choice([None, "", "?!"]), "t"))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_words_are_grouped_within_their_document(spark):
    rows = [("a", "b a b c b"), ("b", None), ("c", ""), ("d", "a")]
    built = index.build(spark.createDataFrame([(*r, "t") for r in rows], SCHEMA))
    assert _rows(built.postings, "id", "term") == [("a", "a", 1, 5, [1]), ("b", "a", 3, 5, [0, 2, 4]), ("c", "a", 1, 5, [3]), ("a", "d", 1, 1, [0])]
    assert "Exchange" not in built.postings._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "").split("MapInArrow")[0]


@pytest.mark.parametrize("seed", [1])
def test_bounds_skip_blocks_and_lose_nothing(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(index, "RANGE_DOCS", 30)
    monkeypatch.setattr(search, "FIRST_RANGES", 3)
    index.build(_frame(spark, _corpus(seed, 900))).save(str(tmp_path / "i"))
    held = index.Index.load(spark, str(tmp_path / "i"))
    skipped = 0
    for query, k in (("w17", 5), ("w17 w3", 4), ("w0 w1 w17", 10), ("w38 w2 w2", 3), ("absent", 5), ("w39 absent", 1000)):
        full = [(r.id, round(r.score, 9)) for r in search.top(search.scores(held, query), k).orderBy("rank").collect()]
        assert [(r.id, round(r.score, 9)) for r in search.ranked_search(held, query, k, least=0).orderBy("rank").collect()] == full
        every, kept = search.worth_reading(held, query, k)
        skipped += every.count() - kept.count()
        for k1, b in ((0.0, 0.0), (2.5, 1.0)):
            best = {(r.segment, r.range): r.bound for r in search.bounds(held, query, k1, b).collect()}
            scored = search.scores(held, query, k1, b).agg(F.max("score")).first()[0]
            assert scored is None and not best or scored <= max(best.values()) + 1e-9
    assert skipped > 10


def test_segments_answer_as_a_fresh_build(spark, tmp_path):
    rows = _corpus(5, 200)
    path, first, later = str(tmp_path / "i"), rows[:150], rows[150:]
    index.build(_frame(spark, first)).save(path)
    files = {p for p in (tmp_path / "i").rglob("*.parquet")}
    index.delete_saved(spark, path, [f"d{i}" for i in range(0, 150, 4)])
    assert all("gone" in str(p) for p in {*(tmp_path / "i").rglob("*.parquet")} - files)  # only ids are written
    again = [("d0", "w3 w17 again", "u"), ("d4", None, "u")]
    index.add_saved(spark, path, _frame(spark, [*later, *again]))
    index.delete_saved(spark, path, ["d4", later[0][0]])
    live = [r for r in first if int(r[0][1:]) % 4] + later[1:] + again[:1]
    fresh = index.build(_frame(spark, live))

    def same(held):
        assert _rows(held.postings, "term", "id") == _rows(fresh.postings, "term", "id")
        assert _rows(held.term_stats, "term") == _rows(fresh.term_stats, "term")
        assert _rows(held.doc_stats, "id") == _rows(fresh.doc_stats, "id") and _rows(held.docs, "id") == _rows(fresh.docs, "id")
        assert _rows(held.corpus_stats, "n") == _rows(fresh.corpus_stats, "n")
        for query in ("w17 w3", "w0 again"):
            want = [(r.id, round(r.score, 9)) for r in search.ranked_search(fresh, query, 8).orderBy("rank").collect()]
            assert [(r.id, round(r.score, 9)) for r in search.ranked_search(held, query, 8, least=0).orderBy("rank").collect()] == want
            assert _rows(search.boolean_search(held, query, "AND"), "id") == _rows(search.boolean_search(fresh, query, "AND"), "id")

    held = index.Index.load(spark, path)
    same(held)
    index.compact(spark, path)
    assert len(index.Index.load(spark, path).segments) == 1
    same(index.Index.load(spark, path))
    same(held)  # readers of the old state go on
    with pytest.raises(KeyError):
        index.delete_saved(spark, path, ["d4"])
    with pytest.raises(ValueError, match="repeated"):
        index.add_saved(spark, path, _frame(spark, [("d0", "x", "t")]))
    with pytest.raises(ValueError, match="repeated"):
        index.add_saved(spark, path, _frame(spark, [("n", "x", "t"), ("n", "y", "t")]))


def test_an_empty_index(spark, tmp_path):
    path = str(tmp_path / "i")
    index.build(_frame(spark, [])).save(path)
    held = index.Index.load(spark, path)
    assert search.ranked_search(held, "w1", 3, least=0).count() == 0 and held.postings.count() == 0 and held.corpus_stats.first().n == 0
    index.add_saved(spark, path, _frame(spark, [("a", "w1 w2", "t")]))
    assert [r.id for r in search.ranked_search(index.Index.load(spark, path), "w1", 3, least=0).collect()] == ["a"]


def test_blocks_are_gathered_from_sorted_rows(spark):
    """The plans of a write see no hash aggregation of lists; the setting is as before afterwards."""
    rows = lambda: spark.range(9).groupBy("id").agg(F.collect_list("id"))._jdf.queryExecution().sparkPlan().toString()
    assert "ObjectHashAggregate" in rows()
    with index._by_sorting(spark):
        assert "ObjectHashAggregate" not in rows() and "SortAggregate" in rows()
    assert "ObjectHashAggregate" in rows()


def test_a_phrase_takes_a_row_for_each_word_of_a_document(spark):
    texts = ["a b c", "a a b", "b a", "a x b a b", "b a a", "a b c a b d"]
    built = index.build(spark.createDataFrame([(f"d{i}", t, "t") for i, t in enumerate(texts)], SCHEMA))
    found = lambda words: [r.id for r in search.phrase_search(built, words).collect()]
    assert found("a b") == ["d0", "d1", "d3", "d5"] and found("a a") == ["d1", "d4"] and found("a b d") == ["d5"] and found("b") == [f"d{i}" for i in range(6)]
    assert not found("a z") and not found("")
    assert "explode(" not in search.phrase_search(built, "a b")._jdf.queryExecution().toString()


def test_hits_of_many_queries_are_dealt_by_their_number(spark, monkeypatch):
    built = index.build(_frame(spark, _corpus(3, 200)))
    queries = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} w3") for i in range(9)], "query_id string, query string")
    grid = spark.createDataFrame([(0.9, 0.4), (1.5, 0.75)], "k1 double, b double")
    taken = lambda g: {tuple(r[:-1]): round(r.score, 9) for r in evaluation.batch_scores(built, queries, g).collect()}
    few = taken(None), taken(grid)
    monkeypatch.setattr(evaluation, "TASK_HITS", 20)
    assert (taken(None), taken(grid)) == few and len(few[1]) == 2 * len(few[0])
    assert "REPARTITION_BY_NUM" in evaluation.batch_scores(built, queries)._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_built_and_compacted_whole(spark, tmp_path, monkeypatch):
    """A build and a compaction move blocks, not postings; segments of other ranges are dealt anew, with the same result."""
    rows, path = _corpus(7, 240), str(tmp_path / "i")
    live = [r for r in rows if int(r[0][1:]) % 5]
    fresh = index.build(_frame(spark, live))
    assert fresh.parts(1, 1000).count() < fresh.postings.count() / 3
    dealt, singles = [], index._singles
    monkeypatch.setattr(index, "_singles", lambda *a: dealt.append(a) or singles(*a))
    index.build(_frame(spark, rows[:200])).save(path)
    index.add_saved(spark, path, _frame(spark, rows[200:]))
    index.delete_saved(spark, path, [r[0] for r in rows if not int(r[0][1:]) % 5])
    for docs, again in ((4096, 0), (30, 1), (4096, 1)):
        monkeypatch.setattr(index, "RANGE_DOCS", docs)
        dealt.clear()
        index.compact(spark, path)
        held = index.Index.load(spark, path)
        assert len(dealt) == again and _rows(held.postings, "term", "id") == _rows(fresh.postings, "term", "id")
        blocks = held.segments[0].blocks.select("term", "range", "n", "tf", "length", "p").collect()
        assert len({(b.term, b.range) for b in blocks}) == len(blocks) and (docs == 4096 or held.segments[0].ranges == len(live) // 30)
        for b in blocks:
            assert (b.n, b.tf, b.length) == (len(b.p), max(x.tf for x in b.p), min(x.length for x in b.p)) and [x.id for x in b.p] == sorted(x.id for x in b.p)


@pytest.mark.parametrize("buckets, slots, places, at_once", [(8, 1, 10**6, 10**6), (3, 4, 700, 10**6), (2, 2, 700, 300)])
def test_postings_are_moved_packed(spark, monkeypatch, buckets, slots, places, at_once):
    """A row for each bucket and slot of many documents, in a fraction of the postings' bytes; unpacked, each block is whole and once there."""
    monkeypatch.setattr(index, "PACK_PLACES", places)
    monkeypatch.setattr(index, "OPEN_PLACES", at_once)
    monkeypatch.setattr(index, "OUT_PLACES", 200)
    fresh = index.build(_frame(spark, _corpus(11, 300)))
    chunks = sorted(fresh.parts(3, buckets, slots).collect(), key=lambda r: r[:2])
    assert "hashpartitioning" not in fresh.parts(3, buckets, slots)._jdf.queryExecution().executedPlan().toString()  # no texts are exchanged
    postings = fresh.postings.collect()
    assert sum(len(c.chunk) for c in chunks) < 12 * len(postings) + 9000 * len(chunks)
    batches = [pa.RecordBatch.from_pylist([c.asDict() for c in chunks[i : i + 5]], pa.schema([("bucket", pa.int32()), ("slot", pa.int32()), ("chunk", pa.binary())])) for i in range(0, len(chunks), 5)]
    blocks = [row for batch in index._opened(iter(batches)) for row in batch.to_pylist()]
    assert len({(b["term"], b["range"]) for b in blocks}) == len(blocks)
    assert all(b["bucket"] == index._bucket(b["term"].encode(), buckets) and b["n"] == len(b["p"]) and b["tf"] == max(x["tf"] for x in b["p"]) and b["length"] == min(x["length"] for x in b["p"]) for b in blocks)
    assert sorted((b["term"], x["id"], x["tf"], x["length"], x["positions"]) for b in blocks for x in b["p"]) == sorted(map(tuple, postings))
    assert len({b["range"] for b in blocks}) > 3


def test_keys_too_large_for_one_number_are_put_in_order():
    keys = [np.array(x) for x in ([1, 0, 1, 0], [2**40, 5, 2**40, 5], [7, 2**40, 6, 2**40])]
    assert index._order(*keys).tolist() == [1, 3, 2, 0] == index._order(*(k % 1000 for k in keys[:1]), *keys[1:]).tolist()
    assert index._order(np.zeros(0, np.int32), np.zeros(0, np.int32)).tolist() == []


def test_blocks_are_not_moved_for_deleted_ids(spark, tmp_path, monkeypatch):
    """Deleted ids of a range are sent to its blocks, whatever Spark knows of their size; with more of them than may be sent the result is the same."""
    path, name = str(tmp_path / "i"), "spark.sql.autoBroadcastJoinThreshold"
    index.build(_frame(spark, _corpus(2, 120))).save(path)
    index.delete_saved(spark, path, [f"d{i}" for i in range(0, 120, 3)])
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        held = index.Index.load(spark, path)
        segment, _, _, lengths = held.saved[0]
        rows = index._kept_blocks(segment, lengths, held.gone)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [range" in plan and "SortMergeJoin [range" not in plan
        monkeypatch.setattr(index, "BROADCAST_IDS", 5)
        many = index._kept_blocks(segment, lengths, held.gone)
        assert "SortMergeJoin [range" in many._jdf.queryExecution().executedPlan().toString()
        flat = lambda x: _rows(x.select("term", "range", F.sort_array("lost")), "term", "range")
        assert flat(rows) == flat(many)
    finally:
        spark.conf.set(name, before)
