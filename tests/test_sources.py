"""Files in, tables out: workbooks, corpora, stores; and the streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from attesto.plans.fixtures import SHEETS, workbook
from attesto.sources import documents, parsers
from attesto.streaming import streams


def test_workbooks(spark):
    book = workbook(SHEETS)
    files = spark.createDataFrame([(bytearray(book),), (bytearray(b"junk"),)], "content binary")
    e = parsers.ercot_queue(files).collect()
    assert [(r.queue_id, r.county, r.mw, r.queue_date, r.air_permit, r.state) for r in e] == [("I1", "Polk", 120.5, "2024-01-01", "yes", "TX")]
    c = parsers.caiso_queue(files).collect()
    assert [(r.queue_id, r.mw, r.withdrawn, r.queue_date) for r in c] == [("7", 1000.0, True, "2024-01-02")]
    one = files.limit(1)
    assert [(r.plant, r.planned_online) for r in parsers.generators(one, "Planned").collect()] == [("P", "2026-03"), ("P2", "")]
    for bad in (lambda: parsers.generators(one, "Retired"), lambda: parsers.generators(one, "Operating").collect(), lambda: parsers.generators(files, "Planned").collect()):
        with pytest.raises(Exception, match="sheet|workbook"):
            bad()
    page = '<a href="/x/march_generator2024.xlsx"> <a href="/x/April_generator2024.xlsx"> <a href="/x/may_generator2023.xlsx"> <a href="/x/may_generator2023.xlsx">'
    assert [r.url[3:8] for r in parsers.workbook_links(spark.createDataFrame([(page,)], "html string")).collect()] == ["April", "march", "may_g"]


def test_loud_feeds(spark):
    one = lambda x: spark.createDataFrame([(x,)], "json string")
    for f in (parsers.fts_hits, parsers.permit_facilities):
        with pytest.raises(Exception, match="without"):
            f(one('{"other": 1}')).collect()
    assert tuple(parsers.permit_summary(one('{"Results":{"QueryID":"9","QueryRows":"12"}}')).first()) == ("9", 12)
    with pytest.raises(Exception, match="another shape"):
        parsers.permit_summary(one('{"Results":{"QueryID":"9","QueryRows":"x"}}')).collect()
    subs = '{"cik":"5","filings":{"recent":{"accessionNumber":["a","b","c"],"filingDate":["2024-01-01","2024-03-01","2024-02-01"],"form":["8-K","8-K","4"],"primaryDocument":["x","y","z"]}}}'
    assert [r.accession for r in parsers.recent_filings(one(subs), ["8-K", "10-K"], 5).collect()] == ["b", "a"]


def test_rollups(spark):
    texts = ["a", "a", "a b", "b", "c", "c d", "e"]
    rows = spark.createDataFrame([([(float(i), t) for i, t in enumerate(texts)],)], parsers.CUES.join(["c ", ""]))
    assert [x.text for x in rows.select(parsers.without_rollups(F.col("c")).alias("k")).first().k] == ["a", "b", "c", "d", "e"]


def test_corpus_round_trip(spark, tmp_path):
    good = {"id": "1", "text": "a b", "source_type": "s", "venue_type": "v", "date": "2024", "deep_link": "l"}
    (tmp_path / "raw" / "deep").mkdir(parents=True)
    (tmp_path / "raw" / "a.jsonl").write_text(json.dumps(good) + "\n\n{bad\n")
    (tmp_path / "raw" / "deep" / "b.jsonl").write_text(json.dumps(good | {"id": "2", "ticker": "T"}) + "\n" + json.dumps(good | {"date": None}) + "\n")
    docs = documents.read_directory(spark, str(tmp_path / "raw"))
    assert sorted((r.id, r.ticker) for r in docs.collect()) == [("1", None), ("2", "T")]
    assert documents.read_directory(spark, str(tmp_path / "none")).count() == 0
    out = str(tmp_path / "corpus")
    made = documents.build_corpus(docs, out, "v1")
    assert made["doc_count"] == 2 and made["source_counts"] == {"s": 2} and documents.read_manifest(spark, out) == made
    assert documents.read_snapshot(spark, f"{out}/docs").count() == 2 and documents.read_snapshot(spark, f"{out}/zz").count() == 0
    assert documents.build_corpus(docs.limit(0), out, "v1") is None and documents.read_manifest(spark, f"{out}/zz") is None
    again = documents.build_corpus(docs, str(tmp_path / "again"), "v1", created_at=made["created_at"])
    assert again == made


def test_history_and_stores(spark, tmp_path):
    rows = spark.createDataFrame([("c", "h", [1.0, 0.0], "m", 2)], "chunk_id string, content_hash string, vec array<float>, model string, dim int")
    for _ in range(2):
        documents.append_history(rows.select("chunk_id"), str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2
    documents.save_store(rows, str(tmp_path / "s"), "1")
    assert documents.load_store(spark, str(tmp_path / "s"), "m", 2).count() == 1
    with pytest.raises(ValueError):
        documents.load_store(spark, str(tmp_path / "s"), "m", 3)
    (tmp_path / "j.jsonl").write_text('{"query_id":"q","query":"x","criterion":"c","doc_id":"d","grade":1}\n\n')
    assert documents.read_judgments(spark, str(tmp_path / "j.jsonl")).first().grade == 1
    (tmp_path / "k.jsonl").write_text('{"query_id":"q"}\n')
    with pytest.raises(Exception, match="bad row"):
        documents.read_judgments(spark, str(tmp_path / "k.jsonl")).collect()


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:01", "x", 1.0), ("a", "2024-01-01 00:00:02", "y", 2.0), ("b", "2024-01-01 00:01:20", "z", 3.0), ("c", "2024-01-01 03:00:00", "late", 4.0)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "video string, t string, text string, value double").select("video", F.to_timestamp("t").alias("ts"), "text", "value", F.col("video").alias("accession")).write.parquet(path)
    schema = spark.read.parquet(path).schema
    read = lambda: spark.readStream.schema(schema).parquet(path)

    def run(df, name):
        q = streams.versioned_sink(df, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / name)).collect()

    assert sorted(r.accession for r in run(streams.new_entries(read()), "new")) == ["a", "b", "c"]
    assert ("a", "x y") in {(r.video, r.text) for r in run(streams.tumbling_captions(read()), "cap")}
    counts = run(streams.over_limit(streams.windowed_counts(read(), ["video"]), 1), "lim")
    assert [(r.video, r.n) for r in counts] == [("a", 2)]


def test_video_directory(spark, tmp_path):
    (tmp_path / "a.info.json").write_text('{"id": "vid", "upload_date": "20240102"}')
    (tmp_path / "a.en.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhello\n")
    (tmp_path / "a.zz.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nother\n")
    (tmp_path / "b.info.json").write_text('{"id": "none"}')
    docs = parsers.caption_docs(documents.read_video_dir(spark, str(tmp_path), "Alpha")).collect()
    assert [(r.id, r.text, r.date, r.jurisdiction) for r in docs] == [("yt:vid:seg000", "hello", "2024-01-02", "Alpha")]


def test_mapping_cache_and_digest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"Polk, IA": "Polk County, IA"}')
    assert [tuple(r) for r in documents.read_mapping(spark, str(tmp_path / "m.json")).collect()] == [("Polk, IA", "Polk County, IA")]
    assert documents.read_mapping(spark, str(tmp_path / "none.json")).count() == 0
    cache = spark.createDataFrame([("A", "2024-01-02 10:00:00"), ("B", "2024-01-01 00:00:00"), ("../C", "2024-01-02 10:00:00")], "ticker string, fetched_at string")
    assert [r.ticker for r in documents.fresh_prices(cache, "2024-01-02 12:00:00").collect()] == ["A"]
    (tmp_path / "f").write_bytes(b"abc")
    assert documents.file_sha256(str(tmp_path / "f")).startswith("ba7816bf")


def test_command_line(spark, tmp_path, capsys):
    from attesto import __main__ as cli

    doc = {"text": "substation permit granted", "source_type": "s", "venue_type": "v", "date": "2024", "deep_link": "l"}
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(doc | {"id": i, "source_type": s}) for i, s in (("1", "s"), ("2", "t"))))
    where = str(tmp_path / "i")
    assert cli.main(["build", str(tmp_path / "d.jsonl"), where], spark) == 0
    cli.main(["search", "permit", "--index", where, "--source", "t"], spark)
    assert "\t2\t" in (out := capsys.readouterr().out) and "\t1\t" not in out
    cli.main(["search", "substation permit", "--phrase", "--k", "1", "--index", where], spark)
    assert "\t1\t" in capsys.readouterr().out
    cli.main(["demo", "--index", where, "--op", "AND"], spark)
    assert capsys.readouterr().out.count("#") == 3
    with pytest.raises(SystemExit):
        cli.main(["search", "x", "--index", where, "--k", "0"], spark)


def test_sql_surface(spark):
    from attesto.operators.index import build
    from attesto.plans import sql

    sql.register(spark, build(spark.createDataFrame([("1", "300 MW substation"), ("2", "none of it")], "id string, text string")))
    assert spark.sql("SELECT id FROM hits WHERE term = 'substation'").first().id == "1"
    assert spark.sql("SELECT analyze('Straße')[0] AS t").first().t == "strasse"
    row = spark.sql("SELECT d.id, q.* FROM docs d, LATERAL quantities(d.text) q").first()
    assert (row.id, row.kind, row.value, row.unit) == ("1", "power", 300.0, "MW")


def test_lanes(spark, tmp_path):
    from attesto.plans import lanes

    def broken(s, day):
        raise RuntimeError("feed is down")

    made = lanes.refresh(spark, {"a": lambda s, day: s.createDataFrame([(day,)], "d string"), "b": lambda s, day: None, "c": broken}, lanes.since({"created_at": "2024-05-06T00:00:00"}), str(tmp_path / "lanes"))
    assert [(r["lane"], r["status"], r["rows"]) for r in made] == [("a", "ok", 1), ("b", "skipped", 0), ("c", "failed", 0)]
    assert lanes.since(None) == "2024-01-01"
    path = str(tmp_path / "runs")
    feed = lambda *ids: {"a": lambda s, day: s.createDataFrame([(i, "x") for i in ids], "id long, t string"), "empty": lambda s, day: s.createDataFrame([], "id long, t string")}
    turns = [lanes.refresh(spark, feed(*ids), "2024-01-01", path, run, {"a": ["id"]}) for run, ids in (("1", (1, 2, 3)), ("1", (1, 2, 3)), ("2", (2, 3, 4, 5, 5)), ("2", (4,)))]
    assert [[(r["status"], r["rows"]) for r in t] for t in turns] == [[("ok", n), ("ok", 0)] for n in (3, 3, 2, 1)]
    assert sorted((r.id, r.run) for r in lanes.lane_rows(spark, path, "a", "id long").collect()) == [(1, "1"), (2, "1"), (3, "1"), (4, "2")]
    assert lanes.refresh(spark, {"a": broken}, "2024-01-01", path, "2")[0]["status"] == "failed"
    assert lanes.lane_rows(spark, path, "a", "id long").count() == 4 and lanes.lane_rows(spark, path, "never", "id long").count() == 0


def test_sinks_of_several_batches(spark, tmp_path):
    from attesto.streaming import streams

    for mode in ("append", "complete"):
        at = tmp_path / mode
        for turn in range(2):
            spark.createDataFrame([(turn, "k")], "n long, k string").coalesce(1).write.mode("append").parquet(str(at / "in"))
            stream = spark.readStream.schema("n long, k string").parquet(str(at / "in"))
            stream = stream.groupBy("k").count() if mode == "complete" else stream
            streams.versioned_sink(stream, str(at / "out"), str(at / "checkpoint"), mode).awaitTermination()
        got = sorted(tuple(r) for r in streams.sink_rows(spark, str(at / "out"), mode).collect())
        assert got == ([("k", 2)] if mode == "complete" else [(0, "k"), (1, "k")])


def test_snippets_by_the_index_words(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from attesto.functions import text

    body = "x " * 200 + "cafe\u0301 noir " + "y " * 200 + "noir"
    for form in (body, unicodedata.normalize("NFC", body), body.replace("noir", "ＮＯＩＲ")):
        got = spark.createDataFrame([(form,)], "t string").select(text.centred_snippet(F.col("t"), F.array(F.lit("café"))).alias("s")).first().s
        assert unicodedata.normalize("NFC", got[80:]).startswith("café") and len(got) < 200
    samples = ["½ Straße ﬁn a\u0308b", "한글 \u1112\u1161\u11ab", "plain Words 1_2", "", "e\u0301\u0327x ＡＢ", "\u0301lead"]
    for s in samples:
        assert [w for w, _, _ in text.placed_tokens(s)] == text.analyze_text(s)


def test_positions_and_reports(spark):
    from attesto.operators import analytics

    raw = [
        {"symbol": {"symbol": {"symbol": "AAA", "currency": {"code": "USD"}, "type": {"description": "Stock"}}}, "fractional_units": 2, "price": 3},
        {"symbol": {"symbol": "BBB", "currency": "CAD"}, "units": 4, "market_value": 9}, {"symbol": "CCC"}, {"symbol": {}}, {"units": 1},
    ]
    rows = spark.createDataFrame([(json.dumps(r),) for r in raw], "json string")
    got = sorted((r.symbol, r.quantity, r.market_value, r.currency, r.kind) for r in analytics.normalised_positions(rows).collect())
    assert got == [("AAA", 2.0, 6.0, "USD", "Stock"), ("BBB", 4.0, 9.0, "CAD", None), ("CCC", None, None, None, None)]
    mentions = spark.createDataFrame([("d1", "2024-01-05", 3.0), ("d2", "2023-01-05", 9.0), ("d3", "2024-01-06", 5.0)], "doc_id string, date string, return_pct double")
    assert [r.doc_id for r in analytics.recent_mentions(mentions, "2024-01-10", 30, 5).collect()] == ["d3", "d1"]
    with pytest.raises(ValueError):
        analytics.recent_mentions(mentions, "2024-01-10", 0, 5)
    live, soon = analytics.upcoming(spark.createDataFrame([("j", "v1", "is_live"), ("j", "v2", "is_upcoming")], "jurisdiction string, video_id string, status string"))
    assert live.first().video_id == "v1" and soon.first().video_id == "v2"


def test_shared_folder(spark):
    from types import SimpleNamespace

    from attesto.operators import tables

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="app-x"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(cluster)
    with tables.cleared(keep=1):
        gone = tables.written(spark.range(3))
        kept = tables.written(gone.where("id > 0"))
    assert kept.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()
    at = tables.put(spark, f"{tables.shared_dir(spark)}/note/x.txt", "a\nb")
    assert tables.exists(spark, at) and [r.value for r in spark.read.text(at).collect()] == ["a", "b"]


def test_workers_find_the_package_without_the_drivers_path(tmp_path):
    """A driver that knows the package by sys.path alone; workers get it from Spark."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession, functions as F\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.driver.host', '127.0.0.1').getOrCreate()\n"
        "from attesto.functions import text\n"
        "assert spark.createDataFrame([('ＡＢＣ',)], 't string').select(text.analyze(F.col('t')).alias('a')).first().a == ['abc']\n"
        "from attesto.plans import sql\n"
        "from attesto.sources import parsers\n"
        "sql.register(spark)\n"
        "assert spark.sql(\"SELECT analyze('Straße')[0] AS t, size(claims('One. Two.')) AS n, verdict('{}') AS v\").first().t == 'strasse'\n"
        "assert spark.sql(\"SELECT q.kind FROM quantities('300 MW') q\").first().kind == 'power'\n"
        "files = spark.createDataFrame([(b'no workbook',)], 'content binary')\n"
        "assert parsers.ercot_queue(files).count() == 0 and parsers.caiso_queue(files).count() == 0\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=200)


def test_rollups_of_a_stream_are_those_of_a_file(spark, tmp_path):
    """Two batches, the second with a cue that belongs before some of the first's."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from attesto.sources import parsers
    from attesto.streaming import streams

    texts = ["we call", "we call the roll", "the roll", "the roll of members", "new business", "new business", "business", "none"]
    rows = [("v", datetime(2024, 1, 1) + timedelta(seconds=5 * i), t) for i, t in enumerate(texts)]
    end = [("w", datetime(2024, 1, 2), "end"), ("v", datetime(2024, 1, 1), None)]
    for turn, part in enumerate(([rows[i] for i in (0, 1, 3, 5)], [rows[i] for i in (2, 4, 7, 6)], end)):
        spark.createDataFrame(part, "video string, ts timestamp, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("video string, ts timestamp, text string").parquet(str(tmp_path / "in"))
        streams.versioned_sink(streams.without_rollups(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = [r.text for r in streams.sink_rows(spark, str(tmp_path / "out")).where("video = 'v'").orderBy("at").collect()]
    cues = F.array(*(F.struct(F.lit(5.0 * i).alias("start"), F.lit(t).alias("text")) for i, t in enumerate(texts)))
    assert got == [c.text for c in spark.range(1).select(parsers.without_rollups(cues).alias("c")).first().c]


def test_rollups_take_linear_time():
    """Each cue that the watermark has passed is taken once; the others aren't moved for it."""
    import time

    import pandas as pd

    from attesto.streaming import streams

    class State:
        exists, get = False, None

        def getCurrentWatermarkMs(self):
            return 10**12

        def update(self, value):
            self.held = value

        def setTimeoutTimestamp(self, at):
            self.timeout = at

    n, state = 600_000, State()
    late = 10**15 + 5
    frame = pd.DataFrame({"at": [*range(n), late], "text": [f"said {i}" for i in range(n + 1)]})
    began = time.process_time()
    out = next(streams._rolled(("v",), iter([frame]), state))
    assert time.process_time() - began < 15
    assert len(out) == n and out["at"].is_monotonic_increasing and state.held == (f"said {n - 1}", [(late, f"said {n}")])


def test_snippets_of_plain_texts_stay_in_generated_code(spark):
    """The same by generated code as word by word; others are looked at up to the word that is asked for."""
    from pyspark.sql import functions as F

    from attesto.functions import text

    rows = ["", None, "that", "thatch a-THAT? " + "z" * 200, "Straße " * 50 + "that", "x\n" * 300 + "Été, WITH it", "éthat with", "no word " * 60, "that_1 _with_", "ſomething " * 40 + "WİTH with that"]
    frame = spark.createDataFrame(list(enumerate(rows)), "n int, t string")
    for terms in (["that", "with"], ["strasse", "a.b"], ["été"], [".*"], []):
        wanted = F.array(*(F.lit(t) for t in terms)).cast("array<string>")
        got = [r.s for r in frame.select("n", text.centred_snippet(F.col("t"), wanted).alias("s")).orderBy("n").collect()]
        assert got == [r.s for r in frame.select("n", text._centred_snippet(F.col("t"), wanted).alias("s")).orderBy("n").collect()]
    assert next(text.placed_tokens("ſome " + "word " * 3)) == ("some", 0, 4)  # nothing behind it is taken


def test_texts_without_names_are_not_taken_apart(spark, monkeypatch):
    from attesto.functions import extract
    from attesto.operators import analytics

    taken, last = [], extract._last_word
    monkeypatch.setattr(extract, "_last_word", lambda chunk: taken.append(chunk) or last(chunk))
    body = "Some Words Here " * 200 + "of Acme Land Holdings, LLC and (Project Blue Sky Review)"
    assert extract.projects_of(body) == ["Project Blue Sky"] and extract.entities_of(body) == ["Acme Land Holdings"]
    assert len(taken) < 12
    docs = spark.createDataFrame([(str(i), t, "county_meeting", "2024-01-01", "l", "j") for i, t in enumerate(["nothing here", None, body])], "id string, text string, source_type string, date string, deep_link string, jurisdiction string")
    mined = analytics.mine_names(docs)
    assert sorted(r.name for r in mined.collect()) == ["Acme Land Holdings", "Project Blue Sky"]
    plan = mined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Contains(text")


def test_batches_of_texts_are_small_for_functions_of_series(spark):
    from pyspark.sql import functions as F

    from attesto.functions import text, udf

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    spark.range(1).select(text.analyze(F.lit("a b"))).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == udf.BATCH


def test_rollups_of_a_hot_video_are_many_groups(spark, tmp_path):
    """Spans of a few seconds, gaps, late cues and several batches: the same as the cues in order, and no state holds more than a span."""
    import random
    from datetime import datetime, timedelta

    import pandas as pd

    from attesto.streaming import streams

    r, start = random.Random(4), datetime(2024, 1, 1)
    at = lambda us: start + timedelta(microseconds=us)
    texts = ["a", "a b", "b", "", "a b c", "c"]
    held, got, late = [], set(), -1
    for turn in range(4):
        part = [("vw"[i % 2], r.randrange(25_000_000) // 700 * 700 + turn * 12_000_000 + (30_000_000 if i % 9 == 0 else 0), r.choice(texts)) for i in range(60)]
        held += [x for x in part if x[1] >= late]
        spark.createDataFrame([(v, at(us), t) for v, us, t in part], "video string, ts timestamp, text string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("video string, ts timestamp, text string").parquet(str(tmp_path / "in"))
        streams.versioned_sink(streams.without_rollups(stream, "9 seconds", span=5), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        late = max(late, (max(x[1] for x in part) // 1000 - 9000) * 1000)
    want = []
    for video in "vw":
        last = None
        for _, us, t in sorted(x for x in held if x[0] == video and x[1] < late):
            said, last = streams._said(last, t), t
            want += [(video, us, said)] if said else []
    zero = spark.sql("select unix_micros(timestamp'2024-01-01') as z").first().z
    got = sorted((x.video, x.at - zero, x.text) for x in streams.sink_rows(spark, str(tmp_path / "out")).collect())
    assert got == sorted(want) and len(want) >= 50

    class State:
        exists, get = False, None

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.held = value

        def setTimeoutTimestamp(self, at):
            self.timeout = at

    rows = pd.DataFrame({"at": range(10), "text": ["x"] * 10})
    state = State()
    assert not len(next(streams._rolled(("v", streams._ALL), iter([rows]), state, 5))) and state.held == (None, [(9, "x")])
