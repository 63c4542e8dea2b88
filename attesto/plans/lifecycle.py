"""Queries of what is written and read again: corpora, indexes, stores, histories, lanes, streams, and the engine's surfaces."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from .. import __main__ as cli
from ..operators import analytics, evaluation, vectors
from ..operators.tables import put, shared_dir
from ..sources import documents
from ..streaming import streams
from . import fixtures as fx
from . import lanes, sql
from .base import ASKED, BASE, DIGITS, DOCS, bm25_sql, built, corpus, query, table, values


def _fresh(spark) -> str:
    """A folder of one's own below the shared one."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query(f"WITH {DOCS} SELECT source_type, count(*) AS n, (SELECT count(*) FROM docs) AS doc_count, (SELECT count(DISTINCT id) FROM docs) AS ids FROM docs GROUP BY 1")
def corpus_build(spark, sf_dir):
    """Writes the corpus with its index and manifest, and reads snapshot and manifest again."""
    path = _fresh(spark)
    documents.build_corpus(corpus(spark, sf_dir).drop("ord"), path, "v1")
    made = documents.read_manifest(spark, path)
    ids = documents.read_snapshot(spark, f"{path}/docs").agg(F.count_distinct("id").alias("ids"))
    counts = spark.createDataFrame([(k, v, made["doc_count"]) for k, v in made["source_counts"].items()], "source_type string, n long, doc_count long")
    return counts.crossJoin(F.broadcast(ids))  # one row


@query(f"WITH {DOCS} SELECT id, source_type, date FROM docs WHERE id = '7'")
def index_document(spark, sf_dir):
    return built(spark, sf_dir).doc("7").select("id", "source_type", "date")


@query(f"{BASE} SELECT 'that' AS term, count(*) AS df FROM post WHERE term = 'that' UNION ALL SELECT 'no such term', 0")
def index_df(spark, sf_dir):
    i = built(spark, sf_dir)
    parts = [i.df(t).select(F.lit(t).alias("term"), "df") for t in ("that", "no such term")]
    return parts[0].unionByName(parts[1])


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 64 AS dim, len(embedding) AS size FROM embeddings")
def store_round_trip(spark, sf_dir):
    """Saves two versions of the store, the second of no rows, goes back to the first, and loads it with its checks."""
    path = _fresh(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"), F.col("embedding").alias("vec"), F.lit("m").alias("model"), F.lit(64).alias("dim"))
    documents.save_store(rows, path, "1")
    documents.save_store(rows.limit(0), path, "2")
    documents.point_to(spark, path, "1")
    return documents.load_store(spark, path, "m", 64).select("chunk_id", "dim", F.size("vec").cast("long").alias("size"))


@query("SELECT doc_id AS chunk_id, length(text) > 24000 AS truncated FROM documents")
def embed_in_steps(spark, sf_dir):
    """Embeds documents in steps that a stopped run goes on from."""
    provider = lambda texts: [[float(t.count(c)) + 1 for c in "abcd"] for t in texts]
    pairs = corpus(spark, sf_dir).select(F.col("id").alias("chunk_id"), "text")
    path = _fresh(spark)
    vectors.embed_in_steps(pairs.where("chunk_id < '5'"), provider, "letters", 4, path, every=400)
    held = vectors.embed_in_steps(pairs, provider, "letters", 4, path, every=400)
    return held.select(F.col("chunk_id").cast("long").alias("chunk_id"), "truncated")


_DOC = {"text": "t", "source_type": "s", "venue_type": "v", "date": "2024", "deep_link": "l"}


def _line(**more) -> str:
    return json.dumps(_DOC | more)


@query(values("ord, id, ticker", "(1::BIGINT, 'a', NULL)", "(2, 'b', 'T')", "(3, 'c', NULL)", "(4, 'a', 'again')"))
def directory_fixture(spark, sf_dir):
    """Files in order of their paths, lines in order within them; what is no document is left out."""
    path = _fresh(spark)
    put(spark, f"{path}/a.jsonl", f"{_line(id='a')}\n\n{{bad\n{_line(id='b', ticker='T')}\n")
    put(spark, f"{path}/deep/b.jsonl", f"{_line(id='c')}\n{_line(id='x', date=None)}\n{_line(id='a', ticker='again')}")
    put(spark, f"{path}/notes.txt", _line(id="z"))
    return documents.read_directory(spark, path, ordered=True).select("ord", "id", "ticker")


@query(values("id, text, date, jurisdiction", "('yt:vid:seg000', 'hello', '2024-01-02', 'Alpha')"))
def video_fixture(spark, sf_dir):
    from ..sources import parsers

    path = _fresh(spark)
    cue = "WEBVTT\n\n00:01.000 --> 00:02.000\n"
    for name, body in (("a.info.json", '{"id": "vid", "upload_date": "20240102"}'), ("a.en.vtt", cue + "hello\n"), ("a.zz.vtt", cue + "other\n"), ("b.info.json", '{"id": "none"}')):
        put(spark, f"{path}/{name}", body)
    return parsers.caption_docs(documents.read_video_dir(spark, path, "Alpha")).select("id", "text", "date", "jurisdiction")


@query(values("kind, ord, id, said", "('judgment', 1::BIGINT, 'q', '1')", "('qa', 2, 'a1', 'd1,d2')", "('unanswerable', 1, 'u1', 'out-of-scope')", "('label', 2, 'l1', 'supported')"))
def loaders_fixture(spark, sf_dir):
    """Strict loaders; ord is the line."""
    path = _fresh(spark)
    judged = put(spark, f"{path}/j.jsonl", '{"query_id":"q","query":"x","criterion":"c","doc_id":"d","grade":1}\n\n')
    qa = put(spark, f"{path}/qa.jsonl", '\n{"qa_id":"a1","question":"x","criterion":"c","answer_doc_ids":["d1","d2"],"origin":"owner"}\n')
    none = put(spark, f"{path}/u.jsonl", '{"qa_id":"u1","question":"x","notes":"n","reason":"out-of-scope"}')
    label = '{"label_id":"%s","question":"q","answer_text":"a","claim":"c","chunk_texts":["t"],"human_verdict":"supported"}\n'
    labels = put(spark, f"{path}/l.jsonl", label % "example-1" + label % "l1")
    parts = (
        documents.read_judgments(spark, judged).select(F.lit("judgment").alias("kind"), "ord", F.col("query_id").alias("id"), F.col("grade").cast("string").alias("said")),
        documents.read_qa(spark, qa).select(F.lit("qa").alias("kind"), "ord", F.col("qa_id").alias("id"), F.array_join("answer_doc_ids", ",").alias("said")),
        documents.read_unanswerable(spark, none).select(F.lit("unanswerable").alias("kind"), "ord", F.col("qa_id").alias("id"), F.col("reason").alias("said")),
        documents.read_labels(spark, labels).select(F.lit("label").alias("kind"), "ord", F.col("label_id").alias("id"), F.col("human_verdict").alias("said")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(values("what, said", "('judgment', 'bad row, line 3: grade is missing')", "('qa', 'bad row, line 1: origin must be one of judgments, owner')", "('ids', 'bad row, line 1: answer_doc_ids must be a list of ids')", "('unanswerable', 'bad row, line 2: not a JSON object')", "('board', 'board 2: email is no address')"))
def loader_errors_fixture(spark, sf_dir):
    path = _fresh(spark)
    good = '{"query_id":"q","query":"x","criterion":"c","doc_id":"d","grade":1}\n'
    qa = '{"qa_id":"a1","question":"x","criterion":"c","answer_doc_ids":%s,"origin":"%s"}'
    cases = {
        "judgment": (documents.read_judgments, good + "\n" + good.replace("1}", "null}")), "qa": (documents.read_qa, qa % ('["d"]', "guess")), "ids": (documents.read_qa, qa % ("[]", "owner")),
        "unanswerable": (documents.read_unanswerable, '{"qa_id":"u1","question":"x","notes":"n","reason":"out-of-scope"}\n[1]'),
        "board": (documents.read_boards, '[{"jurisdiction":"A","name":"n","email":"a@b"},{"jurisdiction":"B","name":"n","email":"none"}]'),
    }
    said = []
    for name, (read, body) in cases.items():
        try:
            read(spark, put(spark, f"{path}/{name}", body)).collect()
        except Exception as error:  # what it says is the result
            text = str(error)
            at = max(text.find("bad row, line"), text.find("board "))
            said.append((name, text[at:].split("\n")[0].split(" SQLSTATE")[0].strip()))
    return spark.createDataFrame(said, "what string, said string")


@query(values("ticker, code, value", "('T', 'S', 10::DOUBLE)"))
def transactions_fixture(spark, sf_dir):
    path = put(spark, f"{_fresh(spark)}/t.jsonl", '{"ticker":"T","code":"S","value":10.0}\n{bad\n{"ticker":"","code":"P","value":1.0}\n')
    return documents.read_transactions(spark, path).select("ticker", "code", "value")


@query(values("kind, name, said", "('ticker', 'AAA', 'power')", "('place', 'Polk, IA', 'Polk County, IA')", "('board', 'Alpha', 'a@b')"))
def registry_fixture(spark, sf_dir):
    path = _fresh(spark)
    held = documents.read_registry(spark, put(spark, f"{path}/r.json", '{"tickers": [{"symbol": "AAA", "sector": "power"}]}'))
    tickers = spark.createDataFrame([("ticker", t["symbol"], t["sector"]) for t in held["tickers"]], "kind string, name string, said string")
    places = documents.read_mapping(spark, put(spark, f"{path}/m.json", '{"Polk, IA": "Polk County, IA", "x": 1}')).select(F.lit("place").alias("kind"), F.col("place").alias("name"), F.col("jurisdiction").alias("said"))
    boards = documents.read_boards(spark, put(spark, f"{path}/b.json", '[{"jurisdiction":"Alpha","name":"n","email":"a@b"}]')).select(F.lit("board").alias("kind"), F.col("jurisdiction").alias("name"), F.col("email").alias("said"))
    return tickers.unionByName(places).unionByName(boards)


@query(values("name, sha256", "('f', 'ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad')"))
def digest_fixture(spark, sf_dir):
    return documents.file_digests(spark, put(spark, f"{_fresh(spark)}/f", "abc"))


@query(values("mode, ndcg", "('lexical', 0.4::DOUBLE)", "('hybrid', 0.6)"))
def history_fixture(spark, sf_dir):
    """Appended rows; the last well-formed one of each mode counts."""
    path = _fresh(spark)
    for ord, (mode, ndcg) in enumerate((("lexical", 0.5), ("hybrid", 0.6), (None, 1.0), ("lexical", 0.4))):
        documents.append_history(spark.createDataFrame([(mode, ndcg, ord)], "mode string, ndcg double, ord int"), path)
    return evaluation.latest_by_mode(spark.read.schema("mode string, ndcg double, ord int").json(path))


@query("""WITH e AS (SELECT user_id, min(floor(epoch(ts))) AS first FROM events GROUP BY user_id), h AS (SELECT floor((min(floor(epoch(ts))) + max(floor(epoch(ts)))) / 2) AS t FROM events)
SELECT * FROM (SELECT '1' AS run, count(*) FILTER (first < t) AS rows, 1 AS turn FROM e, h UNION ALL SELECT '1', count(*) FILTER (first < t), 2 FROM e, h UNION ALL SELECT '2', count(*) FILTER (first >= t), 3 FROM e, h
UNION ALL SELECT 'all', count(*), 4 FROM e)""")
def lane_runs(spark, sf_dir):
    """A lane of the users seen up to the middle of the events, run twice, then of all; each run reports new users only, and together they hold each once."""
    events, path = table(spark, sf_dir, "events"), _fresh(spark)
    events = events.select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    middle = events.agg(F.floor((F.min("at") + F.max("at")) / 2).alias("t"))
    early = events.crossJoin(F.broadcast(middle)).where("at < t").select("user_id")  # one row
    keys = {"users": ["user_id"]}
    made = [lanes.refresh(spark, {"users": lambda s, day, r=rows: r}, "2024-01-01", path, run, keys)[0] for run, rows in (("1", early), ("1", early), ("2", events.select("user_id")))]
    turns = spark.createDataFrame([(r["run"], r["rows"], i) for i, r in enumerate(made, 1)], "run string, rows long, turn int")
    held = lanes.lane_rows(spark, path, "users", f"user_id {dict(events.dtypes)['user_id']}")
    return turns.unionByName(held.agg(F.lit("all").alias("run"), F.count("*").alias("rows"), F.lit(4).alias("turn")))


@query(values("lane, status, rows, error", "('a', 'ok', 1::BIGINT, NULL)", "('b', 'skipped', 0, NULL)", "('c', 'failed', 0, 'feed is down')", "('d', 'ok', 0, NULL)"))
def lanes_fixture(spark, sf_dir):
    def broken(s, day):
        raise RuntimeError("feed is down")

    steps = {"a": lambda s, day: s.createDataFrame([(day,)], "d string"), "b": lambda s, day: None, "c": broken, "d": lambda s, day: s.createDataFrame([], "d string")}
    made = lanes.refresh(spark, steps, lanes.since({"created_at": "2024-05-06T00:00:00"}), _fresh(spark))
    return spark.createDataFrame([(r["lane"], r["status"], r["rows"], r["error"]) for r in made], "lane string, status string, rows long, error string")


@query(values("name, statuses, n", "('outcomes', 'followed_up=1,quiet=1,too_recent=2', 4::BIGINT)", "('grid', 'misses=3', 1)", "('shells', '', 3)"))
def lane_artifacts_fixture(spark, sf_dir):
    """The artefacts of three lanes, written and read again."""
    path = _fresh(spark)
    docs = spark.createDataFrame(fx.OUTCOME_DOCS, "id string, text string, jurisdiction string, date string").withColumn("deep_link", F.lit(""))
    promises = spark.createDataFrame(fx.PROMISES, "promise_id string, jurisdiction string, date string, quote string")
    terms = spark.createDataFrame([("p1", ["Acme Corp"])], "promise_id string, terms array<string>")
    from ..operators import joins
    from ..sources import parsers

    queue = parsers.miso_queue(spark.createDataFrame([(fx.MISO,)], "json string")).unionByName(parsers.spp_queue(spark.createDataFrame([(fx.SPP,)], "csv string")))
    mapping = spark.createDataFrame([("Polk, IA", "Polk County, IA")], "place string, jurisdiction string")
    shells = spark.createDataFrame(fx.SHELL_DOCS, "id string, text string, source_type string, jurisdiction string, date string, deep_link string")
    made = (
        lanes.outcomes_artifact(analytics.outcomes(promises, docs, terms), f"{path}/outcomes"),
        lanes.grid_artifact(*joins.join_jurisdictions(queue, mapping), ["miso", "spp"], f"{path}/grid"),
        lanes.rows_artifact(analytics.mine_shell_candidates(shells), f"{path}/shells"),
    )
    parts = [spark.read.json(f"{p}/summary").select(F.lit(p.rsplit("/", 1)[1]).alias("name"), F.coalesce("said", F.lit("")).alias("statuses"), "n") for p in made]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _streamed(spark, sf_dir, df, mode: str):
    """What a stream over all of a table leaves in its versioned sink."""
    path = _fresh(spark)
    streams.versioned_sink(df, f"{path}/out", f"{path}/checkpoint", mode).awaitTermination()
    return streams.sink_rows(spark, f"{path}/out", mode)


def _events(spark, sf_dir):
    at = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(at).schema).parquet(at + "*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, CAST(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    rows = streams.windowed_counts(_events(spark, sf_dir), ["event_type"], window="1 day")
    return _streamed(spark, sf_dir, rows, "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 2).alias("value"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS accession FROM events")
def stream_new_entries(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("accession"), "ts")
    return _streamed(spark, sf_dir, streams.new_entries(rows), "append").select("accession")


@query("""WITH c AS (SELECT event_type AS video, epoch_us(ts) AS us, repeat('so ', (1 + user_id % 4)::INT) || (user_id % 2) AS text FROM events),
l AS (SELECT *, lag(text) OVER (PARTITION BY video ORDER BY us, text) AS last FROM c WHERE us < (SELECT max(us) // 1000 * 1000 FROM c) - 3600000000),
s AS (SELECT video, us, CASE WHEN last IS NULL THEN text WHEN starts_with(text, last) THEN trim(substr(text, length(last) + 1), ' ') WHEN ends_with(last, text) THEN '' ELSE text END AS text FROM l)
SELECT * FROM s WHERE text <> ''""")
def stream_rollups(spark, sf_dir):
    """Events as cues; what the watermark has passed is given out, each cue without what the one before said."""
    text = F.concat(F.repeat(F.lit("so "), (1 + F.col("user_id") % 4).cast("int")), (F.col("user_id") % 2).cast("string"))
    cues = _events(spark, sf_dir).select(F.col("event_type").alias("video"), "ts", text.alias("text"))
    return _streamed(spark, sf_dir, streams.without_rollups(cues, "1 hour"), "append").select("video", F.col("at").alias("us"), "text")


@query("SELECT event_type AS video, CAST(floor(epoch(ts) / 75) * 75 AS BIGINT) AS at, count(*) AS n FROM events GROUP BY ALL")
def stream_captions(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("video"), "ts", F.col("event_id").cast("string").alias("text"))
    out = _streamed(spark, sf_dir, streams.tumbling_captions(rows), "complete")
    return out.select("video", F.unix_timestamp("start").alias("at"), F.size(F.split("text", " ")).cast("long").alias("n"))


@query("SELECT event_type, CAST(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 40")
def stream_over_limit(spark, sf_dir):
    counts = _streamed(spark, sf_dir, streams.windowed_counts(_events(spark, sf_dir), ["event_type"], window="1 day"), "complete")
    return streams.over_limit(counts, 40).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"{BASE}, {bm25_sql()} SELECT sc.id, score FROM sc JOIN docs USING (id) WHERE source_type = 'en' ORDER BY score DESC, sc.id LIMIT 12")
def cli_search(spark, sf_dir):
    rows = cli.found(built(spark, sf_dir), ASKED, 12, "OR", False, "en")
    return rows.select("id", F.round("score", DIGITS).alias("score"))


@query(f"{BASE}, {bm25_sql("('that', 1), ('with', 1), ('from', 1)")} SELECT id, score, 'strasse' AS word, 'power' AS kind, 1 AS n_claims FROM sc ORDER BY score DESC, id LIMIT 12")
def sql_surface(spark, sf_dir):
    sql.register(spark, built(spark, sf_dir))
    best = f"SELECT id, round(sum(bm25), {DIGITS}) AS score FROM hits WHERE term IN ('that', 'with', 'from') GROUP BY id ORDER BY score DESC, id LIMIT 12"
    return spark.sql(f"SELECT id, score, analyze(concat('Stra\u00dfe ', id))[0] AS word, q.kind, size(claims(id)) AS n_claims FROM ({best}) b, LATERAL quantities(concat('300 MW at ', id)) q")
