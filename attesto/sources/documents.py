"""Document sources and the corpus sink."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import given
from ..operators.ranking import global_rank
from ..operators.tables import exists

_ROW = "struct<id:string,text:string,source_type:string,venue_type:string,date:string,deep_link:string,ticker:string,jurisdiction:string,speaker:string>"


def parse_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected lines with a reason) of JSON lines.

    Blank lines are nothing. Lines that are no JSON object or lack a required field, or
    have it null, are rejected; fields that are not of the schema are ignored.
    """
    rows = lines.where(F.trim(column) != "").withColumn("doc", F.from_json(F.col(column), _ROW, {"mode": "PERMISSIVE"}))
    is_object = F.trim(F.col(column)).startswith("{") & F.try_parse_json(column).isNotNull()
    missing = F.filter(F.array(*(F.when(F.col(f"doc.{c}").isNull(), F.lit(c)) for c in schema.REQUIRED)), lambda x: x.isNotNull())
    reason = F.when(~is_object, "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("doc.*", *keep), rows.where("reason is not null").select(F.col(column).alias("line"), "reason")


def read_directory(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Documents of every .jsonl file below path; no folder, no documents. Lines that are rejected are left out.

    ordered adds ord, the place of each document by path and line, for what takes the first of repeated ids.
    """
    if not exists(spark, path):
        rows = spark.createDataFrame([], schema.DOC)
        return rows.withColumn("ord", F.lit(0).cast("long")) if ordered else rows
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    if not ordered:
        return parse_lines(lines)[0]
    # Within a file, blocks are in order of their start and lines in order of what the reader counts.
    lines = lines.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    good = parse_lines(lines, keep=("__file", "__block", "__line"))[0]
    ranked = global_rank(good, [F.col("__file"), F.col("__block"), F.col("__line")], "ord")
    return ranked.drop("__file", "__block", "__line")


def read_snapshot(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Documents of gzipped JSON lines. Such a file can't be split, so its rows are dealt out after reading."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema.DOC)
    lines = spark.read.text(path)
    return parse_lines(lines.repartition(parts) if parts else lines)[0]


def manifest(docs: DataFrame, version: str, git_sha: str = "unversioned", snapshot_sha256: str = "", created_at: str | None = None) -> dict:
    """A corpus' description; its counts come from one aggregation."""
    counts = {r.source_type: r["count"] for r in docs.groupBy("source_type").count().collect()}
    return {
        "corpus_version": version, "created_at": created_at or datetime.now(UTC).isoformat(timespec="seconds"), "doc_count": sum(counts.values()),
        "source_counts": dict(sorted(counts.items())), "git_sha": git_sha, "snapshot_sha256": snapshot_sha256,
    }


def build_corpus(docs: DataFrame, path: str, version: str, **details) -> dict | None:
    """Writes docs as gzipped JSON lines in order of id, their index and the manifest; None without documents."""
    from ..operators.index import assert_unique, build

    if not docs.limit(1).count():
        return None
    docs = assert_unique(docs)
    docs.orderBy("id").write.mode("overwrite").option("compression", "gzip").json(f"{path}/docs")
    build(docs).save(f"{path}/index")
    # Order-free digest of all rows, so that equal corpora have equal manifests: sums of the parts of each row's SHA-256.
    row = F.sha2(F.to_json(F.struct(*sorted(docs.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    digest = docs.agg(F.sha2(F.concat_ws(":", F.count("*"), *parts), 256)).first()[0]
    made = manifest(docs, version, snapshot_sha256=digest, **details)
    docs.sparkSession.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return made


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a corpus; None if there is none or it is no object."""
    try:
        found = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    except Exception:  # a missing or damaged manifest is none
        return None
    return found if isinstance(found, dict) else None


def append_history(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").json(path)


def save_store(store: DataFrame, path: str, version: str) -> None:
    """A version of an embedding store; readers follow the last pointer, which is appended when the version is complete."""
    store.write.mode("errorifexists").parquet(f"{path}/{version}")
    point_to(store.sparkSession, path, version)


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version the current one, also to go back; the pointers before stay, so a write that fails changes nothing."""
    n = spark.read.json(f"{path}/current").count() if exists(spark, f"{path}/current") else 0
    spark.createDataFrame([(version, n)], "version string, n long").coalesce(1).write.mode("append").json(f"{path}/current")


def load_store(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    from ..operators.vectors import check_store

    version = spark.read.json(f"{path}/current").orderBy(F.desc("n")).first().version
    store = spark.read.parquet(f"{path}/{version}")
    check_store(store, model, dim)
    return store


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, from 1, and value of the lines that are not blank; for files that are written by hand."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\n")).alias("at", "value")).select((F.col("at") + 1).alias("line_no"), "value")
    return rows.where(F.trim(F.regexp_replace("value", r"\s", "")) != "")


def _strict(rows: DataFrame, ddl: str, checks: list) -> DataFrame:
    """The rows of a schema; the first check that a line fails, as (condition, what is wrong), is an error that names the line."""
    rows = rows.withColumn("row", F.from_json("value", ddl))
    is_object = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    fault = F.when(~is_object, "not a JSON object")
    for bad, what in checks:
        fault = fault.when(F.coalesce(bad, F.lit(True)), what)
    guarded = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("bad row, line "), F.col("line_no").cast("string"), F.lit(": "), fault))).otherwise(F.col("row"))
    return rows.select(guarded.alias("row"), "line_no").select("row.*", F.col("line_no").cast("long").alias("ord"))


def _blank(name: str):
    return given(F.col(f"row.{name}")).isNull()


def read_judgments(spark: SparkSession, path: str, ddl=schema.JUDGMENT) -> DataFrame:
    """Strict JSON lines, with ord: a line that does not fit the schema is an error that names it."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ddl.fields)
    return _strict(numbered_lines(spark, path), fields, [(F.col(f"row.{f.name}").isNull(), f"{f.name} is missing") for f in ddl.fields])


QA_ORIGINS, REASONS = ("judgments", "owner"), ("out-of-corpus", "out-of-scope", "false-premise")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their answer documents, strict."""
    ids = F.col("row.answer_doc_ids")
    checks = [(_blank(c), f"{c} is missing or empty") for c in ("qa_id", "question", "criterion")]
    checks += [(ids.isNull() | (F.size(ids) == 0) | F.exists(ids, lambda x: x.isNull()), "answer_doc_ids must be a list of ids"), (~F.col("row.origin").isin(*QA_ORIGINS), f"origin must be one of {', '.join(QA_ORIGINS)}")]
    return _strict(numbered_lines(spark, path), "qa_id string, question string, criterion string, answer_doc_ids array<string>, origin string", checks)


def read_unanswerable(spark: SparkSession, path: str) -> DataFrame:
    """Questions that the corpus can't answer, strict."""
    checks = [(_blank(c), f"{c} is missing or empty") for c in ("qa_id", "question", "notes")]
    checks += [(~F.col("row.reason").isin(*REASONS), f"reason must be one of {', '.join(REASONS)}")]
    return _strict(numbered_lines(spark, path), "qa_id string, question string, notes string, reason string", checks)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Faithfulness labels, strict; examples are left out."""
    checks = [(_blank(c), f"{c} is missing or empty") for c in ("label_id", "question", "answer_text", "claim")]
    checks += [(F.col("row.chunk_texts").isNull(), "chunk_texts is missing"), (~F.col("row.human_verdict").isin("supported", "unsupported", "contradicted"), "human_verdict is not a verdict")]
    rows = _strict(numbered_lines(spark, path), "label_id string, question string, answer_text string, claim string, chunk_texts array<string>, human_verdict string", checks)
    return rows.where(~F.col("label_id").startswith("example-"))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Insider transactions; malformed lines are skipped."""
    return spark.read.schema(schema.TRANSACTION).option("mode", "DROPMALFORMED").json(path).where(given(F.col("ticker")).isNotNull())


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """place, jurisdiction of a JSON object from one to the other; no file, no places."""
    try:
        text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    except Exception:  # a mapping that is not there maps nothing
        text = "{}"
    rows = [(k, v) for k, v in json.loads(text).items() if isinstance(v, str)]
    return spark.createDataFrame(rows, "place string, jurisdiction string")


def read_registry(spark: SparkSession, path: str) -> dict:
    """The registry's lists, from YAML where a reader for it is installed, else from JSON; any path that Spark reads."""
    text = spark.read.text(path, wholetext=True).first().value
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """jurisdiction, name, email of a JSON list of boards; one that lacks any, or an address without @, is an error."""
    rows = spark.createDataFrame([(x,) for x in [spark.read.text(path, wholetext=True).first().value]], "value string")
    rows = rows.select(F.posexplode(F.from_json("value", "array<struct<jurisdiction:string,name:string,email:string>>")).alias("at", "b")).select("at", "b.*")
    fault = F.when(given(F.col("jurisdiction")).isNull() | given(F.col("name")).isNull(), "jurisdiction and name are required").when(F.coalesce(~F.contains("email", F.lit("@")), F.lit(True)), "email is no address")
    bad = rows.withColumn("fault", fault).where("fault is not null").orderBy("at").limit(1).collect()
    if bad:
        raise ValueError(f"board {bad[0]['at'] + 1}: {bad[0].fault}")
    return rows.select("jurisdiction", "name", "email")


def read_video_dir(spark: SparkSession, path: str, jurisdiction: str | None) -> DataFrame:
    """Files for parsers.caption_docs: each .info.json with the first .vtt of its stem; others are left out."""
    read = lambda glob: spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "value")
    info = read("*.info.json").select(F.regexp_replace("name", r"\.info\.json$", "").alias("stem"), F.from_json("value", "id string, upload_date string").alias("i"))
    info = info.where("i is not null")
    # A caption file's stem is one of the dotted prefixes of its name, so the pairing is an equality.
    parts = F.split("name", r"\.")
    stems = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    vtt = read("*.vtt").select("name", F.col("value").alias("vtt"), F.explode(stems).alias("stem"))
    first = vtt.groupBy("stem").agg(F.min_by("vtt", "name").alias("vtt"))
    rows = info.join(first, "stem")
    return rows.select(F.coalesce(given(F.col("i.id")), "stem").alias("video"), F.coalesce("i.upload_date", F.lit("")).alias("upload_date"), "vtt", F.lit(jurisdiction).alias("jurisdiction"))


SAFE_TICKER = r"^[A-Za-z0-9.\-]{1,15}$"


def fresh_prices(cache: DataFrame, now: str, days: int = 1) -> DataFrame:
    """Rows of a price cache (ticker, date, close, fetched_at) that are younger than days; unsafe names are misses."""
    return cache.where(F.col("ticker").rlike(SAFE_TICKER) & (F.to_timestamp("fetched_at") > F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days))))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of the files at a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def file_sha256(path: str) -> str:
    """Of a file of the driver's, in blocks."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
