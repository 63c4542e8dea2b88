"""Dimension, anti and as-of joins that report their misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, given
from .tables import small

ACCESSION = r"^\d{10}-\d{2}-\d{6}$"
FORMS = ("8-K", "10-K", "10-Q")
#: A dimension is broadcast up to this many rows, which are counted first.
BROADCAST_ROWS = 100_000


def join_jurisdictions(rows: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows with the jurisdiction of exactly "county, state" in mapping (place, jurisdiction), and the others."""
    key = F.concat(F.coalesce("county", F.lit("")), F.lit(", "), F.coalesce("state", F.lit("")))
    dim = small(mapping.select(F.col("place").alias("__place"), F.col("jurisdiction").alias("__jurisdiction")), BROADCAST_ROWS)
    joined = rows.withColumn("__key", key).join(dim, F.col("__key") == F.col("__place"), "left")
    own = [c for c in rows.columns if c != "jurisdiction"]
    hits = joined.where("__jurisdiction is not null").select(*own, F.col("__jurisdiction").alias("jurisdiction"))
    return hits, joined.where("__jurisdiction is null").select(*rows.columns)


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def pull_jurisdictions(rows: DataFrame, mapping: DataFrame, key: str = "permit_id", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    return join_jurisdictions(first_by(rows, [key], [order]), mapping)


def corpus_accessions(docs: DataFrame) -> DataFrame:
    """accession: the part of each filing's id that has an accession number's form."""
    parts = F.split("id", ":")
    found = F.get(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p.rlike(ACCESSION)), F.lit(0))
    return docs.where((F.size(parts) >= 3) & (parts[0] == "edgar")).select(found.alias("accession")).where("accession is not null").distinct()


def new_filings(entries: DataFrame, known: DataFrame, since: str, forms=FORMS, order: str = "ord") -> DataFrame:
    """Entries of these forms since a day whose accession is neither known nor earlier in entries, oldest first."""
    rows = entries.where(given(F.col("accession")).isNotNull() & F.col("form").isin(*forms) & (F.coalesce("filing_date", F.lit("")) >= since))
    rows = first_by(rows.join(known.select("accession"), "accession", "left_anti"), ["accession"], [order])
    return rows.orderBy("filing_date", order)


def novel_candidates(hits: DataFrame, known: DataFrame, query: str, forms: list[str], window: str, order: str = "ord") -> DataFrame:
    """Full-text hits that the corpus lacks, each accession once, with where they come from."""
    rows = first_by(hits.join(known.select("accession"), "accession", "left_anti"), ["accession"], [order])
    source = F.struct(F.lit(query).alias("query"), F.array(*(F.lit(f) for f in forms)).alias("forms"), F.lit(window).alias("window"))
    return rows.withColumn("provenance", source)


def time_bucket(time: str, kind: str):
    """A coarse part of a time column: days of timestamps and dates, months of ISO text, 86,400 of numbers."""
    if kind.startswith(("timestamp", "date")):
        return F.to_date(time).cast("string")
    if kind == "string":
        return F.substring(time, 1, 7)
    return F.floor(F.col(time) / 86_400)


def carried(rows: DataFrame, by: list[str], bucket: str, order: str, value: str, name: str) -> DataFrame:
    """rows with name: the last value, not null, of their key's earlier buckets.

    Each bucket ends in one row, and only these rows of a key are put in order, so a key
    with very many rows is as many tasks as it has buckets.
    """
    ends = rows.groupBy(*by, bucket).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__end"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(ends.select(*by, bucket, F.last("__end", ignorenulls=True).over(before).alias(name)), [*by, bucket])


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key at or before its time, null without one; null keys and times have none.

    Both sides are one stream, so the join is a sort by key and time and a window, linear in
    the rows, where a join by inequality would pair each with all before it. The windows are
    of a key's time bucket, and the last value is carried from bucket to bucket.
    """
    kind = right.schema[right_time].dataType.simpleString()
    a = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(F.col(by), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v")).where(F.col(by).isNotNull() & F.col("__t").isNotNull())
    usable = F.col(by).isNotNull() & F.col("__t").isNotNull()
    stream = a.where(usable).unionByName(b, allowMissingColumns=True).withColumn("__bucket", time_bucket("__t", kind))
    stream = carried(stream, [by], "__bucket", "__t", "__v", "__before")
    w = Window.partitionBy(by, "__bucket").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = stream.withColumn("__last", F.coalesce(F.last("__v", ignorenulls=True).over(w), "__before")).where("__side = 1").select(*left.columns, F.col("__last").alias(f"asof_{value}"))
    return rows.unionByName(a.where(~usable).select(*left.columns, F.col("__v").alias(f"asof_{value}")))


def newest_alive(docs: DataFrame, alive: DataFrame, order: str = "ord") -> DataFrame:
    """jurisdiction, video_id: the meeting video still online with the latest day; the first of equal days."""
    parts = F.split("id", ":")
    rows = docs.where((F.col("source_type") == "county_meeting") & given(F.col("jurisdiction")).isNotNull() & (F.size(parts) >= 3) & (parts[0] == "yt"))
    rows = rows.withColumn("video_id", parts[1]).join(alive.select("video_id"), "video_id", "left_semi")
    return first_by(rows.withColumn("__d", F.coalesce("date", F.lit(""))), ["jurisdiction"], [F.desc("__d"), order]).select("jurisdiction", "video_id")


def cik_for_ticker(tickers: DataFrame, mapping: DataFrame, order: str = "ord") -> DataFrame:
    """ticker, cik of ten digits by mapping (ticker, cik_str), whatever the case, with - for a dot."""
    known = first_by(mapping.select(F.upper("ticker").alias("__t"), F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik"), order), ["__t"], [order]).drop(order)
    return tickers.join(small(known, BROADCAST_ROWS), F.replace(F.upper("ticker"), F.lit("."), F.lit("-")) == F.col("__t"), "left").drop("__t")


def raw_document_name(primary):
    """The file itself of a document that may be named by a rendered copy in a folder."""
    return F.substring_index(primary, "/", -1)


def county_queries(mapping: DataFrame) -> DataFrame:
    """county, state of the places that end in a state of two letters."""
    m = F.regexp_extract("place", r"^(.+), ([^,]{2})$", 1), F.regexp_extract("place", r"^(.+), ([^,]{2})$", 2)
    return mapping.select(m[0].alias("county"), m[1].alias("state")).where("county <> ''").distinct()


def require(column: str, where: str):
    """The column, or an error that names it."""
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{where}: {column} is required"))).otherwise(F.col(column))


def slugs(jurisdiction):
    """Candidate names of a county's or city's site."""
    name = F.lower(F.trim(F.substring_index(jurisdiction, ",", 1)))
    flat = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    cut = F.when(name.rlike(" (county|parish)$"), flat(F.regexp_replace(name, " (county|parish)$", "")))
    return F.filter(F.array_compact(F.array(cut, flat(name))), lambda s: s != "")


def registry_frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A dimension read by the driver as a table."""
    return spark.createDataFrame(rows, ddl)


def state_evidence(page, name, state, state_name):
    """Whether a page names the place and its state: the state's name, ", ST", or the place followed by ST."""
    flat = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    words = F.array_join(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), 0), "[^a-zA-Z0-9]{1,3}")
    near = F.call_function("rlike", page, F.concat(F.lit("(?i:"), words, F.lit(r")[\s,]{1,3}"), state, F.lit(r"\b")))
    named = (state_name != "") & F.contains(F.lower(page), state_name)
    return (clean(name) != "") & F.contains(flat(page), flat(name)) & (named | F.call_function("rlike", page, F.concat(F.lit(r",\s*"), state, F.lit(r"\b"))) | near)
