"""Evidence analytics over documents, promises, transactions, queue rows and prices."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.extract import event_items, may_have_name, quantities, shell_names
from ..functions.text import content_tokens, count_phrases, given, head_snippet, k_grams
from ..functions.udf import in_arrow
from .joins import carried
from .tables import small, written

#: Phrases of an evasive answer.
DODGE_MARKERS = (
    "no comment", "cannot comment", "can't comment", "not at liberty", "get back to you", "take that offline", "take this offline",
    "defer to counsel", "on advice of counsel", "not prepared to answer", "decline to answer", "we'll circle back", "outside the scope of this meeting",
)
#: Titles of the items of current reports.
EVENT_ITEMS = {
    "1.01": "Entry into a Material Definitive Agreement", "1.02": "Termination of a Material Definitive Agreement", "1.03": "Bankruptcy or Receivership",
    "1.04": "Mine Safety — Shutdowns and Violations", "1.05": "Material Cybersecurity Incidents", "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.02": "Results of Operations and Financial Condition", "2.03": "Creation of a Direct Financial Obligation or Off-Balance-Sheet Arrangement",
    "2.04": "Triggering Events That Accelerate or Increase a Direct Financial Obligation", "2.05": "Costs Associated with Exit or Disposal Activities",
    "2.06": "Material Impairments", "3.01": "Notice of Delisting or Failure to Satisfy a Listing Rule", "3.02": "Unregistered Sales of Equity Securities",
    "3.03": "Material Modification to Rights of Security Holders", "4.01": "Changes in Registrant's Certifying Accountant",
    "4.02": "Non-Reliance on Previously Issued Financial Statements", "5.01": "Changes in Control of Registrant",
    "5.02": "Departure of Directors or Certain Officers; Election; Compensation", "5.03": "Amendments to Articles of Incorporation or Bylaws; Fiscal Year Change",
    "5.04": "Temporary Suspension of Trading Under Employee Benefit Plans", "5.05": "Amendments to the Code of Ethics", "5.06": "Change in Shell Company Status",
    "5.07": "Submission of Matters to a Vote of Security Holders", "5.08": "Shareholder Director Nominations", "6.01": "ABS Informational and Computational Material",
    "6.02": "Change of Servicer or Trustee", "6.03": "Change in Credit Enhancement or Other External Support", "6.04": "Failure to Make a Required Distribution",
    "6.05": "Securities Act Updating Disclosure", "6.06": "Static Pool", "7.01": "Regulation FD Disclosure", "8.01": "Other Events",
    "9.01": "Financial Statements and Exhibits",
}
QUIET_DAYS, TRAIL, SAMPLES = 90, 5, 3


def first_samples(rows: DataFrame, key: list[str], order: list, fields: list[str], n: int = SAMPLES, name: str = "samples") -> DataFrame:
    """key and an array of the fields of the first n rows of each key; the cut precedes the collecting."""
    w = Window.partitionBy(*key).orderBy(*order)
    kept = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    parts = F.array_sort(F.collect_list(F.struct("__n", *fields)))
    return kept.groupBy(*key).agg(F.transform(parts, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def marker_rates(docs: DataFrame, markers=DODGE_MARKERS, min_docs: int = 200, source_type: str | None = "county_meeting") -> DataFrame:
    """jurisdiction, docs, markers, per_1000: occurrences of the markers for each thousand documents, highest first."""
    rows = docs.where(given(F.col("jurisdiction")).isNotNull())
    rows = rows if source_type is None else rows.where(F.col("source_type") == source_type)
    rates = rows.withColumn("hits", count_phrases(F.col("text"), markers)).groupBy("jurisdiction").agg(F.count("*").alias("docs"), F.sum("hits").alias("markers"))
    rates = rates.where(F.col("docs") >= min_docs).withColumn("per_1000", F.round(F.col("markers") / F.col("docs") * 1000, 1))
    return rates.orderBy(F.desc("per_1000"), "jurisdiction")


def dodge_index(docs: DataFrame, min_docs: int = 200, order: str = "ord") -> DataFrame:
    """marker_rates with the first documents that have a marker, in input order, as sample_receipts."""
    rates = marker_rates(docs, DODGE_MARKERS, min_docs)
    hit = docs.where((F.col("source_type") == "county_meeting") & (count_phrases(F.col("text"), DODGE_MARKERS) > 0)).withColumnRenamed("id", "doc_id")
    samples = first_samples(hit, ["jurisdiction"], [order, "doc_id"], ["doc_id", "deep_link"], name="sample_receipts")
    return rates.join(samples, "jurisdiction", "left").orderBy(F.desc("per_1000"), "jurisdiction")


def net_flow(rows: DataFrame, since: str, by: str = "ticker") -> DataFrame:
    """Totals of purchases (P) and sales (S) since a day, a row for each ticker."""
    day = F.col("transaction_date")
    rows = rows.where((F.length(day) == 10) & (day >= since) & F.col("code").isin("P", "S"))
    part = lambda code, x: F.round(F.coalesce(F.sum(F.when(F.col("code") == code, F.col(x))), F.lit(0.0)), 2)
    who = lambda code: F.count_distinct(F.when(F.col("code") == code, F.coalesce("filer_name", F.lit(""))))
    out = rows.groupBy(by).agg(
        F.count("*").alias("transactions"), part("P", "value").alias("buys_value"), part("S", "value").alias("sells_value"),
        part("P", "shares").alias("buys_shares"), part("S", "shares").alias("sells_shares"),
        who("S").alias("insiders_selling"), who("P").alias("insiders_buying"), F.max(day).alias("last_transaction_date"),
    )
    return out.withColumn("net_value", F.round(F.col("buys_value") - F.col("sells_value"), 2))


def net_flow_by_month(rows: DataFrame, since: str, by: str = "ticker") -> DataFrame:
    day = F.col("transaction_date")
    rows = rows.where((F.length(day) == 10) & (day >= since) & F.col("code").isin("P", "S"))
    part = lambda code: F.round(F.coalesce(F.sum(F.when(F.col("code") == code, F.col("value"))), F.lit(0.0)), 2)
    return rows.groupBy(by, F.substring(day, 1, 7).alias("month")).agg(part("P").alias("buys_value"), part("S").alias("sells_value"))


def recent_transactions(rows: DataFrame, since: str, n: int = 10, by: str = "ticker", order: str = "ord") -> DataFrame:
    day = F.col("transaction_date")
    w = Window.partitionBy(by).orderBy(F.desc(day), order)
    return rows.where((F.length(day) == 10) & (day >= since) & F.col("code").isin("P", "S")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def quantity_rollup(rows: DataFrame, by: str, q: str = "quantities") -> DataFrame:
    """Promised megawatts, gallons a day, jobs and dollars by jurisdiction or ticker; keys without any are kept.

    Each row's array is reduced in place, so nothing is exploded.
    """
    if by not in ("jurisdiction", "ticker"):
        raise ValueError("by is jurisdiction or ticker")
    items = F.coalesce(F.col(q), F.array().cast("array<struct<kind:string,value:double,unit:string,cadence:string,raw_span:string>>"))

    def total(test):
        return F.aggregate(F.filter(items, test), F.lit(0.0), lambda s, x: s + F.coalesce(x["value"], F.lit(0.0)))

    money = lambda x: x["kind"] == "money"
    annual = lambda x: F.coalesce(x["cadence"] == "annual", F.lit(False))
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.sum(total(lambda x: x["kind"] == "power")).alias("promised_mw"), F.sum(total(lambda x: (x["kind"] == "water") & (x["unit"] == "GPD"))).alias("promised_gpd"),
        F.sum(total(lambda x: x["kind"] == "jobs")).alias("promised_jobs"), F.sum(total(lambda x: money(x) & annual(x))).alias("promised_dollars_annual"),
        F.sum(total(lambda x: money(x) & ~annual(x))).alias("promised_dollars_total"), F.count_if(F.size(items) > 0).alias("n_quantified"),
    )


def queue_rollup(rows: DataFrame, by: str = "jurisdiction") -> DataFrame:
    """n, queued and withdrawn megawatts, never in one sum."""
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("mw"))), F.lit(0.0))
    return rows.groupBy(by).agg(F.count("*").alias("n"), part(~F.col("withdrawn")).alias("queued_mw"), part(F.col("withdrawn")).alias("withdrawn_mw"))


def promise_list(promises: DataFrame, k: int, order: str = "ord", **equal) -> tuple[DataFrame, DataFrame]:
    """The k newest promises with these values, and the count of each category among all with them."""
    rows = reduce(lambda d, x: d.where(F.col(x[0]) == x[1]) if x[1] is not None else d, equal.items(), promises)
    return rows.orderBy(F.desc(F.coalesce("date", F.lit(""))), order).limit(k), rows.groupBy("category").count()


def build_events(docs: DataFrame) -> DataFrame:
    """Filings with item headers: doc_id, ticker, date, items, labels, newest first; a code without a title is an error."""
    titles = F.create_map(*(F.lit(x) for kv in EVENT_ITEMS.items() for x in kv))
    rows = docs.where(F.col("source_type") == "filing").withColumn("items", event_items(F.col("text"))).where(F.size("items") > 0)
    unknown = F.filter("items", lambda c: ~c.isin(list(EVENT_ITEMS)))
    guarded = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown item codes "), F.array_join(unknown, ", ")))).otherwise(F.col("items"))
    rows = rows.select(F.col("id").alias("doc_id"), "ticker", "date", guarded.alias("items"), "deep_link")
    return rows.withColumn("labels", F.transform("items", lambda c: titles[c])).orderBy(F.desc(F.coalesce("date", F.lit(""))), "doc_id")


def mine_names(docs: DataFrame) -> DataFrame:
    """name, n_docs, first_seen, jurisdictions of the project and entity names in meetings, most frequent first."""
    rows = docs.where((F.col("source_type") == "county_meeting") & may_have_name(F.col("text"))).select("id", "date", "jurisdiction", "deep_link", F.explode(shell_names(F.col("text"))).alias("name"))
    return rows.groupBy("name").agg(
        F.count_distinct("id").alias("n_docs"), F.min("date").alias("first_seen"), F.sort_array(F.collect_set(given(F.col("jurisdiction")))).alias("jurisdictions")
    ).orderBy(F.desc("n_docs"), "name")


def mine_shell_candidates(docs: DataFrame) -> DataFrame:
    """mine_names with the first documents of each name, by date and id."""
    rows = docs.where((F.col("source_type") == "county_meeting") & may_have_name(F.col("text"))).select(F.col("id").alias("doc_id"), "date", "deep_link", F.explode(shell_names(F.col("text"))).alias("name"))
    samples = first_samples(rows.dropDuplicates(["name", "doc_id"]), ["name"], ["date", "doc_id"], ["doc_id", "deep_link"], name="sample_receipts")
    return mine_names(docs).join(samples, "name").orderBy(F.desc("n_docs"), "name")


def bounded(term):
    """A pattern for the term as whole words."""
    return F.concat(F.lit(r"(?U)\b\Q"), term, F.lit(r"\E\b"))


#: Characters of all terms that one automaton holds; more terms are several automata and as many passes.
AUTOMATON_CHARS = 4_000_000


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc")


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    return (at > 0 and _in_word(text[at - 1])) != (at < len(text) and _in_word(text[at]))


def _found_terms(terms: list[str]):
    """(id, term) of the texts of a batch: one pass of an automaton of all terms, each hit checked for the words' edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            machine.add_word(term, (i, len(term)))
        machine.make_automaton()
        for batch in batches:
            ids, found = [], []
            for place, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    held = {i for end, (i, n) in machine.iter(text) if _edge(text, end + 1 - n) and _edge(text, end + 1)}
                    ids += [place] * len(held)
                    found += sorted(held)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array([terms[i] for i in found], pa.string())], ["id", "term"])

    return run


def term_hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term) where a text holds a term as whole words; terms is one column, term, of fixed names.

    All terms are one automaton, which goes to the workers and passes over each text once, whatever the number of terms;
    no text is shuffled. Terms of more than AUTOMATON_CHARS characters are parted by their hash, a pass for each part, so
    what goes through the driver is bounded. Null and empty terms are in no text; an id that repeats is one document.
    """
    known = written(terms.select("term").where("term <> ''").distinct())
    parts = max(1, -(-(known.agg(F.sum(F.length("term"))).first()[0] or 0) // AUTOMATON_CHARS))
    texts = docs.select("id", "text")
    schema = f"id {dict(texts.dtypes)['id']}, term string"
    hits = []
    for part in range(parts):
        mine = sorted(r.term for r in known.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect())
        if mine:
            hits.append(in_arrow(texts, _found_terms(mine), schema))
    return reduce(DataFrame.unionByName, hits).distinct() if hits else docs.sparkSession.createDataFrame([], schema)


def link_evidence(candidates: DataFrame, docs: DataFrame, company_terms: DataFrame) -> DataFrame:
    """shell, ticker, n_cooccurrence_docs, receipts: documents with a candidate's name and one of a company's terms."""
    shells = term_hits(docs, candidates.select(F.col("name").alias("term"))).withColumnRenamed("term", "shell")
    companies = term_hits(docs, company_terms.select("term")).join(company_terms, "term").select("id", "ticker").distinct()
    both = shells.join(companies, "id").join(docs.select("id", "date", "deep_link"), "id").withColumnRenamed("id", "doc_id")
    counts = both.groupBy("shell", "ticker").agg(F.count("*").alias("n_cooccurrence_docs"))
    receipts = first_samples(both, ["shell", "ticker"], ["date", "doc_id"], ["doc_id", "deep_link"], name="receipts")
    return counts.join(receipts, ["shell", "ticker"]).orderBy(F.desc("n_cooccurrence_docs"), "shell", "ticker")


def checked_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Curated links (shell, ticker, confidence, receipts); any fault in any of them is an error."""
    rows = links.withColumn("doc_id", F.explode_outer("receipts")).join(docs.select(F.col("id").alias("doc_id"), F.col("text").alias("__text")), "doc_id", "left")
    fault = (
        F.when(given(F.col("shell")).isNull() | given(F.col("ticker")).isNull(), "shell and ticker are required")
        .when(F.coalesce(~F.col("confidence").isin("confirmed", "reported"), F.lit(True)), "confidence must be confirmed or reported")
        .when(F.col("doc_id").isNull(), "a link needs a receipt")
        .when(F.col("__text").isNull(), "receipt is not in the corpus")
        .when(~F.contains("__text", "shell"), "receipt does not hold the name")
    )
    bad = rows.withColumn("fault", fault).where("fault is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].shell} -> {bad[0].ticker}: {bad[0].fault}")
    return links


def corpus_counts(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("docs"), F.count_distinct(given(F.col("jurisdiction"))).alias("jurisdictions"), F.count_distinct(given(F.col("ticker"))).alias("tickers"))


def source_counts(docs: DataFrame, by: str = "source_type") -> DataFrame:
    return docs.groupBy(by).agg(F.count("*").alias("n"))


def ticker_counts(registry: DataFrame, docs: DataFrame) -> DataFrame:
    """Every ticker of the registry (symbol, sector) with its documents and the day of the last; none counts 0."""
    counts = docs.where(given(F.col("ticker")).isNotNull()).groupBy(F.col("ticker").alias("symbol")).agg(F.count("*").alias("docs"), F.max("date").alias("last_receipt"))
    return registry.join(counts, "symbol", "left").select("symbol", "sector", F.coalesce("docs", F.lit(0)).alias("docs"), "last_receipt")


def by_sector(tickers: DataFrame) -> DataFrame:
    return tickers.groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("symbol", "docs", "last_receipt"))).alias("tickers")).orderBy("sector")


def mention_returns(docs: DataFrame, prices: DataFrame, since: str) -> DataFrame:
    """Each mention of a ticker with its close as of the day, the latest, the peak since, and both returns.

    Prices and mentions are one stream by ticker and month. Within a month, the last close
    up to a mention and the greatest from it on are running windows; what earlier and later
    months add is carried from one row a month, so a ticker with very many rows is many
    tasks. Mentions before the series and series of one price give no row.
    """
    hits = docs.where((given(F.col("ticker")).isNotNull()) & (given(F.col("date")) >= since)).select("ticker", "date", F.col("id").alias("doc_id"))
    points = prices.select("ticker", "date", F.lit(None).cast("string").alias("doc_id"), "close")
    stream = points.unionByName(hits.withColumn("close", F.lit(None).cast("double"))).withColumn("month", F.substring("date", 1, 7))
    day = F.when(F.col("close").isNotNull(), F.col("date"))
    months = stream.groupBy("ticker", "month").agg(F.max_by("close", day).alias("end"), F.max("close").alias("top"), F.max(day).alias("last"), F.count("close").alias("n"))
    order = Window.partitionBy("ticker").orderBy("month")
    later = Window.partitionBy("ticker").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("ticker")
    months = months.select(
        "ticker", "month", F.last("end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.max("top").over(later).alias("after"),
        F.max_by("end", "last").over(whole).alias("latest"), F.sum("n").over(whole).alias("n"),
    )
    back = Window.partitionBy("ticker", "month").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # From the last day backwards, so that this frame too only ever grows; to the end of the partition it would be taken anew for each row.
    ahead = Window.partitionBy("ticker", "month").orderBy(F.desc("date")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = stream.withColumns({"own": F.max_by("close", day).over(back), "top": F.max("close").over(ahead)}).where("doc_id is not null").join(months, ["ticker", "month"])
    rows = rows.select("ticker", "doc_id", "date", "latest", "n", F.coalesce("own", "before").alias("entry"), F.greatest("top", "after").alias("peak")).where("n >= 2 and entry > 0")
    rows = rows.withColumn("peak", F.coalesce("peak", "latest"))
    mentions = rows.groupBy("ticker").agg((F.count("*") - 1).alias("co_mentions"))
    change = lambda x: F.round((F.col(x) / F.col("entry") - 1) * 100, 2)
    return rows.join(mentions, "ticker").select(
        "ticker", "doc_id", "date", F.round("entry", 2).alias("entry_close"), F.round("latest", 2).alias("latest_close"), change("latest").alias("return_pct"), change("peak").alias("peak_pct"), "co_mentions",
    )


def mention_rows(docs: DataFrame, prices: DataFrame, since: str) -> DataFrame:
    rows = mention_returns(docs, prices, since).join(docs.select(F.col("id").alias("doc_id"), "deep_link", "venue_type", "source_type", head_snippet(F.col("text")).alias("snippet")), "doc_id")
    return rows.orderBy(F.desc("return_pct"), "doc_id")


def significant_moves(prices: DataFrame, threshold_pct: float = 5.0) -> DataFrame:
    """ticker, date, return_pct of the days whose close moved by threshold_pct or more; none after a close of 0. Prices have a row a day."""
    rows = carried(prices.withColumn("__month", F.substring("date", 1, 7)), ["ticker"], "__month", "date", "close", "__before")
    prior = F.coalesce(F.lag("close").over(Window.partitionBy("ticker", "__month").orderBy("date")), F.col("__before"))
    rows = rows.withColumn("prior", prior).where("prior is not null and prior <> 0")
    rows = rows.withColumn("return_pct", (F.col("close") - F.col("prior")) / F.col("prior") * 100)
    return rows.where(F.abs("return_pct") >= threshold_pct).select("ticker", "date", "return_pct")


def trailing(prices: DataFrame, days: int) -> DataFrame:
    """The last days of each series, counted back from its own last day; all of it for 0 or less."""
    if days <= 0:
        return prices
    last = prices.groupBy("ticker").agg(F.max(F.to_date("date")).alias("__last"))
    return prices.join(last, "ticker").where(F.to_date("date") >= F.date_sub("__last", days - 1)).select(*prices.columns)


def nearby_receipts(moves: DataFrame, docs: DataFrame, window_days: int = 7, bucket: int | None = None) -> DataFrame:
    """Each move with an array of its ticker's documents of the days up to it; empty where there are none.

    A range join by equality: days are cut into buckets as long as the window, so that a
    document can only meet moves of its own bucket or the next.
    """
    size = bucket or window_days + 1
    day = lambda c: F.datediff(F.try_to_date(c), F.lit("1970-01-01").cast("date"))
    d = docs.select("ticker", F.col("id").alias("doc_id"), F.col("date").alias("doc_date"), "source_type", "venue_type", "deep_link", head_snippet(F.col("text")).alias("snippet"))
    d = d.withColumn("__day", day(F.col("doc_date"))).where("__day is not null").withColumn("__b", F.explode(F.array(F.floor(F.col("__day") / size), F.floor(F.col("__day") / size) + 1)))
    m = moves.withColumn("__move", day(F.col("date"))).withColumn("__b", F.floor(F.col("__move") / size))
    near = m.join(d, ["ticker", "__b"]).where((F.col("__move") - F.col("__day")).between(0, window_days))
    fields = ["doc_id", "doc_date", "source_type", "venue_type", "deep_link", "snippet"]
    found = near.groupBy("ticker", "date").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("receipts"))
    empty = F.array().cast(found.schema["receipts"].dataType)
    return moves.join(found, ["ticker", "date"], "left").withColumn("receipts", F.coalesce("receipts", empty))


#: Words of promises up to which they are broadcast.
BROADCAST_WORDS = 200_000


def _rarest(p: DataFrame, d: DataFrame) -> DataFrame:
    """promise_id and t: of each of a promise's grams whose words are all held by documents, the word that the fewest hold."""
    words = p.select("promise_id", F.posexplode("grams").alias("at", "g")).select("promise_id", "at", F.size(F.array_distinct("g")).alias("need"), F.explode(F.array_distinct("g")).alias("t"))
    known = small(words.select("t").distinct(), BROADCAST_WORDS)
    df = d.select(F.explode("held").alias("t")).join(known, "t", "left_semi").groupBy("t").agg(F.count("*").alias("df"))
    best = words.join(df, "t").groupBy("promise_id", "at", "need").agg(F.min(F.struct("df", "t")).alias("x"), F.count("*").alias("n"))
    return best.where("n = need").select("promise_id", F.col("x.t").alias("t")).distinct()


def outcomes(promises: DataFrame, docs: DataFrame, entity_terms: DataFrame | None = None) -> DataFrame:
    """promise_id, status, trail: later documents of a promise's jurisdiction that take it up, five at most by date.

    A document takes it up by an equal quantity, else by one of the promise's entity
    terms (promise_id, terms array), else by four of its words in order with at most short
    ones between. Without a trail the promise is quiet if a document came over QUIET_DAYS
    later, else too recent.

    Pairs come from an equality on jurisdiction and a key that any of the three needs in
    the document: the quantity, the term's first word, of the four words the one that the
    fewest documents hold; runs with a word that none holds ask for nothing. A jurisdiction's last day is an aggregate, so no promise meets all its documents.
    """
    p = promises.select("promise_id", "jurisdiction", F.coalesce("date", F.lit("")).alias("promise_date"), F.coalesce("quote", F.lit("")).alias("quote"))
    p = p.withColumn("promised", F.transform(quantities(F.col("quote")), lambda q: F.struct(q["kind"].alias("kind"), q["value"].alias("value"))))
    p = p.withColumn("grams", F.array_distinct(k_grams(content_tokens(F.col("quote")))))
    if entity_terms is not None:
        p = p.join(entity_terms, "promise_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    else:
        p = p.withColumn("terms", F.array().cast("array<string>"))
    read = lambda d: d.withColumn("found", quantities(F.col("text"))).withColumn("held", F.array_distinct(content_tokens(F.col("text"))))
    plain = docs.where(given(F.col("jurisdiction")).isNotNull()).select("jurisdiction", F.col("id").alias("doc_id"), "date", "deep_link", "text")
    d = read(plain)
    words = lambda x: F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), 0)
    amount = lambda q: F.concat_ws(":", F.lit("q"), q["kind"], q["value"])
    tagged = lambda tag, items: F.transform(items, lambda x: F.concat(F.lit(tag), x))
    first_word = lambda t: F.coalesce(F.get(words(t), F.lit(0)), F.lit(""))
    asked = F.concat(F.transform("promised", amount), tagged("w", F.transform("terms", first_word)))
    firsts = () if entity_terms is None else (tagged("w", words(F.col("text"))),)
    has = F.concat(F.transform("found", amount), *firsts, tagged("t", F.col("held")))
    due = p.where("promise_date <> ''")
    p_keys = due.select("promise_id", "jurisdiction", "promise_date", F.explode(F.array_distinct(asked)).alias("key"))
    p_keys = p_keys.unionByName(_rarest(due, d).join(due.select("promise_id", "jurisdiction", "promise_date"), "promise_id").select("promise_id", "jurisdiction", "promise_date", F.concat(F.lit("t"), "t").alias("key")))
    p_keys = written(p_keys)
    asked_for = small(p_keys.select("jurisdiction", "key").distinct(), BROADCAST_WORDS)  # so that no other word of a document is dealt
    d_keys = d.select("jurisdiction", "doc_id", "date", F.explode(F.array_distinct(has)).alias("key")).join(asked_for, ["jurisdiction", "key"], "left_semi")
    meet = p_keys.join(d_keys, ["jurisdiction", "key"]).where(F.col("date") > F.col("promise_date")).select("promise_id", "doc_id").distinct()
    meet = written(meet)
    met = read(plain.join(meet.select("doc_id").distinct(), "doc_id", "left_semi"))  # only these are read again
    pairs = meet.join(p.drop("jurisdiction"), "promise_id").join(met, "doc_id")
    same = F.get(F.filter("found", lambda q: F.array_contains("promised", F.struct(q["kind"].alias("kind"), q["value"].alias("value")))), F.lit(0))
    by_term = F.get(F.filter("terms", lambda t: (t != "") & F.call_function("rlike", F.col("text"), bounded(t))), F.lit(0))
    possible = F.filter("grams", lambda g: F.size(F.array_except(g, F.col("held"))) == 0)
    # Only pairs without another signal whose document holds all words of a gram have their words' places compared.
    unsure = same.isNull() & by_term.isNull() & (F.size(possible) > 0)
    phrase = F.when(unsure, extract.phrase_spans(F.when(unsure, F.col("text")), F.when(unsure, possible)))
    signal = F.when(same.isNotNull(), "quantity").when(by_term.isNotNull(), "entity").when(phrase.isNotNull(), "phrase")
    span = F.coalesce(same["raw_span"], by_term, phrase)
    signals = pairs.select("promise_id", "promise_date", "doc_id", "date", "deep_link", signal.alias("signal"), span.alias("matched_span"))
    ends = d.groupBy("jurisdiction").agg(F.max("date").alias("end"))
    last = p.join(ends, "jurisdiction", "left").select("promise_id", "promise_date", F.when((F.col("end") > F.col("promise_date")) & (F.col("promise_date") != ""), F.col("end")).alias("last"))
    trail = first_samples(signals.where("signal is not null"), ["promise_id"], ["date", "doc_id"], ["doc_id", "date", "signal", "matched_span", "deep_link"], TRAIL, "trail")
    gap = F.datediff(F.try_to_date(F.substring("last", 1, 10)), F.try_to_date(F.substring("promise_date", 1, 10)))
    status = F.when(F.col("trail").isNotNull(), "followed_up").when(gap > QUIET_DAYS, "quiet").otherwise("too_recent")
    rows = promises.select("promise_id").join(last, "promise_id", "left").join(trail, "promise_id", "left").withColumn("status", status)
    return rows.select("promise_id", "status", F.coalesce("trail", F.array().cast(trail.schema["trail"].dataType)).alias("trail"))


def with_outcomes(promises: DataFrame, found: DataFrame) -> DataFrame:
    """promises with status and trail of their outcomes; null where there is none."""
    return promises.join(found.select("promise_id", "status", "trail"), "promise_id", "left")


def later_documents(promises: DataFrame, docs: DataFrame, n: int = TRAIL) -> DataFrame:
    """promise_id, doc_id, place: the first n documents of the promise's jurisdiction after its day, by day and id.

    No promise meets all its documents: a day's first n documents and the days that follow
    a day are found once each, so a promise joins the few days that its n documents can be of.
    """
    d = docs.where(given(F.col("jurisdiction")).isNotNull() & given(F.col("date")).isNotNull())
    first = F.row_number().over(Window.partitionBy("jurisdiction", "date").orderBy("id"))
    d = d.select("jurisdiction", "date", F.col("id").alias("doc_id"), first.alias("__n")).where(F.col("__n") <= n)
    days = d.select("jurisdiction", "date").unionByName(promises.where("date is not null").select("jurisdiction", "date")).distinct()
    held = days.join(d.groupBy("jurisdiction", "date").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")), ["jurisdiction", "date"], "left")
    # Every day that has documents brings at least one, so the n first after a day are of the next n such days.
    held = held.withColumn("__day", F.count(F.col("ids")).over(Window.partitionBy("jurisdiction").orderBy("date")))
    ends = promises.join(held.select("jurisdiction", "date", "__day"), ["jurisdiction", "date"]).select("promise_id", "jurisdiction", F.explode(F.sequence(F.col("__day") + 1, F.col("__day") + n)).alias("__day"))
    rows = ends.join(held.where("ids is not null"), ["jurisdiction", "__day"]).select("promise_id", "date", F.explode("ids").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("promise_id").orderBy("date", "doc_id"))
    return rows.withColumn("place", place).where(F.col("place") <= n).select("promise_id", "doc_id", "place")


def outcome_summary(promises: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of each status, by jurisdiction and (jurisdiction null, everyone true) in all."""
    rows = promises.join(found.select("promise_id", "status"), "promise_id", "left")
    return rows.groupingSets([["jurisdiction", "status"], ["status"]], "jurisdiction", "status").agg(F.count("*").alias("n"), (F.grouping("jurisdiction") == 1).alias("everyone"))


def cross_with_record(positions: DataFrame, events: DataFrame, conduct: DataFrame, promised: DataFrame, mentions: DataFrame) -> DataFrame:
    """Positions (symbol) with what four registries (ticker, ...) say of each; on_record is false where none does."""
    count = lambda d, name: d.groupBy(F.col("ticker").alias("symbol")).agg(F.count("*").alias(name))
    out = positions
    for frame, name in ((events, "n_events"), (conduct, "n_transactions"), (promised, "n_promised"), (mentions, "n_mentions")):
        out = out.join(count(frame, name), "symbol", "left")
    names = ["n_events", "n_transactions", "n_promised", "n_mentions"]
    return out.withColumn("on_record", F.coalesce(*names).isNotNull())


def normalised_positions(rows: DataFrame) -> DataFrame:
    """Broker rows (json) as symbol, quantity, market_value, currency, kind.

    The symbol may stand in up to three nested objects of that name; currency and kind are
    those of the innermost. Units come before fractional units, a stated value before
    units times price. Rows without a symbol are dropped.
    """
    at = lambda path: F.get_json_object("json", f"$.{path}")
    number = lambda path: at(path).try_cast("double")
    depth = F.when(at("symbol.symbol.symbol").isNotNull(), 3).when(at("symbol.symbol").isNotNull(), 2).otherwise(1)
    inner = lambda field: F.when(F.col("depth") == 3, at(f"symbol.symbol.{field}")).when(F.col("depth") == 2, at(f"symbol.{field}"))
    rows = rows.withColumn("depth", depth)
    symbol = F.when(F.col("depth") == 1, at("symbol")).otherwise(inner("symbol"))
    currency = F.coalesce(inner("currency.code"), F.when(~inner("currency").startswith("{"), inner("currency")))
    units = F.coalesce(number("units"), number("fractional_units"))
    out = rows.select(
        symbol.alias("symbol"), units.alias("quantity"), F.coalesce(number("market_value"), units * number("price")).alias("market_value"),
        currency.alias("currency"), F.coalesce(inner("type.description"), inner("type.code")).alias("kind"),
    )
    return out.where(given(F.col("symbol")).isNotNull() & ~F.col("symbol").startswith("{"))


def price_report(prices: DataFrame, docs: DataFrame, days: int = 365, threshold_pct: float = 5.0, window_days: int = 7) -> DataFrame:
    """Each significant move of the trailing days with the documents before it."""
    return nearby_receipts(significant_moves(trailing(prices, days), threshold_pct), docs, window_days)


def promised_total(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.coalesce(F.sum("n_quantified"), F.lit(0)).alias("n_quantified"))


def recent_mentions(rows: DataFrame, as_of: str, window: int, k: int) -> DataFrame:
    """The best k mentions of the days up to as_of; co-mentions were counted before this cut."""
    if not (1 <= window <= 365 and 1 <= k <= 200):
        raise ValueError("window is 1 to 365 days, k 1 to 200")
    return rows.where(F.datediff(F.lit(as_of).cast("date"), F.try_to_date("date")).between(0, window)).orderBy(F.desc("return_pct"), "doc_id").limit(k)


def upcoming(entries: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Live streams, and the first k that are to come."""
    return entries.where("status = 'is_live'"), entries.where("status = 'is_upcoming'").orderBy("jurisdiction", "video_id").limit(k)
