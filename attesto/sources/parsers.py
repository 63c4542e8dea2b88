"""Parsers of feeds and files: one row of raw text in, rows of a schema out.

JSON and CSV are parsed by Spark's expressions. Captions, HTML, XML with refusals and
workbooks are Arrow-batched UDFs over the file's content, one call a batch of files.
"""

from __future__ import annotations

import html
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from datetime import date, timedelta
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, compact_date, given, iso_date, lenient_number
from ..functions.udf import series_udf
from ..operators.chunking import caption_windows, islands

# ---- captions

_CUE = re.compile(r"^((?:\d+:)?\d{2}:\d{2}\.\d{3})\s*-->\s*(?:\d+:)?\d{2}:\d{2}\.\d{3}")
CUES = "array<struct<start:double,text:string>>"


def cues_of(text: str | None) -> list[dict] | None:
    """Start and text of each cue; None for a file without its header or with a bad timing line."""
    lines = (text or "").splitlines()
    if not lines or not lines[0].strip().startswith("WEBVTT"):
        return None
    found: list[dict] = []
    open_cue: dict | None = None
    for line in map(str.strip, lines[1:]):
        if open_cue is not None and line:
            said = html.unescape(re.sub("<[^>]+>", "", line)).strip()
            open_cue["text"] = f"{open_cue['text']} {said}".strip() if said else open_cue["text"]
        elif open_cue is not None:
            found.append(open_cue)
            open_cue = None
        elif "-->" in line:
            m = _CUE.match(line)
            if not m:
                return None
            parts = m.group(1).split(":")
            open_cue = {"start": sum(float(p) * 60**i for i, p in enumerate(reversed(parts))), "text": ""}
    return [c for c in (*found, *([open_cue] if open_cue else [])) if c["text"]]


@series_udf(CUES)
def cues(text: pd.Series) -> pd.Series:
    return text.map(cues_of)


def without_rollups(items):
    """Cues without what rolling captions repeat: equal texts go, grown ones keep what they add, settled tails go.

    A fold over the cues in order; its state is the last full text and what is kept.
    """
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast(CUES).alias("kept"))

    def step(s, c):
        last, text = s["last"], c["text"]
        rest = F.trim(F.substr(text, F.length(last) + 1))
        grown = text.startswith(last)
        said = F.when(last.isNull(), text).when(grown, rest).when(last.endswith(text), "").otherwise(text)
        one = F.array(F.struct(c["start"].alias("start"), said.alias("text")))
        return F.struct(text.alias("last"), F.when(said != "", F.concat(s["kept"], one)).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(items, zero, step)["kept"]


def caption_docs(files: DataFrame, jurisdictions: DataFrame | None = None) -> DataFrame:
    """Documents of 75 seconds each from files (video, upload_date, vtt, jurisdiction); bad files give none."""
    rows = files.withColumn("cues", without_rollups(cues(F.col("vtt")))).where(F.size("cues") > 0)
    flat = rows.select("video", F.posexplode("cues").alias("ord", "c")).select("video", "ord", "c.start", "c.text")
    made = caption_windows(flat).join(rows.select("video", compact_date(F.col("upload_date")).alias("date"), "jurisdiction"), "video")
    link = F.concat(F.lit("https://youtube.com/watch?v="), "video", F.lit("&t="), "at_seconds", F.lit("s"))
    none = F.lit(None).cast("string")
    return made.select(
        "id", "text", F.lit("county_meeting").alias("source_type"), F.lit("sworn").alias("venue_type"), "date", link.alias("deep_link"),
        none.alias("ticker"), "jurisdiction", none.alias("speaker"),
    )


# ---- HTML filings

SECTIONS, LEAST_SECTION = {("1", "a"): "item1a", ("7", ""): "item7"}, 200
#: Elements without an end, elements that end a line, and elements whose text is not shown.
EMPTY, BLOCKS, UNSHOWN = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"), ("p", "tr", "table", "hr", "div"), ("script", "style")
BOLD_TAGS, BOLD_FROM = ("b", "strong"), 600


class _Run(NamedTuple):
    """Text of one look, or (mark) the start or end of a paragraph, or the end of another block."""

    text: str
    bold: bool = False
    linked: bool = False
    mark: str = ""


def _css(style: str | None) -> dict[str, str]:
    pairs = (part.split(":", 1) for part in (style or "").lower().split(";") if ":" in part)
    return {name.strip(): value.split("!")[0].strip() for name, value in pairs}


def _heavy(tag: str, style: str | None) -> bool:
    weight = _css(style).get("font-weight", "")
    return tag in BOLD_TAGS or weight.startswith("bold") or (weight.isdecimal() and int(weight) >= BOLD_FROM)


class _Runs(HTMLParser):
    """A page as runs, in order. Each open element knows its look and whether it links; looks are inherited."""

    def __init__(self, page: str | None):
        super().__init__(convert_charrefs=True)
        self.runs: list[_Run] = []
        self.open: list[tuple[str, bool, bool]] = []
        self.feed(page or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        if tag == "p" and (place := next((i for i, x in enumerate(self.open) if x[0] == "p"), None)) is not None:
            del self.open[place:]  # a paragraph ends where the next one begins
        _, bold, linked = self.open[-1] if self.open else ("", False, False)
        bold, linked = bold or _heavy(tag, held.get("style")), linked or (tag == "a" and held.get("href") is not None)
        if tag == "p":
            self.runs.append(_Run("", mark="start"))
        if linked:
            self.runs.append(_Run("", bold, True))
        if tag not in EMPTY:
            self.open.append((tag, bold, linked))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        place = next((i for i in reversed(range(len(self.open))) if self.open[i][0] == tag), None)
        if place is not None:
            del self.open[place:]
        if tag in BLOCKS:
            self.runs.append(_Run("", mark="end" if tag == "p" else "block"))

    def handle_data(self, data):
        if not any(tag in UNSHOWN for tag, _, _ in self.open):
            _, bold, linked = self.open[-1] if self.open else ("", False, False)
            self.runs.append(_Run(data, bold, linked))


def _item_of(text: str) -> tuple[str, str] | None:
    """Number and letter of a heading such as Item 1A. that a text begins with."""
    word, _, rest = " ".join(text.lower().split()).partition(" ")
    number = rest[: len(rest) - len(rest.lstrip("0123456789"))]
    rest = rest[len(number) :].lstrip()
    letter = rest[0] if rest and "a" <= rest[0] <= "z" else ""
    return (number, letter) if word == "item" and number and rest.startswith(".", len(letter)) else None


def _paragraphs(page: str | None) -> list[tuple[str, list[_Run] | None]]:
    """The page's text in pieces: each paragraph with its runs, and what stands outside of one without."""
    pieces: list[tuple[str, list[_Run] | None]] = []
    inside: list[_Run] | None = None

    def ended() -> None:
        if inside is not None:
            pieces.append(("".join(r.text for r in inside) + "\n", inside))

    for run in _Runs(page).runs:
        if run.mark == "start":
            ended()
            inside = []
        elif run.mark == "end":
            ended()
            if inside is None:
                pieces.append(("\n", None))
            inside = None
        elif run.mark and inside is None:
            pieces.append(("\n", None))
        elif inside is not None:
            inside.append(run)
        else:
            pieces.append((run.text, None))
    ended()
    return pieces


def _headings(pieces: list[tuple[str, list[_Run] | None]]) -> list[tuple[int, tuple[str, str], bool]]:
    """Place in the text, item and whether it is a link, of the paragraphs that are all bold and read as an item's heading."""
    out, at = [], 0
    for text, runs in pieces:
        if runs is not None and all(r.bold for r in runs if r.text.strip()) and (item := _item_of(text)):
            out.append((at, item, any(r.linked for r in runs)))
        at += len(text)
    return out


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def filing_sections(page: str | None, form: str | None) -> list[dict]:
    """(section, text) of a filing: two items of annual and quarterly reports, else the whole text of those that are read."""
    form = (form or "").upper()
    if not (form in ("10-K", "10-Q", "8-K") or form.startswith("EX-99")):
        return []
    pieces = _paragraphs(page)
    text = "".join(x for x, _ in pieces)
    if form not in ("10-K", "10-Q"):
        body = tidy(text)
        return [{"section": "body" if form == "8-K" else form.lower(), "text": body}] if body else []
    found: dict[str, str] = {}
    headings = _headings(pieces)
    ends = [h[0] for h in headings[1:]] + [len(text)]
    for (start, item, linked), end in zip(headings, ends, strict=False):
        section, body = SECTIONS.get(item), tidy(text[start:end])
        if section and section not in found and not linked and len(body) >= LEAST_SECTION:
            found[section] = body
    return [{"section": s, "text": found[s]} for s in SECTIONS.values() if s in found]


@series_udf("array<struct<section:string,text:string>>")
def _sections(page: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([filing_sections(a, b) for a, b in zip(page, form, strict=True)])


@series_udf("string")
def html_text(page: pd.Series) -> pd.Series:
    return page.map(lambda x: tidy("".join(text for text, _ in _paragraphs(x))))


def filing_docs(files: DataFrame) -> DataFrame:
    """Documents of files (ticker, accession, form, filing_date, html)."""
    rows = files.select("*", F.explode(_sections(F.col("html"), F.col("form"))).alias("s"))
    link = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "ticker", F.lit("/"), F.replace("accession", F.lit("-")), F.lit("/"), "accession", F.lit("-index.htm"))
    none = F.lit(None).cast("string")
    return rows.select(
        F.concat_ws(":", F.lit("edgar"), "ticker", "accession", "s.section").alias("id"), F.col("s.text").alias("text"), F.lit("filing").alias("source_type"),
        F.lit("coached").alias("venue_type"), F.col("filing_date").alias("date"), link.alias("deep_link"), "ticker", none.alias("jurisdiction"), none.alias("speaker"),
    )


def recent_filings(submissions: DataFrame, forms, limit: int) -> DataFrame:
    """The newest filings of these forms in a submissions document (column json); parallel arrays, short ones padded."""
    ddl = "cik string, filings struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>,primaryDocument:array<string>>>"
    r = F.from_json("json", ddl)
    rows = submissions.select(r["cik"].alias("cik"), F.posexplode(F.arrays_zip(*(r["filings"]["recent"][c].alias(c) for c in ("accessionNumber", "filingDate", "form", "primaryDocument")))).alias("ord", "x"))
    rows = rows.select("cik", "ord", F.col("x.accessionNumber").alias("accession"), F.col("x.form").alias("form"), F.coalesce("x.filingDate", F.lit("")).alias("filing_date"), F.coalesce("x.primaryDocument", F.lit("")).alias("primary_document"))
    return rows.where(F.col("form").isin(*forms) & F.col("accession").isNotNull()).orderBy(F.desc("filing_date"), "ord").limit(limit).drop("ord")


# ---- transcripts

SPEAKER = r"^(?:[A-Z][A-Za-z'’-]*\s+){0,4}[A-Z][A-Za-z'’-]*$"


def transcript_docs(calls: DataFrame) -> DataFrame:
    """Documents of calls (symbol, quarter, year, date, content): one for each run of a speaker's lines.

    "Name: text" begins a turn, other lines go on with the last; without any name the
    whole content is one document. Turns and runs are gaps and islands over the lines.
    """
    keys = ["symbol", "year", "quarter"]
    lines = calls.select(*keys, F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    name = F.substring_index("line", ": ", 1)
    named = F.col("line").contains(": ") & name.rlike(SPEAKER)
    rows = lines.withColumn("new", named).withColumn("said", F.when(named, F.substr("line", F.length(name) + 3)).otherwise(F.col("line"))).withColumn("name", F.when(named, name))
    by = Window.partitionBy(*keys)
    at = by.orderBy("pos")
    rows = rows.withColumn("speaker", F.last("name", ignorenulls=True).over(at)).withColumn("any", F.max("new").over(by))
    runs = islands(rows.where("any"), keys, "pos", "speaker", "said").withColumnRenamed("said", "text")
    whole = calls.join(rows.where("any").select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(1).cast("long").alias("island"), F.lit(None).cast("string").alias("speaker"), F.trim("content").alias("text"))
    made = runs.unionByName(whole).join(calls.select(*keys, F.substring(F.trim("date"), 1, 10).alias("date")), keys)
    link = F.format_string("https://financialmodelingprep.com/api/v3/earning_call_transcript/%s?quarter=%d&year=%d", "symbol", "quarter", "year")
    return made.select(
        F.format_string("fmp:%s:%dq%d:turn%03d", "symbol", "year", "quarter", "island").alias("id"), "text", F.lit("earnings_call").alias("source_type"),
        F.lit("coached").alias("venue_type"), "date", link.alias("deep_link"), F.col("symbol").alias("ticker"), F.lit(None).cast("string").alias("jurisdiction"), "speaker",
    )


# ---- XML

_FORM4 = (
    "array<struct<cik:string,filer_name:string,filer_title:string,is_officer:boolean,is_director:boolean,transaction_date:string,code:string,"
    "shares:double,price_per_share:double,value:double,shares_owned_after:double>>"
)


def _tree(text: str | None):
    """The root of an XML text; None if it is malformed or declares types or entities."""
    text = text or ""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:  # wherever they stand
        return None
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def form4_of(text: str | None) -> list[dict]:
    root = _tree(text)
    if root is None:
        return []

    def said(node, path: str) -> str:
        found = node.find(path)
        if found is None:
            return ""
        inner = found.findtext("value")
        return (inner if inner is not None else found.text or "").strip()

    def amount(node, path: str) -> float:
        try:
            return float(said(node, path) or 0)
        except ValueError:
            return 0.0

    flag = lambda path: said(root, f"reportingOwner/reportingOwnerRelationship/{path}") in ("1", "true")
    filer = {
        "cik": said(root, "issuer/issuerCik"), "filer_name": said(root, "reportingOwner/reportingOwnerId/rptOwnerName"),
        "filer_title": said(root, "reportingOwner/reportingOwnerRelationship/officerTitle"), "is_officer": flag("isOfficer"), "is_director": flag("isDirector"),
    }
    rows = []
    for t in root.iterfind("nonDerivativeTable/nonDerivativeTransaction"):
        shares, price = amount(t, "transactionAmounts/transactionShares"), amount(t, "transactionAmounts/transactionPricePerShare")
        rows.append(filer | {
            "transaction_date": said(t, "transactionDate"), "code": said(t, "transactionCoding/transactionCode"), "shares": shares, "price_per_share": price,
            "value": round(shares * price, 2), "shares_owned_after": amount(t, "postTransactionAmounts/sharesOwnedFollowingTransaction"),
        })
    return rows


@series_udf(_FORM4)
def _form4(text: pd.Series) -> pd.Series:
    return text.map(form4_of)


def transactions(files: DataFrame) -> DataFrame:
    """Transactions of files (ticker, accession, filing_url, xml)."""
    return files.select("ticker", "accession", "filing_url", F.inline(_form4(F.col("xml"))))


def atom_of(text: str | None) -> list[dict]:
    root = _tree(text)
    if root is None:
        return []
    local = lambda node: node.tag.rpartition("}")[2]
    rows = []
    for entry in (n for n in root.iter() if local(n) == "entry"):
        fields = {local(f): (f.text or "").strip() for c in entry if local(c) == "content" for f in c}
        if fields.get("accession-number"):
            rows.append({"accession": fields["accession-number"], "form": fields.get("filing-type", ""), "filing_date": fields.get("filing-date", ""), "filing_href": fields.get("filing-href", "")})
    return rows


@series_udf("array<struct<accession:string,form:string,filing_date:string,filing_href:string>>")
def _atom(text: pd.Series) -> pd.Series:
    return text.map(atom_of)


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Entries of feeds (ticker, xml), with ord."""
    return feeds.select("ticker", F.posexplode(_atom(F.col("xml"))).alias("ord", "e")).select("ticker", "ord", "e.*")


# ---- JSON feeds


def fts_hits(pages: DataFrame) -> DataFrame:
    """Full-text search hits of pages (json); a response of another shape is an error."""
    ddl = "hits struct<hits:array<struct<_id:string,_source:struct<form:string,root_forms:array<string>,ciks:array<string>,display_names:array<string>,file_date:string,adsh:string>>>>"
    r = F.from_json("json", ddl)
    rows = pages.select(F.posexplode(F.when(r["hits"]["hits"].isNull(), F.raise_error(F.lit("search response without hits"))).otherwise(r["hits"]["hits"])).alias("ord", "h"))
    form = F.coalesce(given(F.col("h._source.form")), F.get("h._source.root_forms", F.lit(0)))
    need = lambda c, name: F.when(c.isNull(), F.raise_error(F.lit(f"search hit without {name}"))).otherwise(c)
    names = F.coalesce("h._source.display_names", F.array().cast("array<string>"))
    found = F.flatten(F.transform(names, lambda n: F.split(F.regexp_extract(n, r"\(([^()]+)\)\s*\(CIK\s+\d+\)\s*$", 1), ",")))
    tickers = F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != ""))
    accession = F.coalesce("h._source.adsh", F.substring_index(need(F.col("h._id"), "_id"), ":", 1))
    return rows.select("ord", accession.alias("accession"), need(form, "form").alias("form"), need(F.col("h._source.ciks"), "ciks").alias("ciks"), tickers.alias("tickers"), F.col("h._source.file_date").alias("filing_date"))


def miso_queue(pages: DataFrame) -> DataFrame:
    ddl = "array<struct<projectNumber:string,county:string,state:string,summerNetMW:string,fuelType:string,applicationStatus:string,queueDate:string,withdrawnDate:string>>"
    rows = pages.select(F.inline(F.from_json("json", ddl)))
    out = rows.select(
        F.lit("MISO").alias("iso"), clean(F.col("projectNumber")).alias("queue_id"), clean(F.col("county")).alias("county"), clean(F.col("state")).alias("state"),
        lenient_number(F.col("summerNetMW")).alias("mw"), clean(F.col("fuelType")).alias("fuel"), clean(F.col("applicationStatus")).alias("status"), iso_date(F.col("queueDate")).alias("queue_date"),
        ((clean(F.col("withdrawnDate")) != "") | (clean(F.col("applicationStatus")) == "Withdrawn")).alias("withdrawn"),
    )
    return out.where("queue_id <> ''")


def permit_facilities(pages: DataFrame) -> DataFrame:
    """Permits of pages (json); a response without its list is an error, rows without an id are skipped."""
    r = F.from_json("json", "Results struct<Facilities:array<struct<SourceID:string,CWPName:string,CWPCounty:string,CWPState:string,CWPPermitStatusDesc:string>>>")
    found = F.when(r["Results"]["Facilities"].isNull(), F.raise_error(F.lit("permit response without facilities"))).otherwise(r["Results"]["Facilities"])
    names = {"CWPName": "facility", "SourceID": "permit_id", "CWPCounty": "county", "CWPState": "state", "CWPPermitStatusDesc": "status"}
    return pages.select(F.posexplode(found).alias("ord", "f")).select("ord", *(clean(F.col(f"f.{a}")).alias(b) for a, b in names.items())).where("permit_id <> ''")


def permit_summary(pages: DataFrame) -> DataFrame:
    r = F.from_json("json", "Results struct<QueryID:string,QueryRows:string>")["Results"]
    bad = (clean(r["QueryID"]) == "") | ~clean(r["QueryRows"]).rlike(r"^\d+$")
    return pages.select(F.when(bad, F.raise_error(F.lit("permit summary of another shape"))).otherwise(clean(r["QueryID"])).alias("query_id"), clean(r["QueryRows"]).try_cast("long").alias("query_rows"))


def legistar_docs(rows: DataFrame, kind: str) -> DataFrame:
    """Documents of matters or events (client, jurisdiction, json); rows without an integer id, a day or text give none."""
    fields = {"matter": ("MatterId", "MatterIntroDate", ("MatterFile", "MatterName", "MatterTitle")), "event": ("EventId", "EventDate", ("EventBodyName", "EventComment", "EventLocation"))}
    key, day, texts = fields[kind]
    r = F.from_json("json", f"{key} string, {day} string, {', '.join(f'{t} string' for t in texts)}, EventInSiteURL string")
    day = F.substring_index(r[day], "T", 1)
    text = F.array_join(F.filter(F.array(*(clean(r[t]) for t in texts)), lambda x: x != ""), " — ")
    none = F.lit(None).cast("string")
    link = F.concat(F.lit("https://webapi.legistar.com/v1/"), "client", F.lit(f"/{kind}s/"), r[key])
    link = F.coalesce(given(r["EventInSiteURL"]), link) if kind == "event" else link
    made = rows.select(
        F.concat(F.lit("legistar:"), "client", F.lit(f":{kind}:"), r[key]).alias("id"), text.alias("text"), F.lit("legistar").alias("source_type"), F.lit("public").alias("venue_type"),
        day.alias("date"), link.alias("deep_link"), none.alias("ticker"), "jurisdiction", none.alias("speaker"), r[key].alias("__key"),
    )
    return made.where(F.col("__key").rlike(r"^-?\d+$") & (F.col("text") != "") & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).drop("__key")


# ---- prices


def stooq_prices(files: DataFrame) -> DataFrame:
    """ticker, date, close of CSV files (ticker, csv): a header, then six fields; other lines are skipped."""
    lines = files.select("ticker", F.explode(F.slice(F.filter(F.transform(F.split("csv", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 2, 1_000_000_000)).alias("line"))
    f = F.split("line", ",")
    rows = lines.where(F.size(f) == 6).select("ticker", F.try_to_date(F.trim(f[0]), "yyyy-MM-dd").cast("string").alias("date"), F.trim(f[4]).try_cast("double").alias("close"))
    return rows.where("date is not null and close is not null").orderBy("ticker", "date")


def fmp_prices(pages: DataFrame) -> DataFrame:
    """Prices of pages (ticker, json); a close must be a number."""
    v = F.try_parse_json("json")
    kind = lambda x: F.schema_of_variant(x)
    items = F.try_variant_get(v, "$.historical", "array<variant>")
    rows = pages.select("ticker", F.explode(items).alias("e"))
    close = F.when(kind(F.try_variant_get("e", "$.close", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get("e", "$.close", "double"))
    rows = rows.select("ticker", F.try_to_date(F.try_variant_get("e", "$.date", "string"), "yyyy-MM-dd").cast("string").alias("date"), close.alias("close"))
    return rows.where("date is not null and close is not null").orderBy("ticker", "date")


def chart_prices(pages: DataFrame) -> DataFrame:
    """Prices of chart pages (ticker, json): parallel arrays of epoch seconds and closes; null closes are skipped."""
    r = F.get(F.from_json("json", "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>")["chart"]["result"], F.lit(0))
    pairs = F.arrays_zip(r["timestamp"].alias("t"), F.get(r["indicators"]["quote"], F.lit(0))["close"].alias("close"))
    rows = pages.select("ticker", F.inline(pairs))
    return rows.where("close is not null and t is not null").select("ticker", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd").alias("date"), "close").orderBy("ticker", "date")


# ---- queue CSV and live streams


def spp_queue(files: DataFrame) -> DataFrame:
    """Queue rows of CSV files (csv): the header is among the first ten lines."""
    key = "Generation Interconnection Number"

    def one(text: str | None) -> list[dict]:
        import csv

        lines = (text or "").splitlines()
        start = next((i for i, line in enumerate(lines[:10]) if key in line), None)
        if start is None:
            return []
        rows = csv.reader(io.StringIO("\n".join(lines[start:])))
        names = [c.strip() for c in next(rows)]
        return [{n: v.strip() for n, v in zip(names, r, strict=False)} for r in rows]

    read = F.pandas_udf(lambda s: s.map(one), "array<map<string,string>>")
    m = lambda c: clean(F.try_element_at("m", F.lit(c)))
    rows = files.select(F.explode(read(F.col("csv"))).alias("m"))
    return rows.select(
        F.lit("SPP").alias("iso"), m(key).alias("queue_id"), m("Nearest Town or County").alias("county"), m("State").alias("state"), lenient_number(m("MAX Summer MW")).alias("mw"),
        F.coalesce(given(m("Generation Type")), m("Fuel Type")).alias("fuel"), m("Status").alias("status"), iso_date(m("Request Received")).alias("queue_date"), (m("Date Withdrawn") != "").alias("withdrawn"),
    ).where("queue_id <> ''")


#: Words in the titles of hearings.
HEARINGS = "meeting session council board commission hearing supervisors committee workshop budget planning zoning agenda trustees aldermen".split()


def stream_entries(lines: DataFrame) -> DataFrame:
    """Live and upcoming streams of lines (jurisdiction, line): id|status|title."""
    p = F.split("line", r"\|", 3)
    rows = lines.where(F.size(p) == 3).select("jurisdiction", F.trim(p[0]).alias("video_id"), F.trim(p[2]).alias("title"), F.trim(p[1]).alias("status"))
    rows = rows.where(F.col("status").isin("is_live", "is_upcoming") & (F.col("video_id") != ""))
    return rows.withColumn("url", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id"))


def hearings(entries: DataFrame) -> DataFrame:
    return entries.where(F.lower(F.coalesce("title", F.lit(""))).rlike("|".join(HEARINGS)))


# ---- workbooks

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _days(formats: list[int]) -> set[int]:
    return {i for i, f in enumerate(formats) if f in range(14, 23) or f in range(45, 48)}


def sheet_grid(content: bytes, sheet: str) -> list[list[str]] | None:
    """The cells of a sheet as text, days as ISO; None if the file is no workbook or has no such sheet."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        root = ET.fromstring(book.read("xl/workbook.xml"))
        names = [s.get("name") for s in root.iter(f"{_NS}sheet")]
        if sheet not in names:
            return None
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        rid = next(s for s in root.iter(f"{_NS}sheet") if s.get("name") == sheet).get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")
        parts = set(book.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts else []
        formats: list[int] = []
        if "xl/styles.xml" in parts:
            cells = ET.fromstring(book.read("xl/styles.xml")).find(f"{_NS}cellXfs")
            formats = [int(x.get("numFmtId") or 0) for x in (cells if cells is not None else [])]
        tree = ET.fromstring(book.read("xl/" + links[rid].removeprefix("/xl/")))
    except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration):
        return None
    dated, grid = _days(formats), []
    for row in tree.iter(f"{_NS}row"):
        at = int(row.get("r") or len(grid) + 1)
        grid += [[] for _ in range(at - len(grid))]
        for c in row.iter(f"{_NS}c"):
            letters = re.match("[A-Z]+", c.get("r") or "")
            col = 0
            for x in letters.group() if letters else "":
                col = col * 26 + ord(x) - 64
            col = col - 1 if letters else len(grid[at - 1])
            value, kind = c.findtext(f"{_NS}v"), c.get("t")
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif value is not None and kind is None and int(c.get("s") or 0) in dated:
                value = (date(1899, 12, 30) + timedelta(days=int(float(value)))).isoformat()
            grid[at - 1] += [""] * (col + 1 - len(grid[at - 1]))
            grid[at - 1][col] = (value or "").strip()
    return grid


def table_of(content: bytes, sheet: str, key: str, scan: int = 60) -> list[dict]:
    """Rows below the header that holds key, by column name; rows without a key are skipped."""
    grid = sheet_grid(content, sheet) or []
    start = next((i for i, r in enumerate(grid[:scan]) if key in r), None)
    if start is None:
        return []
    names = grid[start]
    rows = [dict(zip(names, r, strict=False)) for r in grid[start + 1 :]]
    return [{k: v for k, v in r.items() if k} for r in rows if r.get(key)]


def _workbook(sheet: str, key: str, scan: int = 60):
    return series_udf("array<map<string,string>>")(lambda s: s.map(lambda x: table_of(x, sheet, key, scan)))


def _cells(files: DataFrame, sheet: str, key: str):
    rows = files.select(F.explode(_workbook(sheet, key)(F.col("content"))).alias("m"))
    return rows, lambda c: clean(F.try_element_at("m", F.lit(c)))


def ercot_queue(files: DataFrame) -> DataFrame:
    rows, m = _cells(files, "Project Details - Large Gen", "INR")
    return rows.select(
        F.lit("ERCOT").alias("iso"), m("INR").alias("queue_id"), m("County").alias("county"), F.lit("TX").alias("state"), lenient_number(m("Capacity (MW)")).alias("mw"), m("Fuel").alias("fuel"),
        m("GIM Study Phase").alias("status"), m("Projected COD").alias("queue_date"), F.lit(False).alias("withdrawn"), m("Air Permit").alias("air_permit"), m("GHG Permit").alias("ghg_permit"),
        m("Water Availability").alias("water_availability"),
    )


def caiso_queue(files: DataFrame) -> DataFrame:
    rows, m = _cells(files, "Grid GenerationQueue", "Queue Position")
    return rows.select(
        F.lit("CAISO").alias("iso"), m("Queue Position").alias("queue_id"), m("County").alias("county"), m("State").alias("state"),
        lenient_number(F.coalesce(given(m("Net MWs to Grid")), m("MW-1"))).alias("mw"), m("Fuel-1").alias("fuel"), m("Application Status").alias("status"), m("Queue Date").alias("queue_date"),
        (F.upper(m("Application Status")) == "WITHDRAWN").alias("withdrawn"),
    )


GENERATOR_COLUMNS = ("Entity Name", "Plant Name", "Plant State", "County", "Nameplate Capacity (MW)", "Technology", "Sector")


def generators(files: DataFrame, sheet: str) -> DataFrame:
    """Generators of a monthly workbook; another sheet, no workbook or a missing column is an error."""
    if sheet not in ("Operating", "Planned"):
        raise ValueError(f"unsupported sheet {sheet!r}")

    def one(content: bytes) -> list[dict]:
        grid = sheet_grid(content, sheet)
        if grid is None:
            raise ValueError(f"no workbook with a sheet {sheet!r}")
        header = next((r for r in grid[:10] if "Plant Name" in r), [])
        lacking = [c for c in (*GENERATOR_COLUMNS, *(("Planned Operation Month", "Planned Operation Year") if sheet == "Planned" else ())) if c not in header]
        if lacking:
            raise ValueError(f"{sheet}: missing columns {lacking}")
        return table_of(content, sheet, "Plant Name", 10)

    rows = files.select(F.explode(series_udf("array<map<string,string>>")(lambda s: s.map(one))(F.col("content"))).alias("m"))
    m = lambda c: clean(F.try_element_at("m", F.lit(c)))
    month, year = m("Planned Operation Month"), m("Planned Operation Year")
    online = F.when(month.rlike(r"^\d+$") & year.rlike(r"^\d+$"), F.format_string("%04d-%02d", year.try_cast("int"), month.try_cast("int"))).otherwise("")
    return rows.select(
        m("Plant Name").alias("plant"), m("Entity Name").alias("entity"), m("County").alias("county"), m("Plant State").alias("state"), lenient_number(m("Nameplate Capacity (MW)")).alias("mw"),
        m("Technology").alias("technology"), m("Sector").alias("sector"), F.lit(sheet.lower()).alias("status"), (online if sheet == "Planned" else F.lit("")).alias("planned_online"),
    )


MONTHS = "january february march april may june july august september october november december".split()


def workbook_links(pages: DataFrame) -> DataFrame:
    """url of the monthly workbooks that pages (html) link to, newest first."""
    pattern = '(?i)href="([^"]*/(' + "|".join(MONTHS) + r')_generator(\d{4})\.xlsx)"'
    parts = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(pattern), i).alias(c) for i, c in ((1, "url"), (2, "month"), (3, "year"))))
    rows = pages.select(F.inline(parts)).distinct()
    place = F.array_position(F.array(*(F.lit(x) for x in MONTHS)), F.lower("month"))
    return rows.orderBy(F.desc(F.col("year").cast("int")), F.desc(place), "url").select("url")
