"""Schemas of the library's tables; sources are read with these, never inferred."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType(),
    "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(spec: str) -> T.StructType:
    """A struct of "name type" parts; needs no session, as fromDDL would."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in spec.split(", "))])


DOC = _struct(
    "id string, text string, source_type string, venue_type string, date string, deep_link string, ticker string, jurisdiction string, speaker string"
)
#: Fields that every document must have.
REQUIRED = ("id", "text", "source_type", "venue_type", "date", "deep_link")
CHUNK = _struct(
    "chunk_id string, doc_ids array<string>, text string, source_type string, venue_type string, date string, deep_link string, ticker string, jurisdiction string, speaker string"
)
JUDGMENT = _struct("query_id string, query string, criterion string, doc_id string, grade int")
PRICE = _struct("ticker string, date string, close double")
QUANTITY_DDL = "array<struct<kind:string,value:double,unit:string,cadence:string,raw_span:string>>"
PROMISE = _struct(
    "promise_id string, doc_id string, deep_link string, date string, jurisdiction string, ticker string, quote string, category string, quantified boolean, value_text string"
)
TRANSACTION = _struct(
    "ticker string, cik string, filer_name string, filer_title string, is_officer boolean, is_director boolean, transaction_date string, code string, shares double, price_per_share double, value double, shares_owned_after double, filing_url string, accession string"
)
QUEUE = _struct(
    "iso string, queue_id string, county string, state string, mw double, fuel string, status string, queue_date string, withdrawn boolean, air_permit string, ghg_permit string, water_availability string"
)
PERMIT = _struct("facility string, permit_id string, county string, state string, status string")
GENERATOR = _struct("plant string, entity string, county string, state string, mw double, technology string, sector string, status string, planned_online string")
POSITION = _struct("symbol string, quantity double, market_value double, currency string, kind string")
QA = _struct("qa_id string, question string, criterion string, answer_doc_ids array<string>, origin string")
UNANSWERABLE = _struct("qa_id string, question string, notes string, reason string")
LABEL = _struct("label_id string, question string, answer_text string, claim string, chunk_texts array<string>, human_verdict string")
EMBEDDING = _struct("chunk_id string, content_hash string, vec array<float>, model string, dim int")
