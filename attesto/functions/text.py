"""Text columns: tokens, snippets, marker counts and small coercions, as Catalyst expressions.

There is one analyzer, for texts and queries: NFKC, casefold, runs of letters and digits.
tokens() is that analyzer as a column. Texts of PLAIN characters, for which lower case and
one rule for the sharp s say all that NFKC and casefold would, stay in generated code; only
others go to an Arrow-batched UDF, analyze(), which is exact for every Unicode text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import series_udf

TOKEN = r"[\p{L}\p{N}]+"
#: ASCII, the letters of Latin-1 and punctuation that parts words in every form: nothing here composes or folds to anything else.
PLAIN = r"^[\x00-\x7F\u00A1\u00AB\u00BB\u00BF-\u00FF\u2010-\u2016\u2018-\u201F\u2020-\u2022\u20AC]*$"
_TOKEN = re.compile(r"[^\W_]+")
_PIECE = re.compile(r"[^ \n]+|[ \n][^ \n]*")
SNIPPET, MARGIN = 160, 80


def analyze_text(text: str | None) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFKC", text or "").casefold())


@series_udf("array<string>")
def analyze(text: pd.Series) -> pd.Series:
    return text.map(analyze_text)


def tokens(text) -> Column:
    """The analyzed words of a text, in order; none of a null."""
    text = F.coalesce(text, F.lit(""))
    plain = text.rlike(PLAIN)
    native = F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(TOKEN), 0)
    return F.when(plain, native).otherwise(analyze(F.when(~plain, text)))


def token_count(text) -> Column:
    """How many words tokens() finds; nothing is collected for plain texts."""
    text = F.coalesce(text, F.lit(""))
    plain = text.rlike(PLAIN)
    return F.when(plain, F.regexp_count(text, F.lit(TOKEN))).otherwise(F.size(analyze(F.when(~plain, text)))).cast("long")


def head_snippet(text) -> Column:
    return F.substring(text, 1, SNIPPET)


def _joins(c: str) -> bool:
    """Whether a character may be composed with the one before it: a combining one, or a vowel or end of a Korean syllable."""
    return unicodedata.combining(c) != 0 or "\u1160" <= c <= "\u11ff"


def placed_tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """The words that analyze_text() finds, each with the stretch of the raw text that it came from; taken as they are asked for."""
    if text.isascii():
        for m in _TOKEN.finditer(text):
            yield m.group().lower(), *m.span()
        return
    for piece in _PIECE.finditer(text):  # no word goes on behind a space, and nothing is composed with one that follows
        base = piece.start()
        if piece.group().isascii():
            for m in _TOKEN.finditer(piece.group()):
                yield m.group().lower(), base + m.start(), base + m.end()
            continue
        folded, starts, ends = [], [], []
        at = base
        while at < piece.end():
            end = at + 1
            while end < piece.end() and _joins(text[end]):
                end += 1
            part = unicodedata.normalize("NFKC", text[at:end]).casefold()
            folded.append(part)
            starts += [at] * len(part)
            ends += [end] * len(part)
            at = end
        for m in _TOKEN.finditer("".join(folded)):
            yield m.group(), starts[m.start()], ends[m.end() - 1]


def centred_snippet(text, terms) -> Column:
    """The text around the earliest word that is one of the terms, as the index knows words; its head where none occurs.

    Plain texts stay in generated code, but for those with a sharp s, whose words may be longer than they are written.
    In others, words are found in the normalised text and mapped back, so a composed and a decomposed form are one word.
    """
    text = F.coalesce(text, F.lit(""))
    plain = text.rlike(PLAIN) & ~text.contains("ß")
    low, letter = F.lower(text), r"[\p{L}\p{N}]"
    words = F.filter(terms, lambda w: w.rlike(f"^{letter}+$"))  # nothing else is a word of a text
    pattern = F.concat(F.lit(f"(?<!{letter})(?:"), F.array_join(words, "|"), F.lit(f")(?!{letter})"))
    at = F.when(F.size(words) > 0, F.regexp_instr(low, pattern)).otherwise(0)
    start = F.greatest(at - 1 - MARGIN, F.lit(0))
    around = F.substring(text, start + 1, at - 1 + F.length(F.regexp_substr(low, pattern)) + MARGIN - start)
    return F.when(plain, F.when(at > 0, around).otherwise(head_snippet(text))).otherwise(_centred_snippet(F.when(~plain, text), terms))


@series_udf("string")
def _centred_snippet(text: pd.Series, terms: pd.Series) -> pd.Series:

    def one(body, wanted) -> str:
        body = body or ""
        wanted = set(wanted if wanted is not None else ())
        for word, a, b in placed_tokens(body):
            if word in wanted:
                return body[max(0, a - MARGIN) : b + MARGIN]
        return body[:SNIPPET]

    return pd.Series([one(a, b) for a, b in zip(text, terms, strict=True)], dtype=object)


def literal(text: str) -> str:
    """A pattern that matches exactly this text, for Java and RE2."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def count_phrases(text, phrases) -> Column:
    """Non-overlapping occurrences of each phrase in the lower-cased text, summed."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for p in phrases:
        total = total + F.regexp_count(low, F.lit(literal(p)))
    return total.cast("long")


def given(x) -> Column:
    """Null for a missing or empty string."""
    return F.nullif(x, F.lit(""))


def clean(x) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def lenient_number(x) -> Column:
    """A number with commas, else 0."""
    return F.coalesce(F.replace(x.cast("string"), F.lit(",")).try_cast("double"), F.lit(0.0))


def iso_date(x) -> Column:
    """The day of an ISO time, or of month/day/year with four digits of the year; else the text itself."""
    x = clean(x)
    parts = F.split(x, "/")
    us = F.format_string("%s-%02d-%02d", parts[2], parts[0].cast("int"), parts[1].cast("int"))
    return F.when(x.contains("T"), F.substring_index(x, "T", 1)).when(x.rlike(r"^\d+/\d+/\d{4}$"), us).otherwise(x)


def compact_date(x) -> Column:
    """YYYYMMDD as ISO; else the text itself."""
    return F.when(x.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))).otherwise(x)


def content_hash(model, dim, text) -> Column:
    return F.sha2(F.concat_ws("\n", model, dim.cast("string"), text), 256)


def flattened(x) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


#: Words that carry no content.
STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "this", "that", "these", "those", "will", "we", "they", "it", "is", "are", "was", "were", "be", "been", "our", "its", "their",
    "his", "her", "at", "by", "with", "as", "from",
)
#: Words of a question that name nothing.
QUESTION_STOPWORDS = (
    "about", "after", "again", "against", "because", "been", "before", "being", "between", "could", "does", "doing", "during", "each", "from", "have", "having", "here", "into", "just", "more", "most",
    "only", "other", "over", "same", "should", "some", "such", "tell", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "told", "under", "until", "very", "were", "what",
    "when", "where", "which", "while", "will", "with", "would", "your",
)
WINDOW = 4


def content_tokens(text) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[A-Za-z0-9$']+"), 0)
    return F.filter(found, lambda t: ~t.isin(list(STOPWORDS)))


def k_grams(items, k: int = WINDOW) -> Column:
    """Every run of k neighbours of an array, in order."""
    n = F.size(items)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(items, i, F.lit(k)))).otherwise(F.array().cast("array<array<string>>"))


def question_terms(question, limit: int = 3) -> Column:
    """The longest words of four or more letters that name something, as written at their first place, the first of equal length first."""
    words = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"[A-Za-z][A-Za-z'-]+"), 0)
    keyed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"), F.lower(w).alias("k")))
    kept = F.filter(keyed, lambda x: (F.length(x["k"]) >= 4) & ~x["k"].isin(list(QUESTION_STOPWORDS)))
    keys = F.transform(kept, lambda x: x["k"])
    first = F.filter(kept, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.slice(F.transform(F.array_sort(first), lambda x: x["w"]), 1, limit)


def valid_markers(answer, n) -> Column:
    """Numbers of the citation marks [k] with 1 <= k <= n, distinct, in order of first appearance."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda k: (k >= 1) & (k <= n)))


def without_bad_markers(answer, n) -> Column:
    """The answer with the marks that are out of range removed."""
    bad = F.array_distinct(F.filter(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: F.coalesce((x.try_cast("int") < 1) | (x.try_cast("int") > n), F.lit(True))))
    return F.aggregate(bad, answer, lambda s, x: F.replace(s, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
