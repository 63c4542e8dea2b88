"""What comes before and after a generator: context, refusal, citations, grounding, letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import claims, letter_citations
from ..functions.text import head_snippet, question_terms, valid_markers, without_bad_markers

SENTINEL = "INSUFFICIENT_CONTEXT"


def context_blocks(retrieved: DataFrame) -> DataFrame:
    """question_id, prompt_context, n, best of retrieved (question_id, rank, score, source_type, date, text): numbered blocks."""
    block = F.concat(F.lit("["), "rank", F.lit("] "), F.concat_ws(" | ", "source_type", "date"), F.lit("\n"), "text")
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    rows = retrieved.groupBy("question_id").agg(parts.alias("p"), F.count("*").cast("int").alias("n"), F.max("score").alias("best"))
    return rows.select("question_id", F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("prompt_context"), "n", "best")


NO_RECORDS, LOW_SCORE, NOT_COVERED = "no records were retrieved", "the best score is below the least confidence", "the generator found the context insufficient"


def suggestions(question):
    """Two or three ways to ask anew, from what the question names."""
    t = question_terms(question)
    named = F.array_compact(F.array(
        F.concat(F.lit("Search for "), F.get(t, F.lit(0)), F.lit(" alone, then narrow it.")),
        F.when(F.size(t) > 1, F.concat(F.lit("Name the venue or filing that would speak of "), F.get(t, F.lit(1)), F.lit("."))),
        F.concat(F.lit("Add dates or a jurisdiction to "), F.element_at(t, -1), F.lit(".")),
    ))
    return F.when(F.size(t) > 0, named).otherwise(F.array(F.lit("Name the organisation, venue or filing you have in mind."), F.lit("Add dates or a jurisdiction.")))


def grounding(answer, n):
    """status, supported_claims, total_claims: grounded if every claim of the answer has a valid mark, partial if some have one."""
    held = claims(answer)
    total, supported = F.size(held), F.size(F.filter(held, lambda c: F.size(valid_markers(c, n)) > 0))
    status = F.when((total > 0) & (supported == total), "grounded").when(supported > 0, "partial").otherwise("ungrounded")
    return F.struct(status.alias("status"), supported.alias("supported_claims"), total.alias("total_claims"))


def answers(questions: DataFrame, retrieved: DataFrame, generate: Callable[[DataFrame], DataFrame], min_confidence: float | None = None) -> DataFrame:
    """question_id, refused, reason, answer, cited, grounding, suggestions for every question (question_id, question).

    A question is refused without context, with a best score under min_confidence, or if
    what the generator says holds SENTINEL; generate takes (question_id, question,
    prompt_context) and adds answer. Marks out of range are removed from answers; cited are
    the others, in order. Refusals cite nothing, are ungrounded and come with suggestions.
    """
    rows = questions.join(context_blocks(retrieved), "question_id", "left")
    low = F.lit(False) if min_confidence is None else F.coalesce(F.col("best") < min_confidence, F.lit(False))
    rows = rows.withColumn("early", F.when(F.col("n").isNull(), NO_RECORDS).when(low, LOW_SCORE))
    made = generate(rows.where("early is null").select("question_id", "question", "prompt_context")).select("question_id", "answer")
    rows = rows.join(made, "question_id", "left")
    reason = F.coalesce("early", F.when(F.coalesce(F.contains("answer", F.lit(SENTINEL)), F.lit(True)), NOT_COVERED))
    rows = rows.withColumn("reason", reason).withColumn("kept", F.when(reason.isNull(), without_bad_markers(F.col("answer"), F.col("n"))))
    rows = rows.withColumn("ground", grounding(F.col("kept"), F.col("n")))
    return rows.select(
        "question_id", F.col("reason").isNotNull().alias("refused"), "reason", F.col("kept").alias("answer"),
        F.when(F.col("reason").isNull(), valid_markers(F.col("kept"), F.col("n"))).otherwise(F.array().cast("array<int>")).alias("cited"),
        F.col("ground").alias("grounding"), F.when(F.col("reason").isNotNull(), suggestions(F.col("question"))).alias("suggestions"),
    )


def retrieved_rows(retrieved: DataFrame, answered: DataFrame) -> DataFrame:
    """Retrieved rows with a snippet and whether the answer cites them."""
    rows = retrieved.join(answered.select("question_id", "cited"), "question_id", "left")
    return rows.withColumn("cited", F.coalesce(F.array_contains("cited", F.col("rank").cast("int")), F.lit(False))).withColumn("snippet", head_snippet(F.col("text")))


def bad_letter_citations(letters: DataFrame, docs: DataFrame) -> DataFrame:
    """letter_id, span, doc_id of quotations that their document doesn't hold verbatim."""
    rows = letters.select("letter_id", F.explode(letter_citations(F.col("letter"))).alias("c"))
    rows = rows.select("letter_id", F.col("c.span").alias("span"), F.col("c.doc_id").alias("doc_id"))
    joined = rows.join(docs.select(F.col("id").alias("doc_id"), "text"), "doc_id", "left")
    return joined.where(F.coalesce(~F.contains("text", "span"), F.lit(True))).select("letter_id", "span", "doc_id")
