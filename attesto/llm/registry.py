"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from ._common import table
from .chat import chat_format
from .langid import language_id
from .lexical import ranked
from .licenses import KNOWN, license_scan
from .mixing import mixed, weight_table
from .near_dedup import near_duplicates
from .packing import packed
from .pieces import Vocabulary, encoded
from .quality import ablations, quality_rules
from .secrets import RULES, secret_scan, update
from .sequenced import applied
from .suffix_dedup import repeats_removed
from .topk import top_k


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents")).drop("kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs, weights=weight_table(spark)).drop("text", "n_chars")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger grows in two steps: English documents under the first rules, then all documents under all rules."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan(docs, update(docs.where("lang = 'en'"), rules=RULES[:3]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return chat_format(rows.unionByName(more))


def op11_change_applier(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("change_id").cast("string"))
    day = F.unix_date(F.to_date("valid_at")) + 9 * (h % 4)
    found = applied(table(spark, sf_dir, "client_changes"), day, h % 11 != 0, first_day=19723, days=160)
    return found.withColumn("cents", F.floor(100 * F.col("balance") + 0.5)).drop("balance")


def op12_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    found = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), Vocabulary.load(model))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 50)


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(table(spark, sf_dir, "documents"))


def suffix_dedup_by_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 returns, by the merge of suffix runs alone: no whole copies or periodic stretches are decided before it."""
    return repeats_removed(table(spark, sf_dir, "documents"), shortcuts=False).drop("kept")


def license_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole licence texts, wrapped at several widths behind a copyright line."""
    rows = []
    for _, body in KNOWN:
        for width in (60, 72, 79):
            lines = [x for part in body.split("\n") for x in (textwrap.wrap(part, width, break_on_hyphens=False, break_long_words=False) or [""])]
            rows.append((len(rows), "\n".join(["Copyright (c) 2021 Jane Doe", "", *lines])))
    return license_scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license", "n_copyright_lines")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_suffix_dedup, op3_license_scan, op4_mixing, op5_exact_top_k,
        op6_quality_rules, op7_secret_scan, op8_language_id, op9_near_dedup, op10_chat_format,
        op11_change_applier, op12_sentencepiece, op13_lexical_search,
        quality_ablation, suffix_dedup_by_merge, license_fixture,
    )
}

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op3_license_scan": oracles.LICENSE_SCAN,
    "op4_mixing": oracles.MIXING,
    "op5_exact_top_k": oracles.TOP_K,
    "op6_quality_rules": oracles.QUALITY_RULES,
    "op7_secret_scan": oracles.SECRET_SCAN,
    "op9_near_dedup": oracles.NEAR_DEDUP,
    "op10_chat_format": oracles.CHAT_FORMAT,
    "op11_change_applier": oracles.CHANGE_APPLIER,
    "op13_lexical_search": oracles.LEXICAL_SEARCH,
    "suffix_dedup_by_merge": oracles.SUFFIX_DEDUP,
    "quality_ablation": oracles.ABLATIONS,
    "license_fixture": oracles.LICENSE_FIXTURE,
}
