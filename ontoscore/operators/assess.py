"""The authoritative response assessment: compliance, completion, relevance and refusal from one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoscore.fixed import K
from ontoscore.functions import text as T


def relevance(col: Column) -> Column:
    """Three-valued: relevant, irrelevant, anything else unknown."""
    return F.when(col == "relevant", F.lit(True)).when(col == "irrelevant", F.lit(False))


def authoritative(semantic: DataFrame, metadata: DataFrame, normalise: bool = True) -> DataFrame:
    """semantic: the triple, relevance, refusal_detected, parse_status, alternative_causal_frame; metadata: one row per response_id with
    response_text, word_limit, format_compliant_deterministic, finish_reason, provider_refusal, provider_filtered.

    normalise: bring texts to NFC first (an Arrow function); without it the plan has no Python.
    """
    d = semantic.join(metadata, "response_id")
    d = d.withColumn("_text", T.normalised(F.col("response_text")) if normalise else T.newlines(F.col("response_text")))
    d = d.withColumn("word_count", T.word_count(F.col("_text")))
    truncated = F.coalesce(F.col("finish_reason").isin("length", "max_tokens"), F.lit(False))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    return d.select(
        *K,
        "word_count",
        (F.col("word_count") <= F.col("word_limit")).alias("within_response_budget"),
        true("format_compliant_deterministic").alias("format_compliant"),
        truncated.alias("truncated"),
        (~truncated & ~true("provider_filtered") & (T.stripped(F.col("_text")) != "")).alias("response_complete"),
        relevance(F.col("relevance")).alias("relevance"),
        (true("provider_refusal") | true("refusal_detected")).alias("refusal"),
        "parse_status",
        "alternative_causal_frame",
    )


def relevance_claims(assessment: DataFrame) -> DataFrame:
    """The claim rows that stand for the relevance of each extraction."""
    r = F.col("relevance")
    status = F.when(r.isNull(), "not_assessable").when(r, "true").otherwise("false")
    disposition = F.when(r.isNull(), "not_assessable").when(r, "instantiated").otherwise("omitted")
    none = F.array().cast("array<string>")
    return assessment.select(
        *K, F.lit("accuracy").alias("feature_group"), F.lit("answer_relevant_to_question").alias("feature_id"), F.lit("secondary_afforded").alias("opportunity_class"),
        status.alias("status"), disposition.alias("disposition"), F.lit("descriptive").alias("stance"), F.lit("background").alias("causal_role"),
        none.alias("actor_or_relation"), none.alias("evidence"), F.lit(False).alias("complete_proposition_evidence"), F.lit("high").alias("confidence"),
    )
