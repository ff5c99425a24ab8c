"""Votes of several judges on one observation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoscore.fixed import CONFIDENCE_WEIGHTS, RUBRIC_VERSION
from ontoscore.functions.ident import uuid5

LABEL = ["status", "disposition", "stance", "causal_role"]


def disagreements(claims: DataFrame) -> DataFrame:
    """Observations whose judges differ on the feature's group or class."""
    return claims.groupBy("response_id", "feature_id").agg(F.count_distinct("feature_group").alias("groups"), F.count_distinct("opportunity_class").alias("classes")).where("groups <> 1 OR classes <> 1")


def vote(claims: DataFrame, strategy: str = "majority") -> DataFrame:
    """One row per response and feature with the joint label of the most votes; a tie is a canonical unclear one.

    strategy: 'majority' or 'confidence_majority' (low 1, medium 2, high 3). Evidence is joined in the order of source_identifier.
    Two aggregations on one key: votes by label, then labels by observation; the second reuses the first one's partitioning.
    """
    if strategy not in ("majority", "confidence_majority"):
        raise ValueError(f"unknown strategy {strategy}")
    weight = F.lit(1.0)
    if strategy == "confidence_majority":
        weight = F.when(F.lit(False), F.lit(0.0))
        for k, w in CONFIDENCE_WEIGHTS.items():
            weight = weight.when(F.col("confidence") == k, F.lit(float(w)))
    key = ["response_id", "feature_id"]
    rows = claims.repartition(*key)
    votes = rows.groupBy(*key, *LABEL).agg(
        F.sum(weight).alias("score"),
        F.min("feature_group").alias("feature_group"),
        F.min("opportunity_class").alias("opportunity_class"),
        F.collect_list(F.struct("source_identifier", "evidence", "actor_or_relation")).alias("rows"),
        F.min(F.coalesce(F.col("complete_proposition_evidence"), F.lit(False))).alias("complete"),
        F.min(F.coalesce(F.col("confidence") == "high", F.lit(False))).alias("high"),
    )
    best = votes.groupBy(*key).agg(
        F.collect_list(F.struct("score", *LABEL, "rows", "complete", "high")).alias("labels"), F.max("score").alias("top"), F.min("feature_group").alias("feature_group"), F.min("opportunity_class").alias("opportunity_class")
    )
    first = F.filter("labels", lambda x: x["score"] == F.col("top"))
    best = best.withColumn("leaders", first).withColumn("won", F.size("leaders") == 1).withColumn("w", F.col("leaders")[0])
    label = {c: F.when(F.col("won"), F.col(f"w.{c}")).otherwise(F.lit("unclear")).alias(c) for c in LABEL}
    support = F.array_sort(F.when(F.col("won"), F.col("w.rows")).otherwise(F.flatten(F.transform("labels", lambda x: x["rows"]))))
    none = F.array().cast("array<string>")
    return best.withColumn("support", support).select(
        *key, "feature_group", "opportunity_class", *label.values(),
        F.lit("judge_ensemble").alias("extraction_source"), uuid5(F.lit(f"{strategy}:{RUBRIC_VERSION}")).alias("source_identifier"),
        F.flatten(F.transform("support", lambda x: F.coalesce(x["evidence"], none))).alias("evidence"),
        (F.col("won") & F.col("w.complete")).alias("complete_proposition_evidence"),
        F.when(F.when(F.col("won"), F.col("w.high")).otherwise(F.forall("labels", lambda x: x["high"])), "high").otherwise("medium").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("support", lambda x: F.coalesce(x["actor_or_relation"], none))))).alias("actor_or_relation"),
    )
