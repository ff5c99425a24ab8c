"""From raw extraction JSON to long tables. The JSON is parsed once, with the fixed schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoscore.fixed import K, OUTPUT

META = ["item_family_id", "model_snapshot_id", "repetition_index", "prompt_variant", "domain", "ai_eligible"]


def parse(exports: DataFrame, column: str = "raw_judge_output") -> DataFrame:
    """exports with the parsed output as struct `output` (null where the text is not a JSON object)."""
    return exports.withColumn("output", F.from_json(F.col(column), OUTPUT))


def _meta(df: DataFrame) -> list[str]:
    return [c for c in [*K, *META] if c in df.columns]


def claim_long(parsed: DataFrame) -> DataFrame:
    """One row per claim; an extraction without claims has none."""
    carried = [*_meta(parsed), F.col("output.schema_version").alias("schema_version"), F.col("output.rubric_version").alias("rubric_version")]
    return parsed.select(*carried, F.inline("output.claims"))


def relation_long(parsed: DataFrame) -> DataFrame:
    return parsed.select(*K, F.inline("output.relations"))


def factual_long(parsed: DataFrame) -> DataFrame:
    return parsed.select(*K, F.inline("output.factual_assessments"))


def semantic_rows(parsed: DataFrame) -> DataFrame:
    """One row per extraction: the semantic assessment and the parse status."""
    return parsed.select(*K, "output.semantic_response_assessment.*", F.col("output.parse_status").alias("parse_status"))


def analysis_long(rows: DataFrame, extractions: DataFrame, runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows by extraction_id with their subject and family: a natural response by its run, a synthetic one by its validation case.

    extractions: extraction_id, response_id, validation_case_id, extraction_source, source_identifier; runs: response_id, item_family_id;
    cases: validation_case_id, response_id, item_family_id.
    """
    c = cases.select(F.col("validation_case_id").alias("case_id"), F.col("response_id").alias("case_response"), F.col("item_family_id").alias("case_family"))
    x = extractions.join(c, F.col("validation_case_id") == F.col("case_id"), "left").withColumn("subject_response", F.coalesce("response_id", "case_response"))
    r = runs.select(F.col("response_id").alias("run_response"), F.col("item_family_id").alias("run_family"))
    x = x.join(r, F.col("subject_response") == F.col("run_response"), "left")
    subject = F.coalesce(F.col("response_id"), F.col("case_response"), F.col("case_id"))
    x = x.select("extraction_id", subject.alias("subject_id"), F.coalesce("run_family", "case_family").alias("item_family_id"), "extraction_source", "source_identifier")
    return rows.join(x, "extraction_id")


def keep(col: Column, keys: list[str]) -> Column:
    """The entries of a map whose keys are listed."""
    return F.map_filter(col, lambda k, _: k.isin(*keys))


def renumber(features: Column) -> Column:
    """Array of structs with their position as field i."""
    return F.transform(features, lambda x, i: F.struct(i.alias("i"), x["feature_id"].alias("feature_id"), x["opportunity_class"].alias("opportunity_class")))


def prefixed(df: DataFrame, prefix: str, keys: list[str] = K) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])
