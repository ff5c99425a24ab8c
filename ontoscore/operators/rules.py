"""Validation as data: each rule gives rows (rule_id, key columns, message). Strict mode raises on the first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoscore.fixed import CAUSAL_ROLES, DISPOSITIONS, EXEMPT_RELATION_VALUES, INFERENCES, JOINT, K, MESSAGES, OUTPUT_KEYS, RELATIONS, RUBRIC_VERSION, SCHEMA_VERSION, STANCES, STATUSES

COLUMNS = [*K, "key", "rule_id", "message"]


def violation(df: DataFrame, rule: str, key: Column, message: str) -> DataFrame:
    have = df.columns
    return df.select(*[F.col(k) if k in have else F.lit(None).cast("string").alias(k) for k in K], key.cast("string").alias("key"), F.lit(rule).alias("rule_id"), F.lit(message).alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def strict(violations: DataFrame) -> None:
    """Raises ValueError with the first violation, if there is one."""
    first = violations.orderBy("rule_id", *K, "key").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['message']}: {first[0]['key']}")


def outside(col: Column, allowed: list[str]) -> Column:
    return col.isNull() | ~col.isin(allowed)


def illegal_pair(status: Column, disposition: Column) -> Column:
    legal = F.lit(False)
    for s, ds in JOINT.items():
        legal = legal | ((status == s) & disposition.isin(ds))
    return ~F.coalesce(legal, F.lit(False))


# ---------------------------------------------------------------- claims


def versions(claims: DataFrame) -> DataFrame:
    bad = ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)) | ~F.col("rubric_version").eqNullSafe(F.lit(RUBRIC_VERSION))
    return violation(claims.where(bad), "VAL1", F.col("feature_id"), "schema/rubric mismatch")


def missing_keys(exports: DataFrame, column: str = "raw_judge_output", keys: list[str] = OUTPUT_KEYS) -> DataFrame:
    """Top-level keys that the JSON text lacks; a key with a null value is there."""
    absent = F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")))
    rows = exports.withColumn("absent", absent).where(F.size("absent") > 0)
    return violation(rows, "VAL2", F.array_join(F.array_sort("absent"), ","), "missing keys")


def enums(claims: DataFrame) -> DataFrame:
    bad = outside(F.col("status"), STATUSES) | outside(F.col("disposition"), DISPOSITIONS) | outside(F.col("stance"), STANCES) | outside(F.col("causal_role"), CAUSAL_ROLES)
    return violation(claims.where(bad), "VAL3", F.col("feature_id"), MESSAGES["enum"])


def joint_labels(claims: DataFrame) -> DataFrame:
    return violation(claims.where(illegal_pair(F.col("status"), F.col("disposition"))), "VAL4", F.col("feature_id"), MESSAGES["joint"])


def duplicates(df: DataFrame, keys: list[str], rule: str, message: str) -> DataFrame:
    counted = df.groupBy(*keys).count().where("`count` <> 1")
    return violation(counted, rule, F.concat_ws("|", *[F.col(k) for k in keys if k not in K]), message)


def against_registry(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims of features that are not registered, or of another group."""
    reg = registry.select(F.col("feature_id").alias("reg_feature"), F.col("feature_group").alias("reg_group"))
    x = claims.join(reg, F.col("feature_id") == F.col("reg_feature"), "left")
    return union([
        violation(x.where("reg_feature IS NULL"), "VAL11", F.col("feature_id"), "feature is not registered"),
        violation(x.where("reg_feature IS NOT NULL AND NOT (feature_group <=> reg_group)"), "VAL11", F.col("feature_id"), "feature group differs from registry"),
    ])


def against_opportunities(claims: DataFrame, opportunities: DataFrame) -> DataFrame:
    plan = opportunities.select("item_family_id", "rubric_version", "feature_id", F.col("opportunity_class").alias("planned"))
    x = claims.join(plan, ["item_family_id", "rubric_version", "feature_id"], "left")
    return union([
        violation(x.where("planned IS NULL"), "VAL12", F.col("feature_id"), MESSAGES["unplanned"]),
        violation(x.where("planned = 'inapplicable'"), "VAL12", F.col("feature_id"), MESSAGES["inapplicable"]),
        violation(x.where("planned <> 'inapplicable' AND NOT (planned <=> opportunity_class)"), "VAL12", F.col("feature_id"), MESSAGES["other_class"]),
    ])


def missing_observations(claims: DataFrame, index: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Planned features of an extraction that it has no claim for. index: the triple and item_family_id."""
    plan = opportunities.where((F.col("rubric_version") == RUBRIC_VERSION) & (F.col("opportunity_class") != "inapplicable")).select("item_family_id", "feature_id")
    expected = index.select(*K, "item_family_id").distinct().join(plan, "item_family_id").select(*K, "feature_id")
    return violation(expected.join(claims.select(*K, "feature_id"), [*K, "feature_id"], "left_anti"), "VAL13", F.col("feature_id"), MESSAGES["missing"])


def unknown_responses(claims: DataFrame, index: DataFrame) -> DataFrame:
    return violation(claims.join(index.select("response_id").distinct(), "response_id", "left_anti"), "VAL42", F.col("response_id"), "claim of an unknown response")


def many_to_one(right: DataFrame, keys: list[str]) -> DataFrame:
    """right, after a check that its keys are unique; raises ValueError."""
    if not right.groupBy(*keys).count().where("`count` > 1").isEmpty():
        raise ValueError(f"keys {keys} are not unique")
    return right


def cause_without_claim(claims: DataFrame) -> DataFrame:
    return violation(claims.where("causal_role = 'cause' AND NOT (status <=> 'true')"), "VAL25", F.col("feature_id"), "cause with a status other than true")


def true_without_evidence(claims: DataFrame, optional: list[str]) -> DataFrame:
    rows = claims.where((F.col("status") == "true") & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0) & ~F.col("feature_group").isin(optional))
    return violation(rows, "VAL26", F.col("feature_id"), "true without evidence")


def claim_order(parsed: DataFrame, order: Column) -> DataFrame:
    """Extractions whose features are not in the order asked for, or whose indices are not 0, 1, ..."""
    c = F.col("output.claims")
    index = F.array_sort(F.transform(c, lambda x: x["claim_index"]))
    n = F.size(c)
    expected = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return union([
        violation(parsed.where(~F.transform(c, lambda x: x["feature_id"]).eqNullSafe(order)), "VAL28", F.lit("order"), "feature order differs from request"),
        violation(parsed.where(~index.eqNullSafe(expected)), "VAL29", F.lit("index"), "claim_index is not contiguous"),
    ])


def minima(parsed: DataFrame, claims_true: int, spans: int, relations: int) -> DataFrame:
    c, r = F.col("output.claims"), F.col("output.relations")
    checks = {
        "true claims": F.size(F.filter(c, lambda x: x["status"] == "true")) < claims_true,
        "evidence spans": F.size(F.filter(F.flatten(F.transform(c, lambda x: F.coalesce(x["evidence"], F.array().cast("array<string>")))), lambda s: s != "")) < spans,
        "relations": F.size(F.filter(r, lambda x: ~x["relation_value"].isin([*EXEMPT_RELATION_VALUES, "indeterminate"]))) < relations,
    }
    return union([violation(parsed.where(bad), "VAL31", F.lit(name), f"too few {name}") for name, bad in checks.items()])


# ---------------------------------------------------------------- relations


def relation_types(relations: DataFrame) -> DataFrame:
    return violation(relations.where(outside(F.col("relation_type"), list(RELATIONS))), "VAL5", F.col("relation_type"), "unknown relation type")


def relation_values(relations: DataFrame) -> DataFrame:
    legal = F.lit(False)
    for t, values in RELATIONS.items():
        legal = legal | ((F.col("relation_type") == t) & F.col("relation_value").isin(values))
    known = relations.where(F.col("relation_type").isin(list(RELATIONS)))
    return violation(known.where(~F.coalesce(legal, F.lit(False))), "VAL6", F.concat_ws("=", "relation_type", "relation_value"), "relation value is not allowed for its type")


def relation_evidence(relations: DataFrame) -> DataFrame:
    """Evidence and claim references, which all types but contradiction recognition (evidence only) need unless the value is exempt."""
    due = ~F.col("relation_value").isin(EXEMPT_RELATION_VALUES)
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return union([
        violation(relations.where(due & empty("evidence")), "VAL7", F.col("relation_type"), "relation lacks evidence"),
        violation(relations.where(due & (F.col("relation_type") != "contradiction_recognition") & (empty("source_claim_indices") | empty("target_claim_indices"))), "VAL7", F.col("relation_type"), "relation lacks claim references"),
    ])


def dangling_references(relations: DataFrame, claims: DataFrame) -> DataFrame:
    refs = relations.select(*K, "relation_type", F.explode(F.array_distinct(F.concat("source_claim_indices", "target_claim_indices"))).alias("claim_index"))
    return violation(refs.join(claims.select(*K, "claim_index"), [*K, "claim_index"], "left_anti"), "VAL8", F.concat_ws("#", "relation_type", "claim_index"), "relation refers to a claim that does not exist")


def relation_completeness(parsed: DataFrame) -> DataFrame:
    types = F.transform(F.col("output.relations"), lambda x: x["relation_type"])
    every = F.array(*[F.lit(t) for t in RELATIONS])
    bad = (F.size(types) != len(RELATIONS)) | (F.size(F.array_except(every, types)) > 0) | (F.size(F.array_except(types, every)) > 0)
    return violation(parsed.where(F.coalesce(bad, F.lit(True))), "VAL30", F.lit("relations"), "relations are not the nine types, once each")


# ---------------------------------------------------------------- facts and evidence


def adequate(facts: DataFrame, packets: DataFrame) -> DataFrame:
    """facts with `adequate`: whether a complete packet with an excerpt and a permitted inference stands behind them."""
    p = packets.select("factual_target_id", "packet_status", "source_excerpt_or_slice", "permitted_inference")
    good = (F.col("packet_status") == "complete") & (F.coalesce(F.length("source_excerpt_or_slice"), F.lit(0)) > 0) & F.col("permitted_inference").isin(INFERENCES)
    return facts.join(p, "factual_target_id", "left").withColumn("adequate", F.coalesce(good, F.lit(False)))


def factual_gate(facts: DataFrame, claims: DataFrame, packets: DataFrame) -> DataFrame:
    x = adequate(facts, packets)
    used = violation(x.where("NOT adequate AND NOT (status <=> 'not_assessable')"), "VAL15", F.col("factual_target_id"), MESSAGES["packet"])
    empirical = claims.where("feature_id = 'empirical_claims_supported' AND NOT (status <=> 'not_assessable')")
    bare = empirical.join(x.where("adequate").select(*K).distinct(), K, "left_anti")
    return used.unionByName(violation(bare, "VAL16", F.col("feature_id"), MESSAGES["support"]))


def verbatim(spans: DataFrame, texts: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Evidence spans that their response's text does not contain. spans: the triple, key, span; texts: response_id, text."""
    form = normalise or (lambda c: c)
    x = spans.join(texts.select("response_id", form(F.col("text")).alias("text")), "response_id", "left")
    bad = ~F.coalesce(F.contains(F.col("text"), form(F.col("span"))), F.lit(False))
    return violation(x.where(bad), "VAL22" if normalise else "VAL23", F.col("key"), "evidence is not in the response")


def in_bank(spans: DataFrame, banks: DataFrame) -> DataFrame:
    """Spans outside their feature's evidence bank. banks: feature_id, bank (array)."""
    x = spans.join(banks, "feature_id", "left")
    return union([
        violation(x.where("bank IS NULL"), "VAL24", F.col("feature_id"), "feature has no evidence bank"),
        violation(x.where("bank IS NOT NULL AND NOT array_contains(bank, span)"), "VAL24", F.col("feature_id"), "evidence is not in the feature's bank"),
    ])


def supplied_facts(facts: DataFrame, supplied: DataFrame) -> DataFrame:
    """Facts of targets that were not supplied, and supplied targets without a fact. supplied: the triple, factual_target_id."""
    keys = [*K, "factual_target_id"]
    return union([
        violation(facts.join(supplied.select(*keys), keys, "left_anti"), "VAL32", F.col("factual_target_id"), "factual target was not supplied"),
        violation(supplied.join(facts.select(*keys), keys, "left_anti"), "VAL32", F.col("factual_target_id"), "supplied factual target has no assessment"),
    ])


# ---------------------------------------------------------------- tables


def foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str, rule: str = "VAL42") -> DataFrame:
    p = parent.select(F.col(parent_column).alias(column)).distinct()
    return violation(child.where(F.col(column).isNotNull()).join(p, column, "left_anti"), rule, F.col(column), f"{column} has no parent")


def lock_guard(variants: DataFrame, matrix: DataFrame, n_features: int) -> DataFrame:
    """Families that cannot be locked: three variants, one budget, a whole opportunity matrix. variants: item_family_id, prompt_variant, word_limit."""
    v = variants.groupBy("item_family_id").agg(F.count_distinct("prompt_variant").alias("v"), F.count_distinct("word_limit").alias("b"))
    m = matrix.groupBy("item_family_id").agg(F.count_distinct("feature_id").alias("m"))
    x = v.join(m, "item_family_id", "full")
    checks = {"variants": F.coalesce(F.col("v"), F.lit(0)) != 3, "budget": F.coalesce(F.col("b"), F.lit(0)) != 1, "matrix": F.coalesce(F.col("m"), F.lit(0)) != n_features}
    return union([violation(x.where(bad), "VAL38", F.concat_ws(":", "item_family_id", F.lit(name)), f"{name} incomplete") for name, bad in checks.items()])


def closed_world(families: DataFrame, features: DataFrame, assigned: DataFrame) -> DataFrame:
    """The whole matrix: what is assigned, and `inapplicable` for every other family and feature. families and features are registries."""
    pairs = families.select("item_family_id").distinct().crossJoin(F.broadcast(features.select("feature_id").distinct()))
    rest = pairs.join(assigned, ["item_family_id", "feature_id"], "left_anti").withColumn("opportunity_class", F.lit("inapplicable"))
    return assigned.select("item_family_id", "feature_id", "opportunity_class").unionByName(rest)


def changed_rows(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys of an append-only table that have more than one content."""
    return violation(rows.groupBy(key).agg(F.count_distinct(digest).alias("n")).where("n > 1"), "SNK6", F.col(key), "immutable row was changed")


def exclusive_subject(extractions: DataFrame) -> DataFrame:
    """Extractions that name both a response and a validation case, or neither."""
    return violation(extractions.where(F.col("response_id").isNull() == F.col("validation_case_id").isNull()), "VAL41", F.col("extraction_id"), "exactly one subject is needed")


def attempt_chain(runs: DataFrame) -> DataFrame:
    """Attempt 0 has no predecessor, later ones have one."""
    return violation(runs.where((F.col("attempt_index") == 0) != F.col("retry_of").isNull()), "VAL41", F.col("run_id"), "attempt and retry do not agree")


def complete_packets(packets: DataFrame) -> DataFrame:
    """Packets that call themselves complete but lack sources or a reference answer. packets: factual_target_id, packet_status, sources, reference (JSON texts)."""
    empty = lambda c: F.coalesce(F.regexp_replace(F.col(c), r"\s", ""), F.lit("null")).isin("{}", "[]", "null", "")
    bad = (F.col("packet_status") == "complete") & (empty("sources") | empty("reference"))
    return violation(packets.where(bad), "VAL41", F.col("factual_target_id"), "a complete packet lacks its contents")


def negative(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with a number below 0 in one of the columns that count or measure; nulls are allowed."""
    bad = F.coalesce(F.least(*[F.col(c).cast("double") for c in columns], F.lit(0.0)) < 0, F.lit(False))
    return violation(rows.where(bad), "VAL41", F.col(key), "a count or measure is negative")


def packet_evidence(facts: DataFrame, responses: DataFrame, packets: DataFrame) -> DataFrame:
    """Facts that are assessed although their packet is not complete, and evidence that neither the response nor the packet holds.

    facts: the triple, factual_target_id, status, evidence; responses: response_id, text; packets: factual_target_id, packet_status,
    packet (JSON text).
    """
    x = facts.join(packets.select("factual_target_id", "packet_status", "packet"), "factual_target_id", "left").join(responses.select("response_id", "text"), "response_id", "left")
    within = lambda c, s: F.coalesce(F.contains(F.col(c), s), F.lit(False))
    stray = F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda s: (s != "") & ~within("text", s) & ~within("packet", s))
    return union([
        violation(x.where(~F.col("packet_status").eqNullSafe(F.lit("complete")) & ~F.col("status").eqNullSafe(F.lit("not_assessable"))), "VAL33", F.col("factual_target_id"), "assessed although its packet is not complete"),
        violation(x.select("*", F.explode(stray).alias("span")), "VAL33", F.col("span"), "evidence is neither in the response nor in the packet"),
    ])


def first_errors(violations: DataFrame, limit: int = 100) -> DataFrame:
    """The violations that a report shows: the first by rule and keys."""
    return violations.orderBy("rule_id", *K, "key", "message").limit(limit)


# ---------------------------------------------------------------- rows of runs


def claim_count(rows: DataFrame) -> DataFrame:
    """rows: the triple, n_claims, primary_feature_count, secondary_feature_count, monitor_feature_count. A sum of 0 asks for nothing."""
    due = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("secondary_feature_count", "monitor_feature_count")), F.coalesce("primary_feature_count", F.lit(0)))
    return violation(rows.where((due != 0) & ~F.col("n_claims").eqNullSafe(due)), "VAL27", F.concat_ws("/", F.col("n_claims").cast("string"), due.cast("string")), "claims length differs from the counts asked for")


def semantic_fields(semantic: DataFrame) -> DataFrame:
    bad = outside(F.col("relevance"), ["relevant", "irrelevant", "unclear"]) | F.col("refusal_detected").isNull()
    return violation(semantic.where(bad), "VAL34", F.coalesce("relevance", F.lit("null")), "semantic assessment is not valid")


def hidden_failures(outputs: DataFrame, reduced: DataFrame, strict_jobs: bool = False) -> DataFrame:
    """Failed jobs that their reduced row does not name; in strict mode all failed jobs. reduced: custom_id, failed_jobs (structs with job_id)."""
    failed = outputs.where(~F.coalesce(F.col("ok"), F.lit(False))).select("custom_id", "job_id").distinct()
    named = reduced.select("custom_id", F.explode("failed_jobs.job_id").alias("job_id"))
    hidden = violation(failed.join(named, ["custom_id", "job_id"], "left_anti"), "VAL35", F.col("job_id"), "failed job is not surfaced")
    return hidden.unionByName(violation(failed, "VAL35", F.col("job_id"), "job failed")) if strict_jobs else hidden


def identity(reduced: DataFrame, requests: DataFrame) -> DataFrame:
    """Reduced rows without a request, or with another family or request hash. Both: custom_id, item_family_id, request_body_sha256."""
    r = requests.select("custom_id", F.col("item_family_id").alias("f"), F.col("request_body_sha256").alias("h"), F.lit(True).alias("known"))
    x = reduced.join(r, "custom_id", "left")
    return union([
        violation(x.where("known IS NULL"), "VAL36", F.col("custom_id"), "no matching request"),
        violation(x.where("known AND NOT (item_family_id <=> f)"), "VAL36", F.col("custom_id"), "family differs from request"),
        violation(x.where("known AND NOT (request_body_sha256 <=> h)"), "VAL36", F.col("custom_id"), "request hash differs"),
    ])


def row_status(rows: DataFrame, strict_rows: bool) -> DataFrame:
    """Runner rows that are not ok, with severity: error in strict mode, else warning."""
    bad = violation(rows.where(~F.coalesce(F.col("ok"), F.lit(False))), "VAL37", F.col("custom_id"), "runner row is not ok")
    return bad.withColumn("severity", F.lit("error" if strict_rows else "warning"))


def matrix_size(matrix: DataFrame, families: DataFrame, features: DataFrame) -> DataFrame:
    """n_expected and n_rows of the opportunity matrix; counts only, no pairs."""
    f, g, m = (df.select(c).distinct().agg(F.count("*").alias(n)) for df, c, n in ((families, "item_family_id", "f"), (features, "feature_id", "g"), (matrix.select(F.concat_ws("|", "item_family_id", "feature_id").alias("p")), "p", "n_rows")))
    return f.join(g, F.lit(True)).join(m, F.lit(True)).select((F.col("f") * F.col("g")).alias("n_expected"), "n_rows")


def parse_status(rows: DataFrame, response: str, judged: str) -> DataFrame:
    """rows with parse_status: how far the judge's answer can be used. response: the transport's JSON text; judged: the answer's."""
    keys = F.coalesce(F.json_object_keys(judged), F.array().cast("array<string>"))
    whole = F.size(F.array_except(F.array(*[F.lit(k) for k in OUTPUT_KEYS]), keys)) == 0
    same = F.get_json_object(judged, "$.schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)) & F.get_json_object(judged, "$.rubric_version").eqNullSafe(F.lit(RUBRIC_VERSION))
    status = (
        F.when(F.col(response).isNull(), "request_failed")
        .when(F.try_parse_json(response).isNull(), "raw_response_json_failed")
        .when(F.json_object_keys(judged).isNull(), "judge_json_failed")
        .when(~(whole & same), "judge_schema_failed")
        .otherwise("ok")
    )
    return rows.withColumn("parse_status", status)
