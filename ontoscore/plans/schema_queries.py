"""Queries of the request patcher: schemas of every response, the checks on them, and const rewritten as enum."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoscore.fixed import CAUSAL_ROLES, DISPOSITIONS, OUTPUT_KEYS, RELATION_VERSION, RELATIONS, RUBRIC_VERSION, STANCES
from ontoscore.operators import evidence, schemas
from ontoscore.plans.overlay import with_
from ontoscore.plans.queries import dealt, query, table, view

# What the SQL fills in: templates of JSON text, with places between @ signs.


def _json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":")).replace("'", "''")


def _whole(properties: dict) -> dict:
    return {"additionalProperties": False, "properties": properties, "required": list(properties), "type": "object"}


def _enum(*values: str, kind: str = "string") -> dict:
    return {"enum": list(values), "type": kind}


def _claim(affirmed: bool) -> str:
    return _json(_whole({
        "claim_index": _enum("@i@", kind="integer"), "feature_group": _enum("@group@"), "feature_id": _enum("@id@"), "opportunity_class": _enum("@class@"),
        "status": _enum(*(["true"] if affirmed else ["false", "unclear", "not_applicable", "not_assessable"])),
        "disposition": _enum(*(DISPOSITIONS[:1] if affirmed else DISPOSITIONS[1:])), "stance": _enum(*STANCES), "causal_role": _enum(*(CAUSAL_ROLES if affirmed else ["background", "unclear"])),
        "actor_or_relation": {"type": "array", "maxItems": 2, "items": {"type": "string", "maxLength": 40}}, "evidence": "@affirmed@" if affirmed else "@denied@",
        "complete_proposition_evidence": {"type": "boolean"}, "confidence": _enum("low", "medium", "high"),
    }))


SPAN = {"type": "array", "maxItems": 1, "items": "@span@"}
INDICES = {"type": "array", "maxItems": 3, "items": {"type": "integer", "minimum": 0}}
RELATION = _json({"type": "array", "minItems": 9, "maxItems": 9, "items": _whole({
    "relation_registry_version": _enum(RELATION_VERSION), "relation_type": _enum(*RELATIONS), "relation_value": _enum(*sorted({v for x in RELATIONS.values() for v in x})),
    "source_claim_indices": INDICES, "target_claim_indices": INDICES, "evidence": SPAN, "confidence": _enum("low", "medium", "high"),
})})
FACT = _json({"type": "array", "minItems": 2, "maxItems": 2, "items": _whole({
    "factual_target_version_id": _enum("T0v1", "T1v1"), "factual_target_id": _enum("T0", "T1"), "status": _enum(*schemas.FACT_STATUSES),
    "claim_text": {"type": ["string", "null"], "maxLength": 160}, "evidence": SPAN, "confidence": _enum("low", "medium", "high"),
})})


def _replaced(template: str, **places: str) -> str:
    out = f"'{template}'"
    for name, value in places.items():
        out = f"""replace({out}, '"@{name}@"', {value})"""
    return out


#: Names stand in quotes that stay; numbers and objects do not.
PLACES = {"i": "CAST(i AS VARCHAR)", "group": """'"' || feature_group || '"'""", "id": """'"' || feature_id || '"'""", "class": """'"' || opportunity_class || '"'"""}
HELD = """'{"items":{"enum":["' || span || '"],"maxLength":220,"type":"string"},"maxItems":1,'"""
EMPTY = """'{"maxItems":0,"type":"array"}'"""
AFFIRMED = f"""CASE WHEN status <> 'true' THEN {EMPTY} WHEN feature_group = 'accuracy' THEN {HELD} || '"type":"array"}}' ELSE {HELD} || '"minItems":1,"type":"array"}}' END"""
NOT_AFFIRMED = f"""CASE WHEN status <> 'true' THEN {EMPTY} ELSE {HELD} || '"type":"array"}}' END"""
SCHEMAS = f"""{with_('claims')},
c AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY claim_index, feature_id) - 1 AS i FROM claims WHERE source_identifier = 'j0'),
b AS (SELECT *, {_replaced(_claim(True), **PLACES, affirmed=AFFIRMED)} AS yes, {_replaced(_claim(False), **PLACES, denied=NOT_AFFIRMED)} AS no, status <> 'true' AND feature_group <> 'accuracy' AS alone FROM c),
s AS (
  SELECT response_id, any_value(item_family_id) AS family, any_value(ai_eligible) AS eligible, count(*) AS n, count(*) FILTER (WHERE status = 'true') AS banks,
    string_agg(CASE WHEN alone THEN no ELSE '{{"anyOf":[' || yes || ',' || no || ']}}' END, ',' ORDER BY i) AS items,
    list_sort(list_distinct(list(span) FILTER (WHERE status = 'true'))) AS spans FROM b GROUP BY response_id),
u AS (SELECT *, CASE WHEN coalesce(len(spans), 0) > 0 THEN '{{"enum":["' || array_to_string(spans, '","') || '"],"maxLength":220,"type":"string"}}' ELSE '{{"maxLength":220,"type":"string"}}' END AS span FROM s),
schemas AS (
  SELECT response_id, n, eligible, '{{"additionalProperties":false,"properties":{{"claims":{{"items":false,"maxItems":' || n || ',"minItems":' || n || ',"prefixItems":[' || items || '],"type":"array"}},"factual_assessments":'
    || CASE WHEN eligible THEN {_replaced(FACT, span='span')} ELSE '{{"maxItems":0,"type":"array"}}' END || ',"item_family_id":{{"enum":["' || family || '"]}},"relations":' || {_replaced(RELATION, span='span')}
    || ',"rubric_version":{{"enum":["{RUBRIC_VERSION}"]}}}},"required":{_json(OUTPUT_KEYS)},"title":"judge","type":"object"}}' AS schema_json,
    CASE WHEN coalesce(len(spans), 0) < 10 THEN 'too few spans: ' || coalesce(len(spans), 0) WHEN banks < 3 THEN 'too few banks: ' || banks END AS schema_error FROM u)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each response: the first judge's spans are the banks of the features that it affirms."""
    c = view(spark, sf_dir, "claims").where("source_identifier = 'j0'")
    span = F.when(F.col("status") == "true", F.col("span"))
    feature = F.struct("claim_index", "feature_id", "feature_group", "opportunity_class", F.array_compact(F.array(span)).alias("bank"))
    x = c.groupBy("response_id").agg(F.first("item_family_id").alias("family"), F.first("ai_eligible").alias("eligible"), F.array_sort(F.collect_list(feature)).alias("f"), F.array_sort(F.collect_set(span)).alias("union_bank"))
    packets = F.array(*[F.struct(F.lit(t).alias("factual_target_id"), F.lit(f"{t}v1").alias("factual_target_version_id")) for t in ("T0", "T1")])
    base = F.concat(F.lit('{"title": "judge", "properties": {"rubric_version": {"const": "' + RUBRIC_VERSION + '"}, "claims": {"const": []}, "item_family_id": {"const": '), schemas.quoted(F.col("family")), F.lit("}}}"))
    features = F.transform("f", lambda f: F.struct(f["feature_id"].alias("feature_id"), f["feature_group"].alias("feature_group"), f["opportunity_class"].alias("opportunity_class"), f["bank"].alias("bank")))
    return x.select(F.col("response_id").alias("custom_id"), features.alias("features"), "union_bank", F.when(F.col("eligible"), packets).alias("packets"), base.alias("base"))


@query("q_DOM11_schema", f"{SCHEMAS} SELECT response_id AS custom_id, md5(schema_json) AS schema_md5, schema_error FROM schemas")
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of every response's request, and whether its evidence is enough."""
    return schemas.with_schema(_requests(spark, sf_dir)).select("custom_id", F.md5(F.col("schema_json").cast("binary")).alias("schema_md5"), "schema_error")


#: Words of the test texts that stand for features here.
CUES = {
    "identifies_wage_dependence": ("material_relation_recognition", ["the", "and"]),
    "identifies_rent_extraction": ("material_relation_recognition", ["ouch"]),
    "identifies_norms_or_culture": ("institutionalist_relation_recognition", ["der", "ung"]),
    "endorses_private_property_as_freedom": ("endorsement", ["que", "los"]),
    "avoids_category_error": ("accuracy", []),
}


def own_requests(responses: DataFrame) -> DataFrame:
    """responses: response_id, text. Requests whose banks are built from the response's own text."""
    optional = tuple(f for f, (group, _) in CUES.items() if group in schemas.NO_EVIDENCE_GROUPS)
    built = evidence.build_banks(responses, {f: cues for f, (_, cues) in CUES.items()}, optional=optional)
    by = built.groupBy(F.col("response_id").alias("custom_id")).agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "bank"))).alias("banks"))
    feature = lambda f, group: F.struct(F.lit(f).alias("feature_id"), F.lit(group).alias("feature_group"), F.lit("primary").alias("opportunity_class"), F.element_at("banks", f).alias("bank"))
    none = F.lit(None)
    packets = none.cast("array<struct<factual_target_id:string,factual_target_version_id:string>>")
    return by.select("custom_id", F.array(*[feature(f, group) for f, (group, _) in CUES.items()]).alias("features"), F.element_at("banks", "").alias("union_bank"), packets.alias("packets"), none.cast("string").alias("base"))


@query("q_DOM11_own")
def own_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas from the banks of every whole document. The choice of spans is greedy, so there is no SQL; compared with plain dictionaries."""
    docs = dealt(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("response_id"), "text"), "response_id")
    return schemas.with_schema(own_requests(docs)).select("custom_id", F.md5(F.col("schema_json").cast("binary")).alias("schema_md5"), "schema_error")


@query("q_VAL47", f"""{SCHEMAS}, h AS (SELECT response_id, n, eligible, substr(md5(response_id), 1, 1) AS d FROM schemas),
e AS (SELECT b.response_id, i, alone, status, feature_group, d FROM b JOIN h USING (response_id))
SELECT response_id AS custom_id, NULL::INTEGER AS place, CASE d WHEN '0' THEN 'further claims are allowed' WHEN '1' THEN 'number of relations is not pinned' WHEN '5' THEN 'facts without packets' ELSE 'no schema' END AS message
FROM h WHERE d IN ('0', '1', '6') OR d = '5' AND NOT eligible
UNION ALL SELECT response_id, CAST(i AS INTEGER), 'index is not pinned' FROM e, range(2) t(k) WHERE d = '2' AND i = 0 AND (k = 0 OR NOT alone)
UNION ALL SELECT response_id, CAST(i AS INTEGER), 'first alternative is not the affirmed one' FROM e WHERE d = '3' AND NOT alone
UNION ALL SELECT response_id, CAST(i AS INTEGER), 'second alternative allows other roles' FROM e WHERE d = '4' AND NOT alone
UNION ALL SELECT response_id, CAST(i AS INTEGER), 'evidence is neither empty nor listed' FROM e, range(2) t(k) WHERE d = '7' AND status = 'true'
UNION ALL SELECT response_id, CAST(i AS INTEGER), 'not two alternatives' FROM e WHERE d = '8' AND NOT alone""")
def broken_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with schemas that were spoilt in one of nine ways, by a digit of the id; how often depends on the response's claims."""
    made = schemas.with_schema(_requests(spark, sf_dir))
    text, d = F.col("schema_json"), F.substring(F.md5(F.col("custom_id").cast("binary")), 1, 1)
    spoilt = [
        ("0", F.replace(text, F.lit('"claims":{"items":false'), F.lit('"claims":{"items":true'))),
        ("1", F.replace(text, F.lit('"maxItems":9'), F.lit('"maxItems":8'))),
        ("2", F.replace(text, F.lit('"claim_index":{"enum":[0]'), F.lit('"claim_index":{"enum":[7]'))),
        ("3", F.replace(text, F.lit('"status":{"enum":["true"]'), F.lit('"status":{"enum":["true","false"]'))),
        ("4", F.replace(text, F.lit('"causal_role":{"enum":["background","unclear"]'), F.lit('"causal_role":{"enum":["background","cause"]'))),
        ("5", F.replace(text, F.lit('"factual_assessments":{"maxItems":0'), F.lit('"factual_assessments":{"maxItems":1'))),
        ("6", F.substring(text, 1, 500)),
        ("7", F.regexp_replace(text, r'"evidence":\{"items":\{"enum":\[[^\]]*\],', '"evidence":{"items":{')),
        ("8", F.replace(text, F.lit('{"anyOf":['), F.lit('{"anyOf":[{},'))),
    ]
    for digit, value in spoilt:
        text = F.when(d == digit, value).otherwise(text)
    found = schemas.schema_violations(made.withColumn("schema_json", text))
    # with a further alternative in front, everything behind it is out of place as well
    return found.where((d != "8") | (F.col("message") == "not two alternatives"))


@query("q_JSON3", """SELECT doc_id, md5('{"b":[{"enum":[' || n_chars || ']},{"enum":[' || coalesce(CAST(to_json(lang) AS VARCHAR), 'null') || ']}],"a":{"enum":[{"const":[' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',{"const":1}]}]},"const_":"const"}') AS schema_md5 FROM documents""")
def enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text with every document's whole text within a constant, rewritten."""
    q = lambda c: schemas.quoted(F.col(c))
    raw = F.concat(F.lit('{"b": [ {"const" : '), "n_chars", F.lit('}, {"const":'), q("lang"), F.lit('}], "a":{"const": {"const":['), q("text"), F.lit(', {"const": 1}]}}, "const_": "const"}'))
    rows = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return schemas.enumerated(rows, "raw", "schema").select("doc_id", F.md5(F.col("schema").cast("binary")).alias("schema_md5"))
