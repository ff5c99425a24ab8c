"""Schemas of requests against plain dictionaries, const against enum, and what the checks find."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ontoscore.fixed import CAUSAL_ROLES, DISPOSITIONS, OUTPUT_KEYS, RELATION_VERSION, RELATIONS, STANCES
from ontoscore.operators import evidence, schemas
from ontoscore.plans import schema_queries

SCHEMA = f"custom_id string, features array<{schemas.FEATURE}>, union_bank array<string>, packets array<struct<factual_target_id:string,factual_target_version_id:string>>, base string"


def whole(**properties):
    return {"type": "object", "additionalProperties": False, "properties": properties, "required": list(properties)}


def one_of(values, kind="string"):
    return {"type": kind, "enum": list(values)}


def span(bank):
    return {"type": "string", "maxLength": 220} | ({"enum": bank} if bank else {})


def claim(i, f, affirmed):
    bank, asked = f[3] or [], affirmed and f[1] != "accuracy"
    held = {"type": "array", "maxItems": 0} if not bank else {"type": "array", "maxItems": 1, "items": span(bank)} | ({"minItems": 1} if asked else {})
    return whole(
        claim_index=one_of([i], "integer"), feature_group=one_of([f[1]]), feature_id=one_of([f[0]]), opportunity_class=one_of([f[2]]),
        status=one_of(["true"] if affirmed else ["false", "unclear", "not_applicable", "not_assessable"]), disposition=one_of(DISPOSITIONS[:1] if affirmed else DISPOSITIONS[1:]),
        stance=one_of(STANCES), causal_role=one_of(CAUSAL_ROLES if affirmed else ["background", "unclear"]), actor_or_relation={"type": "array", "maxItems": 2, "items": {"type": "string", "maxLength": 40}},
        evidence=held, complete_proposition_evidence={"type": "boolean"}, confidence=one_of(["low", "medium", "high"]),
    )


def rewritten(value):
    if isinstance(value, list):
        return [rewritten(v) for v in value]
    return {("enum" if k == "const" else k): ([v] if k == "const" else rewritten(v)) for k, v in value.items()} if isinstance(value, dict) else value


def plain(features, union, packets, base):
    union, packets, n = union or [], packets or [], len(features)
    items = [claim(i, f, False) if not f[3] and f[1] != "accuracy" else {"anyOf": [claim(i, f, True), claim(i, f, False)]} for i, f in enumerate(features)]
    relation = whole(
        relation_registry_version=one_of([RELATION_VERSION]), relation_type=one_of(RELATIONS), relation_value=one_of(sorted({v for x in RELATIONS.values() for v in x})),
        source_claim_indices={"type": "array", "maxItems": 3, "items": {"type": "integer", "minimum": 0}}, target_claim_indices={"type": "array", "maxItems": 3, "items": {"type": "integer", "minimum": 0}},
        evidence={"type": "array", "maxItems": 1, "items": span(union)}, confidence=one_of(["low", "medium", "high"]),
    )
    fact = whole(
        factual_target_version_id=one_of(p[1] for p in packets), factual_target_id=one_of(p[0] for p in packets), status=one_of(schemas.FACT_STATUSES),
        claim_text={"type": ["string", "null"], "maxLength": 160}, evidence={"type": "array", "maxItems": 1, "items": span(union)}, confidence=one_of(["low", "medium", "high"]),
    )
    out = rewritten(json.loads(base)) if base else {}
    out.setdefault("type", "object")
    out["additionalProperties"] = False
    made = {"claims": {"type": "array", "minItems": n, "maxItems": n, "prefixItems": items, "items": False}, "relations": {"type": "array", "minItems": 9, "maxItems": 9, "items": relation}}
    made["factual_assessments"] = {"type": "array", "minItems": len(packets), "maxItems": len(packets), "items": fact} if packets else {"type": "array", "maxItems": 0}
    out["properties"] = out.get("properties", {}) | made
    out["required"] = out.get("required", []) + [k for k in OUTPUT_KEYS if k not in out.get("required", [])]
    return json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


BASE = '{"type":"object","$defs":{"const":{"const":[1,{"const":2}]}},"properties":{"schema_version":{"const":"v1 \\"const\\": \\\\"},"claims":{"const":3},"l":[{"const" : null},{"const":[]}],"é":{"type":"string"}},"required":["zz","claims"],"title":"T"}'
ROWS = [
    ("a", [("f0", "g", "primary", ["s1", 'é"q\\', "line\nbreak"]), ("f1", "g", "monitor_only", []), ("f2", "accuracy", "primary", []), ("f3", "accuracy", "primary", ["x"])], ["s1", 'é"q\\'], [("T0", "v0"), ("T1", "v1")], BASE),
    ("b", [("f0", "g", "p", None)], None, None, None),
    ("c", [], [], [], '{"properties":{}}'),
    ("d", [(f"f{i}", "g", "p", ["s"]) for i in range(3)], [str(i) for i in range(10)], [("none", "v")], None),
    ("e", [(f"f{i}", "g", "p", ["s"]) for i in range(3)], [str(i) for i in range(10)], [("T", None)], None),
    ("f", [(f"f{i}", "g", "p", ["s"] * (i > 0)) for i in range(3)], [str(i) for i in range(10)], [], None),
    ("g", [(f"f{i}", "g", "p", ["s"]) for i in range(3)], [str(i) for i in range(10)], [], None),
]


def test_schemas_equal_plain_dictionaries(spark):
    got = {r["custom_id"]: r for r in schemas.with_schema(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    for i, *args in ROWS:
        assert got[i]["schema_json"] == plain(*args)
    assert [got[i]["schema_error"] for i in "abcdefg"] == ["too few spans: 2", "too few spans: 0", "too few spans: 0", "packet without a target", "packet without a version", "too few banks: 2", None]


def test_base_that_is_no_object_counts_as_none(spark):
    rows = [(i, [], [], [], base) for i, base in enumerate(["nope", "[1]", "3", None])]
    got = schemas.with_schema(spark.createDataFrame(rows, SCHEMA.replace("custom_id string", "custom_id int"))).collect()
    assert {r["schema_json"] for r in got} == {plain([], [], [], None)}


def test_checks(spark):
    made = schemas.with_schema(spark.createDataFrame(ROWS, SCHEMA)).cache()
    assert schemas.schema_violations(made).collect() == []
    spoil = {'"maxItems":4,"minItems":4': "number of claims is not pinned", '"items":false': "further claims are allowed", '"enum":["f1"]': "feature is not pinned", '"causal_role"': "object is not complete"}
    for text, message in spoil.items():
        bad = made.where("custom_id = 'a'").withColumn("schema_json", F.replace("schema_json", F.lit(text), F.lit(text.replace("4", "5").replace("false", "true").replace("f1", "f9").replace("causal", "other"))))
        assert message in {r["message"] for r in schemas.schema_violations(bad).collect()}
    gone = made.where("custom_id = 'a'").withColumn("schema_json", F.lit(None).cast("string"))
    assert [tuple(r) for r in schemas.schema_violations(gone).collect()] == [("a", None, "no schema")]
    fewer = made.where("custom_id = 'a'").withColumn("features", F.slice("features", 1, 3))
    assert {r["message"] for r in schemas.schema_violations(fewer).collect()} == {"number of claims is not pinned", "claims are not a tuple of the features", "feature is not pinned"}


@pytest.mark.parametrize("value", [
    {"const": 1}, {"a": {"const": {"const": 1}}}, [{"const": []}, {"const": {}}, {"x": {"const": "const"}}], {"const": ["const", {"const": [1, [2]]}], "z": {"const": None}},
    {"s": 'say "const": \\" \\\\', "const": 'a "const":\\'}, "const", 3, None, [], {}, {"const ": 1, "xconst": {"const": True}},
])
def test_const_becomes_enum(spark, value):
    for text in (json.dumps(value), json.dumps(value, indent=2, ensure_ascii=False)):
        got = schemas.enumerated(spark.createDataFrame([(text, 1), (text, 2), (None, 3), ("{", 4)], "raw string, _end int"), "raw", "out").collect()
        assert [json.loads(r["out"]) if r["raw"] == text else r["out"] for r in sorted(got, key=lambda r: r["_end"])] == [rewritten(value)] * 2 + [None, None]


def test_own_banks(spark):
    """The registered query over whole documents: schemas equal those of plain dictionaries from the same banks."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("response_id"), "text")
    banks = {}
    for r in evidence.build_banks(docs, {f: c for f, (_, c) in schema_queries.CUES.items()}, optional=("avoids_category_error",)).collect():
        banks.setdefault(r["response_id"], {})[r["feature_id"]] = r["bank"]
    want = {}
    for i, own in banks.items():
        text = plain([(f, g, "primary", own[f]) for f, (g, _) in schema_queries.CUES.items()], own[""], None, None)
        n, filled = len(own[""]), sum(bool(own[f]) for f in schema_queries.CUES)
        want[i] = hashlib.md5(text.encode()).hexdigest(), f"too few spans: {n}" if n < 10 else f"too few banks: {filled}" if filled < 3 else None
    assert {r["custom_id"]: (r["schema_md5"], r["schema_error"]) for r in schema_queries.own_schemas(spark, sf).collect()} == want
