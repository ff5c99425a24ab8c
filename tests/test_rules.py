import json

import pytest
from pyspark.sql import functions as F

from golden import document, exports
from ontoscore.fixed import K
from ontoscore.functions.text import normalised
from ontoscore.operators import flatten, rules


def tampered(spark, change):
    def one(text):
        d = json.loads(text)
        change(d)
        return json.dumps(d)

    rows = [(*r[:-1], one(r[-1])) for r in exports(spark).collect()[:1]]
    return flatten.parse(spark.createDataFrame(rows, exports(spark).schema))


def messages(df):
    return {r["message"] for r in df.collect()}


def test_clean_documents_pass(spark):
    p = flatten.parse(exports(spark))
    c, r = flatten.claim_long(p), flatten.relation_long(p)
    for found in (rules.versions(c), rules.enums(c), rules.joint_labels(c), rules.duplicates(c, [*K, "feature_id"], "VAL9", "duplicate"), rules.relation_types(r), rules.relation_values(r), rules.relation_evidence(r), rules.dangling_references(r, c), rules.missing_keys(exports(spark)), rules.cause_without_claim(c), rules.true_without_evidence(c, ["accuracy"])):
        assert found.count() == 0
        rules.strict(found)


@pytest.mark.parametrize(("change", "rule", "message"), [
    (lambda d: d.update(rubric_version=None), rules.versions, "schema/rubric mismatch"),
    (lambda d: d["claims"][0].update(stance="sure"), rules.enums, "invalid claim enum"),
    (lambda d: d["claims"][0].update(status="true", disposition="omitted"), rules.joint_labels, "invalid status/disposition pair"),
    (lambda d: d["claims"][0].update(status="maybe"), rules.joint_labels, "invalid status/disposition pair"),
    (lambda d: d["claims"][0].update(causal_role="cause"), rules.cause_without_claim, "cause with a status other than true"),
])
def test_tampered_claims(spark, change, rule, message):
    found = rule(flatten.claim_long(tampered(spark, change)))
    assert messages(found) == {message}
    with pytest.raises(ValueError, match=message.split("/")[0]):
        rules.strict(found)


@pytest.mark.parametrize(("change", "rule", "message"), [
    (lambda d: d["relations"][0].update(relation_type="other"), rules.relation_types, "unknown relation type"),
    (lambda d: d["relations"][0].update(relation_value="absurd"), rules.relation_values, "relation value is not allowed for its type"),
    (lambda d: d["relations"][0].update(evidence=[]), rules.relation_evidence, "relation lacks evidence"),
    (lambda d: d["relations"][0].update(source_claim_indices=[]), rules.relation_evidence, "relation lacks claim references"),
])
def test_tampered_relations(spark, change, rule, message):
    assert messages(rule(flatten.relation_long(tampered(spark, change)))) == {message}


def test_missing_key_and_null_value_differ(spark):
    d = json.loads(document("r0"))
    a = json.dumps({k: v for k, v in d.items() if k != "relations"})
    b = json.dumps(d | {"relations": None})
    df = spark.createDataFrame([("a", "s", "i", a), ("b", "s", "i", b), ("c", "s", "i", "no json")], ", ".join(f"{k} string" for k in K) + ", raw_judge_output string")
    assert {(r["response_id"], r["key"].count(",")) for r in rules.missing_keys(df).collect()} == {("a", 0), ("c", 6)}


def test_claim_order(spark):
    p = tampered(spark, lambda d: d["claims"].pop(0))
    assert {r["rule_id"] for r in rules.claim_order(p, F.array(F.lit("hm"))).collect()} == {"VAL28", "VAL29"}
    none = tampered(spark, lambda d: d.update(claims=[]))
    assert rules.claim_order(none, F.array().cast("array<string>")).count() == 0


def test_relation_completeness_and_minima(spark):
    p = flatten.parse(exports(spark))
    assert messages(rules.relation_completeness(p)) == {"relations are not the nine types, once each"}
    assert rules.minima(p, 1, 1, 1).count() == 0
    assert {r["key"] for r in rules.minima(p, 99, 99, 99).collect()} == {"true claims", "evidence spans", "relations"}


def test_factual_gate(spark):
    key = ", ".join(f"{k} string" for k in K)
    facts = spark.createDataFrame([("r", "s", "i", "t1", "supported"), ("q", "s", "i", "t2", "supported")], key + ", factual_target_id string, status string")
    packets = spark.createDataFrame([("t1", "complete", "text", "causal"), ("t2", "incomplete", "text", "causal")], "factual_target_id string, packet_status string, source_excerpt_or_slice string, permitted_inference string")
    claims = spark.createDataFrame([("r", "s", "i", "empirical_claims_supported", "true"), ("q", "s", "i", "empirical_claims_supported", "true")], key + ", feature_id string, status string")
    assert {(r["response_id"], r["rule_id"]) for r in rules.factual_gate(facts, claims, packets).collect()} == {("q", "VAL15"), ("q", "VAL16")}


def test_verbatim_with_and_without_normalisation(spark):
    spans = spark.createDataFrame([("r", "1", "a\nb"), ("r", "2", "é"), ("r", "3", "zz"), ("gone", "4", "x")], "response_id string, key string, span string")
    texts = spark.createDataFrame([("r", "a\r\nb é")], "response_id string, text string")
    assert {r["key"] for r in rules.verbatim(spans, texts).collect()} == {"1", "2", "3", "4"}
    assert {r["key"] for r in rules.verbatim(spans, texts, normalised).collect()} == {"3", "4"}


def test_closed_world_and_lock(spark):
    families = spark.createDataFrame([("a",), ("b",)], "item_family_id string")
    features = spark.createDataFrame([("x",), ("y",)], "feature_id string")
    assigned = spark.createDataFrame([("a", "x", "primary")], "item_family_id string, feature_id string, opportunity_class string")
    whole = rules.closed_world(families, features, assigned)
    assert whole.count() == 4 and whole.where("opportunity_class = 'inapplicable'").count() == 3
    variants = spark.createDataFrame([("a", v, 120) for v in "ABC"] + [("b", "A", 120), ("b", "B", 250)], "item_family_id string, prompt_variant string, word_limit int")
    assert {r["key"] for r in rules.lock_guard(variants, whole, 2).collect()} == {"b:variants", "b:budget"}


def test_tables(spark):
    child = spark.createDataFrame([("a",), (None,), ("z",)], "p string")
    assert [r["key"] for r in rules.foreign_key(child, "p", spark.createDataFrame([("a",)], "id string"), "id").collect()] == ["z"]
    with pytest.raises(ValueError, match="not unique"):
        rules.many_to_one(spark.createDataFrame([("a",), ("a",)], "k string"), ["k"])
    x = spark.createDataFrame([("1", "r", None), ("2", "r", "c"), ("3", None, None)], "extraction_id string, response_id string, validation_case_id string")
    assert {r["key"] for r in rules.exclusive_subject(x).collect()} == {"2", "3"}


def test_analysis_long(spark):
    rows = spark.createDataFrame([("e1", "f"), ("e2", "g")], "extraction_id string, feature_id string")
    ex = spark.createDataFrame([("e1", "r1", None, "judge", "j"), ("e2", None, "c1", "judge", "j")], "extraction_id string, response_id string, validation_case_id string, extraction_source string, source_identifier string")
    runs = spark.createDataFrame([("r1", "fam1")], "response_id string, item_family_id string")
    cases = spark.createDataFrame([("c1", None, "fam2")], "validation_case_id string, response_id string, item_family_id string")
    got = {r["extraction_id"]: (r["subject_id"], r["item_family_id"]) for r in flatten.analysis_long(rows, ex, runs, cases).collect()}
    assert got == {"e1": ("r1", "fam1"), "e2": ("c1", "fam2")}
