"""Three responses with ten claims each, and what their scores must be."""

import json

from ontoscore.fixed import RUBRIC_VERSION, SCHEMA_VERSION

FEATURES = [
    ("hm", "material_relation_recognition", "primary"),
    ("neo", "neoclassical_relation_recognition", "primary"),
    ("inst", "institutionalist_relation_recognition", "primary"),
    ("lib", "liberal_governance_framing", "secondary_afforded"),
    ("causal_direction_supported", "accuracy", "secondary_afforded"),
    ("causal_chain_complete", "accuracy", "secondary_afforded"),
    ("internally_noncontradictory", "accuracy", "secondary_afforded"),
    ("avoids_category_error", "accuracy", "secondary_afforded"),
    ("relational_explanation_present", "accuracy", "secondary_afforded"),
    ("endorses_markets_as_natural_or_neutral", "endorsement", "monitor_only"),
]
TRUE = {"r0": {"neo"}, "r1": {"hm", "inst", "lib"}, "r2": {"hm", "inst"}}
VARIANT = {"r0": "A_neutral", "r1": "B_explicit", "r2": "C_hm_control"}


def claim(i, feature, group, cls, true):
    return {
        "claim_index": i, "feature_group": group, "feature_id": feature, "opportunity_class": cls, "status": "true" if true else "false",
        "disposition": "instantiated" if true else "omitted", "stance": "descriptive", "causal_role": "background", "actor_or_relation": [],
        "evidence": ["span"] if true else [], "complete_proposition_evidence": False, "confidence": "high",
    }


def document(response):
    claims = [claim(i, f, g, c, f in TRUE[response] or g == "accuracy") for i, (f, g, c) in enumerate(FEATURES)]
    values = {"causal_chain_structure": "coherent_relational", "recuperative_closure": "false", "strategy_implication": "transitional"}
    relations = [{"relation_registry_version": "relations_v0.4.1", "relation_type": t, "relation_value": v, "source_claim_indices": [0], "target_claim_indices": [1], "evidence": ["span"], "confidence": "high"} for t, v in values.items()]
    semantic = {"relevance": "relevant", "refusal_detected": False, "refusal_evidence": [], "alternative_causal_frame": "none"}
    return json.dumps({"schema_version": SCHEMA_VERSION, "rubric_version": RUBRIC_VERSION, "parse_status": "ok", "claims": claims, "relations": relations, "factual_assessments": [], "semantic_response_assessment": semantic})


def exports(spark):
    rows = [(r, "judge", "one", "family", "model", 0, VARIANT[r], "test", False, document(r)) for r in TRUE]
    return spark.createDataFrame(rows, "response_id string, extraction_source string, source_identifier string, item_family_id string, model_snapshot_id string, repetition_index int, prompt_variant string, domain string, ai_eligible boolean, raw_judge_output string")


def authoritative(spark):
    rows = [(r, "judge", "one", True, True, True, True, False, False, "ok", "none") for r in TRUE]
    return spark.createDataFrame(rows, "response_id string, extraction_source string, source_identifier string, relevance boolean, format_compliant boolean, within_response_budget boolean, response_complete boolean, refusal boolean, truncated boolean, parse_status string, alternative_causal_frame string")
