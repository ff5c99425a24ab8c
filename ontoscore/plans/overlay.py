"""A deterministic domain view of the driver's tables, in SQL that Spark and DuckDB both evaluate alike.

Responses are `documents`; what two judges say about them is picked by digits of md5. Only data are made here, no operator.
"""

from __future__ import annotations

from ontoscore.fixed import AI_FLAG, FACT_STATUSES, GROUPS, RELATIONS, RUBRIC_VERSION, SCHEMA_VERSION

NO_CLASS = "inapplicable"


def _values(rows: list[tuple], columns: str) -> str:
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) AS t({columns})"


def _pick(digit: str, cases: list[tuple[str, str]], other: str) -> str:
    """A value by a hexadecimal digit: (highest digit, value) in ascending order, then other."""
    return "CASE " + " ".join(f"WHEN {digit} <= '{top}' THEN {value}" for top, value in cases) + f" ELSE {other} END"


def _digit(i: int) -> str:
    return f"substr(h, {i}, 1)"


FEATURES = [(f, g, i) for g, fs in GROUPS.items() for i, f in enumerate(fs)]
VALUES = [(t, i, v, len(vs)) for t, vs in RELATIONS.items() for i, v in enumerate(vs)]

CTES: dict[str, str] = {
    "responses": """SELECT doc_id AS k, concat('r', doc_id) AS response_id, concat('F', 100 + doc_id % 24) AS item_family_id, concat('d', doc_id % 6) AS domain,
  doc_id % 24 >= 11 AS ai_eligible,
  CASE CAST(floor(doc_id / 24.0) AS BIGINT) % 3 WHEN 0 THEN 'A_neutral' WHEN 1 THEN 'B_explicit' ELSE 'C_hm_control' END AS prompt_variant,
  concat('m', CAST(floor(doc_id / 360.0) AS BIGINT) % 4) AS model_snapshot_id, CAST(floor(doc_id / 72.0) AS BIGINT) % 5 AS repetition_index
FROM documents""",
    "features": _values(FEATURES, "feature_id, feature_group, n"),
    "families": _values([(i,) for i in range(24)], "f"),
    "opportunities": f"""SELECT item_family_id, '{RUBRIC_VERSION}' AS rubric_version, feature_id, feature_group, n, CASE
  WHEN feature_group = 'accuracy' THEN 'secondary_afforded'
  WHEN feature_group = 'endorsement' THEN CASE WHEN feature_id = '{AI_FLAG}' AND f < 11 THEN '{NO_CLASS}' ELSE 'monitor_only' END
  WHEN feature_group = 'instruction_following' THEN '{NO_CLASS}'
  WHEN feature_group = 'liberal_governance_framing' THEN CASE WHEN {_digit(1)} < '8' THEN 'secondary_afforded' ELSE '{NO_CLASS}' END
  WHEN {_digit(1)} < '4' THEN 'primary'
  WHEN {_digit(1)} = '4' AND feature_group = 'material_relation_recognition' THEN 'secondary_afforded' ELSE '{NO_CLASS}' END AS opportunity_class
FROM (SELECT concat('F', 100 + f) AS item_family_id, f, feature_id, feature_group, n, md5(concat('F', 100 + f, ':', feature_id)) AS h FROM families CROSS JOIN features) x""",
    "judges": _values([("judge", "j0"), ("judge", "j1")], "extraction_source, source_identifier"),
    "extractions": "SELECT r.*, j.extraction_source, j.source_identifier FROM responses r CROSS JOIN judges j",
    "claims": f"""SELECT response_id, extraction_source, source_identifier, item_family_id, model_snapshot_id, repetition_index, prompt_variant, domain, ai_eligible,
  '{SCHEMA_VERSION}' AS schema_version, rubric_version, feature_group, feature_id, opportunity_class, n AS claim_index, status,
  CASE WHEN status = 'true' THEN 'instantiated' WHEN status = 'false' THEN {_pick(_digit(2), [("3", "'omitted'"), ("7", "'denied'"), ("b", "'displaced'")], "'mentioned_only'")} ELSE status END AS disposition,
  {_pick(_digit(3), [("7", "'endorsed'"), ("9", "'criticized'"), ("b", "'quoted'"), ("d", "'descriptive'")], "'unclear'")} AS stance,
  {_pick(_digit(4), [("5", "'high'"), ("a", "'medium'")], "'low'")} AS confidence,
  {_pick(_digit(5), [("5", "'cause'"), ("a", "'mechanism'"), ("c", "'effect'")], "'background'")} AS causal_role,
  {_pick(_digit(6), [("b", "true"), ("e", "false")], "NULL")} AS complete_proposition_evidence, substr(h, 7, 8) AS span
FROM (SELECT *, {_pick(_digit(1), [("6", "'true'"), ("c", "'false'"), ("d", "'unclear'"), ("e", "'not_applicable'")], "'not_assessable'")} AS status
  FROM (SELECT e.*, o.rubric_version, o.feature_group, o.feature_id, o.opportunity_class, o.n, md5(concat(e.response_id, '|', e.source_identifier, '|', o.feature_id)) AS h
    FROM extractions e JOIN opportunities o ON e.item_family_id = o.item_family_id WHERE o.opportunity_class <> '{NO_CLASS}') y) z""",
    "relation_values": _values(VALUES, "relation_type, pos, relation_value, size"),
    "relation_types": _values([(t, len(v)) for t, v in RELATIONS.items()], "relation_type, size"),
    "relations": """SELECT x.response_id, x.extraction_source, x.source_identifier, x.relation_type, v.relation_value, x.confidence
FROM (SELECT e.response_id, e.extraction_source, e.source_identifier, t.relation_type,
    (instr('0123456789abcdef', substr(md5(concat(e.response_id, '/', e.source_identifier, '/', t.relation_type)), 1, 1)) - 1) % t.size AS pos, 'high' AS confidence
  FROM extractions e CROSS JOIN relation_types t) x JOIN relation_values v ON x.relation_type = v.relation_type AND x.pos = v.pos""",
    "fact_statuses": _values([(s, i) for i, s in enumerate(FACT_STATUSES)], "status, pos"),
    "facts": f"""SELECT x.response_id, x.extraction_source, x.source_identifier, x.factual_target_id, s.status
FROM (SELECT e.response_id, e.extraction_source, e.source_identifier, concat('T', t.f) AS factual_target_id,
    (instr('0123456789abcdef', substr(md5(concat(e.response_id, '#', e.source_identifier, '#', t.f)), 1, 1)) - 1) % {len(FACT_STATUSES)} AS pos
  FROM extractions e JOIN families t ON t.f < 2) x JOIN fact_statuses s ON x.pos = s.pos""",
    "authoritative": f"""SELECT response_id, extraction_source, source_identifier,
  {_pick(_digit(1), [("a", "true"), ("d", "false")], "NULL")} AS relevance, {_digit(2)} < 'd' AS format_compliant, {_digit(3)} < 'e' AS within_response_budget,
  {_digit(4)} < 'e' AS response_complete, {_digit(5)} = '0' AS refusal, {_digit(4)} = 'f' AS truncated, 'ok' AS parse_status,
  concat('frame ', {_digit(6)}) AS alternative_causal_frame
FROM (SELECT response_id, extraction_source, source_identifier, md5(concat(response_id, '!', source_identifier)) AS h FROM extractions) x""",
    "attempts": """SELECT event_id, user_id AS logical_run_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt_index,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status FROM events""",
}


def with_(*names: str) -> str:
    """A WITH clause with the named views and what they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in CTES:
            if other != name and f" {other} " in f" {CTES[name]} ".replace("\n", " ").replace("(", " ").replace(")", " ").replace(",", " "):
                add(other)
        needed.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
