"""The registered queries of the engine's own operators, each with DuckDB SQL that says the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoscore.fixed import CELL_DIMENSIONS, CHAIN_WEIGHTS, COHERENCE, DIMENSIONS, FACT_VALUES, GROUPS, K, RATES, RELATIONS, RUBRIC_VERSION, SCHEMA_VERSION, SEVERE, STATES, VARIANTS
from ontoscore.functions import ident, text
from ontoscore.operators import assess, effects, ensemble, flatten, rules, score, stats, swarm
from ontoscore.plans.overlay import with_
from ontoscore.streaming.ingest import sessions, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = ", ".join(K)


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df over all cores by a key if it comes in fewer partitions; for work that costs far more than moving its input."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the domain overlay. It makes about 200 rows of each document's id, so few splits of ids are dealt to all cores."""
    sql = f"{with_(name)} SELECT * FROM {name}"
    used = {t: table(spark, sf_dir, t) for t in ("documents", "events") if f"FROM {t}" in sql}
    if "documents" in used:
        used["documents"] = dealt(used["documents"].select("doc_id"), "doc_id")
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)


def r9(c: F.Column | str) -> F.Column:
    """Rounded to nine digits, no negative zero: sums of doubles depend on their order in the last one."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(0.0)


def sql9(x: str) -> str:
    return f"round({x}, 9) + 0.0"


def case(col: str, values: dict[str, float]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in values.items()) + " END"


TRUTH = {"true": 1.0, "false": 0.0}

# ---------------------------------------------------------------- coverage

COUNTS_SQL = f"""SELECT {KEYS}, feature_group, opportunity_class, count(*) AS planned_n, count(*) FILTER (WHERE status IN ('true', 'false')) AS assessable_n,
  count(*) FILTER (WHERE status = 'true') AS true_n, count(*) FILTER (WHERE status = 'unclear') AS unclear_n, count(*) FILTER (WHERE status = 'not_assessable') AS not_assessable_n
FROM claims GROUP BY ALL"""
SCORES_SQL = f"""SELECT *, assessable_n::DOUBLE / planned_n AS assessability, CASE WHEN assessable_n::DOUBLE / planned_n >= 0.8 THEN true_n::DOUBLE / nullif(assessable_n, 0) END AS score,
  true_n::DOUBLE / planned_n AS worst_case_score FROM ({COUNTS_SQL})"""


@query("q_AGG1", f"{with_('claims')} {COUNTS_SQL}")
def dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.dimension_counts(view(spark, sf_dir, "claims"))


@query("q_AGG2", f"{with_('claims')} {SCORES_SQL}")
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.dimension_scores(view(spark, sf_dir, "claims"))


@query("q_AGG3", f"""{with_('claims')} SELECT {KEYS}, count(*) AS planned_n, count(*) FILTER (WHERE status IN ('true', 'false')) AS assessable_n, count(*) FILTER (WHERE status = 'true') AS true_n,
  count(*) FILTER (WHERE status = 'unclear') AS unclear_n, count(*) FILTER (WHERE status = 'not_assessable') AS not_assessable_n,
  count(*) FILTER (WHERE status IN ('true', 'false'))::DOUBLE / count(*) AS assessability,
  CASE WHEN count(*) FILTER (WHERE status IN ('true', 'false'))::DOUBLE / count(*) >= 0.7 THEN count(*) FILTER (WHERE status = 'true')::DOUBLE / nullif(count(*) FILTER (WHERE status IN ('true', 'false')), 0) END AS score,
  count(*) FILTER (WHERE status = 'true')::DOUBLE / count(*) AS worst_case_score
FROM claims WHERE feature_group = 'material_relation_recognition' GROUP BY ALL""")
def feature_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.feature_dimension(view(spark, sf_dir, "claims"), "material_relation_recognition", None, 0.7)


POOLED_SQL = f"""SELECT {KEYS}, avg(value) AS accuracy, count(value) AS accuracy_assessable_n FROM (
  SELECT {KEYS}, {case('status', TRUTH)} AS value FROM claims WHERE feature_group = 'accuracy' UNION ALL SELECT {KEYS}, {case('status', FACT_VALUES)} FROM facts) GROUP BY ALL"""


@query("q_AGG4", f"{with_('claims', 'facts')} SELECT {KEYS}, {sql9('accuracy')} AS accuracy, accuracy_assessable_n FROM ({POOLED_SQL})")
def pooled_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.pooled_accuracy(view(spark, sf_dir, "claims"), view(spark, sf_dir, "facts")).withColumn("accuracy", r9("accuracy"))


RATES_SQL = f"SELECT {KEYS}, " + ", ".join(f"count(*) FILTER (WHERE disposition = '{d}')::DOUBLE / count(*) AS {n}" for n, d in RATES.items()) + " FROM claims WHERE opportunity_class IN ('primary', 'secondary_afforded') GROUP BY ALL"


@query("q_AGG5", f"{with_('claims')} {RATES_SQL}")
def disposition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.disposition_rates(view(spark, sf_dir, "claims"))


QUALIFIED = "status = 'true' AND disposition = 'instantiated' AND stance = 'endorsed' AND confidence = 'high' AND coalesce(complete_proposition_evidence, false)"
FLAGS_SQL = f"SELECT {KEYS}, " + ", ".join(f"bool_or(feature_id = '{f}' AND {QUALIFIED}) AS {f}_flag" for f in SEVERE) + " FROM claims WHERE feature_group = 'endorsement' AND opportunity_class = 'monitor_only' GROUP BY ALL"


@query("q_AGG6", f"{with_('claims')} {FLAGS_SQL}")
def severe_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.severe_flags(view(spark, sf_dir, "claims"))


@query("q_VAL43", f"{with_('claims')} SELECT {KEYS}, feature_id, {QUALIFIED} AS qualified FROM claims WHERE feature_group = 'endorsement'")
def qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "claims").where("feature_group = 'endorsement'").select(*K, "feature_id", score.qualified().alias("qualified"))


ACCURACY_SQL = f"SELECT {KEYS}, " + ", ".join(f"min(CASE WHEN feature_id = '{f}' THEN status END) AS {f}" for f in GROUPS["accuracy"]) + " FROM claims WHERE feature_group = 'accuracy' GROUP BY ALL"
RELATION_SQL = f"SELECT {KEYS}, " + ", ".join(f"min(CASE WHEN relation_type = '{t}' THEN relation_value END) AS {t}" for t in RELATIONS) + " FROM relations GROUP BY ALL"


@query("q_PV1", f"{with_('claims')} {ACCURACY_SQL}")
def accuracy_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.accuracy_wide(view(spark, sf_dir, "claims"))


@query("q_PV2", f"{with_('relations')} {RELATION_SQL}")
def relation_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.relation_wide(view(spark, sf_dir, "relations"))


@query("q_PV3", f"{with_('claims')} SELECT {KEYS}, {', '.join(COHERENCE)} FROM ({ACCURACY_SQL})")
def coherence_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.accuracy_wide(view(spark, sf_dir, "claims").where(F.col("feature_id").isin(COHERENCE))).select(*K, *COHERENCE)


@query("q_PV6", f"{with_('relations')} SELECT {KEYS}, string_agg(relation_type || '=' || relation_value, ',' ORDER BY o) AS relations FROM (SELECT *, CASE relation_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(RELATIONS)) + " END AS o FROM relations) GROUP BY ALL")
def relation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score.relation_list(score.relation_wide(view(spark, sf_dir, "relations")))
    return rows.select(*K, F.array_join(F.transform("relations", lambda x: F.concat_ws("=", x["relation_type"], x["relation_value"])), ",").alias("relations"))


# ---------------------------------------------------------------- the wide table

RELATIVE = ["score", "assessability", "planned_n", "assessable_n", "true_n", "unclear_n", "not_assessable_n", "worst_case_score"]


def _metrics_sql(anchor: bool, tidy: bool = True) -> str:
    tidied = sql9 if tidy else str
    blocks = ", ".join(f"{p} AS (SELECT * FROM scores WHERE feature_group = '{g}' AND opportunity_class = '{c}')" for p, (g, c) in DIMENSIONS.items())
    columns = ", ".join(f"{p}.{c} AS {p}_{c}" for p in DIMENSIONS for c in RELATIVE)
    if anchor:
        keys = f"SELECT {KEYS} FROM recognition"
    else:
        keys = " UNION ".join(f"SELECT {KEYS} FROM {p}" for p in DIMENSIONS)
    joins = " ".join(f"LEFT JOIN {p} USING ({KEYS})" for p in DIMENSIONS)
    rates = ", ".join(n if anchor else f"coalesce({n}, 0.0) AS {n}" for n in RATES)
    flags = ", ".join(f"{f}_flag" if anchor else f"coalesce({f}_flag, false) AS {f}_flag" for f in SEVERE)
    checks = ["CASE WHEN relevance THEN 1.0::DOUBLE WHEN NOT relevance THEN 0.0::DOUBLE END", *[case(f, TRUTH) for f in COHERENCE]]
    n = " + ".join(f"(c{i} IS NOT NULL)::INT" for i in range(6))
    total = " + ".join(f"coalesce(c{i}, 0.0::DOUBLE)" for i in range(6))
    return f"""{with_('claims', 'relations', 'facts', 'authoritative')}, scores AS ({SCORES_SQL}), {blocks}, keys AS ({keys}), aw AS ({ACCURACY_SQL}), rw AS ({RELATION_SQL}), pa AS ({POOLED_SQL}), dr AS ({RATES_SQL}), sf AS ({FLAGS_SQL}),
joined AS (SELECT keys.*, {columns}, {case('rw.recuperative_closure', TRUTH)} AS recuperative_closure_score, rw.strategy_implication AS strategy, {case('rw.causal_chain_structure', CHAIN_WEIGHTS)} AS chain_weight,
  {', '.join('aw.' + f for f in GROUPS['accuracy'])}, relevance, format_compliant, within_response_budget, response_complete, refusal, truncated, parse_status, alternative_causal_frame,
  {tidied('accuracy')} AS accuracy, accuracy_assessable_n, {rates}, {flags}
  FROM keys {joins} LEFT JOIN rw USING ({KEYS}) LEFT JOIN aw USING ({KEYS}) LEFT JOIN authoritative USING ({KEYS}) LEFT JOIN pa USING ({KEYS}) LEFT JOIN dr USING ({KEYS}) LEFT JOIN sf USING ({KEYS})),
checked AS (SELECT *, {', '.join(f'{c} AS c{i}' for i, c in enumerate(checks))} FROM joined)
SELECT * EXCLUDE (c0, c1, c2, c3, c4, c5), {tidied(f'CASE WHEN c0 IS NOT NULL AND {n} >= 5 THEN chain_weight * ({total}) / ({n}) END')} AS causal_coherence,
  (relevance::INT + format_compliant::INT + within_response_budget::INT + response_complete::INT)::DOUBLE / 4.0::DOUBLE AS instruction_following,
  {' OR '.join(f'coalesce({f}_flag, false)' for f in SEVERE)} AS any_severe_endorsement FROM checked"""


def metrics_of(spark: SparkSession, sf_dir: str, anchor: str | None = None) -> DataFrame:
    return score.response_metrics(*(view(spark, sf_dir, v) for v in ("claims", "relations", "facts", "authoritative")), anchor=anchor)


def _tidy(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({"accuracy": r9("accuracy"), "causal_coherence": r9("causal_coherence")})


@query("q_DOM3", _metrics_sql(False))
def response_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(metrics_of(spark, sf_dir))


@query("q_DOM3_recognition", _metrics_sql(True))
def response_metrics_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(metrics_of(spark, sf_dir, "recognition"))


METRICS = _metrics_sql(False, tidy=False)


def _over_metrics(select: str, more: str = "") -> str:
    """SQL over m (the wide table) and e (extractions)."""
    head, _, tail = METRICS.partition("SELECT * EXCLUDE (c0")
    return f"{head.rstrip()}, m AS (SELECT * EXCLUDE (c0{tail}), e AS (SELECT * FROM extractions){more} {select}"


@query("q_DOM4", _over_metrics(f"SELECT {KEYS}, {sql9('causal_coherence')} AS causal_coherence FROM m WHERE causal_coherence IS NOT NULL"))
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(metrics_of(spark, sf_dir)).where("causal_coherence IS NOT NULL").select(*K, "causal_coherence")


@query("q_VAL19", _over_metrics(f"SELECT {KEYS} FROM m JOIN (SELECT response_id, ai_eligible FROM responses) r USING (response_id) WHERE NOT ai_eligible AND endorses_ai_independent_of_ownership_and_class_flag"))
def misplaced_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.misplaced_ai_flags(metrics_of(spark, sf_dir), view(spark, sf_dir, "responses"))


# ---------------------------------------------------------------- effects

CELLS = f", cells AS (SELECT model_snapshot_id, item_family_id, extraction_source, source_identifier, prompt_variant, unnest([{', '.join(repr(d) for d in CELL_DIMENSIONS)}]) AS dimension, unnest([{', '.join(f'avg({d}::INT::DOUBLE)' if d.startswith('any_') else f'avg({d})' for d in CELL_DIMENSIONS)}]) AS value FROM m JOIN e USING ({KEYS}) GROUP BY 1, 2, 3, 4, 5)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.metric_cells(metrics_of(spark, sf_dir), view(spark, sf_dir, "extractions"))


@query("q_AGG7", _over_metrics(f"SELECT * EXCLUDE (value), {sql9('value')} AS value FROM cells", CELLS))
def metric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).withColumn("value", r9("value"))


def _deltas(keys: str) -> str:
    v = {x: f"avg(value) FILTER (WHERE prompt_variant = '{x}')" for x in VARIANTS}
    return f"SELECT {keys}, " + ", ".join(f"{sql9(e)} AS {x}" for x, e in v.items()) + f", {sql9(v['B_explicit'] + ' - ' + v['A_neutral'])} AS delta_explicit_minus_neutral, {sql9(v['C_hm_control'] + ' - ' + v['A_neutral'])} AS delta_control_minus_neutral"


DELTA_COLUMNS = [*VARIANTS, "delta_explicit_minus_neutral", "delta_control_minus_neutral"]


@query("q_AGG8", _over_metrics(_deltas("model_snapshot_id, item_family_id, extraction_source, source_identifier, dimension") + " FROM cells GROUP BY 1, 2, 3, 4, 5", CELLS))
def matched_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.matched_deltas(_cells(spark, sf_dir)).withColumns({c: r9(c) for c in DELTA_COLUMNS})


@query("q_DOM6", _over_metrics(_deltas("model_snapshot_id, item_family_id") + f" FROM (SELECT *, recognition_score AS value FROM m JOIN e USING ({KEYS})) GROUP BY 1, 2"))
def variant_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = view(spark, sf_dir, "extractions").select(*K, "model_snapshot_id", "item_family_id", "prompt_variant", "repetition_index")
    return effects.variant_deltas(metrics_of(spark, sf_dir).join(index, K), "recognition_score").withColumns({c: r9(c) for c in DELTA_COLUMNS})


@query("q_AGG9", _over_metrics("SELECT model_snapshot_id, item_family_id, extraction_source, source_identifier, " + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT strategy) FILTER (WHERE prompt_variant = '{v}' AND strategy IS NOT NULL)), ','), '') AS {v[0]}_strategy" for v in VARIANTS) + f" FROM m JOIN e USING ({KEYS}) GROUP BY 1, 2, 3, 4"))
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = effects.strategy_transitions(metrics_of(spark, sf_dir), view(spark, sf_dir, "extractions"))
    return rows.withColumns({f"{v[0]}_strategy": F.array_join(f"{v[0]}_strategy", ",") for v in VARIANTS})


def _state_sql(t_r: str, t_l: str) -> str:
    r, lib, q = "recognition_score", "liberal_score", "recuperative_closure_score"
    return f"""CASE WHEN NOT coalesce(recognition_assessability >= 0.8 AND liberal_assessability >= 0.8, false) THEN '{STATES[0]}' WHEN {r} >= {t_r} AND {q} = 0 THEN '{STATES[1]}' WHEN {r} < {t_r} AND {lib} >= {t_l} THEN '{STATES[2]}'
  WHEN {r} < {t_r} AND {lib} < {t_l} THEN '{STATES[3]}' WHEN {r} >= {t_r} AND {q} = 1 THEN '{STATES[4]}' ELSE '{STATES[5]}' END"""


@query("q_DOM5", _over_metrics(f"SELECT {KEYS}, {_state_sql('0.4::DOUBLE', '0.5::DOUBLE')} AS measurement_state, {sql9('recognition_score * exp(-0.5 * recuperative_closure_score)')} AS secondary_composite FROM m"))
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.add_states(metrics_of(spark, sf_dir), 0.4, 0.5, 0.5).select(*K, "measurement_state", r9("secondary_composite").alias("secondary_composite"))


GRID = [", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in g) for g in (effects.THRESHOLDS, effects.LAMBDAS)]


@query("q_DOM9", _over_metrics(f"""SELECT t_r, t_l, "lambda", {sql9('mean_composite')} AS mean_composite, measurement_state, {sql9('share')} AS share FROM
  (SELECT t_r, t_l, measurement_state, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY t_r, t_l) AS share FROM (SELECT t_r, t_l, {_state_sql('t_r', 't_l')} AS measurement_state FROM m, (SELECT unnest([{GRID[0]}]) AS t_r), (SELECT unnest([{GRID[0]}]) AS t_l)) GROUP BY 1, 2, 3),
  (SELECT "lambda", avg(recognition_score * exp(-"lambda" * recuperative_closure_score)) AS mean_composite FROM m, (SELECT unnest([{GRID[1]}]) AS "lambda") GROUP BY 1)"""))
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = effects.threshold_sensitivity(metrics_of(spark, sf_dir))
    return grid.select("t_r", "t_l", "lambda", r9("mean_composite").alias("mean_composite"), F.explode("state_distribution").alias("measurement_state", "share")).withColumn("share", r9("share"))


@query("q_DOM8")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = effects.matched_deltas(_cells(spark, sf_dir)).where("dimension = 'recognition_score'")
    return effects.family_bootstrap(deltas, "delta_explicit_minus_neutral")


@query("q_AGG13", _over_metrics(f"SELECT item_family_id, {sql9('avg(recognition_score)')} AS recognition_score FROM m JOIN e USING ({KEYS}) GROUP BY 1 HAVING avg(recognition_score) IS NOT NULL"))
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics_of(spark, sf_dir).join(view(spark, sf_dir, "extractions").select(*K, "item_family_id"), K)
    return effects.family_means(rows, "recognition_score").withColumn("recognition_score", r9("recognition_score"))


@query("q_W1", f"{with_('attempts')} SELECT logical_run_id, event_id, ts, event_type, attempt_index, status FROM (SELECT *, row_number() OVER (PARTITION BY logical_run_id ORDER BY attempt_index, event_id) AS rn FROM attempts WHERE status = 'succeeded') WHERE rn = 1")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.first_success(view(spark, sf_dir, "attempts")).withColumn("attempt_index", F.col("attempt_index").cast("long"))


@query("q_W2", f"{with_('extractions')} SELECT response_id, source_identifier, prompt_variant, CAST(row_number() OVER (PARTITION BY prompt_variant, source_identifier ORDER BY md5('7:' || response_id), response_id) - 1 AS BIGINT) AS order_index FROM extractions")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "extractions").withColumn("part", F.concat("prompt_variant", F.lit("|"), "source_identifier"))
    return effects.shuffled_cells(rows, 7, "response_id", "part").select("response_id", "source_identifier", "prompt_variant", F.col("order_index").cast("long"))


# ---------------------------------------------------------------- flatten, through a JSON round trip


def exports_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlay as extraction exports with one JSON document each."""
    none = F.array().cast("array<string>")
    c = view(spark, sf_dir, "claims")
    claim = F.struct("claim_index", "feature_group", "feature_id", "opportunity_class", "status", "disposition", "stance", "causal_role", none.alias("actor_or_relation"), F.array("span").alias("evidence"), "complete_proposition_evidence", "confidence")
    claims = c.select(*K, claim.alias("claim"))
    r = view(spark, sf_dir, "relations")
    refs = F.array().cast("array<int>")
    relation = F.struct(F.lit("relations_v0.4.1").alias("relation_registry_version"), "relation_type", "relation_value", refs.alias("source_claim_indices"), refs.alias("target_claim_indices"), none.alias("evidence"), "confidence")
    f = view(spark, sf_dir, "facts")
    fact = F.struct(F.concat("factual_target_id", F.lit("-v1")).alias("factual_target_version_id"), "factual_target_id", "status", F.lit(None).cast("string").alias("claim_text"), none.alias("evidence"), F.lit("high").alias("confidence"))
    empty = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    rel, fac = r.select(*K, relation.alias("relation")), f.select(*K, fact.alias("fact"))
    rows = claims.select(*K, "claim", empty(rel, "relation"), empty(fac, "fact")).unionByName(rel.select(*K, empty(claims, "claim"), "relation", empty(fac, "fact"))).unionByName(fac.select(*K, empty(claims, "claim"), empty(rel, "relation"), "fact"))
    sets = rows.groupBy(*K).agg(F.collect_list("claim").alias("claims"), F.collect_list("relation").alias("relations"), F.collect_list("fact").alias("factual_assessments"))
    a = view(spark, sf_dir, "authoritative").select(*K, F.struct(F.when(F.col("relevance"), "relevant").when(~F.col("relevance"), "irrelevant").otherwise("unclear").alias("relevance"), F.col("refusal").alias("refusal_detected"), none.alias("refusal_evidence"), "alternative_causal_frame").alias("semantic_response_assessment"))
    out = sets.join(a, K)
    doc = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(RUBRIC_VERSION).alias("rubric_version"), F.lit("ok").alias("parse_status"), "claims", "relations", "factual_assessments", "semantic_response_assessment"), {"ignoreNullFields": "false"})
    meta = view(spark, sf_dir, "extractions").select(*K, "item_family_id", "model_snapshot_id", "repetition_index", "prompt_variant", "domain", "ai_eligible")
    return out.select(*K, doc.alias("raw_judge_output")).join(meta, K)


CLAIM_COLUMNS = [*K, "item_family_id", "model_snapshot_id", "repetition_index", "prompt_variant", "domain", "ai_eligible", "schema_version", "rubric_version", "feature_group", "feature_id", "opportunity_class", "status", "disposition", "stance", "causal_role", "confidence", "complete_proposition_evidence"]


@query("q_PRJ1", f"{with_('claims')} SELECT {', '.join(CLAIM_COLUMNS)}, span AS evidence FROM claims")
def claim_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.claim_long(flatten.parse(exports_of(spark, sf_dir))).select(*CLAIM_COLUMNS, F.array_join("evidence", "|").alias("evidence"))


@query("q_PRJ2", f"{with_('relations')} SELECT {KEYS}, 'relations_v0.4.1' AS relation_registry_version, relation_type, relation_value, confidence FROM relations")
def relation_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.relation_long(flatten.parse(exports_of(spark, sf_dir))).select(*K, "relation_registry_version", "relation_type", "relation_value", "confidence")


@query("q_PRJ3", f"{with_('facts')} SELECT {KEYS}, factual_target_id || '-v1' AS factual_target_version_id, factual_target_id, status, 'high' AS confidence FROM facts")
def factual_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.factual_long(flatten.parse(exports_of(spark, sf_dir))).select(*K, "factual_target_version_id", "factual_target_id", "status", "confidence")


@query("q_PRJ4", f"{with_('authoritative')} SELECT {KEYS}, CASE WHEN relevance THEN 'relevant' WHEN NOT relevance THEN 'irrelevant' ELSE 'unclear' END AS relevance, refusal AS refusal_detected, alternative_causal_frame, parse_status FROM authoritative")
def semantic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.semantic_rows(flatten.parse(exports_of(spark, sf_dir))).drop("refusal_evidence")


# ---------------------------------------------------------------- rules

SAID = "'key' AS x"


def _rule(rule: str, message: str, key: str, frm: str) -> str:
    return f"SELECT {KEYS}, CAST({key} AS VARCHAR) AS key, '{rule}' AS rule_id, '{message}' AS message FROM {frm}"


def bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of which some break a rule: by the first digits of their span."""
    c = view(spark, sf_dir, "claims")
    d = F.substring("span", 1, 2)
    return c.withColumns({
        "schema_version": F.when(d == "00", F.lit(None).cast("string")).when(d == "01", "old").otherwise(F.col("schema_version")),
        "stance": F.when(d == "02", "sure").otherwise(F.col("stance")),
        "disposition": F.when(d == "03", "denied").otherwise(F.col("disposition")),
        "feature_group": F.when(d == "04", "accuracy").otherwise(F.col("feature_group")),
        "opportunity_class": F.when(d == "05", "monitor_only").otherwise(F.col("opportunity_class")),
    }).where(d != "06")


BENT = """, bent AS (SELECT * REPLACE (
  CASE substr(span, 1, 2) WHEN '00' THEN NULL WHEN '01' THEN 'old' ELSE schema_version END AS schema_version, CASE WHEN substr(span, 1, 2) = '02' THEN 'sure' ELSE stance END AS stance,
  CASE WHEN substr(span, 1, 2) = '03' THEN 'denied' ELSE disposition END AS disposition, CASE WHEN substr(span, 1, 2) = '04' THEN 'accuracy' ELSE feature_group END AS feature_group,
  CASE WHEN substr(span, 1, 2) = '05' THEN 'monitor_only' ELSE opportunity_class END AS opportunity_class) FROM claims WHERE substr(span, 1, 2) <> '06')"""
BASE = with_("claims") + BENT


@query("q_VAL1", f"{BASE} " + _rule("VAL1", "schema/rubric mismatch", "feature_id", f"bent WHERE schema_version IS DISTINCT FROM '{SCHEMA_VERSION}' OR rubric_version IS DISTINCT FROM '{RUBRIC_VERSION}'"))
def val1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.versions(bent(spark, sf_dir))


@query("q_VAL3", f"{BASE} " + _rule("VAL3", "invalid claim enum", "feature_id", "bent WHERE stance NOT IN ('endorsed', 'criticized', 'quoted', 'attributed', 'hypothetical', 'descriptive', 'unclear')"))
def val3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.enums(bent(spark, sf_dir))


@query("q_VAL4", f"{BASE} " + _rule("VAL4", "invalid status/disposition pair", "feature_id", "bent WHERE CASE status WHEN 'true' THEN disposition <> 'instantiated' WHEN 'false' THEN disposition NOT IN ('omitted', 'denied', 'displaced', 'mentioned_only') ELSE disposition <> status END"))
def val4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.joint_labels(bent(spark, sf_dir))


@query("q_VAL9", f"{BASE}, twice AS (SELECT * FROM bent UNION ALL SELECT * FROM bent WHERE substr(span, 1, 1) = '7') " + f"SELECT {KEYS}, feature_id AS key, 'VAL9' AS rule_id, 'duplicate feature observation' AS message FROM twice GROUP BY {KEYS}, feature_id HAVING count(*) <> 1")
def val9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bent(spark, sf_dir)
    return rules.duplicates(rows.unionByName(rows.where("substr(span, 1, 1) = '7'")), [*K, "feature_id"], "VAL9", "duplicate feature observation")


@query("q_VAL11", f"{BASE} " + _rule("VAL11", "feature group differs from registry", "b.feature_id", "bent b JOIN features f ON b.feature_id = f.feature_id WHERE b.feature_group <> f.feature_group"))
def val11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.against_registry(bent(spark, sf_dir), view(spark, sf_dir, "features"))


@query("q_VAL12", f"{BASE} " + _rule("VAL12", "judge opportunity class differs from plan", "b.feature_id", "bent b JOIN opportunities o USING (item_family_id, rubric_version, feature_id) WHERE b.opportunity_class <> o.opportunity_class"))
def val12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.against_opportunities(bent(spark, sf_dir), view(spark, sf_dir, "opportunities"))


@query("q_VAL13", f"{BASE} " + _rule("VAL13", "missing planned claim observation", "o.feature_id", f"extractions e JOIN opportunities o USING (item_family_id) WHERE o.opportunity_class <> 'inapplicable' AND NOT EXISTS (SELECT 1 FROM bent b WHERE b.response_id = e.response_id AND b.source_identifier = e.source_identifier AND b.feature_id = o.feature_id)"))
def val13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.missing_observations(bent(spark, sf_dir), view(spark, sf_dir, "extractions"), view(spark, sf_dir, "opportunities"))


@query("q_VAL25", f"{BASE} " + _rule("VAL25", "cause with a status other than true", "feature_id", "bent WHERE causal_role = 'cause' AND status IS DISTINCT FROM 'true'"))
def val25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cause_without_claim(bent(spark, sf_dir))


PACKETS = "packets AS (SELECT concat('T', f) AS factual_target_id, CASE WHEN f = 0 THEN 'complete' ELSE 'draft' END AS packet_status, 'x' AS source_excerpt_or_slice, 'causal' AS permitted_inference FROM families WHERE f < 2)"


@query("q_VAL15", f"{with_('claims', 'facts')}, {PACKETS} " + _rule("VAL15", "factual assessment used without an adequate source packet", "factual_target_id", "facts JOIN packets USING (factual_target_id) WHERE packet_status <> 'complete' AND status <> 'not_assessable'"))
def val15(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "families").where("f < 2")
    packets = f.select(F.concat(F.lit("T"), "f").alias("factual_target_id"), F.when(F.col("f") == 0, "complete").otherwise("draft").alias("packet_status"), F.lit("x").alias("source_excerpt_or_slice"), F.lit("causal").alias("permitted_inference"))
    return rules.factual_gate(view(spark, sf_dir, "facts"), view(spark, sf_dir, "claims"), packets)


@query("q_VAL6", f"{with_('relations')}, x AS (SELECT * REPLACE (CASE WHEN relation_value = 'recognized' THEN 'seen' ELSE relation_value END AS relation_value) FROM relations) " + _rule("VAL6", "relation value is not allowed for its type", "relation_type || '=' || relation_value", "x WHERE relation_value = 'seen'"))
def val6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.relation_values(view(spark, sf_dir, "relations").withColumn("relation_value", F.when(F.col("relation_value") == "recognized", "seen").otherwise(F.col("relation_value"))))


@query("q_JN13", f"{with_('opportunities')} SELECT item_family_id, feature_id, opportunity_class FROM opportunities")
def closed_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "opportunities")
    return rules.closed_world(o.select("item_family_id"), view(spark, sf_dir, "features"), o.where("opportunity_class <> 'inapplicable'").select("item_family_id", "feature_id", "opportunity_class"))


@query("q_VAL23", "SELECT concat('r', d.doc_id) AS response_id, CAST(b.item_id AS VARCHAR) AS key FROM documents d, benchmark b WHERE d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id AND NOT contains(d.text, b.text)")
def val23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is held to have quoted one benchmark item."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), "doc_id").alias("response_id"), "doc_id", "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("span"))
    n = b.agg(F.max("item_id") + 1).first()[0] or 1
    spans = docs.select("response_id", (F.col("doc_id") % n).alias("item_id")).join(b, "item_id").select("response_id", F.col("item_id").alias("key"), "span")
    return rules.verbatim(spans, docs.select("response_id", "text")).select("response_id", "key")


# ---------------------------------------------------------------- assessment and ensemble

WORDS_SQL = text.WORD.replace("'", "''")


@query("q_DOM1", f"""{with_('authoritative')}, t AS (SELECT concat('r', doc_id) AS response_id, len(regexp_extract_all(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{WORDS_SQL}')) AS n, text, doc_id FROM documents)
SELECT {KEYS}, CAST(n AS INTEGER) AS word_count, n <= 120 AS within_response_budget, true AS format_compliant, doc_id % 10 = 0 AS truncated, doc_id % 10 <> 0 AND doc_id % 7 <> 0 AND trim(text) <> '' AS response_complete, relevance,
  doc_id % 13 = 0 OR refusal AS refusal, parse_status, alternative_causal_frame FROM authoritative JOIN t USING (response_id)""")
def authoritative(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "authoritative").select(*K, F.when(F.col("relevance"), "relevant").when(~F.col("relevance"), "irrelevant").otherwise("unclear").alias("relevance"), F.col("refusal").alias("refusal_detected"), "parse_status", "alternative_causal_frame")
    d = F.col("doc_id")
    meta = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), d).alias("response_id"), F.col("text").alias("response_text"), F.lit(120).alias("word_limit"), F.lit(True).alias("format_compliant_deterministic"), F.when(d % 10 == 0, "length").otherwise("stop").alias("finish_reason"), (d % 13 == 0).alias("provider_refusal"), (d % 7 == 0).alias("provider_filtered"))
    return assess.authoritative(a, meta, normalise=False)


@query("q_DOM2", f"{with_('authoritative')} SELECT {KEYS}, 'answer_relevant_to_question' AS feature_id, CASE WHEN relevance IS NULL THEN 'not_assessable' WHEN relevance THEN 'true' ELSE 'false' END AS status, CASE WHEN relevance IS NULL THEN 'not_assessable' WHEN relevance THEN 'instantiated' ELSE 'omitted' END AS disposition FROM authoritative")
def relevance_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.relevance_claims(view(spark, sf_dir, "authoritative")).select(*K, "feature_id", "status", "disposition")


def _vote_sql(weight: str, strategy: str) -> str:
    source = {"majority": "3bd0d281-4e74-50bd-b3f7-25db4defc945", "confidence_majority": "c3748fe8-d7ef-58fa-a9bd-8f44713cceda"}[strategy]
    return f"""{with_('claims')}, votes AS (SELECT response_id, feature_id, feature_group, opportunity_class, status, disposition, stance, causal_role, sum({weight}) AS s, bool_and(coalesce(complete_proposition_evidence, false)) AS complete, bool_and(confidence = 'high') AS high, string_agg(span, ',' ORDER BY source_identifier) AS spans FROM claims GROUP BY ALL),
ranked AS (SELECT *, max(s) OVER w AS top, bool_and(high) OVER w AS all_high FROM votes WINDOW w AS (PARTITION BY response_id, feature_id)),
led AS (SELECT *, count(*) FILTER (WHERE s = top) OVER (PARTITION BY response_id, feature_id) AS leaders FROM ranked),
every AS (SELECT response_id, feature_id, string_agg(span, ',' ORDER BY source_identifier) AS all_spans FROM claims GROUP BY ALL)
SELECT DISTINCT response_id, feature_id, feature_group, opportunity_class, CASE WHEN leaders = 1 THEN status ELSE 'unclear' END AS status, CASE WHEN leaders = 1 THEN disposition ELSE 'unclear' END AS disposition, CASE WHEN leaders = 1 THEN stance ELSE 'unclear' END AS stance,
  CASE WHEN leaders = 1 THEN causal_role ELSE 'unclear' END AS causal_role, 'judge_ensemble' AS extraction_source, '{source}' AS source_identifier, CASE WHEN leaders = 1 THEN spans ELSE all_spans END AS evidence,
  leaders = 1 AND complete AS complete_proposition_evidence, CASE WHEN CASE WHEN leaders = 1 THEN high ELSE all_high END THEN 'high' ELSE 'medium' END AS confidence
FROM led JOIN every USING (response_id, feature_id) WHERE s = top"""


def _vote(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    claims = view(spark, sf_dir, "claims").withColumn("evidence", F.array("span")).withColumn("actor_or_relation", F.array().cast("array<string>"))
    return ensemble.vote(claims, strategy).drop("actor_or_relation").withColumn("evidence", F.array_join("evidence", ","))


@query("q_DOM7_majority", _vote_sql("1.0", "majority"))
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vote(spark, sf_dir, "majority")


@query("q_DOM7_confidence", _vote_sql("CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END", "confidence_majority"))
def confidence_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vote(spark, sf_dir, "confidence_majority")


# ---------------------------------------------------------------- text and identity


@query("q_STR1", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORDS_SQL}')) AS INTEGER) AS n FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))


@query("q_STR3", "SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS h FROM documents")
def newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.newlines(F.col("text")).cast("binary")).alias("h"))


@query("q_STR11", r"SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.;:\n]+'), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n FROM documents")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"))


@query("q_STR19", "SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS name FROM pages")
def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.sanitised(F.col("url")).alias("name"))


@query("q_H2", "SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS length FROM pages")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ident.sha256_text(F.col("html")).alias("sha256"), F.octet_length("html").cast("long").alias("length"))


@query("q_VAL40", "SELECT doc_id, sha256(concat_ws(chr(31), coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS h FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ident.content_hash(F.col("lang"), F.col("source"), F.col("text")).alias("h"))


H1_SQL = """SELECT doc_id, '{' || concat_ws(',', '"lang":' || CAST(to_json(lang) AS VARCHAR), '"n_chars":' || n_chars, '"source":' || CAST(to_json(source) AS VARCHAR)) || '}' AS canonical FROM documents"""


@query("q_H1", H1_SQL)
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("source", "lang", "n_chars")).alias("j"))
    return rows.select("doc_id", ident.canonical_json(F.col("j")).alias("canonical"))


@query("q_H4", "SELECT page_id, lower(concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3), substr(h, 21, 12))) AS id FROM (SELECT page_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)")
def uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ident.uuid5(F.col("url")).alias("id"))


# ---------------------------------------------------------------- jobs

JOBS = f"""{with_('claims')}, f AS (SELECT response_id AS custom_id, feature_id, feature_group, row_number() OVER (PARTITION BY response_id ORDER BY feature_id) - 1 AS i FROM claims WHERE source_identifier = 'j0')
SELECT custom_id, 'feature' AS job_type, custom_id || '::feature::' || i AS job_id, feature_id FROM f
UNION ALL SELECT response_id, 'relation', response_id || '::relation::' || unnest([{', '.join(repr(t) for t in RELATIONS)}]), NULL FROM responses
UNION ALL SELECT response_id, 'factual', response_id || '::factual::T0', NULL FROM responses UNION ALL SELECT response_id, 'semantic', response_id || '::semantic::0', NULL FROM responses"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "claims").where("source_identifier = 'j0'")
    return c.groupBy(F.col("response_id").alias("custom_id")).agg(F.array_sort(F.collect_list(F.struct("feature_id", "feature_group"))).alias("features")).withColumn("factual_targets", F.array(F.lit("T0")))


@query("q_DOM15", JOBS)
def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swarm.decompose(_requests(spark, sf_dir)).select("custom_id", "job_type", "job_id", "feature_id")


@query("q_AGG14", f"SELECT job_type, count(*) FILTER (WHERE md5(job_id) >= '2') AS n_ok, count(*) FILTER (WHERE md5(job_id) < '2') AS n_failed, count(*) FILTER (WHERE md5(job_id) < '1') AS n_truncated FROM ({JOBS}) GROUP BY ALL")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("job_id").cast("binary"))
    return swarm.run_report(swarm.decompose(_requests(spark, sf_dir)).withColumn("ok", h >= "2").withColumn("truncated", h < "1"))


@query("q_H9", f"SELECT custom_id, job_id FROM ({JOBS}) WHERE md5(job_id) < '2'")
def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a resumed run still has to do: those without a good row."""
    jobs_ = swarm.decompose(_requests(spark, sf_dir))
    done = swarm.done_ids(jobs_.withColumn("ok", F.md5(F.col("job_id").cast("binary")) >= "2"), "job_id", only_ok=True)
    return jobs_.select("custom_id", "job_id").join(done, "job_id", "left_anti")


@query("q_DOM13", "SELECT item_family_id, prompt_variant, repetition_index, CAST(100 + 1000 * repetition_index + row_number() OVER (ORDER BY item_family_id, prompt_variant, repetition_index) - 1 AS BIGINT) AS seed FROM (SELECT concat('F', 100 + unnest(range(24))) AS item_family_id), (SELECT unnest(['A_neutral', 'B_explicit', 'C_hm_control']) AS prompt_variant), (SELECT CAST(unnest(range(5)) AS INTEGER) AS repetition_index)")
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = view(spark, sf_dir, "families").select(F.concat(F.lit("F"), F.col("f") + 100).alias("item_family_id"))
    return swarm.cells(families, VARIANTS, 4, 100).select("item_family_id", "prompt_variant", "repetition_index", F.col("seed").cast("long"))


# ---------------------------------------------------------------- statistics


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expert labels, and what a judge made of them: wrong for one digit of md5."""
    wrong = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) == "0"
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"), ((F.col("quality") == 1) != wrong).alias("judged"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("stratum"))


LABELS = "l AS (SELECT doc_id, quality = 1 AS gold, (quality = 1) <> (substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) = '0') AS judged, concat('s', doc_id % 3) AS stratum FROM labels)"
COUNTED = "c AS (SELECT stratum, count(*) FILTER (WHERE gold AND judged) AS tp, count(*) FILTER (WHERE NOT gold AND judged) AS fp, count(*) FILTER (WHERE gold AND NOT judged) AS fn, count(*) FILTER (WHERE NOT gold AND NOT judged) AS tn FROM l GROUP BY 1)"


@query("q_ST2", f"WITH {LABELS}, {COUNTED} SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.precision_recall(_labels(spark, sf_dir), ["stratum"], "gold", "judged")


@query("q_ST3", f"""WITH {LABELS}, r AS (SELECT stratum, doc_id, unnest([gold, judged]) AS v FROM l), u AS (SELECT stratum, doc_id, v, count(*) AS n FROM r GROUP BY ALL),
o AS (SELECT stratum, sum(n * (n - 1)) AS same, sum(n) AS total FROM u GROUP BY 1), e AS (SELECT stratum, sum(nv * (nv - 1)) AS expected FROM (SELECT stratum, v, sum(n) AS nv FROM u GROUP BY ALL) GROUP BY 1)
SELECT stratum, CAST(total AS BIGINT) AS n_pairable, {sql9('1 - (1 - same::DOUBLE / total) / (1 - expected::DOUBLE / (total * (total - 1)))')} AS alpha FROM o JOIN e USING (stratum)""")
def alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _labels(spark, sf_dir).select("stratum", "doc_id", F.explode(F.array("gold", "judged")).alias("v"))
    return stats.krippendorff_nominal(ratings, "doc_id", "v", ["stratum"]).withColumn("alpha", r9("alpha"))


@query("q_ST5", f"WITH {LABELS}, {COUNTED}, p AS (SELECT stratum, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS p, (tp + tn + fp + fn)::DOUBLE AS n, {stats.Z95}::DOUBLE AS z FROM c) SELECT stratum, {sql9('(p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)')} AS lower, {sql9('(p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)')} AS upper FROM p")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.precision_recall(_labels(spark, sf_dir), ["stratum"], "gold", "judged")
    low, high = stats.wilson(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.select("stratum", r9(low).alias("lower"), r9(high).alias("upper"))


@query("q_ST9", """WITH t AS (SELECT c_custkey AS test_id, c_nationkey AS fam, (c_custkey * 7919 % 1009 + 1)::DOUBLE / 1010 AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, test_id) AS rank, count(*) OVER (PARTITION BY fam) AS m FROM t)
SELECT test_id, fam, round(p, 9) AS p, CAST(rank AS INTEGER) AS rank, round(least(1.0, min(p * m / rank) OVER (PARTITION BY fam ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)), 9) AS bh, round(least(1.0, max(p * (m - rank + 1)) OVER (PARTITION BY fam ORDER BY rank ROWS UNBOUNDED PRECEDING)), 9) AS holm FROM r""")
def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("test_id"), F.col("c_nationkey").alias("fam"), ((F.col("c_custkey") * 7919 % 1009 + 1).cast("double") / 1010).alias("p"))
    out = stats.adjust(t, "p", ["fam"])
    return out.withColumns({c: F.round(c, 9) for c in ("p", "bh", "holm")})


@query("q_ST15", f"""WITH c AS (SELECT label, list(x ORDER BY i) AS mean FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1)
SELECT vec_id, {sql9('list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * mean[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(mean, lambda x: x * x))))').replace('9)', '7)')} AS similarity FROM embeddings JOIN c USING (label)""")
def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return e.join(mean, "label").select("vec_id", (F.round(stats.cosine(F.col("embedding"), F.col("mean")), 7) + F.lit(0.0)).alias("similarity"))


@query("q_ST16", "SELECT c_custkey, CASE WHEN b < 30 THEN 'development' WHEN b < 60 THEN 'calibration' ELSE 'test' END AS part FROM (SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_nationkey AS VARCHAR)), 1, 7) AS BIGINT) % 100 AS b FROM customer)")
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", stats.partition_of(F.col("c_nationkey")).alias("part"))


# ---------------------------------------------------------------- event time


@query("q_WINDOW", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("q_SESSION", "WITH x AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 minutes THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))
