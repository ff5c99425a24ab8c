import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from golden import authoritative, exports
from ontoscore.fixed import K, STATES
from ontoscore.operators import assess, effects, ensemble, flatten, score
from ontoscore.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def metrics(spark):
    p = flatten.parse(exports(spark)).cache()
    return score.response_metrics(flatten.claim_long(p), flatten.relation_long(p), flatten.factual_long(p), authoritative(spark)).cache()


def test_golden(metrics):
    rows = {r["response_id"]: r for r in metrics.collect()}
    want = {"r0": (0, 1, 0, 0, 3 / 9), "r1": (1, 0, 1, 1, 1 / 9), "r2": (1, 0, 1, 0, 2 / 9)}
    for k, v in want.items():
        r = rows[k]
        got = (r["recognition_score"], r["neoclassical_score"], r["institutionalist_score"], r["liberal_score"], r["omission_rate"])
        assert got == pytest.approx(v, abs=1e-12)
        assert (r["causal_coherence"], r["accuracy"], r["instruction_following"], r["recuperative_closure_score"]) == (1.0, 1.0, 1.0, 0.0)
        assert (r["denial_rate"], r["displacement_rate"], r["mention_only_rate"], r["any_severe_endorsement"]) == (0.0, 0.0, 0.0, False)


def test_golden_deltas(spark, metrics):
    deltas = effects.matched_deltas(effects.metric_cells(metrics, exports(spark)))
    r = deltas.where("dimension = 'recognition_score'").first()
    assert (r["delta_explicit_minus_neutral"], r["delta_control_minus_neutral"]) == (1.0, 1.0)


def test_strategies(spark, metrics):
    r = effects.strategy_transitions(metrics, exports(spark)).first()
    assert (r["A_strategy"], r["B_strategy"]) == (["transitional"], ["transitional"])


def claims_of(spark, rows):
    return spark.createDataFrame([("r", "judge", "j", *r) for r in rows], ", ".join(f"{k} string" for k in K) + ", feature_id string, feature_group string, opportunity_class string, status string")


def test_gate_suppresses_and_ignores_monitored(spark):
    g = "material_relation_recognition"
    df = claims_of(spark, [("a", g, "primary", "true"), ("b", g, "primary", "unclear"), ("c", g, "monitor_only", "false")])
    r = score.feature_dimension(df, g, "primary").first()
    assert (r["planned_n"], r["assessable_n"], r["score"], r["worst_case_score"]) == (2, 1, None, 0.5)


def test_gate_holds_at_four_fifths(spark):
    g = "material_relation_recognition"
    df = claims_of(spark, [(x, g, "primary", "true") for x in "abcd"] + [("e", g, "primary", "unclear")])
    assert score.feature_dimension(df, g, "primary").first()["score"] == 1.0


def test_anchor_leaves_out_extractions_without_recognition(spark):
    every, anchored = Q.metrics_of(spark, SF).count(), Q.metrics_of(spark, SF, "recognition").count()
    assert anchored < every


@pytest.mark.parametrize(("r", "lib", "q", "ra", "want"), [(0.5, 0.0, 0.0, 1.0, 1), (0.1, 0.9, None, 1.0, 2), (0.1, 0.1, None, 1.0, 3), (0.5, 0.0, 1.0, 1.0, 4), (0.5, 0.0, None, 1.0, 5), (None, None, 0.0, 0.5, 0), (None, None, None, None, 0)])
def test_states(spark, r, lib, q, ra, want):
    df = spark.createDataFrame([(r, lib, q, ra, 1.0)], "recognition_score double, liberal_score double, recuperative_closure_score double, recognition_assessability double, liberal_assessability double")
    out = effects.add_states(df, 0.4, 0.5, 1.0).first()
    assert out["measurement_state"] == STATES[want]
    assert out["secondary_composite"] == (None if r is None or q is None else pytest.approx(r * math.exp(-q)))


def test_thresholds_are_checked(metrics):
    with pytest.raises(ValueError, match="thresholds"):
        effects.add_states(metrics, 1.5, 0.5, 0)


def test_sensitivity_matches_direct_evaluation(metrics):
    grid = effects.threshold_sensitivity(metrics, [0.2, 0.5], [0.0, 1.0])
    assert grid.count() == 8
    row = grid.where("t_r = 0.5 AND t_l = 0.2 AND lambda = 1.0").first()
    direct = effects.add_states(metrics, 0.5, 0.2, 1.0)
    n = direct.count()
    assert row["state_distribution"] == {r["measurement_state"]: r["count"] / n for r in direct.groupBy("measurement_state").count().collect()}
    assert row["mean_composite"] == pytest.approx(direct.agg(F.avg("secondary_composite")).first()[0])


def test_codes_keep_the_first_of_the_alphabet(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "?"), (2, "b"), (2, None), (3, "?"), (4, None)], "k int, v string")
    got = df.groupBy("k").agg(F.min(score.code(F.col("v"), ["b", "a", "c"])).alias("i")).select("k", score.decoded(F.col("i"), ["b", "a", "c"]).alias("v"))
    assert {r["k"]: r["v"] for r in got.collect()} == {1: "a", 2: "b", 3: None, 4: None}


def test_bootstrap(spark):
    values = [0.1, 0.4, 0.2, 0.9]
    df = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(values)], "item_family_id string, d double")
    got = effects.family_bootstrap(df, "d", draws=300).first()
    rng = np.random.default_rng(202604)
    sims = [rng.choice(np.array(values), 4, replace=True).mean() for _ in range(300)]
    assert (got["lower"], got["upper"], got["families"]) == (np.quantile(sims, 0.025), np.quantile(sims, 0.975), 4)
    with pytest.raises(Exception, match="two assessable"):
        effects.family_bootstrap(df.limit(1), "d").collect()


def test_missing_variant(spark):
    df = spark.createDataFrame([("m", "f", "A_neutral", 0, 1.0)], "model_snapshot_id string, item_family_id string, prompt_variant string, repetition_index int, x double")
    with pytest.raises(ValueError, match="missing matched variant"):
        effects.variant_deltas(df, "x")


def votes(spark, rows):
    schema = "response_id string, feature_id string, source_identifier string, status string, disposition string, stance string, causal_role string, confidence string, feature_group string, opportunity_class string, evidence array<string>, complete_proposition_evidence boolean, actor_or_relation array<string>"
    return spark.createDataFrame([("r", "f", s, st, d, "endorsed", "cause", c, "g", "primary", [s], e, [s]) for s, st, d, c, e in rows], schema)


def test_votes(spark):
    rows = [("a", "true", "instantiated", "low", True), ("b", "true", "instantiated", "low", True), ("c", "false", "omitted", "high", False)]
    m = ensemble.vote(votes(spark, rows)).first()
    assert (m["status"], m["evidence"], m["complete_proposition_evidence"], m["confidence"]) == ("true", ["a", "b"], True, "medium")
    assert m["source_identifier"] == "3bd0d281-4e74-50bd-b3f7-25db4defc945"
    c = ensemble.vote(votes(spark, rows), "confidence_majority").first()
    assert (c["status"], c["evidence"], c["confidence"], c["source_identifier"]) == ("false", ["c"], "high", "c3748fe8-d7ef-58fa-a9bd-8f44713cceda")


def test_tied_votes_are_unclear(spark):
    r = ensemble.vote(votes(spark, [("b", "true", "instantiated", "high", True), ("a", "false", "omitted", "high", True)])).first()
    assert (r["status"], r["disposition"], r["evidence"], r["complete_proposition_evidence"], r["actor_or_relation"]) == ("unclear", "unclear", ["a", "b"], False, ["a", "b"])
    assert ensemble.disagreements(votes(spark, [("b", "true", "instantiated", "high", True)])).count() == 0


def test_assessment(spark):
    semantic = spark.createDataFrame([("r", "judge", "j", "unclear", False, "ok", "x"), ("s", "judge", "j", "relevant", True, "ok", "x")], ", ".join(f"{k} string" for k in K) + ", relevance string, refusal_detected boolean, parse_status string, alternative_causal_frame string")
    meta = spark.createDataFrame([("r", "one two\r\nthree’s été", 3, True, None, False, False), ("s", "  ", 3, None, "length", None, None)], "response_id string, response_text string, word_limit int, format_compliant_deterministic boolean, finish_reason string, provider_refusal boolean, provider_filtered boolean")
    r, s = assess.authoritative(semantic, meta).orderBy("response_id").collect()
    assert (r["word_count"], r["within_response_budget"], r["response_complete"], r["relevance"], r["refusal"], r["truncated"]) == (4, False, True, None, False, False)
    assert (s["word_count"], s["response_complete"], s["relevance"], s["refusal"], s["truncated"], s["format_compliant"]) == (0, False, True, True, True, False)
    status = {x["response_id"]: x["status"] for x in assess.relevance_claims(assess.authoritative(semantic, meta)).collect()}
    assert status == {"r": "not_assessable", "s": "true"}


def test_closure_rule(spark):
    args = ["recognized", "recognition_then_closure", "preserved", "terminal_substitute", True]
    for i in range(6):
        a = [("x" if j == i and j < 4 else (False if j == i else v)) for j, v in enumerate(args)]
        assert spark.range(1).select(score.recuperative_closure(*[F.lit(v) for v in a])).first()[0] is (i == 5)
