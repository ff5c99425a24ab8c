import pytest

from ontoscore.operators import requests, rules, stats
from ontoscore.plans.overlay import with_


def test_superiority(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 1.0), ("a", 2, 0.0), ("b", 2, 1.0), ("a", 3, 5.0), ("b", 3, 1.0)], "model string, rep int, v double")
    got = {(r["better"], r["worse"]): r["share"] for r in stats.superiority(df, "model", "v", ["rep"]).collect()}
    assert got == {("a", "b"): pytest.approx(2 / 3), ("b", "a"): pytest.approx(1 / 3)}


def test_model_errors_are_rows(spark):
    def model(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    got = {r["id"]: (r["output"], r["error"]) for r in requests.ask(spark.createDataFrame([("1", "hi"), ("2", "bad")], "id string, prompt string"), model, 2).collect()}
    assert got == {"1": ("HI", None), "2": (None, "ValueError: no")}


def test_hidden_failures_in_strict_mode(spark):
    outputs = spark.createDataFrame([("q", "a", False), ("q", "b", None), ("q", "c", True)], "custom_id string, job_id string, ok boolean")
    reduced = spark.createDataFrame([("q", [("a",)])], "custom_id string, failed_jobs array<struct<job_id:string>>")
    assert [r["key"] for r in rules.hidden_failures(outputs, reduced).collect()] == ["b"]
    assert rules.hidden_failures(outputs, reduced, strict_jobs=True).count() == 3


def test_with_clause_has_what_a_view_needs():
    assert "responses AS" in with_("claims") and "events" not in with_("claims")
