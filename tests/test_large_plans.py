"""Plans of queries that move much if they are planned badly."""

from ontoscore.operators import requests


def joins(plan):
    found = [plan] if plan.nodeName() == "Join" else []
    children = plan.children()
    return found + [j for i in range(children.size()) for j in joins(children.apply(i))]


def test_texts_do_not_go_to_the_banks(spark):
    """A join with the banks by feature needs an exchange, which would take the text along once for each claim."""
    claims = spark.createDataFrame([("r", "f", "g", "true", "cause", ["ab", "", "zz"]), ("r", "f", "accuracy", "true", "cause", ["zz"]), ("x", "f", "g", None, "cause", None)], "response_id string, feature_id string, feature_group string, status string, causal_role string, evidence array<string>")
    relations = spark.createDataFrame([("r", "absent"), ("r", "y")], "response_id string, relation_value string")
    responses = spark.createDataFrame([("r", "abc")], "response_id string, text string")
    banks = spark.createDataFrame([("r", "f", ["ab"]), ("r", "h", ["zz"]), ("r", None, ["zz"])], "response_id string, feature_id string, bank array<string>")
    got = requests.report_metrics(claims, relations, responses, banks, ["absent"])
    to_banks = [j for j in joins(got._jdf.queryExecution().optimizedPlan()) if "banks#" in j.right().output().toString()]
    assert len(to_banks) == 1 and "feature_id#" not in to_banks[0].condition().toString()
    assert "text#" not in to_banks[0].left().output().toString()
    assert sorted(tuple(r) for r in got.collect()) == [("r", 2, 2, 1, 2, 1, 1, 0, 1), ("x", 1, 0, 0, 0, 0, 0, 1, 0)]
    twice = requests.report_metrics(claims, relations, responses, banks.union(banks.where("feature_id = 'f'")), ["absent"]).collect()  # each bank of a feature counts, as in a join
    assert sorted(tuple(r) for r in twice) == [("r", 4, 4, 2, 4, 2, 2, 0, 1), ("x", 1, 0, 0, 0, 0, 0, 1, 0)]
