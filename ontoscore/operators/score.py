"""Scores of responses: gated coverage, pooled accuracy, coherence, rates and evidence-qualified flags.

The wide table comes from one aggregation over all observations of an extraction (claims, relations and facts in one long table), so
that it costs one exchange by the extraction triple instead of a join for each block of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoscore.fixed import AI_FLAG, CHAIN_WEIGHTS, COHERENCE, DIMENSIONS, FACT_VALUES, GROUPS, RATES, RELATIONS, SEVERE, STATUSES, K

MINIMUM = 0.80
#: The relations that the wide table reports.
REPORTED = ["causal_chain_structure", "recuperative_closure", "strategy_implication"]


def mapped(col: Column, values: dict[str, float]) -> Column:
    """The double of a category; null for any other."""
    out = F.when(F.lit(False), F.lit(0.0))
    for key, v in values.items():
        out = out.when(col == key, F.lit(float(v)))
    return out


def code(col: Column, values: list[str]) -> Column:
    """The place of a category among the sorted values; null for any other. Numbers let an aggregation hash where strings make it sort."""
    out = F.when(F.lit(False), F.lit(0))
    for i, v in enumerate(sorted(values)):
        out = out.when(col == v, F.lit(i))
    return out


def decoded(col: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in sorted(values)]), col)


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def gated(true_n: Column, assessable_n: Column, planned_n: Column, minimum: float) -> Column:
    return F.when(ratio(assessable_n, planned_n) >= F.lit(float(minimum)), ratio(true_n, assessable_n))


def dimension_counts(claims: DataFrame) -> DataFrame:
    """Counts by extraction, feature group and opportunity class."""
    return claims.groupBy(*K, "feature_group", "opportunity_class").agg(
        F.count("*").alias("planned_n"),
        F.count_if(F.col("status").isin("true", "false")).alias("assessable_n"),
        F.count_if(F.col("status") == "true").alias("true_n"),
        F.count_if(F.col("status") == "unclear").alias("unclear_n"),
        F.count_if(F.col("status") == "not_assessable").alias("not_assessable_n"),
    )


def with_scores(counts: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    return counts.withColumns({
        "assessability": ratio(F.col("assessable_n"), F.col("planned_n")),
        "score": gated(F.col("true_n"), F.col("assessable_n"), F.col("planned_n"), minimum),
        "worst_case_score": ratio(F.col("true_n"), F.col("planned_n")),
    })


def dimension_scores(claims: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """Coverage is suppressed (null) where fewer than `minimum` of the planned observations are assessable."""
    return with_scores(dimension_counts(claims), minimum)


def feature_dimension(claims: DataFrame, group: str, opportunity_class: str | None, minimum: float = MINIMUM) -> DataFrame:
    """One dimension by extraction; without a class all classes count together."""
    q = claims.where(F.col("feature_group") == group)
    if opportunity_class is not None:
        q = q.where(F.col("opportunity_class") == opportunity_class)
    return with_scores(dimension_counts(q.withColumn("opportunity_class", F.lit(opportunity_class or "all"))).drop("feature_group", "opportunity_class"), minimum)


def accuracy_wide(claims: DataFrame) -> DataFrame:
    rows = claims.where("feature_group = 'accuracy'").select(*K, "feature_id", "status")
    return rows.groupBy(*K).pivot("feature_id", GROUPS["accuracy"]).agg(F.min("status"))


def relation_wide(relations: DataFrame) -> DataFrame:
    return relations.select(*K, "relation_type", "relation_value").groupBy(*K).pivot("relation_type", list(RELATIONS)).agg(F.min("relation_value"))


def relation_list(wide: DataFrame) -> DataFrame:
    """The relations of an extraction in the fixed order, absent types left out."""
    entries = F.array(*[F.struct(F.lit(t).alias("relation_type"), F.col(t).alias("relation_value")) for t in RELATIONS])
    return wide.select(*K, F.filter(entries, lambda x: x["relation_value"].isNotNull()).alias("relations"))


def pooled_accuracy(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Mean of the assessable textual and factual observations, and their number."""
    text = claims.where("feature_group = 'accuracy'").select(*K, mapped(F.col("status"), {"true": 1, "false": 0}).alias("value"))
    seen = text.unionByName(facts.select(*K, mapped(F.col("status"), FACT_VALUES).alias("value")))
    return seen.groupBy(*K).agg(F.avg("value").alias("accuracy"), F.count("value").alias("accuracy_assessable_n"))


def afforded() -> Column:
    return F.col("opportunity_class").isin("primary", "secondary_afforded")


def disposition_rates(claims: DataFrame) -> DataFrame:
    return claims.where(afforded()).groupBy(*K).agg(*[ratio(F.count_if(F.col("disposition") == d), F.count("*")).alias(name) for name, d in RATES.items()])


def qualified() -> Column:
    """The five conditions of a severe endorsement, without the feature."""
    same = [F.col("status") == "true", F.col("disposition") == "instantiated", F.col("stance") == "endorsed", F.col("confidence") == "high", F.col("complete_proposition_evidence").eqNullSafe(F.lit(True))]
    out = same[0]
    for x in same[1:]:
        out = out & x
    return F.coalesce(out, F.lit(False))


def severe_flags(claims: DataFrame) -> DataFrame:
    rows = claims.where("feature_group = 'endorsement' AND opportunity_class = 'monitor_only'")
    return rows.groupBy(*K).agg(*[F.bool_or((F.col("feature_id") == f) & qualified()).alias(f"{f}_flag") for f in SEVERE])


def recuperative_closure(contradiction: Column, sequence: Column, outcome: Column, reform: Column, terminal: Column) -> Column:
    """All five conditions of a recuperative closure over relation values; the last one comes with the caller's data."""
    all_ = (contradiction == "recognized") & (sequence == "recognition_then_closure") & (outcome == "preserved") & reform.isin("capitalist_stabilization", "terminal_substitute") & terminal
    return F.coalesce(all_, F.lit(False))


COUNTS = ["planned_n", "assessable_n", "true_n", "unclear_n", "not_assessable_n"]


def observations(claims: DataFrame, relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims, relations and facts as one long table: kind, name, value and what claims have besides."""
    none = lambda kind: F.lit(None).cast(kind)
    c = claims.select(*K, F.lit("claim").alias("kind"), F.col("feature_id").alias("name"), F.col("status").alias("value"), "feature_group", "opportunity_class", "disposition", qualified().alias("qualified"))
    r = relations.select(*K, F.lit("relation").alias("kind"), F.col("relation_type").alias("name"), F.col("relation_value").alias("value"), none("string").alias("feature_group"), none("string").alias("opportunity_class"), none("string").alias("disposition"), F.lit(False).alias("qualified"))
    f = facts.select(*K, F.lit("fact").alias("kind"), F.col("factual_target_id").alias("name"), F.col("status").alias("value"), none("string").alias("feature_group"), none("string").alias("opportunity_class"), none("string").alias("disposition"), F.lit(False).alias("qualified"))
    return c.unionByName(r).unionByName(f)


def response_metrics(claims: DataFrame, relations: DataFrame, facts: DataFrame, authoritative: DataFrame, minimum: float = MINIMUM, anchor: str | None = None) -> DataFrame:
    """One wide row per extraction.

    anchor 'recognition' keeps extractions with a planned recognition feature only, and leaves rates and flags null where they have no
    observations; otherwise every extraction with a planned feature of any dimension is kept, with rates 0 and flags false. Of several
    values for one feature or relation the first in the alphabet counts; values outside the fixed lists are no values (the rules report them).
    """
    seen = observations(claims, relations, facts)
    aggs: list[Column] = []
    status, name, kind = F.col("value"), F.col("name"), F.col("kind")
    for p, (group, cls) in DIMENSIONS.items():
        own = (kind == "claim") & (F.col("feature_group") == group) & (F.col("opportunity_class") == cls)
        conditions = {"planned_n": own, "assessable_n": own & status.isin("true", "false"), "true_n": own & (status == "true"), "unclear_n": own & (status == "unclear"), "not_assessable_n": own & (status == "not_assessable")}
        aggs += [F.count_if(c).alias(f"{p}_{n}") for n, c in conditions.items()]
    accuracy = (kind == "claim") & (F.col("feature_group") == "accuracy")
    aggs += [F.min(F.when(accuracy & (name == f), code(status, STATUSES))).alias(f) for f in GROUPS["accuracy"]]
    aggs += [F.min(F.when((kind == "relation") & (name == t), code(status, RELATIONS[t]))).alias(f"_{t}") for t in REPORTED]
    value = F.when(accuracy, mapped(status, {"true": 1, "false": 0})).when(kind == "fact", mapped(status, FACT_VALUES))
    aggs += [F.avg(value).alias("accuracy"), F.count(value).alias("accuracy_assessable_n")]
    aggs.append(F.count_if(accuracy | (kind == "fact")).alias("_pooled_n"))
    aff = (kind == "claim") & afforded()
    aggs.append(F.count_if(aff).alias("_afforded_n"))
    aggs += [F.count_if(aff & (F.col("disposition") == d)).alias(f"_{n}") for n, d in RATES.items()]
    monitored = (kind == "claim") & (F.col("feature_group") == "endorsement") & (F.col("opportunity_class") == "monitor_only")
    aggs.append(F.count_if(monitored).alias("_monitored_n"))
    aggs += [F.bool_or(monitored & (name == f) & F.col("qualified")).alias(f"_{f}") for f in SEVERE]
    wide = seen.groupBy(*K).agg(*aggs)
    wide = wide.withColumns({f: decoded(F.col(f), STATUSES) for f in GROUPS["accuracy"]} | {f"_{t}": decoded(F.col(f"_{t}"), RELATIONS[t]) for t in REPORTED})
    some = " OR ".join(f"{p}_planned_n > 0" for p in (["recognition"] if anchor else DIMENSIONS))
    wide = wide.where(some).join(authoritative.select(*K, "relevance", "format_compliant", "within_response_budget", "response_complete", "refusal", "truncated", "parse_status", "alternative_causal_frame"), K, "left")
    out: list[Column] = [F.col(k) for k in K]
    for p in DIMENSIONS:
        has = lambda c, p=p: F.when(F.col(f"{p}_planned_n") > 0, c)
        t, a, n = (F.col(f"{p}_{x}") for x in ("true_n", "assessable_n", "planned_n"))
        out += [gated(t, a, n, minimum).alias(f"{p}_score"), ratio(a, n).alias(f"{p}_assessability"), ratio(t, n).alias(f"{p}_worst_case_score")]
        out += [has(F.col(f"{p}_{x}")).alias(f"{p}_{x}") for x in COUNTS]
    chain = mapped(F.col("_causal_chain_structure"), CHAIN_WEIGHTS)
    checks = [F.col("relevance").cast("int").cast("double"), *[mapped(F.col(f), {"true": 1, "false": 0}) for f in COHERENCE]]
    n = sum((c.isNotNull().cast("int") for c in checks[1:]), checks[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in checks[1:]), F.coalesce(checks[0], F.lit(0.0)))
    coherence = F.when(checks[0].isNotNull() & (n >= 5), chain * total / n)
    flag = {f: F.col(f"_{f}") if not anchor else F.when(F.col("_monitored_n") > 0, F.col(f"_{f}")) for f in SEVERE}
    any_flag = F.lit(False)
    for f in SEVERE:
        any_flag = any_flag | F.coalesce(F.col(f"_{f}"), F.lit(False))
    rate = lambda x: ratio(F.col(f"_{x}"), F.col("_afforded_n")) if anchor else F.coalesce(ratio(F.col(f"_{x}"), F.col("_afforded_n")), F.lit(0.0))
    out += [
        mapped(F.col("_recuperative_closure"), {"true": 1, "false": 0}).alias("recuperative_closure_score"),
        F.col("_strategy_implication").alias("strategy"),
        chain.alias("chain_weight"),
        *[F.col(f) for f in GROUPS["accuracy"]],
        *[F.col(c) for c in ("relevance", "format_compliant", "within_response_budget", "response_complete", "refusal", "truncated", "parse_status", "alternative_causal_frame")],
        F.col("accuracy"), F.when(F.col("_pooled_n") > 0, F.col("accuracy_assessable_n")).alias("accuracy_assessable_n"),
        *[rate(x).alias(x) for x in RATES],
        *[F.coalesce(c, F.lit(False)).alias(f"{f}_flag") if not anchor else c.alias(f"{f}_flag") for f, c in flag.items()],
        coherence.alias("causal_coherence"),
        instruction_following().alias("instruction_following"),
        any_flag.alias("any_severe_endorsement"),
    ]
    return wide.select(*out)


def instruction_following() -> Column:
    """Mean of four booleans; null if any is."""
    return sum((F.col(c).cast("int") for c in ("format_compliant", "within_response_budget", "response_complete")), F.col("relevance").cast("int")).cast("double") / F.lit(4.0)


def misplaced_ai_flags(metrics: DataFrame, response_index: DataFrame) -> DataFrame:
    """Extractions of items not about AI that have the AI endorsement flag; there should be none."""
    return metrics.join(response_index.select("response_id", "ai_eligible"), "response_id").where(~F.col("ai_eligible") & F.col(f"{AI_FLAG}_flag")).select(*K)
