"""One extraction request as many small jobs, and their results as one row again; request selection and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontoscore.fixed import RELATIONS, RUBRIC_VERSION, SCHEMA_VERSION

MODES = ("feature", "feature_group", "relation", "factual", "all")


def decompose(requests: DataFrame, mode: str = "all") -> DataFrame:
    """requests: custom_id, features (array of structs with feature_id, feature_group), factual_targets (array of ids).

    Returns custom_id, job_id, job_type, index, feature_id, feature_group, position (order within the request).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    null = F.lit(None).cast("string")

    def job(kind: str, index: Column, feature_id: Column = null, group: Column = null) -> Column:
        return F.struct(F.lit(kind).alias("job_type"), index.cast("string").alias("index"), feature_id.alias("feature_id"), group.alias("feature_group"))

    parts = []
    if mode in ("feature", "all"):
        parts.append(F.transform("features", lambda x, i: job("feature", i, x["feature_id"], x["feature_group"])))
    if mode == "feature_group":
        parts.append(F.transform(F.array_distinct(F.transform("features", lambda x: x["feature_group"])), lambda g: job("feature_group", g, null, g)))
    if mode in ("relation", "all"):
        parts.append(F.array(*[job("relation", F.lit(t)) for t in RELATIONS]))
    if mode in ("factual", "all"):
        parts.append(F.transform(F.filter("factual_targets", lambda t: F.coalesce(t, F.lit("")) != ""), lambda t: job("factual", t)))
    if mode == "all":
        parts.append(F.array(job("semantic", F.lit("0"))))
    jobs = requests.select("custom_id", F.posexplode(F.concat(*parts)).alias("position", "job"))
    return jobs.select("custom_id", F.concat_ws("::", "custom_id", "job.job_type", "job.index").alias("job_id"), "job.job_type", "job.index", "job.feature_id", "job.feature_group", "position")


def reduce(requests: DataFrame, outputs: DataFrame, mode: str = "all", latest_attempt_wins: bool = False) -> DataFrame:
    """requests as for decompose(); outputs: line_no, custom_id, job_id, job_type, index, ok, error, truncated, claims (array of claims),
    relation, fact, semantic. One row per request: ok, judge_output (claims by index, relations in the fixed order, facts and the first
    semantic assessment in line order), failed_jobs and counts.

    Every attempt counts unless latest_attempt_wins: then only the last one of a job does.
    """
    rows = outputs
    if latest_attempt_wins:
        last = outputs.groupBy("job_id").agg(F.max("line_no").alias("line_no"))
        rows = outputs.join(last, ["job_id", "line_no"], "left_semi")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    ordered = lambda cond, *cols: F.array_sort(F.collect_list(F.when(cond, F.struct("line_no", *cols))))
    agg = rows.groupBy("custom_id").agg(
        F.count("*").alias("n_jobs"), F.count_if(ok).alias("n_ok"),
        ordered(ok & F.col("job_type").isin("feature", "feature_group"), "claims").alias("c"),
        ordered(ok & (F.col("job_type") == "relation"), "relation").alias("r"),
        ordered(ok & (F.col("job_type") == "factual") & F.col("fact").isNotNull(), "fact").alias("f"),
        ordered(ok & (F.col("job_type") == "semantic"), "semantic").alias("s"),
        ordered(~ok, "job_id", "job_type", "index", "error", F.coalesce("truncated", F.lit(False)).alias("truncated")).alias("bad"),
    )
    x = requests.join(agg, "custom_id", "left")
    claims = F.coalesce(F.flatten(F.transform("c", lambda j: j["claims"])), F.lit(None))
    x = x.withColumn("seen", claims)
    indices = F.array_sort(F.array_distinct(F.filter(F.transform("seen", lambda c: c["claim_index"]), lambda i: i.isNotNull())))
    x = x.withColumn("claims", F.transform(indices, lambda i: F.element_at(F.filter("seen", lambda c: c["claim_index"] == i), -1)))
    last_of = lambda t: F.try_element_at(F.filter("r", lambda j: j["relation"]["relation_type"] == t), F.lit(-1))["relation"]
    x = x.withColumn("relations", F.filter(F.array(*[last_of(t) for t in RELATIONS]), lambda v: v.isNotNull()))
    x = x.withColumn("facts", F.transform("f", lambda j: j["fact"]))
    x = x.withColumn("semantic", F.try_element_at("s", F.lit(1))["semantic"])
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    want = lambda modes, n: n if mode in modes else F.lit(0)
    expected = {
        "claims": want(("feature", "feature_group", "all"), F.size("features")),
        "relations": want(("relation", "all"), F.lit(len(RELATIONS))),
        "facts": want(("factual", "all"), F.size(F.filter("factual_targets", lambda t: F.coalesce(t, F.lit("")) != ""))),
    }
    good = size("bad") == 0
    for name, n in expected.items():
        good = good & ((n == 0) | (size(name) == n)) if name != "facts" else good & (size(name) == n)
    return x.select(
        "custom_id", good.alias("ok"), F.lit(mode).alias("mode"),
        F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(RUBRIC_VERSION).alias("rubric_version"), F.lit("ok").alias("parse_status"), "claims", "relations", F.col("facts").alias("factual_assessments"), F.col("semantic").alias("semantic_response_assessment")).alias("judge_output"),
        F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"), F.coalesce("n_ok", F.lit(0)).alias("n_ok"), F.transform("bad", lambda b: b.dropFields("line_no")).alias("failed_jobs"),
        *[n.cast("long").alias(f"expected_{name}") for name, n in expected.items()], *[size(name).cast("long").alias(f"observed_{name}") for name in expected],
    )


def run_report(outputs: DataFrame) -> DataFrame:
    """Jobs by type: good, failed, truncated."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return outputs.groupBy("job_type").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("n_truncated"))


def select_rows(requests: DataFrame, done: DataFrame | None = None, start: int = 1, ids: list[str] | None = None, families: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Requests to run: from a line on, not done yet, of the given ids and families, the first `limit` by line."""
    rows = requests.where(F.col("line_no") >= start)
    if ids is not None:
        rows = rows.where(F.col("custom_id").isin(ids))
    if families is not None:
        rows = rows.where(F.col("item_family_id").isin(families))
    if done is not None:
        rows = rows.join(done.select("custom_id").distinct(), "custom_id", "left_anti")
    return rows.orderBy("line_no").limit(limit) if limit is not None else rows


def done_ids(outputs: DataFrame, column: str = "custom_id", only_ok: bool = False) -> DataFrame:
    """Ids that a resumed run leaves out: those with any earlier row, or with only_ok those with a good one."""
    return (outputs.where("ok") if only_ok else outputs).select(column).where(F.col(column).isNotNull()).distinct()


def last_by_line(rows: DataFrame, key: str = "custom_id") -> DataFrame:
    """The last row of each key."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "line_no").alias("b"))
    return best.select(key, "b.*")


def cells(families: DataFrame, variants: list[str], stochastic: int, seed: int) -> DataFrame:
    """Every family, variant and repetition (0 is deterministic) with its running number and seed + 1000 * repetition + number."""
    every = families.select("item_family_id", F.explode(F.array(*[F.lit(v) for v in variants])).alias("prompt_variant"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(stochastic))).alias("repetition_index"))
    # a plan of some hundred cells
    number = F.row_number().over(Window.orderBy("item_family_id", "prompt_variant", "repetition_index")) - 1
    every = every.withColumn("cell", number)
    return every.withColumn("seed", F.lit(seed) + F.col("repetition_index") * 1000 + F.col("cell")).withColumn("decoding", F.when(F.col("repetition_index") == 0, "deterministic").otherwise("stochastic"))
