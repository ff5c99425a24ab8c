"""Queries of reporting: averages over levels, the trait-method matrix, resampled intervals, ranks and superiority, robustness, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoscore.operators import clusters, resample, stats
from ontoscore.plans.overlay import with_
from ontoscore.plans.queries import KEYS, _over_metrics, metrics_of, query, r9, sql9, table, view

# ---------------------------------------------------------------- agreement on all levels

TOTALLED = "concat_ws(',', CASE WHEN grouping(prompt_variant) = 1 THEN 'prompt_variant' END, CASE WHEN grouping(domain) = 1 THEN 'domain' END)"


@query("q_ST2_levels", f"""{with_('claims')}, p AS (
  SELECT response_id, prompt_variant, domain, feature_id, max(CASE WHEN source_identifier = 'j0' THEN status END) = 'true' AS gold, max(CASE WHEN source_identifier = 'j1' THEN status END) = 'true' AS judged FROM claims GROUP BY ALL),
c AS (
  SELECT prompt_variant, domain, {TOTALLED} AS totalled, feature_id, CASE WHEN grouping(feature_id) = 1 THEN 'micro' ELSE 'unit' END AS average,
    count(*) FILTER (WHERE gold AND judged) AS tp, count(*) FILTER (WHERE NOT gold AND judged) AS fp, count(*) FILTER (WHERE gold AND NOT judged) AS fn FROM p GROUP BY CUBE (prompt_variant, domain, feature_id)),
f AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c),
m AS (SELECT prompt_variant, domain, totalled, NULL AS feature_id, 'macro' AS average, NULL AS tp, NULL AS fp, NULL AS fn, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM f WHERE average = 'unit' GROUP BY 1, 2, 3)
SELECT prompt_variant, domain, totalled, feature_id, average, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {sql9('precision')} AS precision, {sql9('recall')} AS recall, {sql9('f1')} AS f1 FROM (FROM f UNION ALL FROM m)""")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second judge against the first: by feature, pooled (micro) and averaged over features (macro), for each variant, domain and in all."""
    c = view(spark, sf_dir, "claims")
    said = lambda j: F.max(F.when(F.col("source_identifier") == j, F.col("status"))) == "true"
    pairs = c.groupBy("response_id", "prompt_variant", "domain", "feature_id").agg(said("j0").alias("gold"), said("j1").alias("judged"))
    return stats.averages(pairs, "feature_id", "gold", "judged", ["prompt_variant", "domain"]).withColumns({x: r9(x) for x in ("precision", "recall", "f1")})


# ---------------------------------------------------------------- traits by methods

TRAITS = ["recognition_score", "liberal_score", "neoclassical_score", "institutionalist_score", "recuperative_closure_score", "causal_coherence", "accuracy", "instruction_following", "omission_rate", "denial_rate", "displacement_rate", "mention_only_rate"]
JUDGES = ["j0", "j1"]


LONG = f"(SELECT response_id, source_identifier AS method, unnest(range({len(TRAITS)})) AS i, unnest({TRAITS}) AS trait, unnest([{', '.join(TRAITS)}]) AS v FROM m)"


@query("q_ST6_matrix", _over_metrics(f"""SELECT a.trait AS x_trait, a.method AS x_method, b.trait AS y_trait, b.method AS y_method,
  CASE WHEN a.trait = b.trait THEN 'reliability' WHEN a.method = b.method THEN 'traits' ELSE 'both differ' END AS kind, count(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 1 END) AS n,
  CASE WHEN stddev_pop(CASE WHEN b.v IS NOT NULL THEN a.v END) > 1e-6 AND stddev_pop(CASE WHEN a.v IS NOT NULL THEN b.v END) > 1e-6 THEN round(corr(a.v, b.v), 6) + 0.0 END AS r
FROM {LONG} a JOIN {LONG} b ON a.response_id = b.response_id AND (a.method < b.method OR a.method = b.method AND a.i < b.i) GROUP BY ALL"""))
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two of twelve scores by two judges."""
    found = stats.traits_by_methods(metrics_of(spark, sf_dir), "response_id", "source_identifier", JUDGES, TRAITS)
    return found.withColumn("r", F.round("r", 6) + F.lit(0.0))


# ---------------------------------------------------------------- resampling

DRAWS = 1000
VALUES = f"""{with_('claims')}, v AS (SELECT model_snapshot_id, feature_group, item_family_id, round(avg((status = 'true')::INT), 6) AS x FROM claims GROUP BY ALL)"""
SAMPLED = f"""{VALUES}, fam AS (SELECT item_family_id, row_number() OVER (ORDER BY item_family_id) - 1 AS slot FROM (SELECT DISTINCT item_family_id FROM v)), f AS (SELECT count(*) AS n FROM fam),
w AS (SELECT draw, slot, count(*) AS weight FROM (SELECT b AS draw, CAST('0x' || substr(md5('{resample.SEED}:' || b || ':' || s), 1, 7) AS BIGINT) % n AS slot FROM f, range({DRAWS}) t(b), (SELECT unnest(range(n)) AS s FROM f)) GROUP BY ALL),
d AS (SELECT draw, model_snapshot_id, feature_group, {sql9('sum(weight * x) / sum(weight)')} AS mean FROM w JOIN fam USING (slot) JOIN v USING (item_family_id) GROUP BY ALL)"""
BY = ["model_snapshot_id", "feature_group"]


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of affirmed claims of each model and group in each family."""
    c = view(spark, sf_dir, "claims").withColumn("true", (F.col("status") == "true").cast("int"))
    return resample.family_values(c, BY, "item_family_id", "true").withColumn("x", F.round("x", 6))


def _quantile(share: float) -> str:
    return sql9(f"quantile_cont(mean, {share}::DOUBLE)")


@query("q_ST8_interval", f"""{SAMPLED}, e AS (SELECT model_snapshot_id, feature_group, count(*) AS families, {sql9('avg(x)')} AS estimate, avg(x) AS m FROM v GROUP BY ALL),
j AS (SELECT model_snapshot_id, feature_group, (families * m - x) / (families - 1) AS jack, m, families FROM v JOIN e USING (model_snapshot_id, feature_group)),
a AS (SELECT model_snapshot_id, feature_group, CASE WHEN sum((m - jack) ** 2) > 1e-14 THEN sum((m - jack) ** 3) / (6 * sum((m - jack) ** 2) ** 1.5) ELSE 0 END AS acceleration FROM j GROUP BY ALL)
SELECT model_snapshot_id, feature_group, any_value(families) AS families, any_value(estimate) AS estimate, {sql9(f'greatest(0.5::DOUBLE / {DRAWS}, least(1.0::DOUBLE - 0.5::DOUBLE / {DRAWS}, count(*) FILTER (WHERE mean < estimate)::DOUBLE / count(*)))')} AS share_below,
  round(any_value(acceleration), 7) + 0.0 AS acceleration, {_quantile(0.025)} AS lower, {_quantile(0.975)} AS upper FROM d JOIN e USING (model_snapshot_id, feature_group) JOIN a USING (model_snapshot_id, feature_group) GROUP BY ALL""")
def percentile_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of all models and groups, with what corrects them: the share of draws below and the jackknife's acceleration."""
    out = resample.intervals(_values(spark, sf_dir), BY, "item_family_id", DRAWS)
    return out.withColumns({c: r9(c) for c in ("share_below", "lower", "upper")}).withColumn("acceleration", F.round("acceleration", 7) + F.lit(0.0))


@query("q_ST8_adjusted")
def adjusted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias-corrected and accelerated intervals of all models and groups. The normal distribution has no SQL; compared with a plain version."""
    return resample.intervals(_values(spark, sf_dir), BY, "item_family_id", DRAWS, adjusted=True)


@query("q_ST10_ranks", f"""{SAMPLED}, r AS (SELECT feature_group, model_snapshot_id, CAST(row_number() OVER (PARTITION BY draw, feature_group ORDER BY mean DESC, model_snapshot_id) AS INTEGER) AS rank FROM d)
SELECT feature_group, model_snapshot_id, rank, draws, {sql9(f'draws::DOUBLE / {DRAWS}')} AS share FROM (SELECT feature_group, model_snapshot_id, rank, count(*) AS draws FROM r GROUP BY ALL)""")
def resampled_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = resample.draw_means(_values(spark, sf_dir), BY, "item_family_id", DRAWS)
    return resample.rank_shares(means, "model_snapshot_id", ["feature_group"]).withColumn("share", r9("share"))


@query("q_ST10_superiority", f"""{SAMPLED} SELECT a.feature_group, a.model_snapshot_id AS better, b.model_snapshot_id AS worse, count(*) AS draws, {sql9('avg((a.mean > b.mean)::INT)')} AS share
FROM d a JOIN d b ON a.draw = b.draw AND a.feature_group = b.feature_group AND a.model_snapshot_id <> b.model_snapshot_id GROUP BY ALL""")
def resampled_superiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = resample.draw_means(_values(spark, sf_dir), BY, "item_family_id", DRAWS)
    return resample.superiority(means, "model_snapshot_id", ["feature_group"]).withColumn("share", r9("share"))


# ---------------------------------------------------------------- robustness

MINIMA = [0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]


@query("q_ST11_levels", f"""{with_('claims')}, c AS (SELECT {KEYS}, domain, feature_group, opportunity_class, count(*) AS p, count(*) FILTER (WHERE status IN ('true', 'false')) AS a, count(*) FILTER (WHERE status = 'true') AS t FROM claims GROUP BY ALL),
x AS (SELECT *, unnest([{', '.join(f'{m}::DOUBLE' for m in MINIMA)}]) AS minimum FROM c)
SELECT feature_group, opportunity_class, minimum, source_identifier, domain, concat_ws(',', CASE WHEN grouping(source_identifier) = 1 THEN 'source_identifier' END, CASE WHEN grouping(domain) = 1 THEN 'domain' END) AS totalled,
  count(CASE WHEN a::DOUBLE / p >= minimum THEN t::DOUBLE / nullif(a, 0) END) AS n_scored, round(avg(CASE WHEN a::DOUBLE / p >= minimum THEN t::DOUBLE / nullif(a, 0) END), 7) AS mean_score
FROM x GROUP BY feature_group, opportunity_class, minimum, CUBE (source_identifier, domain)""")
def robust_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores for seven minimum assessabilities, by judge, by domain, by both and in all, from one aggregation."""
    c = view(spark, sf_dir, "claims").groupBy("response_id", "extraction_source", "source_identifier", "domain", "feature_group", "opportunity_class").agg(
        F.count("*").alias("planned_n"), F.count_if(F.col("status").isin("true", "false")).alias("assessable_n"), F.count_if(F.col("status") == "true").alias("true_n")
    )
    return stats.robustness_levels(c, MINIMA, ["source_identifier", "domain"]).withColumn("mean_score", F.round("mean_score", 7))


# ---------------------------------------------------------------- clusters


@query("q_ST15_clusters")
def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings. An iteration has no SQL; compared with plain rounds from the same seeds."""
    return clusters.clusters(table(spark, sf_dir, "embeddings"), 8).withColumn("distance", F.round("distance", 6))
