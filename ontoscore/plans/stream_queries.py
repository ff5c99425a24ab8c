"""Queries over streams that stop and start again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoscore.operators import swarm
from ontoscore.plans.operator_queries import scratch
from ontoscore.plans.queries import JOBS, _requests, query
from ontoscore.streaming import arriving


@query("q_DOM16_stream", f"""WITH j AS ({JOBS}), b AS (SELECT *, md5(job_id) >= '2' AS ok FROM j)
SELECT custom_id, count(*) AS version, count(*) FILTER (WHERE ok) AS n_ok, bool_and(ok) AS complete, CAST(count(*) FILTER (WHERE ok AND job_type = 'feature') AS INTEGER) AS n_claims,
  CAST(count(*) FILTER (WHERE ok AND job_type = 'relation') AS INTEGER) AS n_relations, CAST(count(*) FILTER (WHERE ok AND job_type = 'factual') AS INTEGER) AS n_facts, bool_or(ok AND job_type = 'semantic') AS semantic, CAST(count(*) FILTER (WHERE NOT ok) AS INTEGER) AS n_failed
FROM b GROUP BY custom_id""")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of all requests arrive in two parts; the stream stops between them. The rows of the highest version equal the batch reduction."""
    jobs = swarm.decompose(_requests(spark, sf_dir))
    ok = F.md5(F.col("job_id").cast("binary")) >= "2"
    body = F.when(F.col("job_type") == "feature", F.to_json(F.array(F.struct(F.col("position").alias("claim_index"), "feature_id"))))
    body = body.when(F.col("job_type") == "relation", F.to_json(F.struct(F.col("index").alias("relation_type"), F.lit("x").alias("relation_value"))))
    body = body.when(F.col("job_type") == "factual", F.to_json(F.struct(F.col("index").alias("factual_target_id")))).otherwise(F.lit('{"relevance":"relevant"}'))
    n = F.count("*").over(swarm.Window.partitionBy("custom_id"))
    rows = jobs.select(F.col("position").cast("long").alias("line_no"), "custom_id", "job_id", "job_type", "index", ok.alias("ok"), F.lit(None).cast("string").alias("error"), F.when(ok, body).alias("payload"), n.alias("n_expected"), F.timestamp_seconds(F.lit(1767225600) + F.col("position")).alias("at"))
    source, target, check = (scratch(spark, x) for x in ("arriving", "assembled", "checkpoint"))
    half = F.substring(F.md5(F.concat(F.lit("half"), "job_id").cast("binary")), 1, 1) < "8"
    for part in (half, ~half):
        rows.where(part).write.mode("append").parquet(source)
        arriving.run(spark.readStream.schema(arriving.RESULT).parquet(source), target, check).awaitTermination()
    size = lambda c: F.coalesce(F.json_array_length(c), F.lit(0))
    out = arriving.latest(spark.read.parquet(target))
    return out.select("custom_id", "version", "n_ok", "complete", size("claims").alias("n_claims"), size("relations").alias("n_relations"), size("facts").alias("n_facts"), F.col("semantic").isNotNull().alias("semantic"), size("failed").alias("n_failed"))
