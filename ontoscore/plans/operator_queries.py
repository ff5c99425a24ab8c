"""Registered queries of sources, sinks, spans, identity, adapters and checks that no other query reaches, each with its SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoscore.fixed import EXEMPT_RELATION_VALUES, K
from ontoscore.functions import ident, text
from ontoscore.operators import effects, evidence, flatten, requests, rules, stats, swarm
from ontoscore.plans.overlay import with_
from ontoscore.plans.queries import KEYS, dealt, query, r9, sql9, table, view
from ontoscore.sources import jsonl
from ontoscore.streaming.ingest import durable_append


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; on a local master without one, in a temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="ontoscore-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def digit(col: str) -> F.Column:
    """The first digit of a column's md5: rows are told apart by it in the fixtures below."""
    return F.substring(F.md5(F.col(col).cast("string").cast("binary")), 1, 1)


def sql_digit(col: str) -> str:
    return f"substr(md5(CAST({col} AS VARCHAR)), 1, 1)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


# ---------------------------------------------------------------- sources and sinks

ITEM_LINE = """'{"item_id":' || item_id || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}'"""


@query("q_SRC1", "SELECT item_id, text, CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS line_no FROM benchmark")
def read_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    jsonl.write_jsonl(items(spark, sf_dir).orderBy("item_id").coalesce(1), path)
    return jsonl.read_jsonl(spark, path, "item_id long, text string").select("item_id", "text", "line_no")


@query("q_SRC2", f"SELECT item_id, text FROM benchmark WHERE {sql_digit('item_id')} >= '4'")
def read_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the lines is broken, in one of several ways; the others are read."""
    path, d = scratch(spark, "lines"), digit("item_id")
    line = F.to_json(F.struct("item_id", "text"))
    broken = F.when(d == "0", F.substring(line, 1, 12)).when(d == "1", F.lit("[1]")).when(d == "2", F.lit(" ")).when(d == "3", F.lit("null")).otherwise(line)
    items(spark, sf_dir).select(broken.alias("value")).write.text(path)
    return jsonl.read_jsonl(spark, path, "item_id long, text string", strict=False).select("item_id", "text")


@query("q_SRC3", f"SELECT CAST(doc_id AS VARCHAR) AS key, doc_id, md5(text) AS text_md5, {sql_digit('doc_id')} >= '2' AS key_matches FROM documents WHERE {sql_digit('doc_id')} <> '8' UNION ALL SELECT NULL, NULL, NULL, false FROM documents WHERE {sql_digit('doc_id')} = '8'")
def read_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object of all documents, read in splits. An eighth of the entries names another key than its own; some are no JSON, which are rows without key."""
    path, key, d = scratch(spark, "keyed"), F.col("doc_id").cast("string"), digit("doc_id")
    said = F.to_json(F.struct(F.when(d >= "2", key).otherwise("x").alias("id"), "doc_id", "text"))
    entry = F.concat(F.to_json(key.cast("variant")), F.when(d == "8", F.lit(" = ")).otherwise(F.lit(": ")), said)
    rows = table(spark, sf_dir, "documents").select(F.lit(1).alias("kind"), "doc_id", entry.alias("value"))
    ends = spark.createDataFrame([(0, None, "{"), (2, None, "}")], "kind int, doc_id long, value string")
    whole = rows.union(ends).repartition(1).sortWithinPartitions("kind", "doc_id").withColumn("place", F.monotonically_increasing_id())
    whole.select(F.concat(F.when((F.col("kind") == 1) & (F.col("place") > 1), F.lit(", ")).otherwise(F.lit("")), "value")).write.text(path)
    read = jsonl.read_keyed(spark, path, "struct<id:string,doc_id:long,text:string>", "id")
    return read.select("key", "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "key_matches")


@query("q_SRC7", f"SELECT 'document' AS class, sha256({ITEM_LINE} || chr(10)) AS sha256, CAST(strlen({ITEM_LINE}) + 1 AS BIGINT) AS length FROM benchmark")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each item, with one file of one line."""
    path = scratch(spark, "tree")
    items(spark, sf_dir).withColumn("folder", F.col("item_id")).select("folder", ident.canonical_json(F.to_json(F.struct("item_id", "text"))).alias("value")).repartition(4, "folder").write.partitionBy("folder").text(path)
    return jsonl.inventory(spark, path).select("class", "sha256", "length")


@query("q_SRC8", f"SELECT page_id, CASE WHEN {sql_digit('page_id')} < '2' THEN 'existing' WHEN {sql_digit('page_id')} < '4' THEN 'error' ELSE 'downloaded' END AS status, CAST(CASE WHEN {sql_digit('page_id')} < '2' THEN 0 WHEN {sql_digit('page_id')} < '4' THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN {sql_digit('page_id')} >= '2' AND {sql_digit('page_id')} < '4' THEN 'OSError: no route' END AS error, CASE WHEN {sql_digit('page_id')} >= '4' THEN CAST(strlen(url) AS BIGINT) END AS bytes FROM pages")
def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host that fails for some addresses, every time."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.concat(digit("page_id"), F.lit(" "), "url").alias("url"))

    def fetch(url: str) -> dict:
        if url[0] < "4":
            raise OSError("no route")
        return {"archived_path": f"/{url[2:]}", "source_sha256": "0" * 64, "bytes": len(url[2:].encode()), "content_type": "text/html", "final_url": url}

    got = jsonl.archive(jsonl.archive_plan(p, p.where(F.substring("url", 1, 1) < "2")), fetch)
    return got.select(F.col("source_id").cast("long").alias("page_id"), "status", "attempts", "error", "bytes")


@query("q_H10", f"""SELECT page_id, CASE d WHEN '3' THEN 'moved' ELSE url END AS url, CASE d WHEN '0' THEN 'gone' END AS download_error, CASE d WHEN '1' THEN url END AS planned_url, CASE WHEN d >= '2' AND d < 'a' THEN 7 END AS bytes, CASE WHEN d >= '4' AND d < 'a' THEN url || '/end' END AS final_url
FROM (SELECT page_id, url, {sql_digit('page_id')} AS d FROM pages)""")
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), "url"), digit("source_id")
    none = F.lit(None).cast("string")
    status = F.when(d == "0", "error").when(d == "1", "dry_run").otherwise("downloaded")
    url = F.when(d == "3", "moved").otherwise(F.col("url"))
    final = F.when(d == "3", "moved").when(d == "2", F.col("url")).otherwise(F.concat("url", F.lit("/end")))
    results = p.where(d < "a").select("source_id", url.alias("url"), status.alias("status"), F.lit("/a").alias("archived_path"), F.lit("x").alias("source_sha256"), F.lit(7).alias("bytes"), none.alias("content_type"), final.alias("final_url"), F.when(d == "0", "gone").alias("error"))
    return jsonl.annotated(p, results).select(F.col("source_id").cast("long").alias("page_id"), "url", "download_error", "planned_url", "bytes", "final_url")


@query("q_SNK1", f"SELECT {ITEM_LINE} AS line, CAST(2 AS BIGINT) AS n FROM benchmark")
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    for _ in range(2):
        jsonl.write_jsonl(items(spark, sf_dir).select("text", "item_id"), path, "append")
    return jsonl.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("q_SNK1_replayed", "SELECT doc_id, md5(text) AS text_md5, CAST(1 AS BIGINT) AS n FROM documents")
def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as a stream of batches, then all batches again, as after a run that was not known to be done: each row is there once."""
    source, target = scratch(spark, "arriving"), scratch(spark, "appended")
    docs = table(spark, sf_dir, "documents")
    docs.repartition(4, "doc_id").write.parquet(source)
    for run in range(2):
        rows = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        done = durable_append(rows, target, f"{scratch(spark, 'checkpoint')}-{run}")
        done.awaitTermination()
    return spark.read.parquet(target).groupBy("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count("*").alias("n"))


@query("q_SNK2", "SELECT item_id, CAST(1 AS BIGINT) AS n FROM benchmark")
def overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    for _ in range(2):
        jsonl.write_jsonl(items(spark, sf_dir), path, "overwrite")
    return jsonl.read_jsonl(spark, path, "item_id long").groupBy("item_id").agg(F.count("*").alias("n"))


def refused(write) -> bool:
    try:
        write()
    except Exception as e:
        return "PATH_ALREADY_EXISTS" in str(e)
    return False


@query("q_SNK3", "SELECT 'run' AS run_id, 'complete' AS status, true AS refused")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "manifest")
    m = ident.RunManifest("run", "2026-01-01T00:00:00Z", "1", ident.configuration_hash({}))
    ident.write_manifest(spark, m, path)
    again = refused(lambda: ident.write_manifest(spark, m, path))
    return spark.read.json(path).select("run_id", "status", F.lit(again).alias("refused"))


@query("q_SNK4", "SELECT doc_id, quality, toxic FROM labels")
def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch(spark, "csv"), table(spark, sf_dir, "labels")
    jsonl.write_csv(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("q_SNK5", "SELECT item_id, true AS refused FROM benchmark")
def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    jsonl.write_jsonl(items(spark, sf_dir), path)
    again = refused(lambda: jsonl.write_jsonl(items(spark, sf_dir), path))
    return jsonl.read_jsonl(spark, path, "item_id long").select("item_id", F.lit(again).alias("refused"))


# ---------------------------------------------------------------- shapes and checks


@query("q_PRJ7", "SELECT doc_id, CAST(list_sort(map_keys(m)) AS VARCHAR) AS keys FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN MAP {'lang': lang, 'source': source} ELSE MAP {'source': source} END AS m FROM documents)")
def kept_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when(F.col("lang") == "en", F.create_map(F.lit("lang"), "lang", F.lit("other"), F.lit("x"), F.lit("source"), "source")).otherwise(F.create_map(F.lit("source"), "source", F.lit("text"), "text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.map_keys(flatten.keep(m, ["lang", "source"]))).alias("k"))
    return rows.select("doc_id", F.concat(F.lit("["), F.array_join("k", ", "), F.lit("]")).alias("keys"))


@query("q_PRJ9", "SELECT * EXCLUDE (text) FROM documents")
def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").drop("text")


@query("q_VAL14", "SELECT 'nation' AS name, (SELECT count(*) = count(DISTINCT n_nationkey) FROM nation) AS holds UNION ALL SELECT 'orders', (SELECT count(*) = count(DISTINCT o_custkey) FROM orders)")
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def holds(name: str, key: str) -> bool:
        try:
            rules.many_to_one(table(spark, sf_dir, name), [key])
        except ValueError:
            return False
        return True

    return spark.createDataFrame([("nation", holds("nation", "n_nationkey")), ("orders", holds("orders", "o_custkey"))], "name string, holds boolean")


EDGES = [-0.1, 0.0, 0.5, 1.0, 1.1, 3.0, 3.1]


@query("q_VAL20", f"SELECT a AS t, b AS lam, NOT (a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 3) AS refused FROM (SELECT unnest({EDGES}::DOUBLE[]) AS a) CROSS JOIN (SELECT unnest({EDGES}::DOUBLE[]) AS b)")
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def bad(t: float, lam: float) -> bool:
        try:
            effects.check_thresholds(t, 0.5, lam)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(t, lam, bad(t, lam)) for t in EDGES for lam in EDGES], "t double, lam double, refused boolean")


@query("q_VAL21", "SELECT unnest(['A_neutral', 'B_explicit', 'C_hm_control']) AS variant, true AS refused")
def absent_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas without each variant in turn."""
    rows = view(spark, sf_dir, "responses").withColumn("x", F.col("k").cast("double"))

    def fails(v: str) -> bool:
        try:
            effects.variant_deltas(rows.where(F.col("prompt_variant") != v), "x")
        except ValueError as e:
            return v in str(e)
        return False

    return spark.createDataFrame([(v, fails(v)) for v in ("A_neutral", "B_explicit", "C_hm_control")], "variant string, refused boolean")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions with their claims in order; where the digit is 0 they stand in reverse order, where it is 1 their indices have a gap."""
    d = digit("response_id")
    c = view(spark, sf_dir, "claims").groupBy(*K).agg(F.array_sort(F.collect_list("feature_id")).alias("order"))
    found = F.when(d == "0", F.reverse("order")).otherwise(F.col("order"))
    each = F.transform(found, lambda f, i: F.struct(f.alias("feature_id"), (i + F.when((d == "1") & (i > 0), 1).otherwise(0)).alias("claim_index")))
    return c.select(*K, "order", F.struct(each.alias("claims")).alias("output"))


def _order_sql(rule: str, d: str) -> str:
    return f"{with_('claims')}, c AS (SELECT {KEYS}, count(*) AS n FROM claims GROUP BY ALL) SELECT {KEYS}, '{rule}' AS rule_id FROM c WHERE n > 1 AND {sql_digit('response_id')} = '{d}'"


@query("q_VAL28", _order_sql("VAL28", "0"))
def other_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.claim_order(_ordered(spark, sf_dir), F.col("order")).where("rule_id = 'VAL28'").select(*K, "rule_id")


@query("q_VAL29", _order_sql("VAL29", "1"))
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.claim_order(_ordered(spark, sf_dir), F.col("order")).where("rule_id = 'VAL29'").select(*K, "rule_id")


@query("q_VAL33", f"""{with_('facts')}, x AS (SELECT response_id, {KEYS.replace('response_id, ', '')}, factual_target_id, status, doc_id FROM facts JOIN (SELECT doc_id, 'r' || doc_id AS response_id FROM documents) d USING (response_id))
SELECT {KEYS}, factual_target_id AS key FROM x WHERE factual_target_id = 'T1' AND status <> 'not_assessable' UNION ALL SELECT {KEYS}, 'zzqx' AS key FROM x""")
def packet_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet of T1 is not complete. Each fact cites its text's first letters, its packet, and words that neither holds."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), "doc_id").alias("response_id"), "text")
    facts = view(spark, sf_dir, "facts").join(docs, "response_id").withColumn("evidence", F.array(F.substring("text", 1, 10), F.lit("a source"), F.lit(""), F.lit("zzqx"))).drop("text")
    packets = spark.createDataFrame([("T0", "complete", '{"sources":["a source"]}'), ("T1", "partial", '{"sources":["a source"]}')], "factual_target_id string, packet_status string, packet string")
    return rules.packet_evidence(facts, docs, packets).select(*K, "key")


@query("q_VAL41", """SELECT 'run' AS kind, CAST(event_id AS VARCHAR) AS key FROM (SELECT *, substr(md5(CAST(event_id AS VARCHAR)), 1, 1) AS d FROM events) WHERE d < '2'
UNION ALL SELECT 'subject', CAST(doc_id AS VARCHAR) FROM documents WHERE substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1')
UNION ALL SELECT 'packet', CAST(item_id AS VARCHAR) FROM benchmark WHERE substr(md5(CAST(item_id AS VARCHAR)), 1, 1) IN ('0', '1')
UNION ALL SELECT 'range', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0""")
def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "events"), digit("event_id")
    runs = e.select(F.col("event_id").cast("string").alias("run_id"), F.when(d < "1", 0).when(d < "8", 1).otherwise(0).alias("attempt_index"), F.when((d < "1") | ((d >= "2") & (d < "8")), "x").alias("retry_of"))
    x, d = table(spark, sf_dir, "documents"), digit("doc_id")
    subjects = x.select(F.col("doc_id").cast("string").alias("extraction_id"), F.when(d != "0", "r").alias("response_id"), F.when(d == "1", "v").alias("validation_case_id"))
    b, d = items(spark, sf_dir), digit("item_id")
    packets = b.select(F.col("item_id").cast("string").alias("factual_target_id"), F.when(d == "2", "partial").otherwise("complete").alias("packet_status"), F.when(d.isin("0", "2"), "[ ]").otherwise('["s"]').alias("sources"), F.when(d != "1", '{"a":1}').alias("reference"))
    customers = table(spark, sf_dir, "customer")
    parts = {"run": rules.attempt_chain(runs), "subject": rules.exclusive_subject(subjects), "packet": rules.complete_packets(packets), "range": rules.negative(customers, "c_custkey", ["c_acctbal", "c_custkey"])}
    return rules.union([v.select(F.lit(k).alias("kind"), "key") for k, v in parts.items()])


@query("q_VAL45", f"SELECT doc_id FROM documents WHERE doc_id >= 20 AND lang IN ('en', 'de') AND {sql_digit('doc_id')} >= '8' ORDER BY doc_id LIMIT 25")
def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 rows that a resumed run of two families has to do."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("line_no"), F.col("doc_id").cast("string").alias("custom_id"), F.col("lang").alias("item_family_id"))
    done = rows.where(digit("custom_id") < "8")
    return swarm.select_rows(rows, done, start=20, families=["en", "de"], limit=25).select(F.col("line_no").alias("doc_id"))


@query("q_JN17", "SELECT item_family_id, factual_target_id, packet, error FROM (SELECT DISTINCT 'F' || (doc_id % 24) AS item_family_id, CASE WHEN doc_id % 24 < 20 THEN 'T' || (doc_id % 24) END AS factual_target_id, CASE WHEN doc_id % 24 < 12 THEN 'p' || (doc_id % 24) END AS packet, CASE WHEN doc_id % 24 >= 20 THEN 'family has no targets' WHEN doc_id % 24 >= 12 THEN 'target has no packet' END AS error FROM documents)")
def family_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = table(spark, sf_dir, "documents").select(F.concat(F.lit("F"), F.col("doc_id") % 24).alias("item_family_id"))
    targets = spark.range(20).select(F.concat(F.lit("F"), "id").alias("item_family_id"), F.concat(F.lit("T"), "id").alias("factual_target_id"))
    packets = spark.range(12).select(F.concat(F.lit("T"), "id").alias("factual_target_id"), F.concat(F.lit("p"), "id").alias("packet"))
    return requests.family_packets(families, targets, packets)


@query("q_LIM3", f"{with_('claims')} SELECT {KEYS}, feature_id AS key FROM claims WHERE causal_role = 'cause' AND status <> 'true' ORDER BY response_id, extraction_source, source_identifier, feature_id LIMIT 100")
def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_errors(rules.cause_without_claim(view(spark, sf_dir, "claims"))).select(*K, "key")


@query("q_AGG10", f"{with_('claims')} SELECT item_family_id, {sql9('avg(claim_index)')} AS claim_index FROM claims GROUP BY ALL")
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.family_means(view(spark, sf_dir, "claims"), "claim_index").withColumn("claim_index", r9("claim_index"))


ABSENT = ", ".join(f"'{v}'" for v in EXEMPT_RELATION_VALUES)


@query("q_AGG15", f"""{with_('claims', 'relations')}, c AS (SELECT *, feature_group = 'accuracy' AS acc, {sql_digit('feature_id')} < '8' AS banked FROM claims),
n AS (SELECT response_id, count(*) AS n_claims, count(*) FILTER (WHERE status = 'true') AS n_true, count(*) AS exact_ok, count(*) AS exact_bad,
  count(*) FILTER (WHERE NOT acc AND banked) AS fs_ok, count(*) FILTER (WHERE NOT acc) * 2 - count(*) FILTER (WHERE NOT acc AND banked) AS fs_bad, count(*) FILTER (WHERE causal_role = 'cause' AND status <> 'true') AS bad_causal FROM c GROUP BY 1),
r AS (SELECT response_id, count(*) FILTER (WHERE relation_value NOT IN ({ABSENT})) AS nonabsent FROM relations GROUP BY 1)
SELECT n.*, nonabsent FROM n JOIN r USING (response_id)""")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim cites its text's first letters and words that are not in it; half of the features have the former in their bank."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), "doc_id").alias("response_id"), "text")
    claims = view(spark, sf_dir, "claims").join(docs.select("response_id", F.substring("text", 1, 10).alias("head")), "response_id")
    claims = claims.withColumn("evidence", F.array("head", F.lit(""), F.lit("zzqx")))
    banks = claims.where(digit("feature_id") < "8").select("response_id", "feature_id", F.array("head").alias("bank")).distinct()
    return requests.report_metrics(claims, view(spark, sf_dir, "relations"), docs, banks, list(EXEMPT_RELATION_VALUES))


# ---------------------------------------------------------------- text and spans


def _list(sql: str) -> str:
    return f"array_to_string({sql}, '|')"


TRIM = r"[\s\p{Z}]"


@query("q_STR6", "SELECT item_id, text AS block FROM benchmark")
def named_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.lit("HEAD\nx\nQUESTION\n"), "text", F.lit("\nANSWER\ny\n"))
    return items(spark, sf_dir).select("item_id", text.named_block(whole, "QUESTION", "ANSWER").alias("block"))


@query("q_STR7", """SELECT item_id, CASE WHEN item_id % 4 = 3 THEN NULL ELSE '{"a": {"b": "}{"}, "id": ' || item_id || '}' END AS found FROM benchmark""")
def first_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object within a fence, after a false start, alone, or cut off."""
    k, o = F.col("item_id") % 4, F.concat(F.lit('{"a": {"b": "}{"}, "id": '), "item_id", F.lit("}"))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), o, F.lit("\n```"))).when(k == 1, F.concat(F.lit("see {this}: "), o, F.lit(" {}"))).when(k == 2, o).otherwise(F.expr("concat('{\"a\": {\"id\": ', item_id)"))
    return items(spark, sf_dir).select("item_id", text.first_json_object(raw).alias("found"))


@query("q_STR8", "SELECT conv_id, turn, coalesce(text, '') AS content FROM conversations")
def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other message as a list of parts."""
    t = F.coalesce("text", F.lit(""))
    parts = F.array(F.struct(F.lit("text").alias("type"), F.substring(t, 1, 3).alias("text")), F.struct(F.lit("text").alias("type"), F.expr("substring(coalesce(text, ''), 4)").alias("text")))
    message = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(t.alias("content")))).otherwise(F.to_json(F.struct(parts.alias("content"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.chat_content(message).alias("content"))


QUOTING = "item_id || ' said “' || text || '” and \"no more\" or \"x\"'"


@query("q_STR10", f"SELECT item_id, {_list(f'''regexp_extract_all({QUOTING}, '[\"“”]([^\"“”]{{2,140}})[\"“”]', 1)''')} AS quoted FROM benchmark")
def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("item_id", F.lit(" said “"), "text", F.lit("” and \"no more\" or \"x\""))
    return items(spark, sf_dir).select("item_id", F.array_join(text.quoted_phrases(raw), "|").alias("quoted"))


LEAD = "|".join(text.LEAD_WORDS)
#: Leading function words; RE2 knows word boundaries of ASCII only, so what follows the last one is spelled out and put back.
LEAD_SQL = rf"(?i)^(?:(?:{LEAD})[\s,]+)*(?:(?:{LEAD})([^\p{{L}}\p{{N}}_]|$))?"
SPAN_SQL = rf"trim(regexp_replace(regexp_replace(regexp_replace(trim({{}}), '^[\"“”]+|[\"“”]+$', '', 'g'), '{LEAD_SQL.replace('{', '{{').replace('}', '}}')}', '\1'), '[\s,;:.\-—–]+$', ''))"


@query("q_STR12", f"SELECT item_id, {SPAN_SQL.format('''CASE item_id % 3 WHEN 0 THEN 'And so, the ' ELSE '“' END || text || ' , ; ' ''')} AS span FROM benchmark")
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("item_id") % 3 == 0, "And so, the ").otherwise("“"), "text", F.lit(" , ; "))
    return items(spark, sf_dir).select("item_id", text.trimmed_span(raw).alias("span"))


WORD_SQL = "[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*"
EDGE_SQL = "[" + ", ".join(f"'{w}'" for w in text.EDGE_WORDS) + "]"


@query("q_STR13", f"""WITH t AS (SELECT item_id, regexp_extract_all(text, '{WORD_SQL}') AS w FROM benchmark), n AS (SELECT unnest(range(4, 15)) AS n),
p AS (SELECT item_id, w, n, unnest(range(1, CAST(len(w) AS BIGINT) - n + 2)) AS i FROM t, n)
SELECT item_id, count(*) AS n, sum(n) AS words FROM p WHERE NOT list_contains({EDGE_SQL}, lower(w[i])) AND NOT list_contains({EDGE_SQL}, lower(w[i + n - 1])) GROUP BY 1""")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window is also checked to be a substring of its text."""
    rows = items(spark, sf_dir).select("item_id", "text", F.explode(text.windows(F.col("text"))).alias("w")).where(F.contains("text", F.col("w")))
    return rows.groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.size(F.regexp_extract_all("w", F.lit(text.ASCII_WORD), F.lit(0)))).alias("words"))


@query("q_SET4", f"SELECT doc_id, round(len(list_intersect(a, b))::DOUBLE / nullif(least(len(a), len(b)), 0), 9) AS overlap FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, length(text) // 2)), '{WORD_SQL}')) AS a, list_distinct(regexp_extract_all(lower(substr(text, length(text) // 2 + 1)), '{WORD_SQL}')) AS b FROM documents)")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that both halves of each whole text have."""
    half, t = F.floor(F.length("text") / 2).cast("int"), F.col("text")
    w = lambda part: F.regexp_extract_all(F.lower(part), F.lit(text.ASCII_WORD), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.overlap(w(t.substr(F.lit(1), half)), w(t.substr(half + 1, F.length(t)))), 9).alias("overlap"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
DOMAIN_SQL = "(?i)" + "|".join(text.DOMAIN)
GENERIC_SQL = text.GENERIC.replace("'", "''")


def _spans_sql(source: str, key: str, windows: bool) -> str:
    """r: key, span, value of the quoted phrases, sentences, clauses and (windows) stretches of words of each text that may be evidence; a span's best rank counts."""
    more = f"""UNION ALL SELECT {key}, regexp_replace(array_to_string(u[i:i + n - 2], '') || w[i + n - 1], '{LEAD_SQL}', '\\1'), 900 FROM (
  SELECT {key}, w, list_transform(w, lambda x, k: x || coalesce(g[k + 1], '')) AS u, n, unnest(range(1, len(w) - n + 2)) AS i FROM (
    SELECT {key}, regexp_extract_all(text, '{WORD_SQL}') AS w, regexp_split_to_array(text, '{WORD_SQL}') AS g FROM {source}), (SELECT unnest(range(4, 15)) AS n))
  WHERE NOT list_contains({EDGE_SQL}, lower(w[i])) AND NOT list_contains({EDGE_SQL}, lower(w[i + n - 1]))"""
    return rf"""WITH s AS (SELECT {key}, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.;:\n]+'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM {source}),
p AS (SELECT {key}, s AS raw, 1500 AS rank FROM s UNION ALL SELECT {key}, unnest(regexp_split_to_array(s, '(?i)[.;:\n]+|,\s+|—|–|\s+(?:where|while|because|which|so that|rather than|whereby)\s+')), 2500 FROM s
  UNION ALL SELECT {key}, unnest(regexp_extract_all(text, '["“”]([^"“”]{{2,140}})["“”]', 1)), 5000 FROM {source}),
q AS (SELECT {key}, span, max(rank) AS rank FROM (SELECT {key}, {SPAN_SQL.format('raw')} AS span, rank FROM p {more if windows else ''}) GROUP BY ALL),
w AS (SELECT *, regexp_extract_all(span, '{WORD_SQL}') AS w FROM q WHERE length(span) BETWEEN 8 AND 160 AND NOT regexp_matches(span, '{GENERIC_SQL}')),
v AS (SELECT *, len(w) AS n, list_filter(w, lambda x: NOT list_contains({STOP_SQL}, lower(x))) AS content FROM w),
r AS (SELECT {key}, span, rank + CASE WHEN regexp_matches(span, '{DOMAIN_SQL}') THEN 400 ELSE 0 END + CASE WHEN n BETWEEN 4 AND 14 THEN 250 ELSE 0 END - greatest(n - 16, 0) * 30 AS value FROM v WHERE n BETWEEN 2 AND 26 AND len(content) >= 2)"""


def _once(ranked: F.Column) -> F.Column:
    """A span that is of several kinds counts once, with its best value: best first, (value, span)."""
    names = F.transform(ranked, lambda s: s["span"])
    return F.filter(F.transform(ranked, lambda s: F.struct((-s["value"]).alias("value"), s["span"].alias("span"))), lambda s, i: F.array_position(names, s["span"]) == i + 1)


def _document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different spans of every document's whole texts, but for stretches of words: an array of (span, value), the best value of each.

    A document is one row, so its spans stay where it is read. Rows of one id are put together first; only if there are any do texts move.
    """
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.select("doc_id", F.array("text").alias("texts"))
    else:
        docs = docs.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    # exploded as the only element: a filter on a plain column would be pushed down with a copy of the expression, and work it out twice
    return docs.select("doc_id", F.explode(F.array(evidence.best(F.col("texts")))).alias("spans")).where(F.size("spans") > 0)


@query("q_STR14", f"{_spans_sql('documents', 'doc_id', False)} SELECT doc_id, count(*) AS n, CAST(sum(length(span)) AS BIGINT) AS characters FROM r GROUP BY 1")
def kept_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each document are neither generic nor too short, too long or without content."""
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.length(s["span"]))
    return _document_spans(spark, sf_dir).select("doc_id", F.size("spans").cast("long").alias("n"), total.alias("characters"))


@query("q_STR15", f"{_spans_sql('documents', 'doc_id', False)} SELECT doc_id, CAST(max(value) AS INTEGER) AS best, CAST(sum(value) AS BIGINT) AS total FROM r GROUP BY 1")
def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's spans are worth: by kind, terms of the domain and length."""
    values = F.transform("spans", lambda s: s["value"])
    return _document_spans(spark, sf_dir).select("doc_id", F.array_max(values).alias("best"), F.aggregate(values, F.lit(0).cast("long"), lambda n, v: n + v).alias("total"))


@query("q_STR17", f"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM benchmark),
s AS (SELECT item_id, list_transform(range(1, len(w) - 3), lambda i: list_distinct(w[i:i + 4])) AS spans FROM t)
SELECT item_id, len(list_reduce(spans, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: len(list_intersect(k, x))::DOUBLE / least(len(k), len(x)) >= 0.6)) > 0 THEN kept ELSE list_append(kept, x) END, CAST([] AS VARCHAR[][]))) AS at_06,
  len(list_reduce(spans, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: len(list_intersect(k, x))::DOUBLE / least(len(k), len(x)) >= 0.7)) > 0 THEN kept ELSE list_append(kept, x) END, CAST([] AS VARCHAR[][]))) AS at_07 FROM s""")
def distinct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all stretches of five words of each text, in order, how many are chosen that share less than 0.6 or 0.7 of their words with any chosen before."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(text.ASCII_WORD), F.lit(0))
    rows = items(spark, sf_dir).select("item_id", w.alias("w")).withColumn("spans", F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 4)), lambda i: i + 4 <= F.size("w")), lambda i: F.array_join(F.slice("w", i, 5), " ")))
    chosen = lambda most: F.size(text.greedy_distinct(F.col("spans"), 1 << 30, most)).cast("long")
    return rows.select("item_id", chosen(0.6).alias("at_06"), chosen(0.7).alias("at_07"))


def _spans(spark: SparkSession, sf_dir: str, cues: list[str] | None = None) -> DataFrame:
    spans = evidence.ranked(F.col("text"))
    rows = dealt(items(spark, sf_dir), "item_id").select("item_id", (spans if cues is None else evidence.aligned(spans, cues)).alias("r"))
    return rows.select("item_id", F.posexplode(_once(F.col("r"))).alias("i", "s")).select("item_id", "i", "s.value", "s.span")


@query("q_SORT1", f"{_spans_sql('benchmark', 'item_id', True)} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY value DESC, length(span), lower(span)) - 1 AS INTEGER) AS i, CAST(value AS INTEGER) AS value, lower(span) AS span FROM r")
def best_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of every item, stretches of words included, best first."""
    return _spans(spark, sf_dir).withColumn("span", F.lower("span"))


@query("q_SORT2", f"{_spans_sql('benchmark', 'item_id', True)} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, value DESC, length(span), lower(span)) - 1 AS INTEGER) AS i, CAST(value AS INTEGER) AS value, lower(span) AS span FROM (SELECT *, contains(lower(span), 'th')::INT + contains(lower(span), 'er')::INT AS hits FROM r) WHERE hits > 0")
def best_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span that cues occur in, those with more cues first."""
    return _spans(spark, sf_dir, ["th", "ER", "er"]).withColumn("span", F.lower("span"))


@query("q_STR21", "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE 'e' || page_id END AS etag FROM pages")
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    last = F.when(k == 0, F.concat(F.lit("ETag: e"), "page_id")).when(k == 1, F.concat(F.lit("x: y\r\netag:  e"), "page_id", F.lit(" "))).otherwise(F.lit("x: y"))
    return table(spark, sf_dir, "pages").select("page_id", text.last_header(F.concat(F.lit("HTTP/1 301\r\nETag: old\r\n\r\nHTTP/1 200\r\n"), last, F.lit("\r\n\r\n")), "etag").alias("etag"))


# ---------------------------------------------------------------- identity and time


DOC_JSON = """'{"lang":' || coalesce(CAST(to_json(lang) AS VARCHAR), 'null') || ',"n_chars":' || n_chars || ',"source":' || coalesce(CAST(to_json(source) AS VARCHAR), 'null') || '}'"""


def _doc_json() -> F.Column:
    return F.to_json(F.struct("source", "lang", "n_chars"), {"ignoreNullFields": "false"})


@query("q_SORT4", f"SELECT doc_id, {DOC_JSON} AS canonical FROM documents")
def sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ident.canonical_json(_doc_json()).alias("canonical"))


@query("q_H3", f"""SELECT doc_id, sha256('{{"n_chars":' || n_chars || ',"source":' || coalesce(CAST(to_json(source) AS VARCHAR), 'null') || '}}') AS h FROM documents""")
def packet_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ident.json_hash(_doc_json(), "lang").alias("h"))


@query("q_H5", """SELECT n, sha256('{"a":' || n || ',"é":[null,true]}') AS h FROM range(5) t(n)""")
def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, ident.configuration_hash({"é": [None, True], "a": n})) for n in range(5)], "n long, h string")


@query("q_H6", "SELECT 'r1' AS run_id, 'complete' AS status, CAST(0 AS BIGINT) AS n_rows, 'judge_output_v0.5.0' AS schema_version, CAST(13 AS BIGINT) AS fields, CAST(64 AS BIGINT) AS digest")
def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "manifest")
    ident.write_manifest(spark, ident.RunManifest("r1", "2026-01-01T00:00:00Z", "1", ident.configuration_hash({"a": 1})), path)
    whole = spark.read.text(path)
    return whole.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("run_id", "status")], F.get_json_object("value", "$.n_rows").cast("long").alias("n_rows"), F.get_json_object("value", "$.schema_version").alias("schema_version"), F.size(F.json_object_keys("value")).cast("long").alias("fields"), F.length(F.get_json_object("value", "$.configuration_sha256")).cast("long").alias("digest"))


@query("q_H8", "SELECT 'spec.txt' AS name, sha256('the specification' || chr(10)) AS found, 'differs' AS state UNION ALL SELECT 'absent.txt', NULL, 'gone'")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose content is not the recorded one, and a recorded file that is gone. Spark names files itself, so the one that is there takes its recorded name."""
    path = scratch(spark, "spec")
    spark.createDataFrame([("the specification",)], "value string").coalesce(1).write.text(path)
    name = jsonl.inventory(spark, path).select(F.element_at(F.split("path", "/"), -1)).first()[0]
    recorded = spark.createDataFrame([(name, "0" * 64), ("absent.txt", "1" * 64)], "name string, sha256 string")
    return jsonl.changed_files(spark, path, recorded).select(F.when(F.col("name") == name, "spec.txt").otherwise(F.col("name")).alias("name"), "found", "state")


@query("q_DATE1", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS micros FROM events")
def utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", requests.iso_utc(F.col("ts")).alias("seconds"), requests.iso_utc(F.col("ts"), micros=True).alias("micros"))


@query("q_DATE2", "SELECT event_id, event_id * 1237 // 1000 + CASE WHEN event_id * 1237 % 1000 >= 500 THEN 1 ELSE 0 END AS latency_ms FROM events")
def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event ends 1,237 microseconds times its id after it began."""
    ts = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(ts) + F.col("event_id") * 1237)
    return table(spark, sf_dir, "events").select("event_id", requests.latency(ts, end).alias("latency_ms"))


# ---------------------------------------------------------------- adapters and statistics


class Status(Exception):
    """A stub's HTTP error."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def _stub():
    """A model that fails as its prompt asks: '429 ...' and '503 ...' always, '1 ...' on each first attempt, 'long ...' by length."""
    tries: dict[str, int] = {}

    def model(prompt: str) -> tuple[str, str]:
        kind = prompt.split(" ", 1)[0]
        tries[prompt] = tries.get(prompt, 0) + 1
        if kind in ("429", "503"):
            raise Status(int(kind))
        if kind == "1" and tries[prompt] == 1:
            raise OSError("reset")
        return prompt[::-1], "length" if kind == "long" else "stop"

    return model


def _asked(spark: SparkSession, sf_dir: str, retry: requests.Retry) -> DataFrame:
    k = F.col("item_id") % 5
    kind = F.when(k == 0, "429").when(k == 1, "503").when(k == 2, "1").when(k == 3, "long").otherwise("ok")
    prompts = items(spark, sf_dir).select(F.col("item_id").cast("string").alias("id"), F.concat(kind, F.lit(" "), "item_id").alias("prompt"))
    got = requests.ask(prompts, _stub(), 2, retry, sleep=lambda s: None)
    return got.select(F.col("id").cast("long").alias("item_id"), "ok", "truncated", "attempts", "waited", "error")


def _asked_sql(attempts: dict[str, tuple[int, float]]) -> str:
    errors = {"0": "Status: status 429", "1": "Status: status 503", "3": "Truncated: the answer was cut off"}
    pick = lambda values: "CASE item_id % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"
    return f"SELECT item_id, item_id % 5 IN (2, 4) AS ok, item_id % 5 = 3 AS truncated, CAST({pick({k: a for k, (a, _) in attempts.items()})} AS INTEGER) AS attempts, CAST({pick({k: w for k, (_, w) in attempts.items()})} AS DOUBLE) AS waited, {pick({k: repr(e) for k, e in errors.items()})} AS error FROM benchmark"


@query("q_DOM17", _asked_sql({"0": (3, 6.0), "1": (3, 6.0), "2": (2, 2.0), "3": (3, 6.0), "4": (1, 0.0)}))
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, requests.JUDGE)


@query("q_DOM18", _asked_sql({"0": (1, 0.0), "1": (4, 7.0), "2": (2, 1.0), "3": (1, 0.0), "4": (1, 0.0)}))
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, requests.GENERATOR)


@query("q_SRC9", "SELECT item_id, reverse(text) AS output FROM benchmark")
def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = items(spark, sf_dir).select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("prompt"))
    return requests.ask(prompts, lambda p: p[::-1]).select(F.col("id").cast("long").alias("item_id"), "output")


@query("q_DOM11", "SELECT item_id, '<features>' || chr(10) || 'cost $1 \\ ' || item_id || chr(10) || '</features>' || chr(10) || chr(10) || text || chr(10) || 'end' AS prompt FROM benchmark")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<features>\na long\nlist\n</features>  \n\n\n\n"), "text", F.lit(" \nend\t"))
    return items(spark, sf_dir).select("item_id", requests.compact_prompt(raw, {"features": F.concat(F.lit("cost $1 \\ "), "item_id")}).alias("prompt"))


@query("q_ST13", f"{with_('claims')} SELECT response_id, item_family_id, (status = 'true')::INT::DOUBLE AS y, 1 AS intercept, (prompt_variant = 'B_explicit')::INT AS prompt_variant_B_explicit, (prompt_variant = 'C_hm_control')::INT AS prompt_variant_C_hm_control, (domain = 'd1')::INT AS domain_d1 FROM claims WHERE feature_group = 'accuracy'")
def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "claims").where("feature_group = 'accuracy'").withColumn("y_", (F.col("status") == "true").cast("int"))
    return stats.design_matrix(rows, "y_", {"prompt_variant": ["A_neutral", "B_explicit", "C_hm_control"], "domain": ["d0", "d1"]}, ["response_id", "item_family_id"])
