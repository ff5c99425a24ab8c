"""Further registered queries: shapes, joins, rules, text, selections and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoscore.fixed import CELL_DIMENSIONS, EXEMPT_RELATION_VALUES, GROUPS, K, RELATIONS
from ontoscore.functions import ident, text
from ontoscore.operators import assess, effects, evidence, flatten, requests, rules, score, stats, swarm
from ontoscore.plans.overlay import with_
from ontoscore.plans.queries import BASE, JOBS, KEYS, LABELS, _labels, _over_metrics, _requests, _rule, bent, dealt, exports_of, metrics_of, query, r9, sql9, table, view

# ---------------------------------------------------------------- shapes


@query("q_PRJ5", f"""{with_('claims')}, x AS (SELECT e.response_id || e.source_identifier AS extraction_id, CASE WHEN doc.k % 5 = 0 THEN NULL ELSE e.response_id END AS response_id, CASE WHEN doc.k % 5 = 0 THEN 'c' || e.response_id END AS case_id, doc.k, e.item_family_id, e.source_identifier FROM extractions e JOIN responses doc USING (response_id))
SELECT x.extraction_id, c.feature_id, CASE WHEN k % 5 <> 0 THEN x.response_id WHEN k % 10 = 0 THEN c.response_id ELSE case_id END AS subject_id, x.item_family_id FROM claims c JOIN x ON x.extraction_id = c.response_id || c.source_identifier WHERE c.feature_group = 'accuracy'""")
def analysis_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural responses by their run; every fifth is a validation case, every tenth one of a response."""
    e = view(spark, sf_dir, "extractions")
    own = F.col("k") % 5 != 0
    case = F.concat(F.lit("c"), "response_id")
    ex = e.select(F.concat("response_id", "source_identifier").alias("extraction_id"), F.when(own, F.col("response_id")).alias("response_id"), F.when(~own, case).alias("validation_case_id"), "extraction_source", "source_identifier")
    runs = view(spark, sf_dir, "responses").where("k % 5 <> 0 OR k % 10 = 0").select("response_id", "item_family_id")
    cases = view(spark, sf_dir, "responses").where("k % 5 = 0").select(case.alias("validation_case_id"), F.when(F.col("k") % 10 == 0, F.col("response_id")).alias("response_id"), "item_family_id")
    rows = view(spark, sf_dir, "claims").where("feature_group = 'accuracy'").select(F.concat("response_id", "source_identifier").alias("extraction_id"), "feature_id")
    return flatten.analysis_long(rows, ex, runs, cases).select("extraction_id", "feature_id", "subject_id", "item_family_id")


@query("q_PRJ8", f"{with_('claims')} SELECT response_id, CAST(row_number() OVER (PARTITION BY response_id ORDER BY feature_id) - 1 AS INTEGER) AS i, feature_id, opportunity_class FROM claims WHERE source_identifier = 'j0'")
def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "claims").where("source_identifier = 'j0'").groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "opportunity_class"))).alias("f"))
    return rows.select("response_id", F.inline(flatten.renumber(F.col("f"))))


@query("q_PRJ10", f"{with_('relations')} SELECT {KEYS}, relation_type AS rel_relation_type, relation_value AS rel_relation_value, confidence AS rel_confidence FROM relations")
def prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.prefixed(view(spark, sf_dir, "relations"), "rel")


@query("q_PV5", _over_metrics(f"SELECT {KEYS}, dimension, {sql9('x')} AS value FROM (SELECT {KEYS}, unnest([{', '.join(repr(d) for d in CELL_DIMENSIONS[:3])}]) AS dimension, unnest([{', '.join(CELL_DIMENSIONS[:3])}]) AS x FROM m)"))
def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics_of(spark, sf_dir)
    return m.select(*K, *CELL_DIMENSIONS[:3]).unpivot(K, CELL_DIMENSIONS[:3], "dimension", "value").withColumn("value", r9("value"))


@query("q_PV4", _over_metrics(f"SELECT model_snapshot_id, item_family_id, round(avg(recognition_score) FILTER (WHERE prompt_variant = 'A_neutral'), 9) AS a FROM m JOIN e USING ({KEYS}) GROUP BY 1, 2"))
def variants_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics_of(spark, sf_dir).join(view(spark, sf_dir, "extractions").select(*K, "model_snapshot_id", "item_family_id", "prompt_variant"), K)
    return rows.groupBy("model_snapshot_id", "item_family_id").pivot("prompt_variant", ["A_neutral"]).agg(F.avg("recognition_score")).select("model_snapshot_id", "item_family_id", r9("A_neutral").alias("a"))


@query("q_SET1", f"{with_('claims', 'facts')} SELECT {KEYS}, status FROM claims WHERE feature_group = 'accuracy' UNION ALL SELECT {KEYS}, status FROM facts")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "claims").where("feature_group = 'accuracy'").select(*K, "status").unionByName(view(spark, sf_dir, "facts").select(*K, "status"))


@query("q_SET2", f"{with_('claims')} SELECT DISTINCT response_id, feature_id FROM claims")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "claims").select("response_id", "feature_id").distinct()


@query("q_SET3", f"{with_('claims')} SELECT DISTINCT item_family_id, feature_id FROM claims EXCEPT SELECT DISTINCT item_family_id, feature_id FROM claims WHERE status = 'unclear'")
def never_unclear(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "claims").select("item_family_id", "feature_id", "status")
    return pairs.select("item_family_id", "feature_id").distinct().join(pairs.where("status = 'unclear'"), ["item_family_id", "feature_id"], "left_anti")


@query("q_LIM1", "SELECT doc_id, lang FROM documents WHERE doc_id >= 10 ORDER BY doc_id LIMIT 25")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection operator's feature is the limit: the first rows by line."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("doc_id").cast("string").alias("custom_id"), "lang", "doc_id")
    return swarm.select_rows(rows, start=10, limit=25).select("doc_id", "lang")


# ---------------------------------------------------------------- joins


@query("q_JN1", f"{with_('claims')} SELECT c.response_id, c.feature_id, r.domain FROM claims c JOIN responses r USING (response_id)")
def claims_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = rules.many_to_one(view(spark, sf_dir, "responses").select("response_id", "domain"), ["response_id"])
    return view(spark, sf_dir, "claims").select("response_id", "feature_id").join(index, "response_id")


@query("q_JN4", f"{with_('extractions', 'opportunities')} SELECT {KEYS}, feature_id FROM extractions JOIN opportunities USING (item_family_id) WHERE opportunity_class <> 'inapplicable'")
def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "opportunities").where("opportunity_class <> 'inapplicable'").select("item_family_id", "feature_id")
    return view(spark, sf_dir, "extractions").select(*K, "item_family_id").join(o, "item_family_id").select(*K, "feature_id")


@query("q_JN15", "SELECT c_custkey, o_orderkey AS last_order FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS rn FROM customer LEFT JOIN orders ON o_custkey = c_custkey) WHERE rn = 1")
def last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custom_id"), F.col("o_orderkey").alias("line_no"), F.col("o_orderkey").alias("last_order"))
    last = swarm.last_by_line(orders).select(F.col("custom_id").alias("c_custkey"), "last_order")
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")


# ---------------------------------------------------------------- rules


@query("q_VAL2", f"""{with_('extractions')} SELECT {KEYS}, 'relations' AS key, 'VAL2' AS rule_id, 'missing keys' AS message FROM extractions WHERE k % 3 = 0""")
def val2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = exports_of(spark, sf_dir)
    third = F.substring("response_id", 2, 12).cast("long") % 3 == 0
    return rules.missing_keys(e.withColumn("raw_judge_output", F.when(third, F.regexp_replace("raw_judge_output", '"relations":', '"other":')).otherwise(F.col("raw_judge_output"))))


@query("q_VAL5", f"{with_('relations')}, x AS (SELECT * REPLACE (CASE WHEN relation_value = 'partial' THEN 'other' ELSE relation_type END AS relation_type) FROM relations) " + _rule("VAL5", "unknown relation type", "relation_type", "x WHERE relation_type = 'other'"))
def val5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.relation_types(view(spark, sf_dir, "relations").withColumn("relation_type", F.when(F.col("relation_value") == "partial", "other").otherwise(F.col("relation_type"))))


EXEMPT = ", ".join(f"'{v}'" for v in EXEMPT_RELATION_VALUES)


@query("q_VAL7", f"{with_('relations')} " + _rule("VAL7", "relation lacks evidence", "relation_type", f"relations WHERE relation_value NOT IN ({EXEMPT})") + " UNION ALL " + _rule("VAL7", "relation lacks claim references", "relation_type", f"relations WHERE relation_value NOT IN ({EXEMPT}) AND relation_type <> 'contradiction_recognition'"))
def val7(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<int>")
    return rules.relation_evidence(view(spark, sf_dir, "relations").withColumns({"evidence": none.cast("array<string>"), "source_claim_indices": none, "target_claim_indices": none}))


@query("q_VAL8", f"{with_('claims')} SELECT {KEYS}, 'causal_chain_structure#' || i AS key, 'VAL8' AS rule_id, 'relation refers to a claim that does not exist' AS message FROM extractions e, (SELECT unnest([3, 99]) AS i) WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.response_id = e.response_id AND c.source_identifier = e.source_identifier AND c.claim_index = i)")
def val8(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "extractions").select(*K, F.lit("causal_chain_structure").alias("relation_type"), F.array(F.lit(3)).alias("source_claim_indices"), F.array(F.lit(99), F.lit(3)).alias("target_claim_indices"))
    return rules.dangling_references(r, view(spark, sf_dir, "claims"))


@query("q_VAL17", f"{with_('relations')}, x AS (SELECT * FROM relations UNION ALL SELECT * FROM relations WHERE relation_value = 'reformist') SELECT {KEYS}, relation_type AS key, 'VAL17' AS rule_id, 'duplicate response relation' AS message FROM x GROUP BY {KEYS}, relation_type HAVING count(*) <> 1")
def val17(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "relations")
    return rules.duplicates(r.unionByName(r.where("relation_value = 'reformist'")), [*K, "relation_type"], "VAL17", "duplicate response relation")


@query("q_VAL22", "SELECT concat('r', doc_id) AS response_id, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE NOT contains(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), replace(nfc_normalize(substr(text, 3, 20) || CASE WHEN doc_id % 7 = 0 THEN '~~' ELSE '' END), chr(13), chr(10)))")
def val22(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("response_id", F.concat(F.lit("r"), "doc_id"))
    span = F.concat(F.substring("text", 3, 20), F.when(F.col("doc_id") % 7 == 0, "~~").otherwise(""))
    return rules.verbatim(d.select("response_id", F.col("doc_id").alias("key"), span.alias("span")), d.select("response_id", "text"), text.normalised).select("response_id", "key")


@query("q_VAL24", f"{BASE} SELECT response_id, source_identifier, feature_id, CASE WHEN feature_group = 'accuracy' THEN 'feature has no evidence bank' ELSE 'evidence is not in the feature''s bank' END AS message FROM bent WHERE feature_group = 'accuracy' OR substr(span, 1, 1) > '3'")
def val24(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bent(spark, sf_dir)
    features = view(spark, sf_dir, "features").where("feature_group <> 'accuracy'")
    banks = features.select("feature_id", F.array(*[F.lit(x) for x in "0123"]).alias("bank"))
    # features that were bent into another group have a bank, as their own group has one
    spans = c.select(*K, F.when(F.col("feature_group") == "accuracy", F.concat(F.lit("acc:"), "feature_id")).otherwise(F.col("feature_id")).alias("feature_id"), F.substring("span", 1, 1).alias("span"))
    out = rules.in_bank(spans, banks)
    return out.select("response_id", "source_identifier", F.regexp_replace("key", "^acc:", "").alias("feature_id"), "message")


@query("q_VAL26", f"{BASE} " + _rule("VAL26", "true without evidence", "feature_id", "bent WHERE status = 'true' AND substr(span, 1, 1) = '8' AND feature_group <> 'accuracy'"))
def val26(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bent(spark, sf_dir).withColumn("evidence", F.when(F.substring("span", 1, 1) == "8", F.array().cast("array<string>")).otherwise(F.array("span")))
    return rules.true_without_evidence(c, ["accuracy"])


@query("q_VAL30", f"{with_('extractions')} SELECT {KEYS}, 'relations' AS key, 'VAL30' AS rule_id, 'relations are not the nine types, once each' AS message FROM extractions WHERE k % 4 = 0")
def val30(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = flatten.parse(exports_of(spark, sf_dir))
    fewer = F.when(F.substring("response_id", 2, 12).cast("long") % 4 == 0, F.slice("output.relations", 1, 8)).otherwise(F.col("output.relations"))
    return rules.relation_completeness(p.withColumn("output", F.struct(fewer.alias("relations"))))


@query("q_VAL31", f"{with_('claims')} SELECT {KEYS}, 'true claims' AS key, 'VAL31' AS rule_id, 'too few true claims' AS message FROM claims GROUP BY {KEYS} HAVING count(*) FILTER (WHERE status = 'true') < 12")
def val31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.minima(flatten.parse(exports_of(spark, sf_dir)), 12, 0, 0).where("key = 'true claims'")


@query("q_VAL32", f"{with_('facts')} " + _rule("VAL32", "factual target was not supplied", "factual_target_id", "facts WHERE factual_target_id = 'T1'") + f" UNION ALL SELECT {KEYS}, 'T9', 'VAL32', 'supplied factual target has no assessment' FROM extractions")
def val32(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "extractions").select(*K, F.explode(F.array(F.lit("T0"), F.lit("T9"))).alias("factual_target_id"))
    return rules.supplied_facts(view(spark, sf_dir, "facts"), e)


@query("q_VAL38", f"{with_('responses', 'features')}, v AS (SELECT DISTINCT item_family_id, prompt_variant, CASE WHEN item_family_id = 'F103' AND prompt_variant = 'A_neutral' THEN 250 ELSE 120 END AS w FROM responses) SELECT item_family_id || ':budget' AS key, 'budget incomplete' AS message FROM v GROUP BY item_family_id HAVING count(DISTINCT w) <> 1")
def val38(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "responses").select("item_family_id", "prompt_variant").distinct().withColumn("word_limit", F.when((F.col("item_family_id") == "F103") & (F.col("prompt_variant") == "A_neutral"), 250).otherwise(120))
    return rules.lock_guard(v, view(spark, sf_dir, "opportunities"), sum(len(x) for x in GROUPS.values())).select("key", "message")


@query("q_VAL42", "SELECT CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def val42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.foreign_key(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), "c_custkey").select("key")


@query("q_VAL44", f"""{with_('relations')}, w AS (SELECT {KEYS}, {', '.join(f"min(CASE WHEN relation_type = '{t}' THEN relation_value END) AS {t}" for t in RELATIONS)} FROM relations GROUP BY ALL)
SELECT {KEYS}, contradiction_recognition = 'recognized' AND recognition_closure_sequence = 'recognition_then_closure' AND property_relation_outcome = 'preserved' AND reform_function IN ('capitalist_stabilization', 'terminal_substitute') AS closure FROM w""")
def val44(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = score.relation_wide(view(spark, sf_dir, "relations"))
    return w.select(*K, score.recuperative_closure(*[F.col(c) for c in ("contradiction_recognition", "recognition_closure_sequence", "property_relation_outcome", "reform_function")], F.lit(True)).alias("closure"))


@query("q_SNK6", "SELECT CAST(l_orderkey AS VARCHAR) AS key FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT md5(CAST(l_linenumber AS VARCHAR) || l_returnflag)) > 1")
def snk6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.md5(F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").cast("binary")).alias("sha"))
    return rules.changed_rows(rows, "l_orderkey", "sha").select("key")


# ---------------------------------------------------------------- text


@query("q_STR2", "SELECT doc_id, md5(nfc_normalize(text)) AS h FROM documents")
def nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.nfc(F.col("text")).cast("binary")).alias("h"))


@query("q_STR4", "SELECT doc_id, md5(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')) AS h FROM documents")
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.stripped(F.col("text")).cast("binary")).alias("h"))


@query("q_STR5", "SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages WHERE len(regexp_extract_all(html, '<title>')) = 1 AND trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> ''")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where(F.size(F.regexp_extract_all("html", F.lit("<title>"), F.lit(0))) == 1)
    return rows.select("page_id", text.tag_block(F.col("html"), "title", 1).alias("title")).where("title <> ''")


@query("q_STR9", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) AS INTEGER) AS n FROM documents")
def ascii_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(text.ASCII_WORD), F.lit(0))).alias("n"))


@query("q_STR16", "SELECT doc_id, CAST(contains(lower(text), 'the')::INT + contains(lower(text), 'ouch')::INT + contains(lower(text), 'zzz')::INT AS INTEGER) AS hits FROM documents")
def cue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = F.array(*[F.lit(c) for c in ("The", "the", "ouch", "zzz")])
    return table(spark, sf_dir, "documents").select("doc_id", text.cue_hits(F.col("text"), cues).alias("hits"))


@query("q_STR18", f"{with_('responses')} SELECT response_id, 'judge-' || response_id || '-rep' || repetition_index AS id FROM responses")
def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "responses").select("response_id", F.format_string("judge-%s-rep%s", "response_id", F.col("repetition_index").cast("string")).alias("id"))


@query("q_STR20", "SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '\\.(pdf|csv|json|xml|html?|txt|xlsx?|zip)$') THEN '.' || regexp_extract(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '\\.(pdf|csv|json|xml|html?|txt|xlsx?|zip)$', 1) ELSE '.html' END AS ext FROM pages")
def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.extension(F.col("url"), F.lit("text/html")).alias("ext"))


CUES = {"one": ["the", "and"], "two": ["ouch"], "own": []}


@query("q_DOM10")
def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The banks of every document. The choice of different spans is greedy, so there is no SQL; it is tested against a brute-force version."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("response_id"), "text")
    built = evidence.build_banks(dealt(docs, "response_id"), CUES, optional=("own",))
    return built.select("response_id", "feature_id", F.size("bank").alias("n"), F.md5(F.array_join("bank", "|").cast("binary")).alias("h"))


@query("q_H7", """SELECT page_id, a.h AS found, b.h AS recorded, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'gone' WHEN a.h = b.h THEN 'same' ELSE 'differs' END AS state
FROM (SELECT page_id, sha256(html) AS h FROM pages WHERE substr(md5(html), 1, 1) >= '2') a
FULL JOIN (SELECT page_id, sha256(CASE WHEN substr(md5(html), 1, 1) >= 'c' THEN url ELSE html END) AS h FROM pages WHERE substr(md5(html), 1, 1) NOT IN ('2', '3')) b USING (page_id)""")
def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots: every page is in one at least, some are gone, new or changed in the other."""
    p, d = table(spark, sf_dir, "pages"), F.substring(F.md5(F.col("html").cast("binary")), 1, 1)
    found = p.where(d >= "2").select("page_id", F.sha2("html", 256).alias("sha256"))
    recorded = p.where(~d.isin("2", "3")).select("page_id", F.sha2(F.when(d >= "c", F.col("url")).otherwise(F.col("html")), 256).alias("sha256"))
    return ident.compare_hashes(found, recorded, "page_id")


# ---------------------------------------------------------------- requests and jobs


@query("q_DOM12", f"""{with_('opportunities')}, r AS (SELECT item_family_id, feature_id, opportunity_class, CASE opportunity_class WHEN 'primary' THEN 0 WHEN 'secondary_afforded' THEN 1 ELSE 2 END AS o FROM opportunities WHERE opportunity_class <> 'inapplicable')
SELECT item_family_id, feature_id, opportunity_class, CAST(row_number() OVER (PARTITION BY item_family_id ORDER BY o, feature_id) - 1 AS INTEGER) AS i FROM r""")
def packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family's packet. The lists of weaker classes name the features of stronger ones again."""
    o = view(spark, sf_dir, "opportunities")
    of = lambda *classes: F.array_sort(F.collect_list(F.when(F.col("opportunity_class").isin(*classes), F.col("feature_id"))))
    every = ("primary", "secondary_afforded", "monitor_only")
    families = o.groupBy("item_family_id").agg(*[of(*every[: i + 1]).alias(c) for i, c in enumerate(("primary", "secondary", "monitor"))])
    return requests.packets(families).select("item_family_id", "feature_id", "opportunity_class", F.col("i").cast("int"))


@query("q_DOM14", "SELECT item_id, 'Question: ' || text || ' End ' || item_id AS prompt FROM benchmark")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").withColumn("n", F.col("item_id").cast("string"))
    return requests.render(rows, "Question: {text} End {n}", ["text", "n"]).select("item_id", "prompt")


@query("q_DOM16", f"""WITH j AS ({JOBS}), b AS (SELECT *, md5(job_id) < '2' AS bad FROM j)
SELECT custom_id, count(*) FILTER (WHERE bad) = 0 AS ok, count(*) AS n_jobs, count(*) FILTER (WHERE NOT bad) AS n_ok, count(*) FILTER (WHERE NOT bad AND job_type = 'feature') AS observed_claims, count(*) FILTER (WHERE NOT bad AND job_type = 'relation') AS observed_relations, count(*) FILTER (WHERE NOT bad AND job_type = 'factual') AS observed_facts FROM b GROUP BY 1""")
def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = _requests(spark, sf_dir)
    j = swarm.decompose(req)
    ok = F.md5(F.col("job_id").cast("binary")) >= "2"
    kind = lambda t, c: F.when(F.col("job_type") == t, c)
    out = j.select(
        F.col("position").alias("line_no"), "custom_id", "job_id", "job_type", "index", ok.alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("truncated"),
        kind("feature", F.array(F.struct(F.col("position").alias("claim_index"), "feature_id"))).alias("claims"), kind("relation", F.struct(F.col("index").alias("relation_type"), F.lit("x").alias("relation_value"))).alias("relation"),
        kind("factual", F.struct(F.col("index").alias("factual_target_id"))).alias("fact"), kind("semantic", F.struct(F.lit("relevant").alias("relevance"))).alias("semantic"),
    )
    return swarm.reduce(req, out).select("custom_id", "ok", "n_jobs", "n_ok", "observed_claims", "observed_relations", "observed_facts")


# ---------------------------------------------------------------- statistics


@query("q_ST4", f"WITH {LABELS} SELECT stratum, count(*) AS n, {sql9('avg((gold = judged)::INT)')} AS share_correct FROM l GROUP BY 1")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).withColumn("right", F.col("gold") == F.col("judged"))
    return stats.calibration(rows, "stratum", "right").withColumn("share_correct", r9("share_correct"))


@query("q_ST6", _over_metrics("SELECT 'recognition_score' AS x, 'omission_rate' AS y, round(corr(recognition_score, omission_rate), 7) AS r FROM m"))
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(metrics_of(spark, sf_dir), ["recognition_score", "omission_rate"]).withColumn("r", F.round("r", 7))


@query("q_ST12", f"{with_('responses')}, n AS (SELECT model_snapshot_id, item_family_id, prompt_variant, count(DISTINCT repetition_index) AS n FROM responses GROUP BY ALL), w AS (SELECT model_snapshot_id, item_family_id, bool_and(n >= 4.0) AS good FROM n GROUP BY ALL), f AS (SELECT model_snapshot_id, count(*) AS families, count(*) FILTER (WHERE good) AS complete_families FROM w GROUP BY 1) SELECT *, complete_families::DOUBLE / families >= 0.9 AS complete, CASE WHEN complete_families < 3 THEN 'descriptive only' WHEN complete_families < 16 THEN 'exploratory' ELSE 'confirmatory' END AS label FROM f")
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "responses").groupBy("model_snapshot_id", "item_family_id", "prompt_variant").agg(F.count_distinct("repetition_index").alias("n"))
    return stats.completion(runs)


@query("q_ST14", "SELECT lineage, stage, dimension, CAST(stage_order AS INTEGER) AS stage_order, round(value - lag(value) OVER (PARTITION BY lineage ORDER BY stage_order), 6) AS delta FROM (SELECT 'n' || (l_linenumber % 3) AS lineage, l_returnflag AS stage, 'price' AS dimension, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS stage_order, avg(l_quantity::DOUBLE) AS value FROM lineitem GROUP BY ALL)")
def stage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("n"), F.col("l_linenumber") % 3).alias("lineage"), F.col("l_returnflag").alias("stage")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value")).withColumn("dimension", F.lit("price"))
    return effects.stage_deltas(means, {"A": 0, "N": 1, "R": 2}).select("lineage", "stage", "dimension", "stage_order", F.round("delta", 6).alias("delta"))


# ---------------------------------------------------------------- rows of runs, and reports


@query("q_VAL27", f"{with_('claims')} SELECT response_id, CAST(count(*) AS VARCHAR) || '/' || CAST(count(*) + 1 AS VARCHAR) AS key FROM claims WHERE source_identifier = 'j0' GROUP BY response_id HAVING count(*) % 3 = 0")
def val27(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = view(spark, sf_dir, "claims").where("source_identifier = 'j0'").groupBy("response_id").agg(F.count("*").alias("n_claims"))
    rows = n.select("response_id", "n_claims", F.when(F.col("n_claims") % 3 == 0, 1).otherwise(0).alias("primary_feature_count"), F.col("n_claims").alias("secondary_feature_count"), F.lit(None).cast("long").alias("monitor_feature_count"))
    return rules.claim_count(rows).select("response_id", "key")


@query("q_VAL34", f"{with_('authoritative')} SELECT {KEYS} FROM authoritative WHERE relevance IS NULL OR truncated")
def val34(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "authoritative")
    rows = a.select(*K, F.when(F.col("relevance").isNull(), "maybe").when(F.col("relevance"), "relevant").otherwise("irrelevant").alias("relevance"), F.when(~F.col("truncated"), F.col("refusal")).alias("refusal_detected"))
    return rules.semantic_fields(rows).select(*K)


@query("q_VAL35", f"SELECT job_id AS key FROM ({JOBS}) WHERE md5(job_id) < '2' AND substr(md5(job_id), 2, 1) < '4'")
def val35(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("job_id").cast("binary"))
    outputs = swarm.decompose(_requests(spark, sf_dir)).select("custom_id", "job_id", (h >= "2").alias("ok"))
    named = outputs.where(~F.col("ok") & (F.substring(h, 2, 1) >= "4")).groupBy("custom_id").agg(F.collect_list(F.struct("job_id")).alias("failed_jobs"))
    return rules.hidden_failures(outputs, named).select("key")


@query("q_VAL36", "SELECT CAST(c_custkey AS VARCHAR) AS key, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['no matching request'] ELSE list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'family differs from request' END, CASE WHEN c_custkey % 11 = 0 THEN 'request hash differs' END], lambda x: x IS NOT NULL) END) AS message FROM customer")
def val36(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    reduced_ = c.select(k.cast("string").alias("custom_id"), F.when(k % 7 == 0, "x").otherwise("f").alias("item_family_id"), F.when(k % 11 == 0, F.lit(None)).otherwise(F.lit("h")).alias("request_body_sha256"))
    req = c.where(k % 5 != 0).select(k.cast("string").alias("custom_id"), F.lit("f").alias("item_family_id"), F.lit("h").alias("request_body_sha256"))
    return rules.identity(reduced_, req).select("key", "message")


@query("q_VAL37", "SELECT CAST(event_id AS VARCHAR) AS key, 'warning' AS severity FROM events WHERE event_type = 'error'")
def val37(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("custom_id"), (F.col("event_type") != "error").alias("ok"))
    return rules.row_status(rows, strict_rows=False).select("key", "severity")


@query("q_VAL39", f"{with_('opportunities')} SELECT CAST(24 * {sum(len(x) for x in GROUPS.values())} AS BIGINT) AS n_expected, count(*) AS n_rows FROM (SELECT DISTINCT item_family_id, feature_id FROM opportunities)")
def val39(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "opportunities")
    return rules.matrix_size(o, o, view(spark, sf_dir, "features"))


@query("q_VAL46", f"{with_('extractions')} SELECT {KEYS}, CASE k % 5 WHEN 0 THEN 'request_failed' WHEN 1 THEN 'raw_response_json_failed' WHEN 2 THEN 'judge_json_failed' WHEN 3 THEN 'judge_schema_failed' ELSE 'ok' END AS parse_status FROM extractions")
def val46(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("response_id", 2, 12).cast("long") % 5
    e = exports_of(spark, sf_dir)
    rows = e.select(*K, F.when(k == 1, "<html>").when(k > 1, "{}").alias("raw"), F.when(k == 2, "[1]").when(k == 3, F.regexp_replace("raw_judge_output", "hm_v0", "hm_v1")).otherwise(F.col("raw_judge_output")).alias("judged"))
    return rules.parse_status(rows, "raw", "judged").select(*K, "parse_status")


@query("q_ST7", _over_metrics("SELECT count(*) AS n, count(*) FILTER (WHERE recognition_score < neoclassical_score AND recognition_score < institutionalist_score) AS n_below, round(avg(recognition_score), 7) AS recognition, round(avg(neoclassical_score), 7) AS neoclassical, round(avg(institutionalist_score), 7) AS institutionalist FROM m"))
def discriminants(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics_of(spark, sf_dir).select("response_id", F.col("recognition_score").alias("recognition"), F.col("neoclassical_score").alias("neoclassical"), F.col("institutionalist_score").alias("institutionalist"))
    return stats.discriminant_panel(m).withColumns({c: F.round(c, 7) for c in ("recognition", "neoclassical", "institutionalist")})


RANK_VALUES = "SELECT concat('m', c_nationkey % 4) AS model, c_custkey % 50 AS rep, round(avg(c_acctbal), 2) AS v FROM customer GROUP BY ALL"


@query("q_ST10", f"WITH v AS ({RANK_VALUES}), r AS (SELECT model, CAST(row_number() OVER (PARTITION BY rep ORDER BY v DESC, model) AS INTEGER) AS rank FROM v) SELECT model, rank, count(*) AS n FROM r GROUP BY ALL")
def rank_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    means = c.groupBy(F.concat(F.lit("m"), F.col("c_nationkey") % 4).alias("model"), (F.col("c_custkey") % 50).alias("rep")).agg(F.round(F.avg("c_acctbal"), 2).alias("v"))
    return stats.ranks(means, "model", "v", ["rep"])


@query("q_ST11", f"{with_('claims')}, c AS (SELECT {KEYS}, feature_group, opportunity_class, count(*) AS p, count(*) FILTER (WHERE status IN ('true', 'false')) AS a, count(*) FILTER (WHERE status = 'true') AS t FROM claims GROUP BY ALL), x AS (SELECT *, unnest([0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]) AS minimum FROM c) SELECT feature_group, opportunity_class, minimum, count(CASE WHEN a::DOUBLE / p >= minimum THEN t::DOUBLE / nullif(a, 0) END) AS n_scored, round(avg(CASE WHEN a::DOUBLE / p >= minimum THEN t::DOUBLE / nullif(a, 0) END), 7) AS mean_score FROM x GROUP BY ALL")
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robustness(score.dimension_counts(view(spark, sf_dir, "claims")), [0.7, 0.8, 0.9, 1.0]).withColumn("mean_score", F.round("mean_score", 7))


@query("q_STR22", "SELECT page_id, 'http://h' || page_id || '/v1/chat/completions' AS endpoint FROM pages")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("http://h"), "page_id", F.when(F.col("page_id") % 3 == 0, "/v1/").when(F.col("page_id") % 3 == 1, "/v1/chat/completions").otherwise("//"))
    return table(spark, sf_dir, "pages").select("page_id", text.chat_url(base).alias("endpoint"))


@query("q_STR23", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'document' WHEN 2 THEN 'table' ELSE 'other' END AS class FROM documents")
def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    path = F.concat(F.lit("/a.b/"), "doc_id", F.when(k == 0, ".PY").when(k == 1, ".md").when(k == 2, ".parquet").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.file_class(path).alias("class"))


@query("q_MATH1", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE / nullif(l_linenumber - 1, 0) AS q FROM lineitem")
def safe_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.ratio(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("q"))


@query("q_MATH7", "SELECT l_returnflag, round(quantile_cont(l_quantity::DOUBLE, 0.025), 9) AS low, round(quantile_cont(l_quantity::DOUBLE, 0.975), 9) AS high FROM lineitem GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile(q, 0.025), 9).alias("low"), F.round(F.percentile(q, 0.975), 9).alias("high"))


@query("q_BOOL1", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS relevance FROM documents")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    said = F.when(k == 0, "relevant").when(k == 1, "irrelevant").otherwise("unclear")
    return table(spark, sf_dir, "documents").select("doc_id", assess.relevance(said).alias("relevance"))


@query("q_ARR1", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS modes, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS line_numbers FROM lineitem GROUP BY 1")
def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.array_sort(F.collect_list("l_linenumber")).alias("b"))
    return g.select("l_orderkey", F.array_join(F.array_sort(F.array_distinct("a")), ",").alias("modes"), F.array_join(F.col("b").cast("array<string>"), ",").alias("line_numbers"))
