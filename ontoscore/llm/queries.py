"""The registered queries of this subpackage (op1 to op13) and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Target weights of sources; sources that are not named get MIX_DEFAULT.
MIX_WEIGHTS = {"src0": 24, "src1": 12, "src2": 8, "src3": 6}
MIX_DEFAULT = 4
MIX_BLOCK = 8
#: Arguments that the tools of plain conversations take.
CHAT_SCHEMAS = {
    "user": {"n_chars": ("integer", True), "text": ("string", True), "turn": ("integer", True)},
    "system": {"n_chars": ("integer", True), "text": ("string", True), "turn": ("integer", True)},
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the bytes that a repeated 400-byte string covers."""
    from ontoscore.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a schedule of source blocks that follows the target weights."""
    from ontoscore.llm.mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_DEFAULT, block=MIX_BLOCK)
    return mixed.select("doc_id", "source", "source_block", "slot", "release", "deadline", "position", "in_ratio")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to a content-addressed archive and reads the records back."""
    from ontoscore.llm.common import new_path
    from ontoscore.llm.warc import read_index, write_archive

    path = new_path(spark, "archive")
    write_archive(_table(spark, sf_dir, "pages"), path)
    return read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows of the largest integer inner product for every vector whose id is divisible by 50."""
    from ontoscore.llm.bitslice import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    from ontoscore.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the interpolated model."""
    from ontoscore.llm.lm import score

    return score(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 4-word shingle similarity 0.8 or more."""
    from ontoscore.llm.setsketch import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept", "n_links")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of every conversation, linked, ordered, validated and serialised."""
    from ontoscore.llm.chat import calls_of, link, results_of

    conversations = _table(spark, sf_dir, "conversations")
    return link(calls_of(conversations), results_of(conversations), CHAT_SCHEMAS).withColumn("problems", F.array_join("problems", ";"))


def op9_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the 50-word windows that start in an earlier document."""
    from ontoscore.llm.rlz import remove_passages

    return remove_passages(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items are covered by tiles, with the items."""
    from ontoscore.llm.decontam import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), whole_short=True).select("doc_id", "item_id", "n_tiles", "matched_words", "item_words", "coverage")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of what they decode to."""
    import public_tokenizers

    from ontoscore.llm.pieces import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    from ontoscore.llm.trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ in their shares of terms, and by which terms."""
    from ontoscore.llm.divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_topk": op4_topk,
    "op5_toxicity": op5_toxicity,
    "op6_lm": op6_lm,
    "op7_near_dedup": op7_near_dedup,
    "op8_chat": op8_chat,
    "op9_rlz": op9_rlz,
    "op10_decontamination": op10_decontamination,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}


def _oracles() -> dict[str, str]:
    from ontoscore.llm.divergence import DIVERGENCE_SQL
    from ontoscore.llm.mixing import mix_sql
    from ontoscore.llm.trie import TRIE_SQL

    return {
        "op12_prefix_trie": TRIE_SQL,
        "op13_divergence": DIVERGENCE_SQL,
        "op2_mixing": mix_sql(MIX_WEIGHTS, MIX_DEFAULT, MIX_BLOCK),
        "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g""",
        "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(q.e, lambda x, i: x * c.e[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op8_chat": """
WITH c AS (
  SELECT conv_id, conv_id || ':' || turn AS id, CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS parent, role AS tool, text, turn
  FROM conversations WHERE role IS NULL OR role <> 'assistant'),
r AS (
  SELECT id, min(struct_pack(turn := turn, text := text)).text AS content, count(*) AS n_results
  FROM (SELECT conv_id || ':' || (turn - 1) AS id, turn, text FROM conversations WHERE role = 'assistant') GROUP BY id),
lv AS (
  SELECT id, floor(turn / 2) - coalesce(max(CASE WHEN missing THEN floor(turn / 2) END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn), floor(turn / 2)) AS level
  FROM (SELECT DISTINCT conv_id, id, turn, turn - 2 NOT IN (SELECT turn FROM c c2 WHERE c2.conv_id = c.conv_id) AS missing FROM c)),
j AS (SELECT c.conv_id, coalesce(c.id, r.id) AS call_id, c.id AS own, c.tool, c.text, c.turn, r.content, r.n_results, r.id AS rid, lv.level FROM c FULL JOIN r ON c.id = r.id LEFT JOIN lv ON lv.id = c.id),
k AS (SELECT *, CASE WHEN own IS NULL THEN '' WHEN tool IS NULL OR tool NOT IN ('user', 'system') THEN 'unknown tool' ELSE concat_ws(';', CASE WHEN text IS NULL THEN 'missing n_chars' END, CASE WHEN text IS NULL THEN 'missing text' END) END AS problems FROM j)
SELECT conv_id, call_id, CAST(level AS BIGINT) AS level,
  CASE WHEN own IS NULL THEN 'orphan' WHEN problems <> '' THEN 'invalid' WHEN rid IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
  problems, CAST(coalesce(n_results, 0) AS BIGINT) AS n_results,
  '{"arguments":' || CASE WHEN own IS NULL THEN 'null' WHEN text IS NULL THEN CAST(json_object('turn', turn) AS VARCHAR) ELSE CAST(json_object('n_chars', length(text), 'text', text, 'turn', turn) AS VARCHAR) END
  || ',"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"tool":' || coalesce(CAST(to_json(tool) AS VARCHAR), 'null') || '}' AS json
FROM k""",
    }


ORACLE_SQL: dict[str, str] = _oracles()
