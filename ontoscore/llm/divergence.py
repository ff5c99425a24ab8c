"""How far the sources of a language differ in their use of terms, by exact integer shares over a dictionary of kept terms.

Texts are counted where they lie: a task hands on each term once for a batch of documents, with its occurrences in each source and the
documents that hold it. Two exchanges give the counts of (lang, source, term) and the documents of (lang, term). Terms in enough
documents are kept; their sorted order, counted by ranges, gives them dense integer ids, so that ids ascend as the terms' UTF-8 bytes do.
From there on only integers move. A chunk is a run of ids; its counts are laid out as dense vectors, one for each source (bincount over
ids found by searchsorted in the chunk's sorted ids), as wide as a bound on cells allows. In a chunk, shares are compared pair by pair and
the first terms of each source are chosen; sums and choices of chunks meet in one more exchange.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontoscore.llm.common import LOWER, UPPER, discard, materialise, ranked

#: Documents that hold a kept term; parts of the whole; what is added to each count; terms reported for a source.
DOCS, PARTS, PRIOR, TOP = 30, 1_000_000_000, 5, 50
#: Bytes that are split into terms at once, terms that a task counts before it hands them on, cells of a chunk, and its most terms.
SLICE, HELD, CELLS, WIDTH = 1 << 20, 200_000, 1 << 22, 1 << 11
#: ASCII but letters parts terms; A-Z count as a-z.
TERM = bytes.maketrans(bytes([b for b in range(128) if not chr(b).isalpha()]) + UPPER.encode(), b" " * 76 + LOWER.encode())
COUNTED = "lang string, source string, term string, n long, docs long"


def _terms(text: str) -> Counter:
    """Occurrences of the terms of a text, as UTF-8; long texts by slices that end between terms."""
    data, found, at = text.encode().translate(TERM), Counter(), 0
    while len(data) - at > SLICE:
        end = data.rfind(b" ", at, at + SLICE)
        end = end if end > at else data.find(b" ", at + SLICE)
        if end < 0:
            break
        found.update(data[at:end].split())
        at = end
    found.update((data[at:] if at else data).split())
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in COUNTED.split(", ")]
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def batch() -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), (counts, holding) in held.items():
            langs += [lang] * len(counts)
            sources += [source] * len(counts)
            terms += counts.keys()
            n += counts.values()
            docs += map(holding.__getitem__, counts)
        columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    size = 0
    for rows in batches:
        for lang, source, text in zip(*[rows.column(i) for i in range(3)], strict=True):
            found = _terms(text.as_py())
            counts, holding = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            size -= len(counts)
            counts.update(found)
            holding.update(found.keys())
            size += len(counts)
            if size >= HELD:
                yield batch()
                held.clear()
                size = 0
    if held:
        yield batch()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it). Null text, lang and source count as ''."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least: int = DOCS) -> DataFrame:
    """lang, source, term, n of the terms that at least so many documents of their language hold."""
    held = counts.withColumn("holding", F.sum("docs").over(Window.partitionBy("lang", "term")))
    return held.where(F.col("holding") >= least).select("lang", "source", "term", "n")


def dictionary(kept: DataFrame) -> DataFrame:
    """Written: lang, term, id (from 0, dense, ascending in the language as the terms' UTF-8 bytes)."""
    found = ranked(kept.select("lang", "term").distinct(), ["lang"], ["term"], {"term": F.col("term")}, "id")
    return found.withColumn("id", F.col("id") - 1)


def shares(counts: np.ndarray, total: int, size: int, parts: int = PARTS, prior: int = PRIOR) -> np.ndarray:
    """1 + floor(parts * (count + prior) / (total + prior * size)) of each count, without rounding at any size of the counts."""
    below = total + prior * size
    if parts * (int(counts.max(initial=0)) + prior) < 2**63 and below < 2**63:
        return 1 + parts * (counts + prior) // below
    return np.array([1 + parts * (int(c) + prior) // below for c in counts], np.int64)


SUMS = "part string, i int, j int, id long, value long"


def _compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk: rows with an id are counts of sources, rows without one tell each source's total; `i` numbers the sources."""
    table = pa.Table.from_batches(list(batches))
    ids, source, n = (np.array(table.column(c).fill_null(-1), np.int64) for c in ("id", "i", "n"))
    size = int(table.column("size")[0].as_py())
    told = ids < 0
    totals = np.zeros(int(told.sum()), np.int64)
    totals[source[told]] = n[told]
    present = np.unique(ids[~told])
    width, many = len(present), len(totals)
    cells = source[~told] * width + np.searchsorted(present, ids[~told])
    if int(n[~told].sum()) < 2**53:
        counts = np.bincount(cells, n[~told], many * width).astype(np.int64).reshape(many, width)
    else:  # weights of bincount are doubles
        counts = np.zeros(many * width, np.int64)
        np.add.at(counts, cells, n[~told])
        counts = counts.reshape(many, width)
    p = np.array([shares(counts[i], int(totals[i]), size) for i in range(many)], np.int64).reshape(many, width)
    q = shares(counts.sum(axis=0), sum(map(int, totals)), size) if width else np.zeros(0, np.int64)

    def rows(part: str, i: int, j: np.ndarray, id_: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([part] * len(value)), pa.array([i] * len(value), pa.int32()), pa.array(j, pa.int32()), pa.array(id_, pa.int64()), pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "i", "j", "id", "value"])

    for i in range(many):
        others = np.arange(i + 1, many)
        if len(others):
            apart = np.abs(p[i + 1 :] - p[i]).sum(axis=1) if width else np.zeros(len(others), np.int64)
            yield rows("pair", i, others, np.full(len(others), -1), apart)
        over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        over = over[np.argsort(q[over] - p[i][over], kind="stable")][:TOP]  # ids ascend, so ties stay in order
        if len(over):
            yield rows("term", i, np.full(len(over), -1), present[over], (p[i] - q)[over])


def divergence(docs: DataFrame, least: int = DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's shares of the language's kept terms are from those of each other source
    (part `pair`, item the other source, the sum of differences, all ranks) and from the language's (part `term`, item each term that it
    uses more, the difference, ranks to 50). Ranks by value, descending, then by UTF-8 item, ascending.

    A share is 1 + floor(10**9 * (count + 5) / (N + 5 * V)) in integers. Null text, lang and source count as ''; every (lang, source) that
    occurs takes part, also without terms; repeated rows are documents of their own; other columns take no part; texts of any length are
    counted whole. Without kept terms all pairs differ by 0; a source alone in its language has no pairs; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = materialise(kept_counts(term_counts(docs), least), "kept")
    terms = dictionary(kept)
    sizes = terms.groupBy("lang").agg(F.count("*").alias("size"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = named.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, "n")
    by_lang = Window.partitionBy("lang")
    totals = totals.withColumn("i", (F.row_number().over(by_lang.orderBy("source")) - 1).cast("int")).withColumn("many", F.count("*").over(by_lang))
    width = F.greatest(F.lit(1), F.least(F.lit(WIDTH), F.floor(F.lit(CELLS) / F.col("many")))).cast("long")
    totals = materialise(totals.join(sizes, "lang", "left").fillna(0, "size").withColumn("width", width), "totals")

    counts = kept.join(terms, ["lang", "term"]).join(totals.select("lang", "source", "i", "size", "width"), ["lang", "source"])
    counts = counts.select("lang", F.floor(F.col("id") / F.col("width")).alias("chunk"), "id", "i", "n", "size")
    last = F.floor((F.greatest(F.col("size"), F.lit(1)) - 1) / F.col("width"))
    told = totals.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"), F.lit(None).cast("long").alias("id"), "i", "n", "size")
    found = counts.union(told).groupBy("lang", "chunk").applyInArrow(_with_lang, f"lang string, {SUMS}")
    found = materialise(found, "differences")

    source = totals.select("lang", "i", "source")
    other = totals.select("lang", F.col("i").alias("j"), F.col("source").alias("item"))
    half = found.where("part = 'pair'").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    pairs = half.union(half.select("lang", "j", "i", "value"))
    pairs = pairs.join(other, ["lang", "j"]).join(source, ["lang", "i"])
    first = Window.partitionBy("lang", "i")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(first.orderBy(F.desc("value"), "item")).alias("rank"))
    top = found.where("part = 'term'").withColumn("rank", F.row_number().over(first.orderBy(F.desc("value"), "id"))).where(F.col("rank") <= TOP)
    top = top.join(terms.withColumnRenamed("term", "item"), ["lang", "id"]).join(source, ["lang", "i"])
    result = materialise(pairs.union(top.select("lang", "source", F.lit("term"), "item", "value", "rank")), "divergence")
    discard(kept, terms, totals, found)
    return result


def _with_lang(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _compare(key, batches):
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(batch), pa.string()), *batch.columns], names=["lang", *batch.schema.names])


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
q0 AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM q0),
f AS (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""
