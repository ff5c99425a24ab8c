"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, repeated strings and benchmark leaks go, and the rest
is mixed to target weights. Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoscore.llm import decontam, mixing, setsketch, suffix_dedup, toxicity
from ontoscore.llm.common import materialise
from ontoscore.llm.queries import MIX_BLOCK, MIX_DEFAULT, MIX_WEIGHTS

#: Bytes of a repeated string: a passage of 50 words is longer, in any of the corpus's languages, but for one in fifty.
REPEATED = 250


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not find toxic. Null and empty texts stay, repeated rows are judged alike, all columns are kept."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id (null ids last); documents without words stay, repeated rows once."""
    return setsketch.keep_one(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of REPEATED bytes that stand anywhere else; a document of which nothing but white space is left goes, if it had more.

    Every copy of such a string goes, the first one too: what many documents share is boilerplate, and its owner is unknown. Null texts
    stay null, empty ones empty; repeated rows lose what they share; all columns are kept, n_chars (where there is one) is set anew for
    changed texts. An empty table gives an empty one.
    """
    flag = next(c for i in range(len(docs.columns) + 1) if (c := f"no_text_{i}") not in docs.columns)
    found = suffix_dedup.remove_repeats(docs.withColumn(flag, F.col("text").isNull()), length=REPEATED, with_text=True, with_rest=True)
    text, changed = F.when(~F.col("rest")[flag], F.col("kept")), F.col("n_removed") > 0
    own = {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(changed, F.length("kept")).otherwise(F.col("rest")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    left = found.where(~changed | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item by half or more. Null and empty texts stay, repeated rows are judged alike, all columns are kept."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"), whole_short=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with their places in a schedule of source blocks; a null source is a source, repeated rows take places each."""
    return mixing.mix(docs, MIX_WEIGHTS, MIX_DEFAULT, block=MIX_BLOCK)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_strings", remove_repeated_strings),
    ("decontamination", remove_leaks),
    ("mixing", mix_sources),
]

#: Model, sketches and suffix sorting have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
