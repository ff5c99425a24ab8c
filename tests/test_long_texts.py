"""Spans of texts with very long runs of function words or of joined words, and of documents in several rows."""

import re
import time

import pytest
from pyspark.sql import functions as F

from ontoscore.functions import text as tx
from ontoscore.plans import operator_queries


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_long_runs_do_not_fill_the_stack(spark):
    rows = spark.createDataFrame([("and " * 200_000 + "rents rise",), ("a-" * 200_000 + "a",)], "t string")
    got = rows.select(F.length(tx.without_lead(F.col("t"))), F.size(F.regexp_extract_all("t", F.lit(tx.ASCII_WORD), F.lit(0)))).collect()
    assert [tuple(r) for r in got] == [(10, 200_002), (400_000, 1)]  # "a" leads and is cut off


def test_long_runs_inside_a_text_take_linear_time(spark, tmp_path):
    runs = [f"Wages fall{c * 400_000}quickly" for c in (" ", "\u00a0", "-", ",")] + [f"Wages fall,{' ' * 400_000}quickly while rents rise"]
    sf = documents(spark, tmp_path, list(enumerate(runs)))
    began = time.monotonic()
    assert [tuple(r) for r in operator_queries.valued(spark, sf).collect()] == [(4, 2900, 5800)]  # of the last: "Wages fall", "rents rise"
    assert time.monotonic() - began < 40


def test_ends_are_cut_off_as_by_patterns(spark):
    spaces, ends = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", ["", " ", ",", "\u2028", "\x85", "”", "\x1f", "\u3000", "—", "\n"]
    texts = [f"{c}{a}rents, rise—high{a}{b}{c}" for a in ends for b in ends for c in ends]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.stripped(F.col("t")), tx.trimmed_span(F.col("t")))
    rows = [tuple(r)[1:] for r in sorted(table.collect())]

    def strip(t):
        return re.sub(rf"^{spaces}|{spaces}\Z", "", t)

    def trimmed(t):
        t = re.sub("^[\"“”]+|[\"“”]+\\Z", "", strip(t))
        return strip(re.sub(r"(?a)[\s,;:.\-—–]+(?=[\x85\u2028\u2029]?\Z)", "", t))

    assert rows == [(strip(t), trimmed(t)) for t in texts]


ONE, TWO = "Wages fall quickly", "landlords own houses"


@pytest.mark.parametrize("rows", [
    [(1, f"{ONE}. {TWO}. {ONE}."), (2, None), (3, "and " * 50_000), (4, "")],
    [(1, f"{ONE}. {TWO}."), (1, f"{ONE}."), (1, None), (2, None), (None, ONE), (None, TWO)],
])
def test_spans_by_document(spark, tmp_path, rows):
    """A span counts once a document, with its best kind, over all rows of the document."""
    sf = documents(spark, tmp_path, rows)
    n = sorted(tuple(r)[1:] for r in operator_queries.kept_spans(spark, sf).collect())
    worth = sorted(tuple(r)[1:] for r in operator_queries.valued(spark, sf).collect())
    documents_ = 2 if rows[1][0] == 1 else 1
    assert n == [(2, len(ONE) + len(TWO))] * documents_
    assert worth == [(2900, 2900 + 2500)] * documents_


def test_spans_move_only_where_rows_of_a_document_meet(spark, tmp_path):
    sf = documents(spark, tmp_path, [(i, f"{ONE}. {TWO}.") for i in range(8)])
    assert "HashAggregate" not in operator_queries.kept_spans(spark, sf)._jdf.queryExecution().executedPlan().toString()
