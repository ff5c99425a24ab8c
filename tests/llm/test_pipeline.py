"""All stages of the corpus pipeline on planted rows, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontoscore.llm.queries import MIX_BLOCK
from tests.llm.test_near_and_leaks import brute, shingles
from tests.llm.test_windows import brute_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_of int, kept string"


def prose(r, n):
    return " ".join("".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """documents, labels and benchmark in a folder, with the ids of each kind of planted row."""
    r = random.Random(8)
    words = prose(r, 300).split()
    plain = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, kinds = [], {}

    def put(kind, text):
        rows.append((len(rows), text))
        kinds.setdefault(kind, []).append(len(rows) - 1)

    for i in range(400):
        put("clean", plain(60))
        if i % 8 == 0:
            w = plain(60).split()
            for _ in range(6):
                w.insert(r.randrange(60), r.choice(["vilest", "hateful", "scumbag"]))
            put("toxic", " ".join(w))
    for i in range(20):
        w = rows[kinds["clean"][i]][1].split()
        put("copy", " ".join(w))
        w[30] = "changed"
        put("near", " ".join(w))
    passages = [prose(r, 52) for _ in range(4)]
    for i in range(24):
        put("passage", f"{plain(30)} {passages[i % 4]} {plain(30)}")
    put("only", passages[0])
    items = [(i, prose(r, 30)) for i in range(10)]
    for i, text in items[:6]:
        half = text.split()
        put("leak", f"{plain(20)} {' '.join(half[15:])} {plain(9)} {' '.join(half[:15])} {plain(20)}")
    put("null", None)
    put("empty", "")
    put("blank", " \n")
    rows += [rows[5], (None, "a text whose id nobody knows"), (1, None)]
    folder = str(tmp_path_factory.mktemp("planted"))
    table = [(d, t, "en" if d != 3 else None, f"s{(d or 0) % 3}" if d != 4 else None, len(t or ""), 7, "q") for d, t in rows]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    toxic = set(kinds["toxic"])
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in [*kinds["clean"][::2], *kinds["toxic"][::2]]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kinds


@pytest.fixture(scope="module")
def stages(spark, planted):
    """(name, rows before, rows after) of each stage, written and read again between them."""
    folder, _ = planted
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        after.write.parquet(f"{folder}/out-{name}")
        after = spark.read.parquet(f"{folder}/out-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_are_kept(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes), name
    assert set(stages[-1][2].columns) > set(stages[-1][1].columns)


def test_toxicity(stages, planted):
    _, kinds = planted
    left = ids(stages[0][2])
    assert sum(d in left for d in kinds["toxic"]) <= 2 and sum(d not in left for d in kinds["clean"]) <= 4
    assert {kinds["null"][0], kinds["empty"][0], kinds["blank"][0], None} <= left


def test_near_duplicates(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1][1].select("doc_id", "text").collect()]
    want = [d for d, _, c, kept in brute([(d, t) for d, t in rows if shingles(t, 5)], 5, 80) if kept]
    got = [r["doc_id"] for r in stages[1][2].where(F.trim(F.translate("text", "\n", " ")) != "").select("doc_id").collect()]
    assert sorted(got, key=str) == sorted(set(want), key=str)


def test_repeated_strings(stages, planted):
    _, kinds = planted
    rows = [(r["doc_id"], r["text"]) for r in stages[2][1].select("doc_id", "text").collect()]
    want = {d: n for d, _, n, _, _ in brute_bytes(rows, corpus_pipeline.REPEATED)}
    before = {r["doc_id"]: r for r in stages[2][1].collect()}
    after = {r["doc_id"]: r for r in stages[2][2].collect()}
    for d, r in after.items():
        assert len((before[d]["text"] or "").encode()) - len((r["text"] or "").encode()) == want[d]
        assert r["n_chars"] == (len(r["text"]) if want[d] else before[d]["n_chars"]) and r["lang"] == before[d]["lang"]
        assert (r["text"] is None) == (before[d]["text"] is None)
    gone = set(before) - set(after)
    assert all(not brute_left(before[d]["text"], rows) for d in gone) and set(kinds["only"]) & set(before) <= gone
    assert all(want[d] >= 250 for d in kinds["passage"] if d in before)


def brute_left(text, rows):
    """Whether anything but white space is left of a text: no, if one repeated stretch covers it."""
    return not any(text in (t or "") and t != text for _, t in rows)


def test_leaks(stages, planted):
    _, kinds = planted
    assert ids(stages[3][1]) - ids(stages[3][2]) == set(kinds["leak"]) & ids(stages[3][1])


def test_mixing(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert len(rows) == before.count() and len({r["position"] for r in rows}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows) and MIX_BLOCK == 8


def test_run_and_empty_tables(spark, planted, stages):
    folder, _ = planted
    assert corpus_pipeline.run(spark, folder).count() == stages[-1][2].count()
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name
    plain = spark.createDataFrame([(1, "x " * 300 + "end", 5), (2, "y " + "x " * 300, 6)], "doc_id long, text string, no_text_0 int")
    kept = corpus_pipeline.remove_repeated_strings(spark, plain, folder)
    assert kept.columns == plain.columns and {(r["doc_id"], r["no_text_0"]) for r in kept.collect()} == {(1, 5), (2, 6)}
