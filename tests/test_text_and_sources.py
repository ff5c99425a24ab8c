import hashlib
import json
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from ontoscore.functions import ident, text
from ontoscore.operators import evidence, stats, swarm
from ontoscore.sources import jsonl
from ontoscore.streaming.ingest import ingest

HARD = ["", "it’s a well-known co-op's – 'quoted' x² ½ naïve", "été été", "你好, world_1", "a--b 'c", "مرحبا"]


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize("t", HARD)
def test_word_count(spark, t):
    t = unicodedata.normalize("NFC", t)
    assert one(spark, text.word_count, t) == len(re.findall(r"\b[\w’'-]+\b", t))


def test_blocks_and_objects(spark):
    t = "<T>short</T> <T>this is a long enough block</T> <T>tiny</T>"
    assert one(spark, lambda c: text.tag_block(c, "T"), t) == "this is a long enough block"
    assert one(spark, lambda c: text.tag_block(c, "T", 100), t) == "tiny"
    assert text.first_object('```json\n{"a": {"b": "}"}} trailing') == '{"a": {"b": "}"}}'
    assert text.first_object("{bad} [1]") is None
    assert one(spark, text.first_json_object, 'x {"a":1} y') == '{"a":1}'
    assert one(spark, text.chat_content, '{"content":"plain"}') == "plain"
    assert one(spark, text.chat_content, '{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}') == "ab"


def test_small_text_functions(spark):
    assert one(spark, text.stripped, "  x\t") == "x"
    assert one(spark, text.newlines, "a\r\nb\rc") == "a\nb\nc"
    assert one(spark, text.sanitised, "__a b//c__") == "a_b_c"
    assert one(spark, lambda c: text.sanitised(c, "._-"), "-.a b.") == "a_b"
    assert one(spark, text.extension, "http://x.org/a.PDF?q", "text/html") == ".pdf"
    assert one(spark, text.extension, "http://x.org/a", "text/html; charset=utf-8") == ".html"
    assert one(spark, text.chat_url, "http://h/v1/") == one(spark, text.chat_url, "http://h") == "http://h/v1/chat/completions"
    assert one(spark, lambda c: text.last_header(c, "etag"), "HTTP/1 301\r\nETag: a\r\n\r\nHTTP/1 200\r\nETag: b\r\n\r\n") == "b"
    assert one(spark, text.sentences, "A b. C;\nd") == ["A b", "C", "d"]
    assert one(spark, text.trimmed_span, "and the big firm, ") == "big firm"
    assert one(spark, lambda c: text.cue_hits(c, F.array(F.lit("Rent"), F.lit("rent"), F.lit("wage"))), "the RENT") == 1
    spans = F.array(*[F.lit(s) for s in ("alpha beta gamma", "beta alpha gamma", "delta epsilon")])
    assert spark.range(1).select(text.greedy_distinct(spans, 5, 0.6)).first()[0] == ["alpha beta gamma", "delta epsilon"]
    grams = spark.range(1).select(text.ngrams(F.array(*[F.lit(w) for w in "the big old firm sells rent".split()]), 4, 5)).first()[0]
    assert grams == ["big old firm sells", "old firm sells rent", "big old firm sells rent"]


def test_identity(spark):
    assert one(spark, ident.uuid5, "http://x/é") == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://x/é"))
    a, b = '{"b":1,"a":{"d":[1,2],"c":"é"}}', '{"a": {"c": "é", "d": [1, 2]}, "b": 1}'
    assert one(spark, ident.canonical_json, a) == one(spark, ident.canonical_json, b) == '{"a":{"c":"é","d":[1,2]},"b":1}'
    want = hashlib.sha256(b'{"x":1}').hexdigest()
    assert one(spark, lambda c: ident.json_hash(c, "h"), '{"h":"old","x":1}') == want
    assert one(spark, lambda a, b: ident.content_hash(a, b), "p", None) == hashlib.sha256(b"p\x1f").hexdigest()


def test_manifest_is_written_once(spark, tmp_path):
    m = ident.RunManifest("1", "now", "c", ident.configuration_hash({"b": 1, "a": 2}))
    ident.write_manifest(spark, m, str(tmp_path / "m"))
    with pytest.raises(Exception, match="exists"):
        ident.write_manifest(spark, m, str(tmp_path / "m"))


def test_jsonl(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text('{"a":1}\n\nnot json\n[2]\n{"a":3}\n')
    rows = jsonl.read_jsonl(spark, str(f), "a int", strict=False).orderBy("line_no").collect()
    assert [(r["line_no"], r["a"]) for r in rows] == [(1, 1), (5, 3)]
    assert [r["line_no"] for r in jsonl.bad_lines(spark, str(f)).orderBy("line_no").collect()] == [3, 4]
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_jsonl(spark, str(f), "a int").collect()
    jsonl.write_jsonl(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":null,"b":1}'


def test_lines_of_split_files(spark, tmp_path):
    for f in ("a", "b"):
        (tmp_path / f).write_text("".join(f"{f}{i}\n" if i % 7 else "\n" for i in range(1, 3000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert {(r["line"], r["line_no"]) for r in lines.collect()} == {(f"{f}{i}", i) for f in "ab" for i in range(1, 3000) if i % 7}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_keyed_and_inventory(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"x": {"id": "x", "v": 1}, "y": {"id": "z", "v": 2}}))
    got = {r["key"]: r["key_matches"] for r in jsonl.read_keyed(spark, str(tmp_path / "k.json"), "struct<id:string,v:int>", "id").collect()}
    assert got == {"x": True, "y": False}
    r = jsonl.inventory(spark, str(tmp_path)).first()
    assert (r["class"], r["sha256"]) == ("data", hashlib.sha256((tmp_path / "k.json").read_bytes()).hexdigest())


def test_evidence_banks_are_verbatim(spark):
    t = 'Owners raise rents because housing is scarce; tenants "pay a growing share" of wages, and the city council argues.'
    got = evidence.banks(t, {"rent": ["rent", "tenant"], "none": ["zebra"]})
    assert got["none"] == [] and got["rent"] and all(s in t for b in got.values() for s in b)
    assert got[""][0] == "pay a growing share"
    rows = evidence.build_banks(spark.createDataFrame([("r", t), ("e", None)], "response_id string, text string"), {"rent": ["rent"]}).collect()
    assert {(r["response_id"], r["feature_id"]) for r in rows} == {("r", ""), ("r", "rent"), ("e", ""), ("e", "rent")}


def requests(spark):
    return spark.createDataFrame([("q", [("f0", "g"), ("f1", "g")], ["t1", None])], "custom_id string, features array<struct<feature_id:string,feature_group:string>>, factual_targets array<string>")


def test_decompose(spark):
    counts = {m: swarm.decompose(requests(spark), m).count() for m in swarm.MODES}
    assert counts == {"feature": 2, "feature_group": 1, "relation": 9, "factual": 1, "all": 2 + 9 + 1 + 1}


def outputs(spark, rows):
    schema = "line_no int, custom_id string, job_id string, job_type string, index string, ok boolean, error string, truncated boolean, claims array<struct<claim_index:int,v:int>>, relation struct<relation_type:string,relation_value:string>, fact struct<factual_target_id:string>, semantic struct<relevance:string>"
    return spark.createDataFrame(rows, schema)


def test_reduce(spark):
    out = outputs(spark, [
        (1, "q", "a", "feature", "0", True, None, None, [(0, 1)], None, None, None),
        (2, "q", "b", "feature", "1", False, "cut", True, None, None, None, None),
        (3, "q", "a", "feature", "0", True, None, None, [(0, 2)], None, None, None),
        (4, "q", "b", "feature", "1", True, None, None, [(1, 3)], None, None, None),
    ])
    r = swarm.reduce(requests(spark), out, "feature").first()
    assert [(c["claim_index"], c["v"]) for c in r["judge_output"]["claims"]] == [(0, 2), (1, 3)]
    assert (r["ok"], r["n_jobs"], r["n_ok"], len(r["failed_jobs"])) == (False, 4, 3, 1)
    assert swarm.reduce(requests(spark), out, "feature", latest_attempt_wins=True).first()["ok"] is True


def test_selection_and_resumption(spark):
    rows = spark.createDataFrame([(i, f"c{i}", "f") for i in range(1, 6)], "line_no int, custom_id string, item_family_id string")
    done = swarm.done_ids(spark.createDataFrame([("c2", False), ("c3", True)], "custom_id string, ok boolean"))
    assert [r["custom_id"] for r in swarm.select_rows(rows, done, start=2, limit=1).collect()] == ["c4"]
    assert done.count() == 2
    twice = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "line_no int, custom_id string, v string")
    assert swarm.last_by_line(twice).first()["v"] == "y"


def test_power_grows_with_families():
    few, many = stats.cluster_power(0.2, 6, draws=2000), stats.cluster_power(0.2, 24, draws=2000)
    assert few["power"] < many["power"] and many["half_width"] < few["half_width"]


def test_streaming_ingest_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"job_id":"a","v":1}\n{"job_id":"a","v":1}\n')
    args = (spark, str(src), "job_id string, v int", str(tmp_path / "out"), str(tmp_path / "ck"))
    ingest(*args).awaitTermination()
    (src / "2.json").write_text('{"job_id":"a","v":2}\n{"job_id":"b","v":3}\n')
    ingest(*args).awaitTermination()
    assert {(r["job_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 1), ("b", 3)}
