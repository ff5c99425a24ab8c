"""Keyed objects and files of any size, and appends that repeat."""

import hashlib
import json
import os

import pytest

from ontoscore.sources import jsonl
from ontoscore.streaming.ingest import append_once, durable_append

ENTRIES = {
    "plain": {"id": "plain", "x": [1, 2, {"a": "}"}]}, "comma,key": {"id": "comma,key", "x": ",,,"}, 'quo"te\\': {"id": 'quo"te\\', "x": '\\",\\\\"{['},
    "braces}{": {"id": "other", "x": "],[", "y": {"z": [[], {}, [{"q": "\\"}]]}}, "é,\n日本": {"id": None, "x": "\n,\t"}, "": {"id": "", "x": {}}, "empty": {}, "long": {"id": "long", "x": "a,\"b\\," * 500},
}


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_keyed_objects_in_splits(spark, tmp_path, size, indent):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.json").write_text(json.dumps(ENTRIES, indent=indent, ensure_ascii=False), encoding="utf8")
    (tmp_path / "o" / "b.json").write_text(" { } \n")
    (tmp_path / "o" / "c.json").write_text('{"one": {"id": "one"}, "bad" {"id": 3}, "two": {"id": "two"}}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert spark.read.option("lineSep", ",").text(str(tmp_path / "o")).rdd.getNumPartitions() > (50 if size < 100 else 0)
        got = {(os.path.basename(r["file"]), r["entry"]): r["text"] for r in jsonl.keyed_entries(spark, str(tmp_path / "o")).collect()}
        rows = jsonl.read_keyed(spark, str(tmp_path / "o"), "struct<id:string>", "id").collect()
        bad = [r["text"].strip() for r in jsonl.bad_entries(spark, str(tmp_path / "o")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [json.loads("{" + got["a.json", i] + "}") for i in range(len(ENTRIES))] == [{k: v} for k, v in ENTRIES.items()]
    assert sorted(k for k in got if k[0] != "a.json") == [("c.json", 0), ("c.json", 1), ("c.json", 2)]
    assert bad == ['"bad" {"id": 3}']
    want = [(k, v.get("id"), k == v.get("id")) for k, v in ENTRIES.items()] + [("one", "one", True), ("two", "two", True), (None, None, False)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_files_are_hashed_as_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jsonl, "CHUNK", 1000)
    data = {"a b.txt": b"x" * 4321, "empty.bin": b"", "sub/u.html": bytes(range(256)) * 40}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = jsonl.inventory(spark, str(tmp_path))
    read = found._jdf.queryExecution().executedPlan().toString().partition("ReadSchema: ")[2]
    assert read.startswith("struct<") and "content" not in read
    got = sorted((r["length"], r["sha256"]) for r in found.collect())
    assert got == sorted((len(x), hashlib.sha256(x).hexdigest()) for x in data.values() if x)


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, text string")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(4).write.json(source)
    stream = lambda: spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).json(source)
    for check in ("one", "one", "two"):  # the second run knows what is done, the third repeats every batch
        durable_append(stream(), target, str(tmp_path / check)).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(target).select("id", "text").collect())) == [(i, f"t{i}") for i in range(20)]
    append_once(rows.limit(3), target, 99)
    append_once(rows.limit(3), target, 99)
    assert spark.read.parquet(target).count() == 23
