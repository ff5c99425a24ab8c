"""Requests that are put together while results arrive, against the batch reduction and a plain one."""

import datetime
import json
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from ontoscore.fixed import RELATIONS
from ontoscore.streaming import arriving

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def made(seed):
    """Results of six requests in line order: repeated attempts, failures, claims of one index by several jobs."""
    pick, rows, line = random.Random(seed), [], 0
    for _ in range(3):
        for c in "abcdef":
            for kind, index in [*[("feature", str(i)) for i in range(4)], *[("relation", t) for t in list(RELATIONS)[:3]], ("factual", "T0"), ("factual", "T1"), ("semantic", "0")]:
                if pick.random() < 0.4 + 0.2 * (c == "a"):
                    continue
                line += 1
                ok = pick.random() < 0.7
                body = {"feature": [{"claim_index": int(index) if kind == "feature" else 0, "v": line}] + [{"claim_index": 9, "v": line}] * (pick.random() < 0.2), "relation": {"relation_type": index, "relation_value": f"é{line}"}, "factual": {"factual_target_id": index, "v": line}, "semantic": {"v": line}}[kind]
                rows.append((line, c, f"{c}::{kind}::{index}", kind, index, ok, None if ok else "no", json.dumps(body) if ok else None, 10, START + datetime.timedelta(minutes=line)))
    return rows


def plain(rows):
    out = {}
    for c in {r[1] for r in rows}:
        own = sorted(r for r in rows if r[1] == c)
        good = [(r, json.loads(r[7])) for r in own if r[5]]
        claims = {x["claim_index"]: x for r, b in good if r[3] == "feature" for x in b}
        relations = {b["relation_type"]: b for r, b in good if r[3] == "relation"}
        semantic = [b for r, b in good if r[3] == "semantic"]
        out[c] = (len(own), len(good), len({r[2] for r, _ in good}) >= 10, [claims[i] for i in sorted(claims)], [relations[t] for t in RELATIONS if t in relations], [b for r, b in good if r[3] == "factual"], semantic[0] if semantic else None, [r[2] for r in own if not r[5]])
    return out


def read(spark, target):
    rows = arriving.latest(spark.read.parquet(target)).collect()
    return {r["custom_id"]: (r["version"], r["n_ok"], r["complete"], *[json.loads(r[c]) for c in ("claims", "relations", "facts")], json.loads(r["semantic"]) if r["semantic"] else None, [x["job_id"] for x in json.loads(r["failed"])]) for r in rows}


def test_a_stream_that_is_stopped_equals_one_reduction(spark, tmp_path):
    rows, source, target, check = made(4), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    files = [rows[i::5] for i in range(5)]  # lines arrive out of order
    schema = arriving.RESULT

    def put(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        arriving.run(stream, target, check).awaitTermination()

    for part in files[:3]:
        put(part)
    go()
    assert read(spark, target) == plain([r for p in files[:3] for r in p])
    go()  # nothing new
    assert read(spark, target) == plain([r for p in files[:3] for r in p])
    for part in files[3:]:
        put(part)
    go()
    assert read(spark, target) == plain(rows)


def test_late_requests(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = [(1, "a", "a::semantic::0", "semantic", "0", True, None, "{}", 2, START), (2, "b", "b::semantic::0", "semantic", "0", True, None, '{"x": 1}', 1, START)]
    later = [(3, "c", "c::semantic::0", "semantic", "0", True, None, "{}", 2, START + datetime.timedelta(hours=9))]
    for part in (first, later, [(4, *later[0][1:-1], START + datetime.timedelta(hours=10))]):
        spark.createDataFrame(part, arriving.RESULT).coalesce(1).write.mode("append").parquet(source)
        arriving.run(spark.readStream.schema(arriving.RESULT).parquet(source), target, check, late="1 hour").awaitTermination()
    assert {(r["custom_id"], r["complete"], r["late"]) for r in arriving.latest(spark.read.parquet(target)).collect()} == {("a", False, True), ("b", True, False), ("c", False, False)}
    assert spark.read.parquet(target).where(F.col("late")).count() == 1


class Counted:
    """A state and its timers in a dictionary; every call is counted, since each goes to the JVM and back."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"getValueState": lambda *a: self, "getMapState": lambda *a: self, "get": lambda: self.values.get("v"), "exists": lambda: "v" in self.values, "containsKey": lambda k: k in self.values,
                    "getValue": lambda k: self.values[k], "updateValue": self.values.__setitem__, "update": lambda v: self.values.__setitem__("v", v), "iterator": lambda: iter([(k, v) for k, v in self.values.items() if k != "v"]),
                    "keys": lambda: iter(()), "listTimers": lambda: iter(self.timers), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[name](*args)

        return call


def test_calls_to_the_state_do_not_grow_with_results():
    rows = [Row(**dict(zip([c.split()[0] for c in arriving.RESULT.split(", ")], r, strict=True))) for r in made(4) if r[1] == "b"]
    state, assembly = Counted(), arriving.Assembly(1000)
    assembly.init(state)
    state.calls = 0
    out = [list(assembly.handleInputRows(("b",), iter(part), None))[0] for part in (rows[:4], rows[4:])]
    assert state.calls <= 8 and len(rows) > 12
    assert (out[-1].version, out[-1].n_ok) == plain(made(4))["b"][:2]
    assert state.timers == (set() if out[-1].complete else {int(max(r.at for r in rows).timestamp() * 1000) + 1000})
    late = list(assembly.handleExpiredTimer(("b",), None, None))
    assert [r.late for r in late] == [True] * (not out[-1].complete)
