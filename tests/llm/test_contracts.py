"""The queries over whole test tables: against brute force written from the contracts, and against their SQL."""

import hashlib
from collections import Counter

import duckdb
import pytest

from ontoscore.llm import queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(spark, sf):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_op1(spark):
    rows = [(d, t.encode()) for d, t in documents(spark, LARGER)]
    seen, twice = set(), set()
    for _, b in rows:
        for i in range(len(b) - 399):
            h = hash(b[i : i + 400])
            (twice if h in seen else seen).add(h)
    places = {}  # equal hashes are told apart by their bytes
    for k, (_, b) in enumerate(rows):
        for i in range(len(b) - 399):
            if (h := hash(b[i : i + 400])) in twice:
                places.setdefault(h, []).append((k, i))
    gone = [bytearray(len(b)) for _, b in rows]
    for same in places.values():
        held = Counter(rows[k][1][i : i + 400] for k, i in same)
        for k, i in same:
            if held[rows[k][1][i : i + 400]] > 1:
                gone[k][i : i + 400] = b"\x01" * 400
    want = Counter()
    for (d, b), g in zip(rows, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        want[d, len(b), sum(g), len([s for s in bytes(g).split(b"\x00") if s]), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in queries.op1_suffix_dedup(spark, LARGER).collect()) == want


def test_op9(spark):
    rows = [(d, t.encode().split()) for d, t in documents(spark, LARGER)]
    first = {}
    for d, w in rows:
        for i in range(len(w) - 49):
            k = b" ".join(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    want = Counter()
    for d, w in rows:
        gone = bytearray(len(w))
        for i in range(len(w) - 49):
            if first[b" ".join(w[i : i + 50])] < d:
                gone[i : i + 50] = b"\x01" * 50
        kept = [x for x, y in zip(w, gone, strict=True) if not y]
        want[d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    assert Counter(tuple(r) for r in queries.op9_rlz(spark, LARGER).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want


def test_op7(spark):
    sets = {}
    for d, t in documents(spark, LARGER):
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    having = {}
    for d, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in having[x] if e < d).items():
            if 100 * both >= 80 * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    want = {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}
    assert {tuple(r) for r in queries.op7_near_dedup(spark, LARGER).select("doc_id", "n_shingles", "component_id", "kept").collect()} == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    r = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(x[c] for c in names) for x in df.collect()) == Counter(map(tuple, r.fetchall()))
