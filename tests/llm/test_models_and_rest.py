"""Toxicity, language model, mixing, archive, search and chat."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoscore.llm import lm, toxicity
from ontoscore.llm.bitslice import Block, add, search
from ontoscore.llm.chat import calls_of, levels, link, problems, results_of
from ontoscore.llm.mixing import mix, period
from ontoscore.llm.queries import CHAT_SCHEMAS
from ontoscore.llm.warc import export_warc, parse_warc, read_index, read_records, read_warc, write_archive

# ---------------------------------------------------------------- toxicity


def labelled(n, seed):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows = []
    for i in range(n):
        w = [r.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randint(1, 6)):
                w.insert(r.randrange(len(w)), r.choice(["vile", "nasty", "grossly", "grossen"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_finds_held_out_texts(spark):
    rows = labelled(800, 1)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d % 2 == 0], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[d]["toxic"], bool(y)) for d, _, y in rows if d % 2]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r["p_severe"] <= r["p_any"] <= 1 and r["severity"] == pytest.approx(r["p_any"] + r["p_severe"]) for r in got.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["toxic"]}


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some text"), (3, "a " * 50000), (3, "again")], "doc_id long, text string")
    one = spark.createDataFrame([(3, 0), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    for labels in (one, one.limit(0)):
        rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(rows) == 5 and not any(r["toxic"] for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), one)).count() == 0


def test_toxicity_chances_keep_the_class_shares_of_all_labels(spark):
    """A tenth is toxic; the sample holds as many of each class. Marking words are in both, so chances are not all near 0 or 1."""
    r = random.Random(3)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows = []
    for i in range(3000):
        bad = i % 10 == 0
        mark = ["vile"] * (r.random() < (0.6 if bad else 0.15))
        rows.append((i, " ".join([r.choice(plain) for _ in range(20)] + mark), int(bad)))
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    for sample in (3000, 300):
        p = [x["p_any"] for x in toxicity.score(docs, toxicity.train(docs, labels, sample=sample)).collect()]
        assert sum(p) / len(p) == pytest.approx(0.1, abs=0.03)


def test_ordinal_gradient():
    """The fit's likelihood is at an optimum: moving a threshold or weight does not raise it."""
    r = np.random.default_rng(0)
    n = 400
    x = r.random((n, 3)) < 0.5
    grades = np.digitize(x @ np.array([2.0, -1.0, 0.5]) + r.logistic(size=n), [0.0, 1.5])
    rows, cols = np.nonzero(x)
    m = toxicity.fit(rows, cols, grades, 3, 3, penalty=0.0, rounds=3000, rate=0.02)
    used = np.flatnonzero(m.weights)

    def loss(w, cuts):
        s = x @ w
        p = 1 / (1 + np.exp(s[:, None] - np.concatenate([[-np.inf], cuts, [np.inf]])[None, :]))
        return -np.log(np.diff(p, axis=1)[np.arange(n), grades]).mean()

    best = loss(m.weights, m.thresholds)
    for i in used:
        for d in (-0.05, 0.05):
            assert loss(m.weights + d * (np.arange(3) == i), m.thresholds) > best
    for i in range(2):
        for d in (-0.05, 0.05):
            assert loss(m.weights, m.thresholds + d * (np.arange(2) == i)) > best


# ---------------------------------------------------------------- language model


def lm_rows(seed, n=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcd") for _ in range(3)) for _ in range(40)]
    rows = [(0, None), (1, ""), (None, "Null id"), (5, "A b"), (5, "a B")]
    for i in range(6, n):
        w, t = r.choice(vocab), []
        for _ in range(r.randint(0, 60)):
            t.append(w)
            w = vocab[(vocab.index(w) * 3 + 1) % 40] if r.random() < 0.8 else r.choice(vocab)
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize(("block", "part"), [(1 << 20, 1 << 20), (700, 64)])
def test_lm(spark, block, part):
    rows = lm_rows(1)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fold int")
    got = lm.score(df, block_bytes=block, part_keys=part).collect()
    texts = [(d, ["<s>", *((t or "").lower().split()), "</s>"]) for d, t in rows]
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5
    uni = Counter()
    for d, w in texts:
        if fold(d) != 1:
            uni.update(w[1:])
    n, v = sum(uni.values()), len(uni)
    want = []
    for d, w in texts:
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w[1:])
        want.append((str(d), fold(d) == 1, len(w) - 1, sum(uni[x] > 0 for x in w[1:]), n, round(base, 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_scores(rows, order, weights=None):
    """Deleted interpolation with dictionaries: (scores by row, weights by level and bucket); weights None: learned by EM, token by token."""
    texts = [(d, ["<s>", *((t or "").lower().split()), "</s>"]) for d, t in rows]
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5
    bucket = lambda c: int(math.log2(c + 1))

    def model(folds):
        count = Counter()
        for d, w in texts:
            if fold(d) in folds:
                for n in range(1, order + 1):
                    count.update(tuple(w[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(w)))
                count[("<s>",)] += 1
        total = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))
        types = sum(len(g) == 1 and g != ("<s>",) for g in count)
        return count, total, types

    def chance(m, w, i, weights):
        count, total, types = m
        p = (count[(w[i],)] + 0.5) / (total + 0.5 * (types + 1))
        for n, by_bucket in enumerate(weights, 2):
            if i >= n - 1 and (c := count[tuple(w[i - n + 1 : i])]):
                x = by_bucket.get(bucket(c), by_bucket[max((b for b in by_bucket if b < bucket(c)), default=0)])
                p = x * count[tuple(w[i - n + 1 : i + 1])] / c + (1 - x) * p
        return p

    if weights is None:
        weights, m = [], model({2, 3, 4})
        for n in range(2, order + 1):
            seen = {}
            for w in (w for d, w in texts if fold(d) == 0):
                for i in range(n - 1, len(w)):
                    if c := m[0][tuple(w[i - n + 1 : i])]:
                        seen.setdefault(bucket(c), []).append((m[0][tuple(w[i - n + 1 : i + 1])] / c, chance(m, w, i, weights)))
            by_bucket = {0: 0.0}
            for b, pairs in seen.items():
                x = 0.5
                for _ in range(100):
                    x = sum(x * p / (x * p + (1 - x) * q) for p, q in pairs) / len(pairs)
                by_bucket[b] = min(max(x, 1e-6), 1 - 1e-6)
            weights.append(by_bucket)
    m = model({0, 2, 3, 4})
    return [sum(math.log10(chance(m, w, i, weights)) for i in range(1, len(w))) for _, w in texts], weights


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize(("block", "part"), [(1 << 20, 1 << 20), (700, 64)])
def test_lm_mixture(spark, monkeypatch, order, block, part):
    rows = lm_rows(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    learned, learn = [], lm.learn
    monkeypatch.setattr(lm, "learn", lambda cells: learned.append(learn(cells)) or learned[-1])
    got = lm.score(df, block_bytes=block, part_keys=part, order=order).collect()
    # with the weights that the operator learned, token by token
    want, _ = plain_scores(rows, order, [dict(enumerate(w)) for w in learned])
    assert sorted([(r["doc_id"], round(r["score"], 6)) for r in got], key=key) == sorted([(d, round(s, 6)) for (d, _), s in zip(rows, want, strict=True)], key=key)
    # these weights are those of EM on the tokens themselves, but for the bins
    assert len(learned) == order - 1
    for mine, plain in zip(learned, plain_scores(rows, order)[1], strict=True):
        for b, x in plain.items():
            assert abs(mine[b] - x) < 0.03


def test_lm_without_tuning_or_training_rows(spark):
    by_fold = {f: [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == f][:6] for f in range(5)}
    for folds in ([1], [0], [2, 3], [0, 1]):
        rows = [(i, "a b a b c a b") for f in folds for i in by_fold[f]] + [(by_fold[folds[0]][0], "")]
        got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and all(math.isfinite(r["score"]) for r in got)
        if folds == [1]:
            assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


def test_lm_probabilities_sum_to_less_than_one(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    w = lm.learn([(3, 0, 10, 0.0), (3, 20, 30, 300.0)])
    x = w[3]
    like = lambda x: 10 * math.log(1 - x) + 30 * math.log(x * 10 + 1 - x)
    assert like(x) >= max(like(x - 0.01), like(x + 0.01))
    assert w[0] == 0 and w[5] == w[3]


# ---------------------------------------------------------------- mixing


def test_mixing_deviates_by_less_than_one_block(spark):
    src = spark.createDataFrame([("a", 7), ("b", 2), (None, 3), ("d", 1)], "source string, weight int")
    slots = period(src).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(13))
    given = Counter()
    for r in slots:
        assert r["release"] <= r["slot"] < r["deadline"]
        given[r["source"]] += 1
        for s, w in [("a", 7), ("b", 2), (None, 3), ("d", 1)]:
            assert abs(given[s] - (r["slot"] + 1) * w / 13) < 1


def edf(weights):
    """Earliest deadline first over one period, source by source; ties to the smaller source, null first."""
    names = sorted(weights, key=lambda s: (s is not None, s))
    total, given, out = sum(weights.values()), dict.fromkeys(names, 0), []
    for t in range(total):
        free = [(-(-(given[s] + 1) * total // weights[s]), i) for i, s in enumerate(names) if given[s] * total // weights[s] <= t]
        s = names[min(free)[1]]
        out.append((t, s, given[s], given[s] * total // weights[s], min(free)[0]))
        given[s] += 1
    return out


@pytest.mark.parametrize("chunk", [1000, 7])
def test_period_is_earliest_deadline_first(spark, monkeypatch, chunk):
    from ontoscore.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK", chunk)
    for weights in ({"a": 3, "b": 3, None: 1, "c": 3, "d": 2, "e": 1}, {"x": 1}, {f"s{i}": 4 for i in range(9)} | {"t": 7}):
        rows = period(spark.createDataFrame(list(weights.items()), "source string, weight int")).collect()
        assert sorted((r["slot"], r["source"], r["turn"], r["release"], r["deadline"]) for r in rows) == edf(weights)


def test_many_sources(spark):
    src = spark.range(20_000).selectExpr("concat('s', id) AS source", "CASE WHEN id = 0 THEN 24 ELSE 4 END AS weight")
    r = period(src).agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.count_if(~F.col("slot").between(F.col("release"), F.col("deadline") - 1)).alias("late")).first()
    assert (r["n"], r["slots"], r["late"]) == (80_020, 80_020, 0)


def test_mix_keeps_every_row(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 5}", i) for i in range(300)] + [(None, None, None, 1), (7, "t7", "hot", 7), (7, "t7", "hot", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    out = mix(df, {"hot": 3}, 2, block=4).collect()
    assert len(out) == len(rows) and len({r["position"] for r in out}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    inside = sorted({(r["slot"], r["source"]) for r in out if r["in_ratio"]}, key=lambda x: x[0])
    assert [s for s, _ in inside] == list(range(len(inside)))
    assert mix(df.limit(0), {}, 1).count() == 0


def test_mix_splits_hot_sources(spark, monkeypatch):
    from ontoscore.llm import mixing

    df = spark.createDataFrame([(i, "x", "a") for i in range(500)], "doc_id long, text string, source string")
    whole = {(r["doc_id"], r["position"]) for r in mix(df, {}, 1).collect()}
    monkeypatch.setattr(mixing.ranked, "__defaults__", (20,))
    assert {(r["doc_id"], r["position"]) for r in mix(df, {}, 1).collect()} == whole


# ---------------------------------------------------------------- archive


def test_archive_round_trip(spark, tmp_path):
    long = "<p>é</p>\r\n\r\n" * 120
    rows = [(1, "http://a", long), (5, "http://b", long), (3, None, long), (2, "u\r\nX: y", "short"), (4, "http://c", "short"), (6, "http://d", None), (7, "http://e", ""), (None, "http://f", long), (5, "http://b", long)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, sha256 string")
    path = str(tmp_path / "a")
    write_archive(df, path)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in read_index(spark, path).collect()}
    assert got == {(1, "revisit", 5), (3, "revisit", 5), (None, "revisit", 5), (5, "response", None), (2, "response", None), (4, "response", None), (6, "response", None), (7, "response", None)}
    assert spark.read.parquet(path + "/payloads").count() == 3
    records = read_records(spark, path).collect()
    assert len(records) == len(rows)
    for r in records:
        (header, payload), = parse_warc(r["record"].encode())
        assert header + "\r\n" == r["header"] + "\r\n" and payload.decode() == ("" if "revisit" in header else r["payload"])
    export_warc(spark, path, str(tmp_path / "w"))
    again = read_warc(spark, str(tmp_path / "w") + "/*.gz").collect()
    assert Counter((r["header"], bytes(r["payload"]).decode()) for r in again) == Counter((r["header"], "" if "Type: revisit" in r["header"] else r["payload"]) for r in records)


def test_record_ids_are_unique(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [(1, "u", "x")] * 3 + [(1, "v", "x"), (1, None, "x"), (None, "u", "x"), (2, "u", "y" * 2000), (3, "u", "y" * 2000), (3, "u", "y" * 2000)]
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    headers = [r["header"] for r in read_records(spark, path).collect()]
    ids = {line for h in headers for line in h.split("\r\n") if line.startswith("WARC-Record-ID")}
    assert len(headers) == len(rows) == len(ids)
    refers = [line.split(": ")[1] for h in headers for line in h.split("\r\n") if line.startswith("WARC-Refers-To: ")]
    assert len(refers) == 1 and f"WARC-Record-ID: {refers[0]}" in ids


def test_archive_detects_changed_headers(spark, tmp_path):
    for old, new in (("Content-Length: 7", "Content-Length: 8"), ("sha1:", "sha1:0")):
        path = str(tmp_path / new[:4])
        write_archive(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), path)
        bad = [(r["header"].replace(old, new), r["sha256"]) for r in spark.read.parquet(path + "/headers").collect()]
        spark.createDataFrame(bad, "header string, sha256 string").write.mode("overwrite").parquet(path + "/headers")
        with pytest.raises(Exception, match="differs from its header"):
            read_index(spark, path).collect()


def test_archive_detects_changed_payloads(spark, tmp_path):
    path = str(tmp_path / "a")
    write_archive(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), path)
    spark.createDataFrame([(r["sha256"], "other") for r in spark.read.parquet(path + "/payloads").collect()], "sha256 string, payload string").write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="differs"):
        read_index(spark, path).collect()
    empty = str(tmp_path / "e")
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert read_index(spark, empty).count() == 0


# ---------------------------------------------------------------- search


def test_carry_save_sum():
    r = np.random.default_rng(3)
    values = r.integers(0, 2**8, (20, 128))
    columns = [[np.packbits((v >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64) for v in values] for b in range(8)]
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(int) << i for i, s in enumerate(add(columns, 2)))
    assert (total == values.sum(0)).all()


@pytest.mark.parametrize(("n", "span"), [(1, 3), (70, 3), (300, 200)])
def test_block_is_exact(n, span):
    r = np.random.default_rng(n)
    v, ids = r.integers(-span, span, (n, 16)), r.permutation(n * 2)[:n]
    block = Block(ids, v)
    for q in range(0, n, 7):
        s = v @ v[q]
        want = sorted(((-s[i], ids[i]) for i in range(n) if ids[i] != ids[q]))[:5]
        assert block.search(v[q], int(ids[q])) == [(-a, b) for a, b in want]


def test_search(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(260)] + [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [0.5] * 6), (305, [1.0, 1.0]), (50, [0.9] * 6), (350, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    good = [(i, [math.floor(256 * np.float32(x).item()) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    got = search(df, F.col("vec_id") % 50 == 0, rows=64).collect()
    by = {}
    for x in got:
        by.setdefault(x["query_id"], []).append((-x["score"], x["vec_id"]))
    for q in {i for i, _ in good if i % 50 == 0}:
        vs = [v for i, v in good if i == q]
        want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for v in vs for i, w in good if i != q and len(w) == len(v))
        assert sorted(by[q]) == want[:5] if len(vs) == 1 else len(by[q]) == 5
    assert search(df.limit(0), F.lit(True)).count() == 0


def test_very_large_components(spark):
    """Scores are those of plain integers: where a component leaves 32 bits, where one leaves 64 and meets nothing, in long vectors."""
    r = random.Random(8)
    rows = [(0, [1.0, 0.0] + [1.0] * 6), (1, [2e6] + [0.0] * 7), (2, [3e6] + [0.0] * 7), (3, [-1e7] * 8), (4, [1e7] * 8), (100, [0.0, 1e300, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0]), (5, [-1e8, 0.0, 0.0, 0.25, 0.0, 0.0, 0.0, 0.0])]
    rows += [(i, [r.uniform(-1, 1) * 10 ** r.randrange(0, 7), 0.0] + [r.uniform(-1, 1) * 10 ** r.randrange(0, 7) for _ in range(6)]) for i in range(10, 60)]
    rows += [(200 + i, [0.0] * 4990 + [r.uniform(-900, 900) for _ in range(10)]) for i in range(12)] + [(250, [200.0] + [0.0] * 4999), (251, [900.0] + [0.0] * 4999)]
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    got = {}
    for x in search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 50, 200, 250), rows=20).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    for q in (0, 50, 200, 250):
        own = next(v for i, v in good if i == q)
        want = sorted(((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in good if i != q and len(v) == len(own)))
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(want[:5], 1)]
    with pytest.raises(Exception, match="64 bits"):
        search(spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 0.0])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def test_scores_that_fit_though_products_do_not(spark):
    rows = [(0, [1e15, 1.0, 2.0]), (1, [1e3, -1e18, 3.0]), (2, [0.0, 7.0, -1.5]), (3, [-1e3, 1e18, 0.0])]
    got = [(x["vec_id"], x["score"]) for x in sorted(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect(), key=lambda x: x["rank"])]
    exact = lambda v: sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, rows[0][1], strict=True))
    assert got == [(i, s) for s, i in sorted(((exact(v), i) for i, v in rows[1:]), reverse=True)[:2]]


# ---------------------------------------------------------------- chat

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False)}}


@pytest.mark.parametrize(("tool", "arguments", "want"), [
    ("add", '{"a": 1}', []), ("add", '{"b": 2.5, "a": 1}', []), ("add", '{"a": "1"}', ["type of a"]), ("add", "{}", ["missing a"]),
    ("add", '{"a": null}', ["type of a"]), ("add", '{"a": 1, "z": 2, "c": 3}', ["unexpected c", "unexpected z"]), ("sub", "{}", ["unknown tool"]),
    (None, "{}", ["unknown tool"]), ("add", "[1]", ["not an object"]), ("add", "{bad", ["not an object"]), ("add", None, ["not an object"]),
])
def test_problems(spark, tool, arguments, want):
    df = spark.createDataFrame([(tool, arguments)], "tool string, arguments string")
    assert df.select(problems(F.col("tool"), F.col("arguments"), SCHEMAS)).first()[0] == want


def test_levels(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("p", "q"), ("q", "p"), ("r", "q"), ("self", "self")] + [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    got = {r["id"]: r["level"] for r in levels(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 0, "p": -1, "q": -1, "r": -1, "self": -1, **{f"n{i}": i for i in range(40)}}


def test_link(spark):
    calls = [(1, "a", None, "add", '{"b": 2.5, "a": 1}'), (1, "b", "a", "add", "nope"), (1, "c", None, "add", '{"a": 2}'), (2, None, None, "add", '{"a": 3}'), (1, "a", None, "add", '{"b": 2.5, "a": 1}')]
    results = [("a", 2, "late"), ("a", 1, 'say "é"\n'), ("z", 1, "alone"), (None, 1, "nameless")]
    c = spark.createDataFrame([(*x, "q") for x in calls], "conv_id long, id string, parent string, tool string, arguments string, level string")
    got = link(c, spark.createDataFrame(results, "id string, seq long, content string"), SCHEMAS).collect()
    by = Counter((r["call_id"], r["status"], r["level"], r["n_results"]) for r in got)
    assert by == {("a", "ok", 0, 2): 2, ("b", "invalid", 1, 0): 1, ("c", "unanswered", 0, 0): 1, (None, "unanswered", 0, 0): 1, ("z", "orphan", None, 1): 1, (None, "orphan", None, 1): 1}
    line = next(r["json"] for r in got if r["call_id"] == "a")
    assert line == '{"arguments":{"a":1,"b":2.5},"content":"say \\"é\\"\\n","id":"a","tool":"add"}' and json.loads(line)
    assert all(json.loads(r["json"]) for r in got)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 4, None, "x"), (2, 1, "assistant", "lost"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["call_id"], r["status"]) for r in link(calls_of(df), results_of(df), CHAT_SCHEMAS).collect()}
    assert got == {("1:0", "ok"), ("1:2", "invalid"), ("1:4", "invalid"), ("2:0", "orphan"), (None, "unanswered")}
    assert link(calls_of(df.limit(0)), results_of(df.limit(0)), CHAT_SCHEMAS).count() == 0


# ---------------------------------------------------------------- toxicity, plainly


def _mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by % 2**64
    return x ^ x >> 31


def _plain_features(text):
    """The places of a text's words and word beginnings, with plain integers."""
    from ontoscore.llm.common import BASE

    out = set()
    for word in re.findall(rb"[^\x00-\x20\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x00-\x08\x0e-\x1f]+", (text or "").encode()):
        letters = [_mixed((b + 1) * BASE % 2**64) for b in word.lower()]
        summed = lambda n: sum(x * pow(BASE, i, 2**64) for i, x in enumerate(letters[:n]))
        out.add(_mixed((summed(len(word)) + len(word)) % 2**64) >> 64 - toxicity.BITS)
        out |= {_mixed((summed(n) + (n << 32)) % 2**64) >> 64 - toxicity.BITS for n in toxicity.HEADS if len(word) > n}
    return out


def test_scores_are_those_of_plain_sums(spark):
    """score() over whole texts: each word and each beginning once, their weights summed, against every threshold."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in toxicity.score(docs, model).collect():
        s = sum(model.weights[k] for k in _plain_features(texts[r["doc_id"]]))
        chances = [1 / (1 + math.exp(min(60, max(-60, t - s)))) for t in model.thresholds]
        assert (r["severity"], r["p_any"], r["p_severe"], r["toxic"]) == (pytest.approx(sum(chances), abs=1e-9), pytest.approx(chances[0], abs=1e-9), pytest.approx(chances[-1], abs=1e-9), r["toxic"])
        assert abs(chances[0] - 0.5) < 1e-9 or r["toxic"] == (chances[0] > 0.5)


def test_grades_of_any_height_are_used(spark):
    """Labels of 2 and more are severe, those below 0 are not toxic; no label is left out but null ones."""
    texts = ["plain words here"] * 40 + ["plain vile words"] * 40 + ["plain vile atrocious words"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, -1 if i < 20 else 0 if i < 40 else 1 if i < 80 else 2 + i % 3) for i in range(120)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert got[0]["severity"] < 0.3 < 0.7 < got[50]["severity"] < 1.3 < 1.7 < got[100]["severity"]
    assert not got[0]["toxic"] and got[50]["toxic"] and got[100]["toxic"]
