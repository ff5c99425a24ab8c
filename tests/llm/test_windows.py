"""Suffix-array deduplication and relative Lempel-Ziv parsing against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ontoscore.llm import rlz, suffix_dedup, windows
from ontoscore.llm.rlz import parse_group, remove_passages
from ontoscore.llm.suffix_dedup import remove_repeats, repeats

SCHEMA = "doc_id long, text string, id long, seg string, spans string"


def texts(seed):
    """Copies, shared passages with different surroundings, runs of one byte, empty and null texts, repeated and null ids."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 3)))
    passage = " ".join(word() for _ in range(30))
    rows = [(0, None), (1, ""), (2, "z" * 90), (3, "z" * 70), (None, passage), (4, "abc " * 30), (5, "abc " * 30)]
    for i in range(6, 30):
        body = " ".join(word() for _ in range(r.randint(0, 40)))
        rows.append((i, f"{body} {passage} {word()}" if i % 3 == 0 else body))
    rows += [(6, rows[13][1]), (29, rows[-1][1]), (29, rows[-1][1])]
    r.shuffle(rows)
    return rows


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = set()
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_words(rows, window):
    big = 2**63 - 1
    docs = [(big if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, big), d)
    out = []
    for (d, w), (own, _) in zip(docs, rows, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def table(spark, rows):
    return spark.createDataFrame([(d, t, 7, "x", None) for d, t in rows], SCHEMA)


@pytest.mark.parametrize(("seed", "length", "hot"), [(1, 24, None), (2, 40, 2)])
def test_bytes(spark, monkeypatch, seed, length, hot):
    if hot:
        monkeypatch.setattr(windows, "HOT", hot)
    rows = texts(seed)
    got = remove_repeats(table(spark, rows), length=length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_bytes(rows, length)


@pytest.mark.parametrize(("seed", "window", "hot"), [(3, 8, None), (4, 12, 2)])
def test_words(spark, monkeypatch, seed, window, hot):
    if hot:
        monkeypatch.setattr(windows, "HOT", hot)
    rows = texts(seed)
    got = remove_passages(table(spark, rows), window=window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_words(rows, window)


def test_empty_table_and_kept_text(spark):
    assert remove_repeats(table(spark, [])).count() == 0
    assert remove_passages(table(spark, [])).count() == 0
    rows = [(1, "ab" * 300 + "x"), (2, "ab" * 300 + "y")]
    got = remove_repeats(table(spark, rows), with_text=True, with_rest=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == ["x", "y"] and got[0]["rest"]["id"] == 7
    assert got[0]["spans"][0].asDict() == {"start": 0, "length": 600}


@pytest.mark.parametrize("seed", [6, 7])
def test_hot_windows_meet_whatever_run_they_are_in(spark, monkeypatch, seed):
    """A line stands twice shortly before a shared passage in some documents, so its anchors stand at several places there."""
    monkeypatch.setattr(windows, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "BATCH", 0)  # groups are sorted one by one
    monkeypatch.setattr(suffix_dedup, "GRAM", 8)
    monkeypatch.setattr(rlz, "GRAM", 3)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for p in range(6):
        line = [word() for _ in range(5)]
        passage = line + [word() for _ in range(25)]
        for i in range(5):
            before = [word() for _ in range(6)] + (line + [word() for _ in range(r.randint(0, 2))]) * (i % 3)
            rows.append((10 * p + i, " ".join(before + passage + [word() for _ in range(6)])))
    r.shuffle(rows)
    got = remove_repeats(table(spark, rows), length=60).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(x) for x in got.collect()) == brute_bytes(rows, 60)
    got = remove_passages(table(spark, rows), window=12).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(x) for x in got.collect()) == brute_words(rows, 12)


def test_only_null_and_empty_texts_in_a_partition(spark):
    rows = [(1, None), (2, ""), (3, None), (4, "")]
    got = remove_repeats(table(spark, rows).coalesce(1), length=40).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_bytes(rows, 40)
    rows += [(5, " \t "), (6, "\n")]
    got = remove_passages(table(spark, rows).coalesce(1), window=8).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_words(rows, 8)


def test_long_texts_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(windows, "PART", 300)
    monkeypatch.setattr(windows, "MOST", 50)
    r = random.Random(5)
    a = "".join(r.choice("abcdefgh ") for _ in range(2000))
    rows = [(1, a), (2, a[900:1600] + "q"), (3, "z" * 700)]
    unit = windows.Unit("byte", 100, 32)
    import numpy as np

    from ontoscore.llm.common import BYTE

    values = BYTE[np.frombuffer(a.encode(), np.uint8)]
    row, s0, n, *_ = windows.runs_of(values, np.array([0, len(values)]), unit)
    assert sorted(x for s, m in zip(s0, n, strict=True) for x in range(s, s + m)) == list(range(len(values) - 99))
    monkeypatch.undo()
    got = remove_repeats(table(spark, rows), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_bytes(rows, 100)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab\x00c", max_size=30), min_size=1, max_size=5), st.integers(1, 6))
def test_suffix_order_finds_all_repeats(segs, length):
    data = [s.encode() + b"a" * length for s in segs]
    starts = [len(d) - length + 1 for d in data]
    count = Counter(d[i : i + length] for d, n in zip(data, starts, strict=True) for i in range(n))
    want = [{i for i in range(n) if count[d[i : i + length]] > 1} for d, n in zip(data, starts, strict=True)]
    assert [{i for a, m in spans for i in range(a, a + m)} for spans in repeats(data, starts, length)] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.lists(st.sampled_from("abc"), min_size=3, max_size=20)), min_size=1, max_size=6))
def test_factors_cover_what_earlier_segments_hold(docs):
    window = 3
    group = [{"g": 0, "fp": i, "id": d, "n": len(w) - window + 1, "seg": " ".join(w).encode()} for i, (d, w) in enumerate(docs)]
    got = parse_group(group, window)
    for (d, w), spans in zip(docs, got, strict=True):
        earlier = {tuple(x[i : i + window]) for e, x in docs if e < d for i in range(len(x) - window + 1)}
        want = {i for i in range(len(w) - window + 1) if tuple(w[i : i + window]) in earlier}
        assert {i for a, m in spans for i in range(a, a + m)} == want


@given(st.lists(st.text(alphabet="ab\x00", max_size=60), min_size=1, max_size=6), st.sampled_from([1, 7, 16, 17, 40]), st.sampled_from([2, 4096]))
@settings(max_examples=80, deadline=None)
def test_sorting_and_common_prefixes(parts, depth, ties):
    data = "ab".join(parts).encode() * 2
    before, suffix_dedup.TIES = suffix_dedup.TIES, ties
    try:
        eight = suffix_dedup.words_at(data)
        order = suffix_dedup.sort_places(data, eight, np.arange(len(data)), depth)
    finally:
        suffix_dedup.TIES = before
    assert sorted(order.tolist()) == list(range(len(data)))
    padded = data + bytes(64)
    keys = [padded[p : p + depth] for p in order]
    assert keys == sorted(keys)
    places = np.array([p for p in order.tolist() if p + depth <= len(data)], np.int64)
    if len(places) > 1:
        got = suffix_dedup.common_prefixes(suffix_dedup.words_at(padded), places, depth)
        for p, q, n in zip(places[:-1].tolist(), places[1:].tolist(), got.tolist(), strict=True):
            assert n == next((i for i in range(depth) if padded[p + i] != padded[q + i]), depth)


@pytest.mark.parametrize("units", [1, 200])
def test_anchors_with_many_bytes_are_cut(spark, monkeypatch, units):
    monkeypatch.setattr(windows, "HOT_UNITS", units)
    rows = texts(9)
    got = remove_repeats(table(spark, rows), length=30).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_bytes(rows, 30)
    got = remove_passages(table(spark, rows), window=9).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_words(rows, 9)


@pytest.mark.parametrize("seed", [11, 12])
def test_crowded_groups_part_into_windows(spark, monkeypatch, seed):
    """One passage between texts that all differ: pieces on its edges are as many as documents, and meet window by window."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(16))
    rows = [(i if i % 7 else None, " ".join([word() for _ in range(9)]) + f" {passage} " + " ".join(word() for _ in range(9))) for i in range(60)]
    rows += [(100 + i, f"{'ab' * 40} {r.choice('xyz')} {passage} {'ab' * 40}") for i in range(20)] + [rows[5], (200, None), (201, "")]
    r.shuffle(rows)
    made = []
    plain = windows.parted
    monkeypatch.setattr(windows, "parted", lambda *x: made.append(plain(*x)) or made[-1])
    monkeypatch.setattr(windows, "HOT", 3)
    monkeypatch.setattr(windows, "SALTS", 3)
    for crowded, sent in ((2, 1 << 20), (0, 0)):
        monkeypatch.setattr(windows, "CROWDED", crowded)
        monkeypatch.setattr(windows, "SENT", sent)
        got = remove_repeats(table(spark, rows), length=30).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert Counter(tuple(x) for x in got.collect()) == brute_bytes(rows, 30)
        got = remove_passages(table(spark, rows), window=9).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert Counter(tuple(x) for x in got.collect()) == brute_words(rows, 9)
    assert len(made) == 4
