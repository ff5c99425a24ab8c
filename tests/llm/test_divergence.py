"""The divergence audit against plain counting in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ontoscore.llm import divergence, queries


def plain(rows, least=30):
    """rows: text, lang, source."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        found = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text)
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def p(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, ps = p(whole), {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[t] - ps[s][t], t.encode()) for t in kept if counts[lang, s][t] and ps[s][t] > q[t])[:50]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, least=30):
    df = spark.createDataFrame([(*r, 1, "i") for r in rows], "text string, lang string, source string, i int, term string")
    return sorted(map(tuple, divergence.divergence(df, least).collect()))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()]
    got = queries.op13_divergence(spark, sf)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


@pytest.mark.parametrize("bounds", [{}, {"CELLS": 12, "SLICE": 7, "HELD": 3}, {"WIDTH": 1, "SLICE": 1}])
def test_small_tables(spark, monkeypatch, bounds):
    """Nulls, ties, repeated rows, sources without terms, languages without kept terms, one source alone; chunks of few terms and slices of few bytes."""
    for k, v in bounds.items():
        monkeypatch.setattr(divergence, k, v)
    pick = random.Random(3)
    words = ["a", "A", "b", "Zz", "\u00dcber", "\u00fcber", "\u65e5\u672c", "\U0001f600", "x1y", "it's", "\u00a0"]
    rows = [(" ".join(pick.choices(words, k=pick.randrange(12))), pick.choice(["en", "de", None]), pick.choice(["s1", "s2", "s3", "\u00e4", None])) for _ in range(60)]
    rows += [(None, "en", "silent"), ("", "fr", "only"), ("b b b", "en", "s1"), ("b b b", "en", "s1"), ("unique", "es", "s1"), ("other", "es", "s2"), ("12 34", "es", "s3")]
    assert found(spark, rows, 3) == plain(rows, 3)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_shares_are_exact():
    big = np.array([2**62, 9_223_372_036, 9_223_372_032, 0], np.int64)
    assert divergence.shares(big, int(2**62), 10).tolist() == [1 + 10**9 * (int(c) + 5) // (2**62 + 50) for c in big]
