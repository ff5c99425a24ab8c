"""Near-duplicates, components and decontamination against brute force."""

import random

import numpy as np
import pytest

from ontoscore.llm import setsketch
from ontoscore.llm.decontam import Index, decontaminate, leaks, tiles
from ontoscore.llm.graph import components
from ontoscore.llm.setsketch import keep_one, likely, near_duplicates, registers


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def family(seed, n=90):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(120)] for _ in range(3)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "two words"), (4, "Two  words"), (5, "other pair"), (None, "two words"), (None, "lonely null id text")]
    for i in range(6, n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [rows[20], rows[20], (7, "a second text of id seven")]
    r.shuffle(rows)
    return rows


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((d, len(sets[i]), comp, d == comp))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "block"), [(1, 4000), (2, 7)])
def test_near_duplicates(spark, seed, block):
    rows = family(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = near_duplicates(df, width=4, percent=80, block=block).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 80)


def test_split_buckets_leaders_and_components(spark):
    rows = family(5, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, width=4, percent=80, block=9, part=6).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 80)


def test_a_large_family_sends_each_set_a_few_times(spark):
    """3,000 near copies of one text: one component, found by way of leaders, not by all pairs of blocks."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base[: (k := r.randrange(140))], f"x{i}", *base[k + 1 :]])) for i in range(3000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, part=200, block=400).collect()
    assert {x["component_id"] for x in got} == {0} and sum(x["n_links"] for x in got) <= 4 * len(rows)


def test_keep_one(spark):
    rows = family(3)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = keep_one(df, width=4)
    assert got.columns == df.columns
    want = {c for d, _, c, k in brute(rows, 4, 80) if k and c is not None}
    assert {r["doc_id"] for r in got.collect() if r["doc_id"] is not None} == want
    assert keep_one(df.limit(0)).count() == 0


def test_estimates_are_near_the_truth():
    r = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        n, both = 2000, int(2 * 2000 * share / (1 + share))
        x = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[n - both : n], x[n : 2 * n - both]]))
        regs = registers([a, b])
        assert abs(likely(regs[0], n, regs[1:], np.array([n]))[0] - share) < 0.16
    merged = np.maximum(*registers([a[:900], a[900:]]))
    assert (merged == registers([a])[0]).all()


def test_large_sets_are_sketched_in_parts():
    x = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64))
    small = [x[:10], x, x[10:700]]
    for got, s in zip(registers(small), small, strict=True):
        least = (setsketch.MULTIPLY[:, None] * s[None, :] + setsketch.ADD[:, None]).min(1)
        v = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64)
        assert (got == np.clip(np.floor(1 - np.log(v) / np.log(setsketch.B)), 0, setsketch.LIMIT)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 105), (200, 106), (106, 107)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 105: 105, 106: 105, 107: 105, 200: 105}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_tiles(text, item, match):
    """Greedy string tiling, straight from its definition."""
    in_text, in_item, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for t in range(len(item)):
            for p in range(len(text)):
                n = 0
                while t + n < len(item) and p + n < len(text) and item[t + n] == text[p + n] and t + n not in in_item and p + n not in in_text:
                    n += 1
                best = max(best, (n, -t, -p))
        n, t, p = best[0], -best[1], -best[2]
        if n < match:
            return out
        out.append((p, t, n))
        in_text.update(range(p, p + n))
        in_item.update(range(t, t + n))


def test_tiles_match_the_definition():
    r = random.Random(1)
    for _ in range(200):
        text, item = ([r.choice("abc") for _ in range(r.randint(0, 25))] for _ in range(2))
        seeds = [(p, t) for p in range(len(text) - 2) for t in range(len(item) - 2) if text[p : p + 3] == item[t : t + 3]]
        assert tiles(text, item, seeds, 3) == slow_tiles(text, item, 3)


def test_leaks(spark):
    first, second = "one two three four five six seven", "red green blue black white grey pink"
    bench = [(1, f"{first} {second}"), (2, None), (3, "too short"), (1, f"{first} {second}"), (None, "alpha beta gamma delta epsilon zeta eta theta")]
    docs = [
        (10, f"x {first} {second} y", 1), (11, f"{second} and then {first.upper()}", 1), (12, f"just {first}"[:30], 1), (13, None, 1), (14, "", 1),
        (15, "too short", 1), (16, f"{first} {second}" * 3 + " w" * 5000, 1), (None, f"{first} {second}", 1), (17, "alpha beta gamma delta epsilon zeta", 1),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for block in (1 << 20, 40):
        got = leaks(d, b, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"], r["n_tiles"]) for r in got} == {(10, 1, 1), (11, 1, 2), (16, 1, 1), (None, 1, 1), (17, None, 1)}
        kept = decontaminate(d, b, block_bytes=block)
        assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {12, 13, 14, 15}
    assert leaks(d.limit(0), b).count() == 0 and leaks(d, b.limit(0)).count() == 0
    assert decontaminate(d, b.limit(0)).count() == len(docs)


def test_stretches_give_the_tiles_of_all_pairs():
    r = random.Random(2)
    for n in (25, 25, 25, 60) * 40:
        letters = r.choice(["ab", "abc", "a"])
        text, item = ([r.choice(letters) for _ in range(r.randint(3, n))] for _ in range(2))
        pairs = [(p, t) for p in range(len(text) - 2) for t in range(len(item) - 2) if text[p : p + 3] == item[t : t + 3]]
        index = Index([(1, " ".join(item))], 3)
        found = [x for _, _, x in index.matches(np.frombuffer(" ".join(text).encode(), np.uint8), np.array([0, 2 * len(text) - 1]))]
        assert (found[0] if found else []) == tiles(text, item, pairs, 3)


def test_long_repeats_cost_their_stretches():
    """A text and an item that repeat one phrase thousands of times: 60,000 diagonals, not a thousand million pairs of places."""
    text, item = "red green blue " * 66_000, "red green blue " * 1_000 + "end"
    (_, _, found), = Index([(1, item)], 5).matches(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert sum(n for _, _, n in found) == 3000


def test_whole_short_items(spark):
    d = spark.createDataFrame([(1, "Yes  indeed"), (2, "yes indeed so"), (3, None), (4, "yes indeed")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "yes indeed"), (8, "other words that are long enough to seed")], "item_id long, text string")
    for block in (1 << 20, 20):
        assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in leaks(d, b, block_bytes=block, whole_short=True).collect()} == {(1, 9, 1.0), (4, 9, 1.0)}
        assert {r["doc_id"] for r in decontaminate(d, b, block_bytes=block, whole_short=True).collect()} == {2, 3}
    assert leaks(d, b).count() == 0


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements: equal modulo 2**64 for any odd base, but not to the hash of words."""
    import numpy as np

    from ontoscore.llm.common import word_ids
    from ontoscore.llm.lm import score
    from ontoscore.llm.setsketch import near_duplicates

    morse = lambda n: "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    texts = [t for n in (256, 1024, 4096, 8192) for t in (morse(n), morse(n).translate(str.maketrans("ab", "ba")))]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs, width=4, percent=80).collect()} == {(i, i, True) for i in range(len(texts))}
    known = {r["doc_id"]: (r["held_out"], r["n_known"]) for r in score(docs).collect()}
    assert all(n == (1 if held else 2) for held, n in known.values()) and any(held for held, _ in known.values())
    every = sorted({f"{a}{b}{'x' * k}" for a in "abABé" for b in ("", "q", "qqqqqqqq") for k in range(30)})
    data = np.frombuffer(" ".join(every).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in every]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    assert len(set(word_ids(data, starts, ends, False).tolist())) == len(every)
    assert len(set(word_ids(data, starts, ends, True).tolist())) == len({w.lower() for w in every})


def test_items_that_seeds_cannot_cover_are_not_tiled(monkeypatch):
    """A phrase in all items makes no work for each; what is left out could not have reached the coverage."""
    import time

    from ontoscore.llm import decontam

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    phrase = "which of the following is"
    items = [(i, " ".join([word() for _ in range(8)] + [phrase] + [word() for _ in range(r.randint(0, 30))])) for i in range(4000)]
    index = Index(items, 5)
    text = " ".join([word() for _ in range(200)] + [phrase] + [word() for _ in range(200)] + [items[7][1]])
    data = np.frombuffer(text.encode(), np.uint8)
    tiled, plain = [], decontam.tiled
    monkeypatch.setattr(decontam, "tiled", lambda *x: tiled.append(1) or plain(*x))
    start = time.perf_counter()
    found = {(i, sum(t[2] for t in got)) for _, i, got in index.matches(data, np.array([0, len(data)]), 0.5)}
    assert time.perf_counter() - start < 0.5 and len(tiled) < 10
    assert (7, len(items[7][1].split())) in found
    # every item that tiles cover by half or more is among them
    few = Index(items[:300], 5)
    every = {(i, sum(t[2] for t in got)) for _, i, got in few.matches(data, np.array([0, len(data)]))}
    reached = lambda rows: {(i, n) for i, n in rows if n >= 0.5 * len(items[i][1].split())}
    assert len(every) == 300 and reached(every) == reached({x for x in found if x[0] < 300})


@pytest.mark.parametrize("coverage", [0.0, 0.3, 0.5, 1.0])
def test_coverable_items_are_bounded_by_their_seeds(coverage):
    r = random.Random(8)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 20)))) for i in range(80)]
    index = Index(items, 3)
    for _ in range(60):
        text = [r.choice("abc") for _ in range(r.randint(3, 9))]
        seeds = {tuple(text[i : i + 3]) for i in range(len(text) - 2)}
        want = []
        for i, (_, t) in enumerate(items):
            w = t.split()
            covered = {j + k for j in range(len(w) - 2) if tuple(w[j : j + 3]) in seeds for k in range(3)}
            if covered and len(covered) >= coverage * len(w):
                want.append(i)
        one = Index([(0, " ".join(text))], 3)
        assert index.coverable(np.unique(one.grams[np.isin(one.grams, index.grams)]), coverage).tolist() == want if want or seeds else True
