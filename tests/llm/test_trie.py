"""The prefix trie against a plain trie in memory."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from ontoscore.llm import queries, trie


def plain(rows):
    """rows: conv_id, turn, role, text. Nodes as prefix_trie() gives them, from a dictionary of whole prefixes."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, at = defaultdict(list), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        at[c] = turns.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + turns[c][h:]
        for d in range(len(at[c]) + 1):
            members[tuple(at[c][:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ended = ",".join(str(c) for c in sorted(m) if len(at[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, node int, n string")
    return sorted(map(tuple, trie.prefix_trie(df).collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_prefix_trie(spark, path)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[:2]) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed, monkeypatch):
    """Nulls, ties, repeated rows, ids without a first conversation, turnless conversations, deep copies; small bounds, so that every join is split."""
    pick = random.Random(seed)
    monkeypatch.setattr(trie, "MEMBERS", 3)
    monkeypatch.setattr(trie, "TURNS", 4)
    monkeypatch.setattr(trie, "RUN", 2)
    texts = ["", None, "a", "b", "h\u00e9llo \U0001f600", "a" * 50]
    rows = []
    for c in pick.sample(range(0, 700), 40):
        rows += [(c, t if t or seed != 1 else None, pick.choice(["user", "assistant", None, ""]) if pick.random() < 0.3 else "user", pick.choice(texts) if pick.random() < 0.3 else "a") for t in range(pick.randrange(1, 9))]
    rows += [(900, t, "user", "x") for t in range(1, 4)] + [(-250, 0, "user", "a"), (-200, 0, "user", "b"), (None, 0, "user", "a"), (901, None, None, None)]
    rows += [(c, t, "user", f"long {t // 7}") for c in (1000, 1001, 1002, 1105) for t in range(30)] + [(1106, 3, "user", "a")] * 3 + [(1107, 2, r, x) for r in ("b", "a") for x in ("y", "x")]
    assert found(spark, rows) == plain(rows)


def test_nested_and_alone(spark):
    """Conversations that are prefixes of one another, one that is alone, and no conversation at all."""
    nested = [(c, t, "user", "same") for c in range(2000, 2006) for t in range(c - 1990)]
    assert found(spark, nested) == plain(nested)
    assert found(spark, nested[:3]) == plain(nested[:3])
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "a")]) == []


def test_many_ends(spark, monkeypatch):
    """One node in which all conversations end, its ids in many runs."""
    monkeypatch.setattr(trie, "RUN", 4)
    rows = [(c, t, "user", "copy") for c in range(500) for t in range(2)]
    assert found(spark, rows) == plain(rows)
