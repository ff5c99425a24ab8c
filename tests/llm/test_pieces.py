"""Piece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ontoscore.llm import pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
OURS = pieces.Pieces(open(MODEL, "rb").read())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
NAMES = sorted(OURS.ids)


def test_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(r["text"] or "")
        joined = ",".join(map(str, ids))
        want.append((r["doc_id"], len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, queries.op11_sentencepiece(spark, sf).collect())) == sorted(want)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("ab \u2581\r{};th", max_size=60), st.lists(st.sampled_from(NAMES), max_size=12).map("".join)))
def test_any_text(text):
    ids = LIBRARY.encode(text)
    assert OURS.encode(text).tolist() == ids
    assert OURS.decode(np.array(ids, np.int32), np.array([0, len(ids)]))[0].as_py() == LIBRARY.decode(ids)


def test_any_ids():
    pick = random.Random(5)
    for _ in range(3000):
        ids = [pick.choice([pick.randrange(32000), pick.randrange(3, 259), pick.randrange(4)]) for _ in range(pick.randrange(9))]
        want = LIBRARY.decode(ids)
        assert OURS.decode_one(ids) == want
        assert OURS.decode(np.array(ids, np.int32), np.array([0, len(ids)]))[0].as_py() == want


def test_pieces_that_give_way():
    """Texts whose longest pieces do not go together, so that places are marked and left backwards."""
    marked = 0
    for text in ("therere", "ationss", "eses" * 30, "ingthe" * 20, "=-=-=" * 40, "      x" * 9, "aaaaaaaaaaaaa"):
        whole = pieces.SPACE + text.replace(" ", pieces.SPACE)
        longest = pieces.Longest(OURS, whole)
        first, at = [], 0
        while at < len(whole):
            token = longest.get(at)
            token = OURS.token(whole[at]) if token is None else token
            first.append(token)
            at += OURS.sizes[token] if token >= 0 else 1
        got = [t for t in OURS.walk(whole, 0, len(whole), longest.get)]
        marked += got != first
        assert [t for t in got if t >= 0] == LIBRARY.encode(text)
    assert marked


def test_slices(monkeypatch):
    """Long texts, parts longer than a slice, and a memory that forgets."""
    monkeypatch.setattr(pieces, "SLICE", 50)
    monkeypatch.setattr(pieces, "PARTS", 20)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    ours = pieces.Pieces(open(MODEL, "rb").read())
    texts = ["the quick brown fox " * 30, "q" * 333 + "thequick" * 40, "", None, "x", " " * 200, "h\u00e9llo \u65e5\u672c \U0001f600" * 20]
    got = [ids[i:j].tolist() for ids, o in ours.encode_all(texts) for i, j in zip(o[:-1], o[1:], strict=True)]
    assert got == [LIBRARY.encode(t or "") for t in texts]


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "x" * 100000)]
    docs = spark.createDataFrame([(k, t, 7, "n") for k, t in rows], "doc_id long, text string, ids int, decoded string")
    found = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    assert sorted(((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in found)) == sorted((k or 0, LIBRARY.encode(t or ""), t or "") for k, t in rows)
    assert pieces.digests(docs.limit(0), MODEL).collect() == []
    assert [r["n_tokens"] for r in pieces.digests(docs.where("doc_id = 1"), MODEL).collect()] == [0]


def test_other_models_are_refused():
    data = open(MODEL, "rb").read()
    at = data.index(b"identity")
    with pytest.raises(ValueError):
        pieces.Pieces(data[: at - 4] + b"\x1a\x02\x20\x01")
