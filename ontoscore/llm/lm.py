"""Language-model scores by deleted interpolation.

Tokens are words and one end. The maximum-likelihood estimates c(uvw) / c(uv) and c(vw) / c(v) are mixed in turn, the trigram's with the
mixture of the bigram's and a smoothed unigram. A mixture weight depends on how often its context was seen (buckets by powers of two)
and is learned by expectation-maximisation on held-out counts: n-grams are counted on training folds but one, the weights are fitted to
the tokens of that one, order by order, then all training counts are used.

Texts lie in blocks, those of the tuning fold in blocks of their own. A block asks for the counts of its distinct n-grams, sorted hashes
packed by part of the hash range; a part adds up what all blocks sent and answers in the same order, so answers carry counts alone.
Memory is bounded by a block and a part, and hot n-grams are one entry in each block.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoscore.llm.common import flat_schema, materialise, mix, text_buffer, words

#: Bytes of text in a block, n-grams in a part.
BLOCK_BYTES, PART_KEYS = 6 << 20, 3 << 18
FOLDS, HELD_OUT, TUNING = 5, 1, 0
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ORDER = 3
BUCKETS, BINS = 40, 128


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with START before and END after each row, and the rows' offsets in them."""
    data, offsets = text_buffer(text)
    _, _, h, first = words(data, offsets, fold=True, strong=True)
    sizes = np.diff(first) + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.uint64)
    out[at[:-1]] = START
    out[at[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = h
    return out, at


def grams(t: np.ndarray, at: np.ndarray, order: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each level n: which tokens have n - 1 before them in their row, and these n-grams' hashes (level 1: the tokens; else `bits` bits)."""
    place = np.arange(len(t)) - np.repeat(at[:-1], np.diff(at))
    h = t
    for n in range(1, order + 1):
        if n > 1:
            h = np.append(t[:1], mix(t[1:] * np.uint64(0x9E3779B97F4A7C15) + mix(h[:-1])))
        has = place >= n - 1
        yield n, has, t if n == 1 else h[has] >> np.uint64(64 - bits)


def pack(values: np.ndarray) -> bytes:
    """How many numbers, then planes of their bytes: random low ones, compressible high ones."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    planes = pa.decompress(memoryview(data)[8:], 8 * int.from_bytes(data[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


#: counts: of a tuning block all its tokens, of another one those that are not held out; kept (without the tuning fold) answers tuning blocks.
ASKED = "level int, part long, block long, tuning boolean, keys binary, counts binary"
ANSWER = "level int, part long, block long, kept binary, every binary, types long, total long, kept_types long, kept_total long"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kind = flat_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kind]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def _asks(order: int, part_bits: int, bits: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        t, at = tokens(_column(block, "text"))
        fold = block.column("fold").to_numpy()
        seen = np.repeat(fold != HELD_OUT, np.diff(at))
        name, tuning, rows = block.column("block")[0].as_py(), bool(fold[0] == TUNING), []
        for level, has, keys in grams(t, at, order, bits):
            unique, inverse = np.unique(keys, return_inverse=True)
            counts = np.bincount(inverse[seen[has]], minlength=len(unique))
            width = 64 if level == 1 else bits
            part = (unique >> np.uint64(width - part_bits)).astype(np.int64) if part_bits else np.zeros(len(unique), np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(unique)]]) if len(unique) else [0]
            for i, j in itertools.pairwise(map(int, cuts)):
                rows.append((level, int(part[i]), name, tuning, pack(np.diff(unique[i:j], prepend=np.uint64(0))), pack(counts[i:j])))
        return _table(ASKED, rows)

    return run


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _answers(part: pa.Table) -> pa.Table:
    rows = part.to_pylist()
    keys = [np.cumsum(unpack(r["keys"]), dtype=np.uint64) for r in rows]
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    cuts = np.cumsum([0, *map(len, keys)])
    kept, every = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
    for r, i, j in zip(rows, cuts[:-1], cuts[1:], strict=True):  # a block's keys are distinct
        counts = unpack(r["counts"]).astype(np.int64)
        every[inverse[i:j]] += counts
        if not r["tuning"]:
            kept[inverse[i:j]] += counts
    word = unique != START if rows[0]["level"] == 1 else np.ones(len(unique), bool)
    sums = tuple(int(x) for x in ((every[word] > 0).sum(), every[word].sum(), (kept[word] > 0).sum(), kept[word].sum()))
    out = []
    for r, i, j in zip(rows, cuts[:-1], cuts[1:], strict=True):
        at = inverse[i:j]
        out.append((r["level"], r["part"], r["block"], pack(kept[at]) if r["tuning"] else None, pack(every[at]), *(sums if not out else (0, 0, 0, 0))))
    return _table(ANSWER, out)


Counted = tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]


def _counts(block: pa.Table, answers: pa.Table, which: str, order: int, bits: int) -> Counted:
    """Of each predicted token its own count, and of each level from 2 its context's count and the n-gram's (0 where too few tokens
    stand before it); and where each row begins among the tokens."""
    t, at = tokens(_column(block, "text"))
    rows = sorted(answers.select(["level", "part", which]).to_pylist(), key=lambda r: (r["level"], r["part"]))
    later, own, pairs, shorter = None, None, [], None
    for level, has, keys in grams(t, at, order, bits):
        unique, inverse = np.unique(keys, return_inverse=True)
        counts = [unpack(r[which]) for r in rows if r["level"] == level]
        counts = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        if len(counts) != len(unique):
            raise ValueError(f"{len(unique)} n-grams asked, {len(counts)} answered")
        full = np.zeros(len(t), np.int64)
        full[has] = counts[inverse]
        if level == 1:
            later = np.ones(len(t), bool)
            later[at[:-1]] = False
            own = full[later]
        else:
            context = np.append(0, shorter[:-1])
            context[~has] = 0
            pairs.append((context[later], full[later]))
        shorter = full
    return own, pairs, at - np.arange(len(at))


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def smoothed(own: np.ndarray, total: int, types: int) -> np.ndarray:
    return (own + 0.5) / (total + 0.5 * (types + 1))


def likelihood(context: np.ndarray, both: np.ndarray) -> np.ndarray:
    return np.divide(both, context, out=np.zeros(len(both)), where=context > 0)


def mixed(base: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray]) -> np.ndarray:
    """Probability of each token: the estimate of each level in turn mixed with that of the levels below."""
    p = base
    for (context, both), w in zip(pairs, weights, strict=True):
        x = w[bucket(context)] * (context > 0)
        p = x * likelihood(context, both) + (1 - x) * p
    return p


def _ratios(level: int, weights: list[np.ndarray], total: int, types: int, bits: int):
    """Histogram of a tuning block's tokens by bucket and by the ratio of the level's estimate to the mixture below (bin 0: no such n-gram)."""

    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows or not answers.num_rows:
            return _table("bucket int, bin int, n long, ratio double", [])
        own, pairs, _ = _counts(block.combine_chunks(), answers, "kept", level, bits)
        ratio = likelihood(*pairs[-1]) / mixed(smoothed(own, total, types), pairs[:-1], weights)
        bins = np.where(ratio > 0, 1 + np.clip((2 * np.log2(np.maximum(ratio, 1e-9)) + 20).astype(np.int64), 0, BINS - 2), 0)
        cell, inverse = np.unique(bucket(pairs[-1][0]) * BINS + bins, return_inverse=True)
        n, sums = np.bincount(inverse), np.bincount(inverse, ratio)
        return _table("bucket int, bin int, n long, ratio double", list(zip((cell // BINS).tolist(), (cell % BINS).tolist(), n.tolist(), sums.tolist(), strict=True)))

    return run


def learn(cells: list[tuple[int, int, int, float]], rounds: int = 100) -> np.ndarray:
    """Mixture weight of a level by bucket: EM on (bucket, bin, tokens, sum of ratios). A bucket without tokens takes the weight of the one below."""
    weights = np.zeros(BUCKETS)
    for b in range(BUCKETS):
        own = [(n, s / n) for k, _, n, s in cells if k == b and n]
        if not own or b == 0:
            weights[b] = weights[b - 1] if b else 0.0
            continue
        n, r = (np.array(x, float) for x in zip(*own, strict=True))
        x = 0.5
        for _ in range(rounds):
            x = float((n * (x * r / (x * r + 1 - x))).sum() / n.sum())
        weights[b] = min(max(x, 1e-6), 1 - 1e-6)
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(order: int, weights: list[np.ndarray], total: int, types: int, bits: int):
    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _table(SCORED, [])
        block = block.combine_chunks()
        own, pairs, begin = _counts(block, answers, "every", order, bits)
        base = smoothed(own, total, types)
        cut = begin[:-1]
        sums = [np.add.reduceat(x, cut) for x in ((own > 0).astype(np.int64), np.log10(base), np.log10(mixed(base, pairs, weights)))]
        fold = block.column("fold").to_numpy() == HELD_OUT
        return _table(SCORED, list(zip(block.column("doc_id").to_pylist(), fold.tolist(), np.diff(begin).tolist(), sums[0].tolist(), [total] * len(cut), sums[1].tolist(), sums[2].tolist(), strict=True)))

    return run


def fold_of(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS, order: int = ORDER) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of the text's probability).

    Rows of fold 1 (crc32 of the id as text, modulo 5) are held out; fold 0 of the training rows tunes the mixture of n-grams up to
    `order`. A null text has its end only; a null id counts as the empty text. Repeated rows are counted each. Without training rows all
    counts are 0. A very long text is a block of its own size. An empty table gives an empty result; other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = plain.withColumn("fold", fold_of(F.col("doc_id")))
    tuning, row_size = F.col("fold") == TUNING, F.octet_length("text") + 1
    tuned, rest = (x or 0 for x in plain.agg(F.sum(F.when(tuning, row_size)), F.sum(F.when(~tuning, row_size))).first())
    blocks, tuned_blocks = (max(1, -(-x // block_bytes)) for x in (rest, tuned))
    size = tuned + rest
    part_bits = max(0, math.ceil(math.log2(max(1, size / 6 / part_keys))))
    bits = min(64, max(48, math.ceil(math.log2(max(2, size / 6))) + 20))
    # a long text is no reason to part a block: one row is the least that a block holds
    name = F.xxhash64("doc_id", "text")
    block = F.when(tuning, blocks + F.pmod(name, F.lit(tuned_blocks))).otherwise(F.pmod(name, F.lit(blocks)))
    plain = plain.select("doc_id", "text", "fold", block.alias("block"))
    asked = plain.groupBy("block").applyInArrow(_asks(order, part_bits, bits), ASKED)
    answers = materialise(asked.groupBy("level", "part").applyInArrow(_answers, ANSWER), "counts")
    sums = answers.where("level = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "total", "kept_types", "kept_total")]).first()
    own, weights = plain.where(F.col("fold") == TUNING), []
    for level in range(2, order + 1):
        kept = answers.where(F.col("kept").isNotNull() & (F.col("level") <= level)).select("block", "level", "part", "kept")
        cells = own.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(_ratios(level, weights, sums[3], sums[2], bits), "bucket int, bin int, n long, ratio double")
        cells = cells.groupBy("bucket", "bin").agg(F.sum("n"), F.sum("ratio")).collect()  # at most BUCKETS * BINS
        weights = [*weights, learn([tuple(r) for r in cells])]
    every = answers.select("block", "level", "part", "every")
    return plain.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_scores(order, weights, sums[1], sums[0], bits), SCORED)
