"""Exact top-k inner products on a bit-sliced index.

Rows are dealt to blocks. In a block, bit b of attribute d of all rows is one bitmap (a slice); attributes are integers that are
shifted to be non-negative and quantised by dropping low bits. For a query, slices are added as its weights ask for: carry-save
adders on bitmaps, shifted by the bits of each weight. The sum's slices are then read from the most significant one downward,
which leaves the rows with the k largest sums. What quantising can hide is bounded, so rows whose sum comes within that bound of
the k-th are kept too and resolved by exact products. Every query meets every block; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 256
K = 5
#: Low bits that the index leaves out.
DROPPED = 2
#: Most slices of an attribute; what lies below is left out, too.
BITS = 20
#: Rows of a block. Queries pass by it in Arrow batches, so memory is bounded by a block.
ROWS = 16384


def components(col: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) / scale of each component as double; null where the vector is null or empty or holds a null or non-finite component.

    The scale is a power of two, so that the quotient is exact; doubles of 2**45 and more are multiples of 1 / scale already.
    """
    if scale < 1 or scale > 256 or scale & (scale - 1):
        raise ValueError("scale must be a power of two up to 256")
    d = F.transform(col, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(F.abs(x) < 2.0**45, F.floor(x * float(scale)).cast("double") / float(scale)).otherwise(x)
    return F.when(F.coalesce(F.size(col), F.lit(0)) > 0, F.when(~F.coalesce(bad, F.lit(True)), F.transform(d, whole)))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """scale * x of components(): 64-bit integers where they all have under 62 bits, else Python's integers, which have no bound."""
    if not x.size or np.abs(x).max() < 2.0**61 / scale:
        return (x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 2.0**45 else int(v * scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products without overflow: of 64-bit integers where no sum can leave them, else of Python's."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    most = sum(abs(int(q)) * max(abs(int(lo)), abs(int(hi))) for q, lo, hi in zip(query.tolist(), vectors.min(axis=0).tolist(), vectors.max(axis=0).tolist(), strict=True))
    if most < 2**63 and vectors.dtype != object and query.dtype != object:
        return vectors @ query
    return np.array([sum(a * b for a, b in zip(v, query.tolist(), strict=True)) for v in vectors.tolist()], object)


def add(columns: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Slices of the sum of bitmaps: columns[i] holds those of weight 2**i. Full adders take three bitmaps of a weight to two."""
    out, i = [], 0
    columns = [list(c) for c in columns]
    while i < len(columns):
        c = columns[i]
        if len(c) > 1 and i + 1 == len(columns):
            columns.append([])
        while len(c) >= 3:
            a, b, d = c.pop(), c.pop(), c.pop()
            x = a ^ b
            c.insert(0, x ^ d)
            columns[i + 1].append((a & b) | (x & d))
        if len(c) == 2:
            a, b = c
            columns[i + 1].append(a & b)
            c[:] = [a ^ b]
        out.append(c[0] if c else np.zeros(words, np.uint64))
        i += 1
    return out


def top(slices: list[np.ndarray], valid: np.ndarray, k: int, slack: int) -> np.ndarray:
    """Bitmap of the rows whose value is at least that of the k-th largest less `slack`."""
    sure, maybe, kth = np.zeros_like(valid), valid.copy(), 0
    count = lambda b: int(np.bitwise_count(b).sum())
    if count(valid) <= k:
        return valid
    for i in range(len(slices) - 1, -1, -1):
        x = sure | (maybe & slices[i])
        if count(x) >= k:
            maybe &= slices[i]
            kth |= 1 << i
        else:
            sure = x
            maybe &= ~slices[i]
    low = max(0, kth - slack)
    above, equal = np.zeros_like(valid), valid.copy()  # rows > low, = low, from the top slice down
    for i in range(len(slices) - 1, -1, -1):
        if low >> i & 1:
            equal &= slices[i]
        else:
            above |= equal & slices[i]
            equal &= ~slices[i]
    return above | equal


class Block:
    """The bit-sliced index of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dropped: int = DROPPED):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, self.dims = vectors.shape
        self.words = -(-n // 64)
        base = self.vectors.min(axis=0)
        spans = [int(hi) - int(lo) for lo, hi in zip(base.tolist(), self.vectors.max(axis=0).tolist(), strict=True)]
        # wide attributes lose more low bits, so that none has more than BITS slices
        self.dropped = [max(dropped, x.bit_length() - BITS) for x in spans]
        self.low = min(self.dropped, default=dropped)
        shifted = np.stack([((self.vectors[:, d] - base[d]) >> self.dropped[d]).astype(np.uint64) for d in range(self.dims)], axis=1)
        self.bits = [x >> k for x, k in zip(spans, self.dropped, strict=True)]
        self.bits = [x.bit_length() for x in self.bits]
        pad = np.zeros((self.words * 64, self.dims), np.uint64)
        pad[:n] = shifted
        self.slices = [[self._bitmap(pad[:, d] >> np.uint64(b) & np.uint64(1)) for b in range(self.bits[d])] for d in range(self.dims)]
        valid = np.zeros(self.words * 64, np.uint64)
        valid[:n] = 1
        self.valid = self._bitmap(valid)

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)

    def search(self, query: np.ndarray, own: int | None, k: int = K) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but those with id `own`, best first, ties to smaller ids."""
        columns: list[list[np.ndarray]] = [[]]
        slack = 0
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            slack += abs(q) * ((1 << self.dropped[d]) - 1)
            weight = abs(q) << (self.dropped[d] - self.low)
            for b, s in enumerate(self.slices[d]):
                if q < 0:  # -|q| u = |q| (most - u) - |q| most: the complement is added
                    s = ~s
                for w in range(weight.bit_length()):
                    if weight >> w & 1:
                        while len(columns) <= b + w:
                            columns.append([])
                        columns[b + w].append(s)
        slices = add(columns, self.words)
        valid = self.valid
        if own is not None:
            lo, hi = np.searchsorted(self.ids, [own, own + 1])
            if hi > lo:
                valid = valid.copy()
                for r in range(lo, hi):
                    valid[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        left = top(slices, valid, k, -(-slack // (1 << self.low)) + 1)
        rows = np.flatnonzero(np.unpackbits(left.view(np.uint8), bitorder="little"))
        scores = products(self.vectors[rows], query)
        best = sorted(zip((-scores).tolist(), self.ids[rows].tolist(), strict=True))[:k] if scores.dtype == object else None
        if best is not None:
            return [(-a, b) for a, b in best]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return list(zip(scores[best].tolist(), self.ids[rows][best].tolist(), strict=True))


FOUND = "query_id long, vec_id long, score long"


def _search(k: int, scale: int):
    """Rows sorted by block and kind: the rows of a block (0), which are indexed, then the queries (1), which are streamed."""

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
        block, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
        ids, v = batch.column("id").to_numpy(), batch.column("v")
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(block)], strict=True):
            if j > i:
                yield int(block[i]), int(kind[i]), ids[i:j], v.slice(i, j - i)

    def vectors(v: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and matrix of the vectors of each length."""
        sizes, flat = pa.compute.list_value_length(v).to_numpy(), v.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = {}
        for d in np.unique(sizes).tolist():
            places = np.flatnonzero(sizes == d)
            out[d] = places, integers(flat[at[places][:, None] + np.arange(d)[None, :]], scale)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, blocks = None, [], {}
        for batch in batches:
            found = []
            for block, kind, ids, v in cut(batch):
                if block != at:
                    at, waiting, blocks = block, [], {}
                if kind == 0:
                    waiting.append((ids, v))
                    continue
                if waiting:
                    all_ids = np.concatenate([x[0] for x in waiting])
                    blocks = {d: Block(all_ids[places], m) for d, (places, m) in vectors(pa.concat_arrays([x[1] for x in waiting])).items()}
                    waiting = []
                for d, (places, m) in vectors(v).items():
                    if d in blocks:
                        for i, q in zip(ids[places].tolist(), m, strict=True):
                            found += [(i, x, s) for s, x in blocks[d].search(q, i, k)]
            if any(abs(s) >= 2**63 for _, _, s in found):
                raise OverflowError("a score leaves 64 bits")
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, rows: int = ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the largest integer inner product for each row that `queries` selects.

    Components are floor(scale * x). Vectors that are null or empty or hold null or non-finite components take no part, nor do rows
    with null ids; only vectors of one length are compared. A query's own id is no candidate; a repeated id is one query for each
    different vector, and rows that repeat an id rank side by side. Ties go to the smaller id. Fewer candidates than k give fewer rows.
    Components and scores are exact at any size; a score among the k best of a block that leaves 64 bits is an error. An empty table gives an empty result; other columns are ignored. Each query is sent
    to each block of `rows` rows, so queries times rows / 16384 vectors move.
    """
    table = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), components(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")).where("v is not null")
    n = table.count()
    blocks = max(1, -(-n // rows))
    dealt = table.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"))
    asked = table.where("is_query").select(F.col("vec_id").alias("query_id"), "v").distinct()
    every = asked.select("query_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    both = dealt.select("block", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v").unionByName(every.select("block", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v"))
    found = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_search(k, scale), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
