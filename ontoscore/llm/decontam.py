"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are words with A-Z in lower case. Running Karp-Rabin hashes of MATCH consecutive words are the seeds that
a text shares with an item. From them the longest common stretch is marked in both, again and again, no word twice; the tiles may
lie in any order, so a passage whose sentences were moved around is found too. A text is contaminated by an item of which tiles
cover `coverage` or more.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoscore.llm.common import chunks, gram_hash, materialise, powers, prefix_hash, text_buffer, words

MATCH = 5
COVERAGE = 0.5
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is tested in several passes over the texts.
BLOCK_BYTES = 16 << 20


def tiles(text: list, item: list, seeds: list[tuple[int, int]], match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, words) of the longest common stretches, no word in two of them.

    seeds: all pairs of places at which `match` words have equal hashes. Ties go to the earliest place in the item, then in the text.
    """
    diagonals = defaultdict(list)
    for p, t in seeds:
        if text[p : p + match] == item[t : t + match]:
            diagonals[p - t].append(t)
    runs = []
    for d, places in diagonals.items():
        places.sort()
        start = last = places[0]
        for t in [*places[1:], None]:
            if t is None or t != last + 1:
                runs.append((start + d, start, last - start + match))
                start = t
            last = t
    return tiled(runs, len(text), len(item), match)


def tiled(runs: list[tuple[int, int, int]], text: int, item: int, match: int) -> list[tuple[int, int, int]]:
    """The tiles among maximal common stretches (place in text, place in item, words), longest first; what a tile leaves of one goes back."""
    heap = [(-n, t, p) for p, t, n in runs]
    heapq.heapify(heap)
    in_text, in_item, out = np.zeros(text, bool), np.zeros(item, bool), []
    while heap:
        size, t, p = heapq.heappop(heap)
        n = -size
        taken = in_item[t : t + n] | in_text[p : p + n]
        if not taken.any():
            in_item[t : t + n] = True
            in_text[p : p + n] = True
            out.append((p, t, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= match:
                heapq.heappush(heap, (s - e, t + s, p + s))
    return out


def stretches(text: np.ndarray, item: np.ndarray, places: np.ndarray, grams: np.ndarray, item_grams: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Maximal common stretches (place in text, place in item, words) of two sequences of word hashes.

    places: where the text has a gram of the item, grams: these. Only pairs of places whose words before differ are made, so a phrase
    that both repeat costs its stretches, not all its pairs.
    """
    by = np.argsort(item_grams, kind="stable")
    order = np.argsort(grams, kind="stable")
    keys, begin = np.unique(grams[order], return_index=True)
    low, high = np.searchsorted(item_grams[by], keys), np.searchsorted(item_grams[by], keys, "right")
    cut = np.append(begin, len(order))
    before_text = np.concatenate([[np.uint64(0)], text])  # the word before each place; 0 at the start
    before_item = np.concatenate([[np.uint64(0)], item])
    ps, ts = [], []
    for k in range(len(keys)):
        own_p, own_t = places[order[cut[k] : cut[k + 1]]], by[low[k] : high[k]]
        if len(own_p) * len(own_t) <= 64:
            x, y = np.repeat(own_p, len(own_t)), np.tile(own_t, len(own_p))
            start = (x == 0) | (y == 0) | (before_text[x] != before_item[y])
            ps.append(x[start])
            ts.append(y[start])
            continue
        words_p, words_t = before_text[own_p], before_item[own_t]
        for w in np.unique(words_t):
            mine, others = own_t[(words_t == w) & (own_t > 0)], own_p[(words_p != w) | (own_p == 0)]
            ps.append(np.repeat(others, len(mine)))
            ts.append(np.tile(mine, len(others)))
        if (own_t == 0).any():
            ps.append(own_p)
            ts.append(np.zeros(len(own_p), np.int64))
    p, t = np.concatenate(ps), np.concatenate(ts)
    # words in common from each start: sums of powers are compared over halves of what is left
    a, b, down = prefix_hash(text), prefix_hash(item), powers(max(len(text), len(item)) + 1)[1]
    size = np.full(len(p), match)
    step = 1 << max(len(text), len(item)).bit_length()
    while step:
        more = size + step
        fits = np.flatnonzero((p + more <= len(text)) & (t + more <= len(item)))
        x, y, m = p[fits], t[fits], more[fits]
        same = (a[x + m] - a[x]) * down[x] == (b[y + m] - b[y]) * down[y]
        size[fits[same]] = m[same]
        step >>= 1
    return list(zip(p.tolist(), t.tolist(), size.tolist(), strict=True))


class Index:
    """The seeds of benchmark items, for vectorised look-up. whole_short: items of fewer words than a seed are kept whole."""

    def __init__(self, items: list[tuple], match: int, whole_short: bool = False):
        self.match = match
        self.items = [(key, text.encode().lower().split()) for key, text in items]
        data = np.frombuffer("".join(t for _, t in items).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in items])]).astype(np.int64)
        _, _, h, first = words(data, offsets, fold=True)
        grams, item = [], []
        self.hashes = [h[first[i] : first[i + 1]] for i in range(len(items))]
        self.own = [gram_hash(x, match) for x in self.hashes]
        self.short: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for i, g in enumerate(self.own):
            grams.append(g)
            item.append(np.full(len(g), i))
            if whole_short and 0 < len(self.items[i][1]) < match:
                self.short[tuple(self.items[i][1])].append(i)
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(self.grams, kind="stable")
        self.grams = self.grams[order]
        self.item = np.concatenate(item)[order] if grams else order
        self.at = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else order
        self.size = np.array([len(x) for x in self.hashes], np.int64)
        bits = max(16, int(len(self.grams) * 16).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.grams & self.mask] = True

    def places(self, grams: np.ndarray) -> np.ndarray:
        """The places of grams that some item has."""
        maybe = np.flatnonzero(self.filter[grams & self.mask])
        if not len(maybe):
            return maybe
        at = np.searchsorted(self.grams, grams[maybe])
        return maybe[self.grams[np.minimum(at, len(self.grams) - 1)] == grams[maybe]]

    def coverable(self, keys: np.ndarray, coverage: float) -> np.ndarray:
        """The items of which grams among `keys` (distinct, sorted) cover a share of `coverage` or more: no tiles can cover more than these do.

        Each gram is looked up once; what a seed costs an item that is not tiled is a few numbers in arrays.
        """
        a, b = np.searchsorted(self.grams, keys), np.searchsorted(self.grams, keys, "right")
        n = b - a
        entries = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, at = self.item[entries], self.at[entries]
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        new = np.flatnonzero(np.diff(item, prepend=-1))
        step = np.minimum(np.diff(at, append=0), self.match)
        step[np.append(new[1:], len(item)) - 1] = self.match  # the last gram of an item counts in full
        covered = np.add.reduceat(step, new)
        return item[new][covered >= coverage * self.size[item[new]]]

    def matches(self, data: np.ndarray, offsets: np.ndarray, coverage: float = 0) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item, tiles) for each row of a buffer and item that share a seed; places in the text count words.

        Items of which the seeds in a text cannot cover a share of `coverage` are left out; others may be covered by less.
        """
        starts, ends, h, first = words(data, offsets, fold=True)
        for k in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < self.match)).tolist() if self.short else ():
            text = data[starts[first[k]] : ends[first[k + 1] - 1]].tobytes().lower().split()
            for i in self.short.get(tuple(text), ()):
                yield k, i, [(0, 0, len(text))]
        if not len(self.grams):
            return
        grams = gram_hash(h, self.match)
        hits = self.places(grams)
        row = np.searchsorted(first, hits, "right") - 1
        inside = hits + self.match <= first[row + 1] if len(hits) else np.zeros(0, bool)
        hits, row = hits[inside], row[inside]
        cuts = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        for lo_hit, hi_hit in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = hits[lo_hit:hi_hit]
            k = int(row[lo_hit])
            lo, hi = int(first[k]), int(first[k + 1])
            met = self.coverable(np.unique(grams[own]), coverage)
            if not len(met):
                continue
            text = data[starts[lo] : ends[hi - 1]].tobytes().lower().split()
            for i in met.tolist():
                at = own[np.isin(grams[own], self.own[i])]
                runs = stretches(h[lo:hi], self.hashes[i], at - lo, grams[at], self.own[i], self.match)
                item = self.items[i][1]
                runs = [(p, t, n) for p, t, n in runs if text[p : p + n] == item[t : t + n]]  # hashes decide nothing by themselves
                found = tiled(runs, len(text), len(item), self.match)
                if found:
                    yield k, i, found


def indexes(benchmark: DataFrame, id_col: str, text_col: str, match: int, block_bytes: int, whole_short: bool) -> tuple[int, Iterator[Index]]:
    """How many blocks of about `block_bytes` bytes the benchmark's distinct items make, and their indexes, each built when it is asked for."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)

    def each() -> Iterator[Index]:
        for b in range(blocks):
            part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
            yield Index(sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), match, whole_short)

    return blocks, each()


def _passes(spark, blocks: int, each: Iterator[Index], over: Callable[[object], DataFrame], empty: DataFrame) -> DataFrame:
    """The rows that `over` finds with each block's broadcast index. Of several blocks one at a time is in memory: its rows are written, then it goes."""
    out = empty
    for index in each:
        sent = spark.sparkContext.broadcast(index)
        found = over(sent)
        if blocks > 1:
            found = materialise(found, "leaks")
            sent.destroy()
        out = out.union(found) if out is not empty else found
        del index
    return out


def _scan(index: Index, coverage: float, act: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            found = []
            for i, j in chunks(offsets):
                for k, item, got in index.value.matches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], coverage):
                    key, item_words = index.value.items[item]
                    n = sum(t[2] for t in got)
                    if n >= coverage * len(item_words):
                        found.append((i + k, key, len(got), n, len(item_words), got))
            yield from act(batch, found)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", match: int = MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, whole_short: bool = False) -> DataFrame:
    """One row per text and benchmark item that contaminates it: doc_id, item_id, n_tiles, matched_words, item_words, coverage, tiles.

    tiles: place in the text, place in the item, words. A null text or item has no words; an item with fewer than `match` words has no
    seed; with whole_short it contaminates the texts that consist of it, else none; equal items count once, equal texts each. Null ids stay null. A long text is
    compared whole, and stretches that it shares with an item are found without making all pairs of places. An empty table on either
    side gives an empty result; other columns are ignored.
    """
    schema = "doc_id long, item_id long, n_tiles long, matched_words long, item_words long, coverage double, tiles array<struct<text:long,item:long,words:long>>"
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def act(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
        if found:
            ids = batch.column("doc_id").to_pylist()
            rows = [{"doc_id": ids[k], "item_id": key, "n_tiles": m, "matched_words": n, "item_words": size, "coverage": n / size, "tiles": [dict(zip(("text", "item", "words"), t, strict=True)) for t in got]} for k, key, m, n, size, got in found]
            yield pa.RecordBatch.from_pylist(rows, kind)

    blocks, each = indexes(benchmark, item_col, item_text, match, block_bytes, whole_short)
    return _passes(spark, blocks, each, lambda sent: plain.mapInArrow(_scan(sent, coverage, act), schema), spark.createDataFrame([], schema))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", match: int = MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, whole_short: bool = False) -> DataFrame:
    """The rows of docs, all columns, that no benchmark item contaminates. Null and empty texts stay; repeated rows are judged alike.

    One pass over the texts without a shuffle, if the benchmark is one block; else one pass for each block finds the texts that go, and
    one join leaves them out. whole_short: as in leaks().
    """
    blocks, each = indexes(benchmark, item_col, item_text, match, block_bytes, whole_short)
    spark = docs.sparkSession
    if not blocks:
        return docs
    if blocks == 1:
        other = None if text_col == "text" else next(f"text_{i}" for i in range(len(docs.columns) + 1) if f"text_{i}" not in docs.columns)
        named = docs if other is None else docs.withColumnsRenamed({"text": other, text_col: "text"})

        def act(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in found]] = False
            yield batch.filter(pa.array(keep))

        out = named.mapInArrow(_scan(spark.sparkContext.broadcast(next(each)), coverage, act), named.schema)
        return out if other is None else out.withColumnsRenamed({"text": text_col, other: "text"})
    texts = docs.select(F.col(text_col).alias("text"))
    schema = "t1 long, t2 long"
    keyed = lambda c: (F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), F.reverse(c)))
    plain = texts.select("text", *[k.alias(n) for k, n in zip(keyed(F.col("text")), ("t1", "t2"), strict=True)])

    def keys(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
        if found:
            yield batch.select(["t1", "t2"]).take(pa.array(sorted({x[0] for x in found})))

    gone = _passes(spark, blocks, each, lambda sent: plain.mapInArrow(_scan(sent, coverage, keys), schema), spark.createDataFrame([], schema)).distinct()
    a, b = keyed(F.col(text_col))
    return docs.join(gone, (a == F.col("t1")) & (b == F.col("t2")), "left_anti")
