"""Suffix-array deduplication of byte strings.

Removes each byte covered by a string of `length` bytes that also starts anywhere else. Candidate segments (windows.py) are
sorted by two-stage suffix sorting: suffixes smaller than their successors (type B) are sorted directly, the others (type A)
are induced by one scan over the buckets of first bytes; common prefixes of neighbours in that order then tell which strings repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ontoscore.llm.windows import Unit, candidates, keyed, resolved, spans_of

LENGTH = 400
GRAM = 64
#: Bytes of segments that are sorted together; a group of one anchor is never split.
BATCH = 1 << 20
#: Suffixes with 16 bytes in common that are sorted by slices of their bytes; larger ties are ranked by further bytes.
TIES = 4096


def words_at(text: bytes) -> np.ndarray:
    """The 8 bytes from each place of a text as one big-endian number; what lies beyond its end counts as 0."""
    data = np.frombuffer(text + bytes(8), np.uint8).astype(np.uint64)
    out = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[i : len(text) + 1 + i]
    return out


def sort_places(text: bytes, eight: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the `depth` bytes from each. Ranks of 16 bytes first; what they leave tied is sorted by its bytes, large ties by the next 16."""
    n = len(text)
    eight_at = lambda p: eight[np.minimum(p, n)]
    out, todo = places.copy(), [(0, len(places), 0)]
    while todo:
        lo, hi, off = todo.pop()
        part = out[lo:hi]
        a, b = eight_at(part + off), eight_at(part + off + 8)
        order = np.lexsort((b, a))
        part, a, b = part[order], a[order], b[order]
        out[lo:hi] = part
        off += 16
        if off >= depth:
            continue
        edges = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [hi - lo]])
        tied = np.flatnonzero(np.diff(edges) > 1)
        for i, j in zip(edges[tied].tolist(), edges[tied + 1].tolist(), strict=True):
            if j - i > TIES:
                todo.append((lo + i, lo + j, off))
            elif j - i == 2:
                p, q = int(part[i]), int(part[i + 1])
                if text[p + off : p + depth] > text[q + off : q + depth]:
                    out[lo + i], out[lo + i + 1] = q, p
            else:
                out[lo + i : lo + j] = sorted(part[i:j].tolist(), key=lambda p: text[p + off : p + depth])
    return out


def suffix_order(segments: list[bytes], starts: list[int], depth: int) -> tuple[bytes, np.ndarray, list[int], np.ndarray]:
    """Joined text, its bytes by eight, where each segment begins, and the places of the first starts[i] suffixes of every segment, sorted by `depth` bytes."""
    text = b"\x00".join(segments) + b"\x00"
    lengths = np.array([len(s) + 1 for s in segments])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    x = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    stops = begin[1:] - 1
    x[stops] = 0
    n = len(x)
    # types, from the right: equal neighbours share the type of the next unequal one
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(x[1:] - x[:-1])
    sign[stops] = 1
    decided = np.where(sign != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = sign[decided] > 0  # type B
    # wanted suffixes, and after the last of each segment the chain up to the next type B
    after = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
    edge = np.zeros(n + 1, np.int32)
    count = np.asarray(starts)
    has = count > 0
    np.add.at(edge, begin[:-1][has], 1)
    np.add.at(edge, after[begin[:-1][has] + count[has] - 1] + 1, -1)
    needed = np.cumsum(edge[:-1]) > 0
    del decided, after, edge, sign
    eight = words_at(text)
    direct = sort_places(text, eight, np.flatnonzero(needed & smaller), depth)
    heads = x[direct]
    order_b = np.argsort(heads, kind="stable")  # separators hold byte 0 in the text but sort before all
    direct = direct[order_b]
    heads = heads[order_b]
    induced = needed & ~smaller
    waiting: dict[int, list[np.ndarray]] = {}
    bounds = np.searchsorted(heads, np.arange(258))
    out = []
    for c in range(257):
        scanned = []
        for fresh in waiting.pop(c, []):
            scanned.append(fresh)
        part = np.concatenate(scanned) if scanned else np.zeros(0, np.int64)
        scanned = [part]
        while len(part):  # predecessors in the same bucket, again and again along a run of one byte
            before = part[part > 0] - 1
            part = before[induced[before] & (x[before] == c)]
            if len(part):
                scanned.append(part)
        scanned.append(direct[bounds[c] : bounds[c + 1]])
        full = np.concatenate(scanned)
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        before = before[induced[before] & (x[before] > c)]
        if len(before):
            chars = x[before]
            by = np.argsort(chars, kind="stable")
            before, chars = before[by], chars[by]
            cuts = np.flatnonzero(np.diff(chars)) + 1
            for piece in np.split(before, cuts):
                waiting.setdefault(int(x[piece[0]]), []).append(piece)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, begin[:-1], 1)
    np.add.at(inside, begin[:-1] + count, -1)
    return text, eight, begin.tolist(), order[np.cumsum(inside[:-1])[order] > 0]


def common_prefixes(eight: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes, up to `length`, that each place in the order has in common with the next one; eight bytes are compared at a time."""
    p, q = order[:-1], order[1:]
    out, open_ = np.zeros(len(p), np.int64), np.arange(len(p))
    for off in range(0, length, 8):
        differ = eight[p[open_] + off] ^ eight[q[open_] + off]
        ended = differ != 0
        at, bits = open_[ended], differ[ended]
        # equal bytes before the highest one that differs
        out[at] = off + np.sum([bits < (np.uint64(1) << np.uint64(64 - 8 * k)) for k in range(1, 8)], axis=0)
        open_ = open_[~ended]
        out[open_] = off + 8
    return np.minimum(out, length)


def repeats(segments: list[bytes], starts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each segment, spans (first, count) of those of its first starts[i] strings of `length` bytes that occur twice among all of them."""
    text, eight, begin, order = suffix_order(segments, starts, length)
    hit = np.zeros(len(text) + 1, bool)
    if len(order) > 1:
        same = common_prefixes(eight, order, length) >= length
        hit[order[:-1][same]] = True
        hit[order[1:][same]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    which = np.searchsorted(begin, edges[::2], "right") - 1
    for k, s, e in zip(which.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out[k].append((s - begin[k], e - s))
    return out


KEPT = "k1 long, k2 long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,length:int>>, kept string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, with_rest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept if with_text, rest (other columns) if with_rest.

    A null text is empty; a null id is a document of its own; repeated rows are copies of each other, so what they hold of `length`
    bytes or more goes from all of them. Strings are judged on the input. kept is the remaining text, without characters of which
    a part went. A long text is looked at whole, in parts of a MB that overlap. Other columns of docs don't matter, whatever their
    names. An empty table gives an empty result.
    """
    unit = Unit("byte", length, min(GRAM, length))
    docs, segments = candidates(keyed(docs, id_col, text_col, with_rest), unit, by_document=False)

    def work(group: list[dict]) -> list[list[tuple[int, int]]]:
        return repeats([r["seg"] for r in group], [r["n"] for r in group], length)

    found = resolved(segments, unit, work, BATCH)
    windows = spans_of(segments, found, lambda _, piece: piece["copies"] > 1)
    more = ["rest"] * with_rest
    joined = docs.join(windows, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "spans", *more)
    schema = StructType.fromDDL(KEPT)
    if with_rest:
        schema = schema.add(docs.schema["rest"])
    out = joined.mapInArrow(_remove(length, with_text, to_arrow_schema(schema)), schema)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_text, *more)


def _remove(length: int, with_text: bool, schema: pa.Schema):
    made = [f.name for f in schema if f.name not in ("k1", "k2", "doc_id", "rest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in made}
            texts, spans = batch.column("text"), batch.column("spans")
            for i in range(batch.num_rows):
                text = (texts[i].as_py() or "").encode()
                cuts: list[list[int]] = []
                for x in sorted((x["s"], x["s"] + x["n"] - 1 + length) for x in spans[i].as_py() or ()):
                    if cuts and x[0] <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], x[1])
                    else:
                        cuts.append(list(x))
                rest, at = [], 0
                for s, e in cuts:
                    rest.append(text[at:s])
                    at = e
                kept = b"".join([*rest, text[at:]])
                rows["n_bytes"].append(len(text))
                rows["n_removed"].append(len(text) - len(kept))
                rows["n_spans"].append(len(cuts))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["spans"].append([{"start": s, "length": e - s} for s, e in cuts])
                rows["kept"].append(kept.decode(errors="ignore") if with_text else None)
            columns = [pa.array(rows[f.name], f.type) if f.name in rows else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run
