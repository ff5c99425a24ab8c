"""Substring deduplication by relative Lempel-Ziv parsing.

The earliest documents that hold a passage form the reference blocks, one for each group of segments that share an anchor
(windows.py). A block is indexed by its phrases of GRAM words. Every later segment is parsed greedily against its block: at each
place the longest factor that the block holds is taken (of GRAM words or more), else one literal word. Factors of `window` words or
more are duplicate spans. Windows that cross the end of a factor, short ones too, are looked up one by one, as a repeat may begin
inside one factor and end in the next. What the block lacks is appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ontoscore.llm.common import record
from ontoscore.llm.windows import Unit, candidates, keyed, resolved, spans_of

WINDOW = 50
GRAM = 16
BATCH = 1 << 20


def extended(a: list[bytes], x: int, b: list[bytes], y: int, n: int) -> int:
    """How many words two lists have in common from places x and y on, n at least; stretches are compared that grow, then shrink."""
    most, step, growing = min(len(a) - x, len(b) - y), 16, True
    while n < most:
        m = min(step, most - n)
        if a[x + n : x + n + m] == b[y + n : y + n + m]:
            n += m
            step = step * 2 if growing else step
        elif m == 1:
            break
        else:
            growing, step = False, m // 2
    return n


class Reference:
    """An indexed reference block: phrases of words, where each gram of them starts, and their windows."""

    def __init__(self, window: int):
        self.window, self.gram = window, min(GRAM, window)
        self.phrases: list[list[bytes]] = []
        self.index: dict[bytes, int | list[int]] = {}  # phrase and place in it as one number, or several
        self.windows: set[bytes] = set()

    def factor(self, words: list[bytes], keys: list[bytes], i: int) -> int:
        """Words of the longest factor at i; 0 if the block lacks even the gram there."""
        places = self.index.get(keys[i]) if i < len(keys) else None
        if places is None:
            return 0
        longest = 0
        for place in places if isinstance(places, list) else (places,):
            phrase, at = self.phrases[place >> 32], place & 0xFFFFFFFF
            n = self.gram
            if longest:  # a place must hold the next word to be better
                n = longest + 1
                if at + n > len(phrase) or phrase[at + longest] != words[i + longest] or phrase[at + self.gram : at + longest] != words[i + self.gram : i + longest]:
                    continue
            longest = extended(phrase, at, words, i, n)
            if i + longest == len(words):
                break
        return longest

    def append(self, words: list[bytes], keys: list[bytes], windows: list[bytes], spans: list[tuple[int, int]]) -> None:
        """Adds the phrases whose windows start in the given spans."""
        for s, n in spans:
            p = len(self.phrases) << 32
            self.phrases.append(words[s : s + n + self.window - 1])
            self.windows.update(windows[s : s + n])
            for i in range(n + self.window - self.gram):
                held = self.index.setdefault(keys[s + i], p + i)
                if isinstance(held, list):
                    held.append(p + i)
                elif held != p + i:
                    self.index[keys[s + i]] = [held, p + i]


def parse(words: list[bytes], keys: list[bytes], windows: list[bytes], block: Reference) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Greedy parse of a segment (keys: its grams): spans (first, count) of windows the block holds, and of those it lacks."""
    found: list[tuple[int, int]] = []
    i, n, W, crossed = 0, len(windows), block.window, -1
    while i < n:
        length = block.factor(words, keys, i)
        if not length:
            i += 1
            continue
        if length >= W:
            found.append((i, length - W + 1))
        end = i + length
        for s in range(max(i + 1, end - W + 1, crossed + 1), min(end, n)):  # windows that cross the factor's end
            if windows[s] in block.windows:
                found.append((s, 1))
        crossed = max(crossed, min(end, n) - 1)
        i = end
    spans: list[list[int]] = []
    for s, m in sorted(found):
        m = min(m, n - s)
        if spans and s <= spans[-1][0] + spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], s + m - spans[-1][0])
        else:
            spans.append([s, m])
    held = [(s, m) for s, m in spans]
    lacking, at = [], 0
    for s, m in held:
        if s > at:
            lacking.append((at, s - at))
        at = s + m
    if at < n:
        lacking.append((at, n - at))
    return held, lacking


def parse_group(group: list[dict], window: int) -> list[list[tuple[int, int]]]:
    """For each segment the spans of its windows that start in a document with a smaller id than its own least one."""
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    by: dict[int, list[int]] = {}
    for i, r in enumerate(group):
        by.setdefault(r["g"], []).append(i)
    for members in by.values():
        block, waiting, last = Reference(window), [], None
        for i in sorted(members, key=lambda i: (group[i]["id"], group[i]["fp"])):
            r = group[i]
            if r["id"] != last:  # one document's own segments do not count against each other
                for x in waiting:
                    block.append(*x)
                waiting, last = [], r["id"]
            words = r["seg"].split(b" ")
            ends, at = [], 0
            for w in words:
                at += len(w) + 1
                ends.append(at)
            seg = r["seg"]
            cut = lambda size, count: [seg[(ends[j - 1] if j else 0) : ends[j + size - 1] - 1] for j in range(count)]  # noqa: B023, E731
            keys, held = cut(block.gram, len(words) - block.gram + 1), cut(window, r["n"])
            out[i], lacking = parse(words, keys, held, block)
            waiting.append((words, keys, held, lacking))
    return out


KEPT = "k1 long, k2 long, doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,length:int>>, kept string"


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, spans of removed words, and kept if with_text.

    Removes each word covered by `window` consecutive words that also start in a document with a smaller id; judged on the input. A
    null text has no words. A null id is larger than all others, and rows with a null id are one document in this. Repeated rows
    have one id and do not count against each other. A long text is looked at whole, in parts that overlap. An empty table gives an
    empty result; other columns are ignored.
    """
    unit = Unit("word", window, min(GRAM, window))
    docs, segments = candidates(keyed(docs, id_col, text_col), unit, by_document=True)
    found = resolved(segments, unit, lambda group: parse_group(group, window), BATCH)
    windows = spans_of(segments, found, lambda own, piece: own > piece["first_id"])
    joined = docs.join(windows, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "spans")
    return joined.mapInArrow(_remove(window, with_text), KEPT).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans", *["kept"] * with_text)


def _remove(window: int, with_text: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(KEPT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            texts, spans = batch.column("text"), batch.column("spans")
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                cuts: list[list[int]] = []
                for x in sorted((x["s"], x["s"] + x["n"] - 1 + window) for x in spans[i].as_py() or ()):
                    if cuts and x[0] <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], x[1])
                    else:
                        cuts.append(list(x))
                rest, at = [], 0
                for s, e in cuts:
                    rest += words[at:s]
                    at = e
                rest += words[at:]
                kept = b" ".join(rest)
                rows["n_words"].append(len(words))
                rows["n_removed"].append(len(words) - len(rest))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["spans"].append([{"start": s, "length": e - s} for s, e in cuts])
                rows["kept"].append(kept.decode() if with_text else None)
            for c in ("k1", "k2", "doc_id"):
                rows[c] = batch.column(c).to_pylist()
            yield record(schema, **rows)

    return run
