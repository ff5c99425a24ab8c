"""Exact piece encoding of whole texts by backtracking, and decoding, for BPE models of the sentencepiece library.

The library merges the best adjacent pair of symbols again and again. A sequence of pieces is that result if and only if each piece and
each two neighbours are the result of merging their own characters: merges that stay inside a span are not touched by what stands around
it, so the first merge over a border between two neighbours would also happen in the two alone. Encoding walks from left to right with
the longest piece that starts at a place (one Aho-Corasick pass finds them all); a piece that does not go with its left neighbour, or
that ends where a bitfield says no encoding can, gives way to its next shorter prefix, and a place without one is marked and left
backwards. Whether two pieces go together is found by merging both side by side, and remembered.

Texts are cut where no piece can lie across: before a run of spaces, and around characters that no longer piece holds. Parts that occur
often are looked up. Rows are handled in slices, so memory follows neither the length of a text nor the number of rows; nothing is
shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SPACE = "▁"
#: Kinds of pieces and of models, as numbered in model files.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Characters that are cut and looked up at once, and parts and pairs that a worker remembers.
SLICE, PARTS, PAIRS = 1 << 19, 600_000, 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialised protocol buffer."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """What encoding and decoding need of a model: BPE with byte fallback, no normalisation but the leading space."""

    def __init__(self, model: bytes) -> None:
        self.names, self.scores, self.kinds = [], [], []
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                entry = dict(_fields(value))
                self.names.append(entry[1].decode())
                self.scores.append(float(np.frombuffer(entry.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        plain = trainer.get(3) == BPE and trainer.get(35) and not trainer.get(24) and {USER_DEFINED, UNUSED}.isdisjoint(self.kinds)
        if not plain or normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only BPE models with byte fallback, a leading space and no other normalisation are supported")
        self.unknown = trainer.get(44, " ⁇ ".encode())
        self.ids = {name: i for i, name in enumerate(self.names) if self.kinds[i] == NORMAL}
        self.bytes = {int(name[1:-1], 16): i for i, name in enumerate(self.names) if self.kinds[i] == BYTE}
        self.score = {name: self.scores[i] for name, i in self.ids.items()}
        # a token is a piece's id, or -1 less a character that is no piece
        self.runs: dict[int, list[tuple[float, str, str]]] = {}
        self.automaton, held, closed = ahocorasick.Automaton(), set(), True
        for name, i in self.ids.items():
            whole, run = self.merge(name)
            if whole:
                self.runs[i] = run
            if len(name) > 1:
                held.update(name)
                closed &= SPACE not in name.lstrip(SPACE)
                if whole:
                    self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for i in self.runs:
            name = self.names[i]
            if len(name) > 1:
                self.shorter[i] = next((j for k in range(len(name) - 1, 1, -1) if (j := self.ids.get(name[:k])) in self.runs), self.token(name[0]))
        letters = "".join(re.escape(c) for c in sorted(held - {SPACE}))
        self.cut = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|[^{SPACE}{letters}]" if closed else f"[{SPACE}{letters}]+|[^{SPACE}{letters}]")
        self.between = next(c for c in map(chr, range(10, 0x10FFFF)) if c not in held and c not in self.ids)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()
        surface = [self.surface(i) for i in range(len(self.names))]
        self.surface_sizes = np.array([len(s) for s in surface], np.int64)
        self.surface_starts = np.concatenate([[0], np.cumsum(self.surface_sizes)])[:-1]
        self.surface_bytes = np.frombuffer(b"".join(surface) or b"\0", np.uint8)
        self.heads = np.array([name.startswith(SPACE) and self.kinds[i] == NORMAL for i, name in enumerate(self.names)])
        self.is_byte = np.array([kind == BYTE for kind in self.kinds])
        self.is_control = np.array([kind == CONTROL for kind in self.kinds])
        self.sizes = list(map(len, self.names))
        self.most = max(map(len, self.ids))

    def token(self, c: str) -> int:
        return self.ids.get(c, -1 - ord(c))

    def text(self, token: int) -> str:
        return self.names[token] if token >= 0 else chr(-1 - token)

    def merge(self, text: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Merges a short text's characters; whether one symbol is left, and after each merge its score and the text's first and last symbol."""
        symbols, run = list(text), []
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                score = self.score.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return False, run
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            run.append((best, symbols[0], symbols[-1]))
        return True, run

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the characters of two tokens side by side never merges over their border. Of equal scores the leftmost goes first."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        left, right = self.runs.get(a, ()), self.runs.get(b, ())
        last, first, i, j = self.text(a)[-1], self.text(b)[0], 0, 0
        while True:
            over = self.score.get(last + first)
            x = left[i][0] if i < len(left) else None
            y = right[j][0] if j < len(right) else None
            if over is not None and (x is None or over > x) and (y is None or over >= y):
                known = False
                break
            if x is None and y is None:
                known = True
                break
            if y is None or (x is not None and x >= y):
                last, i = left[i][2], i + 1
            else:
                first, j = right[j][1], j + 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = known
        return known

    # ------------------------------------------------------------ encoding

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.starts = array("i"), array("q", [0])

    def learn(self, parts: list[str]) -> None:
        """Encodes parts and remembers their ids."""
        at, joined, flat = 0, self.between.join(parts), self.flat
        longest = Longest(self, joined)
        for part in parts:
            for token in self.walk(joined, at, at + len(part), longest.get):
                if token >= 0:
                    flat.append(token)
                else:
                    flat.extend(self.bytes[x] for x in chr(-1 - token).encode())
            self.slots[part] = len(self.starts) - 1
            self.starts.append(len(flat))
            at += len(part) + 1

    def walk(self, text: str, lo: int, hi: int, longest: Callable[[int], int | None]) -> list[int] | array:
        """Tokens of text[lo:hi], which is not empty."""
        sizes, shorter, pairs = self.sizes, self.shorter, self.pairs
        dead = bytearray((hi - lo) // 8 + 1)  # a bit for each place that no encoding passes
        out, at, last, token = [] if hi - lo < SLICE else array("i"), lo, None, longest(lo)
        if token is None:
            token = self.token(text[lo])
        while True:
            end = at + (sizes[token] if token >= 0 else 1)
            k = end - lo
            goes = not dead[k >> 3] >> (k & 7) & 1
            if goes and last is not None and (goes := pairs.get((last, token))) is None:
                goes = self.fits(last, token)
            if goes:
                out.append(token)
                if end == hi:
                    return out
                at, last, token = end, token, longest(end)
                if token is None:
                    token = self.token(text[end])
            elif (less := shorter.get(token)) is not None:
                token = less
            else:
                k = at - lo
                dead[k >> 3] |= 1 << (k & 7)
                token = out.pop()
                last = out[-1] if out else None
                at -= sizes[token] if token >= 0 else 1

    def ids_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, one after the other, and how many each has."""
        found = list(map(self.slots.get, parts))
        if None in found:
            fresh = {p for p, slot in zip(parts, found, strict=True) if slot is None}
            if len(self.slots) + len(fresh) > PARTS or len(self.flat) > 8 * PARTS:
                self.forget()
                fresh = set(parts)
            self.learn(list(fresh))
            found = list(map(self.slots.__getitem__, parts))
        slots = np.array(found, np.int64)
        starts = np.frombuffer(self.starts, np.int64)
        first, counts = starts[slots], starts[slots + 1] - starts[slots]
        del starts
        return _gather(np.frombuffer(self.flat, np.int32), first, counts), counts

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any length, which is cut into slices."""
        if not text:
            return np.zeros(0, np.int32)
        found, out = (m.group() for m in self.cut.finditer(SPACE + text.replace(" ", SPACE))), []
        while parts := _some(found):
            out.append(self.ids_of(parts)[0])
        return np.concatenate(out)

    def encode_all(self, texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and offsets of rows, as many rows together as make a slice; null texts count as empty."""
        parts, ends, size = [], [], 0

        def done() -> tuple[np.ndarray, np.ndarray]:
            ids, counts = self.ids_of(parts)
            return ids, np.concatenate([[0], np.cumsum(counts)])[[0, *ends]]

        for text in texts:
            if text and len(text) > SLICE:
                if ends:
                    yield done()
                    parts, ends, size = [], [], 0
                ids = self.encode(text)
                yield ids, np.array([0, len(ids)])
                continue
            if text:
                parts += self.cut.findall(SPACE + text.replace(" ", SPACE))
                size += len(text)
            ends.append(len(parts))
            if size > SLICE:
                yield done()
                parts, ends, size = [], [], 0
        if ends:
            yield done()

    # ------------------------------------------------------------ decoding

    def surface(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.names[i][1:-1], 16)])
        return b"" if self.kinds[i] == CONTROL else self.unknown if self.kinds[i] == UNKNOWN else self.names[i].replace(SPACE, " ").encode()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids; offsets has where rows begin, and the end."""
        sizes, starts = self.surface_sizes[ids], self.surface_starts[ids]
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        led = heads[self.heads[ids[heads]]]
        sizes[led] -= 1
        starts[led] += 1
        data = _gather(self.surface_bytes, starts, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        begun = ends[:-1][ends[1:] > ends[:-1]]
        try:
            data.tobytes().decode()
            plain = not ((data[begun] & 0xC0) == 0x80).any() and not self.is_control[ids].any()
        except UnicodeDecodeError:
            plain = False
        if plain:
            return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
        return pa.array([self.decode_one(ids[i:j].tolist()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())

    def decode_one(self, ids: list[int]) -> str:
        """Any ids, also byte pieces that are no UTF-8 (a replacement character for each such byte) and control pieces (nothing)."""
        out, some, led, run = [], False, False, b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.surface(i)
                continue
            while run:
                size = next((k for k in range(1, 5) if _is_character(run[:k])), 0)
                out.append(run[:size].decode() if size else "\ufffd")
                run, some = run[max(1, size) :], True
            if i is not None:
                text = self.surface(i).decode()
                led, strip = not (led or some) and bool(self.heads[i]), led or some
                text = text[1:] if led else text
                led = led or strip
                out.append(text)
                some = some or bool(text)
        return "".join(out)


class Longest:
    """The longest piece that starts at each place of a text, by one pass of the automaton over each window that is asked for."""

    def __init__(self, pieces: Pieces, text: str) -> None:
        self.pieces, self.text, self.windows = pieces, text, {}
        if len(text) <= 2 * SLICE:
            self.get = self.window(0, len(text)).get

    def window(self, lo: int, hi: int) -> dict[int, int]:
        longest, sizes = {}, self.pieces.sizes
        for end, token in self.pieces.automaton.iter(self.text, lo, min(len(self.text), hi + self.pieces.most)):
            longest[end + 1 - sizes[token]] = token  # ends ascend, so the longest stays
        return longest

    def get(self, at: int) -> int | None:
        k = at // SLICE
        if k not in self.windows:
            if len(self.windows) > 2:
                self.windows.clear()
            self.windows[k] = self.window(k * SLICE, (k + 1) * SLICE)
        return self.windows[k].get(at)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _some(found: Iterator[str]) -> list[str]:
    parts, size = [], 0
    for part in found:
        parts.append(part)
        size += len(part)
        if size >= SLICE:
            break
    return parts


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


# ---------------------------------------------------------------- Spark

_LOADED: dict[int, Pieces] = {}


def load(model: bytes) -> Pieces:
    """The tables of a model, made once in each worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _model(df: DataFrame, path: str):
    """The model file, read by the driver; half a MB, whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of every text: key, ids (array of int).

    A null text counts as empty and has no ids, as has an empty one. A long text is cut into slices and may be of any length. Repeated
    rows give repeated rows; null keys are kept. Columns beside key and text, whatever their names, take no part. An empty table gives
    an empty one.
    """
    shared = _model(docs, model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(shared.value)
        for batch in batches:
            keys, first = batch.column(0), 0
            for ids, offsets in pieces.encode_all(x.as_py() for x in batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(lists)), lists], names=[key, "ids"])
                first += len(lists)

    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))])
    return docs.select(key, text).mapInArrow(kernel, schema)


def decode(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """The text of every row of ids: key, ids, decoded. Null ids count as none; ids outside the model are an error."""
    shared = _model(encoded, model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(shared.value)
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            ends = np.concatenate([[0], np.cumsum(np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64))])
            flat, i = np.array(lists.flatten(), np.int32), 0
            while i < len(lists):
                j = min(len(lists), max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1))
                texts = pieces.decode(flat[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), lists.slice(i, j - i), texts], names=[key, "ids", "decoded"])
                i = j

    schema = StructType([*encoded.select(key, "ids").schema.fields, StructField("decoded", StringType())])
    return encoded.select(key, "ids").mapInArrow(kernel, schema)


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What encoding and decoding give for every text: key, n_tokens, ids_sha256, decoded_sha256. Nulls and rows as in encode()."""
    both = decode(encode(docs, model, key, text), model, key)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
