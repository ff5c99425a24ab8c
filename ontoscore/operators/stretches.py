"""The stretches of words of one text that may be evidence, best first, made as they are asked for.

A text of n words has about 11 n stretches, and nearly all of them share their words with a span that is chosen already. Their bounds,
values and sizes are arrays; a span's string is made when its turn comes. Stretches that lie within a chosen span or hold one are left
out as arrays: all words of the smaller one are then shared, so that they would be refused in any case. Of those that remain, a block at
a time is compared with all chosen spans by the numbers of their words, so that only spans that share too few of them become strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from ontoscore.functions import text as tx

TOKEN, LETTERS, BLANK = re.compile(tx.ASCII_WORD), re.compile("[A-Za-z]+"), re.compile(r"[\s,]*", re.ASCII)
GENERIC = re.compile(tx.GENERIC, re.ASCII)
STOP, EDGE, LEAD = frozenset(tx.STOPWORDS), frozenset(tx.EDGE_WORDS), frozenset(tx.LEAD_WORDS)
LOW, HIGH = 4, 14
NEVER = 1 << 40
FIRST_BLOCK, BLOCK = 48, 96


def content(span: str) -> list[str]:
    """The different words of a span in lower case, without function words."""
    return [w for w in dict.fromkeys(map(str.lower, TOKEN.findall(span))) if w not in STOP]


def letter(c: str) -> bool:
    """Whether a word goes on with this character, so that it does not end before it."""
    return c == "_" or (c.isalnum() if c.isascii() else unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mn"))


def behind_lead(text: str, at: int) -> int:
    """Where a span that begins at `at` begins without leading function words."""
    while (m := LETTERS.match(text, at)) and m[0].lower() in LEAD and not letter(text[m.end() : m.end() + 1] or " "):
        at = BLANK.match(text, m.end()).end()
    return at


class Stretches:
    """rank, term, good: the value of a stretch, what a term of the domain and a good length add; bounds: of characters and words; fewest: content words."""

    def __init__(self, text: str, rank: int, term: int, good: int, characters: tuple[int, int], words: tuple[int, int], fewest: int) -> None:
        self.text, self.low = text, text.lower()
        tokens = [(m.start(), m.end(), m[0].lower()) for m in TOKEN.finditer(text)]
        m = len(tokens)
        self.from_ = np.array([t[0] for t in tokens] or [0], np.int64)
        self.to = np.array([t[1] for t in tokens] or [0], np.int64)
        counts = np.array([t[2] not in STOP for t in tokens], np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        edge = np.array([t[2] in EDGE for t in tokens], bool)
        starts, firsts, odd, adds = self.from_.copy(), np.arange(max(m, 1)), np.zeros(max(m, 1), bool), np.zeros(max(m, 1), np.int64)
        self.numbers: dict[str, int] = {}  # of words, from 1 on; function words and places without a word are 0
        self.word = np.array([0 if t[2] in STOP else self.numbers.setdefault(t[2], len(self.numbers) + 1) for t in tokens] + [0], np.int32)
        parts: dict[int, int] = {}
        for i, (a, _, word) in enumerate(tokens):
            if not edge[i] and (lead := LETTERS.match(word)) and lead[0] in LEAD and (at := behind_lead(text, a)) > a:
                k = int(np.searchsorted(self.to, at, "right"))  # the first word that ends behind it
                starts[i], firsts[i] = at, k
                if k < m and self.from_[k] < at:  # within a word, of which a part is left
                    part = tokens[k][2][at - tokens[k][0] :].lstrip("-'")
                    odd[i], adds[i] = True, (part not in STOP) - int(counts[k])
                    parts[i] = 0 if part in STOP else self.numbers.setdefault(part, len(self.numbers) + 1)
        n, i = (x.ravel() for x in np.meshgrid(np.arange(LOW, HIGH + 1), np.arange(m), indexing="ij"))
        place = np.arange(len(i))
        keep = i + n <= m
        keep[keep] = ~edge[i[keep]] & ~edge[i[keep] + n[keep] - 1]
        n, i, place = n[keep], i[keep], place[keep]
        end = i + n
        size, number = self.to[end - 1] - starts[i], end - firsts[i]
        keep = (size >= characters[0]) & (size <= characters[1]) & (number >= words[0]) & (number <= words[1])
        keep[keep] = before[end[keep]] - before[firsts[i[keep]]] + adds[i[keep]] >= fewest
        self.i, self.end, self.size, self.place, number = i[keep], end[keep], size[keep], place[keep], number[keep]
        self.starts, self.firsts, self.odd = starts, firsts, odd
        self.head = self.word[firsts]  # the first word of the stretches from each word on
        self.head[list(parts)] = list(parts.values())
        self.value = -(rank + term * self.holds(tx.DOMAIN) + good * ((number >= 4) & (number <= 14)))

    def holds(self, needles: list[str]) -> np.ndarray:
        """Whether any of the needles (lower case) occurs in each stretch."""
        found = []
        for x in needles:
            at = self.low.find(x)
            while at >= 0:
                found.append((at, at + len(x)))
                at = self.low.find(x, at + 1)
        if not found:
            return np.zeros(len(self.i), bool)
        where = np.array(sorted(found), np.int64)
        least = np.append(np.minimum.accumulate(where[::-1, 1])[::-1], NEVER)  # the first end of those from here on
        starts, to = self.starts, self.to
        if len(self.low) != len(self.text):  # characters that grow in lower case
            moved = np.concatenate([[0], np.cumsum([len(c.lower()) for c in self.text])])
            starts, to = moved[starts], moved[to]
        return least[np.searchsorted(where[:, 0], starts)][self.i] <= to[self.end - 1]

    def beside(self, listed: list[tuple[int, str]], words: Callable[[str], list[str]] = content) -> None:
        """Puts spans of the text with values, best first, before the stretches; words: their content words."""
        self.listed = listed
        self.spans = [s for _, s in listed]
        self.lows = [s.lower() for s in self.spans]
        rows = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(s)] for s in self.spans]
        self.own = np.zeros((len(rows), max([HIGH, *map(len, rows)])), np.int32)
        for k, row in enumerate(rows):
            self.own[k, : len(row)] = row
        size = np.concatenate([np.array([len(s) for s in self.spans], np.int64), self.size])
        value = np.concatenate([np.array([v for v, _ in listed], np.int64), self.value])
        place = np.concatenate([np.arange(len(rows)), self.place + NEVER])
        self.ranks = (value, size, place, np.lexsort((place, size, value)))

    def words(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the different content words of listed spans and stretches, zeros in front of them; how many they are."""
        own = len(self.own)
        listed, k = key < own, np.maximum(key - own, 0)
        if listed.all():
            found = self.own[key]
        else:
            i = self.i[k]
            at = self.firsts[i][:, None] + np.arange(self.own.shape[1])
            found = np.where(at < self.end[k][:, None], self.word[np.minimum(at, len(self.word) - 1)], 0)
            found[:, 0] = self.head[i]
            if listed.any():
                found[listed] = self.own[key[listed]]
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = 0
        found.sort(axis=1)
        n = np.count_nonzero(found, axis=1)
        return found[:, found.shape[1] - max(int(n.max(initial=0)), 1) :], n

    def bounds(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of stretches; -1 for listed spans and where a word is cut."""
        if not len(self.i):
            return np.full(len(key), -1), np.full(len(key), -1)
        k = np.maximum(key - len(self.own), 0)
        i = self.i[k]
        return np.where((key < len(self.own)) | self.odd[i], -1, self.firsts[i]), self.end[k]

    def best(self, hits: np.ndarray, chosen: Chosen) -> Iterator[tuple]:
        """The rows of blocks(), one by one."""
        for rows in self.blocks(hits, chosen):
            yield from rows

    def blocks(self, hits: np.ndarray, chosen: Chosen) -> Iterator[list[tuple]]:
        """Rows (-hits, value, size, lower case, place, span, first word, end, words) in this order, without those that `chosen` refuses when their block's turn comes.

        hits: of the listed spans, then of the stretches; without any hit they are left out. First word and end are -1 where they are not known.
        """
        if not hasattr(self, "ranks"):
            self.beside([])
        value, size, place, order = self.ranks
        key = order[hits[order] > 0]
        key = key[np.argsort(-hits[key], kind="stable")]
        step = FIRST_BLOCK  # at first nothing is chosen that leaves spans out, so blocks are small
        while len(key):
            key = key[~chosen.refused(*self.bounds(key))]
            head = max(64, len(key) // 8)
            tied = np.zeros(len(key) + 1, bool)  # to the one before: such stay together
            tied[1:-1] = (hits[key[1:]] == hits[key[:-1]]) & (value[key[1:]] == value[key[:-1]]) & (size[key[1:]] == size[key[:-1]])
            ends = np.flatnonzero(~tied)[1:]  # of ties, the last one of all
            at = 0
            while at < min(head, len(key)):
                end = int(ends[np.searchsorted(ends, min(at + step, len(key)))])
                block, fresh, at, step = key[at:end], at == 0, end, min(2 * step, BLOCK)
                first, last = self.bounds(block)
                if not fresh:
                    keep = ~chosen.refused(first, last)
                    block, first, last = block[keep], first[keep], last[keep]
                words, n = self.words(block)
                keep = ~chosen.close_to_any(words, n, first, last)
                block = block[keep]
                columns = (-hits[block], value[block], size[block], block, first[keep], last[keep], words[keep])
                rows = [(h, v, z, *self.text_of(k), f, e, w) for h, v, z, k, f, e, w in zip(*[c.tolist() for c in columns], strict=True)]
                yield sorted(r for r in rows if r[4] < NEVER or not GENERIC.match(r[5]))
            key = key[at:]

    def text_of(self, k: int) -> tuple[str, int, str]:
        """Lower case, place and span of one that is listed or a stretch."""
        if k < len(self.own):
            return self.lows[k], k, self.spans[k]
        k -= len(self.own)
        span = self.text[self.starts[self.i[k]] : self.to[self.end[k] - 1]]
        return span.lower(), int(self.place[k]) + NEVER, span

    def where(self, span: str) -> tuple[int, int]:
        """First word and end of a span of the text; -1 where it cuts a word."""
        at = self.text.find(span)
        first, end = int(np.searchsorted(self.from_, at)), int(np.searchsorted(self.to, at + len(span), "right"))
        whole = at >= 0 and first < end and (first == 0 or self.to[first - 1] <= at) and (end == len(self.from_) or self.from_[end] >= at + len(span))
        return (first, end) if whole else (-1, -1)


class Chosen:
    """Chosen spans: bounds of spans whose parts, and of spans whose extensions, share too many words with a chosen one; and their words.

    n: words of the text; most: the part of the smaller one's words from which on a span shares too many.
    """

    def __init__(self, n: int, most: float = 1.0) -> None:
        self.within = np.full(n + 1, -1, np.int64)  # the last end of those that begin here or before
        self.around = np.full(n + 1, NEVER, np.int64)  # the first end of those that begin here or behind
        self.most, self.count = most, 0
        self.has = np.zeros((1, 64), np.uint8)  # whether a word (row) is one of a chosen span's
        self.sizes = np.zeros(64, np.int64)
        self.need = [NEVER]  # how many shared words are too many, by the number of the smaller one's

    def needed(self, top: int) -> list[int]:
        for n in range(len(self.need), top + 1):
            self.need.append(next(k for k in range(1, n + 1) if k == n or k / n >= self.most))
        return self.need

    def pick(self, rows: list[tuple], limit: int) -> list[tuple]:
        """Of rows none of which shares too many words with a chosen span, those up to `limit` that share too few with any picked before."""
        picked, masks = [], []
        need = self.needed(max((len(r[-1]) for r in rows), default=0))
        for r in rows:
            if len(picked) == limit:
                break
            mask = 0
            for w in r[-1]:
                mask |= 1 << w >> 1  # no word is 0
            n = mask.bit_count()
            for other, size in masks:
                if (mask & other).bit_count() >= need[n if n < size else size]:
                    break
            else:
                picked.append(r)
                masks.append((mask, n))
        return picked

    def take(self, words: list[list[int]], bounds: list[tuple[int, int]]) -> None:
        """Chooses spans of these words (numbers, or 0) and bounds of words (-1: not known)."""
        if not words:
            return
        numbers, (first, end) = np.array(words), np.array(bounds).T
        rows, columns = self.has.shape
        top, count = int(numbers.max()) + 1, self.count + len(words)
        if top > rows or count > columns:
            grown = np.zeros((max(top, 2 * rows) if top > rows else rows, max(count, 2 * columns) if count > columns else columns), np.uint8)
            grown[:rows, :columns] = self.has
            self.has, self.sizes = grown, np.pad(self.sizes, (0, grown.shape[1] - columns))
        self.has[numbers, np.arange(self.count, count)[:, None]] = 1
        self.has[0] = 0
        self.sizes[self.count : count] = np.count_nonzero(numbers, axis=1)
        self.count = count
        self.add(first, end, first >= 0, first >= 0)

    def close_to_any(self, words: np.ndarray, n: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each row of words (n of them) shares too many with any chosen span; the bounds of those that do are kept."""
        out = np.zeros(len(n), bool)
        if not self.count or not len(n):
            return out
        sizes, need = self.sizes[: self.count], np.array(self.needed(int(n.max())))
        parts, extensions = out.copy(), out.copy()
        for at in range(0, len(n), 256):
            w, m = words[at : at + 256], n[at : at + 256, None]
            shared = self.has[np.where(w < len(self.has), w, 0), : self.count].sum(axis=1, dtype=np.uint8)
            close = shared >= need[np.minimum(m, sizes)]
            out[at : at + 256] = close.any(axis=1)
            parts[at : at + 256] = (close & (shared == m)).any(axis=1)
            extensions[at : at + 256] = (close & (sizes <= m)).any(axis=1)
        self.add(first, end, parts & (first >= 0), extensions & (first >= 0))
        return out

    def add(self, first: np.ndarray, end: np.ndarray, parts: np.ndarray, extensions: np.ndarray) -> None:
        """Of the spans that `parts` and `extensions` tell, their parts or their extensions are refused from now on."""
        if parts.any():
            np.maximum.at(self.within, first[parts], end[parts])
            np.maximum.accumulate(self.within, out=self.within)
        if extensions.any():
            np.minimum.at(self.around, first[extensions], end[extensions])
            self.around = np.minimum.accumulate(self.around[::-1])[::-1]

    def refused(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return ((self.within[first] >= end) | (self.around[first] <= end)) & (first >= 0)
