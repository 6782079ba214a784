"""Words of many texts at once, as numpy arrays: places and 64-bit hashes without a Python loop over words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Code points handled together: the arrays of one block stay within the processor's caches.
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
#: The sign behind the end of a text, greater than any hash but itself.
FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words(NamedTuple):
    """Word i of a block lies in text ``doc[i]`` at code points ``start[i]`` to ``end[i]``; ``first[d]`` is text d's first word.

    ``points`` are the code points of the texts, one line break between them, text d's from ``offset[d]`` on.
    """

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    points: np.ndarray
    offset: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For the first 65,536 code points: 0 no word, 1 word character, 2 a word of its own; and the lower case."""
    kind, lower = np.zeros(65536, np.uint8), np.arange(65536, dtype=np.uint64)
    for i in range(65536):
        c = chr(i)
        if c.isalnum() or unicodedata.category(c) in ("Mn", "Mc"):
            kind[i] = 2 if 0x3040 <= i <= 0x30FF or 0x3400 <= i <= 0x9FFF else 1
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
    return kind, lower


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    return up[:n], down[:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for every span, equal for equal spans wherever they lie."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def scan(texts: Sequence[str]) -> Words:
    """Words are runs of letters, digits and their marks, in lower case; each ideograph or kana is a word."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(lengths + 1) - lengths - 1
    kinds, lowers = _tables()
    if len(points) and points.max() >= 65536:
        small = np.minimum(points, 65535)
        kind = np.where(points < 65536, kinds[small], np.uint8(1))
        lower = np.where(points < 65536, lowers[small], points.astype(np.uint64))
    else:
        kind, lower = kinds[points], lowers[points]
    edge = np.zeros(len(kind) + 1, bool)  # where the kind changes, and around every word of its own
    if len(kind):
        edge[0] = edge[-1] = True
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cuts = np.flatnonzero(edge)
    is_word = kind[cuts[:-1]] > 0 if len(cuts) else np.zeros(0, bool)
    start, end = cuts[:-1][is_word], cuts[1:][is_word]
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1), "left")
    return Words(doc, start - offsets[doc], end - offsets[doc], span_hash(lower, start, end), first, points, offsets)


def blocks(texts: Sequence[str | None], size: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """The texts in order, in blocks of about ``size`` code points, each with the number of its first text; null is empty."""
    at, held, total = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and total + len(text) > size:
            yield at, held
            at, held, total = i, [], 0
        held.append(text)
        total += len(text)
    if held:
        yield at, held


def anchors(hashes: np.ndarray, span: int, inside: bool = False) -> np.ndarray:
    """Places of words that are the smallest of some ``span`` consecutive ones; ``inside``: of such that end in the array.

    Both a text and the item inside it choose the same places, at least one in every ``span`` words.
    """
    if inside and len(hashes) < span:
        return np.arange(len(hashes))
    edge = np.full(span - 1, FAR)
    x = hashes if inside else np.concatenate([edge, hashes, edge])
    low = _rolling(x, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    high = _rolling(np.concatenate([pad, low, pad]), span, np.maximum)  # for each word the greatest minimum around it
    high = high[: len(x)]
    places = np.flatnonzero(high == x)
    return places if inside else places[(places >= span - 1) & (places < span - 1 + len(hashes))] - (span - 1)


def _rolling(x: np.ndarray, span: int, least) -> np.ndarray:
    """Minimum or maximum of every ``span`` consecutive numbers, by doubling."""
    out, width = x, 1
    while width < span:
        step = min(width, span - width)
        out = least(out[:-step], out[step:])
        width += step
    return out


class Numbering:
    """Numbers 0, 1, 2… for 64-bit hashes in order of arrival; whole arrays are looked up and added by open addressing."""

    def __init__(self):
        self.count, self.bits = 0, 12
        self._empty()

    def _empty(self):
        self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        slot = self._slot(keys)
        out = self.numbers[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            out[open_] = self.numbers[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number distinct unknown keys in their order."""
        numbers = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            old = self.numbers >= 0
            keys, numbers = np.concatenate([self.keys[old], keys]), np.concatenate([self.numbers[old], numbers])
            self.bits = max(self.bits + 1, (2 * self.count).bit_length())
            self._empty()
        slot = self._slot(keys)
        while len(keys):
            free = self.numbers[slot] < 0
            at, pick = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[pick]
            self.keys[at], self.numbers[at] = keys[won], numbers[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, numbers, slot = keys[left], numbers[left], (slot[left] + 1) & (len(self.keys) - 1)
