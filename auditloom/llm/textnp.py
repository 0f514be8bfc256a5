"""Texts as numpy arrays: code points, words and their hashes, for whole Arrow batches at once."""

from __future__ import annotations

import functools
import itertools
import unicodedata

import numpy as np

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one 0, and the start of each text (with the end as last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    starts[1:] = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    joined = "\0".join(texts) + "\0" if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


@functools.cache
def word_table() -> np.ndarray:
    """True for the code points that words consist of: Unicode letters and digits."""
    return np.strings.isalnum(np.arange(0x110000, dtype=np.uint32).view("U1"))


@functools.cache
def category_table() -> np.ndarray:
    """First letter of the Unicode category of each code point, as a byte."""
    return np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)


@functools.cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, 0x5851F42D4C957F2D, U64)]))


class Words:
    """Maximal runs of letters or digits of the lower-cased texts.

    start, end: positions in cps; doc: number of the text; key: 64-bit hash of the word; first: number of the
    first word of each text, with the total as last.
    """

    def __init__(self, texts: list[str]):
        self.cps, self.text_start = code_points([t.lower() for t in texts])
        inside = word_table()[self.cps]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.key = run_hash(self.cps, self.start, self.end)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each run of k consecutive words, in order; repeated runs are repeated."""
        n = len(self.key) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            h = np.zeros(n, U64)
            for j in range(k):
                h = mix(h ^ self.key[j : n + j])
        keep = self.doc[:n] == self.doc[k - 1 :]
        return h[keep], self.doc[:n][keep]


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice values[start:end] (slices in order, not empty, not overlapping)."""
    if not len(start):
        return np.zeros(0, U64)
    length = end - start
    with np.errstate(over="ignore"):
        at = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        offset = at - np.repeat(start, length)
        terms = (values[at].astype(U64) + U64(1)) * _powers(max(1 << 14, 1 << int(length.max()).bit_length()))[offset]
        sums = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(length)[:-1]]))
    return mix(sums ^ mix(length.astype(U64)))


def batches(texts: list[str], limit: int = 1 << 21):
    """(from, to) ranges of texts that hold about ``limit`` code points each; a longer text is alone."""
    a = size = 0
    for b, t in enumerate(itertools.chain(texts)):
        if size and size + len(t) > limit:
            yield a, b
            a, size = b, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)
