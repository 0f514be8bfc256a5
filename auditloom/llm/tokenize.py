"""Problem 8: encoding with a public byte-level BPE vocabulary.

Boundaries of the pre-tokens are found without a regex: every code point becomes a symbol, every symbol a
function on the states of a small automaton, and an associative scan over these functions (composition is a
table look-up, since the functions generated by the symbols are few) gives the state before each code point.
The slices between boundaries are merged pair by pair once and then come from a cache.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditloom.llm.textnp import batches, category_table, code_points

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("AUDITLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Symbols; APOS2 and APOS3 begin a contraction of two or three code points.
LETTER, NUMBER, OTHER, SPACE, BLANK, END, APOS2, APOS3 = range(8)
# States: what the code point before belongs to. TAIL1 and TAIL2: so many code points of a contraction are left.
S_CUT, S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_BLANK, S_TAIL1, S_TAIL2 = range(8)

# The Unicode white space and the contractions of the vocabulary's pre-tokeniser.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def symbol_table() -> np.ndarray:
    category = category_table()
    table = np.full(0x110000, OTHER, np.uint8)
    table[category == ord("L")] = LETTER
    table[category == ord("N")] = NUMBER
    table[WHITE] = BLANK
    table[32] = SPACE
    return table


def _step(state: int, symbol: int) -> int:
    if symbol == END:
        return S_CUT
    if state == S_TAIL2:
        return S_TAIL1
    if state == S_TAIL1:
        return S_CUT
    if symbol in (APOS2, APOS3):
        opened = state not in (S_OTHER, S_SPACE)
        return (S_TAIL1 if symbol == APOS2 else S_TAIL2) if opened else S_OTHER
    return {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER, SPACE: S_SPACE, BLANK: S_BLANK}[symbol]


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, state that each function makes of S_CUT)."""
    functions = [tuple(_step(s, x) for s in range(8)) for x in range(8)]
    known = {tuple(range(8)): 0}
    for f in functions:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in functions:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    every = list(known)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint8 if len(every) < 256 else np.uint16)
    return np.array([known[f] for f in functions], compose.dtype), compose, np.array([f[S_CUT] for f in every], np.uint8)


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked scan of composed transition functions."""
    of_symbol, compose, from_cut = monoid()
    n = len(symbols)
    width = max(1, int(np.sqrt(n / 2)))
    lanes = -(-n // width)
    grid = np.zeros(lanes * width, compose.dtype)  # 0 is the identity
    grid[:n] = of_symbol[symbols]
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
    for j in range(1, width):  # prefix within each lane, all lanes at once
        grid[j] = compose[grid[j - 1], grid[j]]
    carry = np.zeros(lanes, compose.dtype)
    for k, f in enumerate(grid[-1][:-1].tolist(), 1):  # the lanes' totals
        carry[k] = compose[carry[k - 1], f]
    after = from_cut[compose[carry[None, :], grid]].T.reshape(-1)[:n]
    return np.concatenate([np.zeros(1, np.uint8), after[:-1]])


def boundaries(cps: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every pre-token, as positions in ``cps`` (texts as made by ``code_points``)."""
    symbols = symbol_table()[cps]
    symbols[text_start[1:] - 1] = END
    at = np.flatnonzero(cps == 39)
    at = at[symbols[at] == OTHER]
    if len(at):
        padded = np.concatenate([cps, np.zeros(2, np.uint32)])
        for tail in CONTRACTIONS:
            hit = at[np.logical_and.reduce([padded[at + 1 + j] == ord(c) for j, c in enumerate(tail)])]
            symbols[hit] = APOS2 if len(tail) == 1 else APOS3
    before = states_before(symbols)
    kind = np.where(symbols >= APOS2, np.uint8(OTHER), symbols)
    following = np.concatenate([kind[1:], np.full(1, END, np.uint8)])
    white = (kind == SPACE) | (kind == BLANK)
    begins = np.where(
        white,
        ((before != S_SPACE) & (before != S_BLANK)) | (following < SPACE),
        (before != kind + 1) & (before != S_SPACE) & (before != S_TAIL1) & (before != S_TAIL2),
    )
    begins[kind == END] = True
    start = np.flatnonzero(begins)
    end = np.concatenate([start[1:], [len(cps)]])
    real = kind[start] != END
    return start[real], end[real]


class Encoder:
    """Pair merging by rank, cached by slice; ``cache_size`` bounds the cache of each worker."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, cache_size: int = 400_000):
        with open(os.path.join(folder, vocabulary), "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.piece = {b: a for a, b in self.rank.items()}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_size = cache_size

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the adjacent pair of least rank, leftmost first, is joined until none is known."""
        if (whole := self.rank.get(piece)) is not None:
            return (whole,)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(parts) and (r := self.rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return tuple(self.rank[p] for p in parts if p is not None)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text, for each id the code point in its text where its slice starts)."""
        ids, counts, offsets = [], [], []
        for a, b in batches(texts):
            cps, text_start = code_points(texts[a:b])
            start, end = boundaries(cps, text_start)
            joined = "\0".join(texts[a:b])
            pieces = [joined[i:j] for i, j in zip(start.tolist(), end.tolist())]
            for p in set(pieces).difference(self.cache):
                self.cache[p] = self.merge(p.encode("utf-8", "surrogatepass"))
            found = [self.cache[p] for p in pieces]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            doc = np.searchsorted(text_start, start, "right") - 1
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum())))
            counts.append(np.bincount(doc, weights=lengths, minlength=b - a).astype(np.int64))
            offsets.append(np.repeat(start - text_start[doc], lengths))
            if len(self.cache) > self.cache_size:
                self.cache.clear()
        empty = np.zeros(0, np.int64)
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([empty, *counts]), np.concatenate([empty, *offsets])

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.piece[i] for i in ids).decode("utf-8", "replace")


@functools.cache
def encoder(folder: str, vocabulary: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(folder, vocabulary)


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row; with ``offsets`` also the code point where each id's slice starts.

    Null and empty texts have the empty list. No shuffle: each Arrow batch is encoded where it is read.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if offsets:
        schema = schema.add("offsets", T.ArrayType(T.LongType()))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts, places = own.encode_batch(texts)
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(ids))]
            if offsets:
                columns.append(pa.ListArray.from_arrays(bounds, pa.array(places)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens INT) of every row; 0 for null and empty texts."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.IntegerType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for batch in stream:
            _, counts, _ = own.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int32))], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
