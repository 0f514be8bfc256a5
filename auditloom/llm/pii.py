"""Problem 4: personal information in free text, by a character-level bidirectional LSTM with CRF transitions in numpy.

Every character of every text is tagged (B-, I- of each type, and O). A long text is cut into windows that overlap. Where windows
overlap, each character's tag scores come from the window in which it lies farther from an edge, and the best path over the whole text
gives its spans. Weights lie in pii.npz, made by train_pii.py.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.textnp import batches, category_table, code_points

TYPES = ("name", "email", "phone", "id_number", "address")
TAGS = 1 + 2 * len(TYPES)  # 0: outside; 1 + 2 t: begin; 2 + 2 t: inside
WEIGHTS = str(Path(__file__).with_name("pii.npz"))
WINDOW, OVERLAP = 960, 64
TOGETHER = 4096  # windows that are scored at once
COLUMNS = 224  # windows that go through the LSTM side by side, each followed by the next one of its column; more make products whose factors OpenBLAS copies first
STEPS = 16  # steps whose scores are put away at once
#: Placeholders that take the place of a span.
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]"}

CLASSES = 112
# Labels of numbers that identify no person.
NO_PERSON = re.compile(r"\b(?:invoice|lot|batch|serial|trial|protocol|sample|specimen|device|order|charge|chargen?-?nr|lote|facture|factura|rechnung)\b[^.;\n]{0,14}$", re.I)


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: 1-95 printable ASCII, then line end, other letters by case, digits, spaces, marks, the rest; 0 is padding."""
    category = category_table()
    table = np.full(0x110000, 104, np.uint8)
    table[category == ord("L")] = 97
    table[category == ord("N")] = 99
    table[category == ord("Z")] = 100
    table[category == ord("P")] = 101
    table[category == ord("M")] = 102
    table[category == ord("C")] = 103
    upper = np.fromiter((chr(c).isupper() for c in range(0x3000)), bool, 0x3000)
    table[:0x3000][upper] = 98
    for c in range(32, 127):
        table[c] = c - 31
    table[[10, 13, 0]] = 96
    table[9] = 1
    return table


def gate(x: np.ndarray) -> np.ndarray:
    """A sigmoid of straight pieces."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def columns_of(length: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column and first place of each window, size of each column): long windows first, each under the shortest column, one place between two."""
    column, place = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    heap = [(0, j) for j in range(min(columns, len(length)))]
    for i in np.argsort(-length, kind="stable").tolist():
        size, j = heap[0]
        column[i], place[i] = j, size
        heapq.heapreplace(heap, (size + int(length[i]) + 1, j))
    return column, place, np.array([size for size, _ in sorted(heap, key=lambda x: x[1])], np.int64)


def aligned(*shape: int) -> np.ndarray:
    """An array whose memory begins at a whole cache line, without which sums and products take up to twice the time."""
    n = int(np.prod(shape))
    room = np.zeros(n + 16, np.float32)
    at = -room.ctypes.data % 64 // 4
    return room[at : at + n].reshape(shape)


class Tagger:
    def __init__(self, path: str = WEIGHTS):
        with np.load(path) as f:
            p = {k: f[k].astype(np.float32) for k in f.files}
        H = self.hidden = p["wh0"].shape[0]
        # What a step reads of each column: the state, a 1, then what a class enters: 1 if it is padding, and its embedding.
        self.enter = np.vstack([np.arange(CLASSES) == 0, p["embed"].T]).astype(np.float32)
        # The gates lie one after the other; their slope and middle are part of the weights.
        slope, middle = np.repeat(np.float32([0.25, 1]), [3 * H, H]), np.repeat(np.float32([0.5, 0]), [3 * H, H])
        closed = np.repeat(np.float32([-1e6, 0]), [3 * H, H])  # after padding the state is 0
        self.step = aligned(2, 4 * H, H + 1 + len(self.enter))
        for d in (0, 1):
            self.step[d] = np.vstack([p[f"wh{d}"] * slope, p[f"b{d}"] * slope + middle, closed, p[f"wx{d}"] * slope]).T
        self.out = np.ascontiguousarray(np.concatenate([p["out"].reshape(2, H, TAGS), np.stack([p["out_bias"], 0 * p["out_bias"]])[:, None]], axis=1).swapaxes(1, 2))
        self.trans, self.first = p["trans"], p["first"]
        self.room = np.empty(0, np.float32)
        # What the transitions of a path can lose at most when tags of a span become "outside" (see tag).
        trans, inside = self.trans, np.arange(2, TAGS, 2)
        within, out, into_span = trans[1:, 1:], trans[1:, 0] - trans[0, 0], trans[0, 1:] - trans[0, 0]
        self.each = float(max(0, within.max() - trans[0, 0]))
        self.weak = self.each + float(max(0, into_span.max() + out.max()))
        left = (within.max(axis=1) - trans[1:, 0]).max()
        self.tail = float(left + max(0, out.max()))
        start = np.arange(TAGS)
        start[inside] -= 1  # an "inside" after an "outside" becomes "begin"
        again = trans[1:].max(axis=0) - trans[0, start] + np.maximum(0, (trans - trans[start]).max(axis=1))
        self.head = float(max(left, into_span.max()) + max(0, again[1:].max()))

    def emissions(self, windows: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tag scores of a batch: columns of windows (L, B) of classes, with a 0 between two of a column and 0 at its end, to (L, B, TAGS), which the next call overwrites."""
        places, B = windows.shape
        H = self.hidden
        L = -(-places // (2 * STEPS)) * 2 * STEPS
        classes = np.zeros((L, B), np.uint8)
        classes[:places] = windows
        if self.room.size < 2 * L * B * TAGS:
            self.room = np.empty(2 * L * B * TAGS, np.float32)
        half, scores = self.room[: 2 * L * B * TAGS].reshape(2, -1)
        half, scores = half.reshape(L, TAGS, B), scores.reshape(B, L * TAGS)
        # Numbers of a kind lie in one piece, (kind, direction, column), so that each operation is a single pass.
        x, z = aligned(self.step.shape[2], 2, B), aligned(4, H, 2, B)
        h, feed, read, gates, (enter, keep, leave, u) = x[:H], x[H + 1 :], x[: H + 1].swapaxes(0, 1), z[:3], z
        c, s, one = aligned(H, 2, B), aligned(H, 2, B), np.array(1, np.float32)
        low, high = aligned(3, H, 2, B), aligned(3, H, 2, B)  # arrays, as maximum and minimum are slow with a number
        x[H] = high[:] = one
        parts, whole = aligned(2, STEPS, TAGS, B), aligned(STEPS, TAGS, B)
        given, made = x.swapaxes(0, 1), z.reshape(4 * H, 2, B).swapaxes(0, 1)
        for a in range(0, L, STEPS):
            forward, backward = slice(a, a + STEPS), slice(L - a - STEPS, L - a)
            rows = np.stack([classes[forward], classes[backward][::-1]], axis=1, dtype=np.intp)
            for t in range(STEPS):
                self.enter.take(rows[t], axis=1, out=feed, mode="wrap")
                np.matmul(self.step, given, out=made)
                np.maximum(np.minimum(gates, high, out=gates), low, out=gates)
                np.divide(u, np.add(np.abs(u, out=s), one, out=s), out=s)
                np.multiply(s, enter, out=s)
                np.add(np.multiply(c, keep, out=c), s, out=c)
                np.divide(c, np.add(np.abs(c, out=s), one, out=s), out=s)
                np.multiply(leave, s, out=h)
                np.matmul(self.out, read, out=parts[:, t])
            # Each place is reached by one direction, later by the other.
            for at, part in ((forward, parts[0]), (backward, parts[1, ::-1])):
                if a < L // 2:
                    half[at] = part
                else:
                    np.add(half[at], part, out=whole)
                    scores[:, at.start * TAGS : at.stop * TAGS] = whole.reshape(-1, B).T
        return scores.reshape(B, L, TAGS).swapaxes(0, 1)[:places]

    def viterbi(self, scores: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best tags (L, B) of scores (L, B, TAGS)."""
        L, B, _ = scores.shape
        best, other = np.empty((L, TAGS, B), np.float32), np.empty((TAGS, B), np.float32)
        best[0] = scores[0].T + self.first[:, None]
        on = np.arange(L)[:, None] < length
        whole = on.all(axis=1)
        for t in range(1, L):
            top = np.add(best[t - 1, 0], self.trans[0][:, None], out=best[t])
            for j in range(1, TAGS):
                np.maximum(top, np.add(best[t - 1, j], self.trans[j][:, None], out=other), out=top)
            top += scores[t].T
            if not whole[t]:
                np.copyto(top, best[t - 1], where=~on[t])
        tags = np.zeros((L, B), np.int8)
        tag = best[-1].argmax(axis=0)
        into = np.ascontiguousarray(self.trans.T)
        for t in range(L - 1, -1, -1):
            tags[t] = tag
            if t:
                tag = np.where(on[t], (best[t - 1].T + into[tag]).argmax(axis=1), tag)
        return tags

    def scores(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tag scores (code points, TAGS) of the texts cps[start:end]."""
        step = WINDOW - OVERLAP
        pieces = np.maximum(-(-(end - start - OVERLAP) // step), end > start)
        of = np.repeat(np.arange(len(start)), pieces)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a = start[of] + k * step
        b = np.minimum(a + WINDOW, end[of])
        low, high = np.where(k > 0, a + OVERLAP // 2, a), np.where(k < pieces[of] - 1, b - OVERLAP // 2, b)
        classes = char_classes()[cps]
        scores = np.zeros((len(cps), TAGS), np.float32)
        for i in range(0, len(of), TOGETHER):
            group = slice(i, i + TOGETHER)
            column, place, size = columns_of((b - a)[group], COLUMNS)
            windows = np.zeros((int(size.max()), len(size)), np.uint8, order="F")
            for j, p, s, e in zip(column.tolist(), place.tolist(), a[group].tolist(), b[group].tolist()):
                windows[p : p + e - s, j] = classes[s:e]
            found = self.emissions(windows, size)
            for j, p, at, s, e in zip(column.tolist(), place.tolist(), a[group].tolist(), low[group].tolist(), high[group].tolist()):
                scores[s:e] = found[p + s - at : p + e - at, j]
        return scores

    def tag(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The tag of every code point on the best path of each text cps[start:end]."""
        tags = np.zeros(len(cps), np.int8)
        scores = self.scores(cps, start, end)
        # By how much "outside" leads, and by how much an "inside" leads its "begin".
        lead, drop = np.empty(len(cps), np.float32), np.empty(len(cps), np.float32)
        for i in range(0, len(cps), 4096):
            part = np.ascontiguousarray(scores[i : i + 4096].T)
            np.subtract(part[0], part[1:].max(axis=0), out=lead[i : i + 4096])
            np.maximum((part[2::2] - part[1::2]).max(axis=0), 0, out=drop[i : i + 4096])
        # A span of a best path has a place where "outside" leads weakly (or an end of the text), and reaches beyond its outermost such places, and
        # over the room between two, only as far as the leads don't add up to more than the transitions and a new "begin" cost: else the path
        # with "outside" there were better. All other places are "outside", and the path is sought between them.
        weak = lead <= self.weak
        weak[start[end > start]] = weak[end[end > start] - 1] = True
        lead -= self.each
        lead[weak] = 0
        total = np.zeros(len(cps) + 1)
        np.cumsum(lead, dtype=np.float64, out=total[1:])
        at = np.flatnonzero(weak)
        of = np.searchsorted(start, at, "right") - 1
        at, of = at[at < end[of]], of[at < end[of]]
        first = np.maximum(np.searchsorted(total, total[at] - self.head - drop[at]), start[of])
        last = np.minimum(np.searchsorted(total, total[at + 1] + self.tail, "right") - 1, end[of])
        first, last = np.minimum.accumulate(first[::-1])[::-1], np.maximum.accumulate(last)
        apart = first[1:] > last[:-1]
        a, b = first[np.append(True, apart)[: len(first)]], last[np.append(apart, True)[: len(last)]]
        of = np.searchsorted(start, a, "right") - 1
        opened, closed = a > start[of], b < end[of]
        a, b = a - opened, b + closed
        order = np.argsort(a - b, kind="stable")
        while len(order):
            # stretches of about the same length, so that padding is a small part
            longest = int(b[order[0]] - a[order[0]])
            size = min(max(1, 1_000_000 // longest), int(np.searchsorted((a - b)[order], 4 - longest * 4 // 5, "right")))
            rows, order = order[: max(1, size)], order[max(1, size) :]
            n = (b - a)[rows]
            place = np.arange(int(n.max()))[:, None]
            at = a[rows] + place
            part = scores.take(at, axis=0, mode="clip")
            part[0, opened[rows], 1:] = part[(n - 1)[closed[rows]], np.flatnonzero(closed[rows]), 1:] = -1e6
            found = self.viterbi(part, n)
            tags[at[place < n]] = found[place < n]
        return tags

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, type number, start, end) of all spans, in order; positions in code points of the text."""
        cps, text_start = code_points(texts)
        return spans_of(self.tag(cps, text_start[:-1], text_start[1:] - 1), cps, text_start)


def spans_of(tags: np.ndarray, cps: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of tags, moved to the ends of the words that they cut, without blanks at their ends.

    An initial right before a name belongs to it, and a bracket around a number doesn't.
    """
    kind = (tags + np.int8(1)) >> 1  # 0: outside, else type + 1
    change = np.diff(kind, prepend=np.int8(0), append=np.int8(0)) != 0
    begins = (kind > 0) & ((tags & 1 == 1) | change[:-1])
    ends = (kind > 0) & (change[1:] | np.append(begins[1:], True))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    kinds = kind[start].astype(np.int64) - 1
    category = category_table()[cps]
    letter = (category == ord("L")) | (category == ord("N"))
    begin = start.copy()
    for i in range(len(start)):
        s, e = int(start[i]), int(end[i])
        low = int(end[i - 1]) if i else 0
        while s > low and letter[s] and letter[s - 1]:
            s -= 1
        while s < e and not letter[s] and cps[s] not in (40, 43):  # "(" and "+" begin telephone numbers
            s += 1
        while e < len(cps) and letter[e - 1] and letter[e] and not (i + 1 < len(start) and e >= start[i + 1]):
            e += 1
        if kinds[i] == 0 and s - low >= 3 and cps[s - 1] == 32 and cps[s - 2] == 46 and 65 <= cps[s - 3] <= 90 and (s == 3 or cps[s - 4] in (0, 10, 32, 40)):
            s -= 3
        if kinds[i] == 2:
            close = np.flatnonzero(cps[s:e] == 41)
            area = close.size and ((cps[s : s + close[0]] >= 48) & (cps[s : s + close[0]] <= 57)).sum() <= 5  # "(030) 1234"
            if cps[s] == 40 and not area:
                s += 1
            elif area and cps[s] != 40 and s > low and cps[s - 1] == 40:
                s -= 1
        if kinds[i] == 3 and NO_PERSON.search("".join(map(chr, cps[max(low, s - 24) : s]))):
            e = s
        begin[i], end[i] = s, e
    real = end - begin >= np.array([2, 6, 6, 4, 6])[kinds]
    begin, end, kinds = begin[real], end[real], kinds[real]
    doc = np.searchsorted(text_start, begin, "right") - 1
    return doc, kinds, begin - text_start[doc], end - text_start[doc]


@functools.cache
def tagger(path: str) -> Tagger:
    """One tagger a Python worker."""
    return Tagger(path)


def find_personal(df: DataFrame, key: str = "doc_id", text: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(key, pii_type, start_pos BIGINT, end_pos BIGINT) of every span; texts without any, null and empty ones have no row."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger(weights)
        names = np.array(TYPES)
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches(texts):
                doc, kind, start, end = own.spans(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + a)), pa.array(names[kind].tolist(), pa.string()), pa.array(start), pa.array(end)], names=[key, "pii_type", "start_pos", "end_pos"])

    return df.where(F.length(text) > 0).select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, pii_type string, start_pos bigint, end_pos bigint")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(key, text, spans INT): every text with its spans replaced by typed placeholders; all else is unchanged, null stays null."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger(weights)
        for batch in stream:
            given = batch.column(1).to_pylist()
            texts = [t or "" for t in given]
            out, counts = list(given), np.zeros(len(texts), np.int32)
            for a, b in batches(texts):
                for d, k, s, e in list(zip(*(x.tolist() for x in own.spans(texts[a:b]))))[::-1]:
                    out[a + d] = out[a + d][:s] + PLACEHOLDERS[TYPES[k]] + out[a + d][e:]
                    counts[a + d] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(counts)], names=[key, text, "spans"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {text} string, spans int")
