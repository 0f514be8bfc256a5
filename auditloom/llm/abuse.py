"""Problem 10: abusive, hateful and sexually explicit passages, by a convolutional classifier in numpy.

A sentence is a row of words; a word's vector is the sum of the hashed embeddings of the word and its character
trigrams, so that disguised spellings stay near the plain ones. Filters of several widths slide over the words, the largest
response of each counts, and a logistic layer gives the sentence's score. A document's score is that of its worst
sentence. Weights and the thresholds by language lie in abuse.npz, made by train_abuse.py.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.pairs import language
from auditloom.llm.textnp import batches, run_hash

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 13, 16, (1, 2, 3, 4), 16
WEIGHTS = str(Path(__file__).with_name("abuse.npz"))
MAX_WORDS = 60  # of a sentence in training
LINE, TEXT = "\x01", "\x02"  # tokens that stand for line and text ends

# Characters that stand for letters in disguised words, and characters that show nothing.
STANDS_FOR = str.maketrans({"$": "s", "@": "a", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "l", "€": "e"})
UNSEEN = re.compile("[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤︀-️﻿]")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._\-*]){2,}[^\W\d_](?![^\W_])")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
RESIDUE = frozenset(("null", "nan", "none", "undefined", "nbsp", "object"))  # fixed values: machine residue
TOKEN = re.compile(r"[^\s\"“”„«»()\[\]{}<>,;:?…/\\=+~^`]+")
ENDS = re.compile(r"[.!?…][\"'”’)\]]*$")
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE_END.split(text) if s]


def clean(sentence: str) -> str:
    """Lower case without invisible characters; letters that stand apart are joined, long repetitions cut."""
    s = UNSEEN.sub("", unicodedata.normalize("NFKC", sentence)).lower().replace("’", "'")
    s = SPACED.sub(lambda m: re.sub(r"[ ._\-*]", "", m[0]), s).replace("_", " ")
    return REPEATED.sub(r"\1", s)


def word_form(token: str) -> str:
    """The word that a token is read as; numbers and codes are all alike, symbols without a letter are no word."""
    token = token.strip(".!'-_*#")
    if token in RESIDUE:
        return "#"
    if not token or token.isalpha():
        return token
    digits = sum(map(str.isdigit, token))
    if len(token) > 40 or (digits > 0.55 * len(token) and not re.search(r"[$@]", token)):
        return "#"
    if not any(map(str.isalnum, token)) or len(re.findall(r"[^\w'-]", token)) > 0.6 * len(token):
        return ""
    return token.translate(STANDS_FOR)


def tokens(sentence: str) -> list[str]:
    return [w for t in TOKEN.findall(clean(sentence)) if (w := word_form(t))]


def word_features(word: str) -> list[int]:
    """Rows of the embedding table: one for the word, one for each character trigram ('*' matches no letter)."""
    padded = f"<{word}>"
    grams = {padded[i : i + 3] for i in range(len(padded) - 2)} if len(word) < 40 else set()
    return [_hash("w" + word), *(BUCKETS + _hash(g) for g in sorted(grams))]


def _hash(s: str) -> int:
    h = 2166136261
    for b in s.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    h ^= h >> 15
    return h % BUCKETS


class Classifier:
    """Scores texts; ``cache_size`` bounds the tokens and words that a worker keeps."""

    def __init__(self, path: str = WEIGHTS, cache_size: int = 400_000):
        with np.load(path) as f:
            self.table = f["table"].astype(np.float32)
            gap = max(WIDTHS)
            # all filters as one matrix over max(WIDTHS) consecutive words
            self.filters = np.zeros((gap * DIM, FILTERS * len(WIDTHS)), np.float32)
            for i, k in enumerate(WIDTHS):
                self.filters[: k * DIM, i * FILTERS : (i + 1) * FILTERS] = f[f"w{k}"].astype(np.float32).reshape(k * DIM, FILTERS)
            self.bias = np.concatenate([f[f"b{k}"].astype(np.float32) for k in WIDTHS])
            self.out, self.out_bias = f["out"].astype(np.float32), float(f["out_bias"])
            self.thresholds = dict(zip(f["languages"].tolist(), f["thresholds"].tolist()))
        self.cache_size = cache_size
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((1 << 12, DIM), np.float32)  # row 0: no word
        self.read: dict[str, tuple[int, ...]] = {LINE: (-1,), TEXT: (-2,)}

    def _word(self, word: str) -> int:
        row = self.known.get(word)
        if row is None:
            row = self.known[word] = len(self.known) + 1
            if row == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[row] = self.table[word_features(word)].sum(axis=0)
        return row

    def _token(self, token: str) -> tuple[int, ...]:
        """The words of a token, and -1 after them if a sentence ends there."""
        words = tuple(self._word(w) for w in tokens(token))
        return (*words, -1) if ENDS.search(token) else words

    def _words(self, texts: list[str]) -> np.ndarray:
        """Word rows of all texts, -1 at sentence ends and -2 at text ends."""
        split = f" {TEXT} ".join(texts).replace("\n", f" {LINE} ")
        split = SPACED.sub(lambda m: re.sub(r"[ ._\-*]", "", m[0]), UNSEEN.sub("", split)).split()
        split.append(TEXT)
        if len(self.read) > self.cache_size or len(self.known) > self.cache_size:
            self._forget()
        for t in set(split).difference(self.read):
            self.read[t] = self._token(t)
        found = [self.read[t] for t in split]
        return np.fromiter(itertools.chain.from_iterable(found), np.int64)

    def score_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score, threshold) of each text: of its worst sentence, and of that sentence's language."""
        score, limit = np.zeros(len(texts)), np.full(len(texts), self.thresholds["any"])
        for a, b in batches(texts, 1 << 20):
            part = [t.replace(TEXT, " ").replace(LINE, " ") for t in texts[a:b]]
            ids = self._words(part)
            text_of = np.cumsum(ids == -2)
            text_of -= ids == -2
            ends = ids < 0
            sentence = np.cumsum(ends) - ends
            real = np.flatnonzero(~ends)
            if not len(real):
                continue
            number, first, length = np.unique(sentence[real], return_index=True, return_counts=True)
            of_text = text_of[real[first]]
            # equal sentences are scored once
            key = run_hash(ids[real], first, first + length)
            _, shown, back = np.unique(key, return_index=True, return_inverse=True)
            p = self._scores(ids[real], first[shown], length[shown])[back]
            order = np.lexsort((-p, of_text))
            lead = order[np.concatenate([[True], of_text[order][1:] != of_text[order][:-1]])]
            score[a + of_text[lead]] = p[lead]
            for i in lead[p[lead] > 0.05].tolist():
                words = ids[real][first[i] : first[i] + length[i]]
                limit[a + of_text[i]] = self._threshold(words)
        return score, limit

    def _threshold(self, rows: np.ndarray) -> float:
        if len(self.names) != len(self.known):
            self.names = dict(zip(self.known.values(), self.known))
        lang, _ = language(" ".join(self.names[r] for r in rows.tolist()))
        return self.thresholds.get(lang or "", self.thresholds["any"])

    names: dict[int, str] = {}

    def sentence_scores(self, rows: list[list[str]]) -> np.ndarray:
        """The probability of each row of words (for training)."""
        ids = np.array([self._word(w) for r in rows for w in r], np.int64)
        length = np.array([len(r) for r in rows], np.int64)
        return self._scores(ids, np.cumsum(length) - length, length)

    def _scores(self, ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The probability of each sentence ids[first:first+length]; sentences have at least one word."""
        out = np.zeros(len(first))
        gap = max(WIDTHS) - 1
        bounds = np.searchsorted(np.cumsum(length + gap), np.arange(0, int((length + gap).sum()), 1 << 16))
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(first)]):
            if a == b:
                continue
            n = length[a:b]
            start = np.cumsum(n + gap) - n - gap
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.zeros(int((n + gap).sum()) + gap, np.int64)
            row[np.repeat(start, n) + offset] = ids[np.repeat(first[a:b], n) + offset]
            x = self.vectors[row]
            wide = np.lib.stride_tricks.as_strided(x, (len(x) - gap, (gap + 1) * DIM), (x.strides[0], x.strides[1]))
            y = np.ascontiguousarray(wide) @ self.filters
            # a filter's last places lie past the sentence's end, on empty words; as in training, it may begin at any word
            place = np.zeros(len(y), bool)
            place[np.repeat(start, n) + offset] = True
            y = y[place]
            top = np.maximum.reduceat(y, np.cumsum(n) - n, axis=0) + self.bias
            z = np.maximum(top, 0) @ self.out + self.out_bias
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


@functools.cache
def classifier(path: str) -> Classifier:
    """One classifier a Python worker."""
    return Classifier(path)


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: str = WEIGHTS) -> DataFrame:
    """(key, source, score DOUBLE, abusive BOOLEAN) of every row; null, empty and blank texts have score 0.

    abusive: the score reaches the threshold of the worst sentence's language. A null source stays null.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, source)}

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classifier(weights)
        for batch in stream:
            score, limit = own.score_texts([t or "" for t in batch.column(2).to_pylist()])
            over = score >= limit
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array(over)], names=[key, source, "score", "abusive"])

    return df.select(key, source, text).mapInArrow(run, f"{key} {kinds[key]}, {source} {kinds[source]}, score double, abusive boolean")


def source_rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """(source, documents, abusive, rate, mean_score) of every source; null sources are one row."""
    hit = F.sum(F.col("abusive").cast("long"))
    return scored.groupBy(source).agg(F.count("*").alias("documents"), hit.alias("abusive"), (hit / F.count("*")).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
