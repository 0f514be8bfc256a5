"""Problem 7: statistics of every text, their place in the distribution of their language, and the kind of text.

The statistics are counted for whole Arrow batches in numpy. For each language and statistic a mergeable KLL sketch is
built over all documents (one sketch a partition and language, merged after; the sketches' size is bounded),
and every value becomes a percentile and a robust z-score (distance from the median in units of the
normalised interquartile range). These are reported; the kind of a document depends on its own shares of prose and of
other kinds of lines only, so that the rest of its language can't change it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.config import cut_lineage
from auditloom.llm.textnp import Words, batches, category_table, run_hash

STATISTICS = ("n_words", "mean_word_len", "symbol_ratio", "punct_line_share", "common_share", "prose_share", "list_share", "table_share", "junk_share")
#: Below this percentile or above 100 - TAIL a value is in the tail of its language's distribution.
TAIL = 1
SHORT_LINE, LONG_WORD = 90, 40


def _sums(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of flags from each start to the next (the last to the end)."""
    return np.add.reduceat(flags, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)


def _has(cps: np.ndarray, chars: str) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in chars]] = True
    return table[cps]


def statistics(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text; common: sorted hashes of the common words of all languages."""
    w = Words(texts)
    cps, n_texts = w.cps, len(texts)
    category = category_table()[cps]
    newline = (cps == 10) | (cps == 0)
    blank = _has(cps, " \t\r\n\0\x0b\x0c ​﻿")
    visible = ~blank
    letter, digit = category == ord("L"), category == ord("N")
    symbol = visible & ~letter & ~digit & (category != ord("M"))
    stop = _has(cps, ".!?…。！？")
    following = np.concatenate([cps[1:], np.zeros(1, np.uint32)])
    before = np.concatenate([np.zeros(1, np.uint32), cps[:-1]])

    # lines
    line_start = np.concatenate([[0], np.flatnonzero(newline)[:-1] + 1]) if len(cps) else np.zeros(0, np.int64)
    line_doc = np.searchsorted(w.text_start, line_start, "right") - 1
    line_chars = _sums(visible, line_start)
    line_end = np.concatenate([line_start[1:], [len(cps)]]) if len(cps) else line_start
    at = np.where(visible, np.arange(len(cps)), -1)
    last = np.maximum.reduceat(at, line_start) if len(cps) else np.zeros(0, np.int64)
    filled = line_chars > 0
    closed = filled & (stop | _has(cps, ":;,\"'”’)»"))[last]
    sentence_end = filled & (stop | _has(cps, "\"'”’)»") & np.concatenate([[False], stop[:-1]]))[last] if len(cps) else closed
    line_len = line_end - line_start
    field = [
        _sums(cps == 9, line_start),
        _sums(cps == ord("|"), line_start),
        _sums(cps == ord(";"), line_start),
        _sums((cps == ord(",")) & ((before == 34) | (following != 32)), line_start),
        _sums((cps == 32) & (following == 32) & (before != 32) & (before != 10) & (before != 0), line_start),
    ]
    # a row has fields, and a neighbouring line has about as many by the same separator
    row = np.zeros(len(line_start), bool)
    for f in field:
        alike = (f[1:] >= 2) & (f[:-1] >= 2) & (np.abs(f[1:] - f[:-1]) <= 1) & (line_doc[1:] == line_doc[:-1])
        row[1:] |= alike
        row[:-1] |= alike
    row &= ~((field[3] >= 2) & reduce(np.logical_and, [f < 2 for f in (field[0], field[1], field[2], field[4])]) & sentence_end)

    # segments: lines, divided after sentence ends
    cut = newline.copy()
    cut |= stop & _has(following, " \t\r")
    seg_start = np.concatenate([[0], np.flatnonzero(cut)[:-1] + 1]) if len(cps) else np.zeros(0, np.int64)
    seg_line = np.searchsorted(line_start, seg_start, "right") - 1
    chars = _sums(visible, seg_start)
    word_seg = np.searchsorted(seg_start, w.start, "right") - 1
    length = w.end - w.start
    n_seg = len(seg_start)
    by_seg = lambda x: np.bincount(word_seg, weights=x, minlength=n_seg)[:n_seg]
    words, longest = by_seg(np.ones(len(length))), np.zeros(n_seg, np.int64)
    np.maximum.at(longest, word_seg, length)
    is_common = common[np.minimum(np.searchsorted(common, w.key), len(common) - 1)] == w.key if len(common) else np.zeros(len(length), bool)
    hits = by_seg(is_common & (length > 1))
    letters, digits, symbols = _sums(letter, seg_start), _sums(digit, seg_start), _sums(symbol, seg_start)
    vowels = _sums(_has(cps, "aeiouyäöüáéíóúàèìòùâêîôûëïÿœæåø"), seg_start)
    latin = _sums(letter & (cps < 0x250), seg_start)
    broken = _sums(((cps == 0xC2) | (cps == 0xC3) | (cps == 0xE2) | (cps == 0xE3)) & (following >= 0x80) & (following < 0x2100) & ~_has(following, "’“”"), seg_start)
    broken += _sums((cps == 0xFFFD) | ((cps > 0x7F) & (cps < 0xA0)), seg_start)
    with np.errstate(all="ignore"):
        size = np.maximum(chars, 1)
        in_row = row[seg_line] if n_seg else np.zeros(0, bool)
        unreadable = (broken / size > 0.04) | (longest > LONG_WORD)
        unreadable |= ~in_row & (symbols / size > 0.2) & (chars >= 8) & (hits / np.maximum(words, 1) < 0.2)
        unreadable |= ~in_row & (words >= 8) & (hits / np.maximum(words, 1) < 0.06) & (latin > 0.6 * letters) & (vowels / np.maximum(latin, 1) < 0.29) & (letters > 0.5 * size)
        unreadable |= ~in_row & (words >= 12) & (by_seg(length == 2) / np.maximum(words, 1) > 0.8) & (by_seg(length) / np.maximum(words, 1) < 2.8)
    # repeated lines
    full = np.flatnonzero(filled)
    key = run_hash(cps, line_start[full], last[full] + 1) ^ (line_doc[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    repeated = np.zeros(len(line_start), bool)
    many = np.unique(key)[times >= 4]
    repeated[full] = np.isin(key, many)
    junk = unreadable | (repeated[seg_line] if n_seg else np.zeros(0, bool))
    short = filled & (line_len <= SHORT_LINE) & ~sentence_end & ~row
    heading = short & (filled & (cps[last] == 58)) if len(cps) else short
    in_list = ~junk & (short & ~heading)[seg_line] if n_seg else junk
    in_row &= ~junk
    seg_doc = line_doc[seg_line] if n_seg else np.zeros(0, np.int64)
    by_doc = lambda x, d, weights: np.bincount(d, weights=np.where(x, weights, 0), minlength=n_texts)[:n_texts]
    total = np.bincount(seg_doc, weights=chars, minlength=n_texts)[:n_texts]
    share = lambda x: by_doc(x, seg_doc, chars) / np.maximum(total, 1)
    lines = np.bincount(line_doc[filled], minlength=n_texts)[:n_texts]
    n_words = np.diff(w.first)
    per_doc = lambda x: np.bincount(w.doc, weights=x, minlength=n_texts)[:n_texts]
    text_of = np.repeat(np.arange(n_texts), np.diff(w.text_start))
    junk_share, table_share, list_share = share(junk), share(in_row), share(in_list)
    out = {
        "n_words": n_words,
        "mean_word_len": per_doc(length) / np.maximum(n_words, 1),
        "symbol_ratio": np.bincount(text_of, weights=symbol, minlength=n_texts)[:n_texts] / np.maximum(total, 1),
        "punct_line_share": np.bincount(line_doc[closed], minlength=n_texts)[:n_texts] / np.maximum(lines, 1),
        "common_share": per_doc(is_common) / np.maximum(n_words, 1),
        "prose_share": np.clip(1 - junk_share - table_share - list_share, 0, 1),
        "list_share": list_share,
        "table_share": table_share,
        "junk_share": junk_share,
        "n_lines": lines,
        "n_visible": total.astype(np.int64),
    }
    return out


def document_statistics(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, statistics ..., n_lines, n_visible) of every row; null and empty texts have zeros.

    common_words is a small fixed dictionary (lang, word); it goes to the workers with the function.
    """
    dictionary = sorted({r["word"] for r in common_words.select("word").distinct().collect() if r["word"]})
    hashes = np.sort(Words(dictionary).key)
    kind = df.schema[key].dataType.simpleString()
    names = [*STATISTICS, "n_lines", "n_visible"]
    schema = f"{key} {kind}, {lang} string, " + ", ".join(f"{n} {'bigint' if n.startswith('n_') else 'double'}" for n in names)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            parts = [statistics(texts[a:b], hashes) for a, b in batches(texts)]
            columns = [np.concatenate([p[n] for p in parts]) if parts else np.zeros(0) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c.astype(np.int64 if n.startswith("n_") else np.float64)) for n, c in zip(names, columns))], names=[key, lang, *names])

    # a language's spelling doesn't matter; unknown ones are one group
    return df.select(key, F.coalesce(F.lower(lang), F.lit("und")).alias(lang), text).mapInArrow(run, schema)


def language_quantiles(stats: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, q_<statistic>): the 0th to 100th percentile from KLL sketches over all documents with words."""
    counted = stats.where(F.col("n_words") > 0).groupBy(lang).agg(*[F.kll_sketch_agg_double(F.col(s).cast("double")).alias(s) for s in STATISTICS])
    at = "array(" + ", ".join(f"{k / 100}D" for k in range(101)) + ")"
    return counted.select(lang, *[F.expr(f"kll_sketch_get_quantile_double({s}, {at})").alias(f"q_{s}") for s in STATISTICS])


def with_distribution(stats: DataFrame, lang: str = "lang") -> DataFrame:
    """stats with <statistic>_pct, <statistic>_z and tails (names of the statistics in a tail of their language)."""
    # one row a language code: bounded by the number of codes, each with 101 numbers a statistic
    joined = stats.join(F.broadcast(language_quantiles(stats, lang)), lang, "left")
    q = lambda s, k: F.get(f"q_{s}", F.lit(k))
    below = lambda s: F.filter(f"q_{s}", lambda x: x <= F.col(s))
    pct = [(F.size(below(s)) / F.size(f"q_{s}")).alias(f"{s}_pct") for s in STATISTICS]
    z = [((F.col(s) - q(s, 50)) / F.greatest((q(s, 75) - q(s, 25)) / 1.349, F.lit(0.02))).alias(f"{s}_z") for s in STATISTICS]
    tail = F.filter(F.array(*[F.when((F.col(s) < q(s, TAIL)) | (F.col(s) > q(s, 100 - TAIL)), F.lit(s)) for s in STATISTICS]), lambda x: x.isNotNull())
    return joined.select(*stats.columns, *pct, *z, tail.alias("tails"))


def with_kind(measured: DataFrame) -> DataFrame:
    """measured with kind: prose, list, table, junk, or empty (null, empty or blank text)."""
    kind = (
        F.when(F.col("n_visible") == 0, "empty")
        .when(F.col("junk_share") > 0.5, "junk")
        .when((F.col("prose_share") < 0.5) & (F.col("table_share") >= F.col("list_share")) & (F.col("n_lines") >= 2), "table")
        .when((F.col("prose_share") < 0.5) & (F.col("n_lines") >= 3), "list")
        .otherwise("prose")
    )
    return measured.withColumn("kind", kind)


def document_quality(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Statistics, percentiles, robust z-scores, tails and kind of every row of df."""
    return with_kind(with_distribution(cut_lineage(document_statistics(df, common_words, key, text, lang)), lang))
