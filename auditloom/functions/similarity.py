"""Similarities of two texts by words, as Spark expressions on arrays of lower-cased words."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def common_ngrams(a: Column, b: Column, n: int) -> Column:
    """Number of common runs of n words of two array columns, each at most as often as in either; null if either is null.

    One Arrow function: an array expression counts each run anew for every run.
    """

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        grams = lambda w: Counter(zip(*(w[i:] for i in range(n))))
        return pd.Series([None if p is None or q is None else (grams(list(p)) & grams(list(q))).total() for p, q in zip(x, y)], dtype="Int32")

    return run(a, b)


def runs_of(a: Column, n: int) -> Column:
    """Number of runs of n words."""
    return F.greatest(F.size(a) - (n - 1), F.lit(0))


def f1(common: Column, n_ref: Column, n_hyp: Column) -> Column:
    return F.when(common > 0, 2.0 * common / (n_ref + n_hyp)).otherwise(F.lit(0.0))


def rouge_n(ref: Column, hyp: Column, n: int) -> Column:
    """F1 of the clipped n-gram overlap."""
    return f1(common_ngrams(ref, hyp, n), runs_of(ref, n), runs_of(hyp, n))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table at once in the bits of a number."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        common = row & at.get(y, 0)
        row = ((row + common) | (row - common)) & full
    return len(a) - row.bit_count()


def lcs(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two array columns of any length; null if either is null."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else lcs_length(list(p), list(q)) for p, q in zip(x, y)], dtype="Int32")

    return run(F.col(a), F.col(b))


def rouge_l(ref: str, hyp: str) -> Column:
    """G1: F1 of the longest common subsequence (words as they are, without stemming)."""
    return f1(lcs(ref, hyp), F.size(ref), F.size(hyp))


def bleu(ref: Column, hyp: Column, n: int) -> Column:
    """Sentence BLEU with equal weights up to n; a zero count of n-grams counts 0.1; 0 without a common word."""
    logs, common = F.lit(0.0), {k: common_ngrams(hyp, ref, k) for k in range(1, n + 1)}
    for k in range(1, n + 1):
        logs = logs + F.log(F.when(common[k] > 0, common[k].cast("double")).otherwise(F.lit(0.1)) / F.greatest(runs_of(hyp, k), F.lit(1))) / n
    brevity = F.when(F.size(hyp) > F.size(ref), F.lit(1.0)).otherwise(F.exp(1.0 - F.size(ref) / F.greatest(F.size(hyp), F.lit(1))))
    return F.when((F.size(ref) > 0) & (F.size(hyp) > 0) & (common[1] > 0), brevity * F.exp(logs)).otherwise(F.lit(0.0))
