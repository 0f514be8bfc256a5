"""Scorers: token log-probabilities of texts under several models."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.config import DEFAULT, cut_lineage
from auditloom.functions.text import words
from auditloom.operators.variants import corrupted, neighbour
from auditloom.sources.images import decode

MODELS = ("base1", "ft1", "base2", "ft2")


def tokens(df: DataFrame, keys: list[str], text: str = "text", most: int | None = DEFAULT.max_tokens) -> DataFrame:
    """(keys, pos, token, prev): the first ``most`` words of each text (None: all); prev of the first is <s>."""
    every = words(text)
    cut = df.select(*keys, (every if most is None else F.slice(every, 1, most)).alias("__w"))
    out = cut.select(*keys, "__w", F.posexplode("__w").alias("pos", "token"))
    return out.select(*keys, "pos", "token", F.when(F.col("pos") == 0, F.lit("<s>")).otherwise(F.get("__w", F.col("pos") - 1)).alias("prev"))


class NGramScorer:
    """Unigram (1) and bigram (2) models of a base corpus (base) and of the base corpus with the members (ft), counted over whole texts.

    log p = ln((c(prev, w) + alpha) / (c(prev) + alpha V)); V: distinct words of all corpora together. The bigram counts are written once; the unigram
    and context counts come from them. Only different (prev, token) pairs meet the counts, so texts' tokens are joined once, with finished values.
    """

    def __init__(self, base: DataFrame, members: DataFrame, everything: DataFrame, alpha: float = 0.1, text: str = "text"):
        self.alpha = alpha
        both = base.select(F.lit(0).alias("m"), F.col(text).alias("text")).unionByName(members.select(F.lit(1).alias("m"), F.col(text).alias("text")))
        count = lambda who: F.sum(F.when(F.col("m") <= who, 1).otherwise(0))
        self.bigrams = cut_lineage(tokens(both, ["m"], most=None).groupBy("prev", "token").agg(count(0).alias("cb"), count(1).alias("cf")))
        self.unigrams = self.bigrams.groupBy("token").agg(F.sum("cb").alias("ub"), F.sum("cf").alias("uf"))
        self.contexts = self.bigrams.groupBy("prev").agg(F.sum("cb").alias("pb"), F.sum("cf").alias("pf"))
        vocabulary = everything.select(F.explode(words(text)).alias("token")).distinct().union(self.bigrams.select("token").distinct())
        self.totals = self.bigrams.agg(F.sum("cb").alias("nb"), F.sum("cf").alias("nf")).crossJoin(vocabulary.agg(F.countDistinct("token").alias("v")))  # one row

    def priced(self, pairs: DataFrame) -> DataFrame:
        """(prev, token, logp_<model> of the four models) of different pairs; those not seen in the corpus too."""
        t = pairs.join(self.bigrams, ["prev", "token"], "left").join(self.unigrams, "token", "left").join(self.contexts, "prev", "left").join(F.broadcast(self.totals))
        a = F.lit(self.alpha)
        lp = lambda c, n: F.log((F.coalesce(F.col(c), F.lit(0)) + a) / (F.coalesce(F.col(n), F.lit(0)) + a * F.col("v")))
        return t.select("prev", "token", lp("ub", "nb").alias("logp_base1"), lp("uf", "nf").alias("logp_ft1"), lp("cb", "pb").alias("logp_base2"), lp("cf", "pf").alias("logp_ft2"))

    def score(self, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """(keys, pos, token, logp_<model> of the four models) of every token."""
        t = tokens(df, keys, text)
        return t.join(self.priced(t.select("prev", "token").distinct()), ["prev", "token"]).select(*keys, "pos", "token", *[f"logp_{m}" for m in MODELS])

    def variant_losses(self, df: DataFrame, key: str, variants: list[tuple[str, int]], kind: str = "kind", no: str = "no", text: str = "text") -> DataFrame:
        """(key, kind, no, loss_<model> ...) of the mean losses of every key's variants.

        Variants of a text share most of their pairs of words: each pair of a key is counted for all its variants before it is shuffled, and is priced once. Texts
        without words have no row.
        """
        t = tokens(df.select(key, kind, no, text), [key, kind, no], text)
        n = [F.sum(F.when((F.col(kind) == k) & (F.col(no) == i), 1).otherwise(0)).alias(f"__{j}") for j, (k, i) in enumerate(variants)]
        counted = cut_lineage(t.groupBy(key, "prev", "token").agg(*n))
        priced = counted.join(self.priced(counted.select("prev", "token").distinct()), ["prev", "token"])
        total = [F.sum(F.col(f"__{j}")).alias(f"__n{j}") for j in range(len(variants))]
        total += [F.sum(-F.col(f"__{j}") * F.col(f"logp_{m}")).alias(f"__{j}_{m}") for j in range(len(variants)) for m in MODELS]
        wide = priced.groupBy(key).agg(*total)
        rows = [F.struct(F.lit(k).alias(kind), F.lit(i).alias(no), *[F.try_divide(F.col(f"__{j}_{m}"), F.col(f"__n{j}")).alias(f"loss_{m}") for m in MODELS]) for j, (k, i) in enumerate(variants)]
        return wide.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*").where(F.col(f"loss_{MODELS[0]}").isNotNull())


class PandasScorer:
    """Adapter of any model: fn gets batches with the keys and text, and gives rows (keys, pos, token, logp).

    load is called once a Python worker, so that weights are read once.
    """

    def __init__(self, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], name: str):
        self.load, self.name = load, name

    def score(self, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        load, name = self.load, self.name
        schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", pos int, token string, logp_{name} double"

        def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fn = load()
            for batch in stream:
                yield fn(batch).rename(columns={"logp": f"logp_{name}"})

        return df.select(*keys, text).mapInPandas(run, schema)


def contrast_losses(pixels: np.ndarray, words_: list[str], model: str) -> np.ndarray:
    """A fixed scorer of a text with a picture: a word's loss is its length over the picture's contrast (ft) or brightness (base)."""
    x = pixels.astype(np.float64)
    return np.array([len(w) for w in words_], np.float64) / (1.0 + (x.std() if model == "ft" else x.mean()) / 64.0)


class VisualScorer:
    """The mean loss of every row's text with its picture, the picture's neighbours and its corruption, under several models.

    load gives fn(pixels, words, model) -> losses of the words, called once a Python worker. Pictures are decoded, and their variants made, once for all
    models. A picture that doesn't decode and a text without words give no rows.
    """

    def __init__(self, load: Callable[[], Callable], models: tuple[str, ...]):
        self.load, self.models = load, models

    def score(self, df: DataFrame, key: str, picture: str, text: str, patch: int = 32, n: int = DEFAULT.neighbours) -> DataFrame:
        load, models = self.load, self.models

        def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fn = load()
            for batch in stream:
                rows = []
                for k, data, t in zip(batch[key], batch[picture], batch[text]):
                    pixels, own = decode(data), (t or "").split()
                    if pixels is None or not own:
                        continue
                    seed = zlib.crc32(str(k).encode())
                    shown = [("orig", 0, pixels), *[("image", i, neighbour(pixels, i, seed, patch)) for i in range(n)], ("corrupt", 0, corrupted(pixels, np.random.default_rng(seed)))]
                    rows += [(k, kind, no, m, float(np.mean(fn(x, own, m)))) for kind, no, x in shown for m in models]
                yield pd.DataFrame(rows, columns=[key, "kind", "no", "model", "loss"])

        return df.select(key, picture, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, kind string, no int, model string, loss double")


class PandasGenerator:
    """Texts that a model makes of prompts: (key, no, text), number 0 greedily, the others sampled.

    load gives fn(prompts, no) -> texts, called once a Python worker.
    """

    def __init__(self, load: Callable[[], Callable[[list[str], int], list[str]]], n: int = 3):
        self.load, self.n = load, n

    def generate(self, df: DataFrame, key: str, prompt: str) -> DataFrame:
        load, n = self.load, self.n

        def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fn = load()
            for batch in stream:
                for no in range(n):
                    yield pd.DataFrame({key: batch[key], "no": no, "text": fn(batch[prompt].tolist(), no)})

        return df.select(key, prompt).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, no int, text string")


class PandasEmbedder:
    """(key, embedding) of a column by any encoder, each vector over its length; load gives fn(values) -> array (rows, dimensions)."""

    def __init__(self, load: Callable[[], Callable]):
        self.load = load

    def embed(self, df: DataFrame, key: str, column: str) -> DataFrame:
        load = self.load

        def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fn = load()
            for batch in stream:
                x = np.asarray(fn(batch[column].tolist()), np.float64)
                length = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({key: batch[key], "embedding": list((x / np.where(length > 0, length, 1)).astype(np.float32))})

        return df.select(key, column).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")
