"""Perturbed variants of texts (rows) and pictures (numpy)."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.config import DEFAULT


def hash32(key: Column) -> Column:
    """The first 32 bits of the MD5 of a string, as a number."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


#: A prime, and a step: place i of a row with seed a has the rank (a + STEP i)^2 modulo PRIME, which every engine computes alike without a hash a word.
PRIME, STEP = 2147483647, 7919
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def without_some(words_: list[str], key: str | None, no: int, percent: int) -> str:
    """The words without the max(1, percent %) of least rank, joined; the seed is from the MD5 of (key, no)."""
    seed = int(hashlib.md5("-".join([*([key] if key is not None else []), str(no)]).encode()).hexdigest()[:8], 16) % PRIME
    x = (seed + np.arange(len(words_), dtype=np.int64) * STEP) % PRIME
    keep = np.ones(len(words_), bool)
    keep[np.argsort(x * x % PRIME, kind="stable")[: max(1, len(words_) * percent // 100)]] = False
    return " ".join(itertools.compress(words_, keep))


def _drops(df: DataFrame, key: str, text: str, n: int, percent: int, answers: bool) -> DataFrame:
    """One Arrow pass: as array expressions the same costs several times as much, for they are interpreted, and evaluated again by every filter on the new texts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, out = part.column(0).cast(pa.string()).to_pylist(), []
                for own, t in zip(names, part.column(1).to_pylist()):
                    head, newline, rest = t.partition("\n") if answers and t is not None else ("", "", t)
                    every = [w for w in _BLANKS.split(rest) if w] if t is not None else []
                    out += [t if len(every) < 5 else head + newline + without_some(every, own, no, percent) for no in range(n)]
                take = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(np.tile(np.arange(n, dtype=np.int32), part.num_rows)), pa.array(out, pa.string())], names=[key, "variant_no", "text"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, variant_no int, text string")


def token_drops(df: DataFrame, key: str = "id", text: str = "text", n: int = DEFAULT.neighbours, percent: int = DEFAULT.drop_ratio_percent) -> DataFrame:
    """V1: (key, variant_no, text): n copies of each text without some of its words; texts of fewer than five words unchanged, null texts null."""
    return _drops(df, key, text, n, percent, False)


def answer_drops(df: DataFrame, key: str = "id", text: str = "text", n: int = DEFAULT.neighbours, percent: int = DEFAULT.drop_ratio_percent) -> DataFrame:
    """V2: as V1 on the answer, its question put before it again; pairs with fewer than five words in the answer unchanged."""
    return _drops(df, key, text, n, percent, True)


def lowercase(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """V3: one variant in lower case."""
    return df.select(key, F.lit(0).alias("variant_no"), F.lower(text).alias("text"))


def caption_negatives(df: DataFrame, key: str = "id", text: str = "text", n: int = DEFAULT.negatives, attempts: int = 8) -> DataFrame:
    """(key, variant_no, text): up to n texts of other rows, different from the row's own.

    The pool (distinct texts) is numbered by the order of its hashes within 256 ranges of hashes; attempt a of a row looks up
    one number, an equi-join instead of a join of all with all. Repeats and equal texts drop out; the first n attempts left count.
    """
    pool = df.where(F.col(text).isNotNull()).select(F.col(text).alias("__p")).distinct().select("__p", F.md5("__p").alias("__h"))
    numbered = pool.withColumn("__b", F.substring("__h", 1, 2)).withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy("__h")) - 1)
    sizes = F.broadcast(numbered.groupBy("__b").agg(F.count("*").alias("__n")))  # 256 rows at most
    asked = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("__a"))
    asked = asked.withColumn("__k", F.md5(F.concat_ws("-", F.col(key), "__a"))).withColumn("__b", F.substring("__k", 1, 2))
    asked = asked.join(sizes, "__b").withColumn("__i", (hash32(F.col("__k")) % F.col("__n")).cast("int"))
    met = asked.join(numbered.select("__b", "__i", "__p"), ["__b", "__i"]).where(F.col("__p") != F.col("__t"))
    first = met.groupBy(key, "__p").agg(F.min("__a").alias("__a"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__a")) - 1
    return first.withColumn("variant_no", rank).where(F.col("variant_no") < n).select(key, "variant_no", F.col("__p").alias("text"))


# ---- pictures: (height, width, 3) uint8 arrays


def noisy(x: np.ndarray, rng: np.random.Generator, std: float = 25.0) -> np.ndarray:
    """V5: Gaussian noise, cut to 0..255."""
    return np.clip(x + rng.normal(0, std, x.shape), 0, 255).astype(np.uint8)


def masked(x: np.ndarray, rng: np.random.Generator, ratio: float = 0.15, patch: int = 32) -> np.ndarray:
    """V6: some patches of the grid in the mean colour; unchanged if there are fewer than two."""
    rows, columns = x.shape[0] // patch, x.shape[1] // patch
    if rows * columns < 2:
        return x.copy()
    out, mean = x.copy(), x.reshape(-1, 3).mean(axis=0).astype(np.uint8)
    for k in rng.choice(rows * columns, max(1, int(rows * columns * ratio)), replace=False):
        r, c = divmod(int(k), columns)
        out[r * patch : (r + 1) * patch, c * patch : (c + 1) * patch] = mean
    return out


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned."""
    y = np.clip((np.arange(height) + 0.5) * x.shape[0] / height - 0.5, 0, x.shape[0] - 1)
    z = np.clip((np.arange(width) + 0.5) * x.shape[1] / width - 0.5, 0, x.shape[1] - 1)
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    y1, z1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(z0 + 1, x.shape[1] - 1)
    fy, fz = (y - y0)[:, None, None], (z - z0)[None, :, None]
    top = x[y0][:, z0] * (1 - fz) + x[y0][:, z1] * fz
    low = x[y1][:, z0] * (1 - fz) + x[y1][:, z1] * fz
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def cropped(x: np.ndarray, rng: np.random.Generator, low: float = 0.7, high: float = 0.9) -> np.ndarray:
    """V7: a random part, resampled to the picture's size."""
    ratio = rng.uniform(low, high)
    h, w = max(1, int(x.shape[0] * ratio)), max(1, int(x.shape[1] * ratio))
    r, c = rng.integers(0, x.shape[0] - h + 1), rng.integers(0, x.shape[1] - w + 1)
    return resized(x[r : r + h, c : c + w], x.shape[0], x.shape[1])


def neighbour(x: np.ndarray, no: int, seed: int, patch: int = 32) -> np.ndarray:
    """V8: noise, mask (in a grid of ``patch`` pixels) and crop in turn."""
    rng = np.random.default_rng([seed & 0xFFFFFFFF, no])
    return masked(x, rng, patch=patch) if no % 3 == 1 else (noisy, None, cropped)[no % 3](x, rng)


def blurred(x: np.ndarray, radius: float = 2.0) -> np.ndarray:
    n = int(3 * radius)
    kernel = np.exp(-0.5 * (np.arange(-n, n + 1) / radius) ** 2)
    kernel /= kernel.sum()
    y = x.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(y, [(n, n) if a == axis else (0, 0) for a in range(3)], mode="edge")
        y = sum(k * np.take(padded, np.arange(i, i + y.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return y


def corrupted(x: np.ndarray, rng: np.random.Generator, std: float = 0.05, radius: float = 2.0) -> np.ndarray:
    """V9: Gaussian blur, then noise on 0..1, cut."""
    return np.rint(np.clip(blurred(x, radius) / 255 + rng.normal(0, std, x.shape), 0, 1) * 255).astype(np.uint8)
