"""Problem 5: near-duplicates by BagMinHash signatures, banding and exact verification.

A text is a bag of runs of k words. Every (run, weight level) owns a Poisson process of points in time whose rate is
the width of the level; a point falls into one of the signature's registers, and a register keeps the earliest point.
Two bags agree in a register with the probability of their weighted Jaccard similarity. The points depend on the
run, level and counter only, so they are drawn anew wherever they are needed, for a whole Arrow batch at once, and
only until a time by which a text's registers are filled with high probability; texts with an empty register
go on to twice that time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.config import cut_lineage
from auditloom.llm.textnp import U64, Words, batches, mix

REGISTERS, ROWS = 256, 5
K, MIN_WORDS, THRESHOLD = 3, 30, 0.6
#: Buckets with more members are divided into blocks of about so many, and all pairs of blocks are compared.
HOT = 64
#: Groups of exact copies up to this size come out as all their pairs, larger ones as pairs with their first member.
EXPAND = 64


def weight_levels(most: int) -> np.ndarray:
    """Discretised weights: every integer up to 8, then steps of a quarter; a weight counts as the level below it."""
    levels = list(range(9))
    while levels[-1] < most:
        levels.append(levels[-1] + max(1, levels[-1] // 4))
    return np.array(levels, np.int64)


def bag(runs: np.ndarray, doc: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, rate, text) of each process: the distinct runs of every text, once a weight level that they reach."""
    if not len(runs):
        return runs, np.zeros(0), doc
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])]))
    times = np.diff(np.concatenate([first, [len(runs)]]))
    runs, doc = runs[first], doc[first]
    if not weighted:
        return runs, np.ones(len(runs)), doc
    levels = weight_levels(int(times.max()))
    reached = np.searchsorted(levels, times, "right") - 1
    of = np.repeat(np.arange(len(runs)), reached)
    level = np.arange(len(of)) - np.repeat(np.cumsum(reached) - reached, reached) + 1
    return mix(runs[of] ^ level.astype(U64)), (levels[level] - levels[level - 1]).astype(float), doc[of]


def signatures(seed: np.ndarray, rate: np.ndarray, doc: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The n x m registers, as the bits of the earliest points' times; all ones for texts without runs."""
    out = np.full(n * m, np.inf)
    weight = np.bincount(doc, weights=rate, minlength=n)
    bound = np.zeros(n)
    bound[weight > 0] = m / weight[weight > 0] * (np.log(m) + 2.5)
    todo = weight > 0
    while todo.any():
        out.reshape(n, m)[todo] = np.inf
        live = np.flatnonzero(todo[doc])
        s, r, d, t, j = seed[live], rate[live], doc[live], np.zeros(len(live)), 0
        while len(s):
            j += 1
            x = mix(s + U64(j * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / r
            keep = t <= bound[d]
            s, r, d, t = s[keep], r[keep], d[keep], t[keep]
            np.minimum.at(out, d * m + (x[keep] & U64(m - 1)).astype(np.int64), t)
        todo &= np.isinf(out.reshape(n, m)).any(axis=1)
        bound[todo] *= 2
    return out.view(U64).reshape(n, m)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = signature.shape[1] // rows
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(bands).astype(U64)), (len(signature), bands)).copy()
        for j in range(rows):
            key = mix(key ^ signature[:, j : bands * rows : rows])
    return key


def _totals(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
        return total[first[1:]] - total[first[:-1]]


def _hashed(texts: list[str], least: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, numbers of the texts with enough of them, a hash of all words of each of these)."""
    w = Words(texts)
    enough = np.flatnonzero(np.diff(w.first) >= least)
    at = np.arange(len(w.key)) - w.first[:-1][w.doc]
    return w, enough, mix(_totals(mix(w.key ^ mix(at.astype(U64) + U64(11))), w.first)[enough])


def text_hashes(df: DataFrame, key: str, text: str, least: int = MIN_WORDS) -> DataFrame:
    """(key, h1 BIGINT) of every text of at least ``least`` words; equal word sequences have equal h1.

    h1 has 64 bits, so that two of a billion different texts share one with a probability of 3 %.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches(texts):
                _, rows, whole = _hashed(texts[a:b], least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + a)), pa.array(whole.view(np.int64))], names=[key, "h1"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.length(text) >= 2 * least - 1).select(key, text).mapInArrow(run, f"{key} {kind}, h1 bigint")


def sketches(df: DataFrame, text: str, k: int = K, least: int = MIN_WORDS, weighted: bool = False) -> DataFrame:
    """(h1, bands ARRAY<BIGINT>) of every text of at least ``least`` words, h1 as in ``text_hashes``.

    Of equal texts in an Arrow batch only the first is kept, so that a hot group of copies is small before any shuffle.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in batches(texts):
                w, rows, whole = _hashed(texts[a:b], max(least, k))
                whole, first = np.unique(whole, return_index=True)
                place = np.full(b - a, -1)
                place[rows[first]] = np.arange(len(first))
                runs, doc = w.runs(k)
                kept = place[doc] >= 0
                keys = band_keys(signatures(*bag(runs[kept], place[doc[kept]], weighted), len(first)))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), bands], names=["h1", "bands"])

    return df.where(F.length(text) >= 2 * least - 1).select(text).mapInArrow(run, "h1 bigint, bands array<bigint>")


def shingle_sets(df: DataFrame, key: str, text: str, k: int = K, weighted: bool = False) -> DataFrame:
    """(key, runs ARRAY<INT>): the distinct runs of k words, hashed to 32 bits (two texts of 300 runs share one by chance in 1 of 50,000 pairs).

    weighted: every occurrence of a run is an element of its own, by its number, so that the sets' similarity is that of the multisets.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches(texts):
                runs, doc = Words(texts[a:b]).runs(k)
                if weighted and len(runs):
                    order = np.lexsort((runs, doc))
                    runs, doc = runs[order], doc[order]
                    new = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])]))
                    runs = mix(runs ^ mix((np.arange(len(runs)) - np.repeat(new, np.diff(np.concatenate([new, [len(runs)]])))).astype(U64)))
                seed, _, doc = bag(runs >> U64(32), doc, False)
                bounds = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(bounds, pa.array(seed.astype(np.uint32).view(np.int32)))], names=[key, "runs"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, runs array<int>")


def candidates(banded: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows that share a band; banded: (key, bands).

    A row may occur more than once. Bands that occur once leave after one shuffle. Buckets of more than ``hot`` rows are cut into blocks
    by the rows' hashes, and every pair of blocks is a bucket of its own, so that no task has a whole hot bucket and no pair is lost.
    """
    exploded = banded.select(key, F.explode("bands").alias("band"))
    shared = exploded.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1")
    shared = cut_lineage(shared)
    cold = shared.where(F.col("n") <= hot).select("band", key)
    a, b = cold.select("band", F.col(key).alias("a")), cold.select("band", F.col(key).alias("b"))
    every = a.join(b, "band").where("a < b").select("a", "b")
    if not shared.where(F.col("n") > hot).isEmpty():
        blocks = F.ceil(F.col("n") / hot).cast("int")
        divided = shared.where(F.col("n") > hot).select("band", key, blocks.alias("__blocks")).distinct().withColumn("__own", F.pmod(F.xxhash64(key), "__blocks").cast("int"))
        a = divided.select("band", F.col(key).alias("a"), F.col("__own").alias("__i"), F.explode(F.sequence("__own", F.col("__blocks") - 1)).alias("__j"))
        b = divided.select("band", F.col(key).alias("b"), F.explode(F.sequence(F.lit(0), "__own")).alias("__i"), F.col("__own").alias("__j"))
        met = a.join(b, ["band", "__i", "__j"]).where("__i < __j and a <> b or a < b")
        every = every.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return every.distinct()


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str, k: int = K, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets (weighted: multisets) of runs have a Jaccard similarity of at least the threshold, with it."""
    pairs = cut_lineage(pairs)
    named = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct()
    sets = cut_lineage(shingle_sets(df.select(key, text).join(named, key, "left_semi"), key, text, k, weighted))
    joined = pairs.join(sets.select(F.col(key).alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col(key).alias("b"), F.col("runs").alias("rb")), "b")
    both = F.size(F.array_intersect("ra", "rb"))
    joined = joined.select("a", "b", F.size("ra").alias("na"), F.size("rb").alias("nb"), both.alias("both"))
    similarity = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return joined.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def similar_classes(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, least: int = MIN_WORDS, threshold: float = THRESHOLD, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity) between representatives of equal texts, members (key, rep, copies) of all texts.

    Null and short texts (fewer than ``least`` words) are in neither; an empty table gives empty results.
    """
    hashed = cut_lineage(text_hashes(df, key, text, max(least, k)))
    classes = hashed.groupBy("h1").agg(F.min(key).alias("rep"), F.count("*").alias("copies"))
    close = candidates(sketches(df, text, k, least, weighted), "h1")
    rep = lambda c: classes.select(F.col("h1").alias(c), F.col("rep").alias(f"r{c}"))
    named = close.join(rep("a"), "a").join(rep("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    links = cut_lineage(verified(named, df, key, text, k, threshold, weighted))
    return links, hashed.join(classes, "h1").select(key, "rep", "copies")


def similar_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, least: int = MIN_WORDS, threshold: float = THRESHOLD, expand: int = EXPAND, weighted: bool = False) -> DataFrame:
    """(a, b), a < b: all pairs of texts over the threshold.

    A class of at most ``expand`` exact copies comes out as all its pairs and takes part with every copy in the pairs with
    other texts. A larger one comes out as pairs of its representative with every copy, and takes part in other pairs
    with its representative; ``similar_classes`` has the membership, so no link is lost.
    """
    links, members = similar_classes(df, key, text, k, least, threshold, weighted)
    linked = links.select(F.col("a").alias("rep")).union(links.select("b")).distinct().withColumn("linked", F.lit(True))
    own = cut_lineage(members.join(linked, "rep", "left").where((F.col("copies") > 1) | F.col("linked")).select(key, "rep", "copies"))
    shown = own.where((F.col("copies") <= expand) | (F.col(key) == F.col("rep")))
    across = links.select("a", "b").join(shown.select(F.col("rep").alias("a"), F.col(key).alias("x")), "a").join(shown.select(F.col("rep").alias("b"), F.col(key).alias("y")), "b").select("x", "y")
    few = own.where((F.col("copies") > 1) & (F.col("copies") <= expand))
    within = few.select("rep", F.col(key).alias("x")).join(few.select("rep", F.col(key).alias("y")), "rep").where("x < y").select("x", "y")
    star = own.where((F.col("copies") > expand) & (F.col(key) != F.col("rep"))).select(F.col("rep").alias("x"), F.col(key).alias("y"))
    every = across.unionByName(within).unionByName(star)
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of links (a, b): the least node that it is connected with.

    Alternates large-star and small-star steps until no edge changes, in rounds by the logarithm of the longest path; every round is one table in the shared folder. More than ``rounds`` are an error.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        small = cut_lineage(small)
        changed = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        edges = small
        if not changed:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(edges.select("v", "v").distinct()).groupBy("node").agg(F.min("component").alias("component"))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, least: int = MIN_WORDS, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """(key, class_id, links): the group of every text that is an (edited) copy of another, with its number of links to other texts.

    class_id is the least key of the group. links counts the different texts linked with this one, not their copies.
    """
    links, members = similar_classes(df, key, text, k, least, threshold, weighted)
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
    of = components(links).withColumnRenamed("node", "rep").join(degree, "rep")
    return members.join(of, "rep", "left").where((F.col("copies") > 1) | F.col("component").isNotNull()).select(key, F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
