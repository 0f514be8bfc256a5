"""Problem 2: evaluation records that occur again in the training split, exactly or almost.

Texts are read once into words as symbols (one code point a word). Every evaluation text is cut into passages of PASSAGE words that don't overlap;
Aho-Corasick automata over shards of the passages scan the training texts, wherever a passage may begin. An edited copy keeps passages:
at a similarity of 0.6 a text of n words has at most n / EDITED single edits, each of which spoils one passage, so that of the
n / PASSAGE passages at least n (1 / PASSAGE - 1 / EDITED) are left; as many of the most frequent passages needn't be looked for. Pairs that share a
passage are compared by odd sketches (parities of hashed runs, whose difference tells the runs that only one text has), and those over
the threshold but for chance exactly, with the merged common intervals as coverage of the evaluation text.
Pictures: bits of block means against random thresholds differ in proportion to the mean absolute difference; pairs that agree in one of many groups of
bits are compared exactly. Equal texts and equal pictures are one class throughout.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.config import cut_lineage
from auditloom.llm.pairs import split_pair
from auditloom.llm.textnp import U64, Words, batches, mix
from auditloom.sources.images import decode, shrink

K, THRESHOLD = 3, 0.6
PASSAGE = 6  # words of a passage
EDITED = 9.5  # words an edit at the threshold: the most edits that leave a similarity of 0.6
SHARD = 100_000  # passages an automaton: about 60 MB
ROWS = 200_000  # training texts that an automaton scans in one task
ODD = 512  # bits of an odd sketch
SIGMAS = 5.0  # a similar pair is lost to chance in 1 of 3 million
GAP = 0x10FFFF  # the symbol between stretches
SIZES = 1 << 32  # above every size of a text
GROUPS, BITS = 48, 64
SAME_PICTURE = 10.0
#: Training pictures in one block of a hot group of bits.
BLOCK = 256
#: Classes of copies come out as all pairs up to this number of pairs, else each copy with the other side's first.
EXPAND = 4096


def side(split: Column) -> Column:
    return F.when(split == "train", "train").when(split.isin("validation", "test"), "eval")


def _hashed(texts: list[str], least: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, numbers of the texts with enough of them, a hash of all words of each of these)."""
    w = Words(texts)
    rows = np.flatnonzero(np.diff(w.first) >= least)
    at = np.arange(len(w.key)) - w.first[:-1][w.doc]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(w.key ^ mix(at.astype(U64))), dtype=U64)])
        return w, rows, mix(total[w.first[1:]] - total[w.first[:-1]])[rows]


def _texts(column: pa.Array, answers: bool) -> list[str]:
    texts = [t or "" for t in column.to_pylist()]
    return [split_pair(t)[1] or "" for t in texts] if answers else texts


def distinct_runs(runs: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of each of n texts, and their texts, in order. As many low bits of a run's hash as n has are lost: 43 or more are left."""
    bits = U64(max(1, n.bit_length()))
    both = np.sort(doc.astype(U64) << (U64(64) - bits) | runs >> bits)
    both = both[np.concatenate([both[:1] == both[:1], both[1:] != both[:-1]])]
    return both << bits, (both >> (U64(64) - bits)).astype(np.int64)


def odd_sketches(runs: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x ODD bits as bytes: the parity of the distinct runs of each text that hash to a bit; runs: distinct within each text."""
    counts = np.bincount(doc * ODD + (runs >> U64(32)).astype(np.int64) % ODD, minlength=n * ODD)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, ODD), axis=1)


def odd_limit(sizes: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The bits in which the sketches of two texts over the threshold differ at most, by the sum of their sizes, but for chance."""
    lone = (1 - threshold) / (1 + threshold) * sizes
    share = (1 - np.exp(-2 * lone / ODD)) / 2
    return ODD * share + SIGMAS * np.sqrt(ODD * share * (1 - share)) + 1


def read_texts(own: DataFrame, least: int, answers: bool) -> DataFrame:
    """(id, side, loaded_at, h, size, words, sketch, symbols) of the texts with enough words; size: distinct runs of K words.

    Of equal texts of one side in a batch only the first has a sketch and symbols, so that a hot group of copies is small before any shuffle.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = _texts(batch.column(3), answers)
            sides = np.array(batch.column(1).to_pylist(), dtype=object) == "eval"
            for a, b in batches(texts):
                w, rows, h = _hashed(texts[a:b], least)
                first = np.zeros(len(rows), bool)
                first[np.unique(mix(h ^ sides[a:b][rows].astype(U64)), return_index=True)[1]] = True
                place = np.full(b - a, -1)
                place[rows[first]] = np.arange(int(first.sum()))
                runs, doc = w.runs(K)
                runs, doc = runs[place[doc] >= 0], place[doc][place[doc] >= 0]
                n = int(first.sum())
                runs, doc = distinct_runs(runs, doc, n)
                symbols = (w.key >> U64(43)).astype(np.uint32) % np.uint32(GAP - 0x10000) + np.uint32(0x10000)
                mine = place[w.doc] >= 0
                count = np.diff(w.first)[rows]
                take, fill = pa.array(rows + a), pa.array(np.where(first, np.cumsum(first) - 1, 0), mask=~first)
                sketches = pa.array([x.tobytes() for x in odd_sketches(runs, doc, n)], pa.binary())
                columns = [pa.array(h.view(np.int64)), pa.array(np.bincount(doc, minlength=n).astype(np.int32), pa.int32()).take(fill), pa.array(count.astype(np.int32))]
                columns += [sketches.take(fill), as_strings(symbols[mine], count[first]).take(fill)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), *columns], names=["id", "side", "loaded_at", "h", "size", "words", "sketch", "symbols"])

    return own.mapInArrow(run, "id string, side string, loaded_at timestamp, h bigint, size int, words int, sketch binary, symbols string")


def as_strings(symbols: np.ndarray, length: np.ndarray) -> pa.Array:
    """Strings of so many symbols each; every symbol takes four bytes."""
    raw = symbols.astype("<u4").tobytes().decode("utf-32-le").encode()
    ends = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)).cast(pa.string())


def as_symbols(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all strings, number of the string of each)."""
    values = ["" if x is None else x for x in strings.to_pylist()]
    n = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer("".join(values).encode("utf-32-le"), np.uint32), np.repeat(np.arange(len(values)), n)


def text_members(read: DataFrame) -> DataFrame:
    """(id, side, h) of the texts, of each id the latest delivery."""
    order = F.struct(F.col("loaded_at").isNotNull(), "loaded_at", "h")
    return read.groupBy("id").agg(F.max_by(F.struct("side", "h"), order).alias("x")).select("id", "x.side", "x.h")


def passage_keys(symbols: np.ndarray) -> np.ndarray:
    """The hash of the passage that begins at each symbol (the last few don't begin any)."""
    n = max(0, len(symbols) - PASSAGE + 1)
    h = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(PASSAGE):
            h = h * U64(0x5851F42D4C957F2D) + symbols[j : n + j].astype(U64)
    return mix(h)


def tiles(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first symbol, key, number of the text) of the passages that each text is cut into; words over at the end are none."""
    keys = passage_keys(symbols)
    at = np.arange(len(doc)) - np.searchsorted(doc, doc)
    start = np.flatnonzero((at[: len(keys)] % PASSAGE == 0) & (doc[: len(keys)] == doc[PASSAGE - 1 :][: len(keys)]))
    return start, keys[start], doc[start]


def passage_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(how often passages of each hash bucket occur in the evaluation texts, number of passages): a sketch of a bounded size."""
    most = 1 << 20

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most, np.int64)
        for batch in stream:
            _, key, _ = tiles(*as_symbols(batch.column(0)))
            total += np.bincount((key & U64(most - 1)).astype(np.int64), minlength=most)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select("symbols").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(most, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(out, 1 << 30).astype(np.int32), int(out.sum())


def chosen_passages(texts: DataFrame, counts: np.ndarray, shards: int) -> DataFrame:
    """(h, size, sketch, shard, passages): of every evaluation text the passages looked for, by the shard of their key, one after the other.

    The most frequent ones are left out, as many as an edited copy at the threshold keeps but one.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)  # bounded

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            symbols, doc = as_symbols(batch.column(3))
            start, key, of = tiles(symbols, doc)
            order = np.lexsort((key, shared.value[(key & U64(len(shared.value) - 1)).astype(np.int64)], of))
            start, key, of = start[order], key[order], of[order]
            words, every = np.bincount(doc, minlength=batch.num_rows), np.bincount(of, minlength=batch.num_rows)
            kept = np.maximum(1, np.floor(words * (1 / PASSAGE - 1 / EDITED))).astype(np.int64)
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            wanted = rank < (every - kept + 1)[of]
            start, key, of = start[wanted], key[wanted], of[wanted]
            yield _by_shard(batch, symbols, start, key, of, shards, False)

    return texts.select("h", "size", "sketch", "symbols").mapInArrow(run, "h bigint, size int, sketch binary, shard int, passages string")


def _by_shard(batch: pa.RecordBatch, symbols: np.ndarray, start: np.ndarray, key: np.ndarray, of: np.ndarray, shards: int, merge: bool) -> pa.RecordBatch:
    """Rows (h, size, sketch, shard, symbols): the passages at ``start`` of each text and shard; merge: overlapping ones as one stretch, with a gap after each."""
    shard = ((key >> U64(40)) % U64(shards)).astype(np.int64)
    order = np.lexsort((start, shard, of))
    start, shard, of = start[order], shard[order], of[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (shard[1:] != shard[:-1])]) if len(of) else np.zeros(0, bool)
    length = np.full(len(start), PASSAGE)
    apart = np.ones(len(start), bool)
    if merge and len(start):
        apart = new | np.concatenate([[True], np.diff(start) > PASSAGE])
        length[~apart] = np.diff(start, prepend=start[:1])[~apart]
        start = np.where(apart, start, start + PASSAGE - length)
    ends = np.concatenate([apart[1:], [True]]) & merge if len(start) else apart
    out = length + ends
    begin = np.cumsum(out) - out
    at = np.repeat(start - begin, out) + np.arange(out.sum())
    text = symbols[np.minimum(at, len(symbols) - 1)] if len(symbols) else symbols
    text = text.copy()
    text[(begin + length)[ends]] = GAP
    group = np.cumsum(new) - 1
    n = int(new.sum())
    total = np.bincount(group, weights=out, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
    take = pa.array(of[new])
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(shard[new].astype(np.int32)), as_strings(text, total)], names=["h", "size", "sketch", "shard", "passages"])


def key_bits(chosen: DataFrame, passages: int) -> np.ndarray:
    """A bitmap of the keys of the passages looked for, 32 bits for each but 128 MB at most: without false negatives."""
    bits = min(1 << 30, max(1 << 20, 1 << (32 * passages).bit_length()))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            _, key, _ = tiles(*as_symbols(batch.column(0)))
            bit = np.unique((key & U64(bits - 1)).astype(np.int64))
            word = bit >> 5
            first = np.flatnonzero(np.diff(word, prepend=-1))
            value = np.bitwise_or.reduceat(np.int64(1) << (bit & 31), first) if len(first) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(value)], names=["word", "b"])

    rows = chosen.select("passages").mapInArrow(run, "word int, b bigint").groupBy("word").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("b").to_numpy().astype(np.uint32)
    return out


def stretches(texts: DataFrame, bits: np.ndarray, shards: int) -> DataFrame:
    """(h, size, sketch, shard, passages) of the training texts: the stretches where passages of a shard may match; no automaton can match elsewhere."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            symbols, doc = as_symbols(batch.column(3))
            key = passage_keys(symbols)
            bit = (key & U64(len(shared.value) * 32 - 1)).astype(np.int64)
            hit = (shared.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) == 1
            start = np.flatnonzero(hit & (doc[: len(key)] == doc[PASSAGE - 1 :][: len(key)]))
            yield _by_shard(batch, symbols, start, key[start], doc[start], shards, True)

    return texts.select("h", "size", "sketch", "symbols").mapInArrow(run, "h bigint, size int, sketch binary, shard int, passages string")


def _columns(x: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, size, sketch as words of 64 bits) of the rows."""
    return x.column("h").to_numpy(), x.column("size").to_numpy().astype(np.int64), np.frombuffer(b"".join(x.column("sketch").to_pylist()), U64).reshape(-1, ODD // 64)


def scan(chosen: DataFrame, training: DataFrame, parts: int, threshold: float = THRESHOLD) -> DataFrame:
    """(e, t): evaluation and training classes that share a passage and whose odd sketches differ no more than those of similar texts.

    Passages and stretches meet in the shard of their key, where an automaton of the passages scans the stretches; the training texts of a shard are divided into
    ``parts``, so that a task has a bounded number of passages and of texts. Owners of a passage are compared in blocks: no task holds all pairs.
    """
    part = F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int")
    left = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = training.withColumn("part", part)

    def run(own: pa.Table, texts: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if own.num_rows and texts.num_rows:
            automaton, ids = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
            rows = own.column("passages").to_pylist()
            number = np.array([ids.setdefault(row[at : at + PASSAGE], len(ids)) for row in rows for at in range(0, len(row), PASSAGE)], np.int64)
            for passage, k in ids.items():
                automaton.add_word(passage, k)
            automaton.make_automaton()
            eh, es, eo = _columns(own)
            th, ts, to = _columns(texts)
            # The owners of a passage by their size: those whose size is near enough to a text's lie side by side.
            number, owner = np.divmod(np.unique(number * len(rows) + np.repeat(np.arange(len(rows)), [len(row) // PASSAGE for row in rows])), len(rows))
            order = np.lexsort((es[owner], number))
            number, owner = number[order], owner[order]
            sizes = number * SIZES + es[owner]
            scanned = texts.column("passages").to_pylist()
            for a in range(0, len(scanned), 1000):  # what a few texts hit, then its pairs a million at a time
                hits = [{k for _, k in automaton.iter(x)} for x in scanned[a : a + 1000]]
                text = np.repeat(np.arange(a, a + len(hits)), [len(x) for x in hits])
                passage = np.fromiter(itertools.chain.from_iterable(hits), np.int64, len(text))
                first = np.searchsorted(sizes, passage * SIZES + np.maximum(np.floor(threshold * ts[text]).astype(np.int64) - 1, 0))
                n = np.searchsorted(sizes, passage * SIZES + np.minimum(np.ceil(ts[text] / threshold).astype(np.int64) + 1, SIZES - 1), "right") - first
                text, first, n = text[n > 0], first[n > 0], n[n > 0]
                total = np.cumsum(n)
                for low in range(0, int(total[-1]) if len(total) else 0, 1_000_000):
                    high = min(low + 1_000_000, int(total[-1]))
                    x = slice(int(np.searchsorted(total, low, "right")), int(np.searchsorted(total, high, "left")) + 1)
                    skipped = np.maximum(low - (total[x] - n[x]), 0)
                    m = np.minimum(high, total[x]) - (total[x] - n[x]) - skipped
                    places = np.repeat(first[x] + skipped - np.cumsum(m) + m, m) + np.arange(m.sum())
                    e, t = owner[places], np.repeat(text[x], m)  # a pair may come once for each passage that it shares
                    keep = np.minimum(es[e], ts[t]) >= threshold * np.maximum(es[e], ts[t]) - 1e-9
                    e, t = e[keep], t[keep]
                    keep = np.bitwise_count(eo[e] ^ to[t]).sum(axis=1) <= odd_limit(es[e] + ts[t], threshold)
                    e, t = np.divmod(np.unique(e[keep] * len(scanned) + t[keep]), len(scanned))
                    found.append((eh[e], th[t]))
        e, t = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(np.stack([e, t], axis=1), axis=0)
        return pa.table({"e": pa.array(pairs[:, 0]), "t": pa.array(pairs[:, 1])})

    met = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(run, "e bigint, t bigint")
    return met.distinct()


def similar(pairs: DataFrame, members: DataFrame, own: DataFrame, answers: bool, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (e, t) of classes whose distinct runs of k words have a Jaccard similarity of at least the threshold, with it and the share of e's words that merged common runs cover."""
    reps = members.groupBy("side", "h").agg(F.min("id").alias("id"))
    rep = lambda who, c: reps.where(F.col("side") == who).select(F.col("h").alias(c), F.col("id").alias(f"id_{c}"))
    named = cut_lineage(pairs.select("e", "t").join(rep("eval", "e"), "e").join(rep("train", "t"), "t"))
    needed = named.select(F.col("id_e").alias("id")).union(named.select("id_t")).distinct()

    def sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = _texts(batch.column(1), answers)
            w, _, h = _hashed(texts, 0)
            runs, doc = w.runs(k)
            ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
            text = pa.ListArray.from_arrays(ends, pa.array((runs >> U64(32)).astype(np.uint32).view(np.int32)))
            order = np.lexsort((runs, doc))
            runs, doc = (runs[order] >> U64(32)).astype(np.uint32).view(np.int32), doc[order]
            fresh = np.concatenate([[True], (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])]) if len(runs) else np.zeros(0, bool)
            runs, doc = runs[fresh], doc[fresh]
            bounds = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(bounds, pa.array(runs)), text], names=["id", "h", "runs", "text"])

    # an id's other deliveries have other hashes, or the same words
    runs = cut_lineage(own.select("id", "t").join(needed, "id", "left_semi").mapInArrow(sets, "id string, h bigint, runs array<int>, text array<int>"))
    of = lambda c, r, *more: runs.select(F.col("id").alias(f"id_{c}"), F.col("h").alias(c), F.col("runs").alias(r), *more)
    joined = named.join(of("e", "re", "text"), ["id_e", "e"]).join(of("t", "rt"), ["id_t", "t"])
    # sets whose sizes differ too much can't be similar
    joined = joined.where(F.least(F.size("re"), F.size("rt")) >= threshold * F.greatest(F.size("re"), F.size("rt")) - 1e-9)
    both = F.size(F.array_intersect("re", "rt"))
    value = both / F.greatest(F.size("re") + F.size("rt") - both, F.lit(1))
    close = joined.withColumn("similarity", value).where(F.col("similarity") >= threshold)
    close = close.withColumn("p", F.expr("filter(transform(text, (x, i) -> if(array_contains(rt, x), i, -1)), i -> i >= 0)"))
    words = F.expr(f"aggregate(transform(p, (x, i) -> if(i = 0, {k}, least({k}, x - get(p, i - 1)))), 0, (s, x) -> s + x)")
    return close.select("e", "t", "similarity", (words / (F.size("text") + k - 1)).alias("covered"))


def expanded(links: DataFrame, members: DataFrame, limit: int = EXPAND) -> DataFrame:
    """(eval_id, train_id) of linked classes. Beyond ``limit`` pairs of a link every copy comes with the other side's first."""
    sizes = members.groupBy("side", "h").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    e = sizes.where("side = 'eval'").select(F.col("h").alias("e"), F.col("n").alias("ne"), F.col("rep").alias("re"))
    t = sizes.where("side = 'train'").select(F.col("h").alias("t"), F.col("n").alias("nt"), F.col("rep").alias("rt"))
    sized = cut_lineage(links.select("e", "t").join(e, "e").join(t, "t"))
    me = members.where("side = 'eval'").select(F.col("h").alias("e"), F.col("id").alias("eval_id"))
    mt = members.where("side = 'train'").select(F.col("h").alias("t"), F.col("id").alias("train_id"))
    few, many = sized.where(F.col("ne") * F.col("nt") <= limit), sized.where(F.col("ne") * F.col("nt") > limit)
    every = few.join(me, "e").join(mt, "t").select("eval_id", "train_id")
    star = many.join(me, "e").select("eval_id", F.col("rt").alias("train_id")).union(many.join(mt, "t").select(F.col("re").alias("eval_id"), "train_id"))
    return every.union(star).distinct()


def partners(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, pairs) of the evaluation records of linked classes; pairs: their similar training records, all copies counted."""
    sizes = members.where("side = 'train'").groupBy(F.col("h").alias("t")).agg(F.count("*").alias("n"))
    of = links.join(sizes, "t").groupBy("e").agg(F.sum("n").alias("pairs"))
    return members.where("side = 'eval'").join(of, F.col("h") == F.col("e")).select("id", "pairs")


def membership(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, side, class_id, covered) of the records of linked classes; class_id: the class's first record of that side; covered: of an evaluation text, the greatest share of words that one training text covers."""
    ends = links.groupBy(F.lit("eval").alias("side"), F.col("e").alias("h")).agg(F.max("covered").alias("covered"))
    ends = ends.unionByName(links.select(F.lit("train").alias("side"), F.col("t").alias("h")).distinct().withColumn("covered", F.lit(None).cast("double")))
    first = members.groupBy("side", "h").agg(F.min("id").alias("class_id"))
    return members.join(ends, ["side", "h"]).join(first, ["side", "h"]).select("id", "side", "class_id", "covered")


def class_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """(eval_class, train_class): the linked classes by their first records, as in ``membership``."""
    first = members.groupBy("side", "h").agg(F.min("id").alias("id"))
    side_ = lambda who, c, name: first.where(F.col("side") == who).select(F.col("h").alias(c), F.col("id").alias(name))
    return links.select("e", "t").join(side_("eval", "e", "eval_class"), "e").join(side_("train", "t", "train_class"), "t").select("eval_class", "train_class")


def text_links(df: DataFrame, key: str, text: str, split: str, loaded: str, least: int, answers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (e, t, similarity, covered) of similar texts' classes, members (id, side, h) of all texts; of repeated keys the latest row counts.

    Null and short texts, null keys and unknown splits take no part.
    """
    own = df.select(F.col(key).cast("string").alias("id"), side(F.col(split)).alias("side"), F.col(loaded).cast("timestamp").alias("loaded_at"), F.col(text).alias("t")).where("id is not null and side is not null").where(F.length("t") >= 2 * least - 1)
    read = cut_lineage(read_texts(own, least, answers))
    members = cut_lineage(text_members(read))
    of = lambda who: read.where((F.col("side") == who) & F.col("symbols").isNotNull())
    counts, passages = passage_counts(of("eval"))
    shards, parts = max(1, -(-passages // SHARD)), max(1, -(-of("train").count() // ROWS))
    chosen = cut_lineage(chosen_passages(of("eval"), counts, shards))
    close = scan(chosen, stretches(of("train"), key_bits(chosen, passages), shards), parts)
    return similar(close, members, own, answers), members


def text_overlaps(df: DataFrame, key: str, text: str, split: str, loaded: str, least: int, answers: bool = False) -> DataFrame:
    """(eval_id, train_id): records of the evaluation splits and of train whose texts are similar, as ``text_links`` has them."""
    return expanded(*text_links(df, key, text, split, loaded, least, answers))


# ---- pictures


def _signature_plan() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1234)
    return rng.integers(0, 108, (GROUPS, BITS)), rng.uniform(0, 255, (GROUPS, BITS))


def small_pictures(data: list[bytes | None]) -> list[np.ndarray | None]:
    """24 x 24 x 3 means of each picture that decodes."""
    return [None if (p := decode(d)) is None else shrink(p) for d in data]


def _signature(small: list[np.ndarray], where: np.ndarray, limits: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all groups of bits, hash) of each small picture."""
    x = np.stack(small).astype(np.float32)
    means = x.reshape(len(x), 6, 4, 6, 4, 3).mean(axis=(2, 4)).reshape(len(x), 108)
    keys = np.zeros((len(x), GROUPS), U64)
    with np.errstate(over="ignore"):
        for g in range(GROUPS):
            keys[:, g] = mix(((means[:, where[g]] > limits[g]) * weights).sum(axis=1, dtype=U64) ^ mix(np.full(1, g, U64)))
        flat = (x * 4).astype(np.uint64).reshape(len(x), -1)
        h = mix((flat * mix(np.arange(flat.shape[1]).astype(U64))).sum(axis=1, dtype=U64))
    return keys, h


def picture_keys(df: DataFrame, key: str, image: str, split: str, loaded: str) -> DataFrame:
    """(id, side, h, keys ARRAY<BIGINT>, loaded_at) of the pictures that decode; equal small pictures have equal h."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, limits = _signature_plan()
        weights = U64(1) << np.arange(BITS, dtype=U64)
        for batch in stream:
            small = small_pictures(batch.column(2).to_pylist())
            rows = [i for i, p in enumerate(small) if p is not None]
            if not rows:
                continue
            parts = [_signature([small[i] for i in rows[at : at + 256]], where, limits, weights) for at in range(0, len(rows), 256)]
            keys, h = (np.concatenate(x) for x in zip(*parts))
            take = pa.array(rows)
            sides = np.array(batch.column(1).to_pylist(), dtype=object)[rows] == "eval"
            first = np.zeros(len(h), bool)
            first[np.unique(mix(h ^ sides.astype(U64)), return_index=True)[1]] = True  # of equal pictures in a batch one has keys
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * GROUPS), pa.array(keys.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(h.view(np.int64)), lists.take(pa.array(np.arange(len(h)), mask=~first)), batch.column(3).take(take)], names=["id", "side", "h", "keys", "loaded_at"])

    own = df.select(F.col(key).cast("string").alias("id"), side(F.col(split)).alias("side"), F.col(f"{image}.bytes").alias("b"), F.col(loaded).cast("timestamp").alias("loaded_at")).where("id is not null and side is not null and b is not null")
    return own.mapInArrow(run, "id string, side string, h bigint, keys array<bigint>, loaded_at timestamp")


def same_pictures(pairs: DataFrame, df: DataFrame, key: str, image: str, most: float = SAME_PICTURE) -> DataFrame:
    """The pairs (e, t, re, rt) whose small pictures' mean absolute difference is at most ``most``."""
    named = pairs.select(F.col("re").alias("id")).union(pairs.select("rt")).distinct()
    bytes_ = df.select(F.col(key).cast("string").alias("id"), F.col(f"{image}.bytes").alias("b")).join(named, "id", "left_semi")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            a, b = (small_pictures(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("ba", "bb"))
            keep = pa.array([p is not None and q is not None and float(np.abs(p - q).mean()) <= most for p, q in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("e", "t")], names=["e", "t"]).filter(keep)

    joined = pairs.join(bytes_.select(F.col("id").alias("re"), F.col("b").alias("ba")), "re").join(bytes_.select(F.col("id").alias("rt"), F.col("b").alias("bb")), "rt")
    return joined.select("e", "t", "ba", "bb").mapInArrow(run, "e bigint, t bigint")


def met(e: DataFrame, t: DataFrame, block: int = BLOCK) -> DataFrame:
    """(e, t) of the rows of either side with equal k. The right rows of a k are divided into blocks of about ``block``, and every left row meets each block, so that no task has all of a hot k."""
    blocks = t.groupBy("k").agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    left = e.join(blocks, "k").select("k", "e", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__b"))
    right = t.join(blocks.where("__n > 1"), "k", "left").select("k", "t", F.pmod(F.xxhash64("t"), F.coalesce("__n", F.lit(1))).cast("int").alias("__b"))
    return left.join(right, ["k", "__b"]).select("e", "t")


def picture_links(df: DataFrame, key: str, image: str, split: str, loaded: str) -> tuple[DataFrame, DataFrame]:
    """(links, members) as of texts, with no covered share: pictures that are the same or almost; those that don't decode take no part."""
    keyed = cut_lineage(picture_keys(df, key, image, split, loaded))
    order = F.struct(F.col("loaded_at").isNotNull(), "loaded_at", "h")
    members = cut_lineage(keyed.groupBy("id").agg(F.max_by(F.struct("side", "h"), order).alias("x")).select("id", "x.*"))
    classes = keyed.where("keys is not null").groupBy("side", "h").agg(F.first("keys").alias("keys"))  # equal pictures have equal keys
    bits = lambda who, c: classes.where(F.col("side") == who).select(F.explode("keys").alias("k"), F.col("h").alias(c))
    pairs = met(bits("eval", "e"), cut_lineage(bits("train", "t"))).distinct()
    reps = members.groupBy("side", "h").agg(F.min("id").alias("id"))
    rep = lambda who, c: reps.where(F.col("side") == who).select(F.col("h").alias(c), F.col("id").alias(f"r{c}"))
    pairs = cut_lineage(pairs.join(rep("eval", "e"), "e").join(rep("train", "t"), "t"))
    equal = pairs.where("e = t").select("e", "t")
    links = equal.union(same_pictures(pairs.where("e <> t"), df, key, image))
    return links.withColumn("covered", F.lit(None).cast("double")), members


def picture_overlaps(df: DataFrame, key: str, image: str, split: str, loaded: str) -> DataFrame:
    """(eval_id, train_id): records whose pictures are the same or almost."""
    return expanded(*picture_links(df, key, image, split, loaded))


def found_rows(overlaps: DataFrame, table: str, field: str) -> DataFrame:
    a, b = F.least("eval_id", "train_id"), F.greatest("eval_id", "train_id")
    return overlaps.where("eval_id <> train_id").select(F.lit(table).alias("tbl"), F.lit(field).alias("field"), a.alias("id_a"), b.alias("id_b"))
