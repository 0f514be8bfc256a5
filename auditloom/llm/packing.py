"""Problem 9: filling sequences of fixed capacity with documents, by the sum-of-squares rule.

Only a document that alone exceeds the capacity is divided: into full sequences and one rest. The rests and the
shorter documents are the items. Items are spread over buckets by a hash of their key, and each bucket is packed
online: an item goes to the fill level for which the sum over levels of the squared number of partly filled
sequences grows least. A bucket holds about ``bucket_items`` items at any size of the corpus, so that no task
grows with it; what stays partly filled at a bucket's end is joined once more, the fullest first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.config import cut_lineage

CAPACITY = 1024


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Number of the container of each item; sizes are from 1 to the capacity."""
    count = np.zeros(capacity + 1, np.int64)  # partly filled containers by fill level; full ones aren't counted
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of = np.empty(len(sizes), np.int64)
    bins = 0
    for k, s in enumerate(sizes.tolist()):
        most = capacity - s
        # moving one container from level h to h + s changes the sum by 2 (count[h + s] - count[h]) + 2
        gain = count[s : capacity + 1] - count[: most + 1]
        gain[count[: most + 1] == 0] = np.iinfo(np.int64).max
        gain[0] = count[s]  # a new container: 2 count[s] + 1, less by one half to be compared with the others
        h = most - int(np.argmin(gain[::-1]))  # of equal gains the fullest
        if h == 0:
            b, bins = bins, bins + 1
        else:
            b = levels[h].pop()
            count[h] -= 1
        bin_of[k] = b
        if h + s < capacity:
            levels[h + s].append(b)
            count[h + s] += 1
    fill = np.bincount(bin_of, weights=sizes, minlength=bins).astype(np.int64)
    return _join_open(bin_of, fill, capacity)


def _join_open(bin_of: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """Partly filled containers are joined, best fit, where their contents fit together."""
    target = np.arange(len(fill))
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for b in np.argsort(-fill, kind="stable").tolist():
        if fill[b] == capacity:
            continue
        fit = next((r for r in range(int(fill[b]), capacity) if room[r]), None)
        if fit is None:
            room[capacity - fill[b]].append(b)
        else:
            into = room[fit].pop()
            target[b] = into
            room[fit - fill[b]].append(into)
    return target[bin_of]


def pack_documents(counts: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, bucket_items: int = 50_000) -> DataFrame:
    """(key, piece, start_token, n_tokens, seq_id, seq_start): where each document's tokens stand.

    counts has one row a document; null and 0 sizes take no room and have no row. seq_id is unique in the result,
    seq_start the first token's place in the sequence. Repeated keys are packed as separate documents.
    """
    counts = cut_lineage(counts.select(key, size))  # counted once; the number of buckets needs the number of documents
    buckets = max(1, -(-counts.count() // bucket_items))
    sized = counts.select(F.col(key), F.col(size).cast("int").alias("__n")).where(F.col("__n") > 0)
    kind = sized.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start_token int, n_tokens int, seq_id bigint, seq_start int"

    def fill(bucket: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["__h", "__n"], kind="stable")
        n = items["__n"].to_numpy()
        whole, rest = n // capacity, n % capacity
        row = np.repeat(np.arange(len(n)), whole + (rest > 0))
        piece = np.arange(len(row)) - np.repeat(np.cumsum(whole + (rest > 0)) - whole - (rest > 0), whole + (rest > 0))
        tokens = np.minimum(capacity, n[row] - piece * capacity)
        seq = np.empty(len(row), np.int64)
        full = tokens == capacity
        seq[~full] = pack(tokens[~full], capacity)
        open_bins = int(seq[~full].max()) + 1 if (~full).any() else 0
        seq[full] = open_bins + np.arange(int(full.sum()))
        order = np.argsort(seq, kind="stable")
        ends = np.cumsum(tokens[order])
        heads = np.concatenate([[True], seq[order][1:] != seq[order][:-1]]) if len(order) else np.zeros(0, bool)
        before = ends - tokens[order]
        at = np.empty(len(row), np.int64)
        at[order] = before - np.maximum.accumulate(np.where(heads, before, 0))
        return pd.DataFrame({key: items[key].to_numpy()[row], "piece": piece, "start_token": piece * capacity, "n_tokens": tokens, "seq_id": (int(bucket[0]) << 32) + seq, "seq_start": at})

    hashed = sized.withColumn("__h", F.xxhash64(F.col(key), F.lit(9)))
    return hashed.withColumn("__b", F.pmod("__h", F.lit(buckets))).groupBy("__b").applyInPandas(fill, schema)
