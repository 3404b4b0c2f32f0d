"""Documents packed into containers of a fixed number of tokens."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.common import cut

#: A vocabulary file of ranks; any published one will do, the same for all documents.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is split before pairs are merged: the published pattern of that vocabulary, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Items packed together, about. What is left over of a block costs less than one container.
BLOCK = 40_000
#: Bits of a container's number that count within its block.
SHIFT = 32


@functools.cache
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("published", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoding(vocabulary)
        for b in batches:
            n = [len(e.encode_ordinary(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n"])

    return run


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, from 0. Sizes are 1 to capacity.

    Each container takes the largest items that fit, one by one; then its smallest one gives way to two others that fill
    the gap so widened more tightly, as long as there are such. Items of one size are alike, so the search goes over the
    sizes in stock, not over items.
    """
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    axis = np.arange(capacity + 1)
    order = np.argsort(sizes, kind="stable")
    nexts = (np.cumsum(count) - count).tolist()  # where the first item of a size, not yet packed, is in order
    at = np.empty(len(sizes), np.int64)
    fit = np.maximum.accumulate(np.where(count > 0, axis, 0))  # the largest size in stock up to each size

    def take(s: int) -> None:
        nonlocal fit
        count[s] -= 1
        if not count[s]:
            fit = np.maximum.accumulate(np.where(count > 0, axis, 0))

    left, box = len(sizes), 0
    while left:
        held, room = [], capacity
        while room and (s := int(fit[room])):
            take(s)
            held.append(s)
            room -= s
        while room and len(held) > 0:
            s = held[-1]  # they come in falling order, so the last is the smallest
            wide = room + s
            a = np.flatnonzero(count[: wide + 1])
            if not len(a):
                break
            b = fit[wide - a]
            same = (b == a) & (count[a] < 2)
            if same.any():
                below = np.concatenate([[0], fit])[a]  # the largest size in stock below each
                b = np.where(same, np.minimum(below, wide - a), b)
            both = np.where(b > 0, a + b, 0)
            i = int(np.argmax(both))
            if both[i] <= s:
                break
            held.pop()
            count[s] += 1
            if count[s] == 1:
                fit = np.maximum.accumulate(np.where(count > 0, axis, 0))
            for x in sorted((int(a[i]), int(b[i])), reverse=True):
                take(x)
                held.append(x)
            held.sort(reverse=True)
            room = wide - int(both[i])
        for s in held:
            at[order[nexts[s]]] = box
            nexts[s] += 1
        left -= len(held)
        box += 1
    return at


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, doc_id, part_no, start_token, n_tokens) of items (doc_id, n).

    An item above the capacity is cut: full parts have containers of their own, and only its rest is packed with others.
    All others stay whole. Items are packed in blocks by hash, each within one task; a block has a bounded number of
    items, whatever their sizes. Items without tokens or with a null size are dropped, repeated rows are items each.
    """
    items = cut(items.select("doc_id", F.col("n").cast("long").alias("n")).where("n > 0"), "sizes")
    blocks = max(1, -(-items.count() // BLOCK))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat([pd.DataFrame({"doc_id": [], "n": []}), *batches])
        if not len(p):
            return
        n = p["n"].to_numpy(np.int64)
        full, rest = n // capacity, n % capacity
        some = np.flatnonzero(rest)
        at = best_two_fit(rest[some], capacity) if len(some) else np.zeros(0, np.int64)
        base = int(at.max()) + 1 if len(at) else 0
        owner = np.repeat(np.arange(len(n)), full)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        ids, mark = p["doc_id"].to_numpy(), np.int64(p["block"].iloc[0]) << SHIFT
        yield pd.DataFrame(
            {
                "container_id": mark + np.concatenate([at, base + np.arange(len(owner))]),
                "doc_id": np.concatenate([ids[some], ids[owner]]),
                "part_no": np.concatenate([full[some], part]).astype(np.int32),
                "start_token": np.concatenate([full[some] * capacity, part * capacity]),
                "n_tokens": np.concatenate([rest[some], np.full(len(owner), capacity)]),
            }
        )

    kind = dict(items.dtypes)["doc_id"]
    # a hash spreads rows evenly even where one id repeats without end; a row's place in its file tells repeats apart
    spread = items.withColumn("_h", F.xxhash64("doc_id", "n", F.monotonically_increasing_id())).repartition(blocks, "_h").withColumn("block", F.spark_partition_id())
    return spread.select("doc_id", "n", "block").mapInPandas(run, f"container_id long, doc_id {kind}, part_no int, start_token long, n_tokens long")


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """pack over the tokens of each non-empty text, in whole. vocabulary: a file that every executor has at that path."""
    sizes = documents.select("doc_id", "text").where("doc_id is not null and length(text) > 0").mapInArrow(_counted(vocabulary), "doc_id long, n long")
    return pack(sizes, capacity)
