"""Full snapshots of a table: the current rows of each, its neighbours, and what changed between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.common import cut, partitions, small

#: A key starts a chunk if its hash is 0 modulo this; so chunks have this many rows on average.
CHUNK_ROWS = 16
#: A chunk is cut at so many rows even without a boundary key. It bounds what a task carries over, and nothing else.
CHUNK_MOST = 4096


def normal_text(text: Column) -> Column:
    """text with one kind of line end and no white space at the end of a line or of the text. Null stays null."""
    one = F.when(F.instr(text, "\r") > 0, F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(one, r"(?<![^\S\n])[^\S\n]++(?=\n|\z)", ""), r"(?<!\s)\s++\z", "")


def digest(text: Column) -> Column:
    """128 bits of the normal form of a text, null for null."""
    return F.unhex(F.md5(normal_text(text)))


def current_rows(rows: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Of each key the row with the latest `at`; of equal times the greatest columns in order. Null times are earliest.

    Columns that a later step doesn't use aren't shuffled: each is taken by its own aggregate over the same order.
    """
    order = F.struct(F.col(at), *[F.col(c) for c in columns])
    return rows.groupBy(*keys).agg(F.max(order).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in columns])


def neighbours(commits: DataFrame, having: DataFrame) -> DataFrame:
    """(commit_before, commit_after) of commits next to each other by seq in one repo, among those in `having.commit_hash`.

    Repeated commits count once, with their smallest seq; equal seqs are ordered by hash. A commit without repo or seq has
    no neighbours.
    """
    from pyspark.sql import Window

    c = commits.select("repo", "commit_hash", "seq").where("repo is not null and seq is not null and commit_hash is not null")
    c = c.groupBy("repo", "commit_hash").agg(F.min("seq").alias("seq"))
    c = c.join(having.select("commit_hash").distinct(), "commit_hash", "left_semi")
    w = Window.partitionBy("repo").orderBy("seq", "commit_hash")
    return c.select(F.lag("commit_hash").over(w).alias("commit_before"), F.col("commit_hash").alias("commit_after")).where("commit_before is not null")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's chunk as (c1, c2, n): two sums over its rows' hashes, and their number. Rows come sorted.

    Only an open chunk is carried from batch to batch, at most CHUNK_MOST rows.
    """

    def closed(t: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        h = t.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
        n = np.diff(np.append(starts, len(h)))
        with np.errstate(over="ignore"):
            c1 = np.add.reduceat(h, starts)
            c2 = np.add.reduceat((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), starts)
        out = [t.column("commit_hash"), t.column("entity_id"), t.column("digest"), *(pa.array(np.repeat(x.view(np.int64), n)) for x in (c1, c2)), pa.array(np.repeat(n, n))]
        return pa.RecordBatch.from_arrays(out, names=["commit_hash", "entity_id", "digest", "c1", "c2", "n"])

    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        s = t.column("commit_hash").dictionary_encode().indices.to_numpy()
        edge = t.column("edge").to_numpy(zero_copy_only=False).astype(bool)
        edge[0] = True
        edge[1:] |= s[1:] != s[:-1]
        starts = np.flatnonzero(edge)
        gaps = np.diff(np.append(starts, t.num_rows))
        if (gaps > CHUNK_MOST).any():
            starts = np.concatenate([np.arange(a, a + g, CHUNK_MOST) for a, g in zip(starts, gaps)])
        last = int(starts[-1])
        if last:
            yield closed(t.slice(0, last), starts[:-1])
        rest = t.slice(last)
    if rest is not None:
        yield closed(rest, np.array([0]))


def snapshot_changes(entities: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit_before, commit_after, entity_id, change_kind) between neighbouring snapshots: added, removed or changed.

    The current rows (latest ingested_at) of each snapshot are sorted by key over range partitions and cut into
    content-defined chunks. Chunks that both neighbours hold, by digest, are discarded; only rows of the others are joined
    by key. A snapshot of any size is spread over all partitions; a partition's end merely cuts one more chunk.

    changed: the text differs apart from line ends and trailing white space. A null text differs from any text and equals a
    null one. Rows with a null commit or id belong to no snapshot. Repeated rows count once; of rows that share their
    latest time yet differ, the greatest digest counts. Empty tables give no rows. Other columns are ignored.
    """
    spark = entities.sparkSession
    slim = entities.where("commit_hash is not null and entity_id is not null").select("commit_hash", "entity_id", "ingested_at", digest(F.col("source_code")).alias("digest"))
    slim = cut(current_rows(slim, ["commit_hash", "entity_id"], "ingested_at", ["digest"]), "current")
    pairs = cut(neighbours(commits, slim), "pairs")
    rows = slim.withColumn("h", F.xxhash64("entity_id", "digest", F.lit(7))).withColumn("edge", F.expr(f"pmod(xxhash64(entity_id), {CHUNK_ROWS}) = 0"))
    rows = rows.repartitionByRange(partitions(spark), "commit_hash", "entity_id").sortWithinPartitions("commit_hash", "entity_id")
    rows = cut(rows.mapInArrow(_chunked, "commit_hash string, entity_id string, digest binary, c1 long, c2 long, n long"), "chunked")

    chunk = ["c1", "c2", "n"]
    chunks = rows.select("commit_hash", *chunk).distinct()
    pairs = small(pairs)
    sides = chunks.join(pairs.withColumn("commit_hash", F.col("commit_before")), "commit_hash").withColumn("side", F.lit(1))
    sides = sides.unionByName(chunks.join(pairs.withColumn("commit_hash", F.col("commit_after")), "commit_hash").withColumn("side", F.lit(2)))
    open_ = sides.groupBy("commit_before", "commit_after", *chunk).agg(F.bit_or("side").alias("side")).where("side < 3")
    open_ = open_.withColumn("commit_hash", F.when(F.col("side") == 1, F.col("commit_before")).otherwise(F.col("commit_after")))
    both = rows.join(open_, ["commit_hash", *chunk]).groupBy("commit_before", "commit_after", "entity_id").agg(
        F.bit_or("side").alias("side"), F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("old"), F.max(F.when(F.col("side") == 2, F.col("digest"))).alias("new")
    )
    kind = F.when(F.col("side") == 1, "removed").when(F.col("side") == 2, "added").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select("commit_before", "commit_after", "entity_id", kind.alias("change_kind")).where("change_kind is not null")
