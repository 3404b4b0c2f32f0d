"""The N best items of every group, by exact positions in one global order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revsift.common import cut, partitions
from revsift.functions.text import bound


def _ranks(n: int, keys: list[str], out: list[str]):
    """Over a sorted partition: rows with their place in the group within it, as far as n. edge: the group is the first or
    the last of the partition, so it may go on in another one. Of the open group at most n rows are held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, count, group, held = None, 0, -1, []

        def flush(edge: bool) -> Iterator[pa.RecordBatch]:
            for t, r in held:
                yield pa.RecordBatch.from_arrays([*t.columns, r, pa.array(np.full(t.num_rows, edge))], names=[*out, "_rank", "_edge"])
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = tuple(b.column(k)[0].as_py() for k in keys) != before
            for k in keys if b.num_rows > 1 else []:
                here, there = b.column(k).slice(1), b.column(k).slice(0, b.num_rows - 1)
                same = pc.or_kleene(pc.equal(here, there), pc.and_(pc.is_null(here), pc.is_null(there)))
                new[1:] |= ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
            nth = np.cumsum(new)  # 0: the group that was open
            starts = np.concatenate([[-count], np.flatnonzero(new)])
            rank = np.arange(b.num_rows) - starts[nth] + 1
            last = int(nth[-1])
            if last:  # the group that was open has ended
                yield from flush(group == 0)
            for ended, m in ((True, (rank <= n) & (nth < last)), (False, (rank <= n) & (nth == last))):
                if m.any():
                    t, r = b.select(out).filter(pa.array(m)), pa.array(rank[m].astype(np.int64))
                    if ended:
                        yield pa.RecordBatch.from_arrays([*t.columns, r, pa.array(group + nth[m] == 0)], names=[*out, "_rank", "_edge"])
                    else:
                        held.append((t, r))
            before, count, group = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys), int(rank[-1]), group + last
        yield from flush(True)

    return run


def top_n(items: DataFrame, group: list[str], item: str, score: str, n: int) -> DataFrame:
    """(group columns, item, score, position from 1): the n best items of every group by score, then item ascending.

    An item counts once in a group, with its best score. Items that are null, or whose score is null or NaN, don't count.
    Null groups are groups. All items are range-partitioned and sorted on group, score and item, so one group may fill
    many partitions and none is too large; each partition counts its groups' rows, and the counts of groups that go on
    in other partitions (at most two a partition) are summed up into exact positions.
    """
    names = [f"_g{i}" for i in range(len(group))]
    x = items.select(*[F.col(g).alias(a) for g, a in zip(group, names)], F.col(item).alias("_item"), F.col(score).cast("double").alias("_score"))
    x = x.where("_item is not null and _score is not null and not isnan(_score)").groupBy(*names, "_item").agg(F.max("_score").alias("_score"))
    order = [*[F.asc_nulls_first(a) for a in names], F.desc("_score"), F.asc("_item")]
    x = x.repartitionByRange(partitions(items.sparkSession), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    out = [*names, "_item", "_score", "_part"]
    kinds = dict(x.dtypes)
    ranked = cut(x.mapInArrow(_ranks(n, names, out), ", ".join(f"{c} {kinds[c]}" for c in out) + ", _rank long, _edge boolean"), "ranked")

    counts = ranked.where("_edge").groupBy(*names, "_part").agg(F.max("_rank").alias("_n"))
    w = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(a).alias(f"_s{a}") for a in names], F.col("_part").alias("_p"), F.sum("_n").over(w).alias("_before")).where("_before > 0")
    same = (F.col("_part") == F.col("_p")) & F.col("_edge")
    for a in names:
        same = same & F.col(a).eqNullSafe(F.col(f"_s{a}"))
    # shift has at most two rows for each partition
    all_ = ranked.join(F.broadcast(shift), same, "left").withColumn("position", F.col("_rank") + F.coalesce("_before", F.lit(0)))
    return all_.where(F.col("position") <= n).select(*[F.col(a).alias(g) for g, a in zip(group, names)], F.col("_item").alias(item), F.col("_score").alias(score), F.col("position").cast("int").alias("position"))


def top_ranked(results: DataFrame, n: int = 10) -> DataFrame:
    """top_n over rankings: the i-th of ranked_scores belongs to the i-th of ranked_entity_ids, an id or score beyond the
    shorter list counts for nothing, and so do null and empty lists.

    Of a ranking only its own n best ids are moved, each with its best score: what n others of one row surpass can't be
    among the group's n best. Repeats are next to each other in a list sorted by id, so a ranking of any length is cut in
    the time that its sort takes.
    """
    usable = "filter(arrays_zip(ranked_entity_ids, ranked_scores), e -> e.ranked_entity_ids is not null and not isnan(coalesce(e.ranked_scores, double('NaN'))))"
    by_id = F.expr(f"sort_array(transform({usable}, e -> struct(e.ranked_entity_ids as entity_id, -double(e.ranked_scores) as low)))")

    def own(e: Column) -> Column:
        first = F.filter(e, lambda v, i: (i == 0) | (F.get(e, i - 1)["entity_id"] != v["entity_id"]))
        return F.slice(F.sort_array(F.transform(first, lambda v: F.struct(v["low"].alias("low"), v["entity_id"].alias("entity_id")))), 1, n)

    x = results.select("run_id", "query_id", F.explode(bound(by_id, own)).alias("e"))
    return top_n(x.select("run_id", "query_id", F.col("e.entity_id").alias("entity_id"), (-F.col("e.low")).alias("score")), ["run_id", "query_id"], "entity_id", "score", n)
