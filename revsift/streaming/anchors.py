"""At which commit each cached vector was last made, per strategy: as one query over a table, and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def anchors(events: DataFrame, keys: list[str], at: str, commit: str, done: str) -> DataFrame:
    """(keys, anchor_commit, update_count) of events: the commit of the latest event that embedded anew, else of the first
    event, and how many did. One aggregate, no fold: an anchor is the last change."""
    hit = F.when(F.col(done), F.struct(F.col(at).alias("at"), F.col(commit).alias("c")))
    first = F.min(F.struct(F.col(at).alias("at"), F.col(commit).alias("c")))
    return events.groupBy(*keys).agg(F.coalesce(F.max(hit)["c"], first["c"]).alias("anchor_commit"), F.count_if(done).alias("update_count"))


def initial(entities: DataFrame, strategies: list[str], commit: str) -> DataFrame:
    """(strategy, entity_id, anchor_commit, update_count) of a cache that was just filled at a commit."""
    return entities.select("entity_id").distinct().select(F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"), "entity_id", F.lit(commit).alias("anchor_commit"), F.lit(0).cast("long").alias("update_count"))


def updated(state: DataFrame, done: DataFrame, commit: str) -> DataFrame:
    """state after done (strategy, entity_id) were embedded at a commit: known ones are marked, new ones registered."""
    x = state.join(done.select("strategy", "entity_id").distinct().withColumn("_done", F.lit(True)), ["strategy", "entity_id"], "full")
    hit = F.col("_done").isNotNull()
    return x.select("strategy", "entity_id", F.when(hit, F.lit(commit)).otherwise(F.col("anchor_commit")).alias("anchor_commit"), (F.coalesce("update_count", F.lit(0)) + hit.cast("long")).alias("update_count"))


def stale(state: DataFrame, digests: DataFrame, commit: str) -> DataFrame:
    """(strategy, entity_id) of a commit's entities that are not cached or differ from their version at their anchor, by
    digests (commit_hash, entity_id, digest). One join for all anchors; an anchor whose commit is unknown is stale."""
    now = digests.where(F.col("commit_hash") == commit).select("entity_id", F.col("digest").alias("now"))
    was = digests.select(F.col("commit_hash").alias("anchor_commit"), "entity_id", F.col("digest").alias("was"), F.lit(True).alias("_there"))
    every = state.select("strategy").distinct().join(now.withColumn("_all", F.lit(1)), F.col("_all") == 1)  # strategies are a handful
    x = every.join(state, ["strategy", "entity_id"], "left").join(was, ["anchor_commit", "entity_id"], "left")
    return x.where(F.col("_there").isNull() | ~F.col("was").eqNullSafe(F.col("now"))).select("strategy", "entity_id")


def stats(state: DataFrame) -> DataFrame:
    """(strategy, cached, anchors, updates): how many entities, at how many different commits, and embeddings made since."""
    return state.groupBy("strategy").agg(F.count("*").alias("cached"), F.countDistinct("anchor_commit").alias("anchors"), F.sum("update_count").alias("updates"))


def anchor_stream(events: DataFrame) -> DataFrame:
    """anchors over a stream of (strategy, entity_id, at, commit, done), as updates of the keys that a batch touched.

    The state of a key is its anchor, its time and the count, whatever the number of events."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, time, count, was_done = state.get if state.exists else ("", 0, 0, False)
        for p in frames:
            for at, commit, done in zip(p["at"], p["commit"], p["done"]):
                at, done = int(at), bool(done)
                count += done
                later = (at, commit) > (time, anchor) if done else (at, commit) < (time, anchor)
                if not anchor or (done and not was_done) or (done == was_done and later):
                    anchor, time, was_done = commit, at, done
        state.update((anchor, time, count, was_done))
        yield pd.DataFrame({"strategy": [key[0]], "entity_id": [key[1]], "anchor_commit": [anchor], "update_count": [count]})

    return events.groupBy("strategy", "entity_id").applyInPandasWithState(
        step, "strategy string, entity_id string, anchor_commit string, update_count long", "anchor string, time long, count long, was_done boolean", "update", GroupStateTimeout.NoTimeout
    )
