"""Which entities are stale between two commits, for one pair or many, and how a sequence of such decisions unfolds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.common import cut, forget
from revsift.operators import graph
from revsift.operators.context import sides

PAIR = ["commit_before", "commit_after"]
STRATEGIES = ("changed_only", "fixed_hop", "predictive_ml", "full_reindex")


def changed_entities(entities: DataFrame, pairs: DataFrame, form: str = "source_code", files: DataFrame | None = None) -> DataFrame:
    """(pair, entity_id) of the later snapshot's entities that are new or whose column `form` differs; with files (pair,
    file_path), only those of these files. A null equals a null."""
    x = sides(entities, pairs, ["entity_id", "file_path"] if files is not None else ["entity_id"], F.md5(F.col(form).cast("string")))
    if files is not None:
        x = x.join(files.select(*PAIR, "file_path").distinct(), [*PAIR, "file_path"], "left_semi")
    return x.where("has").where(~F.col("had") | ~F.col("old").eqNullSafe(F.col("new"))).select(*PAIR, "entity_id")


def dependents_by_pair(edges: DataFrame, pairs: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(pair, entity_id): starts (pair, entity_id) and their callers in the later snapshot within so many hops."""
    name = lambda c: F.concat_ws("\x01", "commit_before", "commit_after", c)
    e = edges.join(pairs.select(*PAIR, F.col("commit_after").alias("commit_hash")), "commit_hash").where("src <> dst").select(name("dst").alias("src"), name("src").alias("dst"))
    p = F.split("node", "\x01")
    return graph.distances(e, starts.select(name("entity_id").alias("node")), hops).select(p[0].alias("commit_before"), p[1].alias("commit_after"), p[2].alias("entity_id"))


def stale_entities(
    pairs: DataFrame, entities: DataFrame, edges: DataFrame, strategy: str = "predictive_ml", hops: int = 1, threshold: float = 0.02,
    score: Callable[[DataFrame, DataFrame], DataFrame] | None = None, form: str = "source_code", files: DataFrame | None = None,
) -> DataFrame:
    """(commit_before, commit_after, entity_id) of what to embed again at commit_after of each pair.

    changed_only: new or changed entities. fixed_hop: also their callers within `hops`. predictive_ml: what changed, and of
    the callers within two hops those whose score reaches the threshold; score maps (candidates, changed), both (pair,
    entity_id), to candidates with a column score. full_reindex: all. Without changes a pair has no rows (but for the last).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "predictive_ml" and score is None:
        raise ValueError("predictive_ml needs a model's scores")
    pairs = cut(pairs.select(*PAIR).distinct(), "pairs")
    if strategy == "full_reindex":
        return pairs.join(entities.select(F.col("commit_hash").alias("commit_after"), "entity_id").distinct(), "commit_after").select(*PAIR, "entity_id")
    changed = cut(changed_entities(entities, pairs, form, files), "changed")
    if strategy == "changed_only":
        return changed
    near = dependents_by_pair(edges, pairs, changed, hops if strategy == "fixed_hop" else 2)
    if strategy == "fixed_hop":
        return near
    hit = score(near, changed).where(F.col("score") >= threshold).select(*PAIR, "entity_id")
    return changed.unionByName(hit).distinct()


def stale_summary(stale: DataFrame, pairs: DataFrame, entities: DataFrame, strategy: str, model_path: str | None = None) -> DataFrame:
    """(from_commit, to_commit, total_entities, stale_count, reembed_ratio, strategy, model_path): one row a pair, also without
    stale entities; the ratio of an empty snapshot is 0."""
    total = entities.groupBy(F.col("commit_hash").alias("commit_after")).agg(F.countDistinct("entity_id").alias("total_entities"))
    n = stale.groupBy(*PAIR).agg(F.count("*").alias("stale_count"))
    x = pairs.select(*PAIR).distinct().join(total, "commit_after", "left").join(n, PAIR, "left").fillna(0, ["total_entities", "stale_count"])
    ratio = F.when(F.col("total_entities") > 0, F.col("stale_count") / F.col("total_entities")).otherwise(0.0)
    return x.select(F.col("commit_before").alias("from_commit"), F.col("commit_after").alias("to_commit"), "total_entities", "stale_count", ratio.alias("reembed_ratio"), F.lit(strategy).alias("strategy"), F.lit(model_path).cast("string").alias("model_path"))


class StaleCache:
    """The decisions above for two commits of one repository, from its tables: entities and calls (commit_hash, src, dst)."""

    def __init__(self, entities: DataFrame, edges: DataFrame, strategy: str = "predictive_ml", hops: int = 1, threshold: float = 0.02, score=None, model_path: str | None = None) -> None:
        self.entities, self.edges, self.model_path = entities, edges, model_path
        self.options = {"strategy": strategy, "hops": hops, "threshold": threshold, "score": score}

    def _pair(self, before: str, after: str) -> DataFrame:
        return self.entities.sparkSession.createDataFrame([(before, after)], "commit_before string, commit_after string")

    def stale_ids(self, before: str, after: str) -> DataFrame:
        return stale_entities(self._pair(before, after), self.entities, self.edges, **self.options).select("entity_id").orderBy("entity_id")

    def stale(self, before: str, after: str) -> DataFrame:
        """The later snapshot's rows of the stale entities."""
        return self.entities.where(F.col("commit_hash") == after).join(self.stale_ids(before, after), "entity_id", "left_semi")

    def summary(self, before: str, after: str) -> DataFrame:
        pair = self._pair(before, after)
        return stale_summary(stale_entities(pair, self.entities, self.edges, **self.options), pair, self.entities, self.options["strategy"], self.model_path)


def kept_nodes(nodes: DataFrame, scores: DataFrame, modified: DataFrame, threshold: float) -> DataFrame:
    """nodes (id, ...) that were modified or whose score reaches the threshold; without a score only if modified."""
    hit = scores.where(F.col("score") >= threshold).select("id").unionByName(modified.select("id")).distinct()
    return nodes.join(hit, "id", "left_semi")


def ingestion_rows(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(commit_hash, id, text, metadata) of entities, with their callers and callees, sorted. A row lists an entity's direct
    neighbours, which is what this format asks for."""
    e = edges.where("src <> dst").select("commit_hash", "src", "dst").distinct()
    callees = e.groupBy("commit_hash", F.col("src").alias("entity_id")).agg(F.array_sort(F.collect_list("dst")).alias("callees"))
    callers = e.groupBy("commit_hash", F.col("dst").alias("entity_id")).agg(F.array_sort(F.collect_list("src")).alias("callers"))
    x = entities.join(callers, ["commit_hash", "entity_id"], "left").join(callees, ["commit_hash", "entity_id"], "left")
    none = F.array().cast("array<string>")
    meta = F.struct("file_path", "entity_type", "lineno", "end_lineno", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"), F.col("entity_id").alias("cpg_id"))
    return x.select("commit_hash", F.col("entity_id").alias("id"), F.col("source_code").alias("text"), meta.alias("metadata"))


def without_files(entities: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without those of files (commit_hash, file_path), at either end."""
    gone = entities.join(files, ["commit_hash", "file_path"], "left_semi").select("commit_hash", "entity_id")
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone.withColumnRenamed("entity_id", end), ["commit_hash", end], "left_anti")
    return entities.join(files, ["commit_hash", "file_path"], "left_anti"), left


def sequence_fold(steps: DataFrame, digests: DataFrame, edges: DataFrame, strategy: str = "changed_only", hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """(decisions, anchors) of a strategy along sequences of snapshots, where each decision changes what is cached.

    steps (repo, commit_before, commit_after, step from 0); digests (commit_hash, entity_id, digest). At the first step all
    of commit_before is cached. At each step an entity counts as changed if it is new or differs from the version that it
    was last embedded at, its anchor; the strategy decides, and what it decides is anchored anew. Deleted entities keep
    their anchors. decisions (repo, commit_after, step, entity_id); anchors (repo, entity_id, anchor_commit, update_count).

    The steps follow each other, but step i of all sequences is one job; the state is written after each.
    """
    steps, digests = cut(steps, "steps"), cut(digests.select("commit_hash", "entity_id", "digest"), "digests")
    edges = cut(edges.select("commit_hash", "src", "dst"), "calls")
    first = steps.where("step = 0").select("repo", F.col("commit_before").alias("commit_hash"))
    state = cut(first.join(digests, "commit_hash").select("repo", "entity_id", F.col("commit_hash").alias("anchor_commit"), "digest", F.lit(0).cast("long").alias("update_count")), "anchors")
    decisions, last = None, steps.agg(F.max("step")).first()[0]
    for i in range(-1 if last is None else last + 1):
        now = steps.where(F.col("step") == i)
        here = now.select("repo", F.col("commit_before"), F.col("commit_after"), F.col("commit_after").alias("commit_hash")).join(digests, "commit_hash")
        old = state.select("repo", "entity_id", F.col("digest").alias("was"), F.lit(True).alias("known"))
        seen = cut(here.join(old, ["repo", "entity_id"], "left"), "seen")
        changed = seen.where(F.col("known").isNull() | ~F.col("was").eqNullSafe(F.col("digest")))
        if strategy == "changed_only":
            chosen = changed.select("repo", "entity_id")
        elif strategy == "full_reindex":
            chosen = seen.select("repo", "entity_id")
        elif strategy == "fixed_hop":
            name = lambda c: F.concat_ws("\x01", "repo", c)
            e = edges.join(now.select("repo", F.col("commit_after").alias("commit_hash")), "commit_hash").select(name("dst").alias("src"), name("src").alias("dst"))
            p = F.split("node", "\x01")
            chosen = graph.distances(e, changed.select(name("entity_id").alias("node")), hops).select(p[0].alias("repo"), p[1].alias("entity_id"))
        else:
            raise ValueError(f"unknown strategy {strategy}")
        made = cut(seen.join(chosen.distinct(), ["repo", "entity_id"], "left_semi").select("repo", "commit_after", F.lit(i).alias("step"), "entity_id", "digest"), "decided")
        decisions = made.drop("digest") if decisions is None else decisions.unionByName(made.drop("digest"))
        fresh = made.select("repo", "entity_id", F.col("commit_after").alias("anchor"), F.col("digest").alias("form"), F.lit(1).alias("n"))
        both = state.join(fresh, ["repo", "entity_id"], "full")
        past = state
        state = cut(
            both.select(
                "repo", "entity_id", F.coalesce("anchor", "anchor_commit").alias("anchor_commit"), F.when(F.col("n").isNotNull(), F.col("form")).otherwise(F.col("digest")).alias("digest"),
                (F.coalesce("update_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("update_count"),
            ), "anchors"
        )
        forget(past, seen)
    if decisions is None:
        decisions = steps.select("repo", "commit_after", "step", F.lit(None).cast("string").alias("entity_id")).where("false")
    return decisions, state.select("repo", "entity_id", "anchor_commit", "update_count")
