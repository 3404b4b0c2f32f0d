"""Which entities to embed again: every strategy is (entities changed, scores, edges) to rows (node)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.common import cut, running
from revsift.operators.graph import clean_edges, decayed_strength, dependents, pagerank

THRESHOLD, HOPS, SHARE = 0.02, 1, 0.3


def changed_only(changed: DataFrame) -> DataFrame:
    return changed.select("node").distinct()


def full_reindex(nodes: DataFrame) -> DataFrame:
    return nodes.select("node").distinct()


def fixed_hop(changed: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """What changed and its callers within so many hops."""
    return dependents(clean_edges(edges), changed, hops).select("node")


def predictive(scores: DataFrame, changed: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Scores from the threshold on; with `changed`, also what changed."""
    hit = scores.where(F.col("score") >= threshold).select("node")
    return (hit.unionByName(changed.select("node")) if changed is not None else hit).distinct()


def pagerank_propagation(nodes: DataFrame, changed: DataFrame, edges: DataFrame, share: float = SHARE, rounds: int | None = None) -> DataFrame:
    """What changed, and the nodes nearest to it by personalised rank until a share of all nodes is reached; ties by node."""
    nodes, changed = nodes.select("node").distinct(), changed.select("node").distinct()
    rank = cut(pagerank(nodes, clean_edges(edges), changed, rounds=rounds), "rank")
    n, m = nodes.count(), changed.count()
    more = max(0, int(share * n) - m)
    near = rank.where("rank > 0").join(changed, "node", "left_anti").select("node", F.round("rank", 12).alias("rank"), F.lit(1).alias("one"))
    # the share may be a third of all nodes, so their places come from counts of sorted ranges
    near = running(near, [F.desc("rank"), F.col("node")], {"place": ("sum", "one")}).where(F.col("place") <= more)
    return changed.unionByName(near.select("node")).distinct()


def bfs_decay(changed: DataFrame, edges: DataFrame, threshold: float = 0.05, hops: int = 6) -> DataFrame:
    return decayed_strength(clean_edges(edges), changed, threshold, hops).select("node")


def decided(name: str, nodes: DataFrame, changed: DataFrame, edges: DataFrame, scores: DataFrame | None = None, hops: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(strategy_name, node) by the strategy's name; what it lacks (a model's scores) and an unknown name mean changed only.
    predictive takes scores alone, predictive_ml adds what changed."""
    made = {
        "full_reindex": lambda: full_reindex(nodes), "fixed_hop": lambda: fixed_hop(changed, edges, hops), "pagerank": lambda: pagerank_propagation(nodes, changed, edges), "bfs_decay": lambda: bfs_decay(changed, edges),
        **({"predictive": lambda: predictive(scores, None, threshold), "predictive_ml": lambda: predictive(scores, changed, threshold)} if scores is not None else {}),
    }
    return made.get(name, lambda: changed_only(changed))().select(F.lit(name).alias("strategy_name"), "node")


def all_decisions(nodes: DataFrame, changed: DataFrame, edges: DataFrame, scores: DataFrame, threshold: float = THRESHOLD, hops: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(strategy_name, node) of every strategy, fixed hops by their number."""
    rows = [decided(s, nodes, changed, edges, scores, threshold=threshold) for s in ("changed_only", "full_reindex", "predictive", "pagerank", "bfs_decay")]
    rows += [fixed_hop(changed, edges, k).select(F.lit(f"fixed_hop_{k}").alias("strategy_name"), "node") for k in hops]
    return reduce(lambda a, b: a.unionByName(b), rows)


def maintenance_cost(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(strategy_name, updated, update_percentage): decided nodes by all nodes; ids that are no nodes count too, so it may
    exceed 100."""
    n = nodes.select("node").distinct().agg(F.count("*").alias("n"))
    x = decisions.distinct().groupBy("strategy_name").agg(F.count("*").alias("updated")).crossJoin(F.broadcast(n))  # one row
    return x.select("strategy_name", "updated", F.when(F.col("n") > 0, 100.0 * F.col("updated") / F.col("n")).otherwise(0.0).alias("update_percentage"))
