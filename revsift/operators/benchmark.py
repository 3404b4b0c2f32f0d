"""What a strategy costs in retrieval: rows for each query, summaries for each strategy, labels from displaced ranks."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.common import cut
from revsift.operators.retrieval import ndcg, sign_p, spearman, wilson

#: Vectors of an index that one task scores, and queries it scores them for.
INDEX_BLOCK, QUERY_BLOCK = 50_000, 2_000


def per_query_rows(ranks: DataFrame, cases: DataFrame, pairs: DataFrame, hit_k: int = 10, ndcg_k: int = 10, baseline: str = "full_reindex") -> DataFrame:
    """The 26 fields of every query and strategy against the baseline's rank of the same run's pair.

    ranks (run_id, query_id, strategy_name, target_rank, target_score); cases, the query set; pairs (run_id, commit_before,
    commit_after, updated_entity_fraction) where known. Of several rankings of the baseline the best counts, and equal
    targets' first case. target_stale is whether the target's score differs beyond 1e-6 + 1e-5 x the baseline's.
    """
    b = ranks.where(F.col("strategy_name") == baseline).groupBy("query_id").agg(F.min(F.struct(F.col("target_rank").alias("baseline_rank"), F.col("target_score").alias("baseline_score"))).alias("b")).select("query_id", "b.*")
    q = cases.groupBy("query_id").agg(*[F.min(c).alias(c) for c in ("query_text", "query_source", "category", "target_entity_id", "target_entity_name", "expected_behavior")])
    x = ranks.where(F.col("strategy_name") != baseline).join(b, "query_id").join(q, "query_id").join(pairs, "run_id", "left")
    base, mine = F.col("baseline_rank"), F.col("target_rank")
    hit_b, hit_s = base <= hit_k, mine <= hit_k
    latest = F.coalesce(F.col("expected_behavior") == "latest_snapshot", F.lit(False))
    gain_b, gain_s = ndcg(base, ndcg_k), ndcg(mine, ndcg_k)
    return x.select(
        "run_id", "commit_before", "commit_after", "query_id", "query_text", "query_source", "category", "target_entity_id", "target_entity_name", "expected_behavior", base.cast("int").alias("baseline_rank"),
        mine.cast("int").alias("selective_rank"), (mine - base).cast("int").alias("rank_delta"), "baseline_score", F.col("target_score").alias("selective_score"), (F.col("target_score") - F.col("baseline_score")).alias("score_delta"),
        "updated_entity_fraction", F.when(gain_b > 0, gain_s / gain_b).otherwise(1.0).alias("ndcg_ratio"), hit_b.alias("top_k_hit_baseline"), hit_s.alias("top_k_hit_selective"), (latest & hit_s).alias("freshness_pass"),
        (~latest & hit_s).alias("cache_preservation_pass"), (mine == base).alias("rank_agreement"), (~hit_b | hit_s).alias("relative_freshness_pass"),
        (F.abs(F.col("target_score") - F.col("baseline_score")) > 1e-6 + 1e-5 * F.abs("baseline_score")).alias("target_stale"), "strategy_name",
    )


def strategy_summary(rows: DataFrame, costs: DataFrame, ndcg_k: int = 10, by: tuple[str, ...] = ("strategy_name",)) -> DataFrame:
    """One row a strategy: rates, both sides' MRR and nDCG, their ratios and deltas, intervals, and the share that was embedded
    again over all pairs. costs (by, updated, entities). Rates of nothing are 0; ratios and agreement are 1."""
    latest = F.coalesce(F.col("expected_behavior") == "latest_snapshot", F.lit(False))
    mean = lambda c: F.avg(1 / F.col(c))
    x = rows.groupBy(*by).agg(
        F.count("*").alias("total_queries"), F.count_if(latest).alias("changed_queries"), F.count_if("freshness_pass").alias("freshness_successes"), F.count_if("cache_preservation_pass").alias("cache_successes"),
        F.count_if("top_k_hit_baseline").alias("_bh"), F.count_if(F.col("top_k_hit_baseline") & F.col("top_k_hit_selective")).alias("_both"), F.avg(F.col("rank_agreement").cast("double")).alias("rank_agreement_rate"),
        mean("baseline_rank").alias("baseline_mrr"), mean("selective_rank").alias("selective_mrr"), F.avg(ndcg(F.col("baseline_rank"), ndcg_k)).alias("baseline_ndcg"), F.avg(ndcg(F.col("selective_rank"), ndcg_k)).alias("selective_ndcg"),
    )
    x = x.withColumn("unchanged_queries", F.col("total_queries") - F.col("changed_queries")).join(costs, list(by), "left")
    share = lambda a, b, none: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(none)
    fresh, kept = wilson(F.col("freshness_successes"), F.col("changed_queries")), wilson(F.col("cache_successes"), F.col("unchanged_queries"))
    return x.select(
        *by, "total_queries", "changed_queries", "unchanged_queries", "freshness_successes", "cache_successes", share("freshness_successes", "changed_queries", 0.0).alias("freshness_success_rate"),
        share("cache_successes", "unchanged_queries", 0.0).alias("cache_preservation_success_rate"), share("_both", "_bh", 1.0).alias("relative_freshness_rate"), "rank_agreement_rate", "baseline_mrr", "selective_mrr", "baseline_ndcg",
        "selective_ndcg", (F.col("selective_mrr") - F.col("baseline_mrr")).alias("mrr_delta"), (F.col("selective_ndcg") - F.col("baseline_ndcg")).alias("ndcg_delta"), share("selective_mrr", "baseline_mrr", 1.0).alias("mrr_ratio"),
        share("selective_ndcg", "baseline_ndcg", 1.0).alias("ndcg_ratio"), F.coalesce(share("updated", "entities", 0.0), F.lit(0.0)).alias("candidate_update_fraction"), fresh[0].alias("freshness_low"), fresh[1].alias("freshness_high"),
        kept[0].alias("preservation_low"), kept[1].alias("preservation_high"),
    )


def quality_scores(summary: DataFrame, losses: DataFrame, k: int = 10) -> DataFrame:
    """(strategy_name, quality, label): retention at k where losses are known, else the freshness rate."""
    at = losses.where(F.col("k") == k).select("strategy_name", "retention")
    x = summary.join(at, "strategy_name", "left")
    return x.select("strategy_name", F.coalesce("retention", "freshness_success_rate").alias("quality"), F.when(F.col("retention").isNotNull(), f"retention@{k}").otherwise("freshness").alias("label"))


def saturation(summary: DataFrame, losses: DataFrame | None, min_effect: float = 0.001, spread: float = 0.05) -> DataFrame:
    """One row (strategies, update_spread, strongest_loss, saturated): whether strategies differ in cost by more than 0.10 while
    none loses a measurable share of hits at any k; without losses, while both success rates differ by less than `spread`."""
    gap = lambda c: F.max(c) - F.min(c)
    s = summary.agg(F.count("*").alias("strategies"), gap("candidate_update_fraction").alias("update_spread"), gap("freshness_success_rate").alias("_f"), gap("cache_preservation_success_rate").alias("_c"))
    low = (losses if losses is not None else summary.select(F.lit(0.0).alias("loss_low"))).agg(F.coalesce(F.max("loss_low"), F.lit(0.0)).alias("strongest_loss"))
    calm = F.col("strongest_loss") <= min_effect if losses is not None else (F.col("_f") < spread) & (F.col("_c") < spread)
    return s.crossJoin(low).select("strategies", "update_spread", "strongest_loss", ((F.col("strategies") >= 2) & (F.col("update_spread") > 0.10) & calm).alias("saturated"))  # one row each


def set_metrics(ranking: DataFrame, truth: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """(by, wanted, recall, mrr, ndcg) of rankings (by, entity_id, score) against sets (by, entity_id), by binary gains; 0
    without a relevant id. Ranks come from counts of higher scores, equal scores by id; only relevant ids are ranked."""
    n = truth.distinct().groupBy(*by).agg(F.count("*").alias("wanted"))
    r = ranking.select(*by, "entity_id", "score")
    good = r.join(truth.distinct(), [*by, "entity_id"], "left_semi").select(*by, F.col("entity_id").alias("_id"), F.col("score").alias("_score"))
    above = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("entity_id") <= F.col("_id")))
    at = good.join(r, by).where(above).groupBy(*by, "_id").agg(F.count("*").alias("rank"))
    x = at.groupBy(*by).agg(F.count_if(F.col("rank") <= k).alias("_hit"), F.min("rank").alias("_first"), F.sum(ndcg(F.col("rank"), k)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = F.lit(0.0)
    return n.join(x, by, "left").select(*by, "wanted", F.coalesce(F.col("_hit") / F.col("wanted"), zero).alias("recall"), F.coalesce(1 / F.col("_first"), zero).alias("mrr"), F.coalesce(F.col("_dcg") / ideal, zero).alias("ndcg"))


def _blocks(queries: DataFrame, index: DataFrame, part: str) -> DataFrame:
    """Query vectors and index vectors of a part, in blocks that meet each other once: rows (part, q, e, side, ...)."""
    size = lambda d, n: d.groupBy(part).agg(F.ceil(F.count("*") / n).cast("int").alias("n"))
    nq, ne = size(queries, QUERY_BLOCK).withColumnRenamed("n", "nq"), size(index, INDEX_BLOCK).withColumnRenamed("n", "ne")
    n = nq.join(ne, part)
    block = lambda id_, of: F.expr(f"cast(pmod(xxhash64({id_}), {of}) as int)")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    q = queries.join(n, part).withColumn("q", block("query_id", "nq")).withColumn("e", every("ne"))
    e = index.join(n, part).withColumn("e", block("entity_id", "ne")).withColumn("q", every("nq"))
    none = F.lit(None)
    q = q.select(part, "q", "e", F.col("query_id").alias("id"), F.col("target_entity_id").alias("target"), F.col("vector"), F.col("fresh"), F.col("stale"))
    e = e.select(part, "q", "e", F.col("entity_id").alias("id"), none.cast("string").alias("target"), "vector", none.cast("double").alias("fresh"), none.cast("double").alias("stale"))
    return q.withColumn("side", F.lit(0)).unionByName(e.withColumn("side", F.lit(1)))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), np.float64)


def top_k(queries: DataFrame, index: DataFrame, part: str, k: int = 10) -> DataFrame:
    """(part, query_id, entity_id, score, position): the k best of index (part, entity_id, vector) by dot product for each of
    queries (part, query_id, vector); equal scores by id. A block of queries meets each block of the index in one task, which
    keeps k rows a query; all vectors of a part have one length."""
    q = queries.select(part, "query_id", F.lit(None).cast("string").alias("target_entity_id"), "vector", F.lit(None).cast("double").alias("fresh"), F.lit(None).cast("double").alias("stale"))
    kind = dict(index.dtypes)[part]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p[p["side"] == 0], p[p["side"] == 1].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({part: [], "query_id": [], "entity_id": [], "score": []})
        s = _matrix(a["vector"]) @ _matrix(b["vector"]).T
        near = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({part: p[part].iloc[0], "query_id": np.repeat(a["id"].to_numpy(), near.shape[1]), "entity_id": b["id"].to_numpy()[near.ravel()], "score": np.take_along_axis(s, near, 1).ravel()})

    best = _blocks(q, index, part).groupBy(part, "q", "e").applyInPandas(run, f"{part} {kind}, query_id string, entity_id string, score double")
    x = best.groupBy(part, "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "entity_id"))), 1, k).alias("b"))  # k rows a block
    return x.select(part, "query_id", F.posexplode("b").alias("position", "b")).select(part, "query_id", "b.entity_id", (-F.col("b.low")).alias("score"), (F.col("position") + 1).alias("position"))


def leave_one_out(before: DataFrame, after: DataFrame, queries: DataFrame, part: str, k: int = 10) -> DataFrame:
    """(part, entity_id, query_id, fresh_rank, stale_rank, displaced, delta): for every query the rank of its target, as embedded
    now and with its own vector as it was, all others being fresh.

    before, after (part, entity_id, vector): entities of both take part. queries (part, query_id, target_entity_id, vector).
    A rank is one more than the higher scores of others. Queries against all vectors, block by block; counts are summed up.
    """
    both = after.join(before.select(part, "entity_id", F.col("vector").alias("_old")), [part, "entity_id"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = queries.join(both.select(part, F.col("entity_id").alias("target_entity_id"), F.col("vector").alias("_new"), "_old"), [part, "target_entity_id"])
    q = q.select(part, "query_id", "target_entity_id", "vector", dot("vector", "_new").alias("fresh"), dot("vector", "_old").alias("stale"))
    kind = dict(after.dtypes)[part]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p[p["side"] == 0], p[p["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({part: [], "query_id": [], "entity_id": [], "above_fresh": [], "above_stale": []})
        s = _matrix(a["vector"]) @ _matrix(b["vector"]).T
        s[a["target"].to_numpy()[:, None] == b["id"].to_numpy()[None]] = -np.inf
        up = lambda c: (s > a[c].to_numpy()[:, None] + 1e-12).sum(axis=1)
        return pd.DataFrame({part: p[part].iloc[0], "query_id": a["id"], "entity_id": a["target"], "above_fresh": up("fresh"), "above_stale": up("stale")})

    x = _blocks(q, both.select(part, "entity_id", "vector"), part).groupBy(part, "q", "e").applyInPandas(run, f"{part} {kind}, query_id string, entity_id string, above_fresh long, above_stale long")
    x = x.groupBy(part, "entity_id", "query_id").agg((F.sum("above_fresh") + 1).alias("fresh_rank"), (F.sum("above_stale") + 1).alias("stale_rank"))
    displaced = (F.col("fresh_rank") <= k) & (F.col("stale_rank") > k)
    return x.withColumns({"displaced": displaced, "delta": ndcg(F.col("fresh_rank"), k) - ndcg(F.col("stale_rank"), k)})


def displacement_labels(rows: DataFrame, entities: DataFrame, part: str, alpha: float = 0.05, least: int = 5, rule: str = "significant") -> DataFrame:
    """(part, entity_id, label, displaced, evaluated, positive, mean_delta, p, is_covered) of entities (part, entity_id) from the
    rows of leave_one_out. Fewer than `least` queries (1 at least): not covered, label 0, p 1. Rule any_displacement: a query
    fell out of the k best; significant: and the exact sign test of the gains lost is below alpha."""
    if rule not in ("significant", "any_displacement"):
        raise ValueError(f"unknown rule {rule}")
    g = rows.groupBy(part, "entity_id").agg(
        F.count("*").alias("evaluated"), F.count_if("displaced").alias("displaced"), F.count_if(F.col("delta") > 0).alias("positive"), F.count_if(F.col("delta") != 0).alias("nonzero"), F.avg("delta").alias("mean_delta")
    )
    x = entities.select(part, "entity_id").distinct().join(g, [part, "entity_id"], "left").fillna(0)
    p: Column = sign_p("positive", "nonzero")
    covered = F.col("evaluated") >= max(1, least)
    x = x.withColumns({"is_covered": covered, "p": F.when(covered, p).otherwise(1.0)})
    hit = covered & (F.col("displaced") >= 1) & (F.col("p") < alpha if rule == "significant" else F.lit(True))
    keep = lambda c, none: F.when(F.col("is_covered"), F.col(c)).otherwise(none).alias(c)
    return x.select(part, "entity_id", hit.cast("int").alias("label"), "displaced", "evaluated", keep("positive", 0), keep("mean_delta", 0.0), "p", "is_covered")


def drift_by_distance(rows: DataFrame) -> DataFrame:
    """(distance, n, mean_drift, max_drift) of rows (distance, drift)."""
    return rows.where("distance is not null and drift is not null").groupBy("distance").agg(F.count("*").alias("n"), F.avg("drift").alias("mean_drift"), F.max("drift").alias("max_drift"))


def _above(queries: DataFrame, index: DataFrame, part: str) -> DataFrame:
    """(part, query_id, above): vectors of the index that score higher than the query's own column `fresh`."""
    q = queries.select(part, "query_id", F.lit(None).cast("string").alias("target_entity_id"), "vector", "fresh", F.col("fresh").alias("stale"))
    kind = dict(index.dtypes)[part]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b = p[p["side"] == 0], p[p["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({part: [], "query_id": [], "above": []})
        s = _matrix(a["vector"]) @ _matrix(b["vector"]).T
        return pd.DataFrame({part: p[part].iloc[0], "query_id": a["id"], "above": (s > a["fresh"].to_numpy()[:, None] + 1e-12).sum(axis=1)})

    x = _blocks(q, index, part).groupBy(part, "q", "e").applyInPandas(run, f"{part} {kind}, query_id string, above long")
    return x.groupBy(part, "query_id").agg(F.sum("above").alias("above"))


def evaluate_strategies(before: DataFrame, after: DataFrame, decisions: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(strategy_name, entities_updated, total_entities, update_percentage, recall_at_k, mrr, ndcg_at_10, rank_correlation): what an
    index costs and finds that holds fresh vectors where a strategy decided so, or nothing was cached, and old ones elsewhere.

    before, after (entity_id, vector); decisions (strategy_name, entity_id); queries (query_id, vector). Relevant are the k best
    of the fresh index. MRR looks for the first of its ten best at any depth. The correlation is that of the scores summed over all
    queries, which are the products with the sum of their vectors. Queries against both indexes, block by block.
    """
    names = decisions.select("strategy_name").distinct()
    every = lambda d: d.join(F.broadcast(names), how="cross")  # strategies are a handful
    old = before.select("entity_id", F.col("vector").alias("_old"))
    done = decisions.select("strategy_name", "entity_id").distinct().withColumn("_done", F.lit(True))
    mixed = every(after.join(old, "entity_id", "left")).join(done, ["strategy_name", "entity_id"], "left")
    mixed = mixed.select("strategy_name", "entity_id", F.when(F.col("_done") | F.col("_old").isNull(), F.col("vector")).otherwise(F.coalesce("_old", "vector")).alias("vector"), F.col("vector").alias("_new"))
    mixed = cut(mixed, "mixed")
    one = lambda d: d.withColumn("part", F.lit(0))
    best = cut(top_k(one(queries), one(after), "part", max(10, *ks)).select("query_id", "entity_id", F.col("position").alias("wanted")), "relevant")
    asked = cut(every(queries.select("query_id", "vector")), "asked")
    near = top_k(asked, mixed.select("strategy_name", "entity_id", "vector"), "strategy_name", max(10, *ks))
    n = best.groupBy("query_id").agg(F.count("*").alias("_n"))
    hit = near.join(best, ["query_id", "entity_id"])
    got = hit.groupBy("strategy_name", "query_id").agg(
        *[F.count_if((F.col("position") <= k) & (F.col("wanted") <= k)).alias(f"_h{k}") for k in ks], F.sum(F.when(F.col("wanted") <= 10, ndcg(F.col("position"), 10)).otherwise(0.0)).alias("_dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    ten = every(best.where("wanted <= 10").select("query_id", "entity_id")).join(mixed.select("strategy_name", "entity_id", F.col("vector").alias("_v")), ["strategy_name", "entity_id"])
    first = ten.join(asked, ["strategy_name", "query_id"]).groupBy("strategy_name", "query_id").agg(F.max(dot("vector", "_v")).alias("fresh"))
    first = _above(asked.join(first, ["strategy_name", "query_id"]), mixed.select("strategy_name", "entity_id", "vector"), "strategy_name")
    x = asked.select("strategy_name", "query_id").join(n, "query_id").join(got, ["strategy_name", "query_id"], "left").join(first, ["strategy_name", "query_id"], "left")
    x = x.groupBy("strategy_name").agg(
        *[F.avg(F.coalesce(f"_h{k}", F.lit(0)) / F.least(F.col("_n"), F.lit(k))).alias(f"recall_at_{k}") for k in ks], F.avg(F.coalesce(1 / (F.col("above") + 1), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg_at_10")
    )
    total = queries.select(F.posexplode("vector").alias("i", "e")).groupBy("i").agg(F.sum(F.col("e").cast("double")).alias("e")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda v: v["e"]).alias("_sum"))  # one row
    scores = mixed.crossJoin(F.broadcast(total)).select("strategy_name", dot("_sum", "_new").alias("a"), dot("_sum", "vector").alias("b"))
    size = mixed.join(done, ["strategy_name", "entity_id"], "left").groupBy("strategy_name").agg(F.count("*").alias("total_entities"))
    cost = done.groupBy("strategy_name").agg(F.count("*").alias("entities_updated")).join(size, "strategy_name")
    r = spearman(scores, ["strategy_name"], "a", "b").select("strategy_name", F.col("spearman").alias("rank_correlation"))
    cost = cost.withColumn("update_percentage", 100.0 * F.col("entities_updated") / F.col("total_entities"))
    return cost.select("strategy_name", "entities_updated", "total_entities", "update_percentage").join(x, "strategy_name").join(r, "strategy_name")
