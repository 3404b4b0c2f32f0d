"""Drift of vectors, ranks of targets, hits lost and gained, and what strategies cost."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revsift.common import running


def usable(v: Column) -> Column:
    """Whether a vector has no null or NaN and is not all zeros."""
    return F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e)) & F.exists(v, lambda e: e != 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is unusable or lengths differ; within -1 and 1."""
    raw = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.when(usable(a) & usable(b) & (F.size(a) == F.size(b)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def drifts(comparisons: DataFrame) -> DataFrame:
    """(comparison_id, strategy_name, entity_id, commit_after, status, cosine, drift); the status is derived from which side exists where null."""
    b, c = F.col("baseline_raw_vector"), F.col("candidate_raw_vector")
    status = F.coalesce("status", F.when(b.isNull() & c.isNotNull(), "added").when(c.isNull() & b.isNotNull(), "removed").otherwise("unchanged"))
    x = comparisons.select("comparison_id", "strategy_name", "entity_id", "commit_before", "commit_after", status.alias("status"), cosine(b, c).alias("cosine")).distinct()
    return x.withColumn("drift", 1 - F.col("cosine"))


def selective_index(comparisons: DataFrame) -> DataFrame:
    """(comparison_id, vector, fresh): the fresh vector where it was made anew or nothing is cached, else the cached one;
    removed entities drop out."""
    anew = F.coalesce(F.col("status").isin("modified", "added"), F.lit(False)) | F.col("baseline_raw_vector").isNull()
    x = comparisons.select("comparison_id", F.when(anew, F.col("candidate_raw_vector")).otherwise(F.col("baseline_raw_vector")).alias("vector"), anew.alias("fresh"), F.coalesce("status", F.lit("unchanged")).alias("s"))
    return x.where("s <> 'removed' and vector is not null").drop("s").distinct()


def ranking(results: DataFrame) -> DataFrame:
    """(run_id, query_id, strategy_name, entity_id, score): each id once, with its best usable score."""
    e = results.select("run_id", "query_id", "strategy_name", F.explode(F.arrays_zip(F.col("ranked_entity_ids").alias("i"), F.col("ranked_scores").alias("s"))).alias("e"))
    e = e.select("run_id", "query_id", "strategy_name", F.col("e.i").alias("entity_id"), F.col("e.s").alias("score")).where("entity_id is not null and score is not null and not isnan(score)")
    return e.groupBy("run_id", "query_id", "strategy_name", "entity_id").agg(F.max("score").alias("score"))


def target_ranks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(run_id, query_id, strategy_name, target_rank, target_score): one more than the scores above the target's; a missing
    target comes after all, with score 0. Rankings of queries without a case are left out.

    Two aggregates, so that no group is gathered: the target's score, then the counts above it.
    """
    r = ranking(results)
    target = cases.select("query_id", "target_entity_id").distinct()
    groups = ["run_id", "query_id", "strategy_name"]
    own = r.join(target, "query_id").where("entity_id = target_entity_id").select(*groups, F.col("score").alias("t"))
    x = r.join(target.select("query_id"), "query_id", "left_semi").join(own, groups, "left").groupBy(*groups).agg(F.count("*").alias("n"), F.max("t").alias("t"), F.count_if(F.col("score") > F.col("t")).alias("above"))
    return x.select(*groups, F.when(F.col("t").isNull(), F.col("n") + 1).otherwise(F.col("above") + 1).alias("target_rank"), F.coalesce("t", F.lit(0.0)).alias("target_score"))


def ndcg(rank: Column, k: int) -> Column:
    """Of a single target: 1 / log2(rank + 1) within k, else 0."""
    return F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)


def recall_at(rank: Column, k: int) -> Column:
    return (rank <= k).cast("double")


def reciprocal(rank: Column, n: Column) -> Column:
    """1 / rank, 0 for a rank beyond the n that were ranked."""
    return F.when(rank <= n, 1 / rank).otherwise(0.0)


def deltas(baseline_rank: Column, selective_rank: Column, baseline_score: Column, selective_score: Column) -> tuple[Column, Column]:
    """(rank_delta, score_delta): selective less baseline."""
    return (selective_rank - baseline_rank).alias("rank_delta"), (selective_score - baseline_score).alias("score_delta")


def ir_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    hit = lambda k: F.avg((F.col("target_rank") <= k).cast("double")).alias(f"recall_{k}")
    return ranks.groupBy(*by).agg(F.count("*").alias("queries"), hit(1), hit(5), hit(10), F.avg(1 / F.col("target_rank")).alias("mrr"), F.avg(ndcg(F.col("target_rank"), 10)).alias("ndcg_10"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the interval for a share; (0, 0) for n = 0."""
    p = hits / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def lost_at_k(pairs: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(by, k, n, baseline_hits, lost, gained, loss_rate, loss_low, loss_high, gain_rate, retention) of (baseline_rank,
    selective_rank): of the baseline's hits those lost, of its misses those gained."""
    x = pairs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    b, s = F.col("baseline_rank") <= F.col("k"), F.col("selective_rank") <= F.col("k")
    x = x.groupBy(*by, "k").agg(F.count("*").alias("n"), F.count_if(b).alias("baseline_hits"), F.count_if(b & ~s).alias("lost"), F.count_if(~b & s).alias("gained"))
    low, high = wilson(F.col("lost"), F.col("baseline_hits"))
    rate = F.when(F.col("baseline_hits") > 0, F.col("lost") / F.col("baseline_hits")).otherwise(0.0)
    gain = F.when(F.col("n") > F.col("baseline_hits"), F.col("gained") / (F.col("n") - F.col("baseline_hits"))).otherwise(0.0)
    return x.select(*by, "k", "n", "baseline_hits", "lost", "gained", rate.alias("loss_rate"), low.alias("loss_low"), high.alias("loss_high"), gain.alias("gain_rate"), (1 - rate).alias("retention"))


def paired_ranks(ranks: DataFrame, baseline: str = "full_reindex") -> DataFrame:
    """(strategy_name, query_id, baseline_rank, selective_rank): every other ranking of a query against its best baseline one."""
    b = ranks.where(F.col("strategy_name") == baseline).groupBy("query_id").agg(F.min("target_rank").alias("baseline_rank"))
    return ranks.where(F.col("strategy_name") != baseline).join(b, "query_id").select("strategy_name", "query_id", "baseline_rank", F.col("target_rank").alias("selective_rank"))


def upper_tail(k: int, m: int) -> float:
    """P(X >= k) for m fair coins: the regularised incomplete beta function at 1/2, by its continued fraction, so that neither
    many coins nor a tail near 0 or 1 is out of reach."""
    if k <= 0:
        return 1.0
    if k > m:
        return 0.0
    if 2 * k <= m:  # the fraction converges fast on the other side of the middle
        return 1.0 - upper_tail(m - k + 1, m)
    a, b = float(k), float(m - k + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - (a + b) * math.log(2.0)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * 0.5 / (a + 1), tiny)
    value = d
    for i in range(1, 100_000):
        for step in (i * (b - i) * 0.5 / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * 0.5 / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, max(0.0, front * value))


def sign_p(positive: str | Column, nonzero: str | Column) -> Column:
    """One-sided exact sign test of counts: 1 without a positive."""

    def of(k: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([upper_tail(int(a), int(b)) for a, b in zip(k, m)], dtype=float)

    return F.pandas_udf(of, "double")(positive, nonzero)


def sign_test(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, positive, nonzero, p): one-sided exact binomial test that ranks got worse; ties dropped, 1 without a positive."""
    d = F.col("selective_rank") - F.col("baseline_rank")
    x = pairs.groupBy(*by).agg(F.count_if(d > 0).alias("positive"), F.count_if(d != 0).alias("nonzero"))
    return x.select(*by, "positive", "nonzero", sign_p("positive", "nonzero").alias("p"))


def pareto(points: DataFrame, cost: str, quality: str) -> DataFrame:
    """points with on_frontier: no other point is as good in both and better in one. Equal points are both kept.

    The best quality of each cost, and its running maximum over range partitions of the distinct costs.
    """
    best = points.groupBy(F.col(cost).alias("_cost")).agg(F.max(quality).alias("_best"))
    best = running(best, [F.col("_cost")], {"_before": ("max", "_best")}, before=True)
    x = points.join(best, points[cost] == best["_cost"])
    return x.withColumn("on_frontier", (F.col("_best") <= F.col(quality)) & (F.col("_before").isNull() | (F.col("_before") < F.col(quality)))).drop("_cost", "_best", "_before")


def coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, needed, reembedded, hit, missed, extra, coverage) of rows with booleans needs and done; 1 if nothing is needed."""
    x = rows.groupBy(*by).agg(F.count_if("needs").alias("needed"), F.count_if("done").alias("reembedded"), F.count_if(F.col("needs") & F.col("done")).alias("hit"))
    return x.select(*by, "needed", "reembedded", "hit", (F.col("needed") - F.col("hit")).alias("missed"), (F.col("reembedded") - F.col("hit")).alias("extra"), F.when(F.col("needed") > 0, F.col("hit") / F.col("needed")).otherwise(1.0).alias("coverage"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, spearman): correlation of tie-averaged ranks; 0 below two rows or without variance. Null pairs don't count.

    Ranks come from the counts of distinct values, so a group's rows are never sorted together.
    """
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))

    def ranks(c: str) -> DataFrame:
        n = r.groupBy(*by, c).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        return n.select(*by, c, (F.sum("_n").over(w) - (F.col("_n") - 1) / 2).alias(f"_r{c}"))

    r = r.join(ranks("_x"), [*by, "_x"]).join(ranks("_y"), [*by, "_y"])
    c = F.corr("_r_x", "_r_y")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0)).alias("spearman"))


def pr_curve(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, true_positives, flagged, precision, recall) at every distinct score, from the highest.

    The running sums go over range partitions of the distinct scores, however many there are.
    """
    by = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("threshold")).agg(F.count_if(label).alias("_p"), F.count("*").alias("_n"))
    x = running(by, [F.desc("threshold")], {"true_positives": ("sum", "_p"), "flagged": ("sum", "_n")})
    x = x.crossJoin(F.broadcast(by.agg(F.sum("_p").alias("_all"))))  # one row
    return x.select("threshold", "true_positives", "flagged", (F.col("true_positives") / F.col("flagged")).alias("precision"), F.when(F.col("_all") > 0, F.col("true_positives") / F.col("_all")).otherwise(0.0).alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """One row: the area under a precision-recall curve, as a sum of steps."""
    x = running(curve, [F.desc("threshold")], {"_was": ("max", "recall")}, before=True)  # recall never falls
    return x.agg(F.sum(F.col("precision") * (F.col("recall") - F.coalesce("_was", F.lit(0.0)))).alias("average_precision"))


def best_threshold(curve: DataFrame, target_recall: float | None = None, most: float = 0.5) -> DataFrame:
    """One row (threshold): where F1 is highest, or the highest cut that reaches the wanted recall; never above `most`."""
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    if target_recall is None:
        best = curve.agg(F.max(F.struct(F.round(f1, 12).alias("f"), F.col("threshold").alias("t")))["t"].alias("t"))
    else:
        best = curve.where(F.col("recall") >= target_recall).agg(F.max("threshold").alias("t"))
    return best.select(F.least(F.coalesce("t", F.lit(most)), F.lit(most)).alias("threshold"))
