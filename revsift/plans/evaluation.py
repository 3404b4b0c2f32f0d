"""Queries of features, staleness, benchmarks and descriptors over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.common import cut, load
from revsift.functions import code, text
from revsift.functions.embed import embedded
from revsift.operators import benchmark, context, features, retrieval, series, staleness
from revsift.operators import queries as asked
from revsift.operators.snapshots import neighbours
from revsift.plans import reference
from revsift.plans.model import compared, fitted_threshold, permutation_importance, scored, train
from revsift.plans.reference import _CUR, _PAIRED, _PAIRS, _RANK, METRICS, current

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COLUMNS = ["entity_type", "file_path", "name", "lineno", "end_lineno", "source_code", *METRICS]


def snapshots(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current entities, calls, pairs of neighbouring snapshots)."""
    e = cut(current(spark, d, COLUMNS), "entities")
    return e, cut(code.call_edges(e), "calls"), neighbours(load(spark, d, "commits"), e)


def ordered_pairs(spark, d, pairs: DataFrame) -> DataFrame:
    c = load(spark, d, "commits").groupBy(F.col("commit_hash").alias("commit_after")).agg(F.min("seq").alias("seq"), F.min("repo").alias("repo"))
    return pairs.join(c, "commit_after").select("repo", "commit_before", "commit_after", "seq")


def semantic_modified(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entities that are new or whose form without names and layout differs."""
    forms = cut(e.select("commit_hash", "entity_id", F.md5(code.semantic_form("source_code")).alias("form")), "forms")
    return staleness.changed_entities(forms, pairs, "form")


_CHANGED = f"""{_CUR}, {_PAIRS}, b AS (SELECT commit_before, commit_after, entity_id, md5(source_code) AS old, true AS had FROM pairs JOIN cur ON commit_hash = commit_before),
a AS (SELECT commit_before, commit_after, entity_id, md5(source_code) AS new FROM pairs JOIN cur ON commit_hash = commit_after),
ch AS (SELECT a.*, had, old FROM a LEFT JOIN b USING (commit_before, commit_after, entity_id) WHERE had IS NULL OR old IS DISTINCT FROM new)"""


@query(f"WITH {_CHANGED} SELECT commit_before, commit_after, entity_id FROM ch")
def source_changed(spark, d):
    """New entities, and those whose source differs by any character."""
    e = current(spark, d, ["source_code"])
    return staleness.changed_entities(e, neighbours(load(spark, d, "commits"), e))


@query(f"""WITH {_CHANGED}, n AS (SELECT commit_hash AS commit_after, count(*) AS total FROM cur GROUP BY 1), s AS (SELECT commit_before, commit_after, count(*) AS stale FROM ch GROUP BY 1, 2)
SELECT commit_before AS from_commit, commit_after AS to_commit, CAST(total AS BIGINT) AS total_entities, CAST(coalesce(stale, 0) AS BIGINT) AS stale_count, round(coalesce(stale, 0) / total, 9) AS reembed_ratio, 'changed_only' AS strategy, CAST(NULL AS VARCHAR) AS model_path
FROM pairs JOIN n USING (commit_after) LEFT JOIN s USING (commit_before, commit_after)""")
def stale_summary(spark, d):
    e = cut(current(spark, d, ["source_code"]), "entities")
    pairs = cut(neighbours(load(spark, d, "commits"), e), "pairs")
    stale = staleness.stale_entities(pairs, e, spark.createDataFrame([], "commit_hash string, src string, dst string"), "changed_only")
    return staleness.stale_summary(stale, pairs, e, "changed_only").withColumn("reembed_ratio", F.round("reembed_ratio", 9))


@query()
def stale_fixed_hop(spark, d):
    """What changed and its direct callers, by the calls of the later snapshot."""
    e, calls, pairs = snapshots(spark, d)
    return staleness.stale_entities(pairs, e, calls, "fixed_hop", 1)


def pair_feature_frame(spark, d) -> tuple[DataFrame, DataFrame]:
    """(the 47 features of all neighbouring pairs, embedded-text labels)."""
    e, calls, pairs = snapshots(spark, d)
    pairs = cut(pairs, "pairs")
    modified = semantic_modified(e, pairs)
    x = features.pair_features(pairs, e, calls, modified, ordered_pairs(spark, d, pairs))
    labels = context.text_labels(context.contextual_texts(e, calls), pairs)
    return x, labels


@query()
def pair_features(spark, d):
    x, _ = pair_feature_frame(spark, d)
    return x.select(*x.columns[:3], *[F.round(c, 6).alias(c) for c in x.columns[3:]])


@query()
def embedded_text_labels(spark, d):
    e, calls, pairs = snapshots(spark, d)
    return context.text_labels(context.contextual_texts(e, calls), pairs)


@query()
def contextual_texts(spark, d):
    e, calls, _ = snapshots(spark, d)
    return context.contextual_texts(e, calls).select("commit_hash", "entity_id", F.md5("embed_text").alias("digest"), F.length("embed_text").alias("characters"))


@query()
def ingestion_rows(spark, d):
    e, calls, _ = snapshots(spark, d)
    return staleness.ingestion_rows(e, calls).select("commit_hash", "id", F.col("metadata.file_path").alias("file_path"), F.size("metadata.callers").alias("callers"), F.size("metadata.callees").alias("callees"))


@query()
def drift_predictor(spark, d):
    """A model on the 47 features: trained on the earlier part of each repo, cut by its out-of-fold threshold for a recall of
    0.95 (folds by commit), and applied to the later part."""
    x, labels = pair_feature_frame(spark, d)
    parts = series.temporal_split(load(spark, d, "commits")).select(F.col("commit_hash").alias("commit_after"), "part")
    x = cut(x.join(labels, features.KEY).join(parts, "commit_after"), "rows")
    fit, held = x.where("part = 'train'"), x.where("part = 'test'")
    t = fitted_threshold(fit, features.FEATURES, "y", "commit_after", 0.95, folds=3)
    s = scored(train(fit, features.FEATURES, "y"), held, features.FEATURES)
    return s.select(*features.KEY, "y", F.round("score", 6).alias("score"), (F.col("score") >= t).alias("predicted"))


def comparison_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    parts = series.temporal_split(load(spark, d, "commits")).select("commit_hash", "part")
    x = cut(reference.feature_frame(spark, d).join(parts, "commit_hash").withColumn("y", F.col("drift") >= 0.02), "features")
    return x.where("part = 'train'"), x.where("part = 'test'")


@query()
def model_comparison(spark, d):
    """Three kinds of models, each cut by its own threshold, on the later part of each repo."""
    fit, held = comparison_rows(spark, d)
    return compared(fit, held, reference.FEATURES, "y", "commit_hash", ("logistic", "tree", "forest"))


@query()
def feature_permutation(spark, d):
    fit, held = comparison_rows(spark, d)
    names = reference.FEATURES[:3]
    return permutation_importance(train(fit, names, "y"), held, names, "y")


# ---- sequences of decisions


def fold_steps(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    e, calls, pairs = snapshots(spark, d)
    w = Window.partitionBy("repo").orderBy("seq", "commit_after")
    steps = ordered_pairs(spark, d, pairs).select("repo", "commit_before", "commit_after", (F.row_number().over(w) - 1).alias("step"))
    return steps, e.select("commit_hash", "entity_id", F.md5("source_code").alias("digest")), calls


@query(f"""WITH {_CHANGED}, o AS (SELECT p.*, repo, row_number() OVER (PARTITION BY repo ORDER BY seq, commit_after) - 1 AS step FROM pairs p JOIN (SELECT commit_hash AS commit_after, min(seq) AS seq, min(repo) AS repo FROM commits GROUP BY 1) USING (commit_after)),
v AS (SELECT repo, -1 AS step, entity_id, md5(source_code) AS h, commit_hash FROM o JOIN cur ON commit_hash = commit_before WHERE step = 0 UNION ALL SELECT repo, step, entity_id, md5(source_code), commit_hash FROM o JOIN cur ON commit_hash = commit_after),
l AS (SELECT *, lag(h) OVER w AS was, lag(true) OVER w AS had FROM v WINDOW w AS (PARTITION BY repo, entity_id ORDER BY step))
SELECT repo, entity_id, arg_max(commit_hash, step) FILTER (step = -1 OR had IS NULL OR h IS DISTINCT FROM was) AS anchor_commit, CAST(count(*) FILTER (step >= 0 AND (had IS NULL OR h IS DISTINCT FROM was)) AS BIGINT) AS update_count FROM l GROUP BY 1, 2""")
def sequence_anchors(spark, d):
    """Anchors after all snapshots of each repo, by the changed-only rule; SQL says the same as the last change of each entity."""
    return staleness.sequence_fold(*fold_steps(spark, d), "changed_only")[1]


@query()
def sequence_decisions(spark, d):
    return staleness.sequence_fold(*fold_steps(spark, d), "fixed_hop", 1)[0]


# ---- benchmark rows and summaries


def query_rows(spark, d) -> DataFrame:
    ranks = retrieval.target_ranks(load(spark, d, "retrieval_results"), load(spark, d, "query_cases"))
    none = spark.createDataFrame([], "run_id string, commit_before string, commit_after string, updated_entity_fraction double")
    return cut(benchmark.per_query_rows(ranks, load(spark, d, "query_cases"), none), "query-rows")


_ROWS = _RANK + """, qq AS (SELECT query_id, min(expected_behavior) AS expected_behavior, min(category) AS category FROM query_cases GROUP BY 1),
bb AS (SELECT query_id, (min({'r': target_rank, 's': target_score})).r AS br, (min({'r': target_rank, 's': target_score})).s AS bs FROM tr WHERE strategy_name = 'full_reindex' GROUP BY 1),
pq AS (SELECT tr.run_id, tr.query_id, tr.strategy_name, category, br, target_rank AS sr, bs, target_score AS ss, coalesce(expected_behavior = 'latest_snapshot', false) AS latest,
 CASE WHEN br <= 10 THEN 1 / log2(br + 1) ELSE 0 END AS bg, CASE WHEN target_rank <= 10 THEN 1 / log2(target_rank + 1) ELSE 0 END AS sg FROM tr JOIN bb USING (query_id) JOIN qq USING (query_id) WHERE strategy_name <> 'full_reindex')"""


@query(f"""WITH {_ROWS} SELECT run_id, query_id, strategy_name, category, CAST(br AS INTEGER) AS baseline_rank, CAST(sr AS INTEGER) AS selective_rank, CAST(sr - br AS INTEGER) AS rank_delta, round(ss - bs, 6) AS score_delta,
round(CASE WHEN bg > 0 THEN sg / bg ELSE 1 END, 6) AS ndcg_ratio, br <= 10 AS top_k_hit_baseline, sr <= 10 AS top_k_hit_selective, latest AND sr <= 10 AS freshness_pass, NOT latest AND sr <= 10 AS cache_preservation_pass, sr = br AS rank_agreement,
br > 10 OR sr <= 10 AS relative_freshness_pass, abs(ss - bs) > 1e-6 + 1e-5 * abs(bs) AS target_stale FROM pq""")
def per_query_rows(spark, d):
    x = query_rows(spark, d)
    return x.select(
        "run_id", "query_id", "strategy_name", "category", "baseline_rank", "selective_rank", "rank_delta", F.round("score_delta", 6).alias("score_delta"), F.round("ndcg_ratio", 6).alias("ndcg_ratio"), "top_k_hit_baseline",
        "top_k_hit_selective", "freshness_pass", "cache_preservation_pass", "rank_agreement", "relative_freshness_pass", "target_stale",
    )


def update_costs(spark, d) -> DataFrame:
    x = load(spark, d, "embedding_comparisons").select("comparison_id", "strategy_name", F.coalesce(F.col("status").isin("modified", "added"), F.lit(False)).alias("done")).distinct()
    return x.groupBy("strategy_name").agg(F.count_if("done").alias("updated"), F.count("*").alias("entities"))


_COSTS = "co AS (SELECT strategy_name, count(*) FILTER (done) AS u, count(*) AS e FROM (SELECT DISTINCT comparison_id, strategy_name, coalesce(status IN ('modified', 'added'), false) AS done FROM embedding_comparisons) GROUP BY 1)"
_SUMMARY = f"""{_ROWS}, {_COSTS}, sm AS (SELECT strategy_name, count(*) AS n, count(*) FILTER (latest) AS c, count(*) FILTER (latest AND sr <= 10) AS fs, count(*) FILTER (NOT latest AND sr <= 10) AS cs, count(*) FILTER (br <= 10) AS bh, count(*) FILTER (br <= 10 AND sr <= 10) AS bo,
avg((sr = br)::INT) AS ra, avg(1 / br) AS bm, avg(1 / sr) AS sm, avg(bg) AS bn, avg(sg) AS sn FROM pq GROUP BY 1),
su AS (SELECT strategy_name, n, c, n - c AS uc, fs, cs, CASE WHEN c > 0 THEN fs / c ELSE 0 END AS fr, CASE WHEN n > c THEN cs / (n - c) ELSE 0 END AS cr, CASE WHEN bh > 0 THEN bo / bh ELSE 1 END AS rf, ra, bm, sm, bn, sn, CASE WHEN bm > 0 THEN sm / bm ELSE 1 END AS mr,
CASE WHEN bn > 0 THEN sn / bn ELSE 1 END AS nr, coalesce(u / e, 0) AS uf FROM sm LEFT JOIN co USING (strategy_name))"""


@query(f"""WITH {_SUMMARY} SELECT strategy_name, CAST(n AS BIGINT) AS total_queries, CAST(c AS BIGINT) AS changed_queries, CAST(uc AS BIGINT) AS unchanged_queries, round(fr, 6) AS freshness_success_rate, round(cr, 6) AS cache_preservation_success_rate, round(rf, 6) AS relative_freshness_rate,
round(ra, 6) AS rank_agreement_rate, round(bm, 6) AS baseline_mrr, round(sm, 6) AS selective_mrr, round(bn, 6) AS baseline_ndcg, round(sn, 6) AS selective_ndcg, round(sm - bm, 6) AS mrr_delta, round(mr, 6) AS mrr_ratio, round(nr, 6) AS ndcg_ratio, round(uf, 6) AS candidate_update_fraction FROM su""")
def strategy_summary(spark, d):
    x = benchmark.strategy_summary(query_rows(spark, d), update_costs(spark, d))
    return x.select(
        "strategy_name", "total_queries", "changed_queries", "unchanged_queries",
        *[F.round(c, 6).alias(c) for c in ("freshness_success_rate", "cache_preservation_success_rate", "relative_freshness_rate", "rank_agreement_rate", "baseline_mrr", "selective_mrr", "baseline_ndcg", "selective_ndcg", "mrr_delta", "mrr_ratio", "ndcg_ratio", "candidate_update_fraction")],
    )


@query(f"""WITH {_SUMMARY}, lo AS (SELECT strategy_name, k, count(*) FILTER (br <= k) AS h, count(*) FILTER (br <= k AND sr > k) AS l FROM pq, (SELECT unnest([1, 5, 10]) AS k) GROUP BY ALL),
w AS (SELECT *, CASE WHEN h > 0 THEN l / h ELSE 0 END AS p, 1.96 AS z FROM lo), b AS (SELECT max(CASE WHEN h > 0 THEN greatest(0, (p + z * z / (2 * h)) / (1 + z * z / h) - z * sqrt(p * (1 - p) / h + z * z / (4.0 * h * h)) / (1 + z * z / h)) ELSE 0 END) AS low FROM w)
SELECT CAST(count(*) AS BIGINT) AS strategies, round(max(uf) - min(uf), 6) AS update_spread, round((SELECT low FROM b), 6) AS strongest_loss, count(*) >= 2 AND max(uf) - min(uf) > .1 AND (SELECT low FROM b) <= .001 AS saturated FROM su""")
def saturation(spark, d):
    rows = query_rows(spark, d)
    losses = retrieval.lost_at_k(rows, ["strategy_name"])
    x = benchmark.saturation(benchmark.strategy_summary(rows, update_costs(spark, d)), losses)
    return x.withColumns({"update_spread": F.round("update_spread", 6), "strongest_loss": F.round("strongest_loss", 6)})


@query(f"WITH {_SUMMARY} SELECT strategy_name, round(1 - count(*) FILTER (br <= 10 AND sr > 10) / count(*) FILTER (br <= 10), 6) AS quality, 'retention@10' AS label FROM pq GROUP BY 1")
def quality_scores(spark, d):
    rows = query_rows(spark, d)
    x = benchmark.quality_scores(benchmark.strategy_summary(rows, update_costs(spark, d)), retrieval.lost_at_k(rows, ["strategy_name"]))
    return x.withColumn("quality", F.round("quality", 6))


@query(f"""WITH {_ROWS}, r AS (SELECT run_id, strategy_name, avg(1 / sr) AS mrr, avg(sg) AS ndcg, avg((sr <= 10)::INT) AS hits FROM pq GROUP BY 1, 2)
SELECT strategy_name, CAST(count(*) AS BIGINT) AS runs, """ + ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 4) AS {c}_std" for c in ("mrr", "ndcg", "hits")) + " FROM r GROUP BY 1")
def multi_run(spark, d):
    """Mean and deviation over the runs of each strategy."""
    r = query_rows(spark, d).groupBy("run_id", "strategy_name").agg(F.avg(1 / F.col("selective_rank")).alias("mrr"), F.avg(retrieval.ndcg(F.col("selective_rank"), 10)).alias("ndcg"), F.avg(F.col("top_k_hit_selective").cast("double")).alias("hits"))
    return series.mean_and_deviation(r, ["strategy_name"], ["mrr", "ndcg", "hits"])


@query("""WITH e AS (SELECT run_id, query_id, unnest(ranked_entity_ids) AS entity_id, unnest(ranked_scores) AS score FROM retrieval_results),
m AS (SELECT run_id, query_id, entity_id, max(score) AS score FROM e WHERE entity_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
t AS (SELECT DISTINCT r.run_id, q.query_id, target_entity_id AS entity_id FROM (SELECT DISTINCT run_id, query_id FROM m) r JOIN query_cases q USING (query_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, entity_id) AS i FROM m), h AS (SELECT run_id, query_id, i FROM k JOIN t USING (run_id, query_id, entity_id)),
n AS (SELECT run_id, query_id, count(*) AS wanted FROM t GROUP BY ALL), a AS (SELECT run_id, query_id, count(*) FILTER (i <= 10) AS hit, min(i) AS f, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS dcg FROM h GROUP BY ALL)
SELECT run_id, query_id, CAST(wanted AS BIGINT) AS wanted, round(coalesce(hit / wanted, 0), 6) AS recall, round(coalesce(1 / f, 0), 6) AS mrr, round(coalesce(dcg / list_sum([1 / log2(j + 1) for j in range(1, least(wanted, 10) + 1)]), 0), 6) AS ndcg FROM n LEFT JOIN a USING (run_id, query_id)""")
def set_metrics(spark, d):
    r = retrieval.ranking(load(spark, d, "retrieval_results")).groupBy("run_id", "query_id", "entity_id").agg(F.max("score").alias("score"))
    r = cut(r, "ranking")
    truth = r.select("run_id", "query_id").distinct().join(load(spark, d, "query_cases").select("query_id", F.col("target_entity_id").alias("entity_id")).distinct(), "query_id").select("run_id", "query_id", "entity_id")
    x = benchmark.set_metrics(r, truth, ["run_id", "query_id"])
    return x.withColumns({c: F.round(c, 6) for c in ("recall", "mrr", "ndcg")})


# ---- displaced ranks


def displaced_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """(rows of leave_one_out, entities): query texts embedded by hashing against both vectors of each strategy's comparisons."""
    v = load(spark, d, "embedding_comparisons").where(retrieval.usable(F.col("baseline_raw_vector")) & retrieval.usable(F.col("candidate_raw_vector")) & (F.size("baseline_raw_vector") == 64) & (F.size("candidate_raw_vector") == 64))
    v = cut(v.groupBy(F.col("strategy_name").alias("part"), "entity_id").agg(F.max(F.struct("comparison_id", "baseline_raw_vector", "candidate_raw_vector")).alias("r")).where("part is not null"), "vectors")
    q = load(spark, d, "query_cases").select("query_id", "query_text", "target_entity_id").distinct()
    q = q.select("query_id", "target_entity_id", embedded(F.col("query_text"), 64).alias("vector")).join(v.select("part", F.col("entity_id").alias("target_entity_id")), "target_entity_id")
    side = lambda c: v.select("part", "entity_id", F.col(f"r.{c}").alias("vector"))
    return benchmark.leave_one_out(side("baseline_raw_vector"), side("candidate_raw_vector"), q, "part"), v.select("part", "entity_id")


@query()
def leave_one_out(spark, d):
    x, _ = displaced_rows(spark, d)
    return x.withColumn("delta", F.round("delta", 6))


@query()
def displacement_labels(spark, d):
    x, entities = displaced_rows(spark, d)
    return benchmark.displacement_labels(x, entities, "part", least=1)


@query()
def nearest_to_queries(spark, d):
    """The five nearest indexed vectors of each query text, by the hashing embedder."""
    v = load(spark, d, "embedding_comparisons").where(retrieval.usable(F.col("candidate_raw_vector")) & (F.size("candidate_raw_vector") == 64))
    v = v.groupBy("entity_id").agg(F.max(F.struct("comparison_id", "candidate_raw_vector"))["candidate_raw_vector"].alias("vector")).withColumn("part", F.lit(0))
    q = load(spark, d, "query_cases").select("query_id", F.lit(0).alias("part"), embedded(F.col("query_text"), 64).alias("vector"))
    return benchmark.top_k(q, v, "part", 5).select("query_id", "entity_id", F.round("score", 6).alias("score"), "position")


@query()
def evaluate_strategies(spark, d):
    """Each strategy's index of fresh and cached vectors against the fresh one, asked by the query texts."""
    c = load(spark, d, "embedding_comparisons").where(retrieval.usable(F.col("baseline_raw_vector")) & retrieval.usable(F.col("candidate_raw_vector")) & (F.size("baseline_raw_vector") == 64) & (F.size("candidate_raw_vector") == 64))
    v = cut(c.groupBy("entity_id").agg(F.max(F.struct("comparison_id", "baseline_raw_vector", "candidate_raw_vector")).alias("r")), "vectors")
    side = lambda n: v.select("entity_id", F.col(f"r.{n}").alias("vector"))
    done = load(spark, d, "embedding_comparisons").where("status in ('modified', 'added') and strategy_name is not null").select("strategy_name", "entity_id").distinct().join(v, "entity_id", "left_semi")
    q = load(spark, d, "query_cases").select("query_id", embedded(F.col("query_text"), 64).alias("vector")).dropDuplicates(["query_id"])
    x = benchmark.evaluate_strategies(side("baseline_raw_vector"), side("candidate_raw_vector"), done, q)
    return x.select("strategy_name", "entities_updated", "total_entities", *[F.round(n, 6).alias(n) for n in x.columns[3:]])


@query(f"""WITH {reference._V}, x AS (SELECT commit_before, commit_after, 1 - cosine AS v FROM dr WHERE cosine IS NOT NULL AND commit_before IS NOT NULL), a AS (SELECT commit_before, commit_after, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY ALL)
SELECT commit_before, commit_after, round(any_value(m), 6) AS mean_drift, round(any_value(s), 6) AS drift_variance, round(avg((v > 2 * m)::INT), 6) AS high_drift_ratio FROM x JOIN a USING (commit_before, commit_after) GROUP BY ALL""")
def drift_evolution(spark, d):
    x = retrieval.drifts(load(spark, d, "embedding_comparisons")).where("commit_before is not null")
    x = features.drift_evolution(x)
    return x.select("commit_before", "commit_after", F.round("sm_mean_drift", 6).alias("mean_drift"), F.round("sm_drift_variance", 6).alias("drift_variance"), F.round("sm_high_drift_ratio", 6).alias("high_drift_ratio"))


# ---- query sets


@query()
def synthetic_queries(spark, d):
    """Queries for the newest snapshot of each repo, from its docstrings and calls."""
    e, calls, pairs = snapshots(spark, d)
    last = ordered_pairs(spark, d, pairs).groupBy("repo").agg(F.max(F.struct("seq", "commit_before", "commit_after")).alias("p")).select("p.commit_before", "p.commit_after")
    changed = staleness.changed_entities(e, last)
    return asked.synthetic_queries(e.join(last.select(F.col("commit_after").alias("commit_hash")), "commit_hash"), calls, changed.select(F.col("commit_after").alias("commit_hash"), "entity_id"))


_TARGET = reference._TARGETS


@query(f"""WITH {_TARGET}, md AS (SELECT entity_id, entity_type, param_count FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ingested_at DESC, commit_hash DESC) AS rn FROM entities WHERE commit_hash IS NOT NULL) WHERE rn = 1),
kw AS (SELECT unnest({asked.DOMAINS_SQL}) AS kw),
dm AS (SELECT entity_id, 'intent:core_functionality' AS dim FROM tg UNION SELECT entity_id, 'param:signature_args' FROM md WHERE param_count > 0 UNION SELECT entity_id, 'error:exception_handling' FROM tg WHERE contains(source_code, 'raise ') OR contains(source_code, 'except ') OR contains(source_code, 'try:')
 UNION SELECT entity_id, 'domain:' || kw.kw[2] FROM tg, kw WHERE contains(lower(source_code), kw.kw[1])
 UNION SELECT entity_id, 'method:' || m FROM (SELECT entity_id, unnest(regexp_extract_all(source_code, 'def\\s+([a-zA-Z0-9_]+)\\s*\\(', 1)) AS m FROM tg JOIN md USING (entity_id) WHERE entity_type = 'class') WHERE NOT starts_with(m, '__') OR m = '__init__'),
cv AS (SELECT DISTINCT entity_id, dim FROM dm JOIN qc ON entity_id = target_entity_id, (SELECT 1), LATERAL (SELECT lower(query_text) AS q) WHERE dim = 'intent:core_functionality' OR dim = 'param:signature_args' AND regexp_matches(q, 'parameter|argument|initialize|accept|mode|option')
 OR dim = 'error:exception_handling' AND regexp_matches(q, 'error|exception|raise|catch|invalid|fail') OR starts_with(dim, 'domain:') AND contains(q, split_part(dim[8:], '_', 1)) OR starts_with(dim, 'method:') AND (contains(q, dim[8:]) OR contains(q, replace(dim[8:], '_', ' ')))),
n AS (SELECT target_entity_id AS entity_id, count(*) AS q FROM (SELECT DISTINCT query_id, target_entity_id FROM query_cases) GROUP BY 1)
SELECT dm.entity_id, CAST(count(*) AS BIGINT) AS total_dimensions, CAST(count(cv.dim) AS BIGINT) AS covered_dimensions, round(count(cv.dim) / count(*), 6) AS coverage_ratio, CAST(coalesce(any_value(n.q), 0) AS BIGINT) AS query_count
FROM dm LEFT JOIN cv ON cv.entity_id = dm.entity_id AND cv.dim = dm.dim LEFT JOIN n ON n.entity_id = dm.entity_id GROUP BY 1""")
def semantic_coverage(spark, d):
    """Of the newest version of each entity."""
    e = load(spark, d, "entities").where("commit_hash is not null and entity_id is not null").groupBy("entity_id").agg(F.max(F.struct("ingested_at", "commit_hash", "entity_type", "param_count", "source_code")).alias("r"))
    e = e.select("entity_id", "r.entity_type", "r.param_count", F.coalesce("r.source_code", F.lit("")).alias("source_code"))
    q = load(spark, d, "query_cases").select("query_id", "target_entity_id", "query_text").distinct()
    x = asked.semantic_coverage(e, q)
    return x.select("entity_id", "total_dimensions", "covered_dimensions", F.round("coverage_ratio", 6).alias("coverage_ratio"), "query_count")


# ---- descriptors


def state_metrics(spark, d) -> DataFrame:
    e, calls, pairs = snapshots(spark, d)
    pairs = cut(pairs, "pairs")
    order = load(spark, d, "commits").where("repo is not null and seq is not null").select("repo", "commit_hash", "seq").distinct().join(e.select("commit_hash").distinct(), "commit_hash", "left_semi")
    modified = staleness.changed_entities(e, pairs).select(F.col("commit_after").alias("commit_hash"), "entity_id")
    x = load(spark, d, "embedding_comparisons")
    vectors = x.where(retrieval.usable(F.col("candidate_raw_vector"))).select(F.col("commit_after").alias("commit_hash"), "entity_id", F.col("candidate_raw_vector").alias("vector")).dropDuplicates(["commit_hash", "entity_id"])
    return series.state_metrics(e, features.snapshot_graphs(e, calls), order, modified, vectors.select("commit_hash", "vector"), x.select(F.col("commit_after").alias("commit_hash"), F.col("semantic_drift").alias("drift")))


@query()
def state_descriptors(spark, d):
    x = series.state_descriptors(state_metrics(spark, d))
    return x.select("repo", "commit_hash", "seq", *[F.round(c, 6).alias(c) for c in series.CATEGORIES])


@query()
def stratified_split(spark, d):
    return series.stratified_split(series.state_descriptors(state_metrics(spark, d)), list(series.CATEGORIES))
