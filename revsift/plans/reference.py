"""Queries of the engine's own operators over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsift.common import cut, load
from revsift.functions import code, text
from revsift.operators import graph, retrieval, series, strategies
from revsift.operators.snapshots import current_rows, neighbours, snapshot_changes
from revsift.plans.model import scored, train
from revsift.streaming.anchors import anchors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- tables that several queries start from

METRICS = ["cyclomatic_complexity", "ast_node_count", "max_nesting_depth", "param_count", "return_count"]


def current(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return current_rows(load(spark, d, "entities").where("commit_hash is not null and entity_id is not null"), ["commit_hash", "entity_id"], "ingested_at", columns)


_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash, entity_id ORDER BY ingested_at DESC) AS rn FROM entities) WHERE rn = 1)"
_PAIRS = """pairs AS (SELECT * FROM (SELECT lag(commit_hash) OVER (PARTITION BY repo ORDER BY seq, commit_hash) AS commit_before, commit_hash AS commit_after
  FROM (SELECT repo, commit_hash, min(seq) AS seq FROM commits WHERE commit_hash IN (SELECT commit_hash FROM entities) GROUP BY ALL)) WHERE commit_before IS NOT NULL)"""


def commit_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, changed): commits that dataset rows lead from and to, and those that comparisons found entities modified at."""
    e = cut(graph.clean_edges(load(spark, d, "dataset_rows").select(text.commit_key(F.col("commit_before")).alias("src"), text.commit_key(F.col("commit_after")).alias("dst"))), "commit-edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    changed = load(spark, d, "embedding_comparisons").where("status = 'modified' and semantic_drift >= 0.1").select(F.substring("commit_after", 1, 8).alias("node")).distinct().join(nodes, "node", "left_semi")
    return nodes, e, changed


_G = r"""k AS (SELECT lower(regexp_replace(commit_before, '^\s+|\s+$', '', 'g')) AS a, lower(regexp_replace(commit_after, '^\s+|\s+$', '', 'g')) AS b FROM dataset_rows),
e AS (SELECT DISTINCT left(a, 8) AS src, left(b, 8) AS dst FROM k WHERE regexp_full_match(a, '[0-9a-f]{8,40}') AND regexp_full_match(b, '[0-9a-f]{8,40}') AND NOT regexp_full_match(a, '0+') AND NOT regexp_full_match(b, '0+') AND left(a, 8) <> left(b, 8)),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
ch AS (SELECT DISTINCT left(commit_after, 8) AS node FROM embedding_comparisons WHERE status = 'modified' AND semantic_drift >= 0.1 AND left(commit_after, 8) IN (SELECT node FROM n))"""

# ---- snapshots, diffs, commits


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def commit_pairs(spark, d):
    return neighbours(load(spark, d, "commits"), load(spark, d, "entities"))


@query("""WITH c AS (SELECT repo, commit_hash, min(seq) AS seq FROM commits GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq DESC, commit_hash DESC) - 1 AS b FROM c),
s AS (SELECT repo, lag(commit_hash) OVER (PARTITION BY repo ORDER BY seq, commit_hash) AS commit_before, commit_hash AS commit_after FROM b WHERE b % 3 = 0) SELECT * FROM s WHERE commit_before IS NOT NULL""")
def sampled_pairs(spark, d):
    return series.stride_sample(load(spark, d, "commits"), 3)


@query("""WITH c AS (SELECT repo, commit_hash, min(seq) AS seq FROM commits GROUP BY ALL)
SELECT repo, commit_hash, CASE WHEN row_number() OVER (PARTITION BY repo ORDER BY seq, commit_hash) <= greatest(1, floor(count(*) OVER (PARTITION BY repo) * 0.7::DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM c""")
def temporal_split(spark, d):
    return series.temporal_split(load(spark, d, "commits"))


def _changes_sql() -> str:
    from revsift.plans.data_pipeline import SQL as other

    return other["p6_found"]


@query(f"SELECT entity_id, CAST(count(*) AS BIGINT) AS modification_frequency FROM ({_changes_sql()}) WHERE change_kind = 'changed' GROUP BY entity_id")
def modification_frequency(spark, d):
    x = snapshot_changes(load(spark, d, "entities"), load(spark, d, "commits"))
    return x.where("change_kind = 'changed'").groupBy("entity_id").agg(F.count("*").alias("modification_frequency"))


@query(f"""WITH ch AS ({_changes_sql()}), k AS (SELECT commit_before, commit_after, count(*) FILTER (change_kind = 'added') AS a, count(*) FILTER (change_kind = 'removed') AS r, count(*) FILTER (change_kind = 'changed') AS m FROM ch GROUP BY ALL),
z AS (SELECT commit_hash AS commit_before, count(DISTINCT entity_id) AS n FROM entities GROUP BY ALL)
SELECT commit_before, commit_after, round(a / (n + a), 6) AS node_added_ratio, round(r / (n + a), 6) AS node_deleted_ratio, round(m / greatest(n - r, 1), 6) AS node_modified_ratio,
round((n - r - m) / greatest(n - r, 1), 6) AS node_unchanged_ratio, round((n - r) / (n + a), 6) AS node_survival_ratio FROM k JOIN z USING (commit_before)""")
def node_diff(spark, d):
    e = load(spark, d, "entities")
    sizes = e.groupBy("commit_hash").agg(F.countDistinct("entity_id").alias("n"))
    x = series.diff_ratios(snapshot_changes(e, load(spark, d, "commits")), sizes)
    return x.select("commit_before", "commit_after", *[F.round(c, 6).alias(c) for c in x.columns[2:]])


@query(f"""WITH {_PAIRS}, e AS (SELECT DISTINCT commit_hash, regexp_extract(entity_id, '^(.*)::[^:]*$', 1) AS src, entity_id AS dst FROM entities WHERE regexp_matches(entity_id, '::.*::')),
s AS (SELECT commit_before, commit_after, src, dst, 1 AS side FROM e JOIN pairs ON commit_hash = commit_before UNION ALL SELECT commit_before, commit_after, src, dst, 2 FROM e JOIN pairs ON commit_hash = commit_after),
u AS (SELECT commit_before, commit_after, src, dst, bit_or(side) AS side FROM s GROUP BY ALL), k AS (SELECT commit_before, commit_after, count(*) AS u, count(*) FILTER (side = 2) AS a, count(*) FILTER (side = 1) AS r FROM u GROUP BY ALL)
SELECT commit_before, commit_after, round(a / u, 6) AS edge_added_ratio, round(r / u, 6) AS edge_removed_ratio, round((a + r) / u, 6) AS edge_churn FROM k""")
def edge_diff(spark, d):
    """Of the tree of classes and methods."""
    e = load(spark, d, "entities").where(F.col("entity_id").rlike("::.*::")).select("commit_hash", F.regexp_extract("entity_id", "^(.*)::[^:]*$", 1).alias("src"), F.col("entity_id").alias("dst"))
    x = series.edge_ratios(e, neighbours(load(spark, d, "commits"), load(spark, d, "entities")))
    return x.select("commit_before", "commit_after", *[F.round(c, 6).alias(c) for c in x.columns[2:]])


@query(f"WITH {_CUR} SELECT commit_hash, CAST(count(*) AS BIGINT) AS entities, CAST(count(*) FILTER (entity_type = 'class') AS BIGINT) AS classes, CAST(count(*) FILTER (entity_type IN ('function', 'method')) AS BIGINT) AS functions, CAST(sum(end_lineno - lineno + 1) AS BIGINT) AS lines FROM cur GROUP BY commit_hash")
def scale_metrics(spark, d):
    size = F.col("end_lineno") - F.col("lineno") + 1
    return current(spark, d, ["entity_type", "lineno", "end_lineno"]).groupBy("commit_hash").agg(
        F.count("*").alias("entities"), F.count_if(F.col("entity_type") == "class").alias("classes"), F.count_if(F.col("entity_type").isin("function", "method")).alias("functions"), F.sum(size.cast("long")).alias("lines")
    )


_SCALE = f"{_CUR}, m AS (SELECT commit_hash, avg(cyclomatic_complexity) AS complexity, avg(max_nesting_depth) AS nesting, avg(end_lineno - lineno + 1) AS lines FROM cur GROUP BY 1)"


def _per_commit(spark, d):
    x = current(spark, d, [*METRICS, "lineno", "end_lineno"]).groupBy("commit_hash").agg(
        F.avg("cyclomatic_complexity").alias("complexity"), F.avg("max_nesting_depth").alias("nesting"), F.avg(F.col("end_lineno") - F.col("lineno") + 1).alias("lines")
    )
    return cut(x, "per-commit")


_Q = "CASE WHEN quantile_cont({c}, .75) OVER () - quantile_cont({c}, .25) OVER () < 1e-9 THEN 0 ELSE (greatest(-3, least(3, ({c} - quantile_cont({c}, .5) OVER ()) / (quantile_cont({c}, .75) OVER () - quantile_cont({c}, .25) OVER ()))) + 3) / 6 END"


@query(f"WITH {_SCALE} SELECT commit_hash, " + ", ".join(f"round({_Q.format(c=c)}, 6) AS {c}" for c in ("complexity", "nesting", "lines")) + " FROM m")
def robust_scale(spark, d):
    x = series.robust_scale(_per_commit(spark, d), ["complexity", "nesting", "lines"])
    return x.select("commit_hash", *[F.round(c, 6).alias(c) for c in ("complexity", "nesting", "lines")])


@query(f"""WITH {_SCALE}, l AS (SELECT 'complexity' AS metric, complexity AS x FROM m UNION ALL SELECT 'nesting', nesting FROM m UNION ALL SELECT 'lines', lines FROM m), p AS (SELECT metric, x / (sum(x) OVER (PARTITION BY metric) + 1e-9) AS p, count(*) OVER (PARTITION BY metric) AS n FROM l),
h AS (SELECT metric, 1 - greatest(0, least(1, -sum(p * ln(p + 1e-9)) / ln(any_value(n) + 1e-9))) AS d FROM p GROUP BY metric) SELECT metric, round(d / sum(d) OVER (), 4) AS weight FROM h""")
def entropy_weights(spark, d):
    return series.entropy_weights(_per_commit(spark, d), ["complexity", "nesting", "lines"]).select("metric", F.round("weight", 4).alias("weight"))


@query(f"WITH {_CUR} SELECT entity_type, CAST(count(*) AS BIGINT) AS runs, " + ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 4) AS {c}_std" for c in METRICS) + " FROM cur GROUP BY entity_type")
def metric_spread(spark, d):
    return series.mean_and_deviation(current(spark, d, ["entity_type", *METRICS]), ["entity_type"], METRICS)


@query("""WITH x AS (SELECT strategy_name, semantic_drift AS v FROM (SELECT DISTINCT comparison_id, strategy_name, semantic_drift FROM embedding_comparisons) WHERE v IS NOT NULL), g AS (SELECT strategy_name, min(v) AS lo, max(v) AS hi, count(*) AS n FROM x GROUP BY 1),
c AS (SELECT strategy_name, n, lo, hi, CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / 20)), 19) ELSE 0 END AS cell, count(*) AS c FROM x JOIN g USING (strategy_name) GROUP BY ALL),
b AS (SELECT g.*, unnest(range(20)) AS cell FROM g), f AS (SELECT b.strategy_name, b.n, coalesce(c.c, 0) / (b.n * (b.hi - b.lo) / 20) + 1e-9 AS d FROM b LEFT JOIN c ON b.strategy_name = c.strategy_name AND b.cell = c.cell),
p AS (SELECT strategy_name, n, d / sum(d) OVER (PARTITION BY strategy_name) AS p FROM f) SELECT strategy_name, CAST(n AS BIGINT) AS n, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY ALL""")
def drift_entropy(spark, d):
    x = load(spark, d, "embedding_comparisons").select("comparison_id", "strategy_name", "semantic_drift").distinct()
    return series.histogram_entropy(x, ["strategy_name"], "semantic_drift").select("strategy_name", "n", F.round("entropy", 6).alias("entropy"))


# ---- the commit graph


@query(f"WITH {_G} SELECT n.node, CAST((SELECT count(*) FROM e WHERE src = n.node) AS BIGINT) AS out_degree, CAST((SELECT count(*) FROM e WHERE dst = n.node) AS BIGINT) AS in_degree FROM n")
def degree_features(spark, d):
    nodes, e, _ = commit_graph(spark, d)
    return graph.degrees(nodes, e)


def _hops(start: str, a: str, b: str, most: int) -> str:
    return f"WITH RECURSIVE {_G}, r AS (SELECT node, 0 AS distance FROM {start} UNION SELECT e.{b}, distance + 1 FROM r JOIN e ON r.node = e.{a} WHERE distance < {most}) SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY node"


@query(_hops("ch", "dst", "src", 2))
def dependents_within_2(spark, d):
    _, e, changed = commit_graph(spark, d)
    return graph.dependents(e, changed, 2)


@query(_hops("ch", "src", "dst", 2))
def dependencies_within_2(spark, d):
    _, e, changed = commit_graph(spark, d)
    return graph.dependencies(e, changed, 2)


@query(f"WITH RECURSIVE {_G}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT node, 0 AS distance FROM ch UNION SELECT b.dst, distance + 1 FROM r JOIN b ON r.node = b.src WHERE distance < 5) SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY node")
def nearest_changed_undirected(spark, d):
    """Without a bound on the distance; the SQL, which enumerates paths, ends at 5 hops, beyond which it has no rows."""
    _, e, changed = commit_graph(spark, d)
    return graph.distances(graph.undirected(e), changed)


def _rank_sql(p: str, rounds: int) -> str:
    steps = [f"r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank, p FROM (SELECT node, {p} AS p FROM n))"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT r.node, .85 * coalesce(g.got, 0) + .85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM e)) * r.p + .15 * r.p AS rank, r.p FROM r{i} r LEFT JOIN "
            f"(SELECT e.dst, sum(x.rank / o.deg) AS got FROM e JOIN r{i} x ON x.node = e.src JOIN o ON o.src = e.src GROUP BY e.dst) g ON g.dst = r.node)"
        )
    return f"WITH {_G}, o AS (SELECT src, count(*) AS deg FROM e GROUP BY src), " + ", ".join(steps)


@query(_rank_sql("1.0::DOUBLE / (SELECT count(*) FROM n)", 6) + " SELECT node, round(rank, 9) AS rank FROM r6")
def pagerank_6(spark, d):
    nodes, e, _ = commit_graph(spark, d)
    return graph.pagerank(nodes, e, rounds=6).select("node", F.round("rank", 9).alias("rank"))


_SEEDED = _rank_sql("CASE WHEN node IN (SELECT node FROM ch) THEN 1.0::DOUBLE / (SELECT count(*) FROM ch) ELSE 0 END", 6)


@query(_SEEDED + " SELECT node, round(rank, 9) AS rank FROM r6")
def personalised_rank_6(spark, d):
    nodes, e, changed = commit_graph(spark, d)
    return graph.pagerank(nodes, e, changed, rounds=6).select("node", F.round("rank", 9).alias("rank"))


@query()
def pagerank(spark, d):
    """To the tolerance; pagerank_6 is its first six rounds, which SQL can say."""
    nodes, e, _ = commit_graph(spark, d)
    return graph.pagerank(nodes, e).select("node", F.round("rank", 9).alias("rank"))


@query()
def personalised_rank(spark, d):
    """To the tolerance; personalised_rank_6 is its first six rounds."""
    nodes, e, changed = commit_graph(spark, d)
    return graph.pagerank(nodes, e, changed).select("node", F.round("rank", 9).alias("rank"))


@query(f"""WITH RECURSIVE {_G}, d AS (SELECT dst, count(*) AS indeg FROM e GROUP BY dst), s AS (SELECT e.src, e.dst, .25 + .3 / greatest(indeg, 1) AS f FROM e JOIN d USING (dst)),
r AS (SELECT node, 1.0::DOUBLE AS strength, 0 AS h FROM ch UNION SELECT s.src, strength * f, h + 1 FROM r JOIN s ON r.node = s.dst WHERE strength * f >= .05 AND h < 6) SELECT node, round(max(strength), 9) AS strength FROM r GROUP BY node""")
def decayed_strength(spark, d):
    _, e, changed = commit_graph(spark, d)
    return graph.decayed_strength(e, changed).select("node", F.round("strength", 9).alias("strength"))


@query(f"""WITH {_G}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d AS (SELECT src AS node, count(*) AS deg FROM b GROUP BY 1), t AS (SELECT x.src AS node, count(*) AS t FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN b z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1)
SELECT node, round(CASE WHEN deg < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (deg * (deg - 1)) END, 6) AS clustering FROM d LEFT JOIN t USING (node)""")
def clustering(spark, d):
    nodes, e, _ = commit_graph(spark, d)
    return graph.clustering(nodes, e).select("node", F.round("clustering", 6).alias("clustering"))


@query(f"""WITH RECURSIVE {_G}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT node, node AS root FROM n UNION SELECT b.dst, root FROM r JOIN b ON r.node = b.src), c AS (SELECT node, min(root) AS root FROM r GROUP BY node) SELECT node, root FROM c WHERE node <> root""")
def weak_components(spark, d):
    _, e, _ = commit_graph(spark, d)
    return graph.components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))


@query()
def topology(spark, d):
    nodes, e, _ = commit_graph(spark, d)
    return graph.topology(nodes, e)


@query()
def path_centralities(spark, d):
    """Of each component of the commit graph, which are short histories."""
    _, e, _ = commit_graph(spark, d)
    root = graph.components(e.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("node", "src")
    return graph.path_centralities(e.join(root, "src", "left").select(F.coalesce("root", "src").alias("part"), "src", "dst"), "part")


# ---- strategies


@query(f"WITH {_G} SELECT node FROM ch")
def strategy_changed_only(spark, d):
    return strategies.changed_only(commit_graph(spark, d)[2])


@query(f"WITH {_G} SELECT node FROM ch UNION SELECT src FROM e WHERE dst IN (SELECT node FROM ch)")
def strategy_fixed_hop(spark, d):
    _, e, changed = commit_graph(spark, d)
    return strategies.fixed_hop(changed, e)


@query(_SEEDED + ", x AS (SELECT node, row_number() OVER (ORDER BY round(rank, 12) DESC, node) AS i FROM r6 WHERE rank > 0 AND node NOT IN (SELECT node FROM ch)) SELECT node FROM ch UNION SELECT node FROM x WHERE i <= greatest(0, floor(.3 * (SELECT count(*) FROM n)) - (SELECT count(*) FROM ch))")
def strategy_pagerank(spark, d):
    """Ranks to the tolerance; the SQL's are those of six rounds, so its choice may differ where ranks are close."""
    nodes, e, changed = commit_graph(spark, d)
    return strategies.pagerank_propagation(nodes, changed, e)


@query(SQL["decayed_strength"].replace("SELECT node, round(max(strength), 9) AS strength FROM r GROUP BY node", "SELECT DISTINCT node FROM r"))
def strategy_bfs_decay(spark, d):
    _, e, changed = commit_graph(spark, d)
    return strategies.bfs_decay(changed, e)


@query("SELECT DISTINCT entity_id AS node FROM embedding_comparisons WHERE semantic_drift >= 0.02")
def strategy_predictive(spark, d):
    return strategies.predictive(load(spark, d, "embedding_comparisons").select(F.col("entity_id").alias("node"), F.col("semantic_drift").alias("score")))


# ---- vectors and retrieval

_V = """v AS (SELECT DISTINCT comparison_id, strategy_name, entity_id, commit_before, commit_after, coalesce(status, CASE WHEN baseline_raw_vector IS NULL AND candidate_raw_vector IS NOT NULL THEN 'added'
  WHEN candidate_raw_vector IS NULL AND baseline_raw_vector IS NOT NULL THEN 'removed' ELSE 'unchanged' END) AS status, CAST(baseline_raw_vector AS DOUBLE[]) AS b, CAST(candidate_raw_vector AS DOUBLE[]) AS c FROM embedding_comparisons),
dr AS (SELECT comparison_id, strategy_name, entity_id, commit_before, commit_after, status, CASE WHEN len(b) = len(c) AND len(list_filter(b, lambda x: isnan(x))) = 0 AND len(list_filter(c, lambda x: isnan(x))) = 0
  AND len(list_filter(b, lambda x: x <> 0)) > 0 AND len(list_filter(c, lambda x: x <> 0)) > 0 THEN greatest(-1, least(1, list_cosine_similarity(b, c))) END AS cosine FROM v)"""


@query(f"WITH {_V} SELECT comparison_id, status, round(cosine, 6) AS cosine, round(1 - cosine, 6) AS drift FROM dr")
def vector_drift(spark, d):
    x = retrieval.drifts(load(spark, d, "embedding_comparisons"))
    return x.select("comparison_id", "status", F.round("cosine", 6).alias("cosine"), F.round("drift", 6).alias("drift"))


@query(f"WITH {_V} SELECT strategy_name, status, CAST(count(*) AS BIGINT) AS n, round(coalesce(avg(cosine), 1), 6) AS mean_cosine, round(coalesce(min(cosine), 1), 6) AS min_cosine, round(coalesce(quantile_cont(1 - cosine, .95), 0), 6) AS p95_drift FROM dr GROUP BY 1, 2")
def index_comparison(spark, d):
    x = retrieval.drifts(load(spark, d, "embedding_comparisons"))
    one = lambda c, v: F.round(F.coalesce(c, F.lit(v)), 6)
    x = cut(x.select("strategy_name", "status", "cosine", "drift"), "drifts")
    g = x.groupBy("strategy_name", "status").agg(F.count("*").alias("n"), one(F.avg("cosine"), 1.0).alias("mean_cosine"), one(F.min("cosine"), 1.0).alias("min_cosine"))
    q = series.quantiles(x, ["strategy_name", "status"], "drift", {"q": 0.95}).select(F.col("strategy_name").alias("_a"), F.col("status").alias("_b"), "q")
    return g.join(q, g["strategy_name"].eqNullSafe(q["_a"]) & g["status"].eqNullSafe(q["_b"]), "left").select(*g.columns, one(F.col("q"), 0.0).alias("p95_drift"))


@query("""SELECT DISTINCT comparison_id, fresh, len(v) AS dimensions, round(v[1], 6) AS first FROM (SELECT comparison_id, coalesce(status, 'unchanged') AS s, coalesce(status IN ('modified', 'added'), false) OR baseline_raw_vector IS NULL AS fresh,
CASE WHEN coalesce(status IN ('modified', 'added'), false) OR baseline_raw_vector IS NULL THEN candidate_raw_vector ELSE baseline_raw_vector END AS v FROM embedding_comparisons) WHERE s <> 'removed' AND v IS NOT NULL""")
def selective_index(spark, d):
    x = retrieval.selective_index(load(spark, d, "embedding_comparisons"))
    return x.select("comparison_id", "fresh", F.size("vector").cast("long").alias("dimensions"), F.round(F.col("vector")[0], 6).alias("first"))


@query(f"WITH {_V} SELECT status, CAST(count(*) AS BIGINT) AS n, round(avg(1 - cosine), 6) AS mean_drift, round(stddev_pop(1 - cosine), 6) AS deviation, CAST(count(*) FILTER (1 - cosine >= .02) AS BIGINT) AS above FROM dr WHERE cosine IS NOT NULL GROUP BY status")
def drift_by_status(spark, d):
    x = retrieval.drifts(load(spark, d, "embedding_comparisons")).where("cosine is not null")
    return x.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("drift"), 6).alias("mean_drift"), F.round(F.stddev_pop("drift"), 6).alias("deviation"), F.count_if(F.col("drift") >= 0.02).alias("above"))


_RANK = """q AS (SELECT DISTINCT query_id, target_entity_id FROM query_cases), e AS (SELECT run_id, query_id, strategy_name, unnest(ranked_entity_ids) AS entity_id, unnest(ranked_scores) AS score FROM retrieval_results),
m AS (SELECT run_id, query_id, strategy_name, entity_id, max(score) AS score FROM e WHERE entity_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
t AS (SELECT m.*, max(CASE WHEN entity_id = target_entity_id THEN score END) OVER (PARTITION BY run_id, query_id, strategy_name) AS t FROM m JOIN q USING (query_id)),
tr AS (SELECT run_id, query_id, strategy_name, CASE WHEN max(t) IS NULL THEN count(*) + 1 ELSE 1 + count(*) FILTER (score > t) END AS target_rank, coalesce(max(t), 0) AS target_score FROM t GROUP BY ALL)"""


def _ranks(spark, d):
    return retrieval.target_ranks(load(spark, d, "retrieval_results"), load(spark, d, "query_cases"))


@query(f"WITH {_RANK} SELECT run_id, query_id, strategy_name, CAST(target_rank AS BIGINT) AS target_rank, target_score FROM tr")
def target_rank(spark, d):
    return _ranks(spark, d)


@query(f"WITH {_RANK} SELECT strategy_name, CAST(count(*) AS BIGINT) AS queries, round(avg((target_rank <= 1)::INT), 6) AS recall_1, round(avg((target_rank <= 5)::INT), 6) AS recall_5, round(avg((target_rank <= 10)::INT), 6) AS recall_10, round(avg(1 / target_rank), 6) AS mrr, round(avg(CASE WHEN target_rank <= 10 THEN 1 / log2(target_rank + 1) ELSE 0 END), 6) AS ndcg_10 FROM tr GROUP BY 1")
def ir_metrics(spark, d):
    x = retrieval.ir_metrics(_ranks(spark, d), ["strategy_name"])
    return x.select("strategy_name", "queries", *[F.round(c, 6).alias(c) for c in x.columns[2:]])


_PAIRED = _RANK + """, b AS (SELECT query_id, min(target_rank) AS baseline_rank FROM tr WHERE strategy_name = 'full_reindex' GROUP BY 1), pr AS (SELECT strategy_name, query_id, baseline_rank, target_rank AS selective_rank FROM tr JOIN b USING (query_id) WHERE strategy_name <> 'full_reindex')"""


@query(f"""WITH {_PAIRED}, k AS (SELECT strategy_name, k, count(*) AS n, count(*) FILTER (baseline_rank <= k) AS h, count(*) FILTER (baseline_rank <= k AND selective_rank > k) AS l, count(*) FILTER (baseline_rank > k AND selective_rank <= k) AS g FROM pr, (SELECT unnest([1, 5, 10]) AS k) GROUP BY ALL),
w AS (SELECT *, CASE WHEN h > 0 THEN l / h ELSE 0 END AS p, 1.96 AS z FROM k)
SELECT strategy_name, CAST(k AS INTEGER) AS k, CAST(n AS BIGINT) AS n, CAST(h AS BIGINT) AS baseline_hits, CAST(l AS BIGINT) AS lost, CAST(g AS BIGINT) AS gained, round(p, 6) AS loss_rate,
round(CASE WHEN h > 0 THEN greatest(0, (p + z * z / (2 * h)) / (1 + z * z / h) - z * sqrt(p * (1 - p) / h + z * z / (4.0 * h * h)) / (1 + z * z / h)) ELSE 0 END, 6) AS loss_low,
round(CASE WHEN h > 0 THEN least(1, (p + z * z / (2 * h)) / (1 + z * z / h) + z * sqrt(p * (1 - p) / h + z * z / (4.0 * h * h)) / (1 + z * z / h)) ELSE 0 END, 6) AS loss_high,
round(CASE WHEN n > h THEN g / (n - h) ELSE 0 END, 6) AS gain_rate, round(1 - p, 6) AS retention FROM w""")
def lost_at_k(spark, d):
    x = retrieval.lost_at_k(retrieval.paired_ranks(_ranks(spark, d)), ["strategy_name"])
    return x.select(*x.columns[:6], *[F.round(c, 6).alias(c) for c in x.columns[6:]])


@query(f"WITH {_PAIRED}, s AS (SELECT strategy_name, count(*) FILTER (selective_rank > baseline_rank) AS k, count(*) FILTER (selective_rank <> baseline_rank) AS m FROM pr GROUP BY 1), i AS (SELECT strategy_name, k, m, unnest(range(k, m + 1)) AS i FROM s) SELECT strategy_name, CAST(k AS BIGINT) AS positive, CAST(m AS BIGINT) AS nonzero, round(CASE WHEN k = 0 THEN 1 ELSE least(1, sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))) END, 6) AS p FROM i GROUP BY strategy_name, k, m")
def sign_test(spark, d):
    return retrieval.sign_test(retrieval.paired_ranks(_ranks(spark, d)), ["strategy_name"]).withColumn("p", F.round("p", 6))


@query(f"WITH {_PAIRED} SELECT strategy_name, CAST(count(*) AS BIGINT) AS n, round(avg((selective_rank > baseline_rank)::INT), 6) AS degraded, round(avg((selective_rank < baseline_rank)::INT), 6) AS improved, round(avg(1 / selective_rank - 1 / baseline_rank), 6) AS mean_reciprocal_delta FROM pr GROUP BY 1")
def staleness_block(spark, d):
    b, s = F.col("baseline_rank"), F.col("selective_rank")
    x = retrieval.paired_ranks(_ranks(spark, d))
    return x.groupBy("strategy_name").agg(F.count("*").alias("n"), F.round(F.avg((s > b).cast("double")), 6).alias("degraded"), F.round(F.avg((s < b).cast("double")), 6).alias("improved"), F.round(F.avg(1 / s - 1 / b), 6).alias("mean_reciprocal_delta"))


_COST = _RANK + """, cost AS (SELECT strategy_name, round(avg((status IN ('modified', 'added'))::INT), 6) AS cost FROM (SELECT DISTINCT comparison_id, strategy_name, coalesce(status, 'unchanged') AS status FROM embedding_comparisons) GROUP BY 1),
qu AS (SELECT strategy_name, round(avg((target_rank <= 10)::INT), 6) AS quality FROM tr GROUP BY 1), pt AS (SELECT * FROM cost JOIN qu USING (strategy_name))"""


@query(f"WITH {_COST} SELECT a.*, NOT EXISTS (SELECT 1 FROM pt b WHERE b.cost <= a.cost AND b.quality >= a.quality AND (b.cost < a.cost OR b.quality > a.quality)) AS on_frontier FROM pt a")
def pareto_frontier(spark, d):
    c = load(spark, d, "embedding_comparisons").select("comparison_id", "strategy_name", F.coalesce("status", F.lit("unchanged")).alias("status")).distinct()
    c = c.groupBy("strategy_name").agg(F.round(F.avg(F.col("status").isin("modified", "added").cast("double")), 6).alias("cost"))
    q = _ranks(spark, d).groupBy("strategy_name").agg(F.round(F.avg((F.col("target_rank") <= 10).cast("double")), 6).alias("quality"))
    return retrieval.pareto(c.join(q, "strategy_name"), "cost", "quality")


_NEED = f"{_V}, y AS (SELECT *, coalesce(1 - cosine >= .02, true) AS needs, status IN ('modified', 'added') AS done FROM dr WHERE status <> 'removed')"


def _needs(spark, d):
    x = retrieval.drifts(load(spark, d, "embedding_comparisons")).where("status <> 'removed'")
    return x.withColumn("needs", F.coalesce(F.col("drift") >= 0.02, F.lit(True))).withColumn("done", F.col("status").isin("modified", "added"))


@query(f"WITH {_NEED} SELECT strategy_name, CAST(count(*) FILTER (needs) AS BIGINT) AS needed, CAST(count(*) FILTER (done) AS BIGINT) AS reembedded, CAST(count(*) FILTER (needs AND done) AS BIGINT) AS hit, CAST(count(*) FILTER (needs AND NOT done) AS BIGINT) AS missed, CAST(count(*) FILTER (done AND NOT needs) AS BIGINT) AS extra, round(count(*) FILTER (needs AND done) / count(*) FILTER (needs), 6) AS coverage FROM y GROUP BY 1")
def coverage_summary(spark, d):
    return retrieval.coverage(_needs(spark, d), ["strategy_name"]).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {_NEED} SELECT needs, done, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY ALL")
def confusion_matrix(spark, d):
    return _needs(spark, d).groupBy("needs", "done").agg(F.count("*").alias("n"))


_PR = f"{_V}, sc AS (SELECT round(1 - cosine, 9) AS threshold, status = 'modified' AS y FROM dr WHERE cosine IS NOT NULL), bt AS (SELECT threshold, count(*) FILTER (y) AS p, count(*) AS n FROM sc GROUP BY 1), cu AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS f, sum(p) OVER () AS a FROM bt)"


def _curve(spark, d):
    x = retrieval.drifts(load(spark, d, "embedding_comparisons")).where("cosine is not null").withColumn("y", F.col("status") == "modified")
    # the last bits of a drift depend on the order of its sum, in SQL too
    return retrieval.pr_curve(x.withColumn("score", F.round("drift", 9)), "score", "y")


@query(f"WITH {_PR} SELECT threshold, CAST(tp AS BIGINT) AS true_positives, CAST(f AS BIGINT) AS flagged, round(tp / f, 6) AS precision, round(tp / a, 6) AS recall FROM cu")
def pr_curve(spark, d):
    return _curve(spark, d).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(f"WITH {_PR}, st AS (SELECT tp / f AS p, tp / a - coalesce(lag(tp / a) OVER (ORDER BY threshold DESC), 0) AS s FROM cu) SELECT round(sum(p * s), 6) AS average_precision FROM st")
def average_precision(spark, d):
    return retrieval.average_precision(_curve(spark, d)).select(F.round("average_precision", 6).alias("average_precision"))


@query(f"WITH {_PR}, c AS (SELECT threshold, tp / a AS r FROM cu) SELECT least(coalesce(max(threshold), .5), .5) AS threshold FROM c WHERE r >= .95")
def recall_threshold(spark, d):
    return retrieval.best_threshold(_curve(spark, d), target_recall=0.95)


@query("""WITH x AS (SELECT lang, n_chars AS x, length(text) AS y FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL), r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS a, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2 AS b FROM x WHERE lang IS NOT NULL)
SELECT lang, CAST(count(*) AS BIGINT) AS n, round(coalesce(corr(a, b), 0), 6) AS spearman FROM r GROUP BY lang""")
def spearman(spark, d):
    x = load(spark, d, "documents").where("lang is not null").select("lang", "n_chars", F.length("text").alias("length"))
    return retrieval.spearman(x, ["lang"], "n_chars", "length").withColumn("spearman", F.round("spearman", 6))


_EV = "ev AS (SELECT DISTINCT strategy_name, entity_id, commit_after, coalesce(status IN ('modified', 'added'), false) AS done, seq FROM embedding_comparisons JOIN (SELECT commit_hash, min(seq) AS seq FROM commits GROUP BY 1) ON commit_hash = commit_after)"


def anchor_events(spark, d):
    seq = load(spark, d, "commits").groupBy("commit_hash").agg(F.min("seq").alias("at"))
    x = load(spark, d, "embedding_comparisons").select(F.col("strategy_name").alias("strategy"), "entity_id", F.col("commit_after").alias("commit_hash"), F.coalesce(F.col("status").isin("modified", "added"), F.lit(False)).alias("done")).distinct()
    return x.join(seq, "commit_hash").withColumnRenamed("commit_hash", "commit")


@query(f"WITH {_EV} SELECT strategy_name AS strategy, entity_id, coalesce(max({{'a': seq, 'c': commit_after}}) FILTER (done), min({{'a': seq, 'c': commit_after}})).c AS anchor_commit, CAST(count(*) FILTER (done) AS BIGINT) AS update_count FROM ev GROUP BY 1, 2")
def cache_anchors(spark, d):
    return anchors(anchor_events(spark, d), ["strategy", "entity_id"], "at", "commit", "done")


# ---- texts


@query(r"SELECT DISTINCT query_id, trim(regexp_replace(query_text, '\s+', ' ', 'g')) AS collapsed, lower(trim(regexp_replace(query_text, '\s+', ' ', 'g'))) AS key FROM query_cases")
def normalize_query(spark, d):
    return load(spark, d, "query_cases").select("query_id", text.collapse(F.col("query_text")).alias("collapsed"), text.lower_collapse(F.col("query_text")).alias("key")).distinct()


_WORDS = r"list_filter(string_split_regex(replace(lower(regexp_replace(regexp_replace({x}, '(.)([A-Z][a-z]+)', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '_', ' '), '\s+'), lambda w: w <> '')"


@query(f"SELECT DISTINCT entity_id, {_WORDS.format(x='entity_id')} AS words FROM entities")
def split_identifier(spark, d):
    return load(spark, d, "entities").select("entity_id").distinct().select("entity_id", text.split_identifier(F.col("entity_id")).alias("words"))


_GRAM = "list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_GRAMS = "SELECT DISTINCT {i}, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT {i}, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT {i}, " + _GRAM + " AS w FROM {f}) WHERE len(w) >= 4)"
# a case is judged against the newest source of its target in the whole table
_TARGETS = """tg AS (SELECT entity_id, source_code FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ingested_at DESC, commit_hash DESC) AS rn FROM entities WHERE commit_hash IS NOT NULL) WHERE rn = 1),
qc AS (SELECT DISTINCT query_id, query_text, target_entity_id, file_path FROM query_cases), qs AS (SELECT qc.*, source_code, concat(query_id, '|', target_entity_id) AS k FROM qc JOIN tg ON entity_id = target_entity_id)"""
_SHARED = _TARGETS + ", qa AS (" + _GRAMS.format(i="k", t="query_text", f="qs") + "), sa AS (" + _GRAMS.format(i="k", t="source_code", f="qs") + "), sh AS (SELECT k, list_sort(list(g)) AS shared FROM qa JOIN sa USING (k, g) GROUP BY k)"
_LEAKS = rf"""fp AS (SELECT *, string_split(target_entity_id, '::') AS p, regexp_extract(coalesce(file_path, ''), '([^/]*)/*$', 1) AS f FROM (SELECT DISTINCT query_id, query_text, target_entity_id, file_path FROM query_cases)),
ft AS (SELECT query_id, query_text, target_entity_id, file_path, unnest(CASE WHEN len(p) > 1 THEN p[2:] ELSE p END) AS t FROM fp UNION SELECT query_id, query_text, target_entity_id, file_path, w FROM
  (SELECT *, unnest({_WORDS.format(x='p[-1]')}) AS w FROM fp) WHERE length(w) >= 4
  UNION SELECT query_id, query_text, target_entity_id, file_path, f FROM fp WHERE f <> '' UNION SELECT query_id, query_text, target_entity_id, file_path, s FROM
  (SELECT *, CASE WHEN regexp_matches(f, '^.+\.[^.]*$') THEN regexp_replace(f, '\.[^.]*$', '') ELSE f END AS s FROM fp) WHERE length(s) >= 4 AND s <> '__init__'),
lt AS (SELECT DISTINCT query_id, target_entity_id, lower(t) AS t FROM ft WHERE replace(t, '_', '') <> '' AND regexp_matches(lower(query_text), '(^|[^a-z0-9_])' || regexp_escape(lower(t)) || '($|[^a-z0-9_])')
  UNION SELECT query_id, target_entity_id, lower(file_path) FROM fp WHERE file_path <> '' AND contains(lower(query_text), lower(file_path))),
lk AS (SELECT query_id, target_entity_id, list_sort(list(DISTINCT t)) AS leaks FROM lt GROUP BY ALL)"""


def cases_with_source(spark, d) -> DataFrame:
    """Query cases with source_code, the newest source of their target in the whole table; null where there is none."""
    newest = load(spark, d, "entities").where("commit_hash is not null and entity_id is not null").groupBy(F.col("entity_id").alias("target_entity_id"))
    newest = newest.agg(F.max(F.struct("ingested_at", "commit_hash", "source_code")).alias("r")).select("target_entity_id", F.col("r.source_code").alias("source_code"), F.lit(True).alias("known"))
    return load(spark, d, "query_cases").select("query_id", "query_text", "target_entity_id", "file_path").distinct().join(newest, "target_entity_id", "left")


@query("WITH " + _SHARED + " SELECT qs.query_id, qs.target_entity_id, CAST(len(shared) AS BIGINT) AS shared, shared[1] AS first FROM sh JOIN qs USING (k)")
def shared_ngrams(spark, d):
    """Runs of four words that a query copies from its own target's source."""
    x = cases_with_source(spark, d).where("known").select("query_id", "target_entity_id", text.shared_ngrams(F.col("query_text"), F.col("source_code")).alias("g"))
    return x.where("size(g) > 0").select("query_id", "target_entity_id", F.size("g").cast("long").alias("shared"), F.col("g")[0].alias("first"))


@query("WITH " + _LEAKS + " SELECT * FROM lk")
def identifier_leaks(spark, d):
    x = load(spark, d, "query_cases").select("query_id", "target_entity_id", text.leaked_terms(F.col("query_text"), F.col("target_entity_id"), F.col("file_path")).alias("leaks"))
    return x.where("size(leaks) > 0").distinct()


_PROBLEMS = "WITH " + _SHARED + ", " + _LEAKS + """, pb AS (SELECT qs.query_id, qs.target_entity_id, list_filter([CASE WHEN len(leaks) > 0 THEN 'identifier:' || array_to_string(leaks, ',') END, CASE WHEN len(shared) > 0 THEN 'verbatim:' || shared[1] END], lambda x: x IS NOT NULL) AS problems
FROM qs LEFT JOIN sh USING (k) LEFT JOIN lk ON lk.query_id = qs.query_id AND lk.target_entity_id = qs.target_entity_id)"""


@query(_PROBLEMS + " SELECT * FROM pb WHERE len(problems) > 0")
def query_violations(spark, d):
    x = cases_with_source(spark, d).where("known")
    x = x.select("query_id", "target_entity_id", text.violations(F.col("query_text"), F.col("target_entity_id"), F.col("file_path"), F.col("source_code")).alias("problems"))
    return x.where("size(problems) > 0")


@query(_PROBLEMS + r""", q AS (SELECT DISTINCT query_id, target_entity_id, lower(trim(regexp_replace(query_text, '\s+', ' ', 'g'))) AS k FROM query_cases), a AS (SELECT k FROM q GROUP BY k HAVING count(DISTINCT target_entity_id) > 1), c AS (SELECT target_entity_id, count(*) AS n FROM q GROUP BY 1),
r AS (SELECT CAST((SELECT count(*) FROM q) AS BIGINT) AS queries, CAST((SELECT count(*) FROM c) AS BIGINT) AS targets, CAST((SELECT count(*) FROM a) AS BIGINT) AS ambiguous, CAST((SELECT count(*) FROM c WHERE n < 5) AS BIGINT) AS under_covered,
CAST((SELECT count(*) FROM c WHERE target_entity_id NOT IN (SELECT entity_id FROM entities WHERE commit_hash IS NOT NULL AND entity_id IS NOT NULL)) AS BIGINT) AS missing, CAST((SELECT count(*) FROM pb WHERE len(problems) > 0) AS BIGINT) AS leaking)
SELECT *, ambiguous + under_covered + missing + leaking = 0 AS ok FROM r""")
def query_audit(spark, d):
    q = load(spark, d, "query_cases").select("query_id", "target_entity_id", text.lower_collapse(F.col("query_text")).alias("k")).distinct()
    c = q.groupBy("target_entity_id").agg(F.count("*").alias("n"))
    known = load(spark, d, "entities").where("commit_hash is not null").select(F.col("entity_id").alias("target_entity_id")).distinct().withColumn("known", F.lit(True))
    c = c.join(known, "target_entity_id", "left").agg(F.count("*").alias("targets"), F.count_if(F.col("n") < 5).alias("under_covered"), F.count_if(F.col("known").isNull()).alias("missing"))
    a = q.groupBy("k").agg(F.countDistinct("target_entity_id").alias("t")).agg(F.count_if(F.col("t") > 1).alias("ambiguous"))
    leaking = query_violations(spark, d).agg(F.count("*").alias("leaking"))
    x = q.agg(F.count("*").alias("queries")).crossJoin(c).crossJoin(a).crossJoin(leaking)  # one row each
    return x.select("queries", "targets", "ambiguous", "under_covered", "missing", "leaking", (F.col("ambiguous") + F.col("under_covered") + F.col("missing") + F.col("leaking") == 0).alias("ok"))


@query("SELECT DISTINCT query_id FROM query_cases WHERE target_entity_id NOT IN (SELECT entity_id FROM entities)")
def missing_targets(spark, d):
    return load(spark, d, "query_cases").join(load(spark, d, "entities").select(F.col("entity_id").alias("target_entity_id")), "target_entity_id", "left_anti").select("query_id").distinct()


# ---- code, features, a model


@query()
def code_metrics(spark, d):
    """Metrics computed from the sources of current rows."""
    x = current(spark, d, ["entity_type", "source_code"]).where("source_code is not null")
    return x.select("commit_hash", "entity_id", code.code_metrics("source_code").alias("m")).select("commit_hash", "entity_id", "m.*")


@query()
def call_graph(spark, d):
    return code.call_edges(current(spark, d, ["entity_type", "file_path", "source_code"]))


@query()
def semantic_changes(spark, d):
    """Changed entities whose form without names and layout changed too."""
    rows = current(spark, d, ["source_code"])
    rows = cut(rows.select("commit_hash", "entity_id", F.md5(code.semantic_form("source_code")).alias("form")), "forms")
    ch = snapshot_changes(load(spark, d, "entities"), load(spark, d, "commits")).where("change_kind = 'changed'")
    before, after = (rows.select(F.col("commit_hash").alias(c), "entity_id", F.col("form").alias(f)) for c, f in (("commit_before", "old"), ("commit_after", "new")))
    return ch.join(before, ["commit_before", "entity_id"]).join(after, ["commit_after", "entity_id"]).where(~F.col("old").eqNullSafe(F.col("new"))).select("commit_before", "commit_after", "entity_id")


FEATURES = [*METRICS, "entity_size", "siblings", "is_modified", "name_words"]


def feature_frame(spark, d) -> DataFrame:
    """A row for each comparison with features of its entity at the later commit and its drift."""
    e = current(spark, d, [*METRICS, "file_path", "lineno", "end_lineno"])
    files = e.groupBy("commit_hash", "file_path").agg(F.count("*").alias("siblings"))
    e = e.join(files, ["commit_hash", "file_path"]).withColumn("entity_size", F.col("end_lineno") - F.col("lineno") + 1).withColumn("name_words", F.size(text.split_identifier(F.regexp_extract("entity_id", "([^:]*)$", 1))))
    x = retrieval.drifts(load(spark, d, "embedding_comparisons")).where("cosine is not null").withColumn("is_modified", (F.col("status") == "modified").cast("double"))
    return x.withColumnRenamed("commit_after", "commit_hash").join(e, ["commit_hash", "entity_id"])


@query()
def features(spark, d):
    return feature_frame(spark, d).select("comparison_id", *[F.col(c).cast("double").alias(c) for c in FEATURES], "drift")


@query()
def drift_model(spark, d):
    """Scores of a model that is trained on the earlier and applied to the later part of each repo."""
    parts = series.temporal_split(load(spark, d, "commits")).select("commit_hash", "part")
    x = cut(feature_frame(spark, d).join(parts, "commit_hash").withColumn("y", F.col("drift") >= 0.02), "features")
    model = train(x.where("part = 'train'"), FEATURES, "y")
    return scored(model, x.where("part = 'test'"), FEATURES).select("comparison_id", "y", F.round("score", 6).alias("score"))
