"""The features of every entity of a snapshot, against the snapshot before it: one row a pair and entity, 47 columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revsift.common import cut
from revsift.operators import context, graph, series

PAIR = ["commit_before", "commit_after"]
KEY = [*PAIR, "entity_id"]
METRICS = ["cyclomatic_complexity", "ast_node_count", "max_nesting_depth"]
#: Distances of what reaches nothing that changed; fixed values.
FAR, FAR_DATA = 999.0, 10.0
GLOBALS = [
    "ne_node_added_ratio", "ne_node_deleted_ratio", "ne_node_modified_ratio", "ne_node_unchanged_ratio", "ne_node_survival_ratio", "ee_edge_added_ratio", "ee_edge_removed_ratio", "ee_edge_churn", "ee_density_delta", "ee_density_a",
    "ee_density_b", "se_node_growth_ratio", "se_edge_growth_ratio", "se_clustering_delta", "se_component_delta", "ce_mean_pagerank_shift", "ce_max_pagerank_shift", "ce_mean_degree_shift",
]
FEATURES = [
    "out_degree", "in_degree", "pagerank", "closeness", "betweenness", "is_modified", "distance_to_modified_directed", "distance_to_modified_undirected", "modified_dependents_count", "modified_dependencies_count", "pagerank_impact",
    "file_lines_added", "file_lines_deleted", "entity_size", "entity_modification_size", "modification_frequency", "gtd_change_class", "gtd_local_edges_added", "gtd_local_edges_removed", "gtd_local_edge_churn", *METRICS,
    "data_flow_distance", "modified_data_deps_count", "taint_reachability_score", "context_stub_changed_count", "modified_member_count", "own_source_changed", *GLOBALS,
]


def snapshot_graphs(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(commit_hash, entity_id, out_degree, in_degree, pagerank, closeness, betweenness, clustering, joined) of every entity;
    joined: its component has a smaller node. All snapshots' graphs are followed at once, as parts that share no node."""
    nodes = entities.select(F.col("commit_hash").alias("part"), F.col("entity_id").alias("node"))
    e = cut(edges.where("src <> dst").select(F.col("commit_hash").alias("part"), "src", "dst").distinct(), "calls")
    own = lambda p, c: F.concat(F.col(p), F.lit("\x01"), F.col(c))
    apart = e.select(own("part", "src").alias("src"), own("part", "dst").alias("dst"))
    back = lambda d: d.select(F.split("node", "\x01")[0].alias("part"), F.split("node", "\x01")[1].alias("node"), *[c for c in d.columns if c != "node"])
    out, into = (e.groupBy("part", F.col(c).alias("node")).agg(F.count("*").alias(n)) for c, n in (("src", "out_degree"), ("dst", "in_degree")))
    triangles = graph.clustering(apart.select(F.col("src").alias("node")).unionByName(apart.select(F.col("dst").alias("node"))).distinct(), apart)
    joined = graph.components(apart.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select("node", F.lit(1).alias("joined"))
    parts = [out, into, graph.ranks_by_part(nodes, e).withColumnRenamed("rank", "pagerank"), graph.path_centralities(e, "part"), back(triangles), back(joined)]
    x = reduce(lambda a, b: a.join(b, ["part", "node"], "left"), parts, nodes)
    # closeness and betweenness are scaled by the whole snapshot's nodes, of which those without edges reach nothing
    n = F.count("*").over(Window.partitionBy("part"))
    m = F.count("closeness").over(Window.partitionBy("part"))
    x = x.withColumn("closeness", F.when(n > 1, F.col("closeness") * (m - 1) / (n - 1)).otherwise(F.col("closeness")))
    x = x.withColumn("betweenness", F.when((n > 2) & (m > 2), F.col("betweenness") * (m - 1.0) * (m - 2.0) / ((n - 1.0) * (n - 2.0))).otherwise(0.0))
    return cut(x.withColumnsRenamed({"part": "commit_hash", "node": "entity_id"}).fillna(0), "graphs")


def transitions(pairs: DataFrame, entities: DataFrame, edges: DataFrame, modified: DataFrame, graphs: DataFrame) -> DataFrame:
    """(commit_before, commit_after, GLOBALS): what changes from one snapshot's graph to the next as a whole."""
    of = graphs.groupBy("commit_hash").agg(F.count("*").alias("n"), F.sum("out_degree").alias("m"), F.avg("clustering").alias("c"), (F.count("*") - F.sum("joined")).alias("k"))
    a, b = (of.select(F.col("commit_hash").alias(p), *[F.col(c).alias(f"{c}_{s}") for c in "nmck"]) for p, s in (("commit_before", "a"), ("commit_after", "b")))
    density = lambda s: F.when(F.col(f"n_{s}") > 1, F.col(f"m_{s}") / (F.col(f"n_{s}") * (F.col(f"n_{s}") - 1.0))).otherwise(0.0)
    one = F.lit(1)
    x = pairs.join(a, "commit_before").join(b, "commit_after").select(
        *PAIR, (density("b") - density("a")).alias("ee_density_delta"), density("a").alias("ee_density_a"), density("b").alias("ee_density_b"), ((F.col("n_b") - F.col("n_a")) / F.greatest("n_a", one)).alias("se_node_growth_ratio"),
        ((F.col("m_b") - F.col("m_a")) / F.greatest("m_a", one)).alias("se_edge_growth_ratio"), (F.col("c_b") - F.col("c_a")).alias("se_clustering_delta"), (F.abs(F.col("k_b") - F.col("k_a")) / F.greatest("k_a", one)).alias("se_component_delta"),
    )
    both = context.sides(graphs, pairs, ["entity_id"], F.struct("pagerank", (F.col("out_degree") + F.col("in_degree")).alias("d")))
    common = both.where("had and has")
    shift = common.groupBy(*PAIR).agg(
        F.avg(F.abs(F.col("new.pagerank") - F.col("old.pagerank"))).alias("ce_mean_pagerank_shift"), F.max(F.abs(F.col("new.pagerank") - F.col("old.pagerank"))).alias("ce_max_pagerank_shift"),
        F.avg(F.abs(F.col("new.d") - F.col("old.d"))).alias("ce_mean_degree_shift"),
    )
    mod = modified.select(*KEY, F.lit("changed").alias("change_kind"))
    kinds = both.join(mod, KEY, "left").select(*KEY, F.when(~F.col("had"), "added").when(~F.col("has"), "removed").otherwise(F.col("change_kind")).alias("change_kind"))
    nodes = series.diff_ratios(kinds, of.select("commit_hash", "n"))
    nodes = nodes.select(*PAIR, *[F.col(c).alias(f"ne_{c}") for c in nodes.columns[2:]])
    ends = series.edge_ratios(edges, pairs)
    ends = ends.select(*PAIR, *[F.col(c).alias(f"ee_{c}") for c in ends.columns[2:]])
    return reduce(lambda l, r: l.join(r, PAIR, "left"), [shift, nodes, ends], x).fillna(0.0)


def pair_features(pairs: DataFrame, entities: DataFrame, edges: DataFrame, modified: DataFrame, order: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """(commit_before, commit_after, entity_id, FEATURES) of every entity of each pair's later snapshot.

    pairs (commit_before, commit_after); entities (commit_hash, entity_id, file_path, lineno, end_lineno, source_code,
    metrics), the current rows; edges (commit_hash, src, dst), the calls; modified (pair, entity_id); order (commit_before,
    commit_after, seq), by which earlier modifications count; diffs (pair, file_path, added, deleted), else sizes are 0.
    What has no value is 0; what reaches nothing modified is FAR, and FAR_DATA for the data flow.
    """
    pairs = cut(pairs.select(*PAIR).distinct(), "pairs")
    entities = cut(entities, "entities")
    edges = cut(edges.where("src <> dst").select("commit_hash", "src", "dst").distinct(), "calls")
    modified = cut(modified.select(*KEY).distinct(), "modified")
    graphs = snapshot_graphs(entities, edges)
    later = pairs.withColumn("commit_hash", F.col("commit_after"))
    x = later.join(entities, "commit_hash").select(*KEY, "file_path", (F.col("end_lineno") - F.col("lineno") + 1).alias("entity_size"), *METRICS)
    g = later.join(graphs, "commit_hash").select(*KEY, "out_degree", "in_degree", "pagerank", "closeness", "betweenness")
    calls = cut(later.join(edges, "commit_hash").select(*PAIR, "src", "dst"), "pair-calls")
    hit = modified.select(*KEY, F.lit(1).alias("is_modified"))

    # the graphs of all pairs at once, as parts that share no node
    pair = F.concat(F.col("commit_before"), F.lit("\x01"), F.col("commit_after"))
    name = lambda c: F.concat(pair, F.lit("\x01"), F.col(c))
    apart = cut(calls.select(name("src").alias("src"), name("dst").alias("dst")), "apart")
    starts = cut(modified.select(name("entity_id").alias("node")), "starts")

    def back(d: DataFrame, *columns) -> DataFrame:
        p = F.split("node", "\x01")
        return d.select(p[0].alias("commit_before"), p[1].alias("commit_after"), p[2].alias("entity_id"), *columns)

    directed = back(graph.distances(graph.reversed_edges(apart), starts), F.col("distance").alias("directed"))
    nearest = back(graph.distances(graph.undirected(apart), starts), F.col("distance").alias("undirected"))
    reached = back(graph.reached_seeds(apart, starts), F.col("n").alias("modified_data_deps_count"))
    nodes = x.select(pair.alias("part"), F.col("entity_id").alias("node"))
    seeded = graph.ranks_by_part(nodes, calls.select(pair.alias("part"), "src", "dst"), modified.select(pair.alias("part"), F.col("entity_id").alias("node")))
    p = F.split("part", "\x01")
    impact = seeded.select(p[0].alias("commit_before"), p[1].alias("commit_after"), F.col("node").alias("entity_id"), F.col("rank").alias("pagerank_impact"))
    near = [
        calls.join(hit.select(*PAIR, F.col("entity_id").alias(there)), [*PAIR, there]).groupBy(*PAIR, F.col(here).alias("entity_id")).agg(F.count("*").alias(n))
        for here, there, n in (("dst", "src", "modified_dependents_count"), ("src", "dst", "modified_dependencies_count"))
    ]
    # each ancestor of a modified entity, by its path
    parts = F.split("entity_id", "::")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "::"))
    members = modified.where(F.size(parts) > 1).select(*PAIR, F.explode(above).alias("entity_id")).groupBy(*KEY).agg(F.count("*").alias("modified_member_count"))
    stubs = context.stub_changes(context.callee_stubs(entities, edges), pairs)
    source = context.sides(entities, pairs, ["entity_id"], F.md5("source_code"))
    own = source.where("has").select(*KEY, (F.col("had") & ~F.col("old").eqNullSafe(F.col("new"))).cast("int").alias("own_source_changed"), F.col("had").alias("was_there"))
    local = context.sides(edges, pairs, ["src", "dst"], F.lit(1)).where("not (had and has)")
    local = local.select(*PAIR, F.explode(F.array("src", "dst")).alias("entity_id"), F.col("has").alias("new")).groupBy(*KEY).agg(F.count_if("new").alias("gtd_local_edges_added"), F.count_if(~F.col("new")).alias("gtd_local_edges_removed"))
    seq = order.groupBy(*PAIR).agg(F.min("seq").alias("seq"))
    past = modified.join(seq, PAIR).groupBy("entity_id", "seq").agg(F.countDistinct("commit_before", "commit_after").alias("k"))
    w = Window.partitionBy("entity_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    asked = x.select(*KEY).join(seq, PAIR)
    history = asked.select("entity_id", "seq").distinct().join(past, ["entity_id", "seq"], "left").select("entity_id", "seq", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("modification_frequency"))
    history = asked.join(history, ["entity_id", "seq"]).select(*KEY, "modification_frequency")

    x = reduce(lambda l, r: l.join(r, KEY, "left"), [g, hit, directed, nearest, reached, impact, *near, members, stubs, own, local, history], x)
    if diffs is not None:
        d = diffs.groupBy(*PAIR, "file_path").agg(F.sum("added").alias("file_lines_added"), F.sum("deleted").alias("file_lines_deleted"))
        x = x.join(d, [*PAIR, "file_path"], "left")
    else:
        x = x.withColumns({"file_lines_added": F.lit(0), "file_lines_deleted": F.lit(0)})
    x = x.join(transitions(pairs, entities, edges, modified, graphs), PAIR, "left")
    is_mod, zero = F.col("is_modified").isNotNull(), F.lit(0)
    size = F.coalesce("file_lines_added", zero) + F.coalesce("file_lines_deleted", zero)
    made = {
        "distance_to_modified_directed": F.when(is_mod, 0.0).otherwise(F.coalesce("directed", F.lit(FAR))),
        "distance_to_modified_undirected": F.when(is_mod, 0.0).otherwise(F.coalesce("undirected", F.lit(FAR))),
        "data_flow_distance": F.when(is_mod, 0.0).otherwise(F.coalesce("directed", F.lit(FAR_DATA))),
        "modified_dependents_count": F.when(is_mod, 0).otherwise(F.col("modified_dependents_count")),
        "modified_dependencies_count": F.when(is_mod, 0).otherwise(F.col("modified_dependencies_count")),
        "taint_reachability_score": (is_mod | F.col("directed").isNotNull()).cast("double"),
        "entity_modification_size": F.when(is_mod, size).otherwise(0),
        "gtd_change_class": F.when(~F.coalesce("was_there", F.lit(False)), 1).when(is_mod, 3).otherwise(0),
        "gtd_local_edge_churn": F.coalesce("gtd_local_edges_added", zero) + F.coalesce("gtd_local_edges_removed", zero),
    }
    x = x.withColumns(made)
    return x.select(*KEY, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


def drift_evolution(drifts: DataFrame) -> DataFrame:
    """(pair, sm_mean_drift, sm_drift_variance, sm_drift_entropy, sm_high_drift_ratio) of drifts (pair, drift): the population
    variance, the entropy of a histogram of at most 20 bins, and the share above twice the mean. Nulls and NaN don't count."""
    d = cut(drifts.where("drift is not null and not isnan(drift)").select(*PAIR, "drift"), "drifts")
    a = d.groupBy(*PAIR).agg(F.avg("drift").alias("sm_mean_drift"), F.var_pop("drift").alias("sm_drift_variance"), F.count("*").alias("_n"))
    high = d.join(a, PAIR).groupBy(*PAIR).agg(F.avg((F.col("drift") > 2 * F.col("sm_mean_drift")).cast("double")).alias("_high"))
    few = d.join(a.where("_n < 20"), PAIR).select(*PAIR, "drift", "_n")
    wide = series.histogram_entropy(d, PAIR, "drift").select(*PAIR, F.col("entropy").alias("_wide"))
    edge = few.groupBy(*PAIR, "_n").agg(F.min("drift").alias("_lo"), F.max("drift").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_n")
    cell = F.when(width > 0, F.least(F.floor((F.col("drift") - F.col("_lo")) / width), F.col("_n") - 1)).otherwise(0)
    c = few.join(edge, [*PAIR, "_n"]).groupBy(*PAIR, "_n", cell.alias("_cell")).agg(F.count("*").alias("_c"))
    narrow = c.groupBy(*PAIR).agg((-F.sum(F.col("_c") / F.col("_n") * F.log(F.col("_c") / F.col("_n")))).alias("_narrow"))
    x = a.join(high, PAIR).join(wide, PAIR).join(narrow, PAIR, "left")
    return x.select(*PAIR, "sm_mean_drift", "sm_drift_variance", F.when(F.col("_n") < 20, F.coalesce("_narrow", F.lit(0.0))).otherwise(F.col("_wide")).alias("sm_drift_entropy"), F.when(F.col("sm_mean_drift") > 0, F.col("_high")).otherwise(0.0).alias("sm_high_drift_ratio"))


def anchored_pairs(state: DataFrame, entities: DataFrame, commit: str) -> DataFrame:
    """(commit_before, commit_after, entity_id): a commit's entities against the version that each is cached at, which may be a
    different commit for each; new ones and those of the same commit are left out."""
    here = entities.where(F.col("commit_hash") == commit).select("entity_id")
    return state.join(here, "entity_id").where(F.col("anchor_commit") != commit).select(F.col("anchor_commit").alias("commit_before"), F.lit(commit).alias("commit_after"), "entity_id").distinct()
