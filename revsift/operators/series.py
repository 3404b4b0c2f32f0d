"""Descriptors of a sequence of snapshots: scaling, weights, entropies, sizes, and what a diff means in shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revsift.common import cut, running

EPS = 1e-9


def quantiles(rows: DataFrame, by: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """(by, wanted names) of a column's exact quantiles, interpolated linearly. Nulls and NaN don't count.

    Distinct values are counted and sorted over range partitions, and running counts give each its positions, so no group
    is gathered in a task."""
    v = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    x = cut(running(v, [*[F.col(c) for c in by], F.col("_v")], {"_to": ("sum", "_n")}), "positions")
    size = x.groupBy(*by).agg(F.sum("_n").alias("_size"), F.min(F.col("_to") - F.col("_n")).alias("_start"))
    if by:
        size = size.withColumnsRenamed({c: f"_of_{c}" for c in by})
        x = x.join(size, reduce(lambda l, r: l & r, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])).drop(*[f"_of_{c}" for c in by])
    else:
        x = x.crossJoin(F.broadcast(size))  # one row
    last, first = F.col("_to") - F.col("_start") - 1, F.col("_to") - F.col("_start") - F.col("_n")
    at = lambda p: F.max(F.when((first <= p) & (last >= p), F.col("_v")))
    ends = {}
    for k, q in wanted.items():
        place = F.lit(q) * (F.col("_size") - 1)
        ends[k] = (at(F.floor(place)).alias(f"_lo_{k}"), at(F.ceil(place)).alias(f"_hi_{k}"), F.max(place - F.floor(place)).alias(f"_f_{k}"))
    g = x.groupBy(*by).agg(*[e for v in ends.values() for e in v])
    return g.select(*by, *[(F.col(f"_lo_{k}") + F.col(f"_f_{k}") * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k) for k in wanted])


def unpivoted(rows: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, metric, x): a row for each column."""
    return rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("m")).select(*keep, "m.*")


def robust_scale(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Every column as clip((x - median) / (q75 - q25), -3, 3) put into 0 to 1; 0 where the quartiles are equal."""
    q = {r["metric"]: r for r in quantiles(unpivoted(rows, columns), ["metric"], "x", {"lo": 0.25, "mid": 0.5, "hi": 0.75}).collect()}  # a row for each column
    made = {}
    for c in columns:
        if c not in q or q[c]["hi"] - q[c]["lo"] < EPS:
            made[c] = F.when(F.col(c).isNotNull(), 0.0)
        else:
            z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col(c) - q[c]["mid"]) / (q[c]["hi"] - q[c]["lo"])))
            made[c] = F.when(F.col(c).isNotNull(), (z + 3) / 6)
    return rows.withColumns(made)


def entropy_weights(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, weight): the less even a column, the more it weighs; uniform for one row or columns all even."""
    long = unpivoted(rows, columns)
    total = long.groupBy("metric").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    p = F.col("x") / (F.col("s") + EPS)
    h = long.join(F.broadcast(total), "metric").groupBy("metric").agg((-F.sum(p * F.log(p + EPS)) / F.log(F.first("n") + EPS)).alias("h"), F.first("n").alias("n"))  # a row for each column
    h = h.select("metric", "n", (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), "h"))).alias("d"))
    w = Window.partitionBy()  # over the metrics, a handful
    return h.select("metric", F.when((F.col("n") <= 1) | (F.sum("d").over(w) < EPS), 1.0 / len(columns)).otherwise(F.col("d") / F.sum("d").over(w)).alias("weight"))


def histogram_entropy(rows: DataFrame, by: list[str], x: str, bins: int = 20) -> DataFrame:
    """(by, n, entropy) of an equal-width histogram over the group's range, densities plus 1e-9; 0 without a range."""
    edge = rows.where(F.col(x).isNotNull()).groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("n"))
    r = rows.where(F.col(x).isNotNull()).join(edge, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    cell = F.when(width > 0, F.least(F.floor((F.col(x) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    c = r.groupBy(*by, "n", "_lo", "_hi", cell.alias("_cell")).agg(F.count("*").alias("_c"))
    density = F.when(width > 0, F.col("_c") / (F.col("n") * width)).otherwise(0.0) + EPS
    per = c.groupBy(*by, "n", "_lo", "_hi").agg(F.sum(density).alias("_d"), F.collect_list(density).alias("_ds"))  # at most `bins` values
    total = F.col("_d") + (bins - F.size("_ds")) * EPS
    part = lambda d: -(d / total) * F.log(d / total)
    h = F.aggregate("_ds", F.lit(0.0), lambda s, d: s + part(d)) + (bins - F.size("_ds")) * part(F.lit(EPS))
    return per.select(*by, "n", F.when(F.col("_hi") > F.col("_lo"), h).otherwise(0.0).alias("entropy"))


def diff_ratios(changes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Shares of a pair of snapshots, from its changes and (commit_hash, n): added, deleted and surviving over the union,
    modified and unchanged over the intersection."""
    k = changes.groupBy("commit_before", "commit_after").agg(*[F.count_if(F.col("change_kind") == v).alias(v) for v in ("added", "removed", "changed")])
    x = k.join(sizes.select(F.col("commit_hash").alias("commit_before"), F.col("n").alias("_n")), "commit_before")
    union, both = F.greatest(F.col("_n") + F.col("added"), F.lit(1)), F.col("_n") - F.col("removed")
    common = F.greatest(both, F.lit(1))
    return x.select(
        "commit_before", "commit_after", (F.col("added") / union).alias("node_added_ratio"), (F.col("removed") / union).alias("node_deleted_ratio"), (F.col("changed") / common).alias("node_modified_ratio"),
        ((both - F.col("changed")) / common).alias("node_unchanged_ratio"), (both / union).alias("node_survival_ratio"),
    )


def edge_ratios(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shares of edges (commit_hash, src, dst) added and removed between the snapshots of pairs, over the union, and densities."""
    e = edges.select("commit_hash", "src", "dst").where("src <> dst").distinct()
    a = e.join(pairs.withColumn("commit_hash", F.col("commit_before")), "commit_hash").withColumn("side", F.lit(1))
    b = e.join(pairs.withColumn("commit_hash", F.col("commit_after")), "commit_hash").withColumn("side", F.lit(2))
    s = a.unionByName(b).groupBy("commit_before", "commit_after", "src", "dst").agg(F.bit_or("side").alias("side"))
    k = s.groupBy("commit_before", "commit_after").agg(F.count("*").alias("u"), F.count_if(F.col("side") == 2).alias("add"), F.count_if(F.col("side") == 1).alias("rem"))
    return k.select("commit_before", "commit_after", (F.col("add") / F.col("u")).alias("edge_added_ratio"), (F.col("rem") / F.col("u")).alias("edge_removed_ratio"), ((F.col("add") + F.col("rem")) / F.col("u")).alias("edge_churn"))


def mean_and_deviation(rows: DataFrame, by: list[str], columns: list[str], digits: int = 4) -> DataFrame:
    """Mean and sample deviation (0 for one row) of each column."""
    cols = [[F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), digits).alias(f"{c}_std")] for c in columns]
    return rows.groupBy(*by).agg(F.count("*").alias("runs"), *reduce(lambda a, b: a + b, cols))


def stride_sample(commits: DataFrame, stride: int, offset: int = 0) -> DataFrame:
    """(repo, commit_before, commit_after): consecutive pairs of every stride-th commit of a repo, counted from its newest."""
    c = commits.where("repo is not null and seq is not null").groupBy("repo", "commit_hash").agg(F.min("seq").alias("seq"))
    back = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("seq"), F.desc("commit_hash"))) - 1 - offset
    c = c.withColumn("b", back).where((F.col("b") >= 0) & (F.col("b") % stride == 0))
    w = Window.partitionBy("repo").orderBy("seq", "commit_hash")
    return c.select("repo", F.lag("commit_hash").over(w).alias("commit_before"), F.col("commit_hash").alias("commit_after")).where("commit_before is not null")


def temporal_split(commits: DataFrame, ratio: float = 0.7) -> DataFrame:
    """(commit_hash, part): of each repo the earliest max(1, floor(n * ratio)) commits are train, the others test."""
    c = commits.where("repo is not null and seq is not null").groupBy("repo", "commit_hash").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("seq", "commit_hash"))
    n = F.count("*").over(Window.partitionBy("repo"))
    return c.select("repo", "commit_hash", F.when(place <= F.greatest(F.lit(1), F.floor(n * ratio)), "train").otherwise("test").alias("part"))


#: Metrics of a snapshot by category; fixed names.
CATEGORIES = {
    "scale": ["entities", "classes", "functions", "total_loc", "loc_per_function"],
    "topology": ["nodes", "edges", "average_degree", "density", "components", "average_clustering", "mean_rank"],
    "semantic": ["mean_similarity", "norm_variance", "norm_entropy"],
    "complexity": ["mean_fan_in", "mean_fan_out", "mean_loc", "import_lines"],
    "evolution": ["mean_churn", "modified_entities", "mean_drift", "relative_age"],
}


def state_metrics(entities: DataFrame, graphs: DataFrame, order: DataFrame, modified: DataFrame, vectors: DataFrame, drifts: DataFrame) -> DataFrame:
    """(repo, commit_hash, seq, all metrics of CATEGORIES): one row a snapshot.

    entities (commit_hash, entity_id, entity_type, lineno, end_lineno, source_code); graphs, of features.snapshot_graphs; order
    (repo, commit_hash, seq); modified (commit_hash, entity_id); vectors (commit_hash, vector); drifts (commit_hash, drift).
    mean_similarity is the mean cosine of all pairs of a snapshot's vectors, from the sum of the unit vectors, so no pair is
    formed. import_lines are distinct lines that begin with import or from.
    """
    loc = (F.col("end_lineno") - F.col("lineno") + 1).cast("double")
    fn = F.col("entity_type").isin("function", "method")
    scale = entities.groupBy("commit_hash").agg(
        F.count("*").alias("entities"), F.count_if(F.col("entity_type") == "class").alias("classes"), F.count_if(fn).alias("functions"), F.coalesce(F.sum(loc), F.lit(0.0)).alias("total_loc"), F.avg(loc).alias("mean_loc")
    )
    scale = scale.withColumn("loc_per_function", F.col("total_loc") / F.greatest("functions", F.lit(1)))
    n = F.col("nodes")
    topology = graphs.groupBy("commit_hash").agg(
        F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.avg("clustering").alias("average_clustering"), (F.count("*") - F.sum("joined")).alias("components"), F.avg("pagerank").alias("mean_rank"),
        F.avg("in_degree").alias("mean_fan_in"), F.avg("out_degree").alias("mean_fan_out"),
    ).withColumns({"average_degree": 2.0 * F.col("edges") / F.greatest(n, F.lit(1)), "density": F.when(n > 1, F.col("edges") / (n * (n - 1.0))).otherwise(0.0)})
    lines = entities.select("commit_hash", F.explode(F.filter(F.transform(F.split("source_code", "\n"), F.trim), lambda t: F.startswith(t, F.lit("import ")) | F.startswith(t, F.lit("from ")))).alias("t"))
    imports = lines.distinct().groupBy("commit_hash").agg(F.count("*").alias("import_lines"))
    v = vectors.where(F.size("vector") > 0).withColumn("_norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))).where("_norm > 0")
    v = cut(v.select("commit_hash", "vector", "_norm"), "vectors")
    total = v.select("commit_hash", F.posexplode("vector").alias("i", "e"), "_norm").groupBy("commit_hash", "i").agg(F.sum(F.col("e").cast("double") / F.col("_norm")).alias("s"))
    total = total.groupBy("commit_hash").agg(F.sum(F.col("s") * F.col("s")).alias("_square"))
    norms = v.groupBy("commit_hash").agg(F.count("*").alias("_n"), F.var_pop("_norm").alias("norm_variance"), (F.max("_norm") - F.min("_norm")).alias("_range"))
    spread = histogram_entropy(v, ["commit_hash"], "_norm").select("commit_hash", F.col("entropy").alias("_entropy"))
    semantic = norms.join(total, "commit_hash").join(spread, "commit_hash").select(
        "commit_hash", F.when(F.col("_n") > 1, (F.col("_square") - F.col("_n")) / (F.col("_n") * (F.col("_n") - 1.0))).otherwise(0.0).alias("mean_similarity"), "norm_variance",
        F.when(F.col("_range") < 1e-4, 0.0).otherwise(F.col("_entropy")).alias("norm_entropy"),
    )
    place = Window.partitionBy("repo").orderBy("seq", "commit_hash")
    c = order.groupBy("repo", "commit_hash").agg(F.min("seq").alias("seq"))
    c = c.withColumn("relative_age", (F.row_number().over(place) - 1) / F.greatest(F.count("*").over(Window.partitionBy("repo")) - 1, F.lit(1)))
    now = modified.distinct().groupBy("commit_hash").agg(F.count("*").alias("modified_entities"))
    # mean churn: modifications so far, for each entity that was modified at all so far
    m = modified.distinct().join(c.select("repo", "commit_hash", "seq"), "commit_hash")
    first = m.groupBy("repo", "entity_id").agg(F.min("seq").alias("seq")).groupBy("repo", "seq").agg(F.count("*").alias("_new"))
    made = m.groupBy("repo", "seq").agg(F.count("*").alias("_made"))
    churn = c.join(made, ["repo", "seq"], "left").join(first, ["repo", "seq"], "left").fillna(0, ["_made", "_new"])
    churn = churn.withColumn("mean_churn", F.coalesce(F.sum("_made").over(place) / F.nullif(F.sum("_new").over(place), F.lit(0)), F.lit(0.0)))
    drift = drifts.where("drift is not null").groupBy("commit_hash").agg(F.avg("drift").alias("mean_drift"))
    x = churn.select("repo", "commit_hash", "seq", "relative_age", "mean_churn").join(scale, "commit_hash")
    x = reduce(lambda l, r: l.join(r, "commit_hash", "left"), [topology, imports, semantic, now, drift], x)
    names = [c for v in CATEGORIES.values() for c in v]
    return x.select("repo", "commit_hash", "seq", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def state_descriptors(metrics: DataFrame, categories: dict[str, list[str]] = CATEGORIES) -> DataFrame:
    """metrics' other columns and, for each category, the weighted sum of its scaled metrics, within 0 and 1. A table of one
    snapshot has zeros."""
    names = [c for v in categories.values() for c in v]
    metrics = cut(metrics, "metrics")
    scaled = cut(robust_scale(metrics, names), "scaled")
    alone = metrics.limit(2).count() < 2
    made = []
    for k, columns in categories.items():
        w = {r["metric"]: r["weight"] for r in entropy_weights(scaled, sorted(columns)).collect()}  # a row for each metric
        total = reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w[c])) for c in sorted(columns)]) if not alone and w else F.lit(0.0)
        made.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias(k))
    return scaled.select(*[c for c in metrics.columns if c not in names], *made)


def stratified_split(descriptors: DataFrame, columns: list[str], ratio: float = 0.7, clusters: int = 3, seed: int = 42) -> DataFrame:
    """(commit_hash, part): of each cluster of descriptors the earliest max(1, floor(n * ratio)) commits are train, the others
    test. Fewer than six commits are one cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    n = descriptors.count()
    k = 1 if n < 6 else min(clusters, n // 2)
    x = VectorAssembler(inputCols=columns, outputCol="_v").transform(descriptors)
    x = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(x).transform(x) if k > 1 else x.withColumn("_c", F.lit(0))
    x = cut(x.select("commit_hash", "seq", "_c"), "clusters")
    place = running(x.withColumn("_one", F.lit(1)), [F.col("_c"), F.col("seq"), F.col("commit_hash")], {"_to": ("sum", "_one")})
    size = cut(place, "places")
    of = size.groupBy("_c").agg(F.count("*").alias("_n"), F.min("_to").alias("_first"))  # a row for each cluster
    return size.join(F.broadcast(of), "_c").select("commit_hash", F.when(F.col("_to") - F.col("_first") < F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)), "train").otherwise("test").alias("part"))
