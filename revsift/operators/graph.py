"""Directed graphs as edge tables (src, dst): reachability, distances, centrality, structure.

Every loop writes its state to the shared folder each round and looks only at a count to end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.common import BROADCAST_ROWS, cut, forget

#: Ranks are final when all together change by less than this a node, and after so many rounds at the latest.
TOLERANCE, MOST_ROUNDS = 1e-6, 100
#: Rounds after which that is looked at.
CHECKED = 2


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops and nulls."""
    return edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reversed_edges(edges)).distinct()


def distances(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(node, distance): hops along the edges from the nearest of starts.node, as far as `most`."""
    known = cut(starts.select("node").where("node is not null").distinct().withColumn("distance", F.lit(0)), "reach")
    edges, hop, front = cut(edges, "edges"), 0, known
    while (most is None or hop < most) and not front.isEmpty():
        hop += 1
        front = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
        front = cut(front.withColumn("distance", F.lit(hop)), "front")
        known = known.unionByName(front)
        if hop % 10 == 0:  # a plan reads few tables, however many hops there are
            known = cut(known, "reach")
    return known


def dependents(edges: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """Callers within so many hops, the start among them; without a bound all callers, the start left out."""
    d = distances(reversed_edges(edges), starts, hops)
    return d if hops is not None else d.where("distance > 0")


def dependencies(edges: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """Callees, by the same rule."""
    d = distances(edges, starts, hops)
    return d if hops is not None else d.where("distance > 0")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree), zeros where a node has no edges."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return nodes.select("node").join(out, "node", "left").join(into, "node", "left").fillna(0, ["out_degree", "in_degree"])


def ranks_by_part(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, rounds: int | None = None) -> DataFrame:
    """(part, node, rank) in each of many graphs at once, of nodes (part, node), edges (part, src, dst), seeds (part, node).

    Ranks start uniform; the teleport is uniform, or over the seeds. Rounds go on until in every part all ranks together
    change by less than TOLERANCE a node, at most MOST_ROUNDS; or a given number of them. The mass of nodes without
    out-edges goes where the teleport goes. In a part without a seed among its nodes all ranks are 0.
    """
    key = ["part", "node"]
    nodes = cut(nodes.select(*key).distinct(), "nodes")
    sizes = cut(nodes.groupBy("part").agg(F.count("*").alias("n")), "sizes")
    # a row for each part: with few parts, which may be large, it goes to every task; with many no part is a hot key
    few = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    of = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    base = nodes.join(of(sizes), "part")
    if seeds is None:
        base = base.withColumn("p", 1.0 / F.col("n"))
    else:
        s = seeds.select(*key).distinct().join(nodes, key, "left_semi")
        s = cut(s, "seeds")
        base = base.join(of(s.groupBy("part").agg(F.count("*").alias("m"))), "part", "left").join(s.withColumn("hit", F.lit(1.0)), key, "left")
        base = base.select(*key, "n", (F.coalesce("hit", F.lit(0.0)) / F.coalesce("m", F.lit(1))).alias("p"), F.col("m").isNotNull().alias("seeded"))
    out = edges.groupBy("part", F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    links = cut(edges.select("part", F.col("src").alias("node"), "dst").join(out, ["part", "node"]), "links")
    start = 1.0 / F.col("n") if seeds is None else F.when(F.col("seeded"), 1.0 / F.col("n")).otherwise(0.0)
    rank = cut(base.join(out, key, "left").select(*key, "n", "p", "deg", start.alias("rank")), "base")
    last = None
    for i in range(MOST_ROUNDS if rounds is None else rounds):
        lost = rank.where("deg is null").groupBy("part").agg(F.sum("rank").alias("lost"))
        got = rank.select(*key, "rank").join(links, key).groupBy("part", F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        new = rank.join(got, key, "left").join(of(lost), "part", "left")
        sent = alpha * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) * F.col("p")) + (1 - alpha) * F.col("p")
        old, new = (rank if last is None else last), cut(new.select(*key, "n", "p", "deg", sent.alias("rank"), F.col("rank").alias("was")), "rank")
        forget(old)
        last, rank = new, new.drop("was")
        if rounds is None and i % CHECKED == CHECKED - 1 and (new.groupBy("part").agg((F.sum(F.abs(F.col("rank") - F.col("was"))) / F.max("n")).alias("change")).agg(F.max("change")).first()[0] or 0.0) < TOLERANCE:
            break
    return rank.select(*key, "rank")


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, rounds: int | None = None) -> DataFrame:
    """(node, rank): ranks_by_part of one graph."""
    one = lambda d: None if d is None else d.withColumn("part", F.lit(0))
    return ranks_by_part(one(nodes), one(edges), one(seeds), alpha, rounds).select("node", "rank")


def decayed_strength(edges: DataFrame, starts: DataFrame, threshold: float = 0.05, hops: int = 6) -> DataFrame:
    """(node, strength) of the callers that a change reaches: a caller's strength is its callee's, times 0.25 plus 0.3 by
    the callee's in-degree; the strongest way counts, and it ends below the threshold or after so many hops."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("indeg"))
    step = cut(edges.join(into, edges["dst"] == into["node"]).select("src", "dst", (0.25 + 0.3 / F.greatest("indeg", F.lit(1))).alias("f")), "steps")
    best = cut(starts.select("node").distinct().withColumn("strength", F.lit(1.0)), "strength")
    front = best
    for _ in range(hops):
        new = front.join(step, front["node"] == step["dst"]).groupBy(F.col("src").alias("node")).agg(F.max(F.col("strength") * F.col("f")).alias("strength")).where(F.col("strength") >= threshold)
        was = best.select("node", F.col("strength").alias("was"))
        front = cut(new.join(was, "node", "left").where("was is null or strength > was").select("node", "strength"), "stronger")
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("node").agg(F.max("strength").alias("strength")), "strength")
    return best


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the connected component, for every node of edges (u, v), except roots.

    Large-star and small-star rounds, until the edges are stars; the number of rounds grows with the logarithm of the size
    of the largest component. Each round's edges are written to the shared folder. Only minima are aggregated, so a node
    with very many edges is never gathered in one task, and AQE splits its join.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was, now = None, mark(e)
    while was != now and now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # an edge to the smallest neighbour itself is kept by its other end, except for local minima
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, cut(star, "star")
        forget(old)
        was, now = now, mark(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, clustering) in the undirected view: closed pairs of neighbours by pairs of neighbours, 0 below two of them.

    Pairs of neighbours are formed at the end of lower degree only, which keeps a hub from pairing all of its neighbours.
    """
    both = undirected(edges)
    deg = cut(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg")), "degree")
    e = both.join(deg.select(F.col("node").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("node").alias("dst"), F.col("deg").alias("dd")), "dst")
    up = cut(e.where("ds < dd or (ds = dd and src < dst)").select("src", "dst"), "up")
    a, b = up.select("src", F.col("dst").alias("x")), up.select("src", F.col("dst").alias("y"))
    pairs = a.join(b, "src").where("x < y")
    near = both.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    tri = pairs.join(near, ["x", "y"])
    each = tri.select(F.explode(F.array("src", "x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    share = F.when(F.col("deg") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0)
    return nodes.select("node").join(deg, "node", "left").join(each, "node", "left").select("node", F.coalesce(share, F.lit(0.0)).alias("clustering"))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average degree, density, components, average clustering, mean rank."""
    nodes = nodes.select("node").distinct()
    n = nodes.agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"))
    joined = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).agg(F.count("*").alias("joined"))
    c = clustering(nodes, edges).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("average_clustering"))
    one = n.crossJoin(m).crossJoin(joined).crossJoin(c)  # one row each
    return one.select(
        "nodes", "edges", (2.0 * F.col("edges") / F.greatest("nodes", F.lit(1))).alias("average_degree"), F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0))).otherwise(0.0).alias("density"),
        (F.col("nodes") - F.col("joined")).alias("components"), "average_clustering", (1.0 / F.greatest("nodes", F.lit(1))).alias("mean_rank"),
    )


#: Sources whose shortest paths one task follows.
SOURCES = 500


def path_centralities(edges: DataFrame, part: str) -> DataFrame:
    """(part, node, closeness, betweenness) of each part's own graph, from edges (part, src, dst).

    Exact, so every node of a part is a source of shortest paths: SOURCES of them in a task, with the part's edges, and the
    tasks' shares of each node are summed up. A task holds one part's edges (a snapshot's graph), the one thing here that
    has to fit its memory. Closeness takes incoming distances, scaled by the share of nodes that reach the node;
    betweenness is Brandes' and normalised for a directed graph.
    """
    kinds = dict(edges.dtypes)
    e = cut(edges.select(part, "src", "dst"), "part-edges")
    nodes = e.select(part, F.col("src").alias("node")).unionByName(e.select(part, F.col("dst").alias("node"))).distinct()
    n = cut(nodes.groupBy(part).agg(F.count("*").alias("_n")), "part-sizes")
    blocks = n.select(part, "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / SOURCES).cast("int"))).alias("_block"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(p["src"]) | set(p["dst"]))
        at = {x: i for i, x in enumerate(names)}
        block = int(p["_block"].iloc[0])
        out: list[list[int]] = [[] for _ in names]
        for a, b in zip(p["src"], p["dst"]):
            out[at[a]].append(at[b])
        far, seen, between = [0] * len(names), [0] * len(names), [0.0] * len(names)
        for s in range(block * SOURCES, min((block + 1) * SOURCES, len(names))):
            dist, ways, before, order = {s: 0}, {s: 1.0}, {s: []}, [s]
            for v in order:
                for w in out[v]:
                    if w not in dist:
                        dist[w], ways[w], before[w] = dist[v] + 1, 0.0, []
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        ways[w] += ways[v]
                        before[w].append(v)
            share = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in before[w]:
                    share[v] += ways[v] / ways[w] * (1 + share[w])
                if w != s:
                    between[w] += share[w]
                    far[w] += dist[w]
                    seen[w] += 1
        return pd.DataFrame({part: p[part].iloc[0], "node": names, "far": far, "seen": seen, "between": between})

    each = e.join(blocks, part).groupBy(part, "_block").applyInPandas(run, f"{part} {kinds[part]}, node {kinds['src']}, far long, seen long, between double")
    x = each.groupBy(part, "node").agg(F.sum("far").alias("far"), F.sum("seen").alias("seen"), F.sum("between").alias("between")).join(n, part)
    close = F.when(F.col("far") > 0, F.col("seen") / F.col("far") * F.col("seen") / (F.col("_n") - 1)).otherwise(0.0)
    return x.select(part, "node", close.alias("closeness"), (F.col("between") * F.when(F.col("_n") > 2, 1 / ((F.col("_n") - 1.0) * (F.col("_n") - 2.0))).otherwise(1.0)).alias("betweenness"))


def reached_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, n): how many seeds other than itself each node reaches along the edges, itself left out.

    Pairs of a node and a seed are followed back from the seeds, so the work is that of the closure's rows that are asked for.
    """
    back = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("up")), "back")
    front = known = cut(seeds.select("node", F.col("node").alias("seed")).distinct(), "reached")
    while not front.isEmpty():
        front = front.join(back, "node").select(F.col("up").alias("node"), "seed").distinct().join(known, ["node", "seed"], "left_anti")
        old, front = front, cut(front, "front")
        past, known = known, cut(known.unionByName(front), "reached")
        forget(old, past)
    return known.where("node <> seed").groupBy("node").agg(F.count("*").alias("n"))


def distance(edges: DataFrame, source: str, target: str) -> int | None:
    """Hops along the edges from one node to another; null where there is no way."""
    spark = edges.sparkSession
    r = distances(edges, spark.createDataFrame([(source,)], "node string")).where(F.col("node") == target).first()
    return None if r is None else r["distance"]


def path_lengths(edges: DataFrame, part: str) -> DataFrame:
    """(part, diameter, average_path) of the largest connected component of each part's graph, directions aside, from edges
    (part, src, dst). Breadth-first from every node of the component at once: (seed, node) pairs, as many as the component's
    pairs of nodes, go through joins and are never in one task."""
    name = lambda c: F.concat(F.col(part).cast("string"), F.lit("\x01"), F.col(c))
    e = cut(undirected(edges.where("src <> dst").select(name("src").alias("src"), name("dst").alias("dst"))), "both")
    root = components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    n = e.select(F.col("src").alias("node")).distinct().join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    of = F.split("node", "\x01")[0]
    size = n.groupBy(of.alias("part"), "root").agg(F.count("*").alias("n")).groupBy("part").agg(F.max(F.struct(F.col("n"), F.col("root"))).alias("m"))
    front = known = cut(n.join(size.select(F.col("m.root").alias("root"), F.col("m.n").alias("n")), "root").select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops")), "seeds")
    hop = 0
    while not front.isEmpty():
        hop += 1
        front = front.join(e, front["node"] == e["src"]).select("seed", F.col("dst").alias("node")).distinct().join(known, ["seed", "node"], "left_anti")
        old, front = front, cut(front.withColumn("hops", F.lit(hop)), "front")
        past, known = known, cut(known.unionByName(front), "ways")
        forget(old, past)
    x = known.where("seed <> node").groupBy(F.split("node", "\x01")[0].alias(part))
    return x.agg(F.max("hops").alias("diameter"), F.avg("hops").alias("average_path"))
