import random

import pytest

from revsift.operators import graph, strategies


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_hops(spark):
    e, start = edges(spark, [("a", "b"), ("b", "c")]), nodes(spark, ["c"])
    assert as_dict(graph.dependents(e, start, 1)) == {"c": 0, "b": 1}
    assert as_dict(graph.dependents(e, start, 2)) == {"c": 0, "b": 1, "a": 2}
    assert as_dict(graph.dependents(e, start)) == {"b": 1, "a": 2}
    assert as_dict(graph.dependencies(e, nodes(spark, ["a"]), 1)) == {"a": 0, "b": 1}


def test_decay(spark):
    assert as_dict(graph.decayed_strength(edges(spark, [("x", "y")]), nodes(spark, ["y"])))["x"] == pytest.approx(0.55)
    assert as_dict(graph.decayed_strength(edges(spark, [("x", "y"), ("z", "y")]), nodes(spark, ["y"])))["x"] == pytest.approx(0.40)
    chain = edges(spark, [(f"n{i + 1}", f"n{i}") for i in range(7)])
    assert len(as_dict(graph.decayed_strength(chain, nodes(spark, ["n0"])))) == 6  # the start and five callers


def test_pagerank(spark):
    r = as_dict(graph.pagerank(nodes(spark, "abc"), edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])))
    assert all(v == pytest.approx(1 / 3) for v in r.values())
    assert sum(as_dict(graph.pagerank(nodes(spark, "abcd"), edges(spark, [("a", "b"), ("c", "b")]))).values()) == pytest.approx(1)
    assert set(as_dict(graph.pagerank(nodes(spark, "ab"), edges(spark, [("a", "b")]), nodes(spark, ["q"]))).values()) == {0.0}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"{rng.randrange(150):03}", f"{rng.randrange(150):03}") for _ in range(110)] + [(f"h{i:03}", "h000") for i in range(1, 60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = as_dict(graph.components(spark.createDataFrame(pairs, "u string, v string")))
    assert got == {x: find(x) for x in root if find(x) != x}
    assert as_dict(graph.components(spark.createDataFrame([], "u string, v string"))) == {}


def test_structure(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    assert as_dict(graph.clustering(nodes(spark, "abcde"), e)) == pytest.approx({"a": 1, "b": 1, "c": 1 / 3, "d": 0, "e": 0})
    t = graph.topology(nodes(spark, "abcde"), e).first()
    assert (t["nodes"], t["edges"], t["components"]) == (5, 4, 2) and t["density"] == pytest.approx(0.2)
    chain = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "p int, src string, dst string")
    got = {r["node"]: (r["closeness"], r["betweenness"]) for r in graph.path_centralities(chain, "p").collect()}
    assert got["b"] == pytest.approx((0.5, 0.5)) and got["c"][0] == pytest.approx(2 / 3) and got["a"] == (0, 0)


def test_strategies(spark):
    e, ch = edges(spark, [("a", "b"), ("b", "c"), ("d", "b")]), nodes(spark, ["c"])
    assert {r[0] for r in strategies.fixed_hop(ch, e).collect()} == {"c", "b"}
    assert {r[0] for r in strategies.bfs_decay(ch, e).collect()} == {"a", "b", "c", "d"}
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.01), ("c", None)], "node string, score double")
    assert {r[0] for r in strategies.predictive(scores).collect()} == {"a"}
    assert {r[0] for r in strategies.predictive(scores, ch).collect()} == {"a", "c"}
    assert {r[0] for r in strategies.pagerank_propagation(nodes(spark, "abcd"), ch, e, share=0.5).collect()} >= {"c"}
