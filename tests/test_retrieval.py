import math

import pytest
from pyspark.sql import functions as F

from revsift.operators import retrieval, series


def test_wilson(spark):
    low, high = retrieval.wilson(F.col("h"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (5, 10)], "h long, n long").select(low, high).collect()
    assert tuple(got[0]) == (0.0, 0.0) and tuple(got[1]) == pytest.approx((0.2365896, 0.7634104), abs=1e-6)


def test_sign(spark):
    rows = [("five", 1, 2)] * 5 + [("none", 2, 1), ("none", 1, 1)] + [("mixed", 1, 2)] * 30 + [("mixed", 2, 1)] * 20
    p = {r["s"]: r["p"] for r in retrieval.sign_test(spark.createDataFrame(rows, "s string, baseline_rank long, selective_rank long"), ["s"]).collect()}
    assert p["five"] == pytest.approx(0.03125) and p["none"] == 1.0
    assert p["mixed"] == pytest.approx(sum(math.comb(50, i) for i in range(30, 51)) / 2**50)


def test_target_rank(spark):
    rows = [("r", "q", "s", ["a", "b", "c", None, "d"], [0.9, 0.9, 0.5, 1.0, float("nan")]), ("r", "m", "s", ["a", "b", "c"], [0.3, 0.2, 0.1]), ("r", "e", "s", None, None)]
    res = spark.createDataFrame(rows, "run_id string, query_id string, strategy_name string, ranked_entity_ids array<string>, ranked_scores array<double>")
    cases = spark.createDataFrame([("q", "b"), ("m", "zz"), ("e", "a")], "query_id string, target_entity_id string")
    got = {r["query_id"]: (r["target_rank"], r["target_score"]) for r in retrieval.target_ranks(res, cases).collect()}
    assert got == {"q": (1, 0.9), "m": (4, 0.0)}


def test_metrics(spark):
    x = spark.createDataFrame([(1,), (3,), (11,)], "target_rank long").withColumn("g", F.lit(1))
    m = retrieval.ir_metrics(x, ["g"]).first()
    assert m["ndcg_10"] == pytest.approx(0.5) and m["recall_5"] == pytest.approx(2 / 3)
    lost = {r["k"]: (r["lost"], r["gained"]) for r in retrieval.lost_at_k(spark.createDataFrame([(1, 6), (7, 2), (1, 1)], "baseline_rank long, selective_rank long"), []).collect()}
    assert lost == {1: (1, 0), 5: (1, 1), 10: (0, 0)}
    f = retrieval.pareto(spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.1, 0.5), ("c", 0.2, 0.5), ("d", 0.3, 0.9)], "s string, c double, q double"), "c", "q")
    assert {r["s"] for r in f.where("on_frontier").collect()} == {"a", "b", "d"}
    c = retrieval.coverage(spark.createDataFrame([(1, False, True)], "g int, needs boolean, done boolean"), ["g"]).first()
    assert c["coverage"] == 1.0 and c["extra"] == 1
    s = retrieval.spearman(spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 3, 9), (2, 1, 1)], "g int, x int, y int"), ["g"], "x", "y")
    assert {r["g"]: round(r["spearman"], 6) for r in s.collect()} == {1: 0.866025, 2: 0.0}


def test_cosine(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 1.0]), (None, [1.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(retrieval.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, None, None, None, None]


def test_threshold(spark):
    rows = [(0.9, True), (0.8, False), (0.4, True), (0.1, False)]
    curve = retrieval.pr_curve(spark.createDataFrame(rows, "s double, y boolean"), "s", "y")
    assert retrieval.average_precision(curve).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert retrieval.best_threshold(curve, 1.0).first()[0] == 0.4 and retrieval.best_threshold(curve, 0.5).first()[0] == 0.5


def test_series(spark):
    x = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in series.robust_scale(x, ["a", "b"]).orderBy("a").collect()] == [(pytest.approx(1 / 3), 0.0), (0.5, 0.0), (pytest.approx(2 / 3), 0.0)]
    w = {r[0]: r[1] for r in series.entropy_weights(x, ["a", "b"]).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["a"] > w["b"]
    assert series.histogram_entropy(x.withColumn("g", F.lit(1)), ["g"], "b").first()["entropy"] == 0.0
