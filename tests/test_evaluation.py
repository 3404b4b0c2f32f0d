import random
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from revsift.functions.embed import vector
from revsift.operators import benchmark, features, queries, retrieval, series, staleness

CODE = "commit_hash string, entity_id string, entity_type string, file_path string, name string, lineno int, end_lineno int, source_code string, cyclomatic_complexity double, ast_node_count double, max_nesting_depth double, param_count double"


def code_rows(spark, commits):
    """{commit: {id: source}} as entities of one file."""
    rows = [(c, i, "function", i.split("::")[0], i.split("::")[-1], 1, 2, s, 1.0, 5.0, 0.0, 1.0) for c, e in commits.items() for i, s in e.items()]
    return spark.createDataFrame(rows, CODE)


def test_sign_test_of_large_groups():
    assert retrieval.upper_tail(100, 2000) == 1.0 and retrieval.upper_tail(500, 5000) == 1.0 and abs(retrieval.upper_tail(2600, 5000) - 0.0024418248687668787) < 1e-12
    assert retrieval.upper_tail(0, 5) == 1.0 and abs(retrieval.upper_tail(5, 5) - 0.03125) < 1e-14 and abs(retrieval.upper_tail(2, 3) - 0.5) < 1e-14


def test_quantiles_and_curves(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([0.1, 0.5, rng.random()]), rng.random() < 0.4) for _ in range(500)] + [("a", None, True), ("b", float("nan"), True)]
    df = spark.createDataFrame(rows, "g string, x double, y boolean")
    got = {r["g"]: (r["p"], r["q"]) for r in series.quantiles(df, ["g"], "x", {"p": 0.25, "q": 0.95}).collect()}
    of = lambda g: [x for k, x, _ in rows if k == g and x is not None and x == x]
    assert all(np.allclose(got[g], np.quantile(of(g), [0.25, 0.95])) for g in "ab")
    curve = retrieval.pr_curve(df, "x", "y").collect()
    scores = sorted({x for _, x, _ in rows if x is not None and x == x}, reverse=True)
    assert [r["threshold"] for r in sorted(curve, key=lambda r: -r["threshold"])] == scores
    good = sum(y for _, x, y in rows if x is not None and x == x)
    want, was = 0.0, 0.0
    for t in scores:
        flagged = [y for _, x, y in rows if x is not None and x == x and x >= t]
        want += sum(flagged) / len(flagged) * (sum(flagged) / good - was)
        was = sum(flagged) / good
    assert abs(retrieval.average_precision(retrieval.pr_curve(df, "x", "y")).first()[0] - want) < 1e-9


def test_features_of_a_pair(spark):
    body = lambda *calls, extra="": "def f():\n    " + "; ".join([f"{c}()" for c in calls] or ["pass"]) + extra
    a = {"m.py::top": body("mid"), "m.py::mid": body("low"), "m.py::low": body(), "m.py::K": "class K: pass", "m.py::K::go": body(), "m.py::gone": body("low")}
    b = {"m.py::top": body("mid"), "m.py::mid": body("low", "new"), "m.py::low": body(extra="  # x"), "m.py::K": "class K: pass", "m.py::K::go": body(extra="; pass"), "m.py::new": body()}
    e = code_rows(spark, {"a": a, "b": b})
    edge = [("a", "top", "mid"), ("a", "mid", "low"), ("a", "gone", "low"), ("b", "top", "mid"), ("b", "mid", "low"), ("b", "mid", "new")]
    edges = spark.createDataFrame([(c, f"m.py::{x}", f"m.py::{y}") for c, x, y in edge], "commit_hash string, src string, dst string")
    pairs = spark.createDataFrame([("a", "b")], "commit_before string, commit_after string")
    modified = spark.createDataFrame([("a", "b", f"m.py::{x}") for x in ("mid", "new", "K::go")], "commit_before string, commit_after string, entity_id string")
    order = spark.createDataFrame([("a", "b", 1)], "commit_before string, commit_after string, seq long")
    diffs = spark.createDataFrame([("a", "b", "m.py", 3, 1)], "commit_before string, commit_after string, file_path string, added int, deleted int")
    got = {r["entity_id"].split("::", 1)[1]: r for r in features.pair_features(pairs, e, edges, modified, order, diffs).collect()}
    assert len(features.FEATURES) == 47 and set(got) == {"top", "mid", "low", "K", "K::go", "new"}
    pick = lambda f: {k: r[f] for k, r in got.items()}
    assert pick("out_degree") == {"top": 1, "mid": 2, "low": 0, "K": 0, "K::go": 0, "new": 0} and got["low"]["in_degree"] == 1
    assert pick("distance_to_modified_directed") == {"top": 1, "mid": 0, "low": 999, "K": 999, "K::go": 0, "new": 0}
    assert pick("distance_to_modified_undirected") == {"top": 1, "mid": 0, "low": 1, "K": 999, "K::go": 0, "new": 0} and got["low"]["data_flow_distance"] == 10
    assert got["top"]["modified_data_deps_count"] == 2 and got["mid"]["modified_data_deps_count"] == 1 and got["top"]["taint_reachability_score"] == 1 and got["low"]["taint_reachability_score"] == 0
    assert got["low"]["modified_dependents_count"] == 1 and got["top"]["modified_dependencies_count"] == 1 and got["mid"]["modified_dependencies_count"] == 0
    assert pick("modified_member_count")["K"] == 1 and pick("own_source_changed") == {"top": 0, "mid": 1, "low": 1, "K": 0, "K::go": 1, "new": 0}
    assert pick("gtd_change_class") == {"top": 0, "mid": 3, "low": 0, "K": 0, "K::go": 3, "new": 1} and got["mid"]["gtd_local_edges_added"] == 1 and got["low"]["gtd_local_edges_removed"] == 1
    # mid: the stub of low differs and that of new comes
    assert got["mid"]["context_stub_changed_count"] == 2 and got["top"]["context_stub_changed_count"] == 1 and got["top"]["entity_modification_size"] == 0 and got["mid"]["entity_modification_size"] == 4
    # by hand: 6 nodes each, one added and one removed of 7; 3 edges each, one added and one removed of 4
    r = got["top"]
    assert np.allclose([r["ne_node_added_ratio"], r["ne_node_deleted_ratio"], r["ne_node_survival_ratio"], r["ee_edge_churn"], r["ee_density_a"], r["se_component_delta"], r["se_node_growth_ratio"]], [1 / 7, 1 / 7, 5 / 7, 0.5, 0.1, 0, 0])
    # networks of 6 nodes: mid lies on top -> low and top -> new of 5 x 4 pairs; low is reached by 2 of 5 at 1 and 2 hops
    assert np.allclose([got["mid"]["betweenness"], got["low"]["closeness"], got["mid"]["closeness"]], [2 / 20, 2 / 3 * 2 / 5, 1 / 5])
    assert abs(sum(pick("pagerank").values()) - 1) < 1e-6 and got["K"]["pagerank_impact"] == 0 and got["new"]["pagerank_impact"] > 0


def test_stale_entities_of_two_commits(spark):
    v1, v2 = "def area(w):\n    return w * w", "def area(w):\n    return w ** 2"
    e = code_rows(spark, {"c1": {"g.py::area": v1, "g.py::use": "def use(): area(1)", "g.py::far": "def far(): use()"}, "c2": {"g.py::area": v2, "g.py::use": "def use(): area(1)", "g.py::far": "def far(): use()"}})
    edges = spark.createDataFrame([(c, x, y) for c in ("c1", "c2") for x, y in (("g.py::use", "g.py::area"), ("g.py::far", "g.py::use"))], "commit_hash string, src string, dst string")
    ids = lambda **k: [r[0] for r in staleness.StaleCache(e, edges, **k).stale_ids("c1", "c2").collect()]
    assert ids(strategy="changed_only") == ["g.py::area"] and ids(strategy="fixed_hop") == ["g.py::area", "g.py::use"] and len(ids(strategy="full_reindex")) == 3
    score = lambda near, changed: near.withColumn("score", F.when(F.col("entity_id") == "g.py::far", 0.9).otherwise(0.0))
    assert ids(strategy="predictive_ml", score=score) == ["g.py::area", "g.py::far"]
    s = staleness.StaleCache(e, edges, "fixed_hop").summary("c1", "c2").first()
    assert (s["from_commit"], s["to_commit"], s["total_entities"], s["stale_count"], round(s["reembed_ratio"], 6), s["strategy"]) == ("c1", "c2", 3, 2, 0.666667, "fixed_hop")
    assert staleness.StaleCache(e, edges, "changed_only").summary("c1", "c1").first()["stale_count"] == 0
    assert [r["source_code"] for r in staleness.StaleCache(e, edges, "changed_only").stale("c1", "c2").collect()] == [v2]
    with pytest.raises(ValueError):
        ids(strategy="predictive_ml")
    rows = {r["id"]: r["metadata"] for r in staleness.ingestion_rows(e.where("commit_hash = 'c1'"), edges).collect()}
    assert rows["g.py::use"]["callers"] == ["g.py::far"] and rows["g.py::use"]["callees"] == ["g.py::area"] and rows["g.py::area"]["callees"] == []


def test_a_sequence_changes_its_own_cache(spark):
    steps = spark.createDataFrame([("r", f"c{i}", f"c{i + 1}", i) for i in range(3)], "repo string, commit_before string, commit_after string, step int")
    forms = {"c0": {"a": "1", "b": "1"}, "c1": {"a": "2", "b": "1"}, "c2": {"a": "1", "b": "1", "n": "1"}, "c3": {"a": "1", "n": None}}
    digests = spark.createDataFrame([(c, i, v) for c, e in forms.items() for i, v in e.items()], "commit_hash string, entity_id string, digest string")
    edges = spark.createDataFrame([("c1", "b", "a"), ("c3", "a", "n")], "commit_hash string, src string, dst string")
    decided, state = staleness.sequence_fold(steps, digests, edges)
    assert {(r["step"], r["entity_id"]) for r in decided.collect()} == {(0, "a"), (1, "a"), (1, "n"), (2, "n")}
    assert {tuple(r)[1:] for r in state.collect()} == {("a", "c2", 2), ("b", "c0", 0), ("n", "c3", 2)}
    decided, _ = staleness.sequence_fold(steps, digests, edges, "fixed_hop")
    assert {(r["step"], r["entity_id"]) for r in decided.collect()} == {(0, "a"), (0, "b"), (1, "a"), (1, "n"), (2, "n"), (2, "a")}


def test_displaced_ranks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(benchmark, "INDEX_BLOCK", 7)
    monkeypatch.setattr(benchmark, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 8)))
    old, new, q = unit(30), unit(30), unit(40)
    old[:10] = new[:10]
    target = rng.integers(0, 30, 40)
    frame = lambda x, name: spark.createDataFrame([("p", f"{name}{i:02}", v.tolist()) for i, v in enumerate(x)], "part string, id string, vector array<double>")
    before, after = (frame(x, "e").withColumnRenamed("id", "entity_id") for x in (old, new))
    asked = spark.createDataFrame([("p", f"q{i:02}", f"e{t:02}", v.tolist()) for i, (t, v) in enumerate(zip(target, q))], "part string, query_id string, target_entity_id string, vector array<double>")
    got = {r["query_id"]: r for r in benchmark.leave_one_out(before, after, asked, "part", 5).collect()}
    for i, t in enumerate(target):
        s = new @ q[i]
        rank = lambda mine: 1 + sum(s[j] > mine for j in range(30) if j != t)
        fresh, stale = rank(s[t]), rank(old[t] @ q[i])
        gain = lambda r: 1 / log2(r + 1) if r <= 5 else 0.0
        r = got[f"q{i:02}"]
        assert (r["fresh_rank"], r["stale_rank"], r["displaced"]) == (fresh, stale, fresh <= 5 < stale) and abs(r["delta"] - gain(fresh) + gain(stale)) < 1e-9
    near = benchmark.top_k(asked, after, "part", 3).where("query_id = 'q07'").orderBy("position").collect()
    assert [r["entity_id"] for r in near] == [f"e{j:02}" for j in np.argsort(-(new @ q[7]))[:3]]
    labels = {r["entity_id"]: r for r in benchmark.displacement_labels(benchmark.leave_one_out(before, after, asked, "part", 5), after, "part", least=1, rule="any_displacement").collect()}
    assert len(labels) == 30 and all(labels[f"e{t:02}"]["is_covered"] for t in target) and not labels["e00"]["label"]


def test_query_sets(spark):
    e = code_rows(spark, {"c": {"m.py::go": "def go():\n    '''Runs every job twice over.'''\n    step()", "m.py::step": "def step(): pass", "m.py::caller": "def caller(): go()"}})
    edges = spark.createDataFrame([("c", "m.py::go", "m.py::step"), ("c", "m.py::caller", "m.py::go")], "commit_hash string, src string, dst string")
    rows = queries.synthetic_queries(e, edges, most=3).collect()
    made = {r["target_entity_id"]: [] for r in rows}
    for r in rows:
        made[r["target_entity_id"]].append(r["query_text"])
    # the docstring's own words are in the source, so only questions by callers and callees are clean
    assert sorted(made["m.py::go"]) == ["What does caller rely on for its core operation?", "Which function coordinates the execution of step?", "Which function is invoked by caller to process its logic?"]
    assert {r["category"] for r in rows if r["target_entity_id"] == "m.py::caller"} == {"changed_entity"}  # the first in order of ids
    cur = spark.createDataFrame([("1", "x", "m.py::go")], "query_id string, query_text string, target_entity_id string")
    syn = spark.createDataFrame([("2", "y", "m.py::go"), ("3", "z", "m.py::step")], "query_id string, query_text string, target_entity_id string")
    assert {r["query_id"] for r in queries.hybrid_queries(cur, syn).collect()} == {"1", "3"} and queries.hybrid_queries(cur, syn, False).count() == 3
    assert vector("Some words", 16) == vector("some, WORDS", 16) and vector(None, 4) is None and vector("", 4) == [0.0] * 4


def test_descriptors(spark):
    rows = [("r", f"c{i}", i, float(i), 2.0, float(i % 3)) for i in range(8)]
    m = spark.createDataFrame(rows, "repo string, commit_hash string, seq long, up double, flat double, wave double")
    d = series.state_descriptors(m, {"one": ["up", "flat"], "two": ["wave"]})
    got = {r["commit_hash"]: r for r in d.collect()}
    assert all(0 <= r["one"] <= 1 and 0 <= r["two"] <= 1 for r in got.values()) and got["c7"]["one"] > got["c0"]["one"]
    split = {r["commit_hash"]: r["part"] for r in series.stratified_split(d, ["one", "two"], clusters=2).collect()}
    assert set(split) == set(got) and {"train", "test"} == set(split.values())
    assert series.state_descriptors(m.limit(1), {"one": ["up", "flat"]}).first()["one"] == 0.0


def test_strategies_on_mixed_indexes(spark):
    rng = np.random.default_rng(8)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 6)))
    old, new, q = unit(25), unit(25), unit(9)
    frame = lambda x, key: spark.createDataFrame([(f"{i:02}", v.tolist()) for i, v in enumerate(x)], f"{key} string, vector array<double>")
    decided = [("all", f"{i:02}") for i in range(25)] + [("some", f"{i:02}") for i in range(12)]
    got = {r[0]: r for r in benchmark.evaluate_strategies(frame(old, "entity_id").where("entity_id <> '24'"), frame(new, "entity_id"), spark.createDataFrame(decided, "strategy_name string, entity_id string"), frame(q, "query_id")).collect()}
    r = got["all"]
    assert (r["entities_updated"], r["update_percentage"], r["recall_at_5"], r["mrr"], r["ndcg_at_10"], round(r["rank_correlation"], 9)) == (25, 100.0, 1.0, 1.0, 1.0, 1.0)
    mixed = np.vstack([new[:12], old[12:24], new[24:]])  # what was not cached is fresh
    recall, mrr, gain = [], [], []
    for v in q:
        best, mine = np.argsort(-(new @ v)), np.argsort(-(mixed @ v))
        recall.append(len(set(best[:5]) & set(mine[:5])) / 5)
        ranks = [i + 1 for i, e in enumerate(mine) if e in best[:10]]
        mrr.append(1 / ranks[0])
        gain.append(sum(1 / log2(k + 1) for k in ranks if k <= 10) / sum(1 / log2(k + 1) for k in range(1, 11)))
    r = got["some"]
    assert np.allclose([r["recall_at_5"], r["mrr"], r["ndcg_at_10"], r["update_percentage"]], [np.mean(recall), np.mean(mrr), np.mean(gain), 48.0])


def test_scores_against_each_anchor(spark):
    from revsift.plans.model import ingestion_pipeline, scores_by_anchor, train

    e = code_rows(spark, {"a": {"m.py::f": "def f(): pass", "m.py::g": "def g(): pass"}, "b": {"m.py::f": "def f(): f2()", "m.py::g": "def g(): pass"}, "c": {"m.py::f": "def f(): f2()", "m.py::g": "def g(): pass", "m.py::new": "def new(): pass"}})
    edges = spark.createDataFrame([], "commit_hash string, src string, dst string")
    order = spark.createDataFrame([("a", "c", 1), ("b", "c", 1)], "commit_before string, commit_after string, seq long")
    rows = spark.createDataFrame([(float(i % 2), bool(i % 2)) for i in range(20)], "is_modified double, y boolean")
    model = train(rows, ["is_modified"], "y")
    state = spark.createDataFrame([("m.py::f", "a"), ("m.py::g", "b")], "entity_id string, anchor_commit string")
    got = {r[0]: r[1] for r in scores_by_anchor(model, ["is_modified"], state, e, edges, order, "c").collect()}
    assert got["m.py::f"] > 0.5 > got["m.py::g"] > 0 and got["m.py::new"] == 0.0
    late = spark.createDataFrame([("m.py::f", "b"), ("m.py::g", "c")], "entity_id string, anchor_commit string")
    got = {r[0]: r[1] for r in scores_by_anchor(model, ["is_modified"], late, e, edges, order, "c").collect()}
    assert got["m.py::f"] < 0.5 and got["m.py::g"] == 0.0
    files = spark.createDataFrame([("c", "m.py", "def f():\n    g()\n\ndef g():\n    pass\n")], "commit_hash string, file_path string, content string")
    kept = ingestion_pipeline(files, None, [], spark.createDataFrame([("m.py::f",)], "entity_id string"), "c").collect()
    assert [(r["id"], r["metadata"]["callees"]) for r in kept] == [("m.py::f", ["m.py::g"])]
