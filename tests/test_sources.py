import json
import subprocess
import warnings

import pytest

from revsift.operators import graph, strategies
from revsift.sources import charts, git, results, settings
from revsift.streaming import anchors as a


def test_git_commands(tmp_path):
    def run(*x):
        subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=n", "-c", "user.email=e@x", *x], check=True, capture_output=True)

    (tmp_path / "r").mkdir()
    run("init", "-q")
    r = str(tmp_path / "r")
    seen = []
    for i in range(2):
        (tmp_path / "r" / "n.py").write_text(f"n = {i}\n")
        (tmp_path / "r" / "b.bin").write_bytes(bytes(range(256)) * (i + 1))
        run("add", ".")
        run("commit", "-qm", f"c{i}")
        seen.append(git.current_commit(r))
    assert git.changed_files(r, *seen) == ["b.bin", "n.py"] and sorted(git.diff_stats(r, *seen)) == [("b.bin", 0, 0), ("n.py", 1, 1)]
    assert git.diff_stats(r, seen[0], seen[0], "n.py") == [("n.py", 0, 0)] and git.file_at(r, seen[0], "n.py") == "n = 0\n" and git.file_at(r, seen[0], "no.py") is None
    git.clone(r, str(tmp_path / "copy"))
    git.clone(r, str(tmp_path / "copy"))
    git.checkout(str(tmp_path / "copy"), seen[0])
    assert git.current_commit(str(tmp_path / "copy")) == seen[0]


def test_run_settings(tmp_path):
    (tmp_path / "settings.json").write_text('{"repo_url": "u", "stride": 3, "top_k": [2]}')
    got = settings.run_settings(["--stride", "1", "--top-k", "5,1", "--no-contextual"], folder=str(tmp_path))
    assert (got["repo_url"], got["stride"], got["top_k"], got["contextual"], got["num_commits"]) == ("u", 1, [1, 5], False, 10)  # given, though equal to the default
    with pytest.raises(ValueError):
        settings.run_settings([], folder=str(tmp_path / "none"))
    (tmp_path / "bad.json").write_text('{"repo_url": "u", "sampling_mode": "manual"}')
    with pytest.raises(ValueError):
        settings.run_settings(["--config", str(tmp_path / "bad.json")])
    with pytest.raises(ValueError):
        settings.run_settings(["--strategies", "odd"], folder=str(tmp_path), known=("changed_only",))
    assert [w["offset"] for w in settings.windows(got | {"windows": 3, "stride": 2})] == [0, 20, 40]


def test_results_and_charts(spark, tmp_path):
    rows = spark.createDataFrame([("fixed_hop", 0.2, 0.9, 0.8, 1.0, 0.5), ("changed_only", 0.1, 0.7, 0.9, 1.0, 0.4)], "strategy_name string, candidate_update_fraction double, freshness_success_rate double, cache_preservation_success_rate double, relative_freshness_rate double, rank_agreement_rate double")
    losses = spark.createDataFrame([(s, k, 10, 1, 0, 0.1, 0.02, 0.4, 0.9) for s in ("fixed_hop", "changed_only") for k in (1, 5)], "strategy_name string, k int, baseline_hits int, lost int, gained int, loss_rate double, loss_low double, loss_high double, retention double")
    front = spark.createDataFrame([("fixed_hop", 0.2, 0.9, True), ("changed_only", 0.1, 0.7, True)], "strategy_name string, cost double, quality double, on_frontier boolean")
    full = spark.createDataFrame([(2, 0.2, 0.0, True)], "strategies long, update_spread double, strongest_loss double, saturated boolean")
    text = results.summary_report({"stride": 1}, rows, losses, full, front)
    assert "**Saturated**" in text and text.index("| changed_only") < text.index("| fixed_hop") and "changed_only, fixed_hop" in text
    d = results.output_dir(str(tmp_path), "run")
    results.persist_run(spark, d, {"stride": 1}, rows.select("strategy_name"), rows.select("strategy_name"), rows, rows, losses)
    assert json.loads(results.read_text(spark, f"{d}/benchmark_config.json")) == {"stride": 1} and spark.read.json(f"{d}/per_query_results").count() == 2
    assert set(json.loads(results.read_text(spark, f"{d}/summary_metrics.json"))) == {"fixed_hop", "changed_only"}
    calls = []
    make = lambda: calls.append(1) or rows
    assert results.cached(make, spark, str(tmp_path), {"a": 1, "b": 2}).count() == results.cached(make, spark, str(tmp_path), {"b": 2, "a": 1}).count() == 2 and len(calls) == 1
    made = charts.benchmark_charts(rows, losses, front)
    assert len(made) == 6 and all(v.startswith("<svg") and v.endswith("</svg>") for v in made.values()) and "fixed_hop" in made["radar"]
    assert charts.counts(rows, "candidate_update_fraction", "t").count("<rect") == 3 and charts.counts(rows.limit(0), "candidate_update_fraction", "t").startswith("<svg")


def test_missing_query_set(spark):
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert settings.hybrid_cases(spark, "/nowhere.json").count() == 0 and w


def test_strategies_by_name_and_anchors(spark):
    node = lambda *x: spark.createDataFrame([(v,) for v in x], "node string")
    nodes, changed = node(*"abcdefghij"), node("a")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "e"), ("e", "f")], "src string, dst string")
    scores = spark.createDataFrame([("d", 0.5), ("a", 0.0)], "node string, score double")
    got = {}
    for r in strategies.all_decisions(nodes, changed, edges, scores).collect():
        got.setdefault(r[0], set()).add(r[1])
    assert got["changed_only"] == {"a"} and got["full_reindex"] == set("abcdefghij") and got["predictive"] == {"d"} and got["fixed_hop_1"] == {"a", "b"} and got["fixed_hop_2"] == {"a", "b", "c"}
    assert got["pagerank"] == {"a", "e", "f"}  # three tenths of the nodes
    assert {r[0]: r[2] for r in strategies.maintenance_cost(strategies.all_decisions(nodes, changed, edges, scores), nodes).collect()}["fixed_hop_2"] == 30.0
    assert graph.distance(edges, "d", "f") == 5 and graph.distance(edges, "f", "a") is None
    parts = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "x", "y")], "part string, src string, dst string")
    assert [(r["diameter"], round(r["average_path"], 6)) for r in graph.path_lengths(parts, "part").collect()] == [(2, round(4 / 3, 6))]
    state = a.initial(spark.createDataFrame([("x",), ("y",)], "entity_id string"), ["s", "t"], "c0")
    done = spark.createDataFrame([("s", "x"), ("s", "new")], "strategy string, entity_id string")
    after = a.updated(state, done, "c1")
    assert {tuple(r) for r in after.where("strategy = 's'").collect()} == {("s", "x", "c1", 1), ("s", "y", "c0", 0), ("s", "new", "c1", 1)}
    forms = spark.createDataFrame([("c0", "x", "1"), ("c0", "y", "1"), ("c1", "x", "2"), ("c1", "y", "1"), ("c1", "new", "1")], "commit_hash string, entity_id string, digest string")
    assert {tuple(r) for r in a.stale(after, forms, "c1").collect()} == {("t", "x"), ("t", "new")}
    assert {tuple(r) for r in a.stats(after).collect()} == {("s", 3, 2, 2), ("t", 2, 1, 0)}
