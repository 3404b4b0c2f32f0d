from revsift.plans.reference import QUERIES


def tables(spark, path, edges, changed):
    """Tables of a commit graph: commits are numbers, written as hashes from 16 on, as zeros alone name no commit."""
    name = lambda i: f"{i + 16:08x}"
    spark.createDataFrame([(name(a), name(b)) for a, b in edges], "commit_before string, commit_after string").write.parquet(f"{path}/dataset_rows.parquet")
    spark.createDataFrame([(name(c), "modified", 0.5) for c in changed], "commit_after string, status string, semantic_drift double").write.parquet(f"{path}/embedding_comparisons.parquet")
    return str(path)


def result(spark, d, name):
    return {int(r[0], 16) - 16: r[1] for r in QUERIES[name](spark, d).collect()}


def test_far_commits_have_a_distance(spark, tmp_path):
    d = tables(spark, tmp_path, [(i, i + 1) for i in range(12)] + [(50, 51)], [0])
    assert result(spark, d, "nearest_changed_undirected") == {i: i for i in range(13)}


def ranks(edges, seeds, rounds=1000):
    """Power iteration up to its fixed point."""
    nodes = sorted({x for e in edges for x in e})
    p = {v: (v in seeds) / len(seeds) if seeds else 1 / len(nodes) for v in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        out = {v: [b for a, b in edges if a == v] for v in nodes}
        lost = sum(rank[v] for v in nodes if not out[v])
        new = {v: (0.15 + 0.85 * lost) * p[v] for v in nodes}
        for v in nodes:
            for w in out[v]:
                new[w] += 0.85 * rank[v] / len(out[v])
        rank = new
    return rank


def test_ranks_reach_the_tolerance(spark, tmp_path):
    # 0 and 1 keep each other's rank, so six rounds are far from the end
    edges = [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0)]
    d = tables(spark, tmp_path, edges, [0])
    for name, seeds in (("pagerank", []), ("personalised_rank", [0])):
        want, got = ranks(edges, seeds), result(spark, d, name)
        assert sum(abs(got[v] - want[v]) for v in want) < 4e-5
        assert sum(abs(ranks(edges, seeds, 6)[v] - want[v]) for v in want) > 1e-3


def test_strategy_chooses_by_final_ranks(spark, tmp_path, monkeypatch):
    from revsift.operators import strategies

    asked = []
    pagerank = strategies.pagerank
    monkeypatch.setattr(strategies, "pagerank", lambda *a, **k: asked.append(pagerank(*a, **k)) or asked[-1])
    edges = [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0)]
    QUERIES["strategy_pagerank"](spark, tables(spark, tmp_path, edges, [0])).collect()
    want = ranks(edges, [0])
    assert sum(abs(r["rank"] - want[int(r["node"], 16) - 16]) for r in asked[0].collect()) < 4e-5


def test_zeros_name_no_commit(spark, tmp_path):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    rows = [(a, b), ("0" * 40, a), (b, "00000000"), ("0" * 40, c), (f" {c[:9].upper()}", a)]
    spark.createDataFrame(rows, "commit_before string, commit_after string").write.parquet(f"{tmp_path}/dataset_rows.parquet")
    spark.createDataFrame([], "commit_after string, status string, semantic_drift double").write.parquet(f"{tmp_path}/embedding_comparisons.parquet")
    assert {tuple(r) for r in QUERIES["degree_features"](spark, str(tmp_path)).collect()} == {("aaaaaaaa", 1, 1), ("bbbbbbbb", 0, 1), ("cccccccc", 1, 0)}
