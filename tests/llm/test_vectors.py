import numpy as np

from revsift.llm import vectors
from revsift.llm.vectors import nearest

SCHEMA = "id long, vec array<float>, cell int, way int"


def brute(rows, k, least):
    got = {}
    x = {i: np.array(v, np.float64) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    for i, a in x.items():
        c = [(-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), j) for j, b in x.items() if j != i and len(a) == len(b)]
        got[i] = [j for s, j in sorted(c)[:k] if least is None or -s >= least]
    return got


def found(spark, rows, k=5, least=None, **kw):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    got = {}
    for r in nearest(df, "id", "vec", k, least, **kw).collect():
        got.setdefault(r["id"], []).append((-r["cosine"], r["neighbour_id"]))
    return {i: [j for _, j in sorted(v)] for i, v in got.items()}


def test_small(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16)).astype(np.float32)
    rows = [(i, (base[i % 40] + 0.1 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(160)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # more copies than neighbours
    rows += [(300 + i, [2 * v for v in rows[5][1]]) for i in range(3)] + [(3, rows[3][1])]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, [float("inf")] * 16)]
    want = brute(rows, 5, 0.85)
    assert found(spark, rows, least=0.85) == {i: v for i, v in want.items() if v}
    full = found(spark, rows)
    assert full[405] == [406] and np.mean([full.get(i, []) == v for i, v in brute(rows, 5, None).items()]) > 0.99


def test_recall_of_many_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 60)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((600, 32)).astype(np.float32)
    rows = [(i, (centre[i % 600] + 0.3 * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(3000)]
    want, got = brute(rows, 5, 0.85), found(spark, rows, least=0.85)
    assert sum(len(set(v) & set(got.get(i, []))) for i, v in want.items()) / sum(map(len, want.values())) >= 0.97


def test_empty(spark):
    assert found(spark, []) == {} and found(spark, [(1, [1.0, 2.0])]) == {}


def test_far_neighbours_of_many_lists(spark, monkeypatch, tmp_path):
    from revsift.llm.queries import p2_neighbours

    monkeypatch.setattr(vectors, "LIST_ROWS", 3)
    monkeypatch.setattr(vectors, "SAMPLE", 2000)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], "comparison_id long, candidate_raw_vector array<float>, baseline_raw_vector array<float>").write.parquet(f"{tmp_path}/embedding_comparisons.parquet")
    got = {}
    for r in p2_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r["id"], set()).add(r["neighbour_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(u @ u.T - 2 * np.eye(len(u))), axis=1)[:, :5]
    assert np.mean([len(got[i] & set(n.tolist())) / 5 for i, n in enumerate(near)]) >= 0.9
