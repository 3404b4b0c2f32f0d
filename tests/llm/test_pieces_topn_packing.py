import math
import random

import numpy as np
import pytest

from revsift.llm.packing import best_two_fit, pack, packed_documents
from revsift.llm.pieces import split_oversized
from revsift.llm.topn import top_n, top_ranked


def pieces(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, t string, piece int")
    got = {}
    for r in sorted(split_oversized(df, ["id"], "t", **kw).collect(), key=lambda r: (r["id"], r["piece_no"])):
        got.setdefault(r["id"], []).append(r["piece"])
    return got


def test_pieces(spark):
    rng = random.Random(1)
    lines = "".join("    " * rng.randrange(3) + "x" * rng.randrange(120) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(400))
    texts = ["short", None, "", "a" * 2000, "a" * 2001, lines, "🧭é" * 3000, "word " * 2000, "ab\n" + "c" * 5000, "x; " + "y" * 4000, "\n" * 3000, "def f():\n    pass\n\n\n" * 400, "z" * 1_000_000]
    got = pieces(spark, texts)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(t) > 2000}
    for i, p in got.items():
        assert max(map(len, p)) <= 2000
        whole = p[0]
        for x in p[1:]:
            k = min(200, len(whole))
            assert len(x) > k and whole.endswith(x[:k])
            whole += x[k:]
        assert whole == texts[i]
    assert all(p.endswith("\n") for p in got[5][:-1]) and all(p.endswith("\n") and not p[:-1].endswith(")") for p in got[11][:-1])
    assert got[8][0] == "ab\n" or got[8][0].startswith("ab\nc")
    assert all(p.endswith(" ") for p in got[7][:-1])
    small = pieces(spark, ["abcdefghij" * 5], limit=20, overlap=4)[0]
    assert "".join([small[0], *(p[4:] for p in small[1:])]) == "abcdefghij" * 5
    with pytest.raises(ValueError):
        pieces(spark, ["a"], limit=20, overlap=10)


def test_top_n(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(50)}", f"i{rng.randrange(400):03}", round(rng.random(), 1)) for _ in range(6000)]
    rows += [(None, "a", 0.5), (None, "b", 0.5), ("g1", None, 9.0), ("g1", "n", None), ("g1", "n", float("nan")), ("one", "x", 1.0), ("one", "x", 2.0)]
    best = {}
    for g, i, s in rows:
        if i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(s, best.get((g, i), -9))
    want = set()
    for g in {g for g, _ in best}:
        for p, (s, i) in enumerate(sorted((-s, i) for (h, i), s in best.items() if h == g)[:7]):
            want.add((g, i, -s, p + 1))
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, i string, s double, position int")
    assert {tuple(r) for r in top_n(df, ["g"], "i", "s", 7).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # groups over many batches
    try:
        assert {tuple(r) for r in top_n(df, ["g"], "i", "s", 7).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert top_n(df.limit(0), ["g"], "i", "s", 7).count() == 0


def test_rankings(spark):
    rows = [("r", "q", ["b", "a", "a", None], [0.5, 0.5, 0.9, 3.0]), ("r", "q", ["c", "d"], [0.7]), ("r", "e", [], []), ("r", "n", None, [1.0]), ("r", "long", [f"k{i % 300}" for i in range(600)], [float(i) for i in range(600)])]
    df = spark.createDataFrame(rows, "run_id string, query_id string, ranked_entity_ids array<string>, ranked_scores array<double>")
    got = {}
    for r in top_ranked(df, 2).orderBy("position").collect():
        got.setdefault(r["query_id"], []).append((r["entity_id"], r["score"]))
    assert got == {"q": [("a", 0.9), ("c", 0.7)], "long": [("k299", 599.0), ("k298", 598.0)]}


def test_best_two_fit():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 101, 3000), rng.integers(30, 70, 1000), np.full(7, 100), np.array([60, 50, 50, 40]), np.zeros(0, int)):
        at = best_two_fit(sizes, 100)
        if len(sizes):
            assert np.bincount(at, weights=sizes).max() <= 100 and set(at) == set(range(at.max() + 1))
    assert best_two_fit(np.array([60, 50, 50, 40]), 100).max() == 1
    small = rng.integers(1, 40, 4000)
    assert best_two_fit(small, 100).max() + 1 <= math.ceil(small.sum() / 100) + 1


def test_pack(spark):
    rows = [(1, 100), (2, 250), (3, 50), (4, 50), (5, 0), (6, None), (None, 10), (1, 100)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n int"), 100).collect()
    fill, parts = {}, {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part_no"], r["start_token"], r["n_tokens"]))
    assert max(fill.values()) <= 100 and sorted(parts[2]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)] and len(parts[1]) == 2 and set(parts) == {1, 2, 3, 4, None}
    docs = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (4, "a b " * 4000, 5)], "doc_id long, text string, n int")
    out = packed_documents(docs).collect()
    assert {r["doc_id"] for r in out} == {1, 4} and sum(r["n_tokens"] for r in out if r["doc_id"] == 1) == 2
