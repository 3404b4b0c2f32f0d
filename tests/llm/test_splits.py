import random

import numpy as np

from revsift.llm.splits import anneal, grouped_splits

ROWS = "row_id long, commit_before string, commit_after string, kind string, g string, n int"
SHARES = "split_name string, target_share double"


def run(spark, rows, shares=(("train", 0.8), ("validation", 0.1), ("test", 0.1)), label=None):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    return {r["row_id"]: (r["group_row_id"], r["split_name"]) for r in grouped_splits(df, spark.createDataFrame(list(shares), SHARES), label=label).collect()}


def test_groups_and_shares(spark):
    rng = random.Random(4)
    hashes = [f"{rng.getrandbits(160):040x}" for _ in range(900)]
    rows = []
    for i in range(3000):
        g = rng.randrange(300)
        a, b = rng.sample(hashes[3 * g : 3 * g + 3], 2)
        rows.append((i, rng.choice([a, a.upper(), f" {a[:9]}\n"]), rng.choice([b, f"\t{b[:8]}", "n/a", None]), "ab"[g % 2]))
    rows += [(5000 + i, hashes[0], hashes[i % 3], "a") for i in range(1500)]  # a third of all rows in one group
    rows += [(9000, None, "HEAD", None), (9001, "", "  ", "a"), rows[0], (None, hashes[1], hashes[5], "a")]
    got = run(spark, rows, label="kind")
    # the same by union and find
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a, b, _ in rows:
        if i is None:
            continue
        find(i)
        for v in (a, b):
            k = (v or "").strip().lower()[:8]
            if len(k) == 8 and set((v or "").strip()) != {"0"} and all(c in "0123456789abcdef" for c in k):
                root[find(i)] = find(k)
    ids = [r[0] for r in rows if r[0] is not None]
    least = {}
    for i in sorted(ids, reverse=True):
        least[find(i)] = i
    assert {i: g for i, (g, _) in got.items()} == {i: least[find(i)] for i in ids}
    assert all(got[i][1] == got[g][1] for i, (g, _) in got.items())
    n = {s: sum(v[1] == s for v in got.values()) / len(got) for s in ("train", "validation", "test")}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["test"] - 0.1) < 0.02


def test_edges(spark):
    assert run(spark, []) == {}
    rows = [(1, "a" * 40, "b" * 40, None), (2, "b" * 40, None, None)]
    assert run(spark, rows, ()) == {1: (1, None), 2: (1, None)} or run(spark, rows, ((None, 1.0),)) == {1: (1, None), 2: (1, None)}
    assert {v[1] for v in run(spark, rows, (("all", 2.0), ("none", -1.0), ("null", None))).values()} == {"all"}


def test_annealing_beats_its_start():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 40, (200, 1)).astype(float)
    share = np.array([0.8, 0.1, 0.1])
    start = rng.integers(0, 3, 200)
    off = lambda at: abs(np.bincount(at, sizes[:, 0], minlength=3) / sizes.sum() - share).sum()
    assert off(anneal(sizes, share, start, 0, 8000)) < 0.01 < off(start)


def test_null_ids_and_repeated_ids(spark):
    z, a, b, c, d = "0" * 40, "a" * 40, "b" * 40, "c" * 40, "d" * 40
    rows = [
        (1, a, z, None), (2, z, b, None), (3, "00000000", z, None), (4, " 0000000000\n", "A" * 8, None),
        (5, c, None, None), (5, d, None, None), (6, d[:9], None, None), (7, None, c, None),  # the id 5 ties c and d
        (8, "0" * 39 + "1", None, None), (9, None, "00000000", None), (10, "0" * 41, "0" * 7, None),
    ]
    # by hand: 1 and 4 share a, 5 to 7 share c and d; zeros alone tie nothing
    assert {i: g for i, (g, _) in run(spark, rows).items()} == {1: 1, 4: 1, 2: 2, 3: 3, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10}


def test_many_splits_and_labels(spark):
    rows = [(i, f"{i + 1:08x}" + "7" * 32, None, f"kind {i % 50}") for i in range(2000)]
    got = run(spark, rows, tuple((f"s{i:04}", 1.0) for i in range(1200)))
    assert len({s for _, s in got.values()}) > 700  # 1,000 and more splits are used
    got = run(spark, rows, label="kind")
    rare = [i for i in range(2000) if i % 50 >= 30]  # equal counts are ordered by name, so these hold most of the rest
    assert abs(sum(got[i][1] == "train" for i in rare) / len(rare) - 0.8) < 0.05
