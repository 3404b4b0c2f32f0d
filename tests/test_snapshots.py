import datetime as dt

from revsift.operators import snapshots
from revsift.operators.snapshots import snapshot_changes

T = [dt.datetime(2024, 1, d) for d in range(1, 9)]
ENTITIES = "commit_hash string, entity_id string, source_code string, ingested_at timestamp, h long, digest string"
COMMITS = "commit_hash string, repo string, seq long, side int"


def changes(spark, entities, commits):
    e = spark.createDataFrame([(*r, 1, "x") for r in entities], ENTITIES)  # h and digest: extra columns with clashing names
    c = spark.createDataFrame([(*r, 0) for r in commits], COMMITS)
    return {tuple(r) for r in snapshot_changes(e, c).collect()}


def test_kinds(spark):
    e = [
        ("a", "f::x", "one\r\ntwo  \n", T[0]), ("b", "f::x", "one\ntwo", T[0]),  # only line ends and trailing blanks
        ("a", "f::y", "old", T[0]), ("b", "f::y", "new", T[0]), ("b", "f::y", "old", T[1]),  # the latest row counts
        ("a", "f::z", "  in", T[0]), ("b", "f::z", "in", T[0]), ("a", "f::gone", None, T[0]), ("b", "f::new", "", T[0]),
        ("a", "f::null", None, T[0]), ("b", "f::null", None, T[0]), ("a", "f::text", None, T[0]), ("b", "f::text", "", T[0]),
        (None, "f::q", "x", T[0]), ("b", None, "x", T[0]), ("b", "f::z", "in", T[0]), ("lone", "f::x", "x", T[0]),
    ]
    c = [("a", "r", 1), ("none", "r", 2), ("b", "r", 3), ("b", "r", 3), ("lone", None, 4), (None, "r", 9)]
    assert changes(spark, e, c) == {("a", "b", "f::z", "changed"), ("a", "b", "f::gone", "removed"), ("a", "b", "f::new", "added"), ("a", "b", "f::text", "changed")}


def test_empty(spark):
    assert changes(spark, [], []) == set()
    assert changes(spark, [("a", "x", "1", T[0])], []) == set()


def test_against_brute_force_with_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "CHUNK_MOST", 3)
    e, want = [], set()
    for i in range(400):
        a, b = (None if i % 7 == 0 else "s"), (None if i % 11 == 0 else "s" if i % 5 else "t")
        if a:
            e.append(("a", f"k{i}", a, T[0]))
        if b:
            e.append(("b", f"k{i}", b, T[0]))
        if (a is None) != (b is None):
            want.add(("a", "b", f"k{i}", "added" if b else "removed"))
        elif a != b:
            want.add(("a", "b", f"k{i}", "changed"))
    assert changes(spark, e, [("a", "r", 1), ("b", "r", 2)]) == want


def test_very_long_text(spark):
    long = "x = 1\n" * 300_000
    e = [("a", "k", long, T[0]), ("b", "k", long + " \r\n", T[0]), ("a", "l", long, T[0]), ("b", "l", long + "y", T[0])]
    assert changes(spark, e, [("a", "r", 1), ("b", "r", 2)]) == {("a", "b", "l", "changed")}
