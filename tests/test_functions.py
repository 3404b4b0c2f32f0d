import datetime as dt
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from revsift.functions import code, text
from revsift.sources import git, settings
from revsift.streaming.anchors import anchor_stream, anchors


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_text(spark):
    t = F.col("t")
    assert one(spark, " A  b\n", text.collapse(t), text.lower_collapse(t)) == ("A b", "a b")
    assert one(spark, "parseHTTPRequest_v2", text.split_identifier(t))[0] == ["parse", "http", "request", "v2"]
    assert one(spark, "One two, three FOUR five", text.ngrams(t))[0] == ["one two three four", "two three four five"]
    assert one(spark, "a b", text.ngrams(t))[0] == [] and one(spark, None, text.ngrams(t))[0] == []
    lit = F.lit
    assert one(spark, "src/loader.py::Cache::load_item", text.forbidden_terms(t, lit("src/loader.py")))[0] == ["cache", "item", "load", "load_item", "loader", "loader.py"]
    assert one(spark, "__::go", text.forbidden_terms(t, lit(None).cast("string")))[0] == ["go"]
    leaks = lambda q: one(spark, q, text.leaked_terms(t, lit("a/io.py::Cache::load_item"), lit("a/io.py")))[0]
    assert leaks("Which one loads an ITEM of the cache?") == ["cache", "item"] and leaks("reload load") == ["load"] and leaks("see xa/io.pyc") == ["a/io.py"] and leaks("in a/io.py") == ["a/io.py", "io.py"]
    v = lambda q: one(spark, q, text.violations(t, lit("f.py::go"), lit("f.py"), lit("it takes the next one now")))[0]
    assert v("What takes the next one?") == ["verbatim:takes the next one"] and v("go on") == ["identifier:go"] and v("fine") == []
    assert one(spark, 'def f():\n    """ Reads a thing.\n  More."""\n', text.docstring_summary(t))[0] == "Reads a thing." and one(spark, '"""abc"""', text.docstring_summary(t))[0] is None
    assert one(spark, "x = '#'  # c\n" + '"""d"""y', text.cleaned(t))[0] == "x = '#'  \ny"


SOURCE = '''import os.path as p
from a.b import c

class K(Base):
    def m(self, x, *y):
        """Doc."""
        if x and y or 1:
            return self.n()
        elif y:
            for i in y:
                return helper(i)

    def n(self):
        return 1

def helper(i):
    def inner():
        pass
    return i
'''


def test_code(spark):
    files = spark.createDataFrame([("c", "f.py", SOURCE), ("c", "bad.py", "def ("), ("c", "null.py", None)], "commit_hash string, file_path string, content string")
    e = {r["entity_id"]: r for r in code.parse_entities(files).collect()}
    assert set(e) == {"f.py::K", "f.py::K::m", "f.py::K::n", "f.py::helper"}
    m = e["f.py::K::m"]
    assert (m["entity_type"], m["lineno"], m["end_lineno"], m["cyclomatic_complexity"], m["param_count"], m["return_count"], m["max_nesting_depth"]) == ("method", 5, 11, 6.0, 2.0, 2.0, 2.0)
    assert {(r["alias"], r["target"]) for r in code.imports(files).collect()} == {("p", "import:os.path"), ("c", "import:a.b.c")}
    assert {(r["src"], r["dst"]) for r in code.call_edges(code.parse_entities(files)).collect()} == {("f.py::K::m", "f.py::K::n"), ("f.py::K::m", "f.py::helper")}
    assert code.normalised("def f(a):\n  # x\n  b = a\n  return b") == code.normalised("def f(z):\n    q = z\n    return q")
    assert code.normalised("def f(a): return a") != code.normalised("def f(a): return 2")
    # annotations keep their names, layout and brackets count for nothing
    assert code.normalised("def f(a: b):\n  b = (a)\n  return b") == code.normalised("def f(x: b):\n    y = x\n    return y") != code.normalised("def f(x: y):\n    y = x\n    return y")
    assert code.normalised("f(; // x\n/* y */ 2 # z") == "f(; 2" and code.normalised("import a\na.b()") != code.normalised("import c\nc.b()")
    assert one(spark, "@dec\ndef f(a,\n      b):  # c\n    pass", code.signature(F.col("t")))[0] == "def f(a,\n      b):"


CALLS = {
    "pkg/a.py": "from pkg.b import helper\nfrom lib import tool as t\n\ndef main():\n    helper()\n    t()\n    lonely()\n    twice()\n    near()\n\ndef near():\n    main()\n",
    "pkg/b.py": "def helper():\n    return twice()\n\nclass K:\n    def run(self):\n        self.step()\n    def step(self):\n        pass\n",
    "other/c.py": "def helper():\n    pass\n\ndef lonely():\n    pass\n\ndef twice():\n    pass\n",
    "pkg/d.py": "def twice():\n    pass\n\ndef step():\n    pass\n",
    "src/lib.py": "def tool():\n    pass\n",
}


def test_calls_by_priority(spark):
    files = spark.createDataFrame([("c", p, s) for p, s in CALLS.items()], "commit_hash string, file_path string, content string")
    e = code.parse_entities(files)
    got = {(r["src"], r["dst"]) for r in code.call_edges(e, code.imports(files)).collect()}
    main = "pkg/a.py::main"
    assert got == {
        (main, "pkg/b.py::helper"), (main, "src/lib.py::tool"), (main, "other/c.py::lonely"), (main, "pkg/d.py::twice"), (main, "pkg/a.py::near"), ("pkg/a.py::near", main),
        ("pkg/b.py::helper", "pkg/d.py::twice"), ("pkg/b.py::K::run", "pkg/b.py::K::step"),
    }
    # without imports helper is unique in the directory only, and the alias t is no name
    assert {(r["src"], r["dst"]) for r in code.call_edges(e).collect()} == got - {(main, "src/lib.py::tool")}


def test_anchors_as_table_and_stream(spark, tmp_path):
    rows = [("s", "e", 1, "c1", False), ("s", "e", 2, "c2", True), ("s", "e", 3, "c3", False), ("s", "f", 2, "c2", False), ("s", "e", 4, "c4", True)]
    schema = "strategy string, entity_id string, at long, commit string, done boolean"
    df = spark.createDataFrame(rows, schema)
    want = {("s", "e", "c4", 2), ("s", "f", "c2", 0)}
    assert {tuple(r) for r in anchors(df, ["strategy", "entity_id"], "at", "commit", "done").collect()} == want
    for part in (rows[3:], rows[:3]):  # late events too
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = anchor_stream(stream).writeStream.outputMode("update").format("memory").queryName("anchored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.sql("select * from anchored").collect():
        k = (r["strategy"], r["entity_id"])
        last[k] = max(last.get(k, (0, "")), (r["update_count"], r["anchor_commit"]))
    assert {(*k, a, n) for k, (n, a) in last.items()} == want


def test_git_source(spark, tmp_path):
    def run(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)

    run("init", "-q")
    for i, n in enumerate((2, 3)):
        (tmp_path / "sizes.py").write_text(f"def area(w):\n    return w ** {n}\n")
        run("add", ".")
        run("commit", "-qm", f"c{i}")
    git.register(spark)
    read = lambda t: spark.read.format("git").option("path", str(tmp_path)).option("table", t).load()
    commits = read("commits").orderBy("seq").collect()
    assert [r["message"] for r in commits] == ["c0", "c1"]
    files = read("files")
    assert files.count() == 2 and {r["entity_id"] for r in code.parse_entities(files).collect()} == {"sizes.py::area"}
    assert tuple(read("file_diffs").first()) == (commits[0]["commit_hash"], commits[1]["commit_hash"], "sizes.py", 1, 1)


def test_settings(spark, tmp_path):
    with pytest.warns(UserWarning):
        got = settings.read_settings('{"a": 1, /* "b" */ "b": "http://x", // end\n "zz": 3}', {"a": 0, "b": "", "c": 5}, {"c": 6})
    assert got == {"a": 1, "b": "http://x", "c": 6}
    assert settings.number_list("5, 1,5") == [1, 5] and settings.name_list("") == ["changed_only"] and settings.name_list("b,a,b") == ["b", "a"]
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "1", "query_text": " a  b ", "target_entity_id": "f::g", "misspelt": 1}]))
    r = settings.read_queries(spark, str(tmp_path / "q.json")).first()
    assert (r["query_text"], r["category"], r["target_entity_name"], r["entity_type"]) == ("a b", "curated", "f::g", "unknown")
    settings.write_results(spark.createDataFrame([(1, dt.date(2024, 1, 1))], "a int, d date"), str(tmp_path / "out"))
    assert settings.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double")) == "| a | b |\n| --- | --- |\n| 1 | 0.5000 |"


def test_model(spark):
    from revsift.plans.model import scored, train

    rows = spark.createDataFrame([(float(i), float(i % 3), i > 50) for i in range(100)], "x double, z double, y boolean")
    m = train(rows, ["x", "z", "retired"], "y")  # a feature that is not there counts as 0
    s = scored(m, rows, ["x", "z", "retired"]).collect()
    assert min(r["score"] for r in s if r["y"]) > 0.5 > max(r["score"] for r in s if not r["y"])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
