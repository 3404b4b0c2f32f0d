import ast
import datetime as dt

import pytest

from revsift.llm.documentation import documentation, documented_functions, trivial

T = dt.datetime(2024, 1, 1)
SCHEMA = "commit_hash string, entity_id string, entity_type string, name string, source_code string, ingested_at timestamp, doc string, kind int"
REAL = "Return the oldest open order."


def table(spark, rows):
    full = [(c, i, t, i.split("::")[-1] if i else None, s, at, "clash", 1) for c, i, t, s, at in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.mark.parametrize(
    "source, doc",
    [
        ('def f(a="x: y", b=lambda q: q,  # not: yet\n  c={1: 2}) -> "a: b":\n    # note: "no"\n\n    r"""Doc \\d."""\n    x = 1', "Doc \\d."),
        ("@dec(\"a: b\")\n@other\nasync def f(): 'Doc'; return 1", "Doc"),
        ('def f():\n    ("one "\n     # c\n     "two")\n', "one two"),
        ('def f():\r\n\tu"""a\r\n\tb"""\r\n\tprint x', "a\n\tb"),
        ('def f():\n    "a" \\\n    "b"\n', "ab"),
        ('def f():\n    "a" "b"  # c\n    print 1', "ab"),
        ('def f():\n    f"""no"""\n', None),
        ('def f():\n    "a" f"{b}"\n', None),
        ('def f():\n    b"no"\n', None),
        ('def f():\n    "no".strip()\n', None),
        ('def f():\n    "no" % x\n', None),
        ('def f():\n    x = 1\n    "no"\n', None),
        ('def f():\n    # "no"\n    return', None),
        ('def f(): # "no"; return None', None),
        ('def f():\n    """open', None),
        ('def f():\n    def g():\n        """no"""\n', None),
        ("def f(", None),
        ("", None),
    ],
)
def test_first_statement(source, doc):
    assert documentation(source)[1] == doc


def test_same_as_the_parser():
    for q in ('"', "'", '"""', "'''"):
        s = f"def f(x=[1, (2)]):\n    {q}It is \\{q[0]} here, \\n done{q}\n    return x"
        assert documentation(s)[1] == ast.literal_eval(f"{q}It is \\{q[0]} here, \\n done{q}")


def test_trivial():
    assert trivial("", "f") and trivial("Load item cache.", "load_item_cache") and trivial("Load two items", "load") and trivial("To be documented.", "f") and trivial("TODO: write the docs", "f")
    assert not trivial("Load the items twice", "load") and not trivial("Nobody knows this function", "f")


def test_operator(spark):
    doc = f'(self):\n    """{REAL}"""'
    rows = [
        ("c", "a.py::f", "function", f'def f():\n    """{REAL}"""', T), ("c", "a.py::f", "function", f'def f():\n    """{REAL}"""', T),
        ("c", "a.py::g", None, f'def g():\n    "{REAL}"', T), ("c", "a.py::C", None, f'class C:\n    """{REAL}"""', T),
        ("c", "a.py::old", "function", f'def old():\n    "{REAL}"', T), ("c", "a.py::old", "function", "def old(): pass", T + dt.timedelta(1)),
        ("c", "a.py::none", "function", None, T), ("c", None, "function", "def f(): 'x y z'", T), (None, "a.py::f", "function", "def f(): 'x y z'", T),
        ("c", "b.py::Base", "class", "class Base(object):\n  pass", T), ("c", "b.py::Base::run", "method", "def run" + doc, T), ("c", "b.py::Base::stop", "method", "def stop(self): pass", T),
        ("c", "a.py::Mid", "class", "class Mid(mod.Base, Generic[T], metaclass=M): pass", T), ("c", "a.py::Leaf", "class", "class Leaf(Mid): pass", T),
        ("c", "a.py::Leaf::run", "method", "def run(self):\n    '''{@inheritDoc}'''", T), ("c", "a.py::Leaf::stop", "method", "def stop(self): pass", T),
        ("c", "a.py::X", "class", "class X(Y): pass", T), ("c", "a.py::Y", "class", "class Y(X): pass", T), ("c", "a.py::X::m", "method", "def m(self): pass", T),  # a cycle
        ("d", "a.py::Leaf::run", "method", "def run(self): pass", T),
        ("c", "a.py::long", "function", "def long():\n    '''" + "Many words. " * 50_000 + "'''", T),
    ]
    got = {(r["commit_hash"], r["entity_id"]): r for r in documented_functions(table(spark, rows)).collect()}
    assert set(got) == {("c", i) for i in ("a.py::f", "a.py::g", "b.py::Base::run", "a.py::Leaf::run", "a.py::long")}
    leaf = got["c", "a.py::Leaf::run"]
    assert (leaf["origin"], leaf["inherited_from"], leaf["description"]) == ("inherited", "b.py::Base::run", REAL)
    assert got["c", "a.py::f"]["origin"] == "own" and got["c", "a.py::f"]["source_code"].startswith("def f") and got["c", "a.py::f"]["name"] == "f"
    assert documented_functions(table(spark, [])).count() == 0


def test_references_diamonds_and_common_names(spark):
    rows = [("c", "a.py::Top", "class", "class Top: pass", T), ("c", "a.py::Top::run", "method", f'def run(self):\n    "{REAL}"', T)]
    names = ["Top"]
    for i in range(12):  # a diamond on each level: 4,096 ways up
        low = [f"L{i}", f"R{i}"]
        rows += [("c", f"a.py::{n}", "class", f"class {n}({', '.join(names)}): pass", T) for n in low]
        names = low
    rows += [("c", "a.py::Leaf", "class", f"class Leaf({', '.join(names)}): pass", T), ("c", "a.py::Leaf::run", "method", "def run(self):\n    'See the base class.'", T)]
    rows += [("c", "a.py::Lone::run", "method", "def run(self):\n    'See the base class.'", T)]
    rows += [("c", f"m{i}.py::Meta", "class", "class Meta(Meta): pass", T) for i in range(40)] + [("c", f"m{i}.py::Meta::go", "method", "def go(self): pass", T) for i in range(40)]
    got = {r["entity_id"]: r for r in documented_functions(table(spark, rows)).collect()}
    assert set(got) == {"a.py::Top::run", "a.py::Leaf::run", "a.py::Lone::run"}
    assert (got["a.py::Leaf::run"]["description"], got["a.py::Leaf::run"]["own"]) == (REAL, True)  # inherited, and own by its three words
    assert (got["a.py::Lone::run"]["description"], got["a.py::Lone::run"]["origin"]) == ("See the base class.", "own")
