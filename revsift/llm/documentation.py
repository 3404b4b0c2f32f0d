"""Functions paired with their documentation, own or inherited."""

from __future__ import annotations

import ast
import inspect
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.common import cut
from revsift.operators.snapshots import current_rows

_STRING = r"""(?:\"{3}(?:[^"\\]++|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]++|\\.|'(?!''))*+'{3}|"(?:[^"\\\r\n]++|\\(?:\r\n|.))*+"|'(?:[^'\\\r\n]++|\\(?:\r\n|.))*+')"""
#: What a header is made of: strings, comments, brackets, colons, anything else.
_TOKEN = re.compile(r"(?s)(?P<s>" + _STRING + r")|(?P<c>\#[^\r\n]*+)|(?P<o>[(\[{])|(?P<x>[)\]}])|(?P<e>:)|[^\"'\#(\[{)\]}:]++|.")
_LITERAL = re.compile(r"(?s)([A-Za-z]{0,2})(" + _STRING + ")")
_GAP = re.compile(r"(?:[^\S\r\n]++|\\\r?\n|(?P<n>\#[^\r\n]*+|\r\n?|\n))*+")
_HEAD = re.compile(r"(?P<k>(?:async[ \t]+)?def|class)\b[ \t]*(?P<name>\w*)")
_LINE = re.compile(r"[^\r\n]*+(?:\r\n?|\n|\Z)")
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"(?m)^[ \t]*(?:[:@\\](?P<a>param|parameter|arg|type|returns?|rtype|raises?|throws|yields?|see|since|deprecated|note)\b|(?P<b>Args|Arguments|Parameters|Returns|Raises|Yields|Examples?|Notes?):[ \t]*$)")
_INHERITS = re.compile(r"(?i)\{?@inherit_?doc\}?|^\W*(?:see (?:the )?(?:base|super|parent)\s?class|inherited\b[\w ]{0,40})\W*$")

#: Words of a text that only says that documentation is missing or still to be written, and those of which it has one.
PLACEHOLDER = frozenset(
    "a add added an and available be been coming comment comments describe described description doc docs docstring docstrings document documentation documented fill fixme for function has have here i in is it later me"
    " method missing n need needed needs no none not now of pending placeholder please provide provided should some something soon still tba tbd text the there this to todo undocumented update wip will write written xxx yet".split()
)
TELLING = frozenset("comment comments describe described description doc docs docstring docstrings document documentation documented fixme placeholder tba tbd todo undocumented wip xxx".split())

SCHEMA = "kind string, documented boolean, inherits boolean, doc string, bases array<string>"


def _code_start(s: str) -> int:
    """Where the definition begins, after decorators, comments and blank lines."""
    at = 0
    while True:
        at = _GAP.match(s, at).end()
        if at < len(s) and s[at] == "@":
            depth = 0
            for m in _TOKEN.finditer(s, at):
                if m["o"]:
                    depth += 1
                elif m["x"]:
                    depth -= 1
                elif not depth and not m["s"] and not m["c"] and (cut_ := re.search(r"[\r\n]", m[0])):
                    at = m.start() + cut_.start()
                    break
            else:
                return len(s)
        else:
            return at


def _header(s: str) -> tuple[str | None, int, list[str]]:
    """(kind, where the body begins or -1, base classes) of a definition's source."""
    m = _HEAD.match(s, _code_start(s))
    if not m:
        return None, -1, []
    depth, first = 0, None
    for t in _TOKEN.finditer(s, m.end()):
        if t["o"]:
            first = t.end() if first is None else first
            depth += 1
        elif t["x"]:
            depth -= 1
            if depth < 0:
                break
        elif t["e"] and not depth:
            if m["k"] != "class":
                return "function", t.end(), []
            inside = s[first : t.start()].rstrip() if first else ""
            bases = [b for x in re.split(r",", re.sub(r"\[[^\]]*\]|\#[^\r\n]*", "", inside.rstrip(") \t\r\n"))) if "=" not in x and (b := x.strip().split(".")[-1]).isidentifier()]
            return "class", t.end(), bases
    return ("class" if m["k"] == "class" else "function"), -1, []


def documentation(s: str) -> tuple[str | None, str | None, list[str]]:
    """(kind, documentation string or None, base classes) of a definition's source, whether or not the rest parses.

    The documentation is the string literal (also joined or in brackets, not a bytes or formatted one) that is the first
    statement of the body.
    """
    kind, at, bases = _header(s)
    if at < 0:
        return kind, None, bases
    gap = _GAP.match(s, at)
    at, depth, parts = gap.end(), 0, []
    if gap["n"] is not None:
        line = max(s.rfind("\n", 0, at), s.rfind("\r", 0, at)) + 1
        if line == at:  # no deeper than the definition: no body
            return kind, None, bases
    while at < len(s) and s[at] == "(":
        depth += 1
        at = _GAP.match(s, at + 1).end()
    while m := _LITERAL.match(s, at):
        if m[1].lower() not in ("", "r", "u"):
            return kind, None, bases
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                parts.append(ast.literal_eval(m[0]))
        except (ValueError, SyntaxError):
            parts.append(re.sub(r"^(?:'''|\"\"\"|.)|(?:'''|\"\"\"|.)$", "", m[2]))
        gap = _GAP.match(s, m.end())
        at = gap.end()
        if not depth and gap["n"] is not None:
            return kind, "".join(parts), bases
    if not parts:
        return kind, None, bases
    while depth and at < len(s) and s[at] == ")":
        depth -= 1
        gap = _GAP.match(s, at + 1)
        at = gap.end()
    ended = not depth and (at >= len(s) or s[at] == ";" or gap["n"] is not None)
    return kind, "".join(parts) if ended else None, bases


def trivial(doc: str, name: str) -> bool:
    """Fewer than three words beside those of the function's name, or only words that say documentation is missing."""
    own = set(_WORD.findall(name.lower()))
    rest = [w for w in _WORD.findall(doc.lower()) if w not in own]
    return len(rest) < 3 or (PLACEHOLDER.issuperset(rest) and not TELLING.isdisjoint(rest))


def _parse(source: pd.Series, entity_id: pd.Series, entity_type: pd.Series) -> pd.DataFrame:
    out = []
    for s, i, t in zip(source, entity_id, entity_type):
        if not isinstance(s, str):
            out.append((None, False, False, None, None))
            continue
        kind, doc, bases = documentation(s)
        if isinstance(t, str) and t:
            kind = "class" if t.lower() == "class" else "function" if t.lower() in ("function", "method") else None
        if kind == "class":
            out.append((kind, False, False, None, bases))
        else:
            # a reference to the parent's documentation is none of one's own unless it says more than that
            good = kind == "function" and doc is not None and not trivial(doc, i.rpartition("::")[2])
            inherits = doc is not None and bool(_INHERITS.search(doc)) and (not good or trivial(_INHERITS.sub("", doc), i.rpartition("::")[2]))
            out.append((kind, good, inherits, inspect.cleandoc(doc) if good else None, None))
    return pd.DataFrame(out, columns=["kind", "documented", "inherits", "doc", "bases"])


def _tags(doc: pd.Series) -> pd.Series:
    return doc.map(lambda d: list(dict.fromkeys((m["a"] or m["b"]).lower() for m in _TAG.finditer(d))) if isinstance(d, str) else None)


def documented_functions(entities: DataFrame, with_source: bool = True) -> DataFrame:
    """Current functions and methods with a real documentation string, own or inherited.

    (commit_hash, entity_id, description, summary, tags, origin, inherited_from, own) and with_source name and source_code.
    origin is own, or inherited where a method has none (or a mere reference to its parent's) and the nearest class up its
    hierarchy in the same snapshot documents a method of that name: base classes are resolved by name, first within the
    file, and overridden methods are joined level by level until no method is left that still has a class above it.
    own: the function's own string is no trivial text. Such a one that is a reference and little else gives way to what it
    inherits, and stands where there is nothing to inherit. A base that is several classes of the snapshot is the smallest
    id other than the class itself (or else the greatest).
    What stays without documentation is dropped. Cyclic hierarchies end at the class where they close.

    Rows with a null commit, id or source are dropped; a null entity_type is judged by the source. Rows of one key with
    one latest time count once. Empty tables give no rows, and other columns are ignored.
    """
    parse = F.pandas_udf(_parse, SCHEMA)
    rows = entities.where("commit_hash is not null and entity_id is not null").select("commit_hash", "entity_id", "ingested_at", parse("source_code", "entity_id", "entity_type").alias("p"))
    fields = ["kind", "documented", "inherits", "doc", "bases"]
    rows = rows.select("commit_hash", "entity_id", "ingested_at", *[F.col(f"p.{f}").alias(f) for f in fields])
    rows = cut(current_rows(rows, ["commit_hash", "entity_id"], "ingested_at", fields), "documentation")

    owner = F.regexp_extract("entity_id", r"(?s)^(.*)::[^:]*\z", 1)
    last = F.regexp_extract("entity_id", r"([^:]*)\z", 1)
    file = F.regexp_extract("entity_id", r"(?s)^(.*?)::", 1)
    own = rows.where("kind = 'function' and documented").select("commit_hash", "entity_id", F.col("doc").alias("description"), F.lit("own").alias("origin"), F.lit(None).cast("string").alias("inherited_from"), F.lit(True).alias("own"))

    # one class for each base: of its file, else of the snapshot; each step is a join on a unique key, however common a name
    classes = rows.where("kind = 'class'").select("commit_hash", F.col("entity_id").alias("class_id"), last.alias("class_name"), file.alias("file"))
    wanted = rows.where("kind = 'class' and size(bases) > 0").select("commit_hash", F.col("entity_id").alias("at"), file.alias("file"), F.posexplode("bases").alias("pos", "class_name"))
    ends = lambda by, n: classes.groupBy("commit_hash", *by, "class_name").agg(F.min("class_id").alias(f"lo{n}"), F.max("class_id").alias(f"hi{n}"))
    other = lambda n: F.when(F.col(f"lo{n}") != F.col("at"), F.col(f"lo{n}")).when(F.col(f"hi{n}") != F.col("at"), F.col(f"hi{n}"))
    above = wanted.join(ends(["file"], 0), ["commit_hash", "file", "class_name"], "left").join(ends([], 1), ["commit_hash", "class_name"], "left")
    above = cut(above.select("commit_hash", "at", "pos", F.coalesce(other(0), other(1)).alias("above")).where("above is not null"), "hierarchy")
    found = own
    if not above.isEmpty():
        named = rows.where("kind = 'function' and documented and not inherits").select("commit_hash", owner.alias("above"), last.alias("method"), "doc", F.col("entity_id").alias("from_id"))
        left = rows.where("kind = 'function' and (inherits or not documented)").select("commit_hash", "entity_id", owner.alias("at"), last.alias("method")).where("at <> ''")
        left = left.join(above.select("commit_hash", "at").distinct(), ["commit_hash", "at"], "left_semi").withColumn("seen", F.array("at")).withColumn("way", F.array().cast("array<int>"))
        left, hits = cut(left, "unresolved"), None
        while not left.isEmpty():
            up = left.join(above, ["commit_hash", "at"]).where("not array_contains(seen, above)").withColumn("way", F.concat("way", F.array("pos"))).drop("at", "pos")
            # of the ways to one class only the first goes on, so a diamond doesn't double the rows at each level
            up = up.groupBy("commit_hash", "entity_id", "method", "above").agg(F.min(F.struct("way", "seen")).alias("w")).select("commit_hash", "entity_id", "method", "above", "w.way", "w.seen")
            up = cut(up.join(named, ["commit_hash", "above", "method"], "left"), "level")
            hit = up.where("from_id is not null").groupBy("commit_hash", "entity_id").agg(F.min(F.struct("way", "from_id", "doc")).alias("h"))
            hit = cut(hit.select("commit_hash", "entity_id", F.col("h.doc").alias("description"), F.lit("inherited").alias("origin"), F.col("h.from_id").alias("inherited_from")), "inherited")
            hits = hit if hits is None else hits.unionByName(hit)
            left = up.where("from_id is null").join(hit, ["commit_hash", "entity_id"], "left_anti").select("commit_hash", "entity_id", "method", F.col("above").alias("at"), F.concat("seen", F.array("above")).alias("seen"), "way")
            left = cut(left, "unresolved")
        if hits is not None:
            hits = hits.join(own.select("commit_hash", "entity_id", "own"), ["commit_hash", "entity_id"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
            found = own.join(hits.select("commit_hash", "entity_id"), ["commit_hash", "entity_id"], "left_anti").unionByName(hits)

    tags = F.pandas_udf(_tags, "array<string>")
    found = found.select("commit_hash", "entity_id", "description", F.split("description", r"\R[ \t]*\R", 2)[0].alias("summary"), tags("description").alias("tags"), "origin", "inherited_from", "own")
    if with_source:
        source = current_rows(entities.select("commit_hash", "entity_id", "ingested_at", "name", "source_code"), ["commit_hash", "entity_id"], "ingested_at", ["name", "source_code"])
        found = found.join(source, ["commit_hash", "entity_id"])
    return found
