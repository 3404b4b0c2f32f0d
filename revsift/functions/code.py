"""Python source as rows: entities, metrics, imports, calls, and a form without names and layout."""

from __future__ import annotations

import ast
import symtable
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def spellings(source: str):
    """A file, or one definition however it is indented, as a module."""
    source = source.replace("\r\n", "\n")
    yield source
    bare = textwrap.dedent(source)
    yield bare
    yield "if 1:\n" + textwrap.indent(bare, " ")


def parsed(source: str) -> ast.Module | None:
    """The tree of a file, or of one definition however it is indented."""
    for s in spellings(source):
        try:
            return ast.parse(s)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return None


def metrics(node: ast.AST) -> tuple[float, float, float, float, float]:
    """(cyclomatic complexity, nodes of the tree, deepest nesting, parameters but self and cls, returns)."""
    complexity, count, returns = 1, 0, 0
    for x in ast.walk(node):
        count += 1
        complexity += isinstance(x, _BRANCH) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
        returns += isinstance(x, ast.Return)
    deepest, stack = 0, [(node, 0)]
    while stack:
        x, depth = stack.pop()
        deepest = max(deepest, depth)
        for child in ast.iter_child_nodes(x):
            alone = isinstance(x, ast.If) and isinstance(child, ast.If) and child in x.orelse  # elif stays at its if
            stack.append((child, depth + (isinstance(child, _NESTS) and not alone)))
    params = 0
    if isinstance(node, _FUNCTION):
        a = node.args
        params = sum(p.arg not in ("self", "cls") for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))))
    return float(complexity), float(count), float(deepest), float(params), float(returns)


def _bound_names(source: str) -> set[str]:
    """Names that a source binds by assignment or as parameters; not definitions, imports, self and cls."""
    found, todo = set(), [symtable.symtable(source, "source", "exec")]
    while todo:
        table = todo.pop()
        todo += table.get_children()
        found |= {x.get_name() for x in table.get_symbols() if (x.is_parameter() or x.is_assigned()) and not x.is_namespace() and not x.is_imported()}
    return found - {"self", "cls"}


def _written(node, bound: set[str], number: dict[str, int]) -> str:
    """A tree as text: bound names by the number of their first place, except in annotations; contexts left out."""
    if isinstance(node, list):
        return "[" + " ".join(_written(x, bound, number) for x in node) + "]"
    if not isinstance(node, ast.AST):
        return repr(node)
    name = node.id if isinstance(node, ast.Name) else node.arg if isinstance(node, ast.arg) else None
    parts = [type(node).__name__]
    for field, value in ast.iter_fields(node):
        if field in ("ctx", "type_comment", "kind"):
            continue
        if name in bound and value == name:
            parts.append(f"#{number.setdefault(name, len(number))}")
        else:
            parts.append(_written(value, set() if field in ("annotation", "returns") else bound, number))
    return "(" + " ".join(parts) + ")"


def _bare(text: str) -> str:
    """A text that is no Python, without comments of the usual kinds and with single blanks."""
    for start, end in (("/*", "*/"), ("//", "\n"), ("#", "\n")):
        head, *rest = text.split(start)
        kept = [head]
        for x in rest:
            _, found, tail = x.partition(end)
            kept.append((end if end == "\n" else " ") + tail if found else "" if end == "\n" else start + x)
        text = "".join(kept)
    return " ".join(text.split())


def normalised(source: str) -> str:
    """What a source says apart from layout, comments and the choice of local names; docstrings count."""
    for s in spellings(source):
        try:
            return _written(ast.parse(s), _bound_names(s), {})
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return _bare(source)


def _definitions(tree: ast.Module):
    """(node, class name or None) of classes and of functions outside of functions."""
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        x, owner = stack.pop()
        for c in ast.iter_child_nodes(x):
            if isinstance(c, ast.ClassDef):
                yield c, None
                stack.append((c, c.name))
            elif isinstance(c, _FUNCTION):
                yield c, owner
            else:
                stack.append((c, owner))


def parse_entities(files: DataFrame) -> DataFrame:
    """Entities of (commit_hash, file_path, content): (commit_hash, entity_id, entity_type, file_path, name, lineno, end_lineno, source_code, 5
    metrics). Files that don't parse and null contents give none."""

    def run(batches):
        for p in batches:
            rows = []
            for commit, path, content in zip(p["commit_hash"], p["file_path"], p["content"]):
                tree = parsed(content) if isinstance(content, str) else None
                lines = content.splitlines() if tree else []
                for node, owner in _definitions(tree) if tree else ():
                    kind = "class" if isinstance(node, ast.ClassDef) else "method" if owner else "function"
                    key = "::".join(filter(None, (path, owner, node.name)))
                    body = "\n".join([lines[node.lineno - 1][node.col_offset :], *lines[node.lineno : node.end_lineno]])
                    rows.append((commit, key, kind, path, node.name, node.lineno, node.end_lineno, body, *metrics(node)))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("commit_hash", "file_path", "content").mapInPandas(run, _SCHEMA)


_COLUMNS = "commit_hash entity_id entity_type file_path name lineno end_lineno source_code cyclomatic_complexity ast_node_count max_nesting_depth param_count return_count".split()
_SCHEMA = "commit_hash string, entity_id string, entity_type string, file_path string, name string, lineno int, end_lineno int, source_code string, cyclomatic_complexity double, ast_node_count double, max_nesting_depth double, param_count double, return_count double"


def _metrics(source: pd.Series) -> pd.DataFrame:
    out = []
    for s in source:
        tree = parsed(s) if isinstance(s, str) else None
        node = next((n for n in ast.walk(tree) if isinstance(n, (*_FUNCTION, ast.ClassDef))), None) if tree else None
        out.append(metrics(node) if node is not None else (None,) * 5)
    return pd.DataFrame(out, columns=_COLUMNS[8:], dtype=float)


def code_metrics(source: str | Column) -> Column:
    """Metrics of the first definition of a source; nulls where it doesn't parse."""
    return F.pandas_udf(_metrics, f"struct<{', '.join(f'{c} double' for c in _COLUMNS[8:])}>")(source)


def _forms(source: pd.Series) -> pd.Series:
    return source.map(lambda s: normalised(s) if isinstance(s, str) else None)


def semantic_form(source: str | Column) -> Column:
    """`normalised` of a source."""
    return F.pandas_udf(_forms, "string")(source)


def _called(source: pd.Series) -> pd.Series:
    def of(s: str | None) -> list[str]:
        tree = parsed(s) if isinstance(s, str) else None
        found = (x.func.attr if isinstance(x.func, ast.Attribute) else getattr(x.func, "id", None) for x in ast.walk(tree) if isinstance(x, ast.Call)) if tree else ()
        return sorted({f for f in found if f})

    return source.map(of)


def called_names(source: str | Column) -> Column:
    """Names called in a source, the text after the last dot, distinct."""
    return F.pandas_udf(_called, "array<string>")(source)


def imports(files: DataFrame) -> DataFrame:
    """(commit_hash, file_path, alias, target) of import statements; of equal aliases the last counts."""

    def of(content: pd.Series) -> pd.Series:
        def one(s: str | None) -> list[dict]:
            found: dict[str, str] = {}
            tree = parsed(s) if isinstance(s, str) else None
            for x in ast.walk(tree) if tree else ():
                if isinstance(x, ast.Import):
                    found |= {a.asname or a.name: f"import:{a.name}" for a in x.names}
                elif isinstance(x, ast.ImportFrom):
                    base = "." * x.level + (x.module or "")
                    found |= {a.asname or a.name: f"import:{base}.{a.name}" for a in x.names}
            return [{"alias": k, "target": v} for k, v in found.items()]

        return content.map(one)

    found = F.pandas_udf(of, "array<struct<alias string, target string>>")
    return files.select("commit_hash", "file_path", F.explode(found("content")).alias("i")).select("commit_hash", "file_path", "i.*")


def resolved_imports(imports_: DataFrame, entities: DataFrame) -> DataFrame:
    """(commit_hash, file_path, alias, entity_id): imports of entities of the same snapshot. The longest module that is a file
    there counts, at its path or below src; a name or a class and its method may follow it."""
    x = imports_.select("commit_hash", "file_path", "alias", F.split(F.regexp_replace("target", "^import:", ""), r"\.").alias("p"))
    x = x.withColumn("i", F.explode(F.sequence(F.size("p"), F.lit(1), F.lit(-1)))).withColumn("root", F.explode(F.array(F.lit(""), F.lit("src/"))))
    file = F.concat("root", F.array_join(F.slice("p", F.lit(1), F.col("i")), "/"), F.lit(".py"))
    rest = F.slice("p", F.col("i") + 1, F.size("p") - F.col("i"))
    x = x.select("commit_hash", "file_path", "alias", (-F.col("i")).alias("i"), "root", file.alias("module"), F.size(rest).alias("n"), F.concat_ws("::", file, rest).alias("entity_id")).where("n <= 2")
    known = entities.select("commit_hash", "entity_id").distinct()
    files = entities.select("commit_hash", F.col("file_path").alias("module")).distinct()
    whole = x.where("n = 0").join(files, ["commit_hash", "module"]).withColumn("entity_id", F.lit(None).cast("string"))  # a module is no entity
    found = whole.select("commit_hash", "file_path", "alias", "i", "root", "entity_id").unionByName(x.where("n > 0").join(known, ["commit_hash", "entity_id"]).select("commit_hash", "file_path", "alias", "i", "root", "entity_id"))
    return found.groupBy("commit_hash", "file_path", "alias").agg(F.min_by("entity_id", F.struct("i", "root")).alias("entity_id")).where("entity_id is not null")


def call_edges(entities: DataFrame, imports_: DataFrame | None = None) -> DataFrame:
    """(commit_hash, src, dst): calls resolved within a snapshot, in this order: a method of the same class, the same file, an
    import of the file (where imports are given), the only function or method of that name, the only one in the directory.

    Each step is a join on a unique key, so a name that is called or defined everywhere multiplies no rows. A null type is
    judged by the source. Calls of oneself are dropped.
    """
    part = lambda c: F.regexp_extract(c, r"(?s)^(.*)::[^:]*\z", 1)
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    function = F.coalesce(F.col("entity_type").isin("function", "method"), F.col("source_code").rlike(r"\A(?:\s|@[^\n]*\n)*(?:async\s+)?def\b"))
    f = entities.where(function & F.col("source_code").isNotNull())
    calls = f.select("commit_hash", F.col("entity_id").alias("src"), part("entity_id").alias("owner"), "file_path", folder.alias("folder"), F.explode(called_names("source_code")).alias("called"))
    calls = calls.withColumns({"at_class": F.when(F.col("owner") != F.col("file_path"), F.concat_ws("::", "owner", "called")), "at_file": F.concat_ws("::", "file_path", "called")})
    ids = entities.select("commit_hash", F.col("entity_id").alias("id")).distinct()
    named = f.select("commit_hash", folder.alias("folder"), F.regexp_extract("entity_id", r"([^:]*)\z", 1).alias("called"), "entity_id").distinct()
    only = lambda by, name: named.groupBy("commit_hash", *by).agg(F.count("*").alias("n"), F.min("entity_id").alias(name)).where("n = 1").drop("n")
    x = calls.join(ids.select("commit_hash", F.col("id").alias("at_class"), F.col("id").alias("by_class")), ["commit_hash", "at_class"], "left")
    x = x.join(ids.select("commit_hash", F.col("id").alias("at_file"), F.col("id").alias("by_file")), ["commit_hash", "at_file"], "left")
    if imports_ is not None:
        r = resolved_imports(imports_, entities).select("commit_hash", "file_path", F.col("alias").alias("called"), F.col("entity_id").alias("by_import"))
        x = x.join(r, ["commit_hash", "file_path", "called"], "left")
    else:
        x = x.withColumn("by_import", F.lit(None).cast("string"))
    x = x.join(only(["called"], "by_name"), ["commit_hash", "called"], "left").join(only(["folder", "called"], "by_folder"), ["commit_hash", "folder", "called"], "left")
    x = x.select("commit_hash", "src", F.coalesce("by_class", "by_file", "by_import", "by_name", "by_folder").alias("dst"))
    return x.where("dst is not null and src <> dst").distinct()


def signature(source: Column) -> Column:
    """The lines of a definition up to the one that ends with a colon, comments cut."""
    head = F.regexp_extract(source, r"(?s)((?:async[ \t]+)?(?:def|class)\s.*?:)[ \t]*(?:#[^\n]*)?(?:\r?\n|\z)", 1)
    return F.regexp_replace(head, r"[ \t]*#[^\n]*", "")
