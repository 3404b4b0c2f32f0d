"""What an entity's text is embedded with: short forms of what it calls, and what changes in them between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.functions.code import signature

HEADER = "\n\n# Call Graph Context\n"


def stub(source: Column, name: Column, docstring: Column | None = None) -> Column:
    """A definition's header and, as a comment, its first line beside headers and decorators (at most 120 characters); with
    `docstring`, the header and the whole docstring."""
    head = F.coalesce(F.nullif(F.trim(signature(source)), F.lit("")), F.concat(F.lit("def "), name, F.lit("()")))
    head = F.regexp_replace(head, "\n[ \t]{4}", "\n")
    head = F.when(F.endswith(head, F.lit(":")), head).otherwise(F.concat(head, F.lit(":")))
    if docstring is not None:
        doc = F.when(F.length(docstring) > 0, F.concat(F.lit('    """\n    '), F.regexp_replace(docstring, "\n(?=.)", "\n    "), F.lit('\n    """\n'))).otherwise("")
        return F.concat(head, F.lit("\n"), doc, F.lit("    pass"))
    lines = F.transform(F.split(source, "\r?\n"), F.trim)
    body = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("def ")) & ~F.startswith(x, F.lit("class ")) & ~F.startswith(x, F.lit("@")))
    first = F.coalesce(F.get(body, 0), F.lit("pass"))
    first = F.when(F.length(first) > 120, F.concat(F.substring(first, 1, 117), F.lit("..."))).otherwise(first)
    return F.concat(head, F.lit("\n    # Context: "), first, F.lit("\n    pass"))


def callee_stubs(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(commit_hash, entity_id, callee_id, stub) of direct callees, from entities (commit_hash, entity_id, source_code) and
    edges (commit_hash, src, dst). Each stub is made once, before the join. Callees without a source have none."""
    made = entities.where("source_code is not null").select("commit_hash", F.col("entity_id").alias("callee_id"), stub(F.col("source_code"), F.regexp_extract("entity_id", "([^:]*)$", 1)).alias("stub"))
    e = edges.where("src <> dst").select("commit_hash", F.col("src").alias("entity_id"), F.col("dst").alias("callee_id")).distinct()
    return e.join(made, ["commit_hash", "callee_id"]).select("commit_hash", "entity_id", "callee_id", "stub")


def contextual_texts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(commit_hash, entity_id, embed_text): the source, then the stubs of its callees in order of their ids.

    A row holds one entity's callees, which its own source names, so its size is bounded by that of the source times a stub."""
    s = callee_stubs(entities, edges).groupBy("commit_hash", "entity_id").agg(F.array_sort(F.collect_list(F.struct("callee_id", "stub"))).alias("s"))
    x = entities.select("commit_hash", "entity_id", "source_code").join(s, ["commit_hash", "entity_id"], "left")
    return x.select("commit_hash", "entity_id", F.when(F.col("s").isNull(), F.col("source_code")).otherwise(F.concat("source_code", F.lit(HEADER), F.array_join(F.col("s.stub"), "\n\n"))).alias("embed_text"))


def sides(rows: DataFrame, pairs: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(commit_before, commit_after, keys, old, new, had, has) of rows (commit_hash, keys) at both commits of each pair."""
    r = rows.select("commit_hash", *keys, value.alias("_v"))
    both = [r.join(pairs.select("commit_before", "commit_after", F.col(c).alias("commit_hash")), "commit_hash").withColumn("_new", F.lit(n)) for c, n in (("commit_before", False), ("commit_after", True))]
    x = both[0].unionByName(both[1]).groupBy("commit_before", "commit_after", *keys)
    return x.agg(F.max(F.when(~F.col("_new"), F.col("_v"))).alias("old"), F.max(F.when(F.col("_new"), F.col("_v"))).alias("new"), F.bool_or(~F.col("_new")).alias("had"), F.bool_or("_new").alias("has"))


def text_labels(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(commit_before, commit_after, entity_id, y): 1 where the embedded text differs; entities of both commits only."""
    x = sides(texts, pairs, ["entity_id"], F.md5("embed_text")).where("had and has")
    return x.select("commit_before", "commit_after", "entity_id", F.when(F.col("old").eqNullSafe(F.col("new")), 0.0).otherwise(1.0).alias("y"))


def text_changed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(commit_before, commit_after, entity_id) of entities that are new or whose embedded text differs."""
    x = sides(texts, pairs, ["entity_id"], F.md5("embed_text")).where("has")
    return x.where(~F.col("had") | ~F.col("old").eqNullSafe(F.col("new"))).select("commit_before", "commit_after", "entity_id")


def stub_changes(stubs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(commit_before, commit_after, entity_id, context_stub_changed_count): stubs that differ, come or go."""
    x = sides(stubs, pairs, ["entity_id", "callee_id"], F.md5("stub")).where(~F.col("old").eqNullSafe(F.col("new")))
    return x.groupBy("commit_before", "commit_after", "entity_id").agg(F.count("*").alias("context_stub_changed_count"))
