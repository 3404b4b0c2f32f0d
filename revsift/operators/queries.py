"""Query sets: made from sources and calls, kept clean, and what they cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revsift.functions import text

#: Words of sources and the dimension that each stands for; fixed values.
DOMAINS = [
    ("jwt", "jwt_authentication"), ("rs256", "rs256_algorithm"), ("pbkdf2", "pbkdf2_hashing"), ("salt", "salt_security"), ("session", "session_lifetime"), ("rbac", "rbac_authorization"), ("permission", "permission_check"),
    ("replica", "read_replica"), ("pool", "connection_pool"), ("lru", "lru_cache_policy"), ("ttl", "ttl_expiry"), ("rate_limit", "rate_limiting"), ("iso", "iso_8601_date"), ("aes", "aes_256_encryption"),
]
DOMAINS_SQL = "[" + ", ".join(f"['{a}', '{b}']" for a, b in DOMAINS) + "]"
#: Words of queries that cover parameters and errors; fixed values.
PARAMETER_WORDS = "parameter|argument|initialize|accept|mode|option"
ERROR_WORDS = "error|exception|raise|catch|invalid|fail"


def violation_free(candidates: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Of candidates (keys, position, query_text, entity_id, file_path, source_code) those without violations, each text once
    whatever its case and white space, by position the first `most` of each key; texts come collapsed."""
    x = candidates.withColumn("_form", text.lower_collapse(F.col("query_text"))).where("_form <> ''")
    x = x.groupBy(*keys, "_form").agg(F.min_by(F.struct("position", "query_text", "entity_id", "file_path", "source_code"), "position").alias("r")).select(*keys, "r.*")
    x = x.where(F.size(text.violations(F.col("query_text"), F.col("entity_id"), F.col("file_path"), F.coalesce("source_code", F.lit("")))) == 0)
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("position")))
    x = x.where(F.col("_i") <= most) if most is not None else x
    return x.select(*keys, (F.col("_i") - 1).alias("position"), text.collapse(F.col("query_text")).alias("query_text"))


def synthetic_queries(entities: DataFrame, edges: DataFrame, changed: DataFrame | None = None, most: int = 2) -> DataFrame:
    """Query cases of snapshots' entities (commit_hash, entity_id, entity_type, file_path, name, source_code): the docstring's
    first line in four wordings, two questions by each of three callers, one by each of three callees (edges; in order of
    their ids), the first `most` of those that give nothing away. Without `changed` (commit_hash, entity_id) every second
    entity counts as changed."""
    key = ["commit_hash", "entity_id"]
    doc = text.docstring_summary(F.col("source_code"))
    e = entities.where("source_code is not null").select(*key, "entity_type", "file_path", "name", "source_code", doc.alias("doc"))
    wordings = ["%s", "Which function is described as: %s?", "How is the following behavior implemented: %s?", "What module handles: %s?"]
    docs = e.where("doc is not null").select(*key, F.posexplode(F.array(*[F.format_string(w, F.col("doc")) for w in wordings])).alias("position", "query_text"))
    parts = [docs]
    short = F.regexp_extract("other", "([^:]*)$", 1)
    for here, there, asks, base in (
        ("dst", "src", ["What does %s rely on for its core operation?", "Which function is invoked by %s to process its logic?"], 4),
        ("src", "dst", ["Which function coordinates the execution of %s?"], 10),
    ):
        n = edges.select("commit_hash", F.col(here).alias("entity_id"), F.col(there).alias("other")).where("entity_id <> other").distinct()
        # a hub's callers are cut to three before any text is made
        n = n.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("other"))).where("i <= 3")
        parts.append(n.select(*key, "i", F.posexplode(F.array(*[F.format_string(w, short) for w in asks])).alias("j", "query_text")).select(*key, (base + (F.col("i") - 1) * len(asks) + F.col("j")).cast("int").alias("position"), "query_text"))
    c = reduce(lambda a, b: a.unionByName(b), parts).join(e.select(*key, "file_path", "source_code"), key)
    c = violation_free(c.select(*[F.col(k).alias(f"_{k}") for k in key], "position", "query_text", "entity_id", "file_path", "source_code"), [f"_{k}" for k in key], most)
    c = c.withColumnsRenamed({f"_{k}": k for k in key}).join(e.select(*key, "entity_type", "file_path", "name"), key)
    if changed is not None:
        c = c.join(changed.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    else:
        place = F.row_number().over(Window.partitionBy("commit_hash").orderBy("entity_id")) - 1
        c = c.join(e.select(*key, (place % 2 == 0).alias("_hit")), key)
    pick = lambda a, b: F.when(F.col("_hit"), a).otherwise(b)
    return c.select(
        F.concat_ws("::", F.substring("commit_hash", 1, 8), "entity_id", F.col("position").cast("string")).alias("query_id"), "query_text", F.lit("synthetic").alias("query_source"), pick("changed_entity", "unchanged_entity").alias("category"),
        F.col("entity_id").alias("target_entity_id"), F.col("name").alias("target_entity_name"), pick("latest_snapshot", "cached_snapshot").alias("expected_behavior"), F.col("commit_hash").alias("commit_after"), "file_path", "entity_type",
    )


def hybrid_queries(curated: DataFrame, synthetic: DataFrame, uncovered_only: bool = True) -> DataFrame:
    """Curated cases, then synthetic ones: for targets that no curated case has, or all of them."""
    more = synthetic.join(curated.select("target_entity_id").distinct(), "target_entity_id", "left_anti") if uncovered_only else synthetic
    return curated.unionByName(more.select(*curated.columns), allowMissingColumns=True)


def categorised(cases: DataFrame, changed: DataFrame) -> DataFrame:
    """Cases with category and expected_behavior by whether their target is among changed (entity_id)."""
    c = changed.select(F.col("entity_id").alias("target_entity_id"), F.lit(True).alias("_hit")).distinct()
    hit = F.col("_hit").isNotNull()
    x = cases.join(c, "target_entity_id", "left")
    return x.withColumns({"category": F.when(hit, "changed_entity").otherwise("unchanged_entity"), "expected_behavior": F.when(hit, "latest_snapshot").otherwise("cached_snapshot")}).drop("_hit")


def pair_cases(pairs: DataFrame, cases: DataFrame, entities: DataFrame) -> DataFrame:
    """(commit_before, commit_after, case columns): the cases whose target is in the later snapshot of each pair."""
    here = entities.select(F.col("commit_hash").alias("commit_after"), F.col("entity_id").alias("target_entity_id")).distinct()
    return cases.drop("commit_after").join(here, "target_entity_id").join(pairs.select("commit_before", "commit_after"), "commit_after")


def sampled_queries(cases: DataFrame, n: int = 20, seed: str = "") -> DataFrame:
    """n cases by the hash of their id and a seed: the same ones each time."""
    return cases.orderBy(F.xxhash64(F.lit(seed), "query_id"), "query_id").limit(n)


def overlap(trained: DataFrame, pairs: DataFrame) -> DataFrame:
    """(commit_hash) that a model was trained on and that the pairs to judge it by also hold; must be empty."""
    used = pairs.select(F.explode(F.array("commit_before", "commit_after")).alias("commit_hash"))
    return trained.select("commit_hash").intersect(used)


def dimensions(entities: DataFrame) -> DataFrame:
    """(entity_id, dimension): what there is to ask about each entity (entity_id, entity_type, param_count, source_code)."""
    src, low = F.col("source_code"), F.lower("source_code")
    one = [
        F.lit("intent:core_functionality"), F.when(F.col("param_count") > 0, "param:signature_args"), F.when(F.contains(src, F.lit("raise ")) | F.contains(src, F.lit("except ")) | F.contains(src, F.lit("try:")), "error:exception_handling"),
        *[F.when(F.contains(low, F.lit(w)), f"domain:{n}") for w, n in DOMAINS],
    ]
    methods = F.filter(F.regexp_extract_all(src, F.lit(r"def\s+([a-zA-Z0-9_]+)\s*\("), F.lit(1)), lambda m: ~F.startswith(m, F.lit("__")) | (m == "__init__"))
    named = F.when(F.col("entity_type") == "class", F.transform(methods, lambda m: F.concat(F.lit("method:"), m))).otherwise(F.array().cast("array<string>"))
    all_ = F.array_distinct(F.concat(F.array_compact(F.array(*one)), F.coalesce(named, F.array().cast("array<string>"))))
    return entities.select("entity_id", F.explode(all_).alias("dimension"))


def semantic_coverage(entities: DataFrame, cases: DataFrame) -> DataFrame:
    """(entity_id, total_dimensions, covered_dimensions, coverage_ratio, query_count, uncovered): dimensions that some case of
    the entity mentions. A case meets its own target's dimensions only."""
    d = dimensions(entities)
    q = cases.select(F.col("target_entity_id").alias("entity_id"), "query_id", F.lower("query_text").alias("q"))
    x = d.join(q, "entity_id", "left")
    tail = F.substring_index("dimension", ":", -1)
    hit = (
        F.when(F.col("q").isNull(), False)
        .when(F.col("dimension") == "intent:core_functionality", True)
        .when(F.col("dimension") == "param:signature_args", F.col("q").rlike(PARAMETER_WORDS))
        .when(F.col("dimension") == "error:exception_handling", F.col("q").rlike(ERROR_WORDS))
        .when(F.startswith("dimension", F.lit("domain:")), F.contains("q", F.substring_index(tail, "_", 1)))
        .otherwise(F.contains("q", tail) | F.contains("q", F.translate(tail, "_", " ")))
    )
    c = x.groupBy("entity_id", "dimension").agg(F.bool_or(hit).alias("hit"))
    n = q.groupBy("entity_id").agg(F.countDistinct("query_id").alias("query_count"))
    c = c.groupBy("entity_id").agg(F.count("*").alias("total_dimensions"), F.count_if("hit").alias("covered_dimensions"), F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("dimension")))).alias("uncovered"))
    return c.join(n, "entity_id", "left").select("entity_id", "total_dimensions", "covered_dimensions", (F.col("covered_dimensions") / F.col("total_dimensions")).alias("coverage_ratio"), F.coalesce("query_count", F.lit(0)).alias("query_count"), "uncovered")
