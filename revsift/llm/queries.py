"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsift.common import load
from revsift.llm.documentation import documented_functions
from revsift.llm.leaks import leaked_cases
from revsift.llm.packing import packed_documents
from revsift.llm.pieces import oversized_sources
from revsift.llm.spam import spam_pages
from revsift.llm.splits import grouped_splits
from revsift.llm.topn import top_ranked
from revsift.llm.vectors import similar_comparisons


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(load(spark, d, "entities"), with_source=False).where("own").select("commit_hash", "entity_id")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(load(spark, d, "entities"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = similar_comparisons(load(spark, d, "embedding_comparisons"), least=0.85)
    return x.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """All 5 neighbours of every vector, near or far: far ones are spread over many lists, so a tenth of all lists is probed, and
    every vector is in three of them."""
    return similar_comparisons(load(spark, d, "embedding_comparisons"), share=0.099, ways=3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = p3_splits(spark, d)
    return s.where("row_id <> group_row_id").select("group_row_id", "row_id")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """Balanced by the category of the query case; query_cases is looked at for its size before it is broadcast."""
    from revsift.common import small

    kinds = load(spark, d, "query_cases").groupBy("query_id").agg(F.min("category").alias("category"))
    rows = load(spark, d, "dataset_rows").join(small(kinds), "query_id", "left")
    return grouped_splits(rows, load(spark, d, "split_targets"), label="category")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized_sources(load(spark, d, "entities")).where("piece_no = 0").select("commit_hash", "entity_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return oversized_sources(load(spark, d, "entities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_ranked(load(spark, d, "retrieval_results")).select("run_id", "query_id", "entity_id")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return top_ranked(load(spark, d, "retrieval_results"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packed_documents(load(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_cases(load(spark, d, "documents"), load(spark, d, "query_cases")).where("verbatim").select("doc_id", "query_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Also re-parameterised copies."""
    return leaked_cases(load(spark, d, "documents"), load(spark, d, "query_cases"), merged=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(load(spark, d, "documents")).where("is_spam").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_neighbours, p3_found, p3_splits, p4_found, p4_pieces, p5_found, p5_ranking, p7_containers, p8_found, p8_leaks, p9_found, p9_scores)}

_TOP = """
WITH e AS (SELECT run_id, query_id, unnest(ranked_entity_ids) AS entity_id, unnest(ranked_scores) AS score FROM retrieval_results),
m AS (SELECT run_id, query_id, entity_id, max(score) AS score FROM e WHERE entity_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, entity_id) AS INTEGER) AS position FROM m)
"""

_SIMILAR = """
WITH v AS (SELECT DISTINCT comparison_id AS id, CAST(coalesce(candidate_raw_vector, baseline_raw_vector) AS DOUBLE[]) AS v FROM embedding_comparisons),
g AS (SELECT id, v FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda e: isnan(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0),
s AS (SELECT a.id, b.id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM g a JOIN g b ON a.id <> b.id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour_id) AS place FROM s)
"""

SQL = {
    "p2_found": _SIMILAR + "SELECT DISTINCT least(id, neighbour_id) AS id_a, greatest(id, neighbour_id) AS id_b FROM r WHERE place <= 5 AND cosine >= 0.85",
    "p3_found": r"""
WITH RECURSIVE x AS (SELECT row_id, lower(regexp_replace(v, '^\s+|\s+$', '', 'g')) AS v FROM
    (SELECT row_id, commit_before AS v FROM dataset_rows UNION ALL SELECT row_id, commit_after FROM dataset_rows)),
k AS (SELECT DISTINCT row_id, left(v, 8) AS k FROM x WHERE regexp_full_match(v, '[0-9a-f]{8,40}') AND NOT regexp_full_match(v, '0+')),
e AS (SELECT DISTINCT a.k AS u, b.k AS v FROM k a JOIN k b USING (row_id)),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
root AS (SELECT u, min(v) AS root FROM reach GROUP BY u),
g AS (SELECT DISTINCT row_id, root FROM k JOIN root ON k = u),
m AS (SELECT root, min(row_id) AS group_row_id FROM g GROUP BY root)
SELECT group_row_id, row_id FROM g JOIN m USING (root) WHERE row_id <> group_row_id""",
    "p4_found": """
SELECT commit_hash, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash, entity_id ORDER BY ingested_at DESC) AS rn FROM entities)
WHERE rn = 1 AND length(source_code) > 2000""",
    "p5_found": _TOP + "SELECT run_id, query_id, entity_id FROM r WHERE position <= 10",
    "p5_ranking": _TOP + "SELECT run_id, query_id, entity_id, score, position FROM r WHERE position <= 10",
}
