"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revsift.common import load
from revsift.operators.snapshots import snapshot_changes


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(load(spark, d, "entities"), load(spark, d, "commits"))


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": r"""
WITH cur AS (
  SELECT commit_hash, entity_id, regexp_replace(regexp_replace(regexp_replace(source_code, '\r\n?', E'\n', 'g'), '[ \t\f\v]+\n', E'\n', 'g'), '\s+$', '') AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash, entity_id ORDER BY ingested_at DESC) AS rn FROM entities) WHERE rn = 1),
c AS (SELECT repo, commit_hash, min(seq) AS seq FROM commits WHERE commit_hash IN (SELECT commit_hash FROM cur) GROUP BY ALL),
p AS (SELECT lag(commit_hash) OVER (PARTITION BY repo ORDER BY seq, commit_hash) AS commit_before, commit_hash AS commit_after FROM c),
b AS (SELECT p.*, entity_id, t FROM p JOIN cur ON commit_hash = commit_before),
a AS (SELECT p.*, entity_id, t FROM p JOIN cur ON commit_hash = commit_after WHERE commit_before IS NOT NULL)
SELECT coalesce(b.commit_before, a.commit_before) AS commit_before, coalesce(b.commit_after, a.commit_after) AS commit_after,
  coalesce(b.entity_id, a.entity_id) AS entity_id,
  CASE WHEN a.entity_id IS NULL THEN 'removed' WHEN b.entity_id IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM b FULL JOIN a ON b.commit_before = a.commit_before AND b.commit_after = a.commit_after AND b.entity_id = a.entity_id
WHERE a.entity_id IS NULL OR b.entity_id IS NULL OR a.t IS DISTINCT FROM b.t"""
}
