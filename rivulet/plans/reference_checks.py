"""Queries p4: references of the golden sets and the catalogue to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.operators.references import failing_references, orphan_report, references
from rivulet.sources.tables import table


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    refs = [
        references(table(spark, sf_dir, "document_chunks"), "document_chunks", "document_id", "chunk_id", "linked_at"),
        references(table(spark, sf_dir, "qa_pairs"), "qa_pairs", "qa_id", "relevant_chunks", "created_at"),
        references(table(spark, sf_dir, "retrieval_dataset"), "retrieval_dataset", "id", "relevant_chunk_ids", "created_at"),
    ]
    return refs, table(spark, sf_dir, "chunks").select("id", "created_at", "deleted_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failing_references(*_inputs(spark, sf_dir))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(*_inputs(spark, sf_dir))


_REFS = r"""
refs AS (
  SELECT DISTINCT 'document_chunks' AS ref_table, document_id AS ref_key, lower(regexp_replace(chunk_id, '^\s+|\s+$', '', 'g')) AS chunk_id, linked_at AS ref_time
  FROM document_chunks WHERE chunk_id IS NOT NULL
  UNION
  SELECT DISTINCT 'qa_pairs', CAST(qa_id AS VARCHAR), lower(regexp_replace(c, '^\s+|\s+$', '', 'g')), created_at
  FROM (SELECT qa_id, created_at, unnest(relevant_chunks) AS c FROM qa_pairs) WHERE c IS NOT NULL
  UNION
  SELECT DISTINCT 'retrieval_dataset', id, lower(regexp_replace(c, '^\s+|\s+$', '', 'g')), created_at
  FROM (SELECT id, created_at, unnest(relevant_chunk_ids) AS c FROM retrieval_dataset) WHERE c IS NOT NULL),
alive AS (
  SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS chunk_id, min(created_at) AS born,
         CASE WHEN bool_or(deleted_at IS NULL) THEN NULL ELSE max(deleted_at) END AS gone
  FROM chunks WHERE id IS NOT NULL GROUP BY 1),
bad AS (
  SELECT DISTINCT r.ref_table, r.ref_key, r.chunk_id,
         CASE WHEN a.chunk_id IS NULL THEN 'missing' WHEN a.born > r.ref_time THEN 'late' WHEN a.gone <= r.ref_time THEN 'deleted' END AS reason,
         strftime(r.ref_time, '%Y-%m') AS ref_month
  FROM refs r LEFT JOIN alive a USING (chunk_id))"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLE = {
    "p4_found": f"WITH {_REFS} SELECT * FROM bad WHERE reason IS NOT NULL",
    "p4_report": f"""WITH {_REFS},
n AS (SELECT ref_table, strftime(ref_time, '%Y-%m') AS ref_month, count(*) AS n_refs FROM refs GROUP BY 1, 2),
b AS (SELECT ref_table, ref_month, count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'late') AS n_late,
             count(*) FILTER (reason = 'deleted') AS n_deleted FROM bad WHERE reason IS NOT NULL GROUP BY 1, 2)
SELECT n.ref_table, n.ref_month, n_refs, coalesce(n_missing, 0) AS n_missing, coalesce(n_late, 0) AS n_late, coalesce(n_deleted, 0) AS n_deleted,
       round((coalesce(n_missing, 0) + coalesce(n_late, 0) + coalesce(n_deleted, 0)) / n_refs, 6) AS fail_share
FROM n LEFT JOIN b ON n.ref_table = b.ref_table AND n.ref_month IS NOT DISTINCT FROM b.ref_month""",
}
