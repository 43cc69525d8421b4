"""Queries on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.integrity import citation_orphans, record_orphans
from quillspark.runtime import load


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = load(spark, d, "citation_edges").select("edge_id", "source_paper_id", "target_paper_id", "created_at")
    papers = load(spark, d, "papers").select("id", "created_at")
    records = load(spark, d, "sample_papers").select("external_id", "doi", "reference_ids", "fetched_at")
    return citation_orphans(edges, papers).unionByName(record_orphans(records))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_key", "ref_field", "ref_value")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, month and reason."""
    return _orphans(spark, d).groupBy("ref_table", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '^https://doi\.org/', ''), '^doi:\s*', ''), '^https://arxiv\.org/abs/', 'arxiv:'), '^https://openalex\.org/', 'openalex:'), '^(arxiv:.*?)v\d+$', '\1')"
_SQL = f"""
WITH ends AS (
  SELECT edge_id, created_at, 'source_paper_id' AS ref_field, source_paper_id AS ref FROM citation_edges
  UNION ALL SELECT edge_id, created_at, 'target_paper_id', target_paper_id FROM citation_edges),
edge_cases AS (
  SELECT DISTINCT 'citation_edges' AS ref_table, CAST(e.edge_id AS VARCHAR) AS ref_key, e.ref_field, CAST(e.ref AS VARCHAR) AS ref_value,
    strftime(e.created_at AT TIME ZONE 'UTC', '%Y-%m') AS period, CASE WHEN p.id IS NULL THEN 'missing' ELSE 'later' END AS reason
  FROM ends e LEFT JOIN papers p ON p.id = e.ref
  WHERE e.ref IS NOT NULL AND (p.id IS NULL OR p.created_at > e.created_at)),
keys AS (
  SELECT DISTINCT {_NORMAL.format("k")} AS k FROM (SELECT external_id AS k FROM sample_papers UNION ALL SELECT doi FROM sample_papers) WHERE k IS NOT NULL),
refs AS (SELECT external_id, fetched_at, unnest(reference_ids) AS v FROM sample_papers),
record_cases AS (
  SELECT 'sample_papers' AS ref_table, external_id AS ref_key, 'reference_ids' AS ref_field, v AS ref_value,
    strftime(min(fetched_at) AT TIME ZONE 'UTC', '%Y-%m') AS period, 'missing' AS reason
  FROM refs WHERE v IS NOT NULL AND {_NORMAL.format("v")} <> '' AND {_NORMAL.format("v")} NOT IN (SELECT k FROM keys)
  GROUP BY external_id, v),
cases AS (SELECT * FROM edge_cases UNION ALL SELECT * FROM record_cases)
"""
QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL = {
    "p7_found": _SQL + "SELECT ref_table, ref_key, ref_field, ref_value FROM cases",
    "p7_report": _SQL + "SELECT ref_table, ref_field, period, reason, count(*) AS orphans FROM cases GROUP BY ALL",
}
