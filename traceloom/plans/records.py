"""Queries p1_ and p6_: nested records and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators import nested, orphans
from traceloom.session import scratch_path, table


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return nested.stored_tables(table(spark, sf_dir, "raw_user_docs"), scratch_path(spark, "nested"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nested_rows(_tables(spark, sf_dir))


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the typed tables and of their links, by kind and status."""
    tables = _tables(spark, sf_dir)
    products = tables["product"].select("file_id", "wp_no", "status")
    out = None
    for tag, t in tables.items():
        if tag != "product":
            one = products.join(t, ["file_id", "wp_no"]).groupBy(F.lit(tag).alias("kind"), "status").agg(F.count(F.lit(1)).alias("n_values"), F.countDistinct("file_id", "wp_no").alias("n_products"))
            out = one if out is None else out.unionAll(one)
    return out


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(table(spark, sf_dir, "part_3_concept"), table(spark, sf_dir, "part_4_system"), table(spark, sf_dir, "sample_user_doc_v2"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir))


QUERIES = {q.__name__: q for q in (p1_found, p1_tables, p6_found, p6_report)}

_P6 = r"""
WITH c3 AS (SELECT * FROM part_3_concept QUALIFY row_number() OVER (PARTITION BY clause_key ORDER BY loaded_at) = 1),
c4 AS (SELECT * FROM part_4_system QUALIFY row_number() OVER (PARTITION BY clause_key ORDER BY loaded_at) = 1),
w AS (SELECT * FROM sample_user_doc_v2 QUALIFY row_number() OVER (PARTITION BY wp_key ORDER BY loaded_at) = 1),
parents AS (
  SELECT standard_id || '|' || part || '|' || section AS target, loaded_at, deleted_at FROM c3
  UNION ALL SELECT standard_id || '|' || part || '|' || section, loaded_at, deleted_at FROM c4
  UNION ALL SELECT '#' || CAST(CAST(regexp_extract(id, 'WP-(\d+)', 1) AS BIGINT) AS VARCHAR), loaded_at, deleted_at FROM w),
x AS (SELECT clause_key AS k, standard_id, part, loaded_at, generate_subscripts(cross_references, 1) AS pos, unnest(cross_references) AS ref FROM c3),
m AS (SELECT wp_key AS k, standard_id, mapped_part, loaded_at, generate_subscripts(mapped_sections, 1) AS pos, unnest(mapped_sections) AS ref FROM w),
l AS (SELECT wp_key AS k, loaded_at, generate_subscripts(traceability_links, 1) AS pos, unnest(traceability_links)."to" AS ref FROM w),
refs AS (
  SELECT 'cross_references' AS field_name, k, pos, loaded_at, p AS part,
         standard_id || '|' || p || '|' || regexp_extract(rest, '(\d+(\.\d+)+)', 1) AS target
  FROM (SELECT *, coalesce(nullif(regexp_extract(ref, '(?i)part[\s_]*(\d+)', 1), ''), part) AS p,
               regexp_replace(ref, '(?i)part[\s_]*\d+\s*:?', ' ') AS rest FROM x)
  WHERE regexp_extract(rest, '(\d+(\.\d+)+)', 1) <> ''
  UNION ALL
  SELECT 'mapped_sections', k, pos, loaded_at, mapped_part, standard_id || '|' || mapped_part || '|' || regexp_extract(ref, '(\d+(\.\d+)+)', 1)
  FROM m WHERE regexp_extract(ref, '(\d+(\.\d+)+)', 1) <> ''
  UNION ALL
  SELECT 'traceability_links.to', k, pos, loaded_at, '3', '#' || CAST(CAST(regexp_extract(ref, '(?i)(^|[^a-z0-9])wp[\s_-]*(\d+)', 2) AS BIGINT) AS VARCHAR)
  FROM l WHERE regexp_extract(ref, '(?i)(^|[^a-z0-9])wp[\s_-]*(\d+)', 2) <> ''),
found AS (
  SELECT field_name, k AS source_key, CAST(pos AS INTEGER) AS pos,
         CASE WHEN p.target IS NULL THEN 'missing' WHEN p.deleted_at IS NOT NULL THEN 'deleted' WHEN p.loaded_at > r.loaded_at THEN 'late' END AS reason,
         strftime(r.loaded_at, '%Y-%m') AS load_month
  FROM refs r LEFT JOIN parents p ON r.target = p.target WHERE r.part IN ('3', '4'))
"""
ORACLE = {
    "p6_found": _P6 + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p6_report": _P6 + "SELECT field_name, load_month, reason, count(*) AS n_references, count(DISTINCT source_key) AS n_sources FROM found WHERE reason IS NOT NULL GROUP BY ALL",
}
