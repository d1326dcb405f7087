"""The pN_ queries of the problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import canonical, frequency, line_spam, mixing, scan_noise, similar_sets, tokenizer
from traceloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
#: Records loaded from here on form the second batch of p2_live_counts.
SECOND_BATCH = "2025-01-01"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_counts(spark, sf_dir).filter(F.col("mark").isNotNull())


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the persistent counts that spark.traceloom.counts.dir names, else in new ones."""
    kept = spark.conf.get("spark.traceloom.counts.dir", None)
    counts = frequency.TermCounts(spark, kept) if kept else None
    return frequency.term_counts(table(spark, sf_dir, "part_3_concept"), table(spark, sf_dir, "sample_user_doc_v2"), counts)


def p2_live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.live_term_counts(table(spark, sf_dir, "part_3_concept"), table(spark, sf_dir, "sample_user_doc_v2"), SECOND_BATCH)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets.tag_sets(table(spark, sf_dir, "part_3_concept"), table(spark, sf_dir, "sample_user_doc_v2"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets.similar_records(_sets(spark, sf_dir))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets.linked_records(_sets(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.scan_defects(table(spark, sf_dir, "part_3_concept"))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired(table(spark, sf_dir, "part_3_concept")).select("clause_key", "field_name", "item_pos", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.mapped_values(table(spark, sf_dir, "sample_user_doc_v2"), table(spark, sf_dir, "term_catalog"))


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unmatched_report(table(spark, sf_dir, "sample_user_doc_v2"), table(spark, sf_dir, "term_catalog"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's ids decode to its text again."""
    documents = table(spark, sf_dir, "documents")
    encoded = tokenizer.encode(documents)
    decoded = tokenizer.decode(encoded).withColumnRenamed("text", "decoded")
    # the texts are compared by two hashes, so that they aren't shuffled
    def marks(text: str) -> list:
        return [F.xxhash64(F.coalesce(text, F.lit(""))).alias(f"h_{text}"), F.hash(F.coalesce(text, F.lit(""))).alias(f"g_{text}")]

    back = decoded.select("doc_id", *marks("decoded"))
    return documents.select("doc_id", *marks("text")).join(back, "doc_id").select("doc_id", ((F.col("h_text") == F.col("h_decoded")) & (F.col("g_text") == F.col("g_decoded"))).alias("same"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spam.spam_pages(table(spark, sf_dir, "documents"))


def p9_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spam.shape_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (p2_found, p2_counts, p2_live_counts, p3_found, p3_links, p4_found, p4_text, p5_found, p5_unmatched, p7_ids, p7_round_trip, p8_mixture, p8_shares, p9_found, p9_shapes)}


_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _fold(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '{_SPACE}', ' ', 'g')))"


_P2_VALUES = f"""
values_of AS (
  SELECT 'tags' AS field_name, k, {_fold('v')} AS term FROM (SELECT clause_key AS k, unnest(tags) AS v FROM c)
  UNION ALL SELECT 'asil_level', clause_key, {_fold('asil_level')} FROM c
  UNION ALL SELECT 'methods_used', k, {_fold('v')} FROM (SELECT wp_key AS k, unnest(methods_used) AS v FROM w)),
good AS (SELECT * FROM values_of WHERE term <> ''),
totals AS (SELECT field_name, count(DISTINCT k) AS n_total FROM good GROUP BY 1),
counts AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT k) AS n_records FROM good GROUP BY 1, 2),
marked AS (
  SELECT field_name, term, n_occurrences, n_records,
         CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.2 * n_total THEN 'common' END AS mark
  FROM counts JOIN totals USING (field_name))"""


def _p2(where: str, rest: str) -> str:
    return f"""
WITH c AS (SELECT * FROM part_3_concept {where} QUALIFY row_number() OVER (PARTITION BY clause_key ORDER BY loaded_at) = 1),
w AS (SELECT * FROM sample_user_doc_v2 {where} QUALIFY row_number() OVER (PARTITION BY wp_key ORDER BY loaded_at) = 1),
{_P2_VALUES}
SELECT field_name, term, n_occurrences, n_records, mark FROM marked {rest}"""


def _sets_sql() -> str:
    return f"""
c AS (SELECT * FROM part_3_concept QUALIFY row_number() OVER (PARTITION BY clause_key ORDER BY loaded_at) = 1),
w AS (SELECT * FROM sample_user_doc_v2 QUALIFY row_number() OVER (PARTITION BY wp_key ORDER BY loaded_at) = 1),
items AS (
  SELECT DISTINCT k, {_fold('v')} AS item FROM (
    SELECT clause_key AS k, unnest(tags) AS v FROM c UNION ALL SELECT wp_key, unnest(tags_addressed) FROM w)
  WHERE {_fold('v')} <> ''),
sizes AS (SELECT k, count(*) AS n FROM items GROUP BY 1 HAVING count(*) >= 4),
shared AS (
  SELECT x.k AS a, y.k AS b, count(*) AS s FROM items x JOIN items y ON x.item = y.item AND x.k < y.k GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _p2("", "WHERE mark IS NOT NULL"),
        "p2_counts": _p2("", ""),
        "p2_live_counts": _p2("WHERE deleted_at IS NULL", ""),
        "p3_found": f"""WITH {_sets_sql()}
SELECT a AS left_key, b AS right_key FROM shared JOIN sizes l ON l.k = a JOIN sizes r ON r.k = b
WHERE 1000 * s >= 650 * (l.n + r.n - s)""",
        "p3_links": f"""WITH {_sets_sql()},
sets AS (SELECT k, list_sort(list(item)) AS s FROM items SEMI JOIN sizes USING (k) GROUP BY 1),
classes AS (SELECT k, min(k) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS n_copies FROM sets),
alike AS (SELECT a, b FROM shared JOIN sizes l ON l.k = a JOIN sizes r ON r.k = b WHERE 1000 * s >= 650 * (l.n + r.n - s)),
linked AS (SELECT DISTINCT least(x.class_id, y.class_id) AS p, greatest(x.class_id, y.class_id) AS q FROM alike JOIN classes x ON x.k = a JOIN classes y ON y.k = b WHERE x.class_id <> y.class_id),
n AS (SELECT class_id, count(*) AS n_links FROM (SELECT p AS class_id FROM linked UNION ALL SELECT q FROM linked) GROUP BY 1)
SELECT k AS record_key, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN n USING (class_id)""",
        "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
    }
