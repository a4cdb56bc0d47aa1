"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.llm import frequency, leakage, mojibake, tokens
from ribospark.session import spread, table


def _terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(field_name, record_id, term) of the counted fields, and (field_name, n_rows)."""
    peptides, vep = table(spark, d, "peptide_table"), table(spark, d, "vep_records")
    columns = ("feature_type", "variant_id")
    values = F.array(*(F.struct(F.lit(c).alias("field_name"), frequency.clean_value(F.col(c)).alias("term")) for c in columns))
    single = peptides.select(F.col("row_id").alias("record_id"), F.explode(values).alias("v")).select("v.field_name", "record_id", "v.term")
    split = F.regexp_extract_all("consequences", F.lit(r"[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*"), F.lit(0))
    packed_terms = vep.select(F.lit("consequences").alias("field_name"), "record_id", F.explode(split).alias("term"))
    n_peptides = peptides.agg(F.count(F.lit(1)).alias("n_rows"))
    totals = n_peptides.select(F.explode(F.array(*(F.lit(c) for c in columns))).alias("field_name"), "n_rows").unionByName(
        vep.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("consequences").alias("field_name"), "n_rows")
    )
    return single.unionByName(packed_terms), totals


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    terms, totals = _terms(spark, d)
    return frequency.marked(frequency.term_frequencies(terms), totals)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_documents(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(_documents(spark, d), table(spark, d, "eval_items"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(_documents(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


QUERIES = {
    "p5_found": p5_found,
    "p5_terms": p5_terms,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_COUNTED = """
terms AS (
  SELECT 'feature_type' AS field_name, row_id AS record_id, regexp_replace(feature_type, '^\\s+|\\s+$', '', 'g') AS term FROM peptide_table
  UNION ALL SELECT 'variant_id', row_id, regexp_replace(variant_id, '^\\s+|\\s+$', '', 'g') FROM peptide_table
  UNION ALL SELECT 'consequences', record_id, unnest(regexp_extract_all(consequences, '[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*')) FROM vep_records
), totals AS (
  SELECT unnest(['feature_type', 'variant_id']) AS field_name, count(*) AS n_rows FROM peptide_table
  UNION ALL SELECT 'consequences', count(*) FROM vep_records
), counted AS (
  SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT record_id) AS n_records
  FROM terms WHERE term NOT IN ('', '.') GROUP BY ALL
), marks AS (
  SELECT field_name, term, n_occurrences, n_records,
    CASE WHEN n_records * 5 > n_rows THEN 'common' WHEN n_records <= 3 THEN 'rare' END AS mark
  FROM counted JOIN totals USING (field_name)
)"""

SQL = {
    "p5_terms": f"WITH {_COUNTED} SELECT * FROM marks",
    "p5_found": f"WITH {_COUNTED} SELECT field_name, term, mark FROM marks WHERE mark IS NOT NULL",
}
