"""Queries of the general data-preparation operators (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import orphans_found, orphans_report
from ..operators.stamps import STAMPED, stamps_found


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}


_REGISTERS = ("gateway_settlements", "refunds_report", "order_register", "payment_register", "upi_wallet_txns", "paypal_statement")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_found(load(spark, sf_dir, *_REGISTERS))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_report(load(spark, sf_dir, *_REGISTERS))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load(spark, sf_dir, *(name for name, _ in STAMPED), "feed_profiles")
    return stamps_found(tables, tables["feed_profiles"])


def key_sql(column: str) -> str:
    """The key of a reference in DuckDB's SQL."""
    clean = f"trim(regexp_replace({column}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
    plain = f"upper(regexp_replace({clean}, '[^0-9A-Za-z]+', '', 'g'))"
    bare = f"regexp_replace(regexp_replace({plain}, '^[A-Z]+([0-9])', '\\1'), '^0+([0-9])', '\\1')"
    number = f"ltrim({clean}, '''')"
    return f"""CASE WHEN lower({clean}) IN ('', '-', '—', 'na', 'n/a', 'nan', 'nil', 'none', 'null') THEN NULL
        WHEN regexp_full_match({number}, '[0-9]+(\\.[0-9]+)?([eE]\\+?[0-9]{{1,2}})?') AND regexp_matches({number}, '[.eE]') THEN CAST(CAST(CAST({number} AS DOUBLE) AS BIGINT) AS VARCHAR)
        ELSE {bare} END"""


P1_FOUND_SQL = f"""
WITH refs AS (
  SELECT 'gateway_settlements' AS table_name, row_id, 'order_id' AS field_name, 'order' AS target, {key_sql("order_id")} AS k, loaded_at AS t FROM gateway_settlements
  UNION ALL SELECT 'gateway_settlements', row_id, 'payment_id', 'payment', {key_sql("payment_id")}, loaded_at FROM gateway_settlements
  UNION ALL SELECT 'refunds_report', row_id, 'original_reference', CASE upper(trim(source_type)) WHEN 'UPI' THEN 'upi' WHEN 'PAYPAL' THEN 'paypal' WHEN 'GATEWAY' THEN 'payment' END,
    {key_sql("original_reference")}, loaded_at FROM refunds_report),
parents AS (
  SELECT 'order' AS target, {key_sql("order_id")} AS k, loaded_at AS a, removed_at AS b FROM order_register
  UNION ALL SELECT 'payment', {key_sql("payment_id")}, loaded_at, removed_at FROM payment_register
  UNION ALL SELECT 'upi', {key_sql("reference_utr")}, loaded_at, removed_at FROM upi_wallet_txns
  UNION ALL SELECT 'paypal', {key_sql("transaction_id")}, loaded_at, removed_at FROM paypal_statement)
SELECT DISTINCT table_name, row_id, field_name FROM refs r
WHERE r.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.target = r.target AND p.k = r.k AND p.a <= r.t AND (p.b IS NULL OR p.b > r.t))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p4_found": p4_found}
SQL = {"p1_found": P1_FOUND_SQL}
