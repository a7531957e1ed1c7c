"""Pools of records for the matching queries, derived from the orders table by rules on the order's key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Left rows: orders as bank credits.
PRIMARY = """
SELECT concat('P', CAST(o_orderkey AS STRING)) AS id, 'S1' AS statement_id, 'bank' AS source_name, CAST(o_orderdate AS DATE) AS txn_date, CAST(o_totalprice AS DECIMAL(18,2)) AS net_amount,
  'INR' AS currency, 'CREDIT' AS direction, CASE o_orderstatus WHEN 'P' THEN 'completed' ELSE 'settled' END AS status,
  CASE WHEN o_orderkey % 7 <> 0 THEN concat('NEFTCR-UTR', lpad(CAST(o_orderkey AS STRING), 8, '0')) END AS utr, CASE WHEN o_orderkey % 3 = 0 THEN concat('ORD', lpad(CAST(o_orderkey AS STRING), 8, '0')) END AS order_id,
  concat('NEFT CR ', o_orderpriority, ' ORD', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS description, lpad(CAST(o_orderkey AS STRING), 12, '0') AS ord, o_orderkey AS k
FROM orders
"""

#: Right rows: what the gateway says of them, with fees, lags, other currencies and failures by rule.
COUNTERPART = """
SELECT concat('C', CAST(o_orderkey AS STRING)) AS id, 'S2' AS statement_id, 'gateway' AS source_name, CAST(date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 6 AS INT)) AS DATE) AS txn_date,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) - 12.50 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS net_amount,
  CASE WHEN o_orderkey % 17 = 0 THEN 'USD' ELSE 'INR' END AS currency, 'CREDIT' AS direction, CASE WHEN o_orderkey % 23 = 0 THEN 'failed' ELSE 'captured' END AS status,
  CASE WHEN o_orderkey % 5 <> 0 THEN concat('UTR', lpad(CAST(o_orderkey AS STRING), 8, '0')) END AS utr, concat('ORD', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS order_id,
  concat('settlement of ', lower(o_orderpriority)) AS description, lpad(CAST(o_orderkey AS STRING), 12, '0') AS ord, o_orderkey AS k
FROM orders WHERE o_orderkey % 11 <> 0
"""

#: Reconciled rows: orders with the outcome of a run, by rule.
TRANSACTIONS = """
SELECT concat('T', CAST(o_orderkey AS STRING)) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'gateway' WHEN 2 THEN 'upi' ELSE 'orders' END AS source_name,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderkey % 10 < 4 THEN 'settled' WHEN o_orderkey % 10 < 6 THEN 'Matched' WHEN o_orderkey % 10 = 6 THEN 'similar' WHEN o_orderkey % 10 = 7 THEN 'manual' ELSE 'unmatched' END AS status,
  CAST(o_orderdate AS DATE) AS txn_date,
  CASE o_orderkey % 8 WHEN 0 THEN 'exact utr' WHEN 1 THEN 'tolerance fee' WHEN 2 THEN 'split n:1' WHEN 3 THEN 'order id' WHEN 4 THEN 'no match in overlap' WHEN 5 THEN 'date lag' WHEN 6 THEN 'manual override' ELSE 'duplicate amount' END AS rule,
  CAST((o_orderkey % 100) / 100.0 AS DOUBLE) AS score, CASE WHEN o_orderkey % 19 = 0 THEN 'USD' ELSE 'INR' END AS currency,
  CASE WHEN o_orderkey % 13 = 0 THEN 'self transfer' ELSE concat('payment ', lower(o_orderpriority)) END AS description,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat('UTR', CAST(o_orderkey % 5000 AS STRING)) END AS utr,
  CASE WHEN o_orderkey % 10 < 7 THEN concat('T', CAST(o_orderkey + 4 AS STRING)) END AS counterpart_id,
  CAST(CASE WHEN o_orderkey % 10 < 7 THEN CAST(o_totalprice AS DECIMAL(18,2)) - (o_orderkey % 3) * 40 END AS DECIMAL(18,2)) AS counterpart_amount,
  o_orderkey % 2 = 0 AS is_primary, o_orderkey % 29 = 0 AS duplicate, o_orderkey AS k
FROM orders
"""


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str, **frames: DataFrame) -> DataFrame:
    """Run SQL over tables of the folder and given frames."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables} | frames
    for name in named:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **named)


def primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PRIMARY, "orders")


def counterpart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, COUNTERPART, "orders")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, TRANSACTIONS, "orders")


#: The pools for DuckDB: the same text, dates moved in its way.
DUCK_COUNTERPART = COUNTERPART.replace("date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 6 AS INT))", "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INT)")
WITH_POOLS = f"WITH P AS ({PRIMARY}), C AS ({DUCK_COUNTERPART})"
WITH_T = f"WITH T AS ({TRANSACTIONS})"
