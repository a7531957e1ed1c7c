"""Queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.dataprep import key_sql, load
from .bpe import encode_corpus
from .history import repeats_found
from .mixing import mix, mix_shares, temperature_report
from .names import variants_found
from .nearest import settlement_credits
from .splitting import oversized, split_documents


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "upi_wallet_txns", "cash_ledger", "vendor_register")
    return variants_found(t["upi_wallet_txns"], t["cash_ledger"], t["vendor_register"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "gateway_settlements", "bank_statement", "feed_profiles")
    return settlement_credits(t["gateway_settlements"], t["bank_statement"], t["feed_profiles"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "upi_wallet_txns", "gateway_settlements")
    return repeats_found(t["upi_wallet_txns"], t["gateway_settlements"])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents")["documents"])


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "documents", "mix_targets")
    return mix(t["documents"], t["mix_targets"])


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "documents", "mix_targets")
    return mix_shares(mix(t["documents"], t["mix_targets"]), t["mix_targets"])


def p7_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "documents", "mix_targets")
    return temperature_report(t["documents"], t["mix_targets"])


def _limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, int, int]]:
    """The limits: a list of settings with as many rows as there are limits."""
    return [tuple(r) for r in load(spark, sf_dir, "piece_limits")["piece_limits"].select("limit_name", "tokenizer", "max_tokens", "overlap_tokens").collect()]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(load(spark, sf_dir, "documents")["documents"], _limits(spark, sf_dir), "wide")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(load(spark, sf_dir, "documents")["documents"], _limits(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_temperature": p7_temperature, "p8_found": p8_found, "p8_pieces": p8_pieces}
#: Pairs within an account and amount, closed by reachability.
P5_FOUND_SQL = f"""
WITH RECURSIVE R AS (SELECT 'upi_wallet_txns' AS t, row_id, merchant_id AS m, amount AS c, {key_sql("transaction_id")} AS n0, {key_sql("reference_utr")} AS n1 FROM upi_wallet_txns
  UNION ALL SELECT 'gateway_settlements', row_id, merchant_id, net_amount, {key_sql("utr")}, NULL FROM gateway_settlements),
E AS (SELECT a.t, a.row_id AS x, b.row_id AS y FROM R a JOIN R b ON a.t = b.t AND a.m = b.m AND a.c = b.c AND a.row_id < b.row_id AND (damerau_levenshtein(a.n0, b.n0) <= 1 OR damerau_levenshtein(a.n1, b.n1) <= 1)),
U AS (SELECT t, x, y FROM E UNION SELECT t, y, x FROM E),
C AS (SELECT t, x AS id, y AS r FROM U UNION SELECT C.t, C.id, U.y FROM C JOIN U ON U.x = C.r)
SELECT t AS table_name, min(r) AS row_id_a, id AS row_id_b FROM C GROUP BY t, id HAVING min(r) < id
"""
SQL = {"p5_found": P5_FOUND_SQL}
