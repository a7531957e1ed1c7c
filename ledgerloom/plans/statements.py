"""Queries of reading, cleaning, mapping and deduplicating statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, dates, text
from ..operators import ingest
from .common import plain, tokens_sql, typed
from .pools import sql


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def parse_numeric_forms(spark, d):
    b = _table(spark, d, "bank_statement")
    return plain(b.select("row_id", *[clean.parse_numeric(F.col(c)).alias(c) for c in ("withdrawal_dr", "deposit_cr", "balance")]))


def _numeric_sql(c: str) -> str:
    s = f"trim({c})"
    inner = f"trim(CASE WHEN regexp_full_match({s}, '\\(.*\\)') THEN {s}[2:-2] ELSE {s} END)"
    body = f"regexp_replace(regexp_replace({inner}, '(?i)\\s*(dr|cr)$', ''), '[^0-9.\\-]', '', 'g')"
    value = f"CAST(CASE WHEN regexp_full_match({body}, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN {body} END AS DECIMAL(18,2))"
    return f"CASE WHEN (regexp_full_match({s}, '\\(.*\\)') OR regexp_matches({inner}, '(?i)dr$')) AND {value} > 0 THEN -{value} ELSE {value} END"


def canonical_bank(spark, d):
    b = _table(spark, d, "bank_statement")
    mapped, _ = ingest.map_columns([c for c in b.columns if c not in ("row_id", "batch_no", "loaded_at", "feed_code", "merchant_id", "balance")])
    out = ingest.canonical(b, mapped, "BNK", F.col("row_id") - 19_999_990_000)
    return plain(out.select("transaction_id", "utr", "net_amount", "direction", "currency", "source_row_number"))


CANONICAL_SQL = typed(
    f"""WITH B AS (SELECT row_id - 19999990000 AS n, trim(ref_utr) AS ref, trim(description) AS des, {_numeric_sql("withdrawal_dr")} AS dr, {_numeric_sql("deposit_cr")} AS cr FROM bank_statement),
 V AS (SELECT *, CASE WHEN ref IS NOT NULL AND lower(ref) NOT IN ('', 'nan', 'none', 'null', 'unknown', 'n/a', 'na', '—', '-', 'undefined') THEN ref END AS good,
  CASE WHEN cr IS NOT NULL OR dr IS NOT NULL THEN coalesce(cr, 0) - coalesce(dr, 0) END AS net FROM B),
 U AS (SELECT *, coalesce(good, nullif(regexp_extract(des, '(?i)\\b(?:NEFT|UTR|RRN)?([A-Z0-9]{{12,18}})\\b', 1), ''), nullif(regexp_extract(des, '(?i)\\b(NEFT[A-Z0-9]+)\\b', 1), ''), nullif(regexp_extract(des, '(?i)\\b(RRN[0-9]{{10,12}})\\b', 1), '')) AS utr FROM V)
 SELECT coalesce(utr, 'BNK-TXN-' || printf('%04d', n)) AS transaction_id, utr, net AS net_amount,
  CASE WHEN cr > 0 AND coalesce(dr, 0) = 0 THEN 'CREDIT' WHEN dr > 0 AND coalesce(cr, 0) = 0 THEN 'DEBIT' WHEN net >= 0 THEN 'CREDIT' WHEN net < 0 THEN 'DEBIT' END AS direction, 'INR' AS currency, n AS source_row_number FROM U""",
    transaction_id="s", utr="s", net_amount="d", direction="s", currency="s", source_row_number="n",
)


def identifier_backfill(spark, d):
    o = sql(spark, d, "SELECT o_orderkey AS k, concat('paid via NEFT', lpad(CAST(o_orderkey AS STRING), 12, '0'), ' for order_', CAST(o_orderkey % 1000 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ' setl_77' ELSE '' END) AS des, CASE WHEN o_orderkey % 2 = 0 THEN 'nan' WHEN o_orderkey % 5 = 0 THEN '2024-01-05' ELSE concat('ORD', CAST(o_orderkey AS STRING)) END AS oid FROM orders", "orders")
    f = lambda c, p: clean.backfill(c, F.col("des"), p)
    none = F.lit(None).cast("string")
    return plain(o.select("k", f(F.col("oid"), clean.ORDER_PATTERNS).alias("order_id"), f(none, clean.UTR_PATTERNS).alias("utr"), f(none, clean.SETTLEMENT_PATTERNS).alias("settlement_id")))


def content_hash(spark, d):
    g = _table(spark, d, "lineitem")
    c = lambda n: F.col(n).cast("string")
    h = clean.content_hash(F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_extendedprice").cast("decimal(18,2)"), c("l_partkey"), c("l_orderkey"), F.col("l_returnflag"), c("l_suppkey"))
    return plain(g.select("l_orderkey", "l_linenumber", h.alias("hash")))


def _marked(spark, d):
    u = _table(spark, d, "upi_wallet_txns").select("row_id", F.nullif(F.trim("transaction_id"), F.lit("")).alias("transaction_id"), F.concat_ws("|", "merchant_id", "amount", F.col("txn_date").cast("string"), "customer_name").alias("content"))
    return ingest.mark_duplicates(u, "row_id", ["transaction_id", "content"])


def dedupe_first_wins(spark, d):
    return _marked(spark, d).select("row_id", "dup_kind")


def dedupe_report(spark, d):
    return plain(ingest.duplicate_report(_marked(spark, d)))


_DEDUPE = """WITH U AS (SELECT row_id, nullif(trim(transaction_id), '') AS transaction_id, concat_ws('|', merchant_id, CAST(amount AS VARCHAR), CAST(txn_date AS VARCHAR), customer_name) AS content FROM upi_wallet_txns),
 A AS (SELECT *, transaction_id IS NOT NULL AND row_id > min(row_id) OVER (PARTITION BY transaction_id) AS d1 FROM U), B AS (SELECT row_id, row_id > min(row_id) OVER (PARTITION BY content) AS d2 FROM A WHERE NOT d1),
 M AS (SELECT A.row_id, CASE WHEN d1 THEN 'transaction_id' WHEN d2 THEN 'content' END AS dup_kind FROM A LEFT JOIN B USING (row_id))"""


def duplicate_columns(spark, d):
    li = _table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_orderkey").cast("string").alias("order_copy"), "l_returnflag", F.lower("l_returnflag").alias("flag_copy"), F.concat(F.lit("$"), "l_partkey").alias("part_copy"))
    return ingest.duplicate_columns(li)


def summary_row_filter(spark, d):
    o = sql(spark, d, "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 'Total' WHEN o_orderkey % 51 = 0 THEN 'Grand Total: 5' WHEN o_orderkey % 52 = 0 THEN 'totally fine' ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 53 = 0 THEN ' closing balance ' ELSE o_orderstatus END AS b FROM orders", "orders")
    return o.where(~ingest.is_summary_row(F.col("a"), F.col("b"))).select("k")


def eligibility_split(spark, d):
    u = ingest.eligibility(_table(spark, d, "upi_wallet_txns").select("row_id", "status"))
    return u.select("row_id", "eligible", "excluded_reason")


def quality_report(spark, d):
    return plain(ingest.quality_report(_table(spark, d, "upi_wallet_txns"), ["transaction_id", "reference_utr", "order_id", "customer_name", "removed_at"]))


def channel_scores(spark, d):
    return plain(ingest.channel_scores(_table(spark, d, "bank_statement"), "02_neft_statement.csv", ["description", "ref_utr"]))


def append_without_known(spark, d):
    s = _table(spark, d, "paypal_statement").select("transaction_id", "order_id")
    return ingest.append_new(s.where("transaction_id < 'PP5'").distinct(), s.where("transaction_id > 'PP3'"), "transaction_id").select("transaction_id")


def status_registry(spark, d):
    return _table(spark, d, "upi_wallet_txns").select("row_id", clean.registry(clean.clean_text(F.col("status")), clean.STATUS).alias("status"))


def date_parse_multi(spark, d):
    o = sql(spark, d, "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'dd-MM-yyyy') WHEN 3 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE 'pending' END AS s FROM orders", "orders")
    return o.select("k", dates.parse_date(F.col("s")).alias("date"))


def business_days(spark, d):
    o = sql(spark, d, "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, date_add(CAST(o_orderdate AS DATE), CAST(o_custkey % 40 AS INT) - 20) AS b FROM orders", "orders")
    return plain(o.select("k", dates.business_days(F.col("a"), F.col("b")).alias("n")))


def narration_tokens(spark, d):
    p = _table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    a, b = text.tokens(F.col("p_name")), text.tokens(F.col("p_type"))
    return plain(p.select("p_partkey", F.array_sort(a).alias("words"), F.round(text.token_jaccard(a, b), 4).alias("jaccard")))


def pattern_keys(spark, d):
    return _table(spark, d, "bank_statement").select("row_id", clean.pattern_key(F.concat_ws(" ", "description", "ref_utr")).alias("key"))


def header_mapping(spark, d):
    rows = []
    for name in ("bank_statement", "gateway_settlements", "upi_wallet_txns", "refunds_report", "cash_ledger"):
        mapped, missing = ingest.map_columns(_table(spark, d, name).columns)
        rows += [(name, m.column, m.field, m.method, m.confidence) for m in mapped] + [(name, h, None, "none", 0.0) for h in missing]
    return spark.createDataFrame(rows, "table_name string, header string, field string, method string, confidence double")


QUERIES = {
    "parse_numeric_forms": parse_numeric_forms, "canonical_projection": canonical_bank, "identifier_backfill": identifier_backfill, "content_hash": content_hash, "dedupe_first_wins": dedupe_first_wins, "dedupe_report": dedupe_report,
    "duplicate_columns": duplicate_columns, "summary_row_filter": summary_row_filter, "eligibility_split": eligibility_split, "quality_report": quality_report, "channel_scores": channel_scores, "append_new_rows": append_without_known,
    "status_registry": status_registry, "date_parse_multi": date_parse_multi, "business_days": business_days, "narration_tokens": narration_tokens, "pattern_keys": pattern_keys, "header_mapping": header_mapping,
}

_STATUS_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in clean.STATUS.items())




SQL = {
    "parse_numeric_forms": typed(f"SELECT row_id, {', '.join(f'{_numeric_sql(c)} AS {c}' for c in ('withdrawal_dr', 'deposit_cr', 'balance'))} FROM bank_statement", row_id="n", withdrawal_dr="d", deposit_cr="d", balance="d"),
    "canonical_projection": CANONICAL_SQL,
    "identifier_backfill": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 THEN concat('order_', CAST(o_orderkey % 1000 AS VARCHAR)) ELSE concat('ORD', CAST(o_orderkey AS VARCHAR)) END AS order_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS utr,
 CASE WHEN o_orderkey % 3 = 0 THEN 'setl_77' END AS settlement_id FROM orders""",
    "content_hash": typed("SELECT l_orderkey, l_linenumber, sha256(concat_ws('|', CAST(l_suppkey AS VARCHAR), l_returnflag, CASE WHEN CAST(l_extendedprice AS DECIMAL(18,2)) <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) ELSE '' END, CAST(l_orderkey AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d'), CAST(l_partkey AS VARCHAR)))[1:16] AS hash FROM lineitem", l_orderkey="n", l_linenumber="n", hash="s"),
    "dedupe_first_wins": f"{_DEDUPE} SELECT row_id, dup_kind FROM M",
    "dedupe_report": typed(f"{_DEDUPE} SELECT count(*) AS total, count(*) - count(dup_kind) AS n_unique, count(dup_kind) AS n_duplicate, count(dup_kind) >= 0.8 * count(*) AS duplicate_upload FROM M", total="n", n_unique="n", n_duplicate="n", duplicate_upload="b"),
    "duplicate_columns": "SELECT * FROM (VALUES ('l_orderkey', 'order_copy'), ('l_returnflag', 'flag_copy'), ('l_partkey', 'part_copy')) AS v(kept, dropped)",
    "summary_row_filter": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 50 <> 0 AND (o_orderkey % 51 <> 0 OR o_orderkey % 50 = 0) AND o_orderkey % 53 <> 0",
    "eligibility_split": f"""WITH S AS (SELECT row_id, CASE WHEN status IS NOT NULL THEN CASE lower(trim(status)) {_STATUS_CASE} ELSE 'UNKNOWN' END END AS st FROM upi_wallet_txns)
 SELECT row_id, coalesce(st NOT IN ('FAILED', 'DECLINED', 'CANCELLED', 'PENDING', 'REJECTED'), true) AS eligible, CASE WHEN st IN ('FAILED', 'DECLINED', 'CANCELLED', 'PENDING', 'REJECTED') THEN 'status excluded: ' || st END AS excluded_reason FROM S""",
    "quality_report": typed(
        "WITH F AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) FILTER ({c} IS NOT NULL AND lower(trim(CAST({c} AS VARCHAR))) NOT IN ('', 'nan', 'none', 'null', 'undefined', '—', '-')) AS f FROM upi_wallet_txns" for c in ("transaction_id", "reference_utr", "order_id", "customer_name", "removed_at"))
        + ") SELECT field, n AS n_rows, n - f AS n_missing, round(CAST(f AS DOUBLE) / n, 4) AS fill_rate, n >= 5 AND round(CAST(f AS DOUBLE) / n, 4) < 0.3 AS sparse FROM F", field="s", n_rows="n", n_missing="n", fill_rate="d", sparse="b",
    ),
    "channel_scores": typed(
        """WITH H AS (SELECT count(*) AS n, count(*) FILTER (regexp_matches(r, '@upi|@ybl|@ok|@icici|@axl')) AS u, count(*) FILTER (regexp_matches(r, 'visa|mastercard|rupay|amex')) AS c, count(*) FILTER (regexp_matches(r, '\\bneft\\b|neftcr')) AS f, count(*) FILTER (regexp_matches(r, 'cash deposit|petty cash')) AS s
 FROM (SELECT lower(concat_ws(' ', description, ref_utr)) AS r FROM bank_statement)) SELECT channel, round(base + 0.2 * CAST(x AS DOUBLE) / n, 4) AS score FROM (SELECT n, 'UPI' AS channel, u AS x, 0.0 AS base FROM H UNION ALL SELECT n, 'CARD', c, 0.0 FROM H UNION ALL SELECT n, 'NEFT', f, 0.35 FROM H UNION ALL SELECT n, 'CASH', s, 0.0 FROM H)""",
        channel="s", score="d",
    ),
    "append_new_rows": "SELECT transaction_id FROM (SELECT DISTINCT transaction_id, order_id FROM paypal_statement WHERE transaction_id < 'PP5') UNION ALL SELECT DISTINCT transaction_id FROM paypal_statement WHERE transaction_id >= 'PP5'",
    "status_registry": f"SELECT row_id, CASE WHEN lower(trim(status)) NOT IN ('', 'nan', 'none', 'null', 'undefined', '—', '-') THEN CASE lower(trim(status)) {_STATUS_CASE} ELSE 'UNKNOWN' END END AS status FROM upi_wallet_txns",
    "date_parse_multi": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders",
    "business_days": typed(
        """WITH O AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 AS INT) - 20 AS b FROM orders)
 SELECT k, len(list_filter(range(0, CAST(abs(b - a) AS BIGINT)), lambda i: isodow(least(a, b) + CAST(i AS INT) + 1) <= 5)) AS n FROM O""", k="n", n="n",
    ),
    "narration_tokens": f"""WITH T AS (SELECT p_partkey, {tokens_sql("p_name")} AS a, {tokens_sql("p_type")} AS b FROM part)
 SELECT p_partkey, array_to_string(list_sort(a), '|') AS words, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))), 4) ELSE 0 END AS jaccard FROM T""",
    "pattern_keys": "SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(concat_ws(' ', description, ref_utr))), '\\b[a-f0-9]{8,}\\b', '', 'g'), '\\b[0-9]{6,}\\b', '', 'g'), '\\s+', ' ', 'g')) AS key FROM bank_statement",
}
