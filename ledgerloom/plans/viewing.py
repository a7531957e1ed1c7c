"""Queries of labels, tags, filters, enrichment and repaired rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import analytics as an
from ..operators import views
from .common import plain, typed
from .pools import WITH_T, sql, transactions
from .reporting import _FLAG_SQL, TAX


def engine_decision(spark, d):
    t = transactions(spark, d)
    stage = F.when(F.col("k") % 5 == 0, "exact").when(F.col("k") % 5 == 1, "ml").when(F.col("k") % 5 == 2, "split").otherwise("none")
    rule = F.when(F.col("k") % 3 == 0, F.col("rule"))
    return t.select("id", views.decision_label(tx.taxonomy(F.col("status")), F.col("status"), stage, F.lit(None), rule, F.lit("amounts differ by more than is allowed"), F.col("score")).alias("label"))


def _tagged(spark, d):
    t = transactions(spark, d)
    gap = F.abs(F.abs("amount") - F.abs(F.coalesce("counterpart_amount", "amount")))
    t = t.join(an.flagged(t), "id")
    return t.withColumn("tags", views.ui_tags(F.col("status"), F.col("rule").contains("utr"), F.col("k") % 4, gap, F.col("rule").contains("split"), F.col("currency"), F.col("flags")))


def ui_tags(spark, d):
    return plain(_tagged(spark, d).select("id", "tags"))


def ui_tag_bar(spark, d):
    return plain(views.offered_tags(_tagged(spark, d)))


def ui_filter(spark, d):
    return views.filter_view(_tagged(spark, d), "deposits", "amt_diff", "1997-").select("id")


def status_enrichment(spark, d):
    t = transactions(spark, d)
    known = t.where("k % 3 = 0").select(F.upper("id").alias("id"), tx.taxonomy(F.col("status")).alias("taxonomy"))
    rows = t.select(F.col("k").alias("key"), F.when(F.col("k") % 2 == 0, F.col("id")).alias("transaction_id"), F.col("counterpart_id").alias("utr"), "status")
    return views.enrich_first_hit(rows, known, "key", ["transaction_id", "utr"], F.col("status")).select("key", "taxonomy")


def row_repair(spark, d):
    o = sql(spark, d, "SELECT o_orderkey AS source_row_number, CASE o_orderkey % 4 WHEN 0 THEN concat('TX_RW_', CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('bank.csv_', CAST(o_orderkey AS STRING)) ELSE concat('ID', CAST(o_orderkey AS STRING)) END AS transaction_id, CASE WHEN o_orderkey % 3 = 0 THEN '(1,250.50)' END AS amount, CASE WHEN o_orderkey % 5 = 0 THEN '70.25' END AS credit, CASE WHEN o_orderkey % 10 = 0 THEN '20' END AS debit FROM orders", "orders")
    return plain(views.repaired(o).select("source_row_number", "transaction_id", "amount"))


def first_per_key(spark, d):
    u = spark.read.parquet(f"{d}/upi_wallet_txns.parquet").select("row_id", "merchant_id", "amount")
    return plain(views.first_per_key(u, ["merchant_id"], ["row_id"]).unionByName(views.first_per_key(u, ["merchant_id"], ["row_id"], last=True)))


QUERIES = {"engine_decision": engine_decision, "ui_tags": ui_tags, "ui_tag_bar": ui_tag_bar, "ui_filter": ui_filter, "status_enrichment": status_enrichment, "row_repair": row_repair, "first_per_key": first_per_key}
_TAGS = f"""{_FLAG_SQL}, Q AS (SELECT T.id, T.amount, T.txn_date, list_filter(['all', CASE lower(status) WHEN 'settled' THEN 'settled' WHEN 'matched' THEN 'auto' WHEN 'similar' THEN 'similar' WHEN 'unmatched' THEN 'unreconciled' WHEN 'manual' THEN 'exception' END,
 CASE WHEN contains(rule, 'utr') THEN 'utr_match' WHEN lower(status) IN ('manual', 'unmatched') THEN 'utr_mismatch' END, CASE WHEN k % 4 > 0 THEN 'date_gap' END, CASE WHEN abs(abs(amount) - abs(coalesce(counterpart_amount, amount))) > 0.01 THEN 'amt_diff' END,
 CASE WHEN contains(rule, 'split') THEN 'split_txn' END, CASE WHEN list_contains(flags, 'International Txn') OR currency IN ('USD', 'EUR', 'GBP') THEN 'intl_txn' END,
 {", ".join(f"CASE WHEN list_contains(flags, '{f}') THEN '{t}' END" for f, t in views._FLAG_TAGS.items())}], lambda x: x IS NOT NULL) AS tags FROM T JOIN G ON G.id = T.id)"""
_RANK = "[" + ", ".join(f"'{t}'" for t in views.TAG_ORDER) + "]"
SQL = {
    "engine_decision": f"""{WITH_T}, L AS (SELECT *, CASE k % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'ml' WHEN 2 THEN 'split' ELSE 'none' END AS stage FROM T)
 SELECT id, CASE WHEN k % 3 = 0 THEN concat('Rule: ', rule[1:24]) WHEN stage = 'exact' THEN 'Rule Engine: Exact UTR Match' WHEN stage = 'split' THEN 'Rule Engine: Split Settlement' WHEN stage = 'ml' THEN concat('ML Model', CASE WHEN score > 0 THEN printf(' (%.2f)', score) ELSE '' END)
 WHEN lower(status) = 'manual' THEN 'Manual Review Override' ELSE CASE {TAX} WHEN 'SETTLED' THEN 'Automated Settlement' WHEN 'MATCHED' THEN 'Rule Engine: Parity Match' WHEN 'SIMILAR' THEN 'Similarity Engine Review' ELSE 'amounts differ by more th' END END AS label FROM L""".replace("'amounts differ by more th'", "'amounts differ by more than is allowed'[1:26]"),
    "ui_tags": f"{_TAGS} SELECT id, array_to_string(tags, '|') AS tags FROM Q",
    "ui_tag_bar": typed(f"{_TAGS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM Q) GROUP BY 1 ORDER BY list_position({_RANK}, tag) LIMIT 8", tag="s", n="n"),
    "ui_filter": f"{_TAGS} SELECT id FROM Q WHERE amount > 0 AND list_contains(tags, 'amt_diff') AND strftime(txn_date, '%Y-') = '1997-'",
    "status_enrichment": typed(
        f"""{WITH_T}, K AS (SELECT lower(id) AS kid, {TAX} AS t FROM T WHERE k % 3 = 0) SELECT T.k AS key, coalesce(a.t, b.t, CASE WHEN lower(status) = 'settled' THEN 'MATCHED' ELSE {TAX} END) AS taxonomy FROM T LEFT JOIN K a ON T.k % 2 = 0 AND a.kid = lower(T.id) LEFT JOIN K b ON b.kid = lower(T.counterpart_id)""", key="n", taxonomy="s",
    ),
    "row_repair": typed(
        """SELECT o_orderkey AS source_row_number, CASE WHEN o_orderkey % 4 < 2 THEN 'BNK-TXN-' || CASE WHEN o_orderkey < 1000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END ELSE 'ID' || CAST(o_orderkey AS VARCHAR) END AS transaction_id,
 CASE WHEN o_orderkey % 3 = 0 THEN -1250.50 WHEN o_orderkey % 10 = 0 THEN 50.25 WHEN o_orderkey % 5 = 0 THEN 70.25 ELSE 0 END AS amount FROM orders""", source_row_number="n", transaction_id="s", amount="d",
    ),
    "first_per_key": typed("WITH R AS (SELECT row_id, merchant_id, amount, row_number() OVER (PARTITION BY merchant_id ORDER BY row_id) AS a, row_number() OVER (PARTITION BY merchant_id ORDER BY row_id DESC) AS b FROM upi_wallet_txns) SELECT row_id, merchant_id, amount FROM R WHERE a = 1 UNION ALL SELECT row_id, merchant_id, amount FROM R WHERE b = 1", row_id="n", merchant_id="s", amount="d"),
}
