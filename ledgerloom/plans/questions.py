"""Queries of the run's view, single-record questions and display values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import learn, match, qa
from .common import plain, typed
from .matching import FEATURES_SQL, KEYS, _feature_pairs
from .pools import WITH_POOLS, WITH_T, counterpart, primary, transactions
from .reporting import _SCORED, TAX, _pct, _scored


def dashboard_run(spark, d):
    p, c = primary(spark, d), counterpart(spark, d)
    found = match.exact_match(p, c).select("p_id", "c_id", F.lit("exact").alias("stage"), F.lit("SETTLED").alias("status"), "confidence")
    records = p.select("id", F.col("net_amount").alias("amount")).unionByName(c.select("id", F.col("net_amount").alias("amount")))
    return plain(qa.run_view(records, found))


def smart_match(spark, d):
    t = transactions(spark, d).select("id", "amount", "txn_date", F.lit(None).cast("string").alias("utr"), "k").where("amount > 0")
    return plain(qa.smart_match(t.where("k % 2 = 0"), t.where("k % 2 = 1"), 500.0, 60).select("id", "amount_gap"))


def explain_pairs(spark, d):
    p, c = primary(spark, d), counterpart(spark, d)
    one = lambda df, x: df.select("k", *[F.col(a).alias(x + b) for a, b in (("id", "id"), ("net_amount", "amount"), ("txn_date", "txn_date"), ("order_id", "utr"), ("description", "description"))])
    return plain(qa.explain(one(p, "p_").join(one(c, "c_"), "k")).select("p_id", "c_id", "amount_match", "date_match", "reference_match", "verdict"))


def keyword_search_stats(spark, d):
    return plain(qa.search_stats(an.search(transactions(spark, d), ["transfer", "urgent"], ["description"])))


def serial_numbers(spark, d):
    t = transactions(spark, d).select(F.col("source_name").alias("statement_id"), "k")
    return qa.number_rows(t, "k").select("k", "serial_no")


def confusion_matrix(spark, d):
    return plain(qa.confusion(_scored(spark, d)))


def weak_labels(spark, d):
    return plain(learn.weak_label(_feature_pairs(spark, d)).select("settlement_id", "label"))


def display_dates(spark, d):
    return transactions(spark, d).select("id", qa.display_date(F.col("txn_date")).alias("shown"))


QUERIES = {
    "dashboard_run": dashboard_run, "smart_match": smart_match, "explain_pairs": explain_pairs, "keyword_search_stats": keyword_search_stats, "serial_numbers": serial_numbers, "confusion_matrix": confusion_matrix, "weak_labels": weak_labels, "display_dates": display_dates,
}
SQL = {
    "dashboard_run": typed(
        f"""{KEYS}, R AS (SELECT id, net_amount FROM P UNION ALL SELECT id, net_amount FROM C), X AS (SELECT p_id AS id, c_id AS other FROM E UNION ALL SELECT c_id, p_id FROM E)
 SELECT R.id, net_amount AS amount, other AS counterpart_id, CASE WHEN other IS NULL THEN 'none' ELSE 'exact' END AS match_stage, CASE WHEN other IS NULL THEN 0 ELSE 1 END AS match_confidence, CASE WHEN other IS NULL THEN 'UNMATCHED' ELSE 'SETTLED' END AS taxonomy FROM R LEFT JOIN X USING (id)""",
        id="s", amount="d", counterpart_id="s", match_stage="s", match_confidence="d", taxonomy="s",
    ),
    "smart_match": typed(
        f"{WITH_T}, O AS (SELECT id, amount, txn_date, k FROM T WHERE amount > 0) SELECT a.id, min(abs(a.amount - b.amount)) AS amount_gap FROM O a JOIN O b ON a.k % 2 = 0 AND b.k % 2 = 1 AND abs(a.amount - b.amount) <= 500 AND abs(a.txn_date - b.txn_date) <= 60 GROUP BY 1", id="s", amount_gap="d",
    ),
    "explain_pairs": typed(
        f"""{WITH_POOLS}, J AS (SELECT p.id AS p_id, c.id AS c_id, greatest(0, round(100 - CAST(abs(p.net_amount - c.net_amount) AS DOUBLE) / greatest(1, CAST(abs(p.net_amount) AS DOUBLE)) * 100, 1)) AS amount_match, greatest(0, 100 - 15 * abs(p.txn_date - c.txn_date)) AS date_match,
  coalesce(p.order_id = c.order_id, false) AS same FROM P p JOIN C c ON p.k = c.k)
 SELECT p_id, c_id, amount_match, date_match, CASE WHEN same THEN 100 ELSE 40 END AS reference_match, CASE WHEN same AND amount_match >= 95 THEN 'same reference' WHEN amount_match = 100 AND date_match >= 40 THEN 'same amount' WHEN amount_match >= 95 THEN 'like amount' ELSE 'different' END AS verdict FROM J""",
        p_id="s", c_id="s", amount_match="d", date_match="n", reference_match="n", verdict="s",
    ),
    "keyword_search_stats": typed(
        f"""{WITH_T}, H AS (SELECT * FROM T WHERE contains(lower(description), 'transfer') OR contains(lower(description), 'urgent')) SELECT count(*) AS n, sum(amount) AS total, count(*) FILTER ({TAX} IN ('SETTLED', 'MATCHED')) AS n_matched, {_pct(f"count(*) FILTER ({TAX} IN ('SETTLED', 'MATCHED'))", "count(*)")} AS match_rate,
 sum(abs(amount)) FILTER ({TAX} NOT IN ('SETTLED', 'MATCHED')) AS open_amount, array_to_string(list_sort(list(DISTINCT lower(status))), '|') AS statuses FROM H""", n="n", total="d", n_matched="n", match_rate="d", open_amount="d", statuses="s",
    ),
    "serial_numbers": f"{WITH_T}, N AS (SELECT k, dense_rank() OVER (ORDER BY source_name) - 1 AS s, row_number() OVER (PARTITION BY source_name ORDER BY k) AS n FROM T) SELECT k, 'AA' || chr(CAST(65 + s AS INT)) || '-' || CAST(n AS VARCHAR) AS serial_no FROM N",
    "confusion_matrix": typed(
        f"""WITH S AS ({_SCORED}), C AS (SELECT count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp FROM S)
 SELECT *, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 4) AS accuracy, CASE WHEN tp + fp > 0 THEN round(CAST(tp AS DOUBLE) / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(CAST(tp AS DOUBLE) / (tp + fn), 4) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn), 4) ELSE 0 END AS f1 FROM C""",
        tn="n", fp="n", fn="n", tp="n", accuracy="d", precision="d", recall="d", f1="d",
    ),
    "weak_labels": typed(
        f"""WITH F AS ({FEATURES_SQL}) SELECT settlement_id, CASE WHEN utr_match = 1 OR order_id_exact = 1 OR (amount_difference_pct <= 0.15 AND date_difference_days <= 7) THEN 1 ELSE 0 END AS label FROM F""", settlement_id="s", label="n",
    ),
    "display_dates": f"{WITH_T} SELECT id, strftime(txn_date, '%d/%m/%Y') AS shown FROM T",
}
