"""Queries of summaries, exceptions, evaluation and search."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import analytics as an
from ..operators import learn, match, review
from ..operators.ingest import union_aligned
from .common import plain, typed
from .matching import KEYS
from .pools import WITH_T, counterpart, primary, sql, transactions

TODAY = datetime.date(2001, 8, 10)
TAX = "CASE WHEN lower(trim(status)) = 'settled' THEN 'SETTLED' WHEN lower(trim(status)) IN ('auto', 'matched') THEN 'MATCHED' WHEN lower(trim(status)) IN ('manual', 'llm', 'similar', 'review') THEN 'SIMILAR' ELSE 'UNMATCHED' END"
OPEN = "lower(status) IN ('exception', 'unmatched', 'unreconciled', 'manual', 'similar', 'review')"
DONE = "lower(status) IN ('settled', 'matched', 'auto', 'similar', 'llm')"


def _pct(a: str, b: str, digits: int = 1) -> str:
    return f"CASE WHEN {b} > 0 THEN round({a} * 100.0 / {b}, {digits}) ELSE 0 END"


def _q(build):
    return lambda spark, d: plain(build(spark, d))


def period_settlement(spark, d):
    t = transactions(spark, d)
    return plain(an.period_status(t, t.where(F.lower("status") == "unmatched").select(F.when(F.col("k") % 3 == 0, "resolved").alias("state"))))


def _results(spark, d):
    return sql(
        spark, d,
        """SELECT concat('S', CAST(l_orderkey AS STRING)) AS settlement_id, concat('B', CAST(l_partkey AS STRING)) AS bank_transaction_id, CASE l_linenumber % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'reconciler' WHEN 2 THEN 'tolerance_matcher' ELSE 'ml' END AS stage,
 CASE l_returnflag WHEN 'A' THEN 'matched' WHEN 'N' THEN 'review' ELSE 'non_match' END AS decision, CAST((l_orderkey % 100) / 100.0 AS DOUBLE) AS confidence,
 CASE l_partkey % 9 WHEN 0 THEN 'Refund open' WHEN 1 THEN 'ambiguous tie of two' WHEN 2 THEN 'insufficient data' WHEN 3 THEN 'status excluded' WHEN 4 THEN 'duplicate of another' WHEN 5 THEN 'no LLM result' ELSE 'amount differs' END AS reason FROM lineitem""",
        "lineitem",
    )


_RESULTS_SQL = """SELECT concat('S', CAST(l_orderkey AS STRING)) AS settlement_id, CASE l_linenumber % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'reconciler' WHEN 2 THEN 'tolerance_matcher' ELSE 'ml' END AS stage,
 CASE l_returnflag WHEN 'A' THEN 'matched' WHEN 'N' THEN 'review' ELSE 'non_match' END AS decision, (l_orderkey % 100) / 100.0 AS confidence, l_partkey % 9 AS r FROM lineitem"""
_EXC = """CASE WHEN r = 0 THEN 'open_refund' WHEN r = 1 THEN 'ambiguous_tie' WHEN r = 2 THEN 'insufficient_data' WHEN r = 3 THEN 'failed_status_excluded' WHEN r = 4 THEN 'duplicate_detected'
 WHEN decision = 'review' THEN CASE WHEN stage = 'llm' THEN 'llm_review' WHEN r = 5 THEN 'llm_unavailable' WHEN stage IN ('reconciler', 'tolerance_matcher') THEN 'unresolved' ELSE 'manual_review' END WHEN decision = 'non_match' THEN 'non_match' ELSE 'unknown' END"""
_PRIO = "CASE WHEN e IN ('llm_unavailable', 'unresolved', 'ambiguous_tie', 'insufficient_data', 'duplicate_detected') OR confidence < 0.70 THEN 'high' WHEN confidence < 0.85 THEN 'medium' ELSE 'low' END"


def exception_ledger(spark, d):
    return review.exception_ledger(_results(spark, d))


def _scored(spark, d):
    return sql(spark, d, "SELECT concat('S', CAST(floor(o_orderkey / 3) AS BIGINT)) AS id, CAST(o_custkey % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS score, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END AS label FROM orders", "orders")


_SCORED = "SELECT concat('S', CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING)) AS id, CAST(o_custkey % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS score, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END AS label FROM orders"


def _predicted(spark, d):
    return sql(spark, d, "SELECT concat('P', CAST(o_orderkey AS STRING), '|P', CAST(o_orderkey + 1 AS STRING)) AS l, concat('C', CAST(o_custkey AS STRING)) AS r FROM orders WHERE o_orderkey % 3 <> 0", "orders")


def prf_metrics(spark, d):
    truth = sql(spark, d, "SELECT concat('P', CAST(o_orderkey AS STRING)) AS a, concat('C', CAST(o_custkey AS STRING)) AS b FROM orders", "orders")
    return plain(an.precision_recall(an.pair_ids(_predicted(spark, d), "l", "r"), truth))


PRF_SQL = typed(
    """WITH T AS (SELECT DISTINCT o_orderkey AS a, o_custkey AS b FROM orders), P AS (SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey % 3 <> 0 UNION SELECT o_orderkey + 1, o_custkey FROM orders WHERE o_orderkey % 3 <> 0),
 N AS (SELECT count(*) FILTER (T.a IS NOT NULL AND P.a IS NOT NULL) AS tp, count(*) FILTER (T.a IS NULL) AS fp, count(*) FILTER (P.a IS NULL) AS fn FROM P FULL JOIN T ON P.a = T.a AND P.b = T.b)
 SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS f1 FROM N""",
    tp="n", fp="n", fn="n", precision="d", recall="d", f1="d",
)


def llm_accuracy(spark, d):
    return plain(an.decision_accuracy(sql(spark, d, "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'non_match' ELSE 'review' END AS decision, CAST(o_custkey % 2 AS INT) AS label FROM orders", "orders")))


def keyword_search(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return an.search(docs.select("doc_id", "text", "source"), ["chargeback", "refund", "utr"], ["text", "source"]).select("doc_id", "source")


def amount_range_search(spark, d):
    return an.amount_search(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", 250000.0, 5000.0).select("o_orderkey", "o_totalprice")


def record_lookup(spark, d):
    t = transactions(spark, d).select("id", "utr", "counterpart_id", "amount")
    return plain(an.lookup(t, " utr77 ", ["id", "utr", "counterpart_id"]).select("utr"))


def paged_sorted_list(spark, d):
    t = transactions(spark, d).select("id", "source_name", "amount")
    return plain(an.page(t, [F.lower("source_name"), F.desc("amount"), F.col("id")], 3, 50))


def union_align(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return plain(union_aligned([c, s]))


def set_difference(spark, d):
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("custkey")).subtract(o.select("o_custkey"))


def report_rows(spark, d):
    t = transactions(spark, d).drop("k")
    return plain(an.report_filter(t, ["SETTLED", "unmatched"], ["BANK", "upi"], datetime.date(1996, 1, 1), datetime.date(1999, 12, 31)).select("id", "source_name", "amount", "txn_date"))


def nearest_amount(spark, d):
    t = transactions(spark, d).select("id", F.abs("amount").alias("amount"), "k")
    return plain(an.nearest_amount(t.where("k % 2 = 0"), t.where("k % 2 = 1")).select("id", "amount_gap"))


def truth_labels(spark, d):
    pairs = match.exact_edges(primary(spark, d), counterpart(spark, d)).select("p_id", "c_id")
    truth = sql(spark, d, "SELECT concat('P', CAST(o_orderkey AS STRING)) AS a, concat('C', CAST(o_orderkey AS STRING)) AS b FROM orders WHERE o_orderkey % 4 <> 0", "orders")
    return plain(learn.label_by_truth(pairs, truth))


def sampled_negatives(spark, d):
    n = sql(spark, d, "SELECT concat('P', CAST(l_orderkey AS STRING)) AS p_id, concat('C', CAST(l_partkey AS STRING)) AS c_id FROM lineitem", "lineitem").distinct()
    return learn.sample_negatives(n).groupBy("p_id").agg(F.count(F.lit(1)).alias("n"))


def kpi_line(spark, d):
    return an.kpi_summary(transactions(spark, d))


QUERIES = {
    "kpi_summary": _q(kpi_line), "status_breakdown": _q(lambda s, d: an.status_breakdown(transactions(s, d))), "source_status_pivot": _q(lambda s, d: an.source_status(transactions(s, d))),
    "cascade_counts": _q(lambda s, d: an.cascade_counts(transactions(s, d))), "mismatch_reasons": _q(lambda s, d: an.mismatch_reasons(transactions(s, d))), "variance_histogram": _q(lambda s, d: an.variance_histogram(transactions(s, d))),
    "risk_matrix": _q(lambda s, d: an.risk_matrix(transactions(s, d), TODAY)), "gateway_performance": _q(lambda s, d: an.gateway_performance(transactions(s, d))), "feature_flags": _q(lambda s, d: an.flagged(transactions(s, d))),
    "tag_counts": _q(lambda s, d: an.tag_counts(an.flagged(transactions(s, d)))), "dup_signature_flag": _q(lambda s, d: an.duplicate_signatures(transactions(s, d))), "period_settlement": period_settlement,
    "period_compare": _q(lambda s, d: an.period_compare(transactions(s, d))), "settlement_rollup": _q(lambda s, d: an.settlement_rollup(_results(s, d))), "exception_summary": _q(lambda s, d: review.exception_summary(exception_ledger(s, d))),
    "scatter_points": _q(lambda s, d: an.scatter_points(transactions(s, d))), "funnel": _q(lambda s, d: an.funnel(transactions(s, d))), "exception_open_counts": _q(lambda s, d: review.open_counts(exception_ledger(s, d))),
    "exception_filter": _q(lambda s, d: review.exceptions_like(exception_ledger(s, d), "HIGH", "duplicate", True).select("settlement_id", "bank_transaction_id", "exception_type", "priority")),
    "exception_ledger": _q(exception_ledger), "prf_metrics": prf_metrics, "llm_accuracy": llm_accuracy, "confidence_bands": _q(lambda s, d: an.confidence_bands(_scored(s, d))), "brier": _q(lambda s, d: an.score_quality(_scored(s, d))),
    "best_second_margin": _q(lambda s, d: an.best_and_second(_scored(s, d))), "hard_cases": _q(lambda s, d: an.hard_cases(_scored(s, d))), "match_graph": _q(lambda s, d: an.links(transactions(s, d))), "settled_split": _q(lambda s, d: an.settled_split(transactions(s, d))),
    "keyword_search": keyword_search, "amount_range_search": amount_range_search, "record_lookup": record_lookup, "paged_sorted_list": paged_sorted_list, "union_align": union_align, "set_difference": set_difference, "report_filter": report_rows,
    "nearest_amount": nearest_amount, "truth_labels": truth_labels, "negative_sampling": sampled_negatives,
}

_FLAG_SQL = f"""{WITH_T}, U AS (SELECT *, trim(coalesce(utr, '')) AS u, lower(trim(status)) IN ('settled', 'matched') AS done FROM T),
 F AS (SELECT id, list_filter([CASE WHEN currency <> 'INR' OR regexp_matches(upper(description), '{"|".join(tx.ABROAD_WORDS)}') THEN 'International Txn' END, CASE WHEN contains(upper(description), 'SELF TRANSFER') THEN 'Internal Transfer' END,
  CASE WHEN contains(rule, 'manual') OR lower(status) = 'manual' THEN 'Manual Override' END, CASE WHEN done AND NOT contains(rule, 'manual') THEN CASE WHEN contains(rule, 'utr') AND u <> '' THEN 'Exact UTR Match' WHEN contains(rule, 'order') THEN 'Order ID Match' WHEN contains(rule, 'exact') THEN 'Exact Match' END END,
  CASE WHEN NOT done AND (u = '' OR lower(status) = 'unmatched') THEN 'Unmatched UTR' END, CASE WHEN contains(rule, 'fee') THEN 'Batch MDR Payout' END, CASE WHEN contains(rule, 'tolerance') THEN 'Digit Transposition' END, CASE WHEN duplicate THEN 'Duplicate Discrepancy' END], lambda x: x IS NOT NULL) AS f FROM U),
 G AS (SELECT id, CASE WHEN len(f) = 0 THEN ['Standard Commercial'] ELSE f END AS flags FROM F)"""
_ORDER = "[" + ", ".join(f"'{x}'" for x in tx.FLAG_ORDER) + "]"
SQL = {
    "kpi_summary": typed(
        f"""{WITH_T} SELECT count(*) AS total, {", ".join(f"count(*) FILTER ({TAX} = '{s}') AS n_{s.lower()}" for s in tx.TAXONOMY)}, {_pct(f"count(*) FILTER ({TAX} IN ('SETTLED', 'MATCHED'))", "count(*)")} AS match_rate,
 coalesce(sum(amount) FILTER (amount > 0), 0) AS deposits, coalesce(sum(-amount) FILTER (amount < 0), 0) AS payments, coalesce(sum(abs(amount)) FILTER ({TAX} = 'UNMATCHED'), 0) AS variance, min(txn_date) AS first_date, max(txn_date) AS last_date, true AS adds_up FROM T""",
        total="n", n_settled="n", n_matched="n", n_similar="n", n_unmatched="n", match_rate="d", deposits="d", payments="d", variance="d", first_date="t", last_date="t", adds_up="b",
    ),
    "status_breakdown": typed(f"{WITH_T} SELECT {TAX} AS taxonomy, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM T), 1) AS share FROM T GROUP BY 1", taxonomy="s", n="n", share="d"),
    "source_status_pivot": typed(f"""{WITH_T} SELECT source_name, {", ".join(f"count(*) FILTER ({TAX} = '{s}') AS \"{s}\"" for s in tx.TAXONOMY)}, count(*) AS total FROM T GROUP BY 1""", source_name="s", SETTLED="n", MATCHED="n", SIMILAR="n", UNMATCHED="n", total="n"),
    "cascade_counts": typed(
        f"""{WITH_T} SELECT CASE WHEN NOT {DONE} THEN 0 WHEN contains(rule, 'split') OR contains(rule, 'n:1') THEN 3 WHEN contains(rule, 'tolerance') OR contains(rule, 'fee') OR contains(rule, 'lag') THEN 2
 WHEN contains(rule, 'exact') OR contains(rule, 'utr') OR score >= 0.9 THEN 1 ELSE 2 END AS stage, count(*) AS n FROM T GROUP BY 1""", stage="n", n="n",
    ),
    "mismatch_reasons": typed(
        f"""{WITH_T}, O AS (SELECT * FROM T WHERE {OPEN}), R AS (SELECT unnest(CASE WHEN len(l) = 0 THEN ['Other'] ELSE l END) AS reason FROM (SELECT list_filter([CASE WHEN contains(rule, 'duplicate') OR duplicate THEN 'Duplicate Transaction' END,
 CASE WHEN regexp_matches(rule, 'amount|tolerance|fee') THEN 'Amount Mismatch' END, CASE WHEN regexp_matches(rule, 'date|time|lag') THEN 'Date/Time Mismatch' END, CASE WHEN regexp_matches(rule, 'reference|utr|narration') THEN 'Reference/UTR Mismatch' END,
 CASE WHEN regexp_matches(rule, 'no candidate|no match|overlap') THEN 'Missing Transaction' END], lambda x: x IS NOT NULL) AS l FROM O)) SELECT reason, count(*) AS n FROM R GROUP BY 1""", reason="s", n="n",
    ),
    "variance_histogram": typed(
        f"""{WITH_T}, B AS (SELECT CASE WHEN {DONE} AND counterpart_id IS NOT NULL THEN CASE WHEN g = 0 THEN '₹0 (Exact)' WHEN g <= 10 THEN '₹0–₹10' WHEN g <= 100 THEN '₹10–₹100' WHEN g <= 1000 THEN '₹100–₹1,000' ELSE '₹1,000+' END
 WHEN lower(status) IN ('exception', 'unmatched', 'unreconciled', 'manual') THEN '₹1,000+' END AS bucket FROM (SELECT *, abs(abs(amount) - abs(coalesce(counterpart_amount, amount))) AS g FROM T)) SELECT bucket, count(*) AS n FROM B WHERE bucket IS NOT NULL GROUP BY 1""", bucket="s", n="n",
    ),
    "risk_matrix": typed(
        f"""{WITH_T}, G AS (SELECT a.i AS amount_tier, b.i AS age_tier FROM range(4) a(i), range(4) b(i)), O AS (SELECT *, CASE WHEN abs(amount) < 1000 THEN 0 WHEN abs(amount) < 10000 THEN 1 WHEN abs(amount) < 100000 THEN 2 ELSE 3 END AS tier,
 greatest(DATE '{TODAY}' - txn_date, 0) AS days FROM T WHERE {OPEN}), X AS (SELECT tier, CASE WHEN days <= 2 THEN 0 WHEN days <= 7 THEN 1 WHEN days <= 14 THEN 2 ELSE 3 END AS ag, count(*) AS n, sum(abs(amount)) AS amount FROM O GROUP BY 1, 2)
 SELECT amount_tier, age_tier, coalesce(n, 0) AS n, coalesce(amount, 0) AS amount FROM G LEFT JOIN X ON tier = amount_tier AND ag = age_tier""", amount_tier="n", age_tier="n", n="n", amount="d",
    ),
    "gateway_performance": typed(
        f"""{WITH_T} SELECT source_name, count(*) AS total, count(*) FILTER ({DONE}) AS matched, {_pct(f"count(*) FILTER ({DONE})", "count(*)")} AS rate, coalesce(sum(abs(abs(amount) - abs(coalesce(counterpart_amount, amount)))) FILTER (counterpart_id IS NOT NULL), 0) AS fee_variance FROM T GROUP BY 1""",
        source_name="s", total="n", matched="n", rate="d", fee_variance="d",
    ),
    "feature_flags": f"{_FLAG_SQL} SELECT id, array_to_string(flags, '|') AS flags, list_filter({_ORDER}, lambda x: list_contains(flags, x))[1] AS primary_type FROM G",
    "tag_counts": f"{_FLAG_SQL} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM G) GROUP BY 1",
    "dup_signature_flag": f"""{WITH_T}, S AS (SELECT CASE WHEN utr IS NOT NULL THEN concat_ws('_', CAST(amount AS VARCHAR), strftime(txn_date, '%Y-%m-%d'), utr) ELSE concat_ws('_', source_name, CAST(amount AS VARCHAR), strftime(txn_date, '%Y-%m-%d'), description) END AS signature FROM T)
 SELECT signature, count(*) AS n FROM S GROUP BY 1 HAVING count(*) > 1""",
    "period_settlement": typed(
        f"""{WITH_T} SELECT count(*) FILTER (is_primary) AS n_primary, count(*) FILTER (is_primary AND lower(status) IN ('settled', 'matched', 'auto')) AS n_matched, count(*) FILTER (lower(status) = 'unmatched' AND k % 3 <> 0) AS n_open, false AS settled FROM T""",
        n_primary="n", n_matched="n", n_open="n", settled="b",
    ),
    "period_compare": typed(
        f"""{WITH_T}, M AS (SELECT CAST(date_trunc('month', txn_date) AS DATE) AS period, count(*) AS n, count(*) FILTER ({TAX} IN ('SETTLED', 'MATCHED')) AS n_matched, sum(abs(amount)) AS volume FROM T GROUP BY 1),
 R AS (SELECT *, round(n_matched * 100.0 / n, 2) AS match_rate FROM M)
 SELECT period, n, n_matched, match_rate, volume, n - lag(n) OVER w AS d_n, round(match_rate - lag(match_rate) OVER w, 2) AS d_rate, volume - lag(volume) OVER w AS d_volume FROM R WINDOW w AS (ORDER BY period)""",
        period="t", n="n", n_matched="n", match_rate="d", volume="d", d_n="n", d_rate="d", d_volume="d",
    ),
    "settlement_rollup": "WITH R AS (SELECT l_orderkey, max(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1) SELECT CASE r WHEN 2 THEN 'matched' WHEN 1 THEN 'manual_review' ELSE 'unmatched' END AS decision, count(*) AS n FROM R GROUP BY 1",
    "scatter_points": f"{WITH_T} SELECT id, txn_date AS date, CAST(abs(amount) AS DOUBLE) AS amount, lower(status) AS status, description[1:60] AS description FROM T WHERE txn_date IS NOT NULL",
    "funnel": f"""{WITH_T}, X AS (SELECT {TAX} AS t FROM T) SELECT CAST(1 AS BIGINT) AS place, 'Total Ingested' AS stage, count(*) AS n FROM X UNION ALL SELECT 2, 'Auto-Matched', count(*) FROM X WHERE t IN ('SETTLED', 'MATCHED')
 UNION ALL SELECT 3, 'Settled', count(*) FROM X WHERE t = 'SETTLED' UNION ALL SELECT 4, 'Similar (Review)', count(*) FROM X WHERE t = 'SIMILAR' UNION ALL SELECT 5, 'Unmatched', count(*) FROM X WHERE t = 'UNMATCHED'""",
    "exception_open_counts": f"WITH R AS ({_RESULTS_SQL}), E AS (SELECT *, {_EXC} AS e FROM R WHERE decision <> 'matched'), Q AS (SELECT {_PRIO} AS priority FROM E) SELECT count(*) AS n_open, count(*) FILTER (priority = 'high') AS n_high FROM Q",
    "exception_filter": f"WITH R AS ({_RESULTS_SQL.replace('FROM lineitem', ', concat(chr(66), CAST(l_partkey AS STRING)) AS bank_transaction_id FROM lineitem')}), E AS (SELECT *, {_EXC} AS e FROM R WHERE decision <> 'matched') SELECT settlement_id, bank_transaction_id, e AS exception_type, {_PRIO} AS priority FROM E WHERE {_PRIO} = 'high' AND contains(e, 'duplicate')",
    "exception_summary": f"WITH R AS ({_RESULTS_SQL}), E AS (SELECT *, {_EXC} AS e FROM R WHERE decision <> 'matched') SELECT e AS exception_type, {_PRIO} AS priority, 'open' AS state, count(*) AS n FROM E GROUP BY 1, 2, 3",
    "prf_metrics": PRF_SQL,
    "llm_accuracy": typed(
        """SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 < 2) AS n_decided, round(count(*) FILTER (o_orderkey % 3 < 2) * 100.0 / count(*), 2) AS coverage,
 round(count(*) FILTER ((o_orderkey % 3 = 0 AND o_custkey % 2 = 1) OR (o_orderkey % 3 = 1 AND o_custkey % 2 = 0)) * 100.0 / count(*) FILTER (o_orderkey % 3 < 2), 2) AS accuracy FROM orders""", n="n", n_decided="n", coverage="d", accuracy="d",
    ),
    "confidence_bands": typed(f"WITH S AS ({_SCORED}) SELECT CASE WHEN score <= 0.5 THEN 0 WHEN score <= 0.7 THEN 1 WHEN score <= 0.8 THEN 2 WHEN score <= 0.9 THEN 3 WHEN score <= 0.95 THEN 4 ELSE 5 END AS band, count(*) AS n FROM S GROUP BY 1", band="n", n="n"),
    "brier": typed(f"WITH S AS ({_SCORED}) SELECT round(avg(pow(label - score, 2)), 6) AS brier, round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(score) FILTER (label = 1), 6) AS mean_match, round(avg(score) FILTER (label = 0), 6) AS mean_other FROM S", brier="d", accuracy="d", mean_match="d", mean_other="d"),
    "best_second_margin": typed(f"WITH S AS ({_SCORED}), R AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC) AS p FROM S), G AS (SELECT id, max(score) AS best, coalesce(max(score) FILTER (p = 2), 0) AS second, count(*) AS n FROM R GROUP BY 1) SELECT id, best, second, round(best - second, 4) AS margin, n FROM G", id="s", best="d", second="d", margin="d", n="n"),
    "match_graph": f"{WITH_T} SELECT DISTINCT least(a.id, a.counterpart_id) AS a, greatest(a.id, a.counterpart_id) AS b FROM T a JOIN T b ON b.id = a.counterpart_id WHERE a.id <> a.counterpart_id",
    "settled_split": typed(f"{WITH_T} SELECT sum(abs(amount)) FILTER (upper(status) IN ('SETTLED', 'MATCHED')) AS settled, sum(abs(amount)) FILTER (upper(status) NOT IN ('SETTLED', 'MATCHED')) AS pending FROM T", settled="d", pending="d"),
    "keyword_search": "SELECT doc_id, source FROM documents WHERE regexp_matches(lower(concat_ws(' ', text, source)), 'chargeback|refund|utr')",
    "amount_range_search": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 245000 AND 255000",
    "record_lookup": "SELECT CASE WHEN count(*) > 0 THEN 'UTR77' END AS utr FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 5000 = 77",
    "paged_sorted_list": typed(f"{WITH_T} SELECT id, source_name, amount FROM T ORDER BY lower(source_name), amount DESC, id LIMIT 50 OFFSET 100", id="s", source_name="s", amount="d"),
    "union_align": typed("SELECT c_name AS name, c_acctbal AS balance, NULL AS nation FROM customer UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier", name="s", balance="d", nation="n"),
    "set_difference": "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "report_filter": typed(f"{WITH_T} SELECT id, source_name, amount, txn_date FROM T WHERE {TAX} IN ('SETTLED', 'UNMATCHED') AND source_name IN ('bank', 'upi') AND txn_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", id="s", source_name="s", amount="d", txn_date="t"),
    "nearest_amount": typed(
        f"""{WITH_T}, A AS (SELECT id, abs(amount) AS amount FROM T WHERE k % 2 = 0), B AS (SELECT DISTINCT abs(amount) AS amount FROM T WHERE k % 2 = 1), L AS (SELECT a.id, a.amount - b.amount AS g FROM A a ASOF LEFT JOIN B b ON a.amount >= b.amount),
 H AS (SELECT a.id, b.amount - a.amount AS g FROM A a ASOF LEFT JOIN B b ON a.amount <= b.amount) SELECT L.id, least(L.g, H.g) AS amount_gap FROM L JOIN H USING (id)""", id="s", amount_gap="d",
    ),
    "exception_ledger": typed(
        f"""WITH R AS ({_RESULTS_SQL.replace("FROM lineitem", ", concat('B', CAST(l_partkey AS STRING)) AS bank_transaction_id FROM lineitem")}), E AS (SELECT *, {_EXC} AS e FROM R WHERE decision <> 'matched'),
 N AS (SELECT *, {_PRIO} AS priority, CASE WHEN r = 0 THEN 'Refund open' WHEN r = 1 THEN 'ambiguous tie of two' WHEN r = 2 THEN 'insufficient data' WHEN r = 3 THEN 'status excluded' WHEN r = 4 THEN 'duplicate of another' WHEN r = 5 THEN 'no LLM result' ELSE 'amount differs' END AS reason FROM E),
 O AS (SELECT *, row_number() OVER (ORDER BY settlement_id, bank_transaction_id, stage, reason, decision, confidence) AS n FROM N)
 SELECT settlement_id, bank_transaction_id, stage, decision, confidence, reason, e AS exception_type, priority, 'open' AS state, NULL AS resolution, 'EXC-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS exception_id FROM O""",
        settlement_id="s", bank_transaction_id="s", stage="s", decision="s", confidence="d", reason="s", exception_type="s", priority="s", state="s", resolution="s", exception_id="s",
    ),
    "hard_cases": typed(f"WITH S AS ({_SCORED}) SELECT id, score, label, kind FROM (SELECT *, 'missed' AS kind FROM S WHERE label = 1 AND score < 0.9 ORDER BY score, id LIMIT 10) UNION ALL SELECT id, score, label, kind FROM (SELECT *, 'false' AS kind FROM S WHERE label = 0 AND score >= 0.9 ORDER BY score DESC, id LIMIT 10)", id="s", score="d", label="n", kind="s"),
    "truth_labels": typed(f"{KEYS} SELECT p_id, c_id, CASE WHEN CAST(p_id[2:] AS BIGINT) % 4 <> 0 AND p_id[2:] = c_id[2:] THEN 1 ELSE 0 END AS label FROM E", p_id="s", c_id="s", label="n"),
    "negative_sampling": "WITH N AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT concat('P', CAST(l_orderkey AS STRING)) AS p_id, least(count(*), 4) AS n FROM N GROUP BY l_orderkey",
}
