"""Queries of the matching operators over the derived pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import REFERENCE_PREFIXES, MatchConfig
from ..functions import dates, score
from ..functions.clean import _quoted, normal_reference
from ..operators import learn, match, review
from .common import plain, tokens_sql, typed
from .pools import WITH_POOLS, counterpart, primary, sql

CFG = MatchConfig()


def _four(x: str) -> str:
    return f"floor((CAST({x} AS DOUBLE) + 1e-9) * 10000 + 0.5) / 10000"


def _norm_sql(c: str) -> str:
    once = "".join(f"(?:{_quoted(p)})?" for p in REFERENCE_PREFIXES)
    return f"regexp_replace(regexp_replace(upper(trim(coalesce({c}, ''))), '^(?:{once})+', ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _registry_sql(c: str) -> str:
    from ..functions.clean import STATUS

    return f"CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'UNKNOWN' END"


COMPATIBLE = f"""(p.source_name <> c.source_name AND p.statement_id <> c.statement_id AND p.id <> c.id AND p.currency = c.currency
  AND {_registry_sql("p.status")} NOT IN ('FAILED','DECLINED','CANCELLED','PENDING','REJECTED') AND {_registry_sql("c.status")} NOT IN ('FAILED','DECLINED','CANCELLED','PENDING','REJECTED'))"""
AGREE = "(abs(p.net_amount - c.net_amount) <= 1.00 OR abs(p.net_amount - c.net_amount) <= greatest(100.0, 0.035 * greatest(abs(p.net_amount), abs(c.net_amount))))"
KEYS = f"""{WITH_POOLS},
PK AS (SELECT id, 0 AS tier, {_norm_sql("utr")} AS key FROM P UNION SELECT id, 4, {_norm_sql("order_id")} FROM P UNION SELECT id, 4, {_norm_sql("id")} FROM P),
CK AS (SELECT id, 0 AS tier, {_norm_sql("utr")} AS key FROM C UNION SELECT id, 4, {_norm_sql("order_id")} FROM C UNION SELECT id, 4, {_norm_sql("id")} FROM C),
E AS (SELECT p.id AS p_id, c.id AS c_id, min(pk.tier) AS tier, min(abs(abs(p.net_amount) - abs(c.net_amount))) AS amount_gap
  FROM PK pk JOIN CK ck ON pk.tier = ck.tier AND pk.key = ck.key AND length(pk.key) >= 5 JOIN P p ON p.id = pk.id JOIN C c ON c.id = ck.id WHERE {COMPATIBLE} AND {AGREE} GROUP BY 1, 2)"""


def exact_tiered_join(spark, d):
    return plain(match.exact_edges(primary(spark, d), counterpart(spark, d)).select("p_id", "c_id", "tier", "amount_gap"))


def exact_match(spark, d):
    return plain(match.exact_match(primary(spark, d), counterpart(spark, d)))


def reference_normalize(spark, d):
    bank = spark.read.parquet(f"{d}/bank_statement.parquet")
    return bank.select("row_id", normal_reference(F.col("ref_utr")).alias("reference"), normal_reference(_chained(F.col("row_id"), F.col("ref_utr"))).alias("behind_chain"))


def _chained(k, ref):
    """A reference behind up to five prefixes, by the row's number."""
    parts = ["REF:", "UTR-", "UPI", "NEFTCR-", "SETTLEMENT-"]
    return F.concat(*[F.when(k % (n + 2) != 0, F.lit(p)).otherwise(F.lit("")) for n, p in enumerate(parts)], F.coalesce(ref, F.lit("12345")))


def desc_substring_join(spark, d):
    return match.description_pairs(primary(spark, d), counterpart(spark, d))


def _coarse(df):
    """Amounts to the next hundred, so that several rows share one."""
    return df.withColumn("net_amount", (F.floor(F.col("net_amount") / 100) * 100).cast("decimal(18,2)"))


def unique_amount_date(spark, d):
    return plain(match.unique_amount_date(_coarse(primary(spark, d)), _coarse(counterpart(spark, d))))


_SCORE_NONE = "CASE WHEN {day} = 0 THEN greatest(0.45, 0.85) WHEN {day} <= 4 THEN 0.30 + 0.15 * greatest(0.5, 1 - {day} / 8.0) ELSE 0.30 END"
UNIQUE_SQL = typed(
    f"""{WITH_POOLS}, P2 AS (SELECT *, floor(net_amount / 100) * 100 AS a FROM P), C2 AS (SELECT *, floor(net_amount / 100) * 100 AS a FROM C),
  J AS (SELECT p.id AS p_id, c.id AS c_id, abs(p.txn_date - c.txn_date) AS day_gap FROM P2 p JOIN C2 c ON p.a = c.a WHERE abs(p.txn_date - c.txn_date) <= 4 AND {COMPATIBLE}),
  O AS (SELECT p_id, min(c_id) AS c_id, min(day_gap) AS day_gap FROM J GROUP BY p_id HAVING count(*) = 1)
  SELECT p_id, c_id, day_gap, {_four(_SCORE_NONE.format(day="day_gap"))} AS confidence FROM O""",
    p_id="s", c_id="s", day_gap="n", confidence="d",
)

_LINES = """SELECT concat('L', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey, l_shipdate) AS STRING)) AS id,
 'S3' AS statement_id, 'lines' AS source_name, CAST(l_shipdate AS DATE) AS txn_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS net_amount, 'INR' AS currency, 'paid' AS status FROM lineitem"""
_BAND = f"""WITH P AS (SELECT concat('P', CAST(o_orderkey AS STRING)) AS id, CAST(o_orderdate AS DATE) AS txn_date, CAST(o_totalprice AS DECIMAL(18,2)) AS net_amount FROM orders), L AS ({_LINES}),
 J AS (SELECT p.id AS p_id, c.id AS c_id, abs(p.net_amount - c.net_amount) AS amount_gap, abs(p.txn_date - c.txn_date) AS day_gap FROM P p JOIN L c
  ON abs(p.net_amount - c.net_amount) <= least(100.00, greatest(1.00, round(0.035 * p.net_amount, 2))) AND abs(p.txn_date - c.txn_date) <= 4)"""


def _band(spark, d):
    left = sql(spark, d, "SELECT concat('P', CAST(o_orderkey AS STRING)) AS id, 'S1' AS statement_id, 'bank' AS source_name, CAST(o_orderdate AS DATE) AS txn_date, CAST(o_totalprice AS DECIMAL(18,2)) AS net_amount, 'INR' AS currency FROM orders", "orders")
    return match.band_pairs(left, sql(spark, d, _LINES, "lineitem"))


def band_join(spark, d):
    return plain(_band(spark, d).select("p_id", "c_id", "amount_gap", "day_gap"))


def band_ties(spark, d):
    best = match.band_best(_band(spark, d).withColumn("narration", F.lit(0.0)))
    return plain(best.select("p_id", "amount_gap", "day_gap", "tie", "confidence"))


BAND_TIES_SQL = typed(
    _BAND + """, R AS (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY amount_gap, day_gap, c_id) AS place FROM J),
 B AS (SELECT a.p_id, a.amount_gap, a.day_gap, coalesce(b.amount_gap = a.amount_gap AND b.day_gap = a.day_gap, false) AS tie FROM R a LEFT JOIN R b ON b.p_id = a.p_id AND b.place = 2 WHERE a.place = 1),
 S AS (SELECT *, CASE WHEN amount_gap = 0 THEN 1.0 WHEN amount_gap <= 1 THEN greatest(0.5, 1 - amount_gap / 2.0) ELSE 0.0 END AS sa, CASE WHEN day_gap = 0 THEN 1.0 ELSE greatest(0.5, 1 - day_gap / 8.0) END AS sd FROM B)
 SELECT p_id, amount_gap, day_gap, tie, """ + _four("CASE WHEN sa = 1.0 AND sd = 1.0 THEN 0.85 ELSE 0.30 * CAST(sa AS DOUBLE) + 0.15 * CAST(sd AS DOUBLE) END") + " AS confidence FROM S",
    p_id="s", amount_gap="d", day_gap="n", tie="b", confidence="d",
)

#: Left rows with a reference, and each cut into two or three right rows; every fifth reference has two left rows, every seventh a wrong part.
_SPLIT_P = "SELECT concat('P', CAST(o_orderkey AS STRING)) AS id, 'S1' AS statement_id, 'bank' AS source_name, CAST(o_orderdate AS DATE) AS txn_date, CAST(o_totalprice AS DECIMAL(18,2)) AS net_amount, 'INR' AS currency, concat('B', CAST(CAST(floor(o_orderkey / CASE WHEN o_orderkey % 20 < 10 THEN 1 ELSE 2 END) AS BIGINT) * CASE WHEN o_orderkey % 20 < 10 THEN 1 ELSE 2 END AS STRING)) AS utr FROM orders"
_SPLIT_C = """SELECT concat('C', CAST(o_orderkey AS STRING), '.', CAST(i AS STRING)) AS id, 'S2' AS statement_id, 'gateway' AS source_name, CAST(o_orderdate AS DATE) AS txn_date,
 CAST(CASE WHEN n = 1 THEN a WHEN i < n THEN 100.00 ELSE a - 100.00 * (n - 1) END + CASE WHEN o_orderkey % 7 = 0 THEN 150.00 ELSE 0.00 END AS DECIMAL(18,2)) AS net_amount, 'INR' AS currency,
 concat('B', CAST(CAST(floor(o_orderkey / CASE WHEN o_orderkey % 20 < 10 THEN 1 ELSE 2 END) AS BIGINT) * CASE WHEN o_orderkey % 20 < 10 THEN 1 ELSE 2 END AS STRING)) AS utr
 FROM (SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS a, CASE WHEN o_orderkey % 20 >= 15 THEN 1 ELSE 2 + o_orderkey % 2 END AS n FROM orders) CROSS JOIN (VALUES (1), (2), (3)) AS parts(i) WHERE i <= n"""


def _aggregates(spark, d):
    return match.aggregate_match(sql(spark, d, _SPLIT_P, "orders"), sql(spark, d, _SPLIT_C, "orders"))


def aggregate_topologies(spark, d):
    return plain(_aggregates(spark, d))


AGGREGATE_SQL = typed(
    f"""WITH P AS ({_SPLIT_P}), C AS ({_SPLIT_C}),
 p1 AS (SELECT utr AS ref, count(*) AS n_p, sum(net_amount) AS sum_p, min(txn_date) AS plo, max(txn_date) AS phi, string_agg(id, '|' ORDER BY id) AS p_ids FROM P GROUP BY 1),
 c1 AS (SELECT utr AS ref, count(*) AS n_c, sum(net_amount) AS sum_c, min(txn_date) AS clo, max(txn_date) AS chi, string_agg(id, '|' ORDER BY id) AS c_ids FROM C GROUP BY 1),
 b AS (SELECT *, CASE WHEN n_p = 1 AND n_c > 1 THEN '1_to_N' WHEN n_c = 1 AND n_p > 1 THEN 'N_to_1' WHEN n_p > 1 AND n_c > 1 THEN 'N_to_N' END AS topology, abs(sum_p - sum_c) AS amount_gap,
  greatest(abs(phi - clo), abs(chi - plo)) AS day_gap FROM p1 JOIN c1 USING (ref))
 SELECT ref, topology, p_ids, c_ids, amount_gap, day_gap, CASE topology WHEN 'N_to_N' THEN 0.90 ELSE 0.95 END AS confidence FROM b
 WHERE topology IS NOT NULL AND day_gap <= 4 AND amount_gap <= least(100.00, greatest(1.00, round(0.035 * CASE topology WHEN 'N_to_1' THEN sum_c ELSE sum_p END, 2)))""",
    ref="s", topology="s", p_ids="s", c_ids="s", amount_gap="d", day_gap="n", confidence="d",
)


def similar_topk_jaccard(spark, d):
    out = match.similar_candidates(primary(spark, d), counterpart(spark, d), k=3)
    return plain(out.select("p_id", "c_id", "similarity_score", "amount_gap", "day_gap", "id_type", "place"))


SIMILAR_SQL = typed(
    f"""{WITH_POOLS}, J AS (SELECT p.id AS p_id, c.id AS c_id, c.ord AS c_ord, abs(p.net_amount - c.net_amount) AS amount_gap, abs(p.txn_date - c.txn_date) AS day_gap, p.utr AS pu, c.utr AS cu, lower(p.order_id) = lower(c.order_id) AS same_order, contains(upper(p.description), upper(c.description)) OR contains(upper(c.description), upper(p.description)) AS part,
  {tokens_sql("p.description")} AS a, {tokens_sql("c.description")} AS b FROM P p JOIN C c ON (lower(p.utr) = lower(c.utr) OR lower(p.order_id) = lower(c.order_id) OR abs(p.net_amount - c.net_amount) <= 1 OR contains(upper(p.description), upper(c.description)) OR contains(upper(c.description), upper(p.description))) WHERE {COMPATIBLE}),
 S AS (SELECT *, CASE WHEN lower(pu) = lower(cu) THEN 'exact_utr' WHEN same_order THEN 'exact_order_id' WHEN part THEN 'partial' ELSE 'none' END AS id_type, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))), 4) AS narr FROM J),
 W AS (SELECT *, CASE id_type WHEN 'exact_utr' THEN CAST(1 AS DOUBLE) WHEN 'exact_order_id' THEN CAST(0.95 AS DOUBLE) WHEN 'partial' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS si,
  CASE WHEN amount_gap = 0 THEN CAST(1 AS DOUBLE) WHEN amount_gap <= 1 THEN greatest(CAST(0.5 AS DOUBLE), 1 - CAST(amount_gap AS DOUBLE) / 2) WHEN id_type IN ('exact_utr', 'exact_order_id') THEN CAST(0.8 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS sa,
  CASE WHEN day_gap = 0 THEN CAST(1 AS DOUBLE) WHEN day_gap <= 4 THEN greatest(CAST(0.5 AS DOUBLE), 1 - CAST(day_gap AS DOUBLE) / 8) ELSE CAST(0 AS DOUBLE) END AS sd FROM S),
 V AS (SELECT *, si * CAST(0.4 AS DOUBLE) + sa * CAST(0.3 AS DOUBLE) + sd * CAST(0.15 AS DOUBLE) + narr * CAST(0.15 AS DOUBLE) AS w FROM W),
 X AS (SELECT *, {_four("CASE WHEN si >= 0.95 OR (sa = 1 AND sd = 1) THEN greatest(w, CAST(0.85 AS DOUBLE)) ELSE w END")} AS similarity_score FROM V),
 R AS (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY similarity_score DESC, c_ord, c_id) AS place FROM X WHERE similarity_score >= 0.4) SELECT * FROM R WHERE place <= 3""",
    p_id="s", c_id="s", similarity_score="d", amount_gap="d", day_gap="n", id_type="s", place="n",
)


def similar_topk_full(spark, d):
    return plain(match.similar_candidates(primary(spark, d), counterpart(spark, d), k=3, narration=True).select("p_id", "c_id", "similarity_score", "narration", "place"))


def score_expression(spark, d):
    pairs = primary(spark, d).alias("p").join(counterpart(spark, d).alias("c"), "k")
    kind = F.when(F.col("k") % 5 == 0, "exact_utr").when(F.col("k") % 5 == 1, "exact_order_id").when(F.col("k") % 5 == 2, "partial").otherwise("none")
    gap, days = F.abs(F.col("p.net_amount") - F.col("c.net_amount")), dates.day_gap(F.col("p.txn_date"), F.col("c.txn_date"))
    s = score.confidence(kind, gap, days, (F.col("k") % 100) / 100.0, F.col("p.currency") == F.col("c.currency"), F.col("p.direction") == F.col("c.direction"))
    return plain(pairs.select(F.col("p.id").alias("p_id"), kind.alias("id_type"), gap.alias("amount_gap"), days.alias("day_gap"), s.alias("confidence")))


SCORE_SQL = typed(
    f"""{WITH_POOLS}, J AS (SELECT p.id AS p_id, p.k, CASE p.k % 5 WHEN 0 THEN 'exact_utr' WHEN 1 THEN 'exact_order_id' WHEN 2 THEN 'partial' ELSE 'none' END AS id_type, abs(p.net_amount - c.net_amount) AS amount_gap,
  abs(p.txn_date - c.txn_date) AS day_gap, p.currency = c.currency AS same FROM P p JOIN C c ON p.k = c.k),
 S AS (SELECT *, CASE id_type WHEN 'exact_utr' THEN CAST(1 AS DOUBLE) WHEN 'exact_order_id' THEN CAST(0.95 AS DOUBLE) WHEN 'partial' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS si,
  CASE WHEN amount_gap = 0 THEN CAST(1 AS DOUBLE) WHEN amount_gap <= 1 THEN greatest(CAST(0.5 AS DOUBLE), 1 - CAST(amount_gap AS DOUBLE) / 2) WHEN id_type IN ('exact_utr', 'exact_order_id') THEN CAST(0.8 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS sa,
  CASE WHEN day_gap = 0 THEN CAST(1 AS DOUBLE) WHEN day_gap <= 4 THEN greatest(CAST(0.5 AS DOUBLE), 1 - CAST(day_gap AS DOUBLE) / 8) ELSE CAST(0 AS DOUBLE) END AS sd FROM J),
 W AS (SELECT *, si * CAST(0.4 AS DOUBLE) + sa * CAST(0.3 AS DOUBLE) + sd * CAST(0.15 AS DOUBLE) + (k % 100) / CAST(100 AS DOUBLE) * CAST(0.15 AS DOUBLE) AS w FROM S)
 SELECT p_id, id_type, amount_gap, day_gap, {_four("CASE WHEN same THEN 1.0 ELSE 0.5 END * CASE WHEN si >= 0.95 OR (sa = 1 AND sd = 1) THEN greatest(w, CAST(0.85 AS DOUBLE)) ELSE w END")} AS confidence FROM W""",
    p_id="s", id_type="s", amount_gap="d", day_gap="n", confidence="d",
)


def expected_net(spark, d):
    g = spark.read.parquet(f"{d}/gateway_settlements.parquet")
    zero = F.lit(None).cast("decimal(18,2)")
    net = score.expected_net(F.col("gross_amount"), F.col("net_amount"), F.col("fee"), F.col("tax"), zero, zero)
    at_rate = score.expected_net(F.col("gross_amount"), zero, zero, zero, zero, zero, F.lit("card"), CFG)
    return plain(g.select("row_id", net.alias("expected"), at_rate.alias("at_card_rate"), score.effective_tolerance(net, CFG).alias("tolerance")))


EXPECTED_SQL = typed(
    """SELECT row_id, e AS expected, CAST(coalesce(gross_amount * 0.981, 0) AS DECIMAL(18,2)) AS at_card_rate, least(100.00, greatest(1.00, CAST(abs(e) * 0.035 AS DECIMAL(18,2)))) AS tolerance FROM (
 SELECT *, CAST(CASE WHEN coalesce(fee, 0) <> 0 OR coalesce(tax, 0) <> 0 THEN coalesce(gross_amount, net_amount, 0) - coalesce(fee, 0) - coalesce(tax, 0) ELSE coalesce(net_amount, gross_amount, 0) END AS DECIMAL(18,2)) AS e
 FROM gateway_settlements)""",
    row_id="n", expected="d", at_card_rate="d", tolerance="d",
)


def greedy_assignment(spark, d):
    return match.assign_nearest(_coarse(primary(spark, d)), _coarse(counterpart(spark, d)), 20)


def cascade_status(spark, d):
    third = counterpart(spark, d).where("k % 3 = 0").withColumns({"id": F.concat(F.lit("U"), "k"), "statement_id": F.lit("S4"), "source_name": F.lit("upi")})
    runs = [("bank", True, primary(spark, d)), ("gateway", False, counterpart(spark, d)), ("upi", False, third)]
    return plain(match.cascade(runs).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n")))


def _feature_pairs(spark, d):
    p, c = primary(spark, d), counterpart(spark, d)
    rename = lambda df, x: df.select(F.col("k").alias(x + "k"), *[F.col(n).alias(x + m) for n, m in (("id", "id"), ("net_amount", "amount"), ("txn_date", "txn_date"), ("utr", "utr"), ("order_id", "order_id"), ("description", "description"), ("currency", "currency"), ("direction", "direction"), ("status", "status"))])
    return rename(c, "s_").join(rename(p, "b_"), F.col("s_k") == F.col("b_k"))


def pair_features(spark, d):
    f = learn.pair_features(_feature_pairs(spark, d), textual=False)
    return plain(f.select("settlement_id", "bank_transaction_id", "amount_difference", "amount_difference_pct", "date_difference_days", "utr_match", "utr_missing", "order_id_exact", "currency_match", "status_compatible", "is_digit_transposition"))


def _feat_sql(c: str) -> str:
    s = f"upper(coalesce({c}, ''))"
    for part in (" ", "-", "_", "NEFTCR", "NEFT", "UTR", "UPI"):
        s = f"replace({s}, '{part}', '')"
    return f"trim({s})"


FEATURES_SQL = typed(
    f"""{WITH_POOLS}, J AS (SELECT c.id AS settlement_id, p.id AS bank_transaction_id, abs(c.net_amount - p.net_amount) AS g, greatest(abs(c.net_amount), abs(p.net_amount), 1) AS m, abs(c.txn_date - p.txn_date) AS dd, c.net_amount AS a, p.net_amount AS b,
  {_feat_sql("c.utr")} AS su, {_feat_sql("p.utr")} AS bu, {_feat_sql("c.order_id")} AS so, {_feat_sql("coalesce(p.order_id, p.description)")} AS bo, c.currency = p.currency AS cur, {_registry_sql("c.status")} IN ('FAILED', 'PENDING') AS bad FROM P p JOIN C c ON p.k = c.k)
 SELECT settlement_id, bank_transaction_id, g AS amount_difference, round(CAST(g AS DOUBLE) / CAST(m AS DOUBLE), 6) AS amount_difference_pct, dd AS date_difference_days, CASE WHEN su <> '' AND su = bu THEN 1 ELSE 0 END AS utr_match, CASE WHEN su = '' OR bu = '' THEN 1 ELSE 0 END AS utr_missing,
  CASE WHEN so <> '' AND contains(bo, so) THEN 1 ELSE 0 END AS order_id_exact, CASE WHEN cur THEN 1 ELSE 0 END AS currency_match, CASE WHEN cur AND NOT bad THEN 1 ELSE 0 END AS status_compatible,
  CASE WHEN a <> b AND list_sort(string_split(CAST(CAST(a * 100 AS BIGINT) AS VARCHAR), '')) = list_sort(string_split(CAST(CAST(b * 100 AS BIGINT) AS VARCHAR), '')) THEN 1 ELSE 0 END AS is_digit_transposition FROM J""",
    settlement_id="s", bank_transaction_id="s", amount_difference="d", amount_difference_pct="d", date_difference_days="n", utr_match="n", utr_missing="n", order_id_exact="n", currency_match="n", status_compatible="n", is_digit_transposition="n",
)


def pair_features_full(spark, d):
    f = learn.pair_features(_feature_pairs(spark, d))
    return plain(f)


def cluster_decision(spark, d):
    return plain(review.decide_cluster(match.similar_candidates(primary(spark, d), counterpart(spark, d), k=1)))


CHAINED = " || ".join(f"CASE WHEN row_id % {n + 2} <> 0 THEN '{p}' ELSE '' END" for n, p in enumerate(["REF:", "UTR-", "UPI", "NEFTCR-", "SETTLEMENT-"])) + " || coalesce(ref_utr, '12345')"

QUERIES = {
    "reference_normalize": reference_normalize, "exact_tiered_join": exact_tiered_join, "exact_match": exact_match, "desc_substring_join": desc_substring_join, "unique_amount_date": unique_amount_date, "band_join": band_join, "band_ties": band_ties,
    "aggregate_topologies": aggregate_topologies, "similar_topk_jaccard": similar_topk_jaccard, "similar_topk_full": similar_topk_full, "score_expression": score_expression, "expected_net": expected_net, "greedy_assignment": greedy_assignment,
    "cascade_status": cascade_status, "pair_features": pair_features, "pair_features_full": pair_features_full, "cluster_decision": cluster_decision,
}
SQL = {
    "reference_normalize": f"SELECT row_id, {_norm_sql('ref_utr')} AS reference, {_norm_sql(CHAINED)} AS behind_chain FROM bank_statement",
    "exact_tiered_join": typed(f"{KEYS} SELECT * FROM E", p_id="s", c_id="s", tier="n", amount_gap="d"),
    "exact_match": typed(f"{KEYS} SELECT p_id, c_id, CASE tier WHEN 0 THEN 'exact_utr' ELSE 'exact_document' END AS match_type, 1.0 AS confidence FROM E", p_id="s", c_id="s", match_type="s", confidence="d"),
    "unique_amount_date": UNIQUE_SQL,
    "band_join": typed(_BAND + " SELECT * FROM J", p_id="s", c_id="s", amount_gap="d", day_gap="n"),
    "band_ties": BAND_TIES_SQL, "aggregate_topologies": AGGREGATE_SQL, "score_expression": SCORE_SQL, "similar_topk_jaccard": SIMILAR_SQL, "expected_net": EXPECTED_SQL, "pair_features": FEATURES_SQL,
    "desc_substring_join": f"{WITH_POOLS} SELECT p.id AS p_id, c.id AS c_id FROM P p JOIN C c ON contains(p.description, c.order_id) WHERE {COMPATIBLE} AND {AGREE}",
}
