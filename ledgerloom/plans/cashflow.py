"""Queries of daily flow, season, recurring payments and forecast, over the events table."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import taxonomy
from ..operators import analytics as an
from ..operators import forecast as fc
from .common import plain, typed
from .pools import sql

#: Events as transactions: purchases come in, errors go out.
FLOW = """SELECT CAST(event_id AS STRING) AS id, CAST(ts AS DATE) AS txn_date, CAST(CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE value END AS DECIMAL(18,2)) AS amount,
 CASE WHEN event_id % 7 = 0 THEN 'pending' WHEN event_id % 7 = 1 THEN 'failed' ELSE 'settled' END AS status FROM events"""
#: Orders as recurring payments: a description per customer group, so that some come back regularly.
RECURRING = """SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_orderdate AS DATE) AS txn_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
 concat('payroll group ', chr(CAST(97 + o_custkey % 23 AS INT)), chr(CAST(97 + o_custkey % 19 AS INT)), ' ', o_orderpriority, ' ref 12345678') AS description, 'settled' AS status FROM orders"""


def _flow(spark, d):
    return sql(spark, d, FLOW, "events")


def _dense(spark, d):
    return fc.densify(fc.daily_flow(_flow(spark, d)))


def daily_flow(spark, d):
    return plain(fc.daily_flow(_flow(spark, d)))


def calendar_densify(spark, d):
    gaps = _flow(spark, d).where(F.dayofmonth("txn_date") % 5 != 0)
    return plain(fc.densify(fc.daily_flow(gaps)))


def running_balance(spark, d):
    return plain(fc.running_balance(_dense(spark, d), 1000.0).select("date", "balance"))


def _r(df, *cols):
    return df.select(*[F.round(c, 4).alias(c) if c in ("trend", "seasonal", "residual", "value") else F.col(c) for c in cols])


def seasonal_component(spark, d):
    return plain(_r(fc.decompose(_dense(spark, d)), "date", "pos", "trend", "seasonal", "residual"))


def residual_std(spark, d):
    s = fc.spread(fc.decompose(_dense(spark, d)))
    return plain(s.select("n", F.round("std_dev", 4).alias("std_dev"), F.round("last_trend", 4).alias("last_trend"), "last_day"))


def forecast_30d(spark, d):
    return fc.forecast(_flow(spark, d))


def forecast_full(spark, d):
    t = sql(spark, d, RECURRING, "orders")
    today = datetime.date(2001, 8, 1)
    lag = an.typical_lag(an.nearest_lag(t.where("id % 10 = 0"), t.where("id % 10 = 1")))
    pending = fc.pending_settlements(_flow(spark, d), datetime.date(2024, 1, 28), lag)
    return fc.forecast(t, today, 60, 500.0, fc.recurring_patterns(t), pending)


def forecast_summary(spark, d):
    return plain(fc.forecast_summary(_flow(spark, d)))


def recurring_patterns(spark, d):
    return plain(fc.recurring_patterns(sql(spark, d, RECURRING, "orders")))


def pattern_projection(spark, d):
    return plain(fc.project_patterns(fc.recurring_patterns(sql(spark, d, RECURRING, "orders"))))


def cadence_snap(spark, d):
    return plain(spark.range(-2, 150).select(F.col("id").alias("gap"), taxonomy.snap_cadence(F.col("id")).alias("cadence")))


def nearest_lag(spark, d):
    t = sql(spark, d, "SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_orderdate AS DATE) AS txn_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderkey AS k FROM orders", "orders")
    return plain(an.nearest_lag(t.where("k % 2 = 0"), t.where("k % 2 = 1")))


def pending_settlements(spark, d):
    lag = spark.createDataFrame([(3,)], "typical_lag int")
    return plain(fc.pending_settlements(_flow(spark, d), datetime.date(2024, 1, 20), lag))


def day_details(spark, d):
    return plain(fc.day_details(_flow(spark, d), datetime.date(2024, 1, 15)))


_DAILY = f"WITH E AS ({FLOW}), D AS (SELECT txn_date AS date, sum(amount) AS net_inflow, count(*) AS tx_count FROM E GROUP BY 1)"
_PARTS = f"""{_DAILY}, C AS (SELECT CAST(x AS DATE) AS date, coalesce(CAST(net_inflow AS DOUBLE), 0) AS v FROM (SELECT unnest(generate_series((SELECT min(date) FROM D), (SELECT max(date) FROM D), INTERVAL 1 DAY)) AS x) LEFT JOIN D ON D.date = CAST(x AS DATE)),
 T AS (SELECT date, v, (row_number() OVER (ORDER BY date) - 1) % 7 AS pos, avg(v) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM C),
 S AS (SELECT *, avg(v - trend) OVER (PARTITION BY pos) AS seasonal FROM T), R AS (SELECT *, v - trend - seasonal AS residual FROM S)"""

QUERIES = {
    "daily_flow": daily_flow, "calendar_densify": calendar_densify, "running_balance": running_balance, "seasonal_component": seasonal_component, "residual_std": residual_std, "forecast_30d": forecast_30d, "forecast_full": forecast_full,
    "forecast_summary": forecast_summary, "recurring_patterns": recurring_patterns, "pattern_projection": pattern_projection, "cadence_snap": cadence_snap, "nearest_lag": nearest_lag, "pending_settlements": pending_settlements, "day_details": day_details,
}
SQL = {
    "daily_flow": typed(f"{_DAILY} SELECT * FROM D", date="t", net_inflow="d", tx_count="n"),
    "calendar_densify": typed(
        f"""WITH E AS ({FLOW}), D AS (SELECT txn_date AS date, sum(amount) AS net_inflow, count(*) AS tx_count FROM E WHERE day(txn_date) % 5 <> 0 GROUP BY 1)
 SELECT CAST(x AS DATE) AS date, coalesce(net_inflow, 0) AS net_inflow, coalesce(tx_count, 0) AS tx_count FROM (SELECT unnest(generate_series((SELECT min(date) FROM D), (SELECT max(date) FROM D), INTERVAL 1 DAY)) AS x) LEFT JOIN D ON D.date = CAST(x AS DATE)""",
        date="t", net_inflow="d", tx_count="n",
    ),
    "running_balance": typed(f"{_DAILY} SELECT date, 1000 + sum(net_inflow) OVER (ORDER BY date) AS balance FROM D", date="t", balance="d"),
    "seasonal_component": typed(f"{_PARTS} SELECT date, pos, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(residual, 4) AS residual FROM R", date="t", pos="n", trend="d", seasonal="d", residual="d"),
    "residual_std": typed(f"{_PARTS} SELECT count(*) AS n, round(stddev_samp(residual), 4) AS std_dev, (SELECT round(avg(trend), 4) FROM (SELECT trend FROM R ORDER BY date DESC LIMIT 7)) AS last_trend, max(date) AS last_day FROM R", n="n", std_dev="d", last_trend="d", last_day="t"),
    "forecast_30d": typed(
        f"""{_PARTS}, B AS (SELECT count(*) AS n, stddev_samp(residual) AS sd, (SELECT avg(trend) FROM (SELECT trend FROM R ORDER BY date DESC LIMIT 7)) AS lt, max(date) AS today, sum(v) AS flow FROM R), P AS (SELECT DISTINCT pos, seasonal FROM R),
 L AS (SELECT d, CAST(today + CAST(d AS INT) AS DATE) AS date, lt + seasonal AS base, sd, flow FROM B, range(1, 31) r(d) JOIN P ON P.pos = ((SELECT n FROM B) + d - 1) % 7), K AS (SELECT *, flow + sum(base) OVER (ORDER BY d) AS total, sd * 1.5 * sqrt(d / 7.0) AS band FROM L)
 SELECT date, round(base, 2) AS projected, round(total, 2) AS cumulative, round(total - band, 2) AS lower_band, round(total + band, 2) AS upper_band FROM K""", date="t", projected="d", cumulative="d", lower_band="d", upper_band="d",
    ),
    "forecast_summary": typed(f"{_PARTS} SELECT round(avg(v), 2) AS avg_daily_net, round(sum(CASE WHEN v > 0 THEN v ELSE 0 END), 2) AS total_inflow, round(sum(CASE WHEN v < 0 THEN v ELSE 0 END), 2) AS total_outflow, round(stddev_samp(residual), 2) AS confidence_std, count(*) AS n_days FROM R", avg_daily_net="d", total_inflow="d", total_outflow="d", confidence_std="d", n_days="n"),
    "cadence_snap": "SELECT g AS gap, CASE WHEN g <= 0 THEN NULL WHEN abs(g - 1) <= 2 THEN 1 WHEN abs(g - 7) <= 2 THEN 7 WHEN abs(g - 14) <= 3.5 THEN 14 WHEN abs(g - 30) <= 7.5 THEN 30 WHEN abs(g - 90) <= 22.5 THEN 90 WHEN g BETWEEN 2 AND 120 THEN g END AS cadence FROM range(-2, 150) r(g)",
    "nearest_lag": typed(
        """WITH O AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders) SELECT CAST(g.k AS VARCHAR) AS id, min(b.d - g.d) AS lag FROM O g JOIN O b ON g.k % 2 = 0 AND b.k % 2 = 1 AND b.d BETWEEN g.d AND g.d + 14
 AND CAST(abs(b.a - g.a) AS DOUBLE) < CAST(0.05 AS DOUBLE) * greatest(CAST(1 AS DOUBLE), CAST(abs(g.a) AS DOUBLE)) GROUP BY 1""", id="s", lag="n",
    ),
    "pending_settlements": typed(f"WITH E AS ({FLOW}) SELECT id, amount, txn_date AS initiated, txn_date + 3 AS expected, DATE '2024-01-20' - txn_date AS age_days FROM E WHERE status = 'pending' AND amount > 0 AND DATE '2024-01-20' - txn_date BETWEEN 0 AND 6", id="s", amount="d", initiated="t", expected="t", age_days="n"),
    "day_details": typed(f"WITH E AS ({FLOW}) SELECT sum(amount) FILTER (status = 'settled' AND txn_date <= DATE '2024-01-15') AS settled, sum(amount) FILTER (status <> 'settled' AND txn_date <= DATE '2024-01-15') AS pending, count(*) FILTER (txn_date = DATE '2024-01-15') AS n_day, sum(amount) FILTER (txn_date = DATE '2024-01-15') AS net_day FROM E", settled="d", pending="d", n_day="n", net_day="d"),
}
