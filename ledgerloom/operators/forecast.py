"""Daily cash flow, its season, recurring payments and the forecast.

A series has one row per day; it is as long as the calendar, whatever the number of transactions, so windows over it
run in one task by nature. Transactions are summed to days before anything is ordered.
"""

from __future__ import annotations

import math
from collections import Counter
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clean, taxonomy

PERIOD = 7


def _all():
    return W.partitionBy(F.lit(1))


def _line():
    return _all().orderBy("date")


def daily_flow(t: DataFrame) -> DataFrame:
    """(date, net_inflow, tx_count) of transactions (txn_date, amount); rows without a date are left out."""
    return t.where("txn_date IS NOT NULL").groupBy(F.col("txn_date").alias("date")).agg(F.sum("amount").alias("net_inflow"), F.count(F.lit(1)).alias("tx_count"))


def densify(daily: DataFrame) -> DataFrame:
    """The same with every day between the first and the last, missing ones 0."""
    days = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("date"))
    zero = F.lit(0)
    return days.join(daily, "date", "left").select("date", F.coalesce("net_inflow", zero).cast(daily.schema["net_inflow"].dataType).alias("net_inflow"), F.coalesce("tx_count", zero).alias("tx_count"))


def running_balance(daily: DataFrame, opening: float = 0.0) -> DataFrame:
    kind = daily.schema["net_inflow"].dataType
    return daily.withColumn("balance", F.lit(opening).cast(kind) + F.sum("net_inflow").over(_line().rowsBetween(W.unboundedPreceding, 0)))


def decompose(daily: DataFrame) -> DataFrame:
    """(date, value, pos, trend, seasonal, residual) of a dense series: centred mean of 7 days, mean by place in the week, rest.

    A series of under two weeks has a centred mean of up to 3 days and no season.
    """
    value = F.col("net_inflow").cast("double")
    s = daily.select("date", value.alias("value"), (F.row_number().over(_line()) - 1).alias("i"), F.count(F.lit(1)).over(_all()).alias("n"))
    long = F.col("n") >= 2 * PERIOD
    short = F.when(F.col("n") == 2, F.avg("value").over(_line().rowsBetween(-1, 0))).otherwise(F.avg("value").over(_line().rowsBetween(-1, 1)))
    s = s.withColumn("trend", F.when(long, F.avg("value").over(_line().rowsBetween(-3, 3))).otherwise(short)).withColumn("pos", (F.col("i") % PERIOD).cast("int"))
    season = F.avg(F.col("value") - F.col("trend")).over(W.partitionBy("pos"))
    s = s.withColumn("seasonal", F.when(long, season).otherwise(0.0))
    return s.select("date", "value", "pos", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def spread(parts: DataFrame) -> DataFrame:
    """One row: n, the residuals' standard deviation (a share of the mean where it is 0 or unknown), the last trend, the last day."""
    mean = F.abs(F.avg("value"))
    sd = F.stddev_samp("residual")
    recent = parts.withColumn("back", F.row_number().over(_all().orderBy(F.desc("date"))))
    return recent.agg(
        F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) > 1) & (sd > 0), sd).otherwise(F.greatest(mean * 0.15, F.lit(1.0))).alias("std_dev"), F.avg(F.when(F.col("back") <= PERIOD, F.col("trend"))).alias("last_trend"), F.max("date").alias("last_day")
    )


#: Share of words that makes two descriptions alike.
ALIKE = 0.6


def _leaders(keys: pd.DataFrame) -> pd.DataFrame:
    """Leader clustering of description keys in order of first appearance: a key joins the first leader that shares 60 % of its words.

    Leaders are found by their rarest words: two sets that alike share one of the first n - ceil(0.6 n) + 1 words in order of rarity.
    """
    ordered = list(keys.sort_values(["first", "key"])["key"])
    count = Counter(w for key in ordered for w in set(key.split()))
    leaders: list[tuple[str, set]] = []
    by_word: dict[str, list[int]] = {}
    out = []
    for key in ordered:
        words = sorted(set(key.split()), key=lambda w: (count[w], w))
        rare, have = words[: len(words) - math.ceil(ALIKE * len(words)) + 1], set(words)
        near = sorted({k for w in rare for k in by_word.get(w, ())})
        label = next((leaders[k][0] for k in near if len(have & leaders[k][1]) / len(have | leaders[k][1]) >= ALIKE), None)
        if label is None:
            label = key
            for w in rare:
                by_word.setdefault(w, []).append(len(leaders))
            leaders.append((key, have))
        out.append((key, label))
    return pd.DataFrame(out, columns=["key", "label"])


# Descriptions that are notes on payments, not payments.
NOTES = ["cancellation", "duplicate charge", "chargeback", "dispute", "reversed", "refund"]


def recurring_patterns(t: DataFrame, least: int = 3) -> DataFrame:
    """(label, cadence_days, n, avg_amount, min_amount, max_amount, total, last_date, next_expected, confidence) of recurring payments.

    Descriptions (txn_date, amount, description) are reduced to keys; like keys form a pattern. Only the distinct keys, far fewer
    than rows, are clustered in one task, in order of first appearance; rows are grouped by label afterwards.
    """
    # The explode of one key keeps the filters on it from being pushed down and the key from being made for each of them.
    rows = t.where("txn_date IS NOT NULL AND abs(amount) >= 1").select("txn_date", F.col("amount").cast("double").alias("amount"), F.explode(F.array(clean.pattern_key(F.col("description")))).alias("key"))
    rows = rows.where((F.length("key") >= 3) & ~F.col("key").rlike("|".join(NOTES)))
    keys = rows.groupBy("key").agg(F.min("txn_date").alias("first"))
    labels = keys.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_leaders, "key string, label string")
    rows = rows.join(labels, "key").groupBy("label", "txn_date").agg(F.count(F.lit(1)).alias("k"), F.sum("amount").alias("sum"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    # By day from here on: repeated days have no gap between them.
    days = rows.withColumn("gap", F.datediff("txn_date", F.lag("txn_date").over(W.partitionBy("label").orderBy("txn_date"))))
    g = days.groupBy("label").agg(
        F.sum("k").alias("n"), (F.sum("sum") / F.sum("k")).alias("avg_amount"), F.min("lo").alias("min_amount"), F.max("hi").alias("max_amount"), F.sum("sum").alias("total"), F.max("txn_date").alias("last_date"),
        F.array_sort(F.collect_list(F.when(F.col("gap").between(1, 180), F.col("gap")))).alias("gaps"),
    ).where((F.col("n") >= least) & (F.size("gaps") > 0) & (F.abs("avg_amount") >= 1))
    g = g.withColumn("median", F.get("gaps", F.floor(F.size("gaps") / 2).cast("int"))).withColumn("cadence_days", taxonomy.snap_cadence(F.col("median")).cast("int")).where("cadence_days IS NOT NULL")
    off = F.aggregate("gaps", F.lit(0), lambda a, x: a + F.abs(x - F.col("cadence_days"))) / F.size("gaps")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - off / F.col("cadence_days")))
    two = lambda c: F.round(c, 2).alias(c)
    return g.select("label", "cadence_days", "n", two("avg_amount"), two("min_amount"), two("max_amount"), two("total"), "last_date", F.date_add("last_date", F.col("cadence_days")).alias("next_expected"), F.round(sure, 3).alias("confidence"))


def project_patterns(patterns: DataFrame, steps: int = 5) -> DataFrame:
    """(label, step, date, amount, confidence): the next occurrences; confidence falls by 3 points a step, within 10..99."""
    sure = F.greatest(F.lit(10), F.least(F.lit(99), F.round(F.col("confidence") * 100 - (F.col("step") - 1) * 3).cast("int")))
    return patterns.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).select("label", "step", F.expr("date_add(last_date, cadence_days * step)").alias("date"), F.col("avg_amount").alias("amount"), sure.alias("confidence_points"))


def pending_settlements(t: DataFrame, today: date, lag: DataFrame) -> DataFrame:
    """(id, amount, initiated, expected, age_days): open credits that are due within the usual lag (one row: typical_lag)."""
    st = F.upper(F.coalesce("status", F.lit("")))
    open_ = st.isin("PENDING", "PROCESSING", "INITIATED", "UNSETTLED", "IN_TRANSIT", "SUBMITTED")
    age = F.datediff(F.lit(today), F.col("txn_date"))
    rows = t.where(open_ & (F.col("amount") > 0)).join(lag, F.lit(True)).where((age >= 0) & (age <= F.col("typical_lag") + 3))
    return rows.select("id", "amount", F.col("txn_date").alias("initiated"), F.date_add("txn_date", F.col("typical_lag")).alias("expected"), age.alias("age_days"))


def forecast(t: DataFrame, today: date | None = None, days: int = 30, opening: float = 0.0, patterns: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
    """(date, projected, cumulative, lower_band, upper_band) of the next ``days`` (at most 90) days.

    Last trend plus season, half of the recurring payments due (confidence from .4), and pending settlements on their day; bands
    widen with the root of time. ``today`` is the last day of history by default.
    """
    days = min(days, 90)
    dense = densify(daily_flow(t))
    parts = decompose(dense)
    base = spread(parts).join(dense.agg(F.sum("net_inflow").cast("double").alias("flow")), F.lit(True))
    season = parts.groupBy("pos").agg(F.first("seasonal").alias("seasonal"))
    start = F.lit(today) if today else F.col("last_day")
    line = base.select("*", start.alias("today"), F.explode(F.sequence(F.lit(1), F.lit(days))).alias("d"))
    line = line.select("*", F.date_add("today", F.col("d")).alias("date"), ((F.col("n") + F.col("d") - 1) % PERIOD).cast("int").alias("pos")).join(season, "pos", "left")
    line = line.withColumn("base", F.col("last_trend") + F.coalesce("seasonal", F.lit(0.0)))
    if patterns is not None:
        hits = patterns.where("confidence >= 0.4").join(base.select(start.alias("today")), F.lit(True))
        first = F.greatest(F.lit(0), F.floor(F.datediff("today", "next_expected") / F.col("cadence_days")) + 1)
        begin = F.expr("date_add(next_expected, cast(skip * cadence_days AS int))")
        hits = hits.withColumn("skip", first.cast("int")).withColumn("begin", begin).where(F.col("begin") <= F.date_add("today", days))
        hits = hits.select("avg_amount", F.explode(F.expr(f"sequence(begin, date_add(today, {days}), make_interval(0, 0, 0, cadence_days))")).alias("date")).groupBy("date").agg(F.sum("avg_amount").alias("due"))
        line = line.join(hits, "date", "left").withColumn("base", F.col("base") + 0.5 * F.coalesce("due", F.lit(0.0)))
    if pending is not None:
        due = pending.groupBy(F.col("expected").alias("date")).agg(F.sum("amount").cast("double").alias("arrives"))
        line = line.join(due, "date", "left").withColumn("base", F.col("base") + F.coalesce("arrives", F.lit(0.0)))
    total = F.lit(opening) + F.col("flow") + F.sum("base").over(_line().rowsBetween(W.unboundedPreceding, 0))
    band = F.col("std_dev") * 1.5 * F.sqrt(F.col("d") / 7)
    r = lambda c, name: F.round(c, 2).alias(name)
    out = line.withColumn("total", total)
    return out.select("date", r(F.col("base"), "projected"), r(F.col("total"), "cumulative"), r(F.col("total") - band, "lower_band"), r(F.col("total") + band, "upper_band"))


def forecast_summary(t: DataFrame) -> DataFrame:
    """One row over the dense series: mean per day, inflow, outflow, spread of the residuals."""
    parts = decompose(densify(daily_flow(t)))
    v = F.col("value")
    flow = parts.agg(F.round(F.avg(v), 2).alias("avg_daily_net"), F.round(F.sum(F.when(v > 0, v).otherwise(0.0)), 2).alias("total_inflow"), F.round(F.sum(F.when(v < 0, v).otherwise(0.0)), 2).alias("total_outflow"))
    return flow.join(spread(parts).select(F.round("std_dev", 2).alias("confidence_std"), F.col("n").alias("n_days")), F.lit(True))


def day_details(t: DataFrame, day: date) -> DataFrame:
    """One row: settled and pending sums up to a day, and the transactions of that day."""
    done = F.upper(F.coalesce("status", F.lit(""))).isin("SETTLED", "MATCHED", "AUTO", "SUCCESS", "COMPLETED", "PAID")
    upto, on = F.col("txn_date") <= F.lit(day), F.col("txn_date") == F.lit(day)
    s = lambda w: F.coalesce(F.sum(F.when(w, F.col("amount"))), F.lit(0)).cast("decimal(18,2)")
    return t.agg(s(upto & done).alias("settled"), s(upto & ~done).alias("pending"), F.count(F.when(on, 1)).alias("n_day"), s(on).alias("net_day"))
