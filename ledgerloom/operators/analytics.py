"""Summaries of reconciled transactions.

Transactions have: id, source_name, amount, status, txn_date, rule, score, currency, description, utr, counterpart_id,
counterpart_amount, is_primary, duplicate. Every function takes and returns DataFrames; nothing reaches the driver.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import taxonomy as tx

MONEY = "decimal(18,2)"


def _count(where: Column) -> Column:
    return F.count(F.when(where, 1))


def _sum(value: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0)).cast(MONEY)


def _percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


def kpi_summary(t: DataFrame, period_settled: bool = False) -> DataFrame:
    """One row: counts per status, match rate, deposits, payments, variance, period, and whether the counts add up."""
    cat = tx.taxonomy(F.col("status"), period_settled)
    n = {s: _count(cat == s) for s in tx.TAXONOMY}
    total, amt = F.count(F.lit(1)), F.col("amount").cast(MONEY)
    matched = n["SETTLED"] + n["MATCHED"]
    return t.agg(
        total.alias("total"), *[n[s].alias("n_" + s.lower()) for s in tx.TAXONOMY], _percent(matched, total).alias("match_rate"), _sum(amt, amt > 0).alias("deposits"), _sum(-amt, amt < 0).alias("payments"),
        _sum(F.abs(amt), cat == "UNMATCHED").alias("variance"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"), (sum(n.values()) == total).alias("adds_up"),
    )


def status_breakdown(t: DataFrame) -> DataFrame:
    """(taxonomy, n, share) of all four statuses, those without rows included."""
    got = t.groupBy(tx.taxonomy(F.col("status")).alias("taxonomy")).agg(F.count(F.lit(1)).alias("n"))
    grid = t.sparkSession.createDataFrame([(s,) for s in tx.TAXONOMY], "taxonomy string")
    rows = grid.join(got, "taxonomy", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("taxonomy", "n", _percent(F.col("n"), F.sum("n").over(W.partitionBy(F.lit(1)))).alias("share"))


def scatter_points(t: DataFrame) -> DataFrame:
    """(id, date, amount, status, description): a point per dated row, amounts without sign, descriptions up to 60 characters. Rows without a date have none."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return t.where("txn_date IS NOT NULL").select("id", F.col("txn_date").alias("date"), F.abs("amount").alias("amount"), F.lower(text("status")).alias("status"), F.substring(text("description"), 1, 60).alias("description"))


def funnel(t: DataFrame) -> DataFrame:
    """(place, stage, n): all rows, those matched or settled, settled, similar, unmatched; five rows, zeros for no rows."""
    cat = tx.taxonomy(F.col("status"))
    counts = [("Total Ingested", F.count(F.lit(1))), ("Auto-Matched", _count(cat.isin("SETTLED", "MATCHED"))), ("Settled", _count(cat == "SETTLED")), ("Similar (Review)", _count(cat == "SIMILAR")), ("Unmatched", _count(cat == "UNMATCHED"))]
    one = t.agg(*[n.alias(f"n{k}") for k, (_, n) in enumerate(counts)])
    each = [F.struct(F.lit(k + 1).alias("place"), F.lit(name).alias("stage"), F.col(f"n{k}").alias("n")) for k, (name, _) in enumerate(counts)]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def source_status(t: DataFrame) -> DataFrame:
    """(source_name, SETTLED, MATCHED, SIMILAR, UNMATCHED, total) per source."""
    cat = tx.taxonomy(F.col("status"))
    return t.groupBy("source_name").agg(*[_count(cat == s).alias(s) for s in tx.TAXONOMY], F.count(F.lit(1)).alias("total"))


def cascade_counts(t: DataFrame) -> DataFrame:
    """(stage, n): rows by the pass that resolved them; 0 are open rows."""
    return t.groupBy(tx.cascade_stage(F.col("status"), F.col("rule"), F.col("score")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def mismatch_reasons(t: DataFrame) -> DataFrame:
    """(reason, n) over open rows; a row counts for each of its reasons."""
    open_ = t.where(F.lower("status").isin(tx.OPEN_STATUSES))
    return open_.select(F.explode(tx.mismatch_reasons(F.col("rule"), F.col("duplicate"))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def variance_histogram(t: DataFrame) -> DataFrame:
    """(bucket, n): resolved rows with a counterpart by the gap of amounts, open ones in the last bucket."""
    st = F.lower("status")
    bucket = F.when(st.isin(tx.RESOLVED_STATUSES) & F.col("counterpart_id").isNotNull(), tx.variance_bucket(F.abs("amount") - F.abs(F.coalesce("counterpart_amount", "amount"))))
    bucket = bucket.when(st.isin("exception", "unmatched", "unreconciled", "manual"), tx.VARIANCE[4])
    return t.select(bucket.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def risk_matrix(t: DataFrame, today: date) -> DataFrame:
    """(amount_tier, age_tier, n, amount) of open rows, all 16 cells."""
    days = F.coalesce(F.greatest(F.datediff(F.lit(today), "txn_date"), F.lit(0)), F.lit(1))
    open_ = t.where(F.lower("status").isin(tx.OPEN_STATUSES))
    got = open_.groupBy(tx.amount_tier(F.col("amount")).alias("amount_tier"), tx.age_tier(days).alias("age_tier")).agg(F.count(F.lit(1)).alias("n"), _sum(F.abs(F.col("amount").cast(MONEY))).alias("amount"))
    grid = t.sparkSession.createDataFrame([(a, b) for a in range(4) for b in range(4)], "amount_tier int, age_tier int")
    return grid.join(got, ["amount_tier", "age_tier"], "left").select("amount_tier", "age_tier", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0)).cast(MONEY).alias("amount"))


def gateway_performance(t: DataFrame) -> DataFrame:
    """(source_name, total, matched, rate, fee_variance) per source."""
    gap = F.when(F.col("counterpart_id").isNotNull(), F.abs(F.abs(F.col("amount")) - F.abs(F.coalesce("counterpart_amount", "amount"))))
    ok, total = _count(F.lower("status").isin(tx.RESOLVED_STATUSES)), F.count(F.lit(1))
    return t.groupBy("source_name").agg(total.alias("total"), ok.alias("matched"), _percent(ok, total).alias("rate"), _sum(gap.cast(MONEY)).alias("fee_variance"))


def flagged(t: DataFrame) -> DataFrame:
    """(id, flags, primary_type) per transaction."""
    none = F.lit(None).cast("string")
    c = lambda name: F.col(name) if name in t.columns else none
    flags = tx.feature_flags(c("currency"), c("description"), c("status"), c("rule"), c("utr"), c("counterpart_utr"), c("order_id"), c("counterpart_order_id"), F.lit(False), F.col("duplicate"))
    return t.select("id", flags.alias("flags")).withColumn("primary_type", tx.primary_type(F.col("flags")))


def tag_counts(f: DataFrame, top: int | None = None) -> DataFrame:
    """(flag, n) over the flags of ``flagged``; with ``top`` the most frequent ones by count, then rank."""
    out = f.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return out
    rank = F.array_position(F.array(*[F.lit(x) for x in tx.FLAG_ORDER]), F.col("flag"))
    return out.orderBy(F.desc("n"), rank).limit(top)


def duplicate_signatures(t: DataFrame) -> DataFrame:
    """(signature, n) of signatures that several rows share: amount, date and reference, else source, amount, date and description."""
    has = F.col("utr").isNotNull() & ~F.lower(F.trim("utr")).isin(tx.NO_REFERENCE)
    day, amt = F.date_format("txn_date", "yyyy-MM-dd"), F.col("amount").cast(MONEY).cast("string")
    sig = F.when(has, F.concat_ws("_", amt, day, F.trim("utr"))).otherwise(F.concat_ws("_", "source_name", amt, day, "description"))
    return t.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def period_status(t: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row: primary rows, matched ones, open exceptions, and whether the period is settled."""
    prim = t.where("is_primary").agg(F.count(F.lit(1)).alias("n_primary"), _count(F.lower("status").isin("settled", "matched", "auto")).alias("n_matched"))
    open_ = exceptions.agg(_count(F.lower(F.coalesce("state", F.lit("open"))) == "open").alias("n_open"))
    # Both sides are a single row of counts.
    both = prim.join(open_, F.lit(True))
    return both.withColumn("settled", (F.col("n_primary") > 0) & (F.col("n_primary") == F.col("n_matched")) & (F.col("n_open") == 0))


def period_compare(t: DataFrame, unit: str = "month") -> DataFrame:
    """(period, n, n_matched, match_rate, volume, d_n, d_rate, d_volume) per period, with the change to the period before."""
    ok = tx.taxonomy(F.col("status")).isin("SETTLED", "MATCHED")
    per = t.groupBy(F.trunc("txn_date", unit).alias("period")).agg(F.count(F.lit(1)).alias("n"), _count(ok).alias("n_matched"), _sum(F.abs(F.col("amount").cast(MONEY))).alias("volume"))
    per = per.withColumn("match_rate", _percent(F.col("n_matched"), F.col("n"), 2))
    # One row per period by now.
    before = W.partitionBy(F.lit(1)).orderBy("period")
    step = lambda c: (F.col(c) - F.lag(c).over(before))
    return per.select("period", "n", "n_matched", "match_rate", "volume", step("n").alias("d_n"), F.round(step("match_rate"), 2).alias("d_rate"), step("volume").cast(MONEY).alias("d_volume"))


def settlement_rollup(results: DataFrame) -> DataFrame:
    """(decision, n): settlements by the best decision that any of their rows has (matched, then review, then unmatched)."""
    rank = F.when(F.lower("decision").isin("matched", "match"), 2).when(F.lower("decision").isin("manual_review", "review", "similar"), 1).otherwise(0)
    best = results.groupBy("settlement_id").agg(F.max(rank).alias("r"))
    name = F.when(F.col("r") == 2, "matched").when(F.col("r") == 1, "manual_review").otherwise("unmatched")
    return best.groupBy(name.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def pair_ids(results: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs of the ids that two columns list, joined by ``|``."""
    one = lambda c: F.explode(F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    return results.select(one(left).alias("a"), right).select("a", one(right).alias("b")).distinct()


def precision_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 (4 digits) over distinct pairs (a, b)."""
    p, q = predicted.select("a", "b").distinct().withColumn("p", F.lit(1)), truth.select("a", "b").distinct().withColumn("t", F.lit(1))
    n = p.join(q, ["a", "b"], "full").agg(_count(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), _count(F.col("t").isNull()).alias("fp"), _count(F.col("p").isNull()).alias("fn"))
    rate = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 4)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", rate(tp, fp).alias("precision"), rate(tp, fn).alias("recall"), F.when(2 * tp + fp + fn > 0, F.round(2 * tp / (2 * tp + fp + fn), 4)).otherwise(0.0).alias("f1"))


def decision_accuracy(decided: DataFrame) -> DataFrame:
    """One row over (decision, label): decided rows, coverage and accuracy; reviews don't count as decided."""
    sure = F.col("decision").isin("match", "non_match")
    right = ((F.col("decision") == "match") & (F.col("label") == 1)) | ((F.col("decision") == "non_match") & (F.col("label") == 0))
    return decided.agg(F.count(F.lit(1)).alias("n"), _count(sure).alias("n_decided"), _percent(_count(sure), F.count(F.lit(1)), 2).alias("coverage"), _percent(_count(sure & right), _count(sure), 2).alias("accuracy"))


def confidence_bands(scored: DataFrame, edges: tuple[float, ...] = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0)) -> DataFrame:
    """(band, n): scores by right-closed bands; the number of the band from 0, scores at the lowest edge in the first."""
    s = F.col("score")
    band = F.when(s <= edges[1], 0)
    for k in range(1, len(edges) - 1):
        band = band.when(s <= edges[k + 1], k)
    return scored.where((s >= edges[0]) & (s <= edges[-1])).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def score_quality(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row over (score, label): Brier score, accuracy, mean score of matches and of others (6 digits)."""
    hit = (F.col("score") >= threshold).cast("int") == F.col("label")
    mean = lambda k: F.round(F.avg(F.when(F.col("label") == k, F.col("score"))), 6)
    return scored.agg(F.round(F.avg(F.pow(F.col("label") - F.col("score"), 2)), 6).alias("brier"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"), mean(1).alias("mean_match"), mean(0).alias("mean_other"))


def best_and_second(scored: DataFrame) -> DataFrame:
    """(id, best, second, margin, n) per id: its two best scores, 0 for a missing second."""
    order = W.partitionBy("id").orderBy(F.desc("score"))
    top = scored.withColumn("place", F.row_number().over(order)).groupBy("id").agg(F.max("score").alias("best"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.count(F.lit(1)).alias("n"))
    return top.select("id", "best", "second", F.round(F.col("best") - F.col("second"), 4).alias("margin"), "n")


def hard_cases(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` matches of the lowest score under .9 and the ``k`` others of the highest from .9, with ``kind``."""
    low = scored.where("label = 1 AND score < 0.9").orderBy("score", "id").limit(k).withColumn("kind", F.lit("missed"))
    return low.unionByName(scored.where("label = 0 AND score >= 0.9").orderBy(F.desc("score"), "id").limit(k).withColumn("kind", F.lit("false")))


def links(t: DataFrame) -> DataFrame:
    """(a, b): undirected, distinct links between transactions and their counterparts among them."""
    pairs = t.where("counterpart_id IS NOT NULL AND counterpart_id <> id").select(F.least("id", "counterpart_id").alias("a"), F.greatest("id", "counterpart_id").alias("b")).distinct()
    known = t.select(F.col("id").alias("k")).distinct()
    return pairs.join(known, F.col("a") == F.col("k"), "left_semi").join(known, F.col("b") == F.col("k"), "left_semi")


def settled_split(t: DataFrame) -> DataFrame:
    """One row: absolute amounts settled and pending."""
    done = F.upper("status").isin("SETTLED", "MATCHED")
    amt = F.abs(F.col("amount").cast(MONEY))
    return t.agg(_sum(amt, done).alias("settled"), _sum(amt, ~done | F.col("status").isNull()).alias("pending"))


def report_filter(t: DataFrame, statuses: list[str] | None = None, sources: list[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """Rows of a report: by four-way status, source (letter case aside; ``all`` for every one) and dates, the smallest row of each id."""
    out = t
    if statuses and "all" not in [s.lower() for s in statuses]:
        out = out.where(tx.taxonomy(F.col("status")).isin([s.upper() for s in statuses]))
    if sources and "all" not in [s.lower() for s in sources]:
        out = out.where(F.lower("source_name").isin([s.lower() for s in sources]))
    if start is not None:
        out = out.where(F.col("txn_date") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("txn_date") <= F.lit(end))
    return out.groupBy(F.col("id").alias("__id")).agg(F.min(F.struct(*[F.col(c) for c in out.columns])).alias("__r")).select("__r.*")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of the rows in an order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search(df: DataFrame, words: list[str], columns: list[str]) -> DataFrame:
    """Rows that hold any of the words in any of the columns, letter case aside."""
    text = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns]))
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w.lower())
    return df.where(hit)


def amount_search(df: DataFrame, column: str, amount: float, tolerance: float) -> DataFrame:
    """Rows whose amount is within a tolerance; a range that reaches the scan."""
    return df.where(F.col(column).between(amount - tolerance, amount + tolerance))


def lookup(df: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """The row that has the value in one of the id columns, the first column first; among equals the smallest row."""
    rank = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(columns))):
        rank = F.when(F.lower(F.trim(F.col(c).cast("string"))) == value.strip().lower(), k).otherwise(rank)
    return df.withColumn("__rank", rank).where("__rank IS NOT NULL").orderBy("__rank", *columns).limit(1).drop("__rank")


def nearest_lag(gateway: DataFrame, bank: DataFrame, most: int = 14, share: float = 0.05) -> DataFrame:
    """(id, lag): days from a gateway credit to the first bank credit of a like amount within ``most`` days.

    Blocks by logarithm of the amount, as wide as the share allows, and slots of time; a row looks into the next ones too.
    """
    import math

    width = math.log(1 + share)
    block = lambda a: F.floor(F.log(F.greatest(F.abs(a).cast("double"), F.lit(1.0))) / width).cast("int")
    slot = lambda d: F.floor(F.unix_date(d) / (most + 1)).cast("int")
    g = gateway.select("id", F.col("txn_date").alias("g_date"), F.col("amount").alias("g_amount")).dropna()
    g = g.withColumn("block", F.explode(F.sequence(block(F.col("g_amount")) - 2, block(F.col("g_amount")) + 2))).withColumn("slot", F.explode(F.sequence(slot(F.col("g_date")), slot(F.col("g_date")) + 1)))
    b = bank.select(F.col("txn_date").alias("b_date"), F.col("amount").alias("b_amount")).dropna().where("b_amount > 0").groupBy("b_date", "b_amount").agg(F.lit(1).alias("one"))
    b = b.withColumn("block", block(F.col("b_amount"))).withColumn("slot", slot(F.col("b_date")))
    gap = F.datediff("b_date", "g_date")
    near = F.abs(F.col("b_amount") - F.col("g_amount")).cast("double") < F.lit(share) * F.greatest(F.lit(1.0), F.abs(F.col("g_amount")).cast("double"))
    return g.join(b, ["block", "slot"]).where((gap >= 0) & (gap <= most) & near).groupBy("id").agg(F.min(gap).alias("lag"))


def typical_lag(lags: DataFrame, default: int = 2) -> DataFrame:
    """One row: the whole part of the mean lag, at least 1; ``default`` without any."""
    mean = F.floor(F.avg("lag")).cast("int")
    return lags.agg(F.when(mean.isNotNull(), F.greatest(F.lit(1), mean)).otherwise(default).alias("typical_lag"))


def nearest_amount(targets: DataFrame, candidates: DataFrame, width: float = 100.0) -> DataFrame:
    """(id, other_id, amount_gap): for every target the candidate of the nearest amount, ties by smaller id.

    Found with running values over both tables in order of amount: the last candidate before and the first after a target. The
    order is cut into blocks of amounts; a block takes over the nearest candidates of the blocks around it.
    """
    c = candidates.where("amount IS NOT NULL").groupBy("amount").agg(F.min("id").alias("cid"))
    rows = c.select(F.col("amount"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("id"), F.struct("amount", "cid").alias("x"))
    rows = rows.unionByName(targets.where("amount IS NOT NULL").select("amount", F.lit(1).alias("side"), F.col("id").cast("string").alias("id"), F.lit(None).cast(rows.schema["x"].dataType).alias("x")))
    rows = rows.withColumn("block", F.floor(F.col("amount") / width))
    ends = rows.where("side = 0").groupBy("block").agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    blocks = rows.select("block").distinct().join(ends, "block", "left")
    # One row per block of amounts.
    line = W.partitionBy(F.lit(1)).orderBy("block")
    blocks = blocks.select("block", F.last("hi", True).over(line.rowsBetween(W.unboundedPreceding, -1)).alias("below"), F.first("lo", True).over(line.rowsBetween(1, W.unboundedFollowing)).alias("above"))
    inside = W.partitionBy("block").orderBy("amount", "side")
    out = rows.withColumn("before", F.last("x", True).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("after", F.first("x", True).over(inside.rowsBetween(0, W.unboundedFollowing)))
    out = out.where("side = 1").join(blocks, "block").withColumn("before", F.coalesce("before", "below")).withColumn("after", F.coalesce("after", "above"))
    gap = lambda x: F.abs(F.col("amount") - F.col(x + ".amount"))
    pick = F.when(F.col("before").isNull(), F.struct(gap("after").alias("g"), F.col("after.cid").alias("c"))).when(F.col("after").isNull(), F.struct(gap("before").alias("g"), F.col("before.cid").alias("c")))
    pick = pick.otherwise(F.least(F.struct(gap("before").alias("g"), F.col("before.cid").alias("c")), F.struct(gap("after").alias("g"), F.col("after.cid").alias("c"))))
    return out.select("id", pick.alias("p")).select("id", F.col("p.c").alias("other_id"), F.col("p.g").alias("amount_gap")).where("other_id IS NOT NULL")
