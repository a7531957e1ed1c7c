"""Questions about single records, the run's view of every transaction, and display values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, taxonomy, text
from .analytics import lookup
from .contain import contained


def run_view(records: DataFrame, results: DataFrame, period_settled: bool = False) -> DataFrame:
    """One row per record (id, amount, ...): its best result's status, counterpart and confidence, and its four-way status.

    Results (p_id, c_id, stage, status, confidence) count for both ends; of several the best status, then the highest
    confidence, then the smaller counterpart. Records without a result are unmatched.
    """
    rank = F.when(F.upper("status") == "SETTLED", 0).when(F.upper("status") == "MATCHED", 1).when(F.upper("status") == "SIMILAR", 2).otherwise(3)
    side = lambda a, b: results.select(F.col(a).alias("__id"), F.struct(rank.alias("rank"), (-F.col("confidence")).alias("minus"), F.coalesce(b, F.lit("")).alias("other"), "status", "stage").alias("x"))
    ends = side("p_id", "c_id").unionByName(side("c_id", "p_id")).where("__id IS NOT NULL")
    best = ends.groupBy("__id").agg(F.min("x").alias("x"))
    out = records.join(best, F.col("id") == F.col("__id"), "left")
    status = F.coalesce("x.status", F.lit("UNMATCHED"))
    return out.select(*[F.col(c) for c in records.columns], F.nullif("x.other", F.lit("")).alias("counterpart_id"), F.coalesce("x.stage", F.lit("none")).alias("match_stage"), F.coalesce(-F.col("x.minus"), F.lit(0.0)).alias("match_confidence"), taxonomy.taxonomy(status, period_settled).alias("taxonomy"))


def smart_match(targets: DataFrame, candidates: DataFrame, amount: float = 5.0, days: int = 14) -> DataFrame:
    """(id, other_id, amount_gap, day_gap): for every target (id, amount, txn_date, utr, description) the nearest candidate by amount, then date, then id.

    A candidate is within ``amount`` and ``days``, or has the same reference, or its reference (utr, else bank_transaction_id,
    settlement_id, order_id) stands in the target's description or the other way round, whatever the case. Found by cells of amount
    and time, by the reference and by stretches of the texts. Missing columns count as null; a missing amount comes last.
    """
    cell = lambda c: F.floor(F.abs(F.col(c)) / amount).cast("long")
    slot = lambda c: F.floor(F.unix_date(F.col(c)) / (days + 1)).cast("int")
    ref = lambda c: F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))
    known = lambda df, *names: F.coalesce(*[ref(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    t = targets.select(F.col("id"), F.col("amount").alias("ta"), F.col("txn_date").alias("td"), ref("utr").alias("tr"), known(targets, "description").alias("tt"))
    c = candidates.select(F.col("id").alias("other_id"), F.col("amount").alias("ca"), F.col("txn_date").alias("cd"), ref("utr").alias("cr"), known(candidates, "utr", "bank_transaction_id", "settlement_id", "order_id").alias("ct"))
    near = t.withColumn("cell", F.explode(F.sequence(cell("ta") - 1, cell("ta") + 1))).withColumn("slot", F.explode(F.sequence(slot("td") - 1, slot("td") + 1)))
    near = near.join(c.withColumn("cell", cell("ca")).withColumn("slot", slot("cd")), ["cell", "slot"]).where((F.abs(F.col("ta") - F.col("ca")) <= amount) & (F.abs(F.datediff("td", "cd")) <= days)).drop("cell", "slot")
    same = t.join(c, F.col("tr") == F.col("cr"))
    texts, refs = t.select(F.col("tt").alias("x")), c.select(F.col("ct").alias("x"))
    said = contained(texts.toDF("whole"), refs.toDF("part"), 1).toDF("tt", "ct").unionByName(contained(refs.toDF("whole"), texts.toDF("part"), 1).toDF("ct", "tt")).distinct()
    both = near.unionByName(same).unionByName(said.join(t, "tt").join(c, "ct")).where("id <> other_id")
    gap = F.abs(F.col("ta") - F.col("ca"))
    best = both.groupBy("id").agg(F.min(F.struct(gap.isNull().alias("unknown"), gap.alias("amount_gap"), F.coalesce(F.abs(F.datediff("td", "cd")), F.lit(999)).alias("day_gap"), "other_id")).alias("b"))
    return best.select("id", "b.other_id", "b.amount_gap", "b.day_gap")


def record(df: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """The one record that an id in any of the columns names; no row if there is none."""
    return lookup(df, value, columns)


def explain(pairs: DataFrame) -> DataFrame:
    """(p_id, c_id, amount_match, date_match, reference_match, words, verdict) of pairs (p_/c_ amount, txn_date, utr, description)."""
    same_ref = F.coalesce(F.upper(F.trim("p_utr")) == F.upper(F.trim("c_utr")), F.lit(False))
    amt, day = amount_match(F.col("p_amount"), F.col("c_amount")), date_match(F.col("p_txn_date"), F.col("c_txn_date"))
    verdict = F.when(same_ref & (amt >= 95), "same reference").when((amt == 100) & (day >= 40), "same amount").when(amt >= 95, "like amount").otherwise("different")
    return pairs.select("p_id", "c_id", amt.alias("amount_match"), day.alias("date_match"), F.when(same_ref, 100).otherwise(40).alias("reference_match"), text.shared_keywords(F.col("p_description"), F.col("c_description")).alias("words"), verdict.alias("verdict"))


def amount_match(target: Column, other: Column) -> Column:
    """100 less the gap as a percentage of the target (of 1 at least), 0 at least, to one digit."""
    gap = F.abs(target - other).cast("double")
    return F.greatest(F.lit(0.0), F.round(100 - gap / F.greatest(F.lit(1.0), F.abs(target).cast("double")) * 100, 1))


def date_match(a: Column, b: Column) -> Column:
    """100 less 15 a day, 0 at least; 0 where a date is missing."""
    return F.coalesce(F.greatest(F.lit(0), 100 - 15 * dates.day_gap(a, b)), F.lit(0))


def search_stats(hits: DataFrame) -> DataFrame:
    """One row over found transactions (amount, status): rows, sum, matched rows and rate, open amount, statuses found."""
    ok = taxonomy.taxonomy(F.col("status")).isin("SETTLED", "MATCHED")
    n, m, amt = F.count(F.lit(1)), F.count(F.when(ok, 1)), F.col("amount").cast("decimal(18,2)")
    return hits.agg(n.alias("n"), F.coalesce(F.sum(amt), F.lit(0)).alias("total"), m.alias("n_matched"), F.when(n > 0, F.round(m * 100.0 / n, 1)).otherwise(0.0).alias("match_rate"), F.coalesce(F.sum(F.when(~ok, F.abs(amt))), F.lit(0)).alias("open_amount"), F.array_sort(F.collect_set(F.lower("status"))).alias("statuses"))


def serials(statements: DataFrame) -> DataFrame:
    """Statements (statement_id) with a code of three letters each, by the order of their ids. There are as many rows as statements."""
    n = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("statement_id")) - 1
    letter = lambda k: F.chr(F.lit(65) + (F.floor(n / k) % 26).cast("int"))
    return statements.withColumn("serial_code", F.concat(letter(676), letter(26), letter(1)))


def number_rows(rows: DataFrame, order: str) -> DataFrame:
    """Rows (statement_id, ...) with serial_no ``CODE-n`` by their order in the statement.

    Numbers are given out by slices of the order: a count per slice, then a number inside it, so a statement needs no task of its own.
    """
    codes = serials(rows.select("statement_id").distinct())
    cut = rows.withColumn("__slice", F.floor(F.col(order) / 10_000))
    sizes = cut.groupBy("statement_id", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.partitionBy("statement_id").orderBy("__slice")) - F.col("__n")).drop("__n")
    place = F.row_number().over(W.partitionBy("statement_id", "__slice").orderBy(order)) + F.col("__before")
    out = cut.join(before, ["statement_id", "__slice"]).join(codes, "statement_id")
    return out.withColumn("serial_no", F.concat_ws("-", "serial_code", place)).drop("__slice", "__before")


def display_date(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def due_on(patterns: DataFrame, pending: DataFrame, day: date) -> DataFrame:
    """(kind, label, amount) that a future day brings: pending settlements due and recurring payments whose cycle hits it."""
    ahead = F.datediff(F.lit(day), "next_expected")
    hits = patterns.where((ahead >= 0) & (ahead % F.col("cadence_days") == 0)).select(F.lit("recurring").alias("kind"), "label", F.col("avg_amount").cast("double").alias("amount"))
    return hits.unionByName(pending.where(F.col("expected") == F.lit(day)).select(F.lit("pending").alias("kind"), F.col("id").alias("label"), F.col("amount").cast("double").alias("amount")))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row over (score, label): tn, fp, fn, tp, accuracy, precision, recall, f1 (4 digits)."""
    hit = F.col("score") >= threshold
    n = lambda a, b: F.count(F.when((hit == F.lit(a)) & (F.col("label") == b), 1))
    c = scored.agg(n(False, 0).alias("tn"), n(True, 0).alias("fp"), n(False, 1).alias("fn"), n(True, 1).alias("tp"))
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select("*", rate(tp + tn, tp + tn + fp + fn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def feedback_examples(ledger: DataFrame, features: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Training examples from decided exceptions: features of their pairs with a label from the decision; a later example of a pair replaces a known one."""
    done = ledger.where("state <> 'open'").groupBy("settlement_id", "bank_transaction_id").agg(F.max(F.coalesce("resolution", "state")).alias("__r"))
    new = features.drop("label").join(done, ["settlement_id", "bank_transaction_id"]).withColumn("label", taxonomy.feedback_label(F.col("__r"))).drop("__r")
    if known is None:
        return new
    return known.join(new.select("settlement_id", "bank_transaction_id"), ["settlement_id", "bank_transaction_id"], "left_anti").select(*new.columns).unionByName(new)
