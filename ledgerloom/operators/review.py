"""Exception ledger, human decisions and the deterministic decision on a cluster of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import score
from ..functions import taxonomy as tx
from ..session import cut

_PAIR = ["settlement_id", "bank_transaction_id"]


def exception_ledger(results: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Open results (settlement_id, bank_transaction_id, stage, decision, confidence, reason) with type, priority and state.

    Resolutions (state, resolution) of an earlier ledger are kept by pair. Ids EXC-0001 and on follow the order of the pairs; they
    are given out by ranges of the order: a sum per range, then a place inside it, so no task holds all rows.
    """
    open_ = results.where(~F.lower(F.coalesce("decision", F.lit(""))).isin("match", "matched"))
    kind = tx.exception_type(F.col("stage"), F.col("decision"), F.col("reason"))
    rows = open_.select(*_PAIR, "stage", "decision", "confidence", "reason", kind.alias("exception_type")).withColumn("priority", tx.exception_priority(F.col("exception_type"), F.col("confidence")))
    if previous is None:
        rows = rows.withColumn("state", F.lit("open")).withColumn("resolution", F.lit(None).cast("string"))
    else:
        old = previous.where("state <> 'open'").groupBy(*[F.col(k).alias("__" + k) for k in _PAIR]).agg(F.max(F.struct("state", "resolution")).alias("__old"))
        rows = rows.join(old, [F.col(k).eqNullSafe(F.col("__" + k)) for k in _PAIR], "left").withColumn("state", F.coalesce("__old.state", F.lit("open"))).withColumn("resolution", F.col("__old.resolution"))
        rows = rows.drop("__old", *["__" + k for k in _PAIR])
    # Ranges of the order, as many as the session shuffles to; a row's number is its place in its range after the ranges before.
    order = [*_PAIR, "stage", "reason", "decision", "confidence"]
    rows = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("__slice", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__slice").alias("__s"), (F.sum("__n").over(W.orderBy("__slice")) - F.col("__n")).alias("__before"))
    out = rows.join(before, F.col("__slice") == F.col("__s")).withColumn("exception_id", F.format_string("EXC-%04d", F.col("__at") + F.col("__before") + 1))
    return out.drop("__slice", "__at", "__s", "__before")


def exceptions_like(ledger: DataFrame, priority: str | None = None, kind: str | None = None, only_open: bool = False) -> DataFrame:
    """Exceptions of a priority, with a text in their type, still open; whatever the case, each condition only where it is given."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    where = F.lit(True)
    if priority:
        where = where & (low("priority") == priority.lower())
    if kind:
        where = where & low("exception_type").contains(kind.lower())
    if only_open:
        where = where & (low("state") == "open")
    return ledger.where(where)


def open_counts(ledger: DataFrame) -> DataFrame:
    """One row: n_open, and n_high, the open ones of high priority."""
    open_ = F.lower("state") == "open"
    return ledger.agg(F.count(F.when(open_, 1)).alias("n_open"), F.count(F.when(open_ & (F.lower("priority") == "high"), 1)).alias("n_high"))


def exception_summary(ledger: DataFrame) -> DataFrame:
    """(exception_type, priority, state, n)."""
    return ledger.groupBy("exception_type", "priority", "state").agg(F.count(F.lit(1)).alias("n"))


def decide(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """The ledger with decisions (exception_id, state, resolution) written in; the greatest of several for one exception."""
    d = decisions.groupBy(F.col("exception_id").alias("__id")).agg(F.max(F.struct("state", "resolution")).alias("__d"))
    out = ledger.join(d, F.col("exception_id") == F.col("__id"), "left")
    return out.withColumn("state", F.coalesce("__d.state", "state")).withColumn("resolution", F.coalesce("__d.resolution", "resolution")).drop("__id", "__d")


def override(results: DataFrame, changes: DataFrame) -> DataFrame:
    """Results with manual statuses (p_id, c_id, status) written over; pairs that weren't there are added.

    A row paired with itself is refused, and where the changes name statements (p_statement_id, c_statement_id) a pair of one statement.
    """
    same = F.coalesce(F.col("p_id") == F.col("c_id"), F.lit(False))
    if {"p_statement_id", "c_statement_id"} <= set(changes.columns):
        same = same | F.coalesce(F.col("p_statement_id") == F.col("c_statement_id"), F.lit(False))
    c = changes.where(~same).groupBy("p_id", "c_id").agg(F.max("status").alias("__status"))
    kept = results.join(c.withColumnsRenamed({"p_id": "__p", "c_id": "__c"}), F.col("p_id").eqNullSafe(F.col("__p")) & F.col("c_id").eqNullSafe(F.col("__c")), "left")
    kept = kept.withColumn("stage", F.when(F.col("__status").isNotNull(), "manual").otherwise(F.col("stage"))).withColumn("status", F.coalesce("__status", "status")).drop("__p", "__c", "__status")
    new = c.join(results.select("p_id", "c_id"), ["p_id", "c_id"], "left_anti").select("p_id", "c_id", F.lit("manual").alias("stage"), F.col("__status").alias("status"))
    return kept.unionByName(new, allowMissingColumns=True)


def decide_cluster(candidates: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(p_id, c_id, decision, confidence): of ranked candidates (place, amount_gap, day_gap, narration, id_type) the first; a match if within 1.00."""
    top = candidates.where("place = 1")
    sure = score.confidence(F.col("id_type"), F.col("amount_gap"), F.col("day_gap"), F.col("narration"), cfg=cfg)
    return top.select("p_id", "c_id", F.when(F.col("amount_gap") <= cfg.amount_tolerance, "match").otherwise("non_match").alias("decision"), sure.alias("confidence"))
