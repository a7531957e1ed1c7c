"""Problem 1: references to records that do not exist.

Keyed state is kept incrementally (``OrphanState``): for every key of a parent index the number of live parents, and the
references that wait for one. A new reference probes the index when it arrives, an arriving parent resolves
the waiting references of its key, and a deletion that leaves no live parent reopens them. Counts are
snapshot at the end of every turn. The queries run through that state, turn by turn.

Within a turn the state machine of a key runs over its events in time. A key may hold any share of all rows, so no task
gets a key as a whole: events are cut into (key, slice of time), a sum per slice gives every slice its
opening number of live parents, and inside a slice a running sum does the rest.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampType

from ..functions.keys import reference_key, squeeze
from ..session import cut, remove, scratch_path
from .state import State, deal

#: Seconds in a slice of time. The rows of one key in one slice meet in one task.
SLICE_SECONDS = 3600
#: Days of a turn when history is taken in from its beginning; a running system takes in what each delivery brings.
TURN_DAYS = 182
_KEY = ["target", "key"]
_REFERENCE = ["table_name", "row_id", "field_name", "target", "key", "t"]


def _present(field: str) -> Column:
    """The key of a field, rows without one left out; as a generator, so that no filter has the key made twice."""
    return F.explode(F.array_compact(F.array(reference_key(F.col(field))))).alias("key")


def references(df: DataFrame, table: str, field: str, target: Column | str, at: str = "loaded_at", row_id: str = "row_id") -> DataFrame:
    """References of one column: (table_name, row_id, field_name, target, key, t).

    ``target`` names the parent index a reference points into (a string, or a column for references that choose it
    per row; a null target means that nothing can be its parent). Null, blank and nothing-words are no references.
    """
    aim = F.lit(target) if isinstance(target, str) else target
    return df.select(
        F.lit(table).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), F.lit(field).alias("field_name"), aim.alias("target"), _present(field), F.col(at).alias("t")
    )


def parent_changes(df: DataFrame, target: str, field: str, loaded: str = "loaded_at", removed: str | None = None) -> DataFrame:
    """Changes of the number of live parents: (target, key, t, delta).

    A parent lives from ``loaded`` until ``removed`` (null: forever), that moment itself excluded; one never loaded,
    or removed no later than loaded, never lives.
    """
    gone = F.col(removed) if removed else F.lit(None).cast(df.schema[loaded].dataType)
    alive = F.col(loaded).isNotNull() & (gone.isNull() | (gone > F.col(loaded)))
    rows = df.where(alive).select(_present(field), F.col(loaded).alias("a"), gone.alias("b"))
    change = F.explode(F.filter(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("delta")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("delta"))), lambda x: x["t"].isNotNull()))
    return rows.select(F.lit(target).alias("target"), "key", change.alias("c")).select("target", "key", "c.t", "c.delta")


def _seconds(kind: DataType) -> Column:
    """Seconds of ``t`` since 1970, in a session's zone or none, rising with ``t``."""
    if isinstance(kind, TimestampType):
        return F.unix_seconds("t")
    return F.unix_date(F.col("t").cast("date")).cast("long") * 86400 + F.hour("t") * 3600 + F.minute("t") * 60 + F.floor(F.second("t"))


def opened_on_arrival(refs: DataFrame, changes: DataFrame, live: DataFrame | None = None, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """The references that find no live parent when they arrive, as (table_name, row_id, field_name, target, key, t).

    ``live`` is the opening state (target, key, live) of the parent index. At one moment parents come and go before
    references probe. References without a time or a target have no parent. Repeated rows count each.
    """
    at = F.floor(_seconds(refs.schema["t"].dataType) / slice_seconds).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    keyed = refs.where(F.col("t").isNotNull() & F.col("target").isNotNull()).select("target", "key", at.alias("slice"), "t", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("delta"), "table_name", "row_id", "field_name")
    moved = changes.select("target", "key", at.alias("slice"), "t", F.lit(0).alias("rank"), F.col("delta").cast("long").alias("delta"), none("string").alias("table_name"), none("long").alias("row_id"), none("string").alias("field_name"))
    events = moved.unionByName(keyed)
    sums = events.groupBy(*_KEY, "slice").agg(F.sum("delta").alias("delta"))
    if live is not None:
        sums = sums.unionByName(live.select("target", "key", F.lit(-(2**62)).alias("slice"), F.col("live").alias("delta")))
    before = W.partitionBy(*_KEY).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    opening = sums.select(*_KEY, "slice", F.sum("delta").over(before).alias("delta")).where(F.col("delta") != 0)
    stamp = refs.schema["t"].dataType
    opening = opening.select("target", "key", "slice", none(stamp).alias("t"), F.lit(-1).alias("rank"), "delta", none("string").alias("table_name"), none("long").alias("row_id"), none("string").alias("field_name"))
    running = W.partitionBy(*_KEY, "slice").orderBy(F.col("t").asc_nulls_first(), "rank").rowsBetween(W.unboundedPreceding, 0)
    found = events.unionByName(opening).withColumn("alive", F.sum("delta").over(running)).where((F.col("rank") == 1) & (F.col("alive") <= 0))
    timeless = refs.where(F.col("t").isNull() | F.col("target").isNull())
    return found.select(*_REFERENCE).unionByName(timeless.select(*_REFERENCE))


class OrphanState:
    """Keyed state between turns, in a folder that a new process goes on from.

    live: (target, key, delta), the change of a key's live parents in a turn. refs: every reference taken in. pending:
    (reference, step), +1 where it began to wait for a parent, -1 where one resolved it. opened: the references that found
    no live parent on arrival.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        reference = "target STRING, key STRING, table_name STRING, row_id BIGINT, field_name STRING"
        logs = {"live": "target STRING, key STRING, delta BIGINT", "refs": reference, "pending": f"{reference}, step INT", "opened": f"{reference}, t TIMESTAMP_NTZ"}
        self.state = State(spark, path, {log: (columns, _KEY) for log, columns in logs.items()}, buckets)

    def advance(self, refs: DataFrame, changes: DataFrame, note: dict | None = None) -> None:
        """Take in a turn, all of it later than what was taken in before.

        Only keys that the turn touches are looked up, and only references of keys that won their first parent or lost their
        last one are resolved or reopened. References without a time or a target have no parent; they are opened and never wait.
        """
        with self.state.turn() as left:
            left |= note or {}
            own = changes.groupBy(*_KEY).agg(F.sum("delta").alias("delta"))
            asked = refs.where(F.col("t").isNotNull() & F.col("target").isNotNull())
            touched = own.unionByName(asked.select(*_KEY, F.lit(0).cast("long").alias("delta"))).groupBy(*_KEY).agg(F.sum("delta").alias("moved"))
            stored = self.state.log("live").groupBy(*_KEY).agg(F.sum("delta").alias("live"))
            keys = cut(touched.hint("shuffle_hash").join(stored, _KEY, "left").select(*_KEY, "moved", F.coalesce("live", F.lit(0)).alias("before")).withColumn("after", F.col("before") + F.col("moved")))
            found = opened_on_arrival(refs, changes, keys.where("before <> 0").select(*_KEY, F.col("before").alias("live")))
            turned = keys.where((F.col("before") > 0) != (F.col("after") > 0))
            columns = [*_KEY, "table_name", "row_id", "field_name"]
            resolved = turned.where("after > 0").select(*_KEY).hint("shuffle_hash").join(self._waiting(), _KEY).select(*columns, (-F.col("n")).cast("int").alias("step"))
            reopened = turned.where("after <= 0").select(*_KEY).hint("shuffle_hash").join(self.state.log("refs"), _KEY).select(*columns, F.lit(1).alias("step"))
            orphaned = asked.join(keys.where("after > 0").select(*_KEY), _KEY, "left_anti").select(*columns, F.lit(1).alias("step"))
            steps = cut(resolved.unionByName(reopened).unionByName(orphaned))
            self.state.append(opened=found.withColumn("t", F.col("t").cast("timestamp_ntz")), pending=steps, refs=asked, live=own.where(F.col("delta") != 0))

    def _waiting(self) -> DataFrame:
        return self.state.log("pending").groupBy(*_KEY, "table_name", "row_id", "field_name").agg(F.sum("step").alias("n")).where("n > 0")

    def opened(self) -> DataFrame:
        """The references that found no live parent when they arrived, with their turn."""
        return self.state.log("opened")

    def waiting(self) -> DataFrame:
        """(target, key, table_name, row_id, field_name, n): the references that have no live parent now; copies of a row in n."""
        return self._waiting()

    def snapshots(self) -> DataFrame:
        """(turn, table_name, field_name, n_opened, n_waiting) at the end of every turn in which a reference of the field was opened, resolved or reopened."""
        fields = ["turn", "table_name", "field_name"]
        opened = self.opened().groupBy(*fields).agg(F.count(F.lit(1)).alias("n_opened"))
        moved = self.state.log("pending").groupBy(*fields).agg(F.sum("step").alias("step"))
        upto = W.partitionBy("table_name", "field_name").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
        both = opened.join(moved, fields, "full").select(*fields, F.coalesce("n_opened", F.lit(0)).alias("n_opened"), F.coalesce("step", F.lit(0)).alias("step"))
        return both.select(*fields, "n_opened", F.sum("step").over(upto).alias("n_waiting"))


def run_turns(spark: SparkSession, refs: DataFrame, changes: DataFrame, path: str, days: int = TURN_DAYS) -> OrphanState:
    """Takes all events into the state under ``path``, ``days`` days a turn (counted from 1970-01-01); a state that has turns goes on after its last day.

    The events are dealt to their turns once, so that a turn reads only its own. References without a time come in the first one.
    """
    kept = OrphanState(spark, path)
    number = F.floor(F.unix_date(F.col("t").cast("date")) / days).cast("int")
    done = max((note["number"] for note in kept.state.taken().values()), default=None)
    dealt = {"refs": refs.withColumn("of", number), "changes": changes.withColumn("of", number)}
    if done is not None:
        dealt = {name: df.where(F.col("of") > done) for name, df in dealt.items()}
    folder = scratch_path(spark, "dealt")
    dealt = {name: deal(df, f"{folder}/{name}") for name, df in dealt.items()}
    # One number per turn.
    numbers = sorted(r["of"] for r in dealt["refs"].select("of").unionByName(dealt["changes"].select("of")).distinct().collect() if r["of"] is not None)
    for k in numbers or ([0] if done is None else []):
        first = done is None and k == (numbers or [0])[0]
        mine = F.col("of") == k
        kept.advance(dealt["refs"].where(mine | F.col("of").isNull() if first else mine).drop("of"), dealt["changes"].where(mine).drop("of"), {"number": k, "start": str(date(1970, 1, 1) + timedelta(days=k * days))})
    remove(spark, folder)
    return kept


def settlement_references(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """References and parent changes of the settlement and refund reports."""
    gateway, refunds = tables["gateway_settlements"], tables["refunds_report"]
    kind = F.upper(F.regexp_replace(squeeze(F.col("source_type")), r"\s", ""))
    refs = (
        references(gateway, "gateway_settlements", "order_id", "order")
        .unionByName(references(gateway, "gateway_settlements", "payment_id", "payment"))
        .unionByName(references(refunds, "refunds_report", "original_reference", F.when(kind == "UPI", "upi").when(kind == "PAYPAL", "paypal").when(kind == "GATEWAY", "payment")))
    )
    changes = (
        parent_changes(tables["order_register"], "order", "order_id", removed="removed_at")
        .unionByName(parent_changes(tables["payment_register"], "payment", "payment_id", removed="removed_at"))
        .unionByName(parent_changes(tables["upi_wallet_txns"], "upi", "reference_utr", removed="removed_at"))
        .unionByName(parent_changes(tables["paypal_statement"], "paypal", "transaction_id", removed="removed_at"))
    )
    return refs, changes


def orphans_found(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_id, field_name) of every reference without a live target when its row was loaded."""
    spark = next(iter(tables.values())).sparkSession
    kept = run_turns(spark, *settlement_references(tables), scratch_path(spark, "orphans"))
    return kept.opened().select("table_name", "row_id", "field_name").distinct()


def orphans_report(tables: dict[str, DataFrame], days: int = 91) -> DataFrame:
    """(table_name, field_name, period, n_opened, n_waiting): per field and turn of ``days`` days, by its first day, the references opened as orphans in it, and the orphans waiting at its end."""
    spark = next(iter(tables.values())).sparkSession
    kept = run_turns(spark, *settlement_references(tables), scratch_path(spark, "orphans"), days)
    turns = spark.createDataFrame([(k, date.fromisoformat(note["start"])) for k, note in kept.state.taken().items()], "turn int, period date")
    return kept.snapshots().join(turns, "turn").select("table_name", "field_name", "period", "n_opened", "n_waiting")
