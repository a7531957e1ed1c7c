"""Problem 3: matching records by nearest time.

Both tables are repartitioned by entity, sorted within partitions and merged by a streaming iterator that
holds only the right records near the left ones it looks at, with one pointer running back and one running on.

An entity here is (account, band of amounts, block of time): an account may hold any share of all rows, so its
rows are cut into cells whose size doesn't grow with the account's. A left row lies in one cell; a right row is
put into every cell that could hold a left row within its tolerances (for most rows one), so every left row
meets all its candidates exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_text
from ..functions.stamps import micros
from ..operators.stamps import with_utc_us

HOUR_US = 3_600_000_000


class NearestMerge:
    """Merges sorted batches of (entity, band, block, t, side, id, cents); side 0 is the right table, 1 the left."""

    def __init__(self, within_us: int, tolerance_cents: int):
        self.within, self.tolerance = within_us, tolerance_cents

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows that later rows may still need
        done = np.zeros(0, bool)  # left rows among them that came out already
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rows = new if held is None else pa.concat_tables([held, new])
            done = np.concatenate([done, np.zeros(new.num_rows, bool)])
            if not rows.num_rows:
                continue
            cell = self._cells(rows)
            t = rows["t"].to_numpy()
            last = cell == cell[-1]
            # Left rows whose window may reach into the next batch wait for it.
            ready = ~done & (~last | (t + self.within < t[-1]))
            yield from self._match(rows, cell, ready)
            done |= ready
            left = rows["side"].to_numpy() == 1
            waiting = left & ~done
            horizon = min(t[waiting].min() if waiting.any() else t[-1], t[-1]) - self.within
            keep = last & (waiting | (~left & (t >= horizon)))
            held, done = rows.filter(pa.array(keep)).combine_chunks(), done[keep]
        if held is not None and held.num_rows:
            yield from self._match(held, self._cells(held), ~done)

    @staticmethod
    def _cells(rows: pa.Table) -> np.ndarray:
        """A number per row that rises where the cell changes."""
        n = rows.num_rows
        change = np.zeros(n, bool)
        for name in ("entity", "band", "block"):
            values = rows[name].combine_chunks()
            if n > 1:
                change[1:] |= pc.not_equal(values.slice(1), values.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        return np.cumsum(change)

    def _match(self, rows: pa.Table, cell: np.ndarray, ready: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, side, ids, cents = (rows[c].to_numpy() for c in ("t", "side", "id", "cents"))
        is_left = (side == 1) & ready
        lefts = np.flatnonzero(is_left)
        rights = np.flatnonzero(side == 0)
        if not len(lefts) or not len(rights):
            return
        rc, rt, rid, rcents = cell[rights], t[rights], ids[rights], cents[rights]
        lc, lt, lcents = cell[lefts], t[lefts], cents[lefts]
        at = np.searchsorted(rights, lefts)  # right rows sorted before the left one
        back_id, back_gap = self._run(at - 1, -1, rc, rt, rid, rcents, lc, lt, lcents)
        on_id, on_gap = self._run(at, 1, rc, rt, rid, rcents, lc, lt, lcents)
        none = np.iinfo(np.int64).max
        # Equally near: the earlier one; at the same moment (gap 0 on both sides) the smaller id.
        back = (back_gap < on_gap) | ((back_gap == on_gap) & ((back_gap > 0) | (back_id <= on_id)))
        best_gap, best = np.where(back, back_gap, on_gap), np.where(back, back_id, on_id)
        hit = best_gap < none
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[lefts][hit]), pa.array(best[hit]), pa.array(best_gap[hit])], names=["left_id", "right_id", "gap_us"])

    def _run(self, start, step, rc, rt, rid, rcents, lc, lt, lcents):
        """The nearest fitting right row for each left one in one direction: its id (the smallest of that moment) and gap."""
        none = np.iinfo(np.int64).max
        found, gap = np.full(len(lc), none), np.full(len(lc), none)
        open_, pos = np.arange(len(lc)), start.copy()
        while len(open_):
            p = pos[open_]
            inside = (p >= 0) & (p < len(rc))
            open_, p = open_[inside], p[inside]
            d = np.abs(rt[p] - lt[open_])
            near = (rc[p] == lc[open_]) & (d <= self.within) & (d <= gap[open_])  # beyond a hit only rows of its very moment matter
            open_, p, d = open_[near], p[near], d[near]
            fits = np.abs(rcents[p] - lcents[open_]) <= self.tolerance
            hit = open_[fits]
            gap[hit], found[hit] = d[fits], np.minimum(found[hit], rid[p[fits]])
            pos[open_] += step
        return found, gap


def nearest_in_time(left: DataFrame, right: DataFrame, within_us: int, tolerance_cents: int, band_cents: int = 5_000, block_us: int = 288 * HOUR_US) -> DataFrame:
    """(left_id, right_id, gap_us): for each left row the right row of its entity nearest in time.

    Both tables have entity (string), id (long, unique), t (microseconds, long), cents (long). A right row fits if its
    amount differs by at most ``tolerance_cents`` and its time by at most ``within_us``. If equally near, the earlier
    one, then the smaller id. A right row may serve several left rows; left rows without one give no row. Rows with a
    null in any of the columns take no part. Empty tables give no rows.
    """
    if band_cents < 2 * tolerance_cents or block_us < 2 * within_us:
        raise ValueError("a cell must be at least twice as wide as its tolerance")
    cols = ["entity", "id", "t", "cents"]
    left, right = left.select(*cols).dropna(), right.select(*cols).dropna()
    cell = lambda value, width: F.floor(value / F.lit(width)).cast("long")
    one = lambda c, w: cell(F.col(c), w)
    span = lambda c, margin, width: F.explode(F.array_distinct(F.array(cell(F.col(c) - margin, width), cell(F.col(c) + margin, width))))
    lefts = left.select("entity", one("cents", band_cents).alias("band"), one("t", block_us).alias("block"), "t", F.lit(1).cast("byte").alias("side"), "id", "cents")
    rights = right.withColumn("band", span("cents", tolerance_cents, band_cents)).withColumn("block", span("t", within_us, block_us))
    rights = rights.select("entity", "band", "block", "t", F.lit(0).cast("byte").alias("side"), "id", "cents")
    keys = ["entity", "band", "block"]
    rows = lefts.unionByName(rights).repartition(*keys).sortWithinPartitions(*keys, "t", "side", "id")
    return rows.mapInArrow(NearestMerge(within_us, tolerance_cents), "left_id long, right_id long, gap_us long")


def settlement_credits(gateway: DataFrame, bank: DataFrame, profiles: DataFrame) -> DataFrame:
    """(settlement_row_id, bank_row_id): each gateway settlement with the bank credit nearest to it in time."""
    left = gateway.select(
        F.col("merchant_id").alias("entity"), F.col("row_id").alias("id"), micros(F.col("settlement_date"), gateway.schema["settlement_date"].dataType).alias("t"), (F.col("net_amount") * 100).cast("long").alias("cents")
    )
    credit = bank.select("merchant_id", "row_id", "feed_code", "txn_date", (money_text(F.col("deposit_cr")) * 100).cast("long").alias("cents")).where("cents > 0")
    right = with_utc_us(credit, "txn_date", "feed_code", profiles, table="bank_statement").select(F.col("merchant_id").alias("entity"), F.col("row_id").alias("id"), F.col("utc_us").alias("t"), "cents")
    return nearest_in_time(left, right, 36 * HOUR_US, 50).select(F.col("left_id").alias("settlement_row_id"), F.col("right_id").alias("bank_row_id"))
