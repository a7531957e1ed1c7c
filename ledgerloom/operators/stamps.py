"""Problem 4: mixed timestamp formats and time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stamps import clean_stamp, known_zone, steps_to_utc_us

#: table, column of the stamp
STAMPED = [("bank_statement", "txn_date"), ("paypal_statement", "txn_date"), ("vendor_register", "payment_date"), ("manual_receipts", "receipt_date")]


def with_utc_us(df: DataFrame, stamp: str, feed: str, profiles: DataFrame, out: str = "utc_us", table: str | None = None) -> DataFrame:
    """``df`` with the instant of ``stamp`` (a column's name) in microseconds since 1970-01-01 UTC, null where it denotes none.

    ``profiles`` has one row per feed: feed_code, fed_table, home_zone, day_first. With ``table`` only the rows of
    that ``fed_table`` count. A row whose feed is unknown keeps its stamp only if the stamp carries its own zone
    and is written without feed order. Null, empty and meaningless stamps, impossible days, times and zones give
    null; very long texts match no anchored pattern and give null. No row is lost or repeated, whatever else
    ``df`` holds: the helper columns have names of their own. A feed listed twice counts with its smallest row.
    """
    rows = profiles if table is None or "fed_table" not in profiles.columns else profiles.where(F.col("fed_table") == table)
    rows = rows.groupBy(F.col("feed_code").alias("__feed")).agg(F.min(F.struct("home_zone", "day_first")).alias("__profile"))
    rows = rows.select("__feed", known_zone(F.col("__profile.home_zone")).alias("__home_zone"), F.col("__profile.day_first").alias("__day_first"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    # The profiles are a fixed list of senders; below the session's broadcast threshold Spark broadcasts them, beyond it it shuffles.
    work = df.join(rows, F.col(f"`{feed}`") == F.col("__feed"), "left")
    work = work.withColumn("__clean", clean_stamp(F.col(f"`{stamp}`")))
    for step in steps_to_utc_us("__home_zone", "__day_first"):
        work = work.withColumns(step)
    # Explode of one value changes no row; it keeps later filters on the instant from being pushed into, and repeated through, every step above.
    return work.select(*kept, F.explode_outer(F.array("__us")).alias(out))


def stamps_found(tables: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """(table_name, row_id, utc_us) of every row of the stamped tables whose stamp denotes an instant."""
    parts = []
    for name, column in STAMPED:
        df = with_utc_us(tables[name].select("row_id", "feed_code", column), column, "feed_code", profiles, table=name)
        parts.append(df.where(F.col("utc_us").isNotNull()).select(F.lit(name).alias("table_name"), "row_id", "utc_us"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
