from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.keys import reference_key
from ledgerloom.functions.money import money_text
from ledgerloom.operators.stamps import with_utc_us

KEYS = {
    "PAY_7701": "7701", "pay 7701": "7701", "#PAY7701": "7701", " PAY/77/01 ": "7701", "utr no. 00123": "123", "REF:NEFTCR-0012": "12", "'51113": "51113", "6018427447463.0": "6018427447463", "6.3151738250908E13": "63151738250908",
    "9548548-6413991": "95485486413991", "१२३": "123", "1,234": "1234", "CASH": "CASH", "ORD000": "0", "0": "0", "": None, "  ": None, "none": None, "N/A": None, "—": None, "nan": None, None: None, "!!!": None, "7E5": "700000",
}


def test_reference_key(spark):
    df = spark.createDataFrame([(k,) for k in KEYS], "v string").select("v", reference_key(F.col("v")).alias("k"))
    assert {r["v"]: r["k"] for r in df.collect()} == KEYS


def test_money_text(spark):
    want = {"106,860.66": "106860.66", "₹96.90": "96.90", "INR 9277.34 ": "9277.34", "2,235.60 Cr": "2235.60", "517.77 Dr": "-517.77", "(3,358.34)": "-3358.34", "-15136.28": "-15136.28", "-": None, "": None, None: None, "1,59,761.86": "159761.86", "0": "0.00"}
    df = spark.createDataFrame([(k,) for k in want], "v string").select("v", money_text(F.col("v")).alias("m"))
    assert {r["v"]: None if r["m"] is None else str(r["m"]) for r in df.collect()} == want


def local(zone, *parts):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp()) * 10**6


U = lambda *p: local("UTC", *p)
STAMPS = [
    ("2025-01-05T19:34:36+05:30", "K", U(2025, 1, 5, 14, 4, 36)), ("2025-01-04 10:41:19", "N", local("America/New_York", 2025, 1, 4, 10, 41, 19)), ("6/1/2025 23:46:30", "K", local("Asia/Kolkata", 2025, 1, 6, 23, 46, 30)),
    ("6/1/2025 23:46:30", "N", local("America/New_York", 2025, 6, 1, 23, 46, 30)), ("०६/०१/२०२५ १२:४२:४५", "K", local("Asia/Kolkata", 2025, 1, 6, 12, 42, 45)), (" 1736227525", "K", 1736227525 * 10**6), ("1736033941758", "K", 1736033941758000),
    ("2025-01-02 04:18:29 UTC", "K", U(2025, 1, 2, 4, 18, 29)), ("Jan 6, 2025 7:16 PM", "L", U(2025, 1, 6, 19, 16)), ("Sept 9, 2025 12:15 AM", "L", local("Europe/London", 2025, 9, 9, 0, 15)), ("20250108061106", "K", local("Asia/Kolkata", 2025, 1, 8, 6, 11, 6)),
    ("20250108", "K", local("Asia/Kolkata", 2025, 1, 8)), ("29/05/25 09:00 AM", "L", local("Europe/London", 2025, 5, 29, 9)), ("45823", "K", local("Asia/Kolkata", 2025, 6, 15)), ("45712.03125", "L", U(2025, 2, 24, 0, 45)),
    ("2025-02-18T22:47:48.226974709Z", "K", U(2025, 2, 18, 22, 47, 48) + 226974), ("2025-02-16 22:21:59,234", "L", U(2025, 2, 16, 22, 21, 59) + 234000), ("Tue, 21 Jan 2025 14:48:20 +0000", "K", U(2025, 1, 21, 14, 48, 20)),
    ("2025-07-13 03:37:08 EDT", "N", U(2025, 7, 13, 7, 37, 8)), ("24 Feb 2025 12:00:42 PM IST", "K", U(2025, 2, 24, 6, 30, 42)), ("12 February 2025, 08:53", "L", U(2025, 2, 12, 8, 53)), ("14-Feb-25", "L", U(2025, 2, 14)),
    ("2025-03-30 01:30:00", "L", U(2025, 3, 30, 1, 30)), ("2025-10-26 01:30:00", "L", U(2025, 10, 26, 0, 30)), ("2025-11-02 01:16:52", "N", U(2025, 11, 2, 5, 16, 52)), ("2025-03-09 02:30", "N", U(2025, 3, 9, 7, 30)),
    ("\t2025-02-25 01:00:05\xa0", "K", local("Asia/Kolkata", 2025, 2, 25, 1, 0, 5)), ("2025-02-13 03:37:08 AEDT", "K", None), ("31/02/2025", "K", None), ("0000-00-00 00:00:00", "K", None), ("2025-13-45", "K", None), ("pending", "K", None),
    ("", "K", None), (None, "K", None), ("2025-01-01 24:00", "K", None), ("13:00 PM", "K", None), ("x" * 5000, "K", None), ("01/02/2025", "?", None), ("2025-01-05T10:00:00Z", "?", U(2025, 1, 5, 10)), ("2025-01-05", "?", None),
]


@pytest.fixture
def profiles(spark):
    return spark.createDataFrame([("K", "t", "Asia/Kolkata", True), ("N", "t", "America/New_York", False), ("L", "t", "Europe/London", True), ("bad", "t", "No/Where", True)], "feed_code string, fed_table string, home_zone string, day_first boolean")


def test_stamps(spark, profiles):
    # A clashing extra column and a session zone with daylight saving (see conftest) change nothing.
    df = spark.createDataFrame([(i, s, f, "x") for i, (s, f, _) in enumerate(STAMPS)], "row_id int, stamp string, feed string, home_zone string")
    got = {r["row_id"]: r["utc_us"] for r in with_utc_us(df, "stamp", "feed", profiles).collect()}
    wrong = [(s, f, want, got[i]) for i, (s, f, want) in enumerate(STAMPS) if got[i] != want]
    assert len(got) == len(STAMPS) and not wrong


def test_stamps_of_empty_and_unknown(spark, profiles):
    none = spark.createDataFrame([], "stamp string, feed string")
    assert with_utc_us(none, "stamp", "feed", profiles).count() == 0
    df = spark.createDataFrame([("2025-01-01", "bad"), ("2025-01-01", None)], "stamp string, feed string")
    assert [r["utc_us"] for r in with_utc_us(df, "stamp", "feed", profiles.limit(0).unionByName(profiles)).collect()] == [None, None]


def test_padding_of_any_length_is_no_obstacle(spark):
    df = spark.createDataFrame([(1, "F", "2026-01-01" + " " * 500), (2, "F", " " * 500 + "2026-01-01"), (3, "F", "x" * 5000)], "row_id long, feed_code string, s string")
    profiles = spark.createDataFrame([("F", "t", "UTC", True)], "feed_code string, fed_table string, home_zone string, day_first boolean")
    assert [r["utc_us"] for r in with_utc_us(df, "s", "feed_code", profiles).orderBy("row_id").collect()] == [1767225600000000, 1767225600000000, None]
