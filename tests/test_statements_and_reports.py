import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig
from ledgerloom.operators import analytics, forecast, ingest, learn, review
from ledgerloom.sources import readers, sinks
from ledgerloom.sources.store import StatementStore
from ledgerloom.streaming import incremental

CSV = "Date,Narration,Ref / UTR,Withdrawal (Dr),Deposit (Cr),Balance\n2026-07-04,NEFT CR-A,NEFTCR-SETL_9914,0.00,\"15,137.05\",495137.05\n2026-07-05,CHQ,,\"(125,179.68)\",,1\nTotal,,,,9,\n"


def test_csv_to_canonical(spark, tmp_path):
    (tmp_path / "02_bank.csv").write_text(CSV)
    raw = readers.read_statement(spark, str(tmp_path / "02_bank.csv"))
    assert raw.count() == 2 and sorted(r[0] for r in raw.select(readers.ROW).collect()) == [2, 3]
    mapped, missing = ingest.map_columns([c for c in raw.columns if c not in (readers.ROW, "source_file")])
    assert {m.column: m.field for m in mapped}["Withdrawal (Dr)"] == "debit_amount" and "Balance" in missing
    rows = ingest.canonical(raw, mapped, "BNK", F.col(readers.ROW), "02_bank.csv").orderBy("source_row_number").collect()
    assert rows[0]["net_amount"] == Decimal("15137.05") and rows[0]["utr"] == "NEFTCR-SETL_9914" and rows[0]["direction"] == "CREDIT" and len(rows[0]["content_hash"]) == 16
    assert rows[1]["transaction_id"] == "BNK-TXN-0003" and rows[1]["currency"] == "INR"


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("opening\n04/07/2026 NEFT 1,000.00 balance 2,500.50\n2026-07-05 no amount\n")
    assert [tuple(r) for r in readers.read_statement(spark, str(tmp_path / "a.txt")).select("transaction_date", "amount").collect()] == [("04/07/2026", "2,500.50")]
    (tmp_path / "b.csv").write_text("x,,\nStatement of account,,\nDate,Amount,Narration\n2026-01-01,5,hello\n")
    promoted = readers.read_headerless(spark, str(tmp_path / "b.csv"))
    assert promoted.columns[1:] == ["Date", "Amount", "Narration"] and promoted.count() == 1
    with pytest.raises(ValueError):
        readers.read_statement(spark, str(tmp_path / "none.csv"))
    (tmp_path / "c.xyz").write_text("")
    with pytest.raises(ValueError):
        readers.read_statement(spark, str(tmp_path / "c.xyz"))
    assert readers.read_or_empty(spark, str(tmp_path / "gone.csv"), "a string").count() == 0
    (tmp_path / "dir").mkdir()
    for n in ("z_bank.csv", "a_orders.csv", ".hidden.csv"):
        (tmp_path / "dir" / n).write_text("a\n1\n")
    assert [(n, first) for n, first, _ in readers.read_directory(spark, str(tmp_path / "dir"))] == [("a_orders.csv", False), ("z_bank.csv", True)]


def test_store_and_sinks(spark, tmp_path):
    store = StatementStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("h1", 1), ("h2", 2)], "content_hash string, amount int")
    store.put("A", "bank", True, rows)
    store.put("B", "upi", False, rows)
    store.append("A", spark.createDataFrame([("h2", 2), ("h3", 3), ("h3", 3)], rows.schema))
    assert sorted(r["content_hash"] for r in store.get("A").collect()) == ["h1", "h2", "h3"] and store.pool(True).count() == 3
    store.replace_rows("A", spark.createDataFrame([("h1", 9)], rows.schema), "content_hash")
    assert {r["content_hash"]: r["amount"] for r in store.get("A").collect()}["h1"] == 9
    store.drop_columns("A", "amount")
    store.update("A", name="renamed")
    assert store.list()[0]["name"] == "renamed" and "amount" not in store.get("A").columns
    store.delete("A")
    assert [m["statement_id"] for m in store.list()] == ["B"] and store.pool(True) is None
    store.clear()
    assert store.list() == []
    results = spark.createDataFrame([("p", "c", "exact", "SETTLED", 1.0)], "p_id string, c_id string, stage string, status string, confidence double")
    sinks.write_results(results, str(tmp_path / "r"), MatchConfig())
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1 and (tmp_path / "r.config.json").exists()
    sinks.write_csv(spark.createDataFrame([("a,b", 1)], "t string, n int"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["t"] == "a b"


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"date_window": 9, "unknown": 1}')
    monkeypatch.setenv("LEDGER_AMOUNT_TOLERANCE", "2.5")
    cfg = MatchConfig.load(str(tmp_path / "c.json"))
    assert cfg.date_window == 9 and cfg.amount_tolerance == 2.5 and MatchConfig().date_window == 4


def test_dedupe_and_columns(spark):
    rows = [(1, "a", "h1"), (2, "a", "h2"), (3, "b", "h2"), (4, None, "h1"), (5, "c", "h2")]
    df = spark.createDataFrame(rows, "n int, id string, h string")
    got = {r["n"]: r["dup_kind"] for r in ingest.mark_duplicates(df, "n", ["id", "h"]).collect()}
    assert got == {1: None, 2: "id", 3: None, 4: "h", 5: "h"}
    assert ingest.duplicate_report(ingest.mark_duplicates(df.limit(0), "n", ["id"])).first()["total"] == 0
    two = spark.createDataFrame([("₹1,000", "1000", "x"), ("2", " 2 ", "y")], "a string, b string, c string")
    assert [tuple(r) for r in ingest.duplicate_columns(two, ["b"]).collect()] == [("b", "a")]
    assert ingest.duplicate_columns(two.limit(0)).count() == 0


def transactions(spark):
    rows = [
        ("t1", "bank", 100.0, "settled", "exact utr", "t2", 100.0, True), ("t2", "upi", 95.0, "matched", "tolerance fee", "t1", 100.0, False), ("t3", "upi", 5000.0, "exception", "amount and date", None, None, True), ("t4", "upi", -7.0, "manual", "", None, None, False),
    ]
    df = spark.createDataFrame(rows, "id string, source_name string, amount double, status string, rule string, counterpart_id string, counterpart_amount double, is_primary boolean")
    extra = {"txn_date": F.lit("2026-01-01").cast("date"), "score": F.lit(0.5), "duplicate": F.lit(False), "currency": F.lit("INR"), "description": F.lit("x"), "utr": F.lit("U1"), "amount": F.col("amount").cast("decimal(18,2)"), "counterpart_amount": F.col("counterpart_amount").cast("decimal(18,2)")}
    return df.withColumns(extra)


def test_summaries(spark):
    t = transactions(spark)
    k = analytics.kpi_summary(t).first()
    assert (k["total"], k["n_settled"], k["n_matched"], k["n_similar"], k["n_unmatched"], k["match_rate"], k["adds_up"]) == (4, 1, 1, 1, 1, 50.0, True) and k["variance"] == 5000
    assert {r["stage"]: r["n"] for r in analytics.cascade_counts(t).collect()} == {1: 1, 2: 1, 0: 2}
    assert {r["reason"]: r["n"] for r in analytics.mismatch_reasons(t).collect()} == {"Amount Mismatch": 1, "Date/Time Mismatch": 1, "Other": 1}
    cells = {(r["amount_tier"], r["age_tier"]): r["n"] for r in analytics.risk_matrix(t, datetime.date(2026, 1, 5)).collect()}
    assert len(cells) == 16 and cells[1, 1] == 1 and cells[0, 1] == 1
    assert [tuple(r) for r in analytics.links(t).collect()] == [("t1", "t2")]
    none = analytics.kpi_summary(t.limit(0)).first()
    assert none["total"] == 0 and none["match_rate"] == 0 and none["deposits"] == 0
    p = spark.createDataFrame([("a|b", "x"), ("c", "y")], "l string, r string")
    q = spark.createDataFrame([("a", "x"), ("d", "y")], "a string, b string")
    m = analytics.precision_recall(analytics.pair_ids(p, "l", "r"), q).first()
    assert (m["tp"], m["fp"], m["fn"]) == (1, 2, 1)


def test_ledger_keeps_resolutions(spark):
    res = spark.createDataFrame([("S2", "B2", "llm", "review", 0.8, "x"), ("S1", "B1", "ml", "non_match", 0.9, "duplicate"), ("S3", "B3", "ml", "matched", 1.0, "")], "settlement_id string, bank_transaction_id string, stage string, decision string, confidence double, reason string")
    first = review.exception_ledger(res)
    ids = {r["settlement_id"]: (r["exception_id"], r["exception_type"], r["priority"], r["state"]) for r in first.collect()}
    assert ids == {"S1": ("EXC-0001", "duplicate_detected", "high", "open"), "S2": ("EXC-0002", "llm_review", "medium", "open")}
    done = review.decide(first, spark.createDataFrame([("EXC-0002", "resolved", "ok")], "exception_id string, state string, resolution string"))
    again = review.exception_ledger(res, done)
    assert {r["settlement_id"]: r["state"] for r in again.collect()} == {"S1": "open", "S2": "resolved"}
    r = spark.createDataFrame([("p", "c", "exact", "SETTLED")], "p_id string, c_id string, stage string, status string")
    new = review.override(r, spark.createDataFrame([("p", "c", "UNMATCHED"), ("q", "d", "MATCHED"), ("z", "z", "MATCHED")], "p_id string, c_id string, status string"))
    assert sorted((x["p_id"], x["status"], x["stage"]) for x in new.collect()) == [("p", "UNMATCHED", "manual"), ("q", "MATCHED", "manual")]


def test_payroll_pattern_and_forecast(spark):
    day = datetime.date(2026, 8, 3)
    rows = [(day + datetime.timedelta(7 * k), -50000.0, "Payroll run staff 12345678", "settled") for k in range(4)] + [(day + datetime.timedelta(k), 8000.0, f"sale {chr(97 + k % 26)}{k}", "settled") for k in range(28)]
    t = spark.createDataFrame(rows, "txn_date date, amount double, description string, status string").withColumn("id", F.monotonically_increasing_id().cast("string"))
    p = {r["label"]: r for r in forecast.recurring_patterns(t).collect()}["payroll run staff"]
    assert (p["cadence_days"], p["n"], p["next_expected"], p["confidence"]) == (7, 4, datetime.date(2026, 8, 31), 1.0)
    steps = forecast.project_patterns(forecast.recurring_patterns(t).where("label = 'payroll run staff'")).orderBy("step").collect()
    assert [s["confidence_points"] for s in steps] == [99, 97, 94, 91, 88] and steps[1]["date"] == datetime.date(2026, 9, 7)
    out = forecast.forecast(t, days=14, patterns=forecast.recurring_patterns(t)).orderBy("date").collect()
    assert len(out) == 14 and out[0]["date"] == datetime.date(2026, 8, 31) and out[0]["projected"] < out[1]["projected"]
    assert forecast.densify(forecast.daily_flow(t.limit(0))).count() == 0


def test_pending(spark):
    rows = [("a", datetime.date(2026, 8, 9), 100.0, "Processing"), ("b", datetime.date(2026, 7, 1), 5.0, "pending"), ("c", datetime.date(2026, 8, 9), 5.0, "settled")]
    t = spark.createDataFrame(rows, "id string, txn_date date, amount double, status string")
    got = forecast.pending_settlements(t, datetime.date(2026, 8, 10), analytics.typical_lag(spark.createDataFrame([], "lag int"))).collect()
    assert [(r["id"], r["expected"]) for r in got] == [("a", datetime.date(2026, 8, 11))]


def test_features_and_model(spark):
    rows = [(f"s{i}", f"b{i}", Decimal(100 + i), Decimal(100 + i if i % 2 else 900 - i), f"U{i:06d}", f"U{i:06d}" if i % 2 else "U9", i % 2) for i in range(60)]
    pairs = spark.createDataFrame(rows, "s_id string, b_id string, s_amount decimal(18,2), b_amount decimal(18,2), s_utr string, b_utr string, label int")
    f = learn.pair_features(pairs)
    learn.check_features(f)
    with pytest.raises(ValueError):
        learn.check_features(f.drop("utr_match"))
    train, test = learn.split_rows(f)
    assert train.count() + test.count() == 60
    scored = learn.predict(learn.train(train, trees=5, depth=3), test)
    assert all((r["score"] >= 0.5) == bool(r["label"]) for r in scored.collect())
    swapped = learn.pair_features(spark.createDataFrame([("s", "b", Decimal("47097.63"), Decimal("47079.63"))], "s_id string, b_id string, s_amount decimal(18,2), b_amount decimal(18,2)"), textual=False).first()
    assert swapped["is_digit_transposition"] == 1


def test_streams(spark, tmp_path):
    schema = "content_hash string, ts timestamp, value double"
    spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2026-01-01 10:00:00', 1.0D), ('a', TIMESTAMP'2026-01-01 11:00:00', 1.0D), ('b', TIMESTAMP'2026-01-05 10:00:00', 2.0D) AS t(content_hash, ts, value)").write.parquet(str(tmp_path / "in"))
    once = incremental.deduplicated(incremental.read_folder(spark, str(tmp_path / "in"), schema), "ts")
    incremental.run_into(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["content_hash"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    total = incremental.daily_totals(incremental.read_folder(spark, str(tmp_path / "in"), schema))
    incremental.run_into(total, str(tmp_path / "days"), str(tmp_path / "cp2")).awaitTermination()
    assert sum(r["n"] for r in spark.read.parquet(str(tmp_path / "days")).collect()) >= 2


def test_weak_label_reads_narrations(spark):
    from ledgerloom.operators import learn

    rows = [("s1", "b1", "rent hall north", "rent hall", 10.0), ("s2", "b2", "alpha", "quite other words", 10.0), ("s3", "b3", None, None, 10.0), ("s4", "b4", "alpha", "zzz", 900.0)]
    pairs = spark.createDataFrame(rows, "s_id string, b_id string, s_description string, b_description string, s_amount double").withColumn("b_amount", F.lit(900.0))
    pairs = pairs.withColumns({"s_txn_date": F.lit("2026-01-05"), "b_txn_date": F.lit("2026-01-06")})
    got = learn.weak_label(pairs)
    assert {r["settlement_id"]: r["label"] for r in got.collect()} == {"s1": 1, "s2": 0, "s3": 0, "s4": 1} and "__left" not in got.columns


def test_smart_match_reads_descriptions(spark):
    from ledgerloom.operators import qa

    kinds = "id string, amount double, txn_date string, utr string, description string, order_id string"
    t = spark.createDataFrame([("t1", 100.0, "2026-01-05", None, "paid for ord-7781x", None), ("t2", 5.0, "2026-01-05", None, "B55", None), ("t3", 7.0, "2026-01-05", None, "alone", None)], kinds)
    c = spark.createDataFrame([("c1", 900.0, "2026-06-05", None, None, "ORD-7781"), ("c2", None, "2026-06-05", "ab55c", None, None), ("c3", 500.0, "2026-06-05", "ORD", None, "alone")], kinds)
    day = lambda df: df.withColumn("txn_date", F.to_date("txn_date"))
    assert sorted((r["id"], r["other_id"], r["amount_gap"]) for r in qa.smart_match(day(t), day(c)).collect()) == [("t1", "c3", 400.0), ("t2", "c2", None)]


def test_row_numbers_over_blocks_and_quoted_line_ends(spark, tmp_path):
    (tmp_path / "n.csv").write_text('Date,Note\n2026-01-01,"two\nlines"\n2026-01-02,b\n')
    assert [(r["Note"], r[readers.ROW]) for r in readers.read_csv(spark, str(tmp_path / "n.csv")).orderBy(readers.ROW).collect()] == [("two\nlines", 2), ("b", 3)]
    (tmp_path / "long.csv").write_text("k\n" + "".join(f"{i:08d}\n" for i in range(12_345)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = readers.read_csv(spark, str(tmp_path / "long.csv"), multi_line=False)
        assert df.rdd.getNumPartitions() > 1
        assert all(int(r["k"]) + 2 == r[readers.ROW] for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw = spark.createDataFrame([("2026-01-01", n) for n in (7, 12_340, 12_341, 2**33 + 2)], "date string, n long")
    rows = ingest.canonical(raw, [ingest.Mapping("transaction_date", "date", "exact", 1.0)], "TXN", F.col("n"))
    assert sorted(r["transaction_id"] for r in rows.collect()) == ["TXN-TXN-0007", "TXN-TXN-12340", "TXN-TXN-12341", "TXN-TXN-8589934594"]


def test_override_refuses_pairs_of_a_statement(spark):
    r = spark.createDataFrame([("p", "c", "exact", "SETTLED")], "p_id string, c_id string, stage string, status string")
    changes = spark.createDataFrame([("a", "b", "S1", "S1", "MATCHED"), ("a", "e", "S1", "S2", "MATCHED")], "p_id string, c_id string, p_statement_id string, c_statement_id string, status string")
    assert sorted((x["p_id"], x["c_id"]) for x in review.override(r, changes).collect()) == [("a", "e"), ("p", "c")]


def test_split_takes_the_same_share_of_each_label(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("settlement_id"), F.col("id").cast("string").alias("bank_transaction_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    train, test = learn.split_rows(df)
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {0: 180, 1: 20} and train.count() == 800


def test_ledger_numbers_without_a_common_task(spark):
    df = spark.range(500).select(F.concat(F.lit("SETTL_"), F.col("id")).alias("settlement_id"), F.lit("B").alias("bank_transaction_id"), F.lit("ml").alias("stage"), F.lit("open").alias("decision"), F.lit(0.5).alias("confidence"), F.lit("").alias("reason"))
    rows = review.exception_ledger(df).orderBy("settlement_id").collect()
    assert [r["exception_id"] for r in rows] == [f"EXC-{k:04d}" for k in range(1, 501)]
