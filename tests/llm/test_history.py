import random
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm.history import History, accept_deliveries, first_rows, numbered, one_slip

SCHEMA = "row_id long, merchant_id string, amount decimal(18,2), tid string, utr string, h string"


def slip(a, b):
    if a == b:
        return False
    if any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))):
        return True
    if len(a) != len(b):
        return False
    diff = [i for i in range(len(a)) if a[i] != b[i]]
    return len(diff) == 1 or (len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]])


def test_one_slip(spark):
    words = ["1234", "1243", "1235", "124", "12344", "21", "12", "1", "2", "", "4321", "123456", "132456", "13245"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = df.select("a", "b", one_slip(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(bool(r["s"]) == slip(r["a"], r["b"]) for r in got)


def made(seed, n=220):
    r = random.Random(seed)
    base = [("hot" if r.random() < 0.4 else "m%d" % r.randrange(4), r.choice([99, 499, 12.5]), str(r.randrange(10**9, 10**10)), str(r.randrange(10**13, 10**14))) for _ in range(40)]

    def typed(s):
        if r.random() < 0.4:
            i, kind = r.randrange(len(s) - 1), r.randrange(4)
            s = [s[:i] + r.choice("0123456789") + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + r.choice("0123456789") + s[i:], s[:i] + s[i + 1] + s[i] + s[i + 2 :]][kind]
        return r.choice([s, "UPI" + s, f" utr no. {s} ", s + ".0", "00" + s, None, "n/a"])

    rows = []
    for i in range(n):
        m, a, t, u = r.choice(base[:3] if r.random() < 0.3 else base)
        rows.append((i, m if r.random() < 0.95 else None, a if r.random() < 0.95 else None, typed(t), typed(u), "x"))
    return rows


def norm(s):
    s = "".join(c for c in (s or "").replace(".0", "") if c.isdigit()).lstrip("0")
    return s or None


def brute(rows):
    groups = defaultdict(list)
    for i, m, a, t, u, _ in rows:
        if m is not None and a is not None:
            groups[m, a].append((i, norm(t), norm(u)))
    out = []
    for members in groups.values():
        root = {x[0]: x[0] for x in members}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                if any(p and q and (p == q or slip(p, q)) for p, q in zip(a[1:], b[1:])):
                    x, y = sorted((find(a[0]), find(b[0])))
                    root[y] = x
        out += [("t", find(i), i) for i in root if find(i) != i]
    return sorted(out)


def frame(spark, rows):
    return numbered(spark.createDataFrame([(i, m, None if a is None else round(a * 100) / 100, t, u, h) for i, m, a, t, u, h in rows], SCHEMA.replace("decimal(18,2)", "double")).withColumn("amount", F.col("amount").cast("decimal(18,2)")), "t", "amount", ["tid", "utr"])


def test_one_run_is_brute_force(spark, tmp_path):
    for seed in (1, 2):
        rows = made(seed)
        assert sorted(map(tuple, first_rows(History(spark, str(tmp_path / str(seed))).accept(frame(spark, rows))).collect())) == brute(rows)


def test_batches_are_one_run_over_restarts(spark, tmp_path):
    rows = made(3)
    for a, b in ((0, 90), (90, 91), (91, 220)):
        History(spark, str(tmp_path / "h")).accept(frame(spark, rows[a:b]))  # each batch by a new object that knows the folder only
    kept = History(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, first_rows(kept.links().drop("turn")).collect())) == brute(rows)
    # A number of an account and amount is stored once, however many batches bring it.
    stored = kept.state.log("index").select("segment", "table_name", "account", "cents", "field", "num")
    assert stored.count() == stored.distinct().count() > 0


def test_deliveries(spark, tmp_path):
    rows = made(4)
    df = frame(spark, rows).withColumn("batch_no", F.when(F.col("row_id") >= 20, F.floor(F.col("row_id") / 20).cast("int")))
    accept_deliveries(df.where("coalesce(batch_no, 0) < 6"), kept := History(spark, str(tmp_path / "h")), at_once=3)
    accept_deliveries(df, kept, at_once=3)
    assert len(kept.state.taken()) == 4
    assert sorted(map(tuple, first_rows(kept.links().drop("turn")).collect())) == brute(rows)


def test_empty(spark, tmp_path):
    kept = History(spark, str(tmp_path / "h"))
    assert first_rows(kept.accept(frame(spark, []))).count() == 0
    accept_deliveries(frame(spark, []).withColumn("batch_no", F.lit(1)), kept)
    assert kept.links().count() == 0
