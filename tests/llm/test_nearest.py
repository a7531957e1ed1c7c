import random

import pytest

from ledgerloom.llm.nearest import HOUR_US, nearest_in_time

SCHEMA = "entity string, id long, t long, cents long, block string"


def brute(left, right, within, tolerance):
    out = []
    for e, i, t, c, _ in left:
        if None in (e, i, t, c):
            continue
        fits = [(abs(u - t), u, j) for f, j, u, d, _ in right if f == e and None not in (j, u, d) and abs(d - c) <= tolerance and abs(u - t) <= within]
        if fits:
            gap, _, j = min(fits)
            out.append((i, j, gap))
    return sorted(out)


def made(seed, n, span):
    r = random.Random(seed)
    row = lambda i: (r.choice(["hot", "hot", "hot", "a", "b", None]), i, r.choice([None, *[r.randrange(span)] * 20]), r.choice([9690, 9690, 9700, 4999, 5000, 5001, r.randrange(20_000), None]), "z")
    return [row(i) for i in range(n)], [row(10_000 + i) for i in range(n)]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_is_brute_force(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for seed, span in ((1, 40 * HOUR_US), (2, 4000 * HOUR_US), (3, 30)):
            left, right = made(seed, 250, span)
            within = 36 * HOUR_US if span > 30 else 4
            got = nearest_in_time(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), within, 50, block_us=max(2 * within, 72 * HOUR_US if span > 30 else 8))
            assert sorted(map(tuple, got.collect())) == brute(left, right, within, 50)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_ties_and_repeats(spark):
    left = [("a", 1, 100, 0, ""), ("a", 2, 100, 0, "")]
    right = [("a", 9, 90, 0, ""), ("a", 8, 110, 0, ""), ("a", 7, 90, 0, ""), ("a", 5, 100, 51, "")]
    got = nearest_in_time(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 10, 50)
    assert sorted(map(tuple, got.collect())) == [(1, 7, 10), (2, 7, 10)]


def test_empty_and_bad_cells(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", 1, 1, 1, "")], SCHEMA)
    assert nearest_in_time(none, some, 1, 1).count() == nearest_in_time(some, none, 1, 1).count() == 0
    with pytest.raises(ValueError):
        nearest_in_time(some, some, 10, 50, band_cents=60)
