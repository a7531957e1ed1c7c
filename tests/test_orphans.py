import random
from datetime import datetime, timedelta

import pytest

from ledgerloom.operators.orphans import OrphanState, opened_on_arrival, parent_changes, references, run_turns

T0 = datetime(2025, 1, 1)
REFS = "row_id long, ref string, loaded_at timestamp_ntz, extra string"
PARENTS = "ref string, loaded_at timestamp_ntz, removed_at timestamp_ntz"


def made(seed, n=300, keys=25):
    r = random.Random(seed)
    at = lambda: T0 + timedelta(hours=r.randrange(0, 24 * 60))
    key = lambda: "ORD7" if r.random() < 0.35 else r.choice([f"ORD{k}", f"ord {k}", f"#{k}.0", None, "n/a"]) if (k := r.randrange(keys)) is not None else None
    refs = [(i, key(), at() if r.random() < 0.97 else None, "x") for i in range(n)]
    parents = [(key(), a := at(), a + timedelta(hours=r.randrange(-5, 300)) if r.random() < 0.5 else None) for _ in range(n // 2)]
    return refs, parents


def norm(v):
    if v is None or v == "n/a":
        return None
    return str(int(float("".join(c for c in v if c.isdigit() or c == "."))))


def brute(refs, parents):
    live = lambda k, t: any(norm(p) == k and a is not None and t is not None and a <= t and (b is None or b > t) for p, a, b in parents)
    return sorted(i for i, v, t, _ in refs if norm(v) is not None and not live(norm(v), t))


def frames(spark, refs, parents):
    r = references(spark.createDataFrame(refs, REFS), "t", "ref", "order")
    return r, parent_changes(spark.createDataFrame(parents, PARENTS), "order", "ref", removed="removed_at")


def test_opened_is_brute_force(spark):
    for seed in (1, 2):
        refs, parents = made(seed)
        for seconds in (900, 3600, 40 * 86400):
            got = opened_on_arrival(*frames(spark, refs, parents), slice_seconds=seconds)
            assert sorted(r["row_id"] for r in got.collect()) == brute(refs, parents)


def test_same_moment_and_never_alive(spark):
    refs = [(1, "A1", T0, ""), (2, "A2", T0, ""), (3, "A3", T0, ""), (4, "A4", None, "")]
    parents = [("A1", T0, None), ("A2", T0 - timedelta(1), T0), ("A3", T0, T0), ("A4", T0, None)]
    got = opened_on_arrival(*frames(spark, refs, parents))
    assert sorted(r["row_id"] for r in got.collect()) == [2, 3, 4]


def test_turns_are_one_run_over_restarts(spark, tmp_path):
    refs, parents = made(3)
    refs = [r for r in refs if r[2] is not None]
    r, c = frames(spark, refs, parents)
    cuts = [T0 + timedelta(days=d) for d in (0, 11, 29, 80)]
    for a, b in zip(cuts, cuts[1:]):
        state = OrphanState(spark, str(tmp_path / "s"))  # each turn by a new object that knows the folder only
        part = lambda df: df.where((df["t"] >= a) & (df["t"] < b))  # noqa: B023, E731
        state.advance(part(r), part(c))
    assert sorted(x["row_id"] for x in OrphanState(spark, str(tmp_path / "s")).opened().collect()) == brute(refs, parents)
    late = [(i, v, cuts[-1], x) for i, v, _, x in refs]
    assert sorted(x["row_id"] for x in state.waiting().collect()) == brute(late, parents)
    assert sum(x["n_opened"] for x in state.snapshots().collect()) == len(brute(refs, parents))


def test_broken_turn_counts_for_nothing(spark, tmp_path):
    refs, parents = made(5)
    refs = [r for r in refs if r[2] is not None]
    r, c = frames(spark, refs, parents)
    state = OrphanState(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError), state.state.turn():
        state.state.append(live=c.select("target", "key", c["delta"].cast("long").alias("delta")))
        raise RuntimeError
    state.advance(r, c)
    assert sorted(x["row_id"] for x in state.opened().collect()) == brute(refs, parents)
    with pytest.raises(ValueError):
        state.state.append(live=c)


def test_snapshots_and_going_on(spark, tmp_path):
    refs, parents = made(4)
    refs = [r for r in refs if r[2] is not None]
    r, c = frames(spark, refs, parents)
    half = T0 + timedelta(days=29)  # a turn begins here
    run_turns(spark, r.where(r["t"] < half), c.where(c["t"] < half), str(tmp_path / "s"), 7)
    state = run_turns(spark, r, c, str(tmp_path / "s"), 7)
    assert len(state.state.taken()) > 8
    ends = {k: datetime.fromisoformat(note["start"]) + timedelta(days=7, microseconds=-1) for k, note in state.state.taken().items()}
    got = {x["turn"]: x["n_waiting"] for x in state.snapshots().collect()}
    assert got
    for turn, n in got.items():
        assert n == len(brute([(i, v, ends[turn], x) for i, v, t, x in refs if t <= ends[turn]], parents))


def test_empty(spark, tmp_path):
    r, c = frames(spark, [], [])
    assert opened_on_arrival(r, c).count() == 0
    state = run_turns(spark, r, c, str(tmp_path / "s"))
    assert state.opened().count() == 0 and state.snapshots().count() == 0 and state.waiting().count() == 0
