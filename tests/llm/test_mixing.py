import collections
import math

from ledgerloom.llm.bpe import encoder
from ledgerloom.llm.mixing import bisect, entropy, mix, mix_shares, plan_mix, temperature_report, temperature_weights


def test_temperature_meets_entropy():
    tokens = [1000, 100, 10]
    a, w = temperature_weights(tokens, 0.9)
    assert abs(entropy(w) - 0.9) < 1e-6 and abs(w[0] / w[1] - 10**a) < 1e-6
    assert temperature_weights(tokens, math.log(3))[0] < 1e-3
    assert bisect(lambda x: x - 0.25, 0, 1) - 0.25 < 1e-9


def test_plan_is_the_largest_budget_at_the_targets():
    plans = {p.source: p for p in plan_mix("m", [("a", 0.5, 1), ("b", 0.5, 3), ("gone", 0.2, 2)], {"a": 900, "b": 200})}
    assert plans["gone"].budget == 0
    assert (plans["a"].budget, plans["b"].budget) == (600, 600) and (plans["b"].passes, plans["b"].rest) == (3, 0)


def test_wanted_budget_bends_towards_natural_shares():
    plans = {p.source: p for p in plan_mix("m", [("a", 0.5, 1), ("b", 0.5, 1)], {"a": 900, "b": 100}, wanted_budget=600)}
    assert 0 < plans["a"].exponent < 1 and abs(sum(p.budget for p in plans.values()) - 600) <= 2 and plans["b"].budget <= 100
    plans = plan_mix("m", [("a", 0.5, 1), ("b", 0.5, 1)], {"a": 900, "b": 100}, wanted_budget=100)
    assert [p.budget for p in plans] == [50, 50]


def documents(spark, n=120):
    texts = [(i, "pay " * (1 + i % 9), "abc"[i % 3] if i % 10 else "b") for i in range(n)] + [(1000, None, "a"), (1001, "", "a"), (1002, "lost", None), (1003, "pay pay", "unused")]
    return spark.createDataFrame([(*t, 5) for t in texts], "doc_id long, text string, source string, n_tokens int")


def test_mix(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("m", "a", 0.6, 1), ("m", "b", 0.3, 2), ("m", "none", 0.1, 1), ("n", "c", 1.0, 3)], "mix_name string, source string, target_share double, max_repeats int")
    rows = mix(docs, targets).collect()
    again = mix(docs, targets).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    uses = collections.Counter((r["mix_name"], r["doc_id"]) for r in rows)
    limit = {"a": 1, "b": 2, "c": 3}
    assert all(uses[r["mix_name"], r["doc_id"]] <= limit[r["source"]] for r in rows)
    assert len({(r["mix_name"], r["pass_no"], r["doc_id"]) for r in rows}) == len(rows)
    e = encoder("byte_bpe_50k")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == e.count(texts[r["doc_id"]]) > 0 for r in rows)
    shares = {(r["mix_name"], r["source"]): r for r in mix_shares(mix(docs, targets), targets).collect()}
    assert abs(shares["m", "a"]["actual_share"] - 2 / 3) < 0.01 and shares["m", "none"]["n_used"] == 0
    assert shares["n", "c"]["most_repeats"] == 3 and shares["n", "c"]["actual_share"] == 1.0


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    assert mix(documents(spark).limit(0), targets).count() == 0
    assert mix(documents(spark), targets.limit(0)).count() == 0
    assert mix_shares(mix(documents(spark).limit(0), targets), targets).collect()[0]["actual_share"] == 0.0
    assert temperature_report(documents(spark).limit(0), targets).count() == 0
