"""Problem 7: mixing sources to target weights.

Temperature mixing: the sources' shares of all tokens are exponentiated and normalised to weights, the exponent is found
by bisection. With no targets the exponent meets a wanted entropy; with targets the family runs from the natural shares
(exponent 0) to the targets (exponent 1) and the exponent is the largest at which no source is repeated more often than
it may be within the wanted budget. With no wanted budget that budget is the largest at which the targets can be met. The weights are realised as block permutations: every pass over a source is one seeded
permutation of all its documents, the last one is cut at the source's budget.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .bpe import VOCABULARIES, count_tokens

#: Documents of a source that a slice of its permutation holds, about: the running sum of tokens is taken in a slice, over sums of the slices before.
SLICE_ROWS = 50_000


@dataclass(frozen=True)
class SourcePlan:
    mix_name: str
    source: str
    target_share: float
    max_repeats: int
    natural_share: float
    weight: float
    exponent: float
    budget: int  # tokens wanted from the source
    passes: int  # whole permutations of all its documents
    rest: int  # tokens wanted from one more permutation
    available: int


def bisect(f: Callable[[float], float], lo: float, hi: float, rounds: int = 100) -> float:
    """The largest x in [lo, hi] with f(x) <= 0, for rising f; lo if there is none."""
    if f(hi) <= 0:
        return hi
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) <= 0 else (lo, mid)
    return lo


def _normal(logs: list[float]) -> list[float]:
    top = max(logs)
    raw = [math.exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def temperature_weights(tokens: list[int], wanted_entropy: float) -> tuple[float, list[float]]:
    """The exponent in [0, 64] and the weights tokens ** exponent, normalised, whose entropy is ``wanted_entropy``."""
    logs = [math.log(n) for n in tokens]
    at = lambda a: _normal([a * x for x in logs])
    a = bisect(lambda a: wanted_entropy - entropy(at(a)), 0.0, 64.0)
    return a, at(a)


def plan_mix(name: str, targets: list[tuple[str, float, int]], tokens: dict[str, int], wanted_budget: int | None = None) -> list[SourcePlan]:
    """Plan of one mix from its (source, target_share, max_repeats) and the sources' tokens.

    A source without tokens gets nothing and its share goes to the others in proportion. Shares are normalised.
    """
    live = [(s, t, r) for s, t, r in sorted(targets) if tokens.get(s, 0) > 0 and t > 0 and r > 0]
    out = [SourcePlan(name, s, t, r, 0.0, 0.0, 1.0, 0, 0, 0, tokens.get(s, 0)) for s, t, r in sorted(targets) if (s, t, r) not in live]
    if not live:
        return out
    n, cap = [tokens[s] for s, _, _ in live], [tokens[s] * r for s, _, r in live]
    goal, natural = _normal([math.log(t) for _, t, _ in live]), _normal([math.log(x) for x in n])
    weights = lambda a: _normal([a * math.log(g) + (1 - a) * math.log(p) for g, p in zip(goal, natural)])
    reach = lambda w: min(c / x for c, x in zip(cap, w))
    budget = reach(goal) if wanted_budget is None else wanted_budget
    exponent = bisect(lambda a: budget * (1 - 1e-12) - reach(weights(a)), 0.0, 1.0)
    w = weights(exponent)
    budget = min(budget, reach(w))
    for (s, t, r), x, p, have in zip(live, w, natural, n):
        want = min(int(budget * x + 1e-6), have * r)
        out.append(SourcePlan(name, s, t, r, p, x, exponent, want, want // have, want % have, have))
    return out


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", seed: int = 17, wanted_budget: int | None = None, folder: str = VOCABULARIES) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, pass_no, place): the documents of every mix, each as often as it is used.

    ``place`` orders a pass; reading passes in turn, each by place, gives the block permutations. Documents without tokens
    (null, empty), without a source or of a source that no mix names are in no mix. Repeated texts are documents of their
    own. In the last pass documents are taken in the order of the permutation until one exceeds the source's rest; then the
    largest document that still fits is added until none does, so a source misses its budget by less than its smallest unused one.
    That filling goes by the counts of sizes, which are as many as the gap has tokens, less than the longest document's.
    """
    spark = documents.sparkSession
    # One row per mix and source: a list of settings, as long as the recipe.
    rows = targets.select("mix_name", "source", "target_share", "max_repeats").dropna().collect()
    sized = cut(count_tokens(documents.where("source IS NOT NULL"), ["doc_id", "source"], tokenizer, folder).where("n_tokens > 0"))
    wanted = sorted({r["source"] for r in rows})
    # One row per source.
    sums = sized.where(F.col("source").isin(wanted)).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    tokens = {r["source"]: r["n"] for r in sums}
    bits = max(8, math.ceil(math.log2(max([r["rows"] for r in sums], default=1) / SLICE_ROWS)))
    plans = [p for name in sorted({r["mix_name"] for r in rows}) for p in plan_mix(name, [(r["source"], r["target_share"], r["max_repeats"]) for r in rows if r["mix_name"] == name], tokens, wanted_budget)]
    if not plans:
        return spark.createDataFrame([], "mix_name string, source string, doc_id long, n_tokens long, pass_no int, place long")
    plan = spark.createDataFrame([(p.mix_name, p.source, p.passes, p.rest) for p in plans], "mix_name string, source string, passes int, rest long")
    # As many rows as the recipe has; Spark broadcasts it below its own threshold.
    base = sized.join(plan, "source")
    key = F.xxhash64(F.lit(seed), "mix_name", "pass_no", "doc_id")
    whole = base.where("passes > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    whole = whole.withColumn("place", key)

    last = base.where("rest > 0").withColumn("pass_no", F.col("passes") + 1).withColumn("place", key)
    last = last.withColumn("slice", F.shiftright("place", 64 - bits))
    group = ["mix_name", "source"]
    sums = last.groupBy(*group, "slice").agg(F.sum("n_tokens").alias("n"))
    before = sums.select(*group, "slice", F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("n_tokens").over(W.partitionBy(*group, "slice").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    last = cut(last.withColumn("upto", upto).join(before, [*group, "slice"]).withColumn("upto", F.col("upto") + F.col("before")).withColumn("taken", F.col("upto") <= F.col("rest")))
    # Then the largest document that still fits, again and again: from the gap of every mix and source and the counts of the sizes that fit it.
    filled = last.groupBy(*group).agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("taken"), F.col("n_tokens"))), F.lit(0))).alias("gap"))
    spare = last.where(~F.col("taken"))
    sizes = spare.join(filled, group).where("n_tokens <= gap").groupBy(*group, "gap", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    picks, gaps = [], {}
    for r in sorted(sizes, key=lambda r: -r["n_tokens"]):
        of = (r["mix_name"], r["source"])
        gap = gaps.get(of, r["gap"])
        k = min(r["n"], gap // r["n_tokens"])
        gaps[of] = gap - k * r["n_tokens"]
        if k:
            picks.append((*of, r["n_tokens"], k))
    picked = spare.join(spark.createDataFrame(picks, "mix_name string, source string, n_tokens long, k long"), [*group, "n_tokens"])
    # The first of a size in the order of the permutation: first in every slice, then of those.
    for parts in ([*group, "n_tokens", "slice"], [*group, "n_tokens"]):
        picked = picked.withColumn("nth", F.row_number().over(W.partitionBy(*parts).orderBy("place", "doc_id"))).where("nth <= k").drop("nth")
    part = last.where("taken").select(*base.columns, "pass_no", "place").unionByName(picked.select(*base.columns, "pass_no", "place"))
    columns = ["mix_name", "source", "doc_id", "n_tokens", "pass_no", "place"]
    return whole.select(*columns).unionByName(part.select(*columns))


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, n_used, n_tokens, actual_share, most_repeats): the shares really reached.

    Every source of a mix is listed, with zeros where it gave nothing.
    """
    # A document's uses meet in one group, which is as large as the limit on repeats; sources are summed from these.
    each = mixed.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("n"))
    used = each.groupBy("mix_name", "source").agg(F.sum("uses").alias("n_used"), F.sum("n").alias("n_tokens"), F.max("uses").alias("most_repeats"))
    rows = targets.select("mix_name", "source", "target_share").join(used, ["mix_name", "source"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_used", "n_tokens", "most_repeats")})
    total = F.sum("n_tokens").over(W.partitionBy("mix_name"))
    return rows.select("mix_name", "source", "target_share", "n_used", "n_tokens", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0).alias("actual_share"), "most_repeats")


def temperature_report(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(mix_name, source, target_share, natural_share, exponent, weight): plain temperature mixing of every mix's sources.

    The exponent is the one at which the weights are as even as the mix's targets (equal entropy). Sources without tokens are left out.
    """
    spark = documents.sparkSession
    rows = targets.select("mix_name", "source", "target_share").dropna().collect()
    sized = count_tokens(documents.where(F.col("source").isin(sorted({r["source"] for r in rows}))), ["source"], tokenizer, folder)
    tokens = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).where("n > 0").collect()}
    out = []
    for name in sorted({r["mix_name"] for r in rows}):
        live = sorted((r["source"], r["target_share"]) for r in rows if r["mix_name"] == name and r["source"] in tokens and r["target_share"] > 0)
        if live:
            n = [tokens[s] for s, _ in live]
            exponent, weights = temperature_weights(n, entropy(_normal([math.log(t) for _, t in live])))
            goal = _normal([math.log(t) for _, t in live])
            out += [(name, s, g, x / sum(n), exponent, w) for (s, _), g, x, w in zip(live, goal, n, weights)]
    return spark.createDataFrame(out, "mix_name string, source string, target_share double, natural_share double, exponent double, weight double")
