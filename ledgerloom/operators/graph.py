"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


#: Rounds of plain propagation before labels are also followed one jump per round.
PLAIN_ROUNDS = 5


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): for every vertex of ``edges`` the smallest id that it is connected with.

    Labels go to neighbours as minima, combined before the shuffle. Small components are done in a few rounds; if any is
    not, labels are also followed one jump a round, so the rounds grow with the logarithm of a component's diameter. Each
    round is checkpointed in the shared folder; only one count per round reaches the driver. Null ends and loops are
    dropped, repeated edges count once; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    # Every vertex is also its own neighbour, which hands its label on.
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("e"))
    both = cut(both.select("e.a", "e.b").distinct())
    labels, rounds = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")), 0
    while True:
        step = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        if rounds >= PLAIN_ROUNDS:
            heads = labels.select(F.col("id").alias("label"), F.col("label").alias("head"))
            step = step.join(heads, "label").select("a", F.least("label", "head").alias("label"), "old")
        step = cut(step)
        labels, rounds = step.select(F.col("a").alias("id"), "label"), rounds + 1
        if step.where("old <> label").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
