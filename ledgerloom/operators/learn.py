"""Pair features, labelled examples and the confidence model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clean, dates, score, text

FEATURES = [
    "settlement_amount", "bank_amount", "amount_difference", "amount_difference_pct", "relative_amount_difference", "date_difference_days", "utr_match", "utr_missing", "utr_similarity", "rrn_exact", "rrn_similarity",
    "order_id_exact", "settlement_id_exact", "gateway_ref_exact", "auth_code_exact", "customer_name_similarity", "vpa_similarity", "narration_similarity", "currency_match", "same_direction", "status_compatible",
    "candidate_count", "split_candidate", "fee_adjusted_difference", "expected_settlement_date_gap", "duplicate_risk", "is_digit_transposition",
]
_TEXTUAL = ["utr_similarity", "rrn_similarity", "customer_name_similarity", "vpa_similarity", "narration_similarity"]


def pair_features(pairs: DataFrame, textual: bool = True, beside: tuple[Column, ...] = ()) -> DataFrame:
    """settlement_id, bank_transaction_id and the features of pairs of rows ``s_...`` (settlement) and ``b_...`` (bank).

    Columns: id, amount, txn_date, utr, rrn, order_id, settlement_id, gateway_reference, auth_code, customer_name, vpa, description,
    currency, direction, status, gross_amount, fee_amount, tax_amount; missing ones count as null. With ``textual`` False the five likenesses that
    need Python are left out, and everything stays in the JVM. ``beside``: further columns of the pairs to carry along.
    """
    have = set(pairs.columns)
    c = lambda name, kind="string": (F.col(name) if name in have else F.lit(None)).cast(kind)
    norm = lambda name: clean.feature_text(c(name))
    eq = lambda n: ((norm("s_" + n) != "") & (norm("s_" + n) == norm("b_" + n))).cast("int")
    within = lambda n: ((norm("s_" + n) != "") & F.coalesce(clean.feature_text(F.coalesce(c("b_" + n), c("b_description"))), F.lit("")).contains(norm("s_" + n))).cast("int")
    a, b = F.coalesce(c("s_amount", "decimal(18,2)"), F.lit(0)), F.coalesce(c("b_amount", "decimal(18,2)"), F.lit(0))
    gap = F.abs(a - b)
    share = F.round(gap.cast("double") / F.greatest(F.abs(a).cast("double"), F.abs(b).cast("double"), F.lit(1.0)), 6)
    days = dates.day_gap(c("s_txn_date", "date"), c("b_txn_date", "date"), 999)
    cur = lambda n: F.upper(F.coalesce(c(n), F.lit("INR")))
    way = lambda n: F.upper(F.coalesce(c(n), F.lit("CREDIT")))
    out = lambda n: F.coalesce(clean.registry(c(n), clean.STATUS).isin(clean.EXCLUDED_STATUSES), F.lit(False))
    m = lambda n: c("s_" + n, "decimal(18,2)")
    net = score.expected_net(m("gross_amount"), m("amount"), m("fee_amount"), m("tax_amount"), m("refund_amount"), m("adjustment_amount"))
    f = {
        "settlement_amount": a.cast("double"), "bank_amount": b.cast("double"), "amount_difference": gap.cast("double"), "amount_difference_pct": share, "relative_amount_difference": share, "date_difference_days": days,
        "utr_match": eq("utr"), "utr_missing": ((norm("s_utr") == "") | (norm("b_utr") == "")).cast("int"), "rrn_exact": eq("rrn"), "order_id_exact": within("order_id"), "settlement_id_exact": within("settlement_id"),
        "gateway_ref_exact": within("gateway_reference"), "auth_code_exact": eq("auth_code"), "currency_match": (cur("s_currency") == cur("b_currency")).cast("int"), "same_direction": (way("s_direction") == way("b_direction")).cast("int"),
        "status_compatible": (~out("s_status") & ~out("b_status") & ((cur("s_currency") == cur("b_currency")) | c("s_currency").isNull() | c("b_currency").isNull())).cast("int"), "candidate_count": F.coalesce(c("s_candidate_count", "int"), F.lit(1)),
        "split_candidate": (F.coalesce(c("s_is_split", "boolean"), F.lit(False)) | F.coalesce(c("b_is_split", "boolean"), F.lit(False))).cast("int"), "fee_adjusted_difference": F.abs(net - b).cast("double"), "expected_settlement_date_gap": days,
        "duplicate_risk": (F.coalesce(c("s_duplicate_risk", "boolean"), F.lit(False)) | F.coalesce(c("b_duplicate_risk", "boolean"), F.lit(False))).cast("int"), "is_digit_transposition": score.digits_swapped(a, b).cast("int"),
    }
    if textual:
        like = text.narration_similarity
        f |= {
            "utr_similarity": like(norm("s_utr"), norm("b_utr")), "rrn_similarity": like(norm("s_rrn"), norm("b_rrn")), "customer_name_similarity": like(c("s_customer_name"), F.coalesce(c("b_customer_name"), c("b_description"))),
            "vpa_similarity": like(c("s_vpa"), c("b_vpa")), "narration_similarity": like(F.coalesce(c("s_description"), c("s_utr")), F.coalesce(c("b_description"), c("b_utr"))),
        }
    label = [F.col("label")] if "label" in have else []
    return pairs.select(c("s_id").alias("settlement_id"), c("b_id").alias("bank_transaction_id"), *[f[n].alias(n) for n in FEATURES if n in f], *label, *beside)


def check_features(df: DataFrame) -> None:
    """Fail where a feature is missing or unknown."""
    have = set(df.columns) - {"settlement_id", "bank_transaction_id", "label"}
    if have != set(FEATURES):
        raise ValueError(f"features differ: missing {sorted(set(FEATURES) - have)}, unknown {sorted(have - set(FEATURES))}")


def weak_label(pairs: DataFrame) -> DataFrame:
    """Pairs with ``label``: 1 for an equal reference or order, amounts within 15 % and dates within a week, or narrations alike by 0.60.

    The narration is the description, else the customer's name (settlements only), else the reference; the likeness is computed
    only for pairs that the other rules leave at 0.
    """
    have = set(pairs.columns)
    c = lambda n: F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) if n in have else F.lit(None).cast("string")
    ref = lambda n: F.nullif(clean.feature_text(c(n)), F.lit(""))
    left, right = F.coalesce(c("s_description"), c("s_customer_name"), ref("s_utr")), F.coalesce(c("b_description"), ref("b_utr"))
    f = pair_features(pairs, textual=False, beside=(left.alias("__left"), right.alias("__right")))
    hit = (F.col("utr_match") == 1) | (F.col("order_id_exact") == 1) | ((F.col("amount_difference_pct") <= 0.15) & (F.col("date_difference_days") <= 7))
    # The sequence ratio of an empty text costs nothing.
    like = text.narration_similarity(F.when(hit, F.lit("")).otherwise(F.col("__left")), F.when(hit, F.lit("")).otherwise(F.col("__right")))
    return f.withColumn("label", (hit | (like >= 0.60)).cast("int")).drop("__left", "__right")


def label_by_truth(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs (p_id, c_id) with ``label`` 1 where the truth (a, b) has them."""
    t = truth.select(F.col("a").alias("__a"), F.col("b").alias("__b")).distinct().withColumn("__t", F.lit(1))
    return pairs.join(t, (F.col("p_id") == F.col("__a")) & (F.col("c_id") == F.col("__b")), "left").withColumn("label", F.coalesce("__t", F.lit(0))).drop("__a", "__b", "__t")


def sample_negatives(negatives: DataFrame, per: int = 4, seed: int = 42) -> DataFrame:
    """At most ``per`` negatives (p_id, c_id) of each left row, the same on every run: those of the smallest seeded hash."""
    h = F.xxhash64(F.lit(seed), "p_id", "c_id")
    return negatives.withColumn("__n", F.row_number().over(W.partitionBy("p_id").orderBy(h, "c_id"))).where(F.col("__n") <= per).drop("__n")


def split_rows(examples: DataFrame, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test examples: of each label the same share, by the order of a seeded hash of the pair.

    A label is cut into slices of the hash, the rows of the slices before are counted, and only inside a slice rows are put in
    order, so no task holds a label. Of a label's n rows floor(n * test_share) are test rows.
    """
    h = F.xxhash64(F.lit(seed), "settlement_id", "bank_transaction_id")
    rows = examples.withColumn("__h", h).withColumn("__slice", F.shiftright("__h", 52))
    sizes = rows.groupBy(F.col("label").alias("__label"), F.col("__slice").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    mine = W.partitionBy("__label")
    sizes = sizes.select("__label", "__s", F.sum("__n").over(mine).alias("__all"), (F.sum("__n").over(mine.orderBy("__s")) - F.col("__n")).alias("__before"))
    rows = rows.join(sizes, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__slice") == F.col("__s")))
    place = F.row_number().over(W.partitionBy("label", "__slice").orderBy("__h", "settlement_id", "bank_transaction_id")) + F.col("__before")
    rows = rows.withColumn("__test", place <= F.floor(F.col("__all") * test_share + 1e-9))
    return tuple(rows.where(F.col("__test") == test).drop("__h", "__slice", "__label", "__s", "__all", "__before", "__test") for test in (False, True))


def train(examples: DataFrame, trees: int = 100, depth: int = 8, seed: int = 42):
    """Random forest over scaled features, examples weighed so that both labels count alike. Returns the pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    clean_ = clean_features(examples)
    share = clean_.agg(F.avg("label").alias("p")).first()["p"] or 0.5
    weighed = clean_.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6)))
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        RandomForestClassifier(featuresCol="scaled", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(weighed)


def clean_features(df: DataFrame) -> DataFrame:
    """Features as doubles, infinite and missing values 0."""
    one = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), 0.0).otherwise(c)
    return df.withColumns({n: one(F.col(n).cast("double")) for n in FEATURES})


def predict(model, examples: DataFrame) -> DataFrame:
    """settlement_id, bank_transaction_id, score, label if known."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(clean_features(examples)).withColumn("score", vector_to_array("probability")[1])
    return out.select("settlement_id", "bank_transaction_id", "score", *(["label"] if "label" in examples.columns else []))
