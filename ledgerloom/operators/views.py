"""What a viewer of a run sees: labels, tags, filters, enriched and repaired rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, taxonomy

_NO_RULE = ["", "none", "n/a"]


def decision_label(tax: Column, status: Column, stage: Column, decision: Column, rule: Column, reason: Column, score: Column) -> Column:
    """Which stage or rule made a row's decision, in words; the first that applies."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    st, sg, d, r, why, x = low(status), low(stage), low(decision), F.trim(F.coalesce(rule, F.lit(""))), F.trim(F.coalesce(reason, F.lit(""))), F.upper(F.trim(F.coalesce(tax, F.lit(""))))
    return (
        F.when(~F.lower(r).isin(_NO_RULE), F.concat(F.lit("Rule: "), F.substring(r, 1, 24)))
        .when((sg == "exact") | st.isin("auto", "exact") | d.isin("auto", "exact"), "Rule Engine: Exact UTR Match")
        .when((sg == "tolerance") | (st == "tolerance") | (d == "tolerance"), "Rule Engine: Tolerance Match")
        .when((sg == "split") | (st == "split"), "Rule Engine: Split Settlement")
        .when((sg == "ml") | (st == "ml"), F.concat(F.lit("ML Model"), F.when(score > 0, F.format_string(" (%.2f)", score)).otherwise("")))
        .when((sg == "llm") | (st == "llm"), "Groq LLM Agent")
        .when((sg == "manual") | st.isin("manual", "manual_review"), "Manual Review Override")
        .when(x == "SETTLED", "Automated Settlement")
        .when(x == "MATCHED", "Rule Engine: Parity Match")
        .when(x == "SIMILAR", "Similarity Engine Review")
        .when(~F.lower(why).isin([*_NO_RULE, "unmatched exception"]), F.substring(why, 1, 26))
        .otherwise("Unmatched Exception")
    )


#: Tags by rank, the order in which they are offered.
TAG_ORDER = [
    "all", "settled", "auto", "similar", "exception", "unreconciled", "intl_txn", "internal_transfer", "manual_override", "exact_utr", "unmatched_utr", "batch_mdr", "groq_llm", "digit_transposition", "duplicate_discrepancy", "llm", "ml",
    "utr_mismatch", "utr_match", "date_gap", "amt_diff", "split_txn",
]
_FLAG_TAGS = {
    "Internal Transfer": "internal_transfer", "Manual Override": "manual_override", "Exact UTR Match": "exact_utr", "Unmatched UTR": "unmatched_utr", "Batch MDR Payout": "batch_mdr", "Groq LLM Assisted": "groq_llm",
    "Digit Transposition": "digit_transposition", "Duplicate Discrepancy": "duplicate_discrepancy",
}


def ui_tags(status: Column, id_matched: Column, day_gap: Column, amount_gap: Column, split: Column, currency: Column, flags: Column) -> Column:
    """All tags of a transaction, ``all`` first."""
    st = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    hit = F.coalesce(id_matched, F.lit(False))
    has = lambda f: F.coalesce(F.array_contains(flags, f), F.lit(False))
    kind = (
        F.when(st == "settled", "settled").when(st.isin("auto", "matched", "exact", "tolerance"), "auto").when(st.isin("similar", "proposed"), "similar").when(st.isin("unreconciled", "unmatched", "rejected"), "unreconciled")
        .when(st.isin("exception", "manual", "review"), "exception").when(st.isin("llm", "ml"), st)
    )
    tags = [
        F.lit("all"), kind, F.when(hit, "utr_match").when(st.isin("llm", "ml", "manual", "unmatched", "exception", "unreconciled"), "utr_mismatch"), F.when(day_gap > 0, "date_gap"), F.when(F.abs(amount_gap) > 0.01, "amt_diff"),
        F.when(F.coalesce(split, F.lit(False)), "split_txn"), F.when(has("International Txn") | F.coalesce(currency.isin("USD", "EUR", "GBP"), F.lit(False)), "intl_txn"), *[F.when(has(f), t) for f, t in _FLAG_TAGS.items()],
    ]
    return F.array_compact(F.array(*tags))


def offered_tags(tagged: DataFrame, top: int | None = 8) -> DataFrame:
    """(tag, n) over rows with ``tags``, by rank; ``all`` always, others if any row has them, the first ``top``."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in TAG_ORDER]), c)
    n = tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    all_ = tagged.sparkSession.createDataFrame([("all", 0)], "tag string, n long")
    n = n.unionByName(all_).groupBy("tag").agg(F.max("n").alias("n"))
    return n if top is None else n.orderBy(rank(F.col("tag"))).limit(top)


def filter_view(tagged: DataFrame, sign: str = "all", tag: str = "all", query: str = "", columns: list[str] | None = None) -> DataFrame:
    """Rows by sign (payments, deposits, all), tag, and a text that one of the columns holds, letter case aside."""
    out = tagged
    if sign in ("payments", "deposits"):
        out = out.where(F.col("amount") < 0 if sign == "payments" else F.col("amount") > 0)
    if tag != "all":
        out = out.where(F.array_contains("tags", tag))
    if query:
        hit = F.lit(False)
        for c in columns or ["txn_date", "description", "amount", "status"]:
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False))
        out = out.where(hit)
    return out


def enrich_first_hit(rows: DataFrame, known: DataFrame, key: str, ids: list[str], fallback: Column, period_settled: bool = False) -> DataFrame:
    """``rows`` (with the unique ``key``) and ``taxonomy``: of the first of ``ids`` that ``known`` (id, taxonomy) has, else from the raw status in ``fallback``.

    Ids are unfolded with their rank and joined by equality; the best rank per row wins by a minimum.
    """
    norm = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    each = rows.select(F.col(key).alias("__key"), F.posexplode(F.array(*[norm(F.col(c)) for c in ids])).alias("__rank", "__id")).where("__id IS NOT NULL")
    table = known.groupBy(norm(F.col("id")).alias("__kid")).agg(F.min("taxonomy").alias("__tax"))
    best = each.join(table, F.col("__id") == F.col("__kid")).groupBy("__key").agg(F.min(F.struct("__rank", "__tax")).alias("__b"))
    st = F.lower(F.trim(F.coalesce(fallback, F.lit(""))))
    raw = F.when(st.isin("settled", "paid", "credit", "success"), "SETTLED" if period_settled else "MATCHED").otherwise(taxonomy.taxonomy(st))
    return rows.join(best, F.col(key) == F.col("__key"), "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__b.__tax", raw).alias("taxonomy"))


def repaired(rows: DataFrame, prefix: str = "BNK", id_column: str = "transaction_id", row_number: str = "source_row_number", amount: str = "amount", credit: str = "credit", debit: str = "debit") -> DataFrame:
    """Rows with synthetic ids of old imports (TX_..., names of files) replaced, and ``amount`` parsed, else credit less debit, else 0."""
    t = F.upper(F.trim(F.coalesce(id_column, F.lit(""))))
    fresh = F.concat(F.lit(f"{prefix}-TXN-"), F.format_string("%04d", F.coalesce(F.col(row_number).cast("int"), F.lit(1))))
    cr, dr = clean.parse_numeric(F.col(credit)), clean.parse_numeric(F.col(debit))
    zero = F.lit(0).cast("decimal(18,2)")
    net = F.when(cr.isNotNull() | dr.isNotNull(), F.coalesce(cr, zero) - F.coalesce(dr, zero))
    value = F.coalesce(clean.parse_numeric(F.col(amount)), net, zero).cast("decimal(18,2)")
    return rows.withColumn(id_column, F.when(t.startswith("TX_") | t.contains(".XLSX_") | t.contains(".CSV_"), fresh).otherwise(F.col(id_column))).withColumn(amount, value)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of every key by an order, ties by the whole row; one minimum per key, so copies don't meet in a task. Null keys are keys."""
    pick = F.max if last else F.min
    packed = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"))
    return rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(pick(packed).alias("__p")).select("__p.__row.*")


def first_value(*columns: Column) -> Column:
    """The first amount that is neither null nor zero; 0 if there is none."""
    return F.coalesce(*[F.nullif(c.cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")) for c in columns], F.lit(0).cast("decimal(18,2)"))
