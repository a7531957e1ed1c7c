"""Statuses, flags and labels of transactions and exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAXONOMY = ["SETTLED", "MATCHED", "SIMILAR", "UNMATCHED"]
OPEN_STATUSES = ["exception", "unmatched", "unreconciled", "manual", "similar", "review"]
RESOLVED_STATUSES = ["settled", "matched", "auto", "similar", "llm"]
NO_REFERENCE = ["—", "-", "nan", "none", "null", ""]

# Words that show a payment abroad and an internal transfer.
ABROAD_WORDS = ["USD", "EUR", "GBP", "JPY", "AUD", "CAD", "FX", "SWIFT", "FOREX", "PAYPAL", "INTERNATIONAL", "OVERSEAS", "CROSS BORDER", "CONVERSION"]
TRANSFER_WORDS = ["INTERNAL TRANSFER", "SELF TRANSFER", "BANK TRANSFER", "INTER ACCOUNT", "ACCOUNT TRANSFER", "UPI TRANSFER", "SWEEP", "CONTRA"]

#: Flags by rank: the first that a transaction has is its type.
FLAG_ORDER = [
    "Manual Override", "International Txn", "Internal Transfer", "Batch MDR Payout", "Groq LLM Assisted", "Exact UTR Match", "Order ID Match", "Exact Match", "Digit Transposition", "Duplicate Discrepancy",
    "Unmatched UTR", "Standard Commercial",
]


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _has(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def taxonomy(status: Column, period_settled: Column | bool = False) -> Column:
    """One of the four statuses of a raw status."""
    st, settled = _low(status), F.lit(period_settled) if isinstance(period_settled, bool) else period_settled
    return (
        F.when((st == "settled") | (settled & st.isin("auto", "matched")), "SETTLED").when(st.isin("auto", "matched"), "MATCHED").when(st.isin("manual", "llm", "similar", "review"), "SIMILAR").otherwise("UNMATCHED")
    )


def cascade_stage(status: Column, rule: Column, score: Column) -> Column:
    """The pass of the cascade that a row's rule text names: 1 to 4, or 0 for an open row."""
    st, r = _low(status), _low(rule)
    stage = (
        F.when(_has(r, ["llm", "groq"]) | (st == "llm"), 4)
        .when(_has(r, ["split", "aggregate", "n:1"]), 3)
        .when(_has(r, ["tolerance", "fee", "mdr", "lag"]), 2)
        .when(_has(r, ["exact", "utr", "clean"]) | (F.coalesce(score, F.lit(0.0)) >= 0.9), 1)
        .otherwise(2)
    )
    return F.when(st.isin(RESOLVED_STATUSES), stage).otherwise(0)


def mismatch_reasons(rule: Column, duplicate: Column) -> Column:
    """All reasons that an open row's rule text names; Other if none."""
    r = _low(rule)
    found = F.array_compact(
        F.array(
            F.when(r.contains("duplicate") | F.coalesce(duplicate, F.lit(False)), "Duplicate Transaction"),
            F.when(_has(r, ["amount", "tolerance", "fee"]), "Amount Mismatch"),
            F.when(_has(r, ["date", "time", "lag"]), "Date/Time Mismatch"),
            F.when(_has(r, ["reference", "utr", "narration"]), "Reference/UTR Mismatch"),
            F.when(_has(r, ["currency", "fx"]), "Source Mismatch"),
            F.when(_has(r, ["no candidate", "no match", "overlap"]), "Missing Transaction"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("Other"))).otherwise(found)


def amount_tier(amount: Column) -> Column:
    a = F.abs(amount)
    return F.when(a < 1000, 0).when(a < 10000, 1).when(a < 100000, 2).otherwise(3)


def age_tier(days: Column) -> Column:
    return F.when(days <= 2, 0).when(days <= 7, 1).when(days <= 14, 2).otherwise(3)


# The buckets of amount gaps.
VARIANCE = ["₹0 (Exact)", "₹0–₹10", "₹10–₹100", "₹100–₹1,000", "₹1,000+"]


def variance_bucket(gap: Column) -> Column:
    g = F.abs(gap)
    return F.when(g == 0, VARIANCE[0]).when(g <= 10, VARIANCE[1]).when(g <= 100, VARIANCE[2]).when(g <= 1000, VARIANCE[3]).otherwise(VARIANCE[4])


def feature_flags(currency: Column, description: Column, status: Column, rule: Column, utr: Column, other_utr: Column, order: Column, other_order: Column, both_primary: Column, duplicate: Column) -> Column:
    """Every flag that a transaction earns, in the order they are tested; Standard Commercial if none."""
    cur = F.upper(F.trim(F.coalesce(currency, F.lit("INR"))))
    desc, r, st = F.upper(F.coalesce(description, F.lit(""))), _low(rule), _low(status)
    u, v = F.trim(F.coalesce(utr, F.lit(""))), F.trim(F.coalesce(other_utr, F.lit("")))
    good_u, good_v = ~F.lower(u).isin(NO_REFERENCE), ~F.lower(v).isin(NO_REFERENCE)
    done = st.isin("settled", "matched")
    by_utr = (good_u & good_v & (F.upper(u) == F.upper(v))) | (r.contains("utr") & good_u)
    o, p = F.trim(F.coalesce(order, F.lit(""))), F.trim(F.coalesce(other_order, F.lit("")))
    by_order = r.contains("order") | ((o == p) & ~o.isin("", "nan"))
    exact = r.contains("exact") | r.contains("pass 1")
    counted = done & ~r.contains("manual")
    found = F.array_compact(
        F.array(
            F.when(~cur.isin("INR", "RS", "RUPEES", "") | _has(desc, ABROAD_WORDS), "International Txn"),
            F.when(_has(desc, TRANSFER_WORDS) | F.coalesce(both_primary, F.lit(False)), "Internal Transfer"),
            F.when(_has(r, ["manual", "override"]) | st.isin("manual", "manually_edited", "manual_override"), "Manual Override"),
            F.when(counted & by_utr, "Exact UTR Match").when(counted & by_order, "Order ID Match").when(counted & exact, "Exact Match"),
            F.when(~done & (~good_u | st.isin("unreconciled", "exception", "unmatched")), "Unmatched UTR"),
            F.when(_has(r, ["mdr", "batch", "1-to-n", "fee", "solver"]), "Batch MDR Payout"),
            F.when(_has(r, ["llm", "groq", "llama"]) | (st == "llm"), "Groq LLM Assisted"),
            F.when(_has(r, ["transposition", "digit", "tolerance"]), "Digit Transposition"),
            F.when(F.coalesce(duplicate, F.lit(False)), "Duplicate Discrepancy"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("Standard Commercial"))).otherwise(found)


def primary_type(flags: Column) -> Column:
    return F.get(F.filter(F.array(*[F.lit(x) for x in FLAG_ORDER]), lambda x: F.array_contains(flags, x)), F.lit(0))


def exception_type(stage: Column, decision: Column, reason: Column, given: Column | None = None) -> Column:
    """The kind of an exception by its own type, reason, decision and stage, in this order."""
    r, g = _low(reason), F.coalesce(given, F.lit("")) if given is not None else F.lit("")
    review = (
        F.when(stage == "llm", "llm_review").when(r.contains("no llm result"), "llm_unavailable").when(stage.isin("reconciler", "tolerance_matcher"), "unresolved").otherwise("manual_review")
    )
    return (
        F.when((g == "open_refund") | _has(r, ["refund", "chargeback"]), "open_refund")
        .when((g == "ambiguous_tie") | _has(r, ["ambiguous tie", "ambiguous_tie"]), "ambiguous_tie")
        .when((g == "insufficient_data") | (decision == "insufficient_data") | _has(r, ["insufficient data", "insufficient_data"]), "insufficient_data")
        .when((g == "failed_status_excluded") | _has(r, ["status excluded", "status_excluded"]), "failed_status_excluded")
        .when((g == "duplicate_detected") | r.contains("duplicate"), "duplicate_detected")
        .when(decision == "review", review)
        .when(decision == "non_match", "non_match")
        .otherwise("unknown")
    )


def exception_priority(kind: Column, score: Column) -> Column:
    s = F.coalesce(score.cast("double"), F.lit(0.0))
    urgent = kind.isin("llm_unavailable", "unresolved", "ambiguous_tie", "insufficient_data", "duplicate_detected")
    return F.when(urgent | (s < 0.70), "high").when(s < 0.85, "medium").otherwise("low")


def feedback_label(outcome: Column) -> Column:
    """1 for a confirmed match, 0 for a rejected one, 1 where nothing is said."""
    o = _low(outcome)
    return F.when(o.isin("confirmed_non_match", "rejected", "non_match", "false_positive"), 0).otherwise(1)


def sniff_currency(text: Column) -> Column:
    t = F.upper(F.coalesce(text, F.lit("")))
    return (
        F.when(_has(t, ["$", "USD", "GLOBALPAY", "STRIPE", "PAYPAL"]), "USD").when(_has(t, ["€", "EUR"]), "EUR").when(_has(t, ["£", "GBP"]), "GBP").when(t.contains("CAD"), "CAD").when(t.contains("AUD"), "AUD").otherwise("INR")
    )


def snap_cadence(gap: Column) -> Column:
    """The usual cadence nearest in order of 1, 7, 14, 30, 90 days; the gap itself if none is near, null beyond 2..120."""
    out = F.when(gap.between(2, 120), gap)
    for target in (90, 30, 14, 7, 1):
        out = F.when(F.abs(gap - target) <= max(2, target * 0.25), target).otherwise(out)
    return F.when(gap > 0, out)
