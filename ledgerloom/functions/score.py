"""Amount rules and the confidence of a pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MatchConfig

EXACT_IDS = ["exact", "exact_match", "exact_utr", "exact_rrn", "exact_utr_match"]
ORDER_IDS = ["exact_order_id", "exact_order_id_match", "exact_order_in_bank_description"]
PARTIAL_IDS = ["partial", "order_subledger_date_match"]
MONEY = "decimal(18,2)"


def expected_net(gross: Column, net: Column, fee: Column, tax: Column, refund: Column, adjustment: Column, hint: Column | None = None, cfg: MatchConfig | None = None) -> Column:
    """What should arrive: gross less fee, tax and refund where any is stated, else net, else gross at the channel's rate."""
    zero = F.lit(0).cast(MONEY)
    z = lambda c: F.coalesce(c, zero)
    stated = (z(fee) != 0) | (z(tax) != 0) | (z(refund) != 0) | (z(adjustment) != 0)
    broken_down = F.coalesce(gross, net, zero) - z(fee) - z(tax) - z(refund) + z(adjustment)
    at_rate = gross
    if cfg is not None and hint is not None:
        text = F.lower(F.coalesce(hint, F.lit("")))
        left = lambda rate: gross * F.lit(f"{1 - rate:.6f}").cast("decimal(10,6)")
        at_rate = (
            F.when(text.contains("razorpay"), left(cfg.razorpay_rate * (1 + cfg.razorpay_tax)))
            .when(text.contains("paypal"), left(cfg.paypal_rate))
            .when(text.contains("card"), left(cfg.card_rate))
            .otherwise(gross)
        )
    return F.coalesce(F.when(stated, broken_down), net, at_rate, zero).cast(MONEY)


def effective_tolerance(amount: Column, cfg: MatchConfig) -> Column:
    """min(cap, max(absolute, share of the amount))."""
    share = F.abs(amount) * F.lit(str(cfg.amount_share)).cast("decimal(10,6)")
    return F.least(F.lit(cfg.tolerance_cap).cast(MONEY), F.greatest(F.lit(cfg.amount_tolerance).cast(MONEY), share.cast(MONEY)))


def amounts_agree(a: Column, b: Column, cfg: MatchConfig) -> Column:
    """The guard of exact pairs: a missing or zero amount agrees with any; else within 1.00, or within max(cap, share)."""
    x, y = F.abs(F.coalesce(a, F.lit(0))), F.abs(F.coalesce(b, F.lit(0)))
    limit = F.greatest(F.lit(cfg.tolerance_cap), F.greatest(x, y) * F.lit(cfg.amount_share))
    gap = F.abs(x - y)
    return (x == 0) | (y == 0) | (gap <= cfg.amount_tolerance) | (gap <= limit)


def confidence(id_type: Column, amount_gap: Column, day_gap: Column, narration: Column, same_currency: Column | None = None, same_direction: Column | None = None, cfg: MatchConfig | None = None) -> Column:
    """Weighted score of a pair's evidence in 0..1, to 4 digits."""
    cfg = cfg or MatchConfig()
    kind = F.lower(F.coalesce(id_type, F.lit("none")))
    s_id = F.when(kind.isin(EXACT_IDS), 1.0).when(kind.isin(ORDER_IDS), 0.95).when(kind.isin(PARTIAL_IDS), 0.6).otherwise(0.0)
    amt, days = F.abs(F.coalesce(amount_gap, F.lit(0))).cast("double"), F.abs(F.coalesce(day_gap, F.lit(0))).cast("double")
    s_amt = F.when(amt == 0, 1.0).when(amt <= cfg.amount_tolerance, F.greatest(F.lit(0.5), 1 - amt / (2 * cfg.amount_tolerance))).when(kind.isin(EXACT_IDS + ORDER_IDS[:2]), 0.8).otherwise(0.0)
    s_date = F.when(days == 0, 1.0).when(days <= cfg.date_window, F.greatest(F.lit(0.5), 1 - days / (2 * cfg.date_window))).otherwise(0.0)
    s_narr = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(narration.cast("double"), F.lit(0.0))))
    total = s_id * cfg.weight_identifier + s_amt * cfg.weight_amount + s_date * cfg.weight_date + s_narr * cfg.weight_narration
    total = F.when((s_id >= 0.95) | ((s_amt == 1.0) & (s_date == 1.0)), F.greatest(total, F.lit(0.85))).otherwise(total)
    differs = [~same for same in (same_currency, same_direction) if same is not None]
    for k, other in enumerate(differs):
        total = F.when(other & (~differs[0] if k else F.lit(True)), total * cfg.incompatible_factor).otherwise(total)
    return to_four(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def to_four(x: Column) -> Column:
    """A score to four digits; halves go up, whatever their last binary digit."""
    return F.floor((x + 1e-9) * 10000 + 0.5) / 10000


def digits_swapped(a: Column, b: Column) -> Column:
    """True where two different amounts have the same digits, in cents."""
    digits = lambda c: F.array_sort(F.split((c * 100).cast("long").cast("string"), ""))
    return (digits(a) == digits(b)) & (a != b)
