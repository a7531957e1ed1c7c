"""Settings of the matching engine."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass

# Prefixes that a reference is stripped of, in this order, again and again.
REFERENCE_PREFIXES = (
    "NEFTCR-", "NEFTCR", "NEFT-", "NEFT", "RTGSCR-", "RTGSCR", "RTGS-", "RTGS", "IMPSCR-", "IMPSCR", "IMPS-", "IMPS",
    "UPI-", "UPI", "UTR-", "UTR", "GPAY-", "GPAY", "PAYTM-", "RAZORPAY-", "SETTLEMENT-", "INB-", "REF:", "REF-", "REF",
)


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds and weights; money in the statements' unit, shares as fractions, gaps in days."""

    date_window: int = 4
    amount_tolerance: float = 1.00
    amount_share: float = 0.035
    tolerance_cap: float = 100.0
    narration_floor: float = 0.50
    similarity_floor: float = 0.40
    confidence_floor: float = 0.60
    weight_identifier: float = 0.40
    weight_amount: float = 0.30
    weight_date: float = 0.15
    weight_narration: float = 0.15
    incompatible_factor: float = 0.50
    split_confidence: float = 0.95
    aggregate_confidence: float = 0.95
    cluster_confidence: float = 0.90
    tie_confidence: float = 0.50
    min_reference: int = 5
    gap_unknown: int = 999
    business_days: bool = False
    card_rate: float = 0.019
    razorpay_rate: float = 0.018
    razorpay_tax: float = 0.18
    paypal_rate: float = 0.034
    prefixes: tuple[str, ...] = REFERENCE_PREFIXES

    @classmethod
    def load(cls, path: str | None = None, env: str = "LEDGER_") -> MatchConfig:
        """Defaults, then the JSON file's values, then environment variables ``LEDGER_<NAME>``; unknown names are ignored."""
        fields = {f.name: f for f in dataclasses.fields(cls)}
        values: dict = {}
        if path and os.path.exists(path):
            with open(path) as file:
                values |= {k: v for k, v in json.load(file).items() if k in fields}
        for name, f in fields.items():
            raw = os.environ.get(env + name.upper())
            if raw is not None and isinstance(f.default, (bool, int, float)):
                values[name] = raw.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(raw)
        return cls(**values)

    def snapshot(self, path: str) -> None:
        """Write the settings of a run beside its results."""
        with open(path, "w") as file:
            json.dump(dataclasses.asdict(self), file, indent=1)
