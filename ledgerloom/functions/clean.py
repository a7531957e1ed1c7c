"""Cleaning of cells: numbers, null words, references, headers, registries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import REFERENCE_PREFIXES

# The registries' aliases.
STATUS = {
    "settled": "SETTLED", "success": "SETTLED", "successful": "SETTLED", "captured": "SETTLED", "completed": "SETTLED", "paid": "SETTLED", "paid_out_custom": "SETTLED",
    "pending": "PENDING", "processing": "PENDING", "initiated": "PENDING", "failed": "FAILED", "failure": "FAILED", "rejected": "FAILED", "declined": "FAILED",
    "reversed": "REVERSED", "refunded": "REFUNDED", "disputed": "DISPUTED", "chargeback": "DISPUTED",
}
DIRECTION = {
    "credit": "CREDIT", "cr": "CREDIT", "in": "CREDIT", "deposit": "CREDIT", "inflow": "CREDIT", "payin": "CREDIT",
    "debit": "DEBIT", "dr": "DEBIT", "out": "DEBIT", "withdrawal": "DEBIT", "outflow": "DEBIT", "payout": "DEBIT",
}
# Statuses that can't be matched, words for nothing, texts that are no identifiers.
EXCLUDED_STATUSES = ["FAILED", "DECLINED", "CANCELLED", "PENDING", "REJECTED"]
NULL_WORDS = ["", "nan", "none", "null", "undefined", "—", "-"]
INVALID_IDS = ["", "nan", "none", "null", "unknown", "n/a", "na", "—", "-", "undefined"]


def parse_numeric(text: Column) -> Column:
    """Money text to decimal(18,2): brackets and a trailing Dr make it negative; null where it is no number."""
    s = F.trim(text)
    bracket = s.rlike(r"^\(.*\)$")
    inner = F.trim(F.when(bracket, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s))
    debit = inner.rlike(r"(?i)dr$")
    body = F.regexp_replace(F.regexp_replace(inner, r"(?i)\s*(dr|cr)$", ""), r"[^0-9.\-]", "")
    value = F.when(body.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), body).try_cast("decimal(18,2)")
    signed = F.when((bracket | debit) & (value > 0), -value).otherwise(value)
    return F.when(F.lower(s).isin("", "nan", "none", "null"), F.lit(None)).otherwise(signed)


def clean_text(text: Column) -> Column:
    """Trimmed text; null words become null."""
    return F.when(~F.lower(F.trim(text)).isin(NULL_WORDS), F.trim(text))


def valid_id(text: Column) -> Column:
    """True for an identifier: no null word and nothing that looks like a date."""
    s = F.trim(text)
    dated = s.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$") | s.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$")
    return F.coalesce(~F.lower(s).isin(INVALID_IDS) & ~dated, F.lit(False))


#: Times through the list of prefixes that one look takes off; longer chains are taken off look by look.
_AT_ONCE = 32


def normal_reference(text: Column, prefixes: tuple[str, ...] = REFERENCE_PREFIXES) -> Column:
    """Upper case, known prefixes stripped in list order, the list gone through until nothing changes, letters and digits only; "" for null."""
    s = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    once = "".join(f"(?:{_quoted(p)})?" for p in prefixes)
    starts = lambda x: x.rlike("^(?:" + "|".join(_quoted(p) for p in prefixes) + ")")
    rest = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), x, lambda left, _: F.regexp_replace(left, "^" + once, ""))
    # The long pattern runs only where there is a prefix, and once, as what it leaves is bound to a name.
    cut = F.get(F.transform(F.array(F.regexp_replace(s, f"^(?:{once}){{1,{_AT_ONCE}}}", "")), lambda x: F.when(starts(x), rest(x)).otherwise(x)), F.lit(0))
    return F.regexp_replace(F.when(starts(s), cut).otherwise(s), r"[^\p{L}\p{N}]", "")


def _quoted(prefix: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in prefix)


def compact(text: Column) -> Column:
    """Upper case without blanks."""
    return F.replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit(""))


def feature_text(text: Column) -> Column:
    """Upper case without blanks, dashes, underscores and the words for transfers."""
    s = F.upper(F.coalesce(text, F.lit("")))
    for part in (" ", "-", "_", "NEFTCR", "NEFT", "UTR", "UPI"):
        s = F.replace(s, F.lit(part), F.lit(""))
    return F.trim(s)


def normal_cell(text: Column) -> Column:
    """Cell for the comparison of whole columns: lower case, no currency signs or thousands separators."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[₹$,]", "")


def pattern_key(text: Column) -> Column:
    """Description for grouping: lower case without long hexadecimal or numeric words, blanks squeezed."""
    s = F.lower(F.trim(text))
    s = F.regexp_replace(F.regexp_replace(s, r"\b[a-f0-9]{8,}\b", ""), r"\b\d{6,}\b", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def amount_or_zero(text: Column) -> Column:
    """Amount with currency signs and separators dropped; 0 where it is none."""
    return F.coalesce(F.regexp_replace(text, r"[₹$€£,\s]", "").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def registry(text: Column, aliases: dict[str, str]) -> Column:
    """The canonical value of an alias; UNKNOWN for others, null for null."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.when(text.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(F.trim(text))), F.lit("UNKNOWN")))


def content_hash(date: Column, net: Column, utr: Column, order: Column, description: Column, customer: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the row's identifying fields, in the order of their names."""
    money = F.when(net.isNotNull() & (net != 0), net.cast("string"))
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (customer, description, money, order, date, utr)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


# Identifiers in free text, first pattern that matches.
ORDER_PATTERNS = [r"(?i)\b(ord_[a-zA-Z0-9_]+)\b", r"(?i)\b(order_[a-zA-Z0-9_]+)\b", r"(?i)\bORDER[_-]?([0-9]{4,10})\b"]
UTR_PATTERNS = [r"(?i)\b(?:NEFT|UTR|RRN)?([A-Z0-9]{12,18})\b", r"(?i)\b(NEFT[A-Z0-9]+)\b", r"(?i)\b(RRN[0-9]{10,12})\b"]
SETTLEMENT_PATTERNS = [r"(?i)\b(setl_[a-zA-Z0-9_]+)\b", r"(?i)\b(setl[0-9]+)\b"]


def backfill(identifier: Column, description: Column, patterns: list[str]) -> Column:
    """The identifier if valid, else the first that a pattern finds in the description, else null."""
    found = [F.nullif(F.regexp_extract(description, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(F.when(valid_id(identifier), F.trim(identifier)), *found)
