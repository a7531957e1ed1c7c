"""From raw statements to canonical rows: header planning, cleaning, eligibility, quality and duplicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean

# Headers that mean a canonical field; each alias has one owner.
ALIASES = {
    "transaction_id": ["transaction_id", "txn_id", "payment_id", "upi_txn_id"], "transaction_date": ["date", "txn_date", "transaction_date", "payment_date", "refund_date", "receipt_date"],
    "value_date": ["value_date", "settlement_date"], "gross_amount": ["gross_amount", "gross", "gross_amount_usd"], "net_amount": ["net_amount", "amount", "net", "net_usd", "refund_amount", "amount_reported"],
    "debit_amount": ["withdrawal_dr", "debit", "withdrawal", "debit_amount"], "credit_amount": ["deposit_cr", "credit", "deposit", "credit_amount", "amount_received"], "fee_amount": ["fee", "fee_usd", "fee_amount", "charges"],
    "tax_amount": ["tax", "gst", "tax_amount"], "utr": ["utr", "ref_utr", "reference_utr", "reference_no", "original_reference"], "rrn": ["rrn"], "order_id": ["order_id", "order_no"], "settlement_id": ["settlement_id", "voucher_no"],
    "auth_code": ["auth_code"], "description": ["description", "narration", "reason", "particulars"], "customer_name": ["customer_name", "vendor_name", "vpa_phone"], "status": ["status", "adjustment_type"],
    "currency": ["currency", "curr", "currency_code"], "channel": ["channel", "payment_mode", "source_type"],
}
MONEY_FIELDS = {"gross_amount", "net_amount", "debit_amount", "credit_amount", "fee_amount", "tax_amount"}
FUZZY_FLOOR = 0.60
# First cells of summary and footer rows, and words of header rows.
SUMMARY_WORDS = ["total", "grand total", "subtotal", "total amount", "summary", "net total", "closing balance", "opening balance", "report total"]
HEADER_WORDS = ["date", "amount", "utr", "ref", "reference", "description", "narration", "debit", "credit", "balance", "status", "order", "transaction", "particulars", "settlement"]


@dataclass(frozen=True)
class Mapping:
    field: str
    column: str
    method: str
    confidence: float


def normal_header(header: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", header.strip().lower())).strip("_")


def map_columns(headers: list[str], aliases: dict[str, list[str]] = ALIASES) -> tuple[list[Mapping], list[str]]:
    """Mappings of headers to canonical fields, and the headers that none was found for.

    An exact alias first, then the likest alias of at least the floor; a field goes to the first header that claims it.
    Headers of balances are never money fields, headers of counts are nothing.
    """
    owner = {a: f for f, names in aliases.items() for a in names}
    out, left, claimed = [], [], set()
    for h in headers:
        f = owner.get(normal_header(h))
        if f and f not in claimed:
            out.append(Mapping(f, h, "exact", 1.0))
            claimed.add(f)
        else:
            left.append(h)
    missing = []
    for h in left:
        n = normal_header(h)
        best = (0.0, "")
        if not re.search(r"count|qty|quantity", n):
            scored = [(SequenceMatcher(None, n, a).ratio(), f) for a, f in owner.items() if f not in claimed and not ("balance" in n and f in MONEY_FIELDS)]
            best = max(scored, default=best)
        if best[0] >= FUZZY_FLOOR:
            out.append(Mapping(best[1], h, "fuzzy", round(best[0], 4)))
            claimed.add(best[1])
        else:
            missing.append(h)
    return out, missing


def promote_header(df: DataFrame, order: str, look: int = 10) -> DataFrame:
    """The rows below the header row that lies within the first ``look`` rows, under its names.

    A row scores 3 for every cell with a header word and 1 for every other text; the best row wins if it beats the present
    header and scores at least 3. ``order`` is the column of the row numbers, which is kept. Only ``look`` rows reach the driver.
    """
    columns = [c for c in df.columns if c != order]
    score = lambda cells: sum(3 if any(w in str(c).lower() for w in HEADER_WORDS) else 1 for c in cells if c and not re.fullmatch(r"[\d.,\-/: ]+", str(c)))
    head = df.orderBy(order).limit(look).collect()
    best, at = score([c for c in columns if not c.startswith("_c")]), None
    for row in head:
        s = score([row[c] for c in columns])
        if s > best and s >= 3:
            best, at = s, row
    if at is None:
        return df
    names = [str(at[c]).strip() if at[c] else c for c in columns]
    return df.where(F.col(order) > at[order]).select(order, *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)])


def is_summary_row(*cells: Column) -> Column:
    """True for a row with a cell that is a summary word, or starts with one and a blank or colon."""
    words = "|".join(SUMMARY_WORDS)
    return F.exists(F.array(*[F.lower(F.trim(c.cast("string"))) for c in cells]), lambda c: F.coalesce(c.rlike(rf"^({words})($|[ :])"), F.lit(False)))


def duplicate_columns(df: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """(kept, dropped): columns that hold the same in every row once cells are normalised; one pass over the data.

    Of two the one earlier in ``priority`` is kept, else the left one. A table without rows has none.
    """
    cols = df.columns
    rank = {c: (priority.index(c) if priority and c in priority else len(cols), cols.index(c)) for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    cell = lambda c: clean.normal_cell(F.col(f"`{c}`").cast("string"))
    schema = "kept string, dropped string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    same = df.agg(*[F.every(cell(a) == cell(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)])
    named = [F.struct(F.col(f"s{k}").alias("same"), F.lit(min((a, b), key=rank.get)).alias("kept"), F.lit(max((a, b), key=rank.get)).alias("dropped")) for k, (a, b) in enumerate(pairs)]
    return same.select(F.explode(F.array(*named)).alias("x")).where("x.same").select("x.kept", "x.dropped")


def canonical(df: DataFrame, mappings: list[Mapping], prefix: str = "TXN", row_number: Column | None = None, source_file: str | None = None) -> DataFrame:
    """Canonical rows of a raw table: one projection in three steps, no Python.

    Net is the stated one, else credit less debit, else gross less fee and tax. Missing references are looked for in the
    description. The id is the first valid one of transaction, reference, order, authorisation, retrieval number, else the
    settlement's with the order or row, else ``prefix-TXN-0001`` by row number.
    """
    by = {m.field: F.col(f"`{m.column}`").cast("string") for m in mappings}
    raw = lambda f: by.get(f, F.lit(None).cast("string"))
    money = lambda f: clean.parse_numeric(raw(f))
    number = row_number if row_number is not None else F.lit(1)
    header_currency = next((code for m in mappings for code in ("INR", "USD", "EUR", "GBP", "AED", "SGD", "CAD", "AUD") if code in m.column.upper()), "INR")
    step = df.select(
        raw("transaction_id").alias("transaction_id"), F.trim(raw("transaction_date")).alias("transaction_date"), F.trim(raw("value_date")).alias("value_date"),
        *[money(f).alias(f) for f in sorted(MONEY_FIELDS)], F.trim(raw("description")).alias("description"), F.trim(raw("customer_name")).alias("customer_name"),
        *[raw(f).alias("__" + f) for f in ("utr", "order_id", "settlement_id", "auth_code", "rrn", "currency", "status")], F.trim(raw("channel")).alias("channel"), number.cast("long").alias("source_row_number"),
    )
    zero = F.lit(0).cast("decimal(18,2)")
    cr, dr = F.col("credit_amount"), F.col("debit_amount")
    split = F.when(cr.isNotNull() | dr.isNotNull(), F.coalesce(cr, zero) - F.coalesce(dr, zero))
    net = F.coalesce("net_amount", split, F.col("gross_amount") - F.coalesce("fee_amount", zero) - F.coalesce("tax_amount", zero)).cast("decimal(18,2)")
    desc = F.col("description")
    valid = lambda f: F.when(clean.valid_id(F.col(f)), F.trim(f))
    said = F.when(desc.rlike(r"(?i)\(USD|\bUSD\b"), "USD").when(desc.rlike(r"(?i)\(EUR|\bEUR\b"), "EUR").when(desc.rlike(r"(?i)\(GBP|\bGBP\b"), "GBP")
    step = step.withColumns(
        {
            "net_amount": net,
            "utr": clean.backfill(F.col("__utr"), desc, clean.UTR_PATTERNS), "order_id": clean.backfill(F.col("__order_id"), desc, clean.ORDER_PATTERNS), "settlement_id": clean.backfill(F.col("__settlement_id"), desc, clean.SETTLEMENT_PATTERNS),
            "auth_code": valid("__auth_code"), "rrn": valid("__rrn"), "currency": F.coalesce(F.upper(clean.clean_text(F.col("__currency"))), said, F.lit(header_currency)), "status": clean.registry(clean.clean_text(F.col("__status")), clean.STATUS),
        }
    )
    only = lambda a, b: (F.col(a) > 0) & (F.coalesce(F.col(b), zero) == 0)
    direction = F.when(only("credit_amount", "debit_amount"), "CREDIT").when(only("debit_amount", "credit_amount"), "DEBIT").when(F.col("net_amount") >= 0, "CREDIT").when(F.col("net_amount") < 0, "DEBIT")
    composite = F.when(F.col("settlement_id").isNotNull(), F.concat(F.col("settlement_id"), F.coalesce(F.concat(F.lit("_"), F.col("order_id")), F.concat(F.lit("_row"), F.col("source_row_number")))))
    fallback = F.concat(F.lit(f"{prefix}-TXN-"), F.format_string("%04d", "source_row_number"))
    return step.withColumns(
        {
            "direction": direction,
            "transaction_id": F.coalesce(valid("transaction_id"), "utr", "order_id", "auth_code", "rrn", composite, fallback),
            "source_file": F.lit(source_file),
            "content_hash": clean.content_hash(F.col("transaction_date"), F.col("net_amount"), F.col("utr"), F.col("order_id"), desc, F.col("customer_name")),
        }
    ).drop(*["__" + f for f in ("utr", "order_id", "settlement_id", "auth_code", "rrn", "currency", "status")])


def eligibility(df: DataFrame, status: str = "status") -> DataFrame:
    """``df`` with ``eligible`` and ``excluded_reason``: rows of an excluded status can't be matched."""
    st = clean.registry(F.col(status), clean.STATUS)
    bad = F.coalesce(st.isin(clean.EXCLUDED_STATUSES), F.lit(False))
    return df.withColumn("eligible", ~bad).withColumn("excluded_reason", F.when(bad, F.concat(F.lit("status excluded: "), st)))


def mark_duplicates(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """``df`` with ``dup_kind``: the first of ``keys`` by which an earlier kept row has the same value; null for kept rows.

    Keys are tried in turn, and only rows that no earlier key dropped register for the next. Null keys are never the same. A key
    is settled by one minimum per value (combined before the shuffle), so copies of one row don't meet in a task.
    """
    out = df.withColumn("dup_kind", F.lit(None).cast("string"))
    for key in keys:
        first = out.where(F.col("dup_kind").isNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(order).alias("__first"))
        out = out.join(first, F.col(key) == F.col("__k"), "left")
        out = out.withColumn("dup_kind", F.when(F.col("dup_kind").isNull() & F.col("__first").isNotNull() & (F.col(order) > F.col("__first")), F.lit(key)).otherwise(F.col("dup_kind"))).drop("__k", "__first")
    return out


def duplicate_report(marked: DataFrame, share: float = 0.80) -> DataFrame:
    """One row: total, unique and duplicate counts, and whether the file looks like one uploaded before."""
    total, dup = F.count(F.lit(1)), F.count("dup_kind")
    return marked.agg(total.alias("total"), (total - dup).alias("n_unique"), dup.alias("n_duplicate"), F.coalesce(dup >= share * total, F.lit(False)).alias("duplicate_upload"))


def quality_report(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_rows, n_missing, fill_rate, sparse) of every field in one pass; sparse: under 30 % filled of at least five rows."""
    have = lambda f: F.count(F.when(clean.clean_text(F.col(f"`{f}`").cast("string")).isNotNull(), 1))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[have(f).alias(f"h{k}") for k, f in enumerate(fields)])
    each = [F.struct(F.lit(f).alias("field"), F.col(f"h{k}").alias("filled")) for k, f in enumerate(fields)]
    rate = F.when(F.col("n") > 0, F.round(F.col("x.filled") / F.col("n"), 4)).otherwise(0.0)
    return one.select("n", F.explode(F.array(*each)).alias("x")).select(F.col("x.field").alias("field"), F.col("n").alias("n_rows"), (F.col("n") - F.col("x.filled")).alias("n_missing"), rate.alias("fill_rate"), ((F.col("n") >= 5) & (rate < 0.3)).alias("sparse"))


# What names a channel in file names, headers and values.
CHANNELS = {
    "UPI": (["upi", "gpay", "phonepe", "paytm_upi"], ["vpa", "upi_id", "upi_txn_id", "handle"], ["@upi", "@ybl", "@ok", "@icici", "@axl"]),
    "CARD": (["card", "pos", "terminal", "credit_card"], ["card_network", "auth_code", "last4", "card_number", "bin"], ["visa", "mastercard", "rupay", "amex"]),
    "NEFT": (["neft"], ["neft_ref"], [r"\bneft\b", "neftcr"]),
    "CASH": (["cash"], ["cash_drawer", "cashier_id"], ["cash deposit", "petty cash"]),
}


def channel_scores(df: DataFrame, filename: str, columns: list[str] | None = None) -> DataFrame:
    """(channel, score): .35 for the file name, .45 for headers, .20 for the share of rows with a typical value, to 4 digits."""
    cols = columns or df.columns
    row = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in cols]))
    headers = {normal_header(c) for c in cols}
    hits = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(row.rlike("|".join(v)), 1)).alias(k) for k, (_, _, v) in CHANNELS.items()])
    each = []
    for k, (names, heads, _) in CHANNELS.items():
        named = any(x in filename.lower() for x in names)
        head = min(1.0, len(headers & set(heads)) / min(3, len(heads)))
        each.append(F.struct(F.lit(k).alias("channel"), F.round(F.lit(0.35 * named + 0.45 * head) + 0.2 * F.when(F.col("n") > 0, F.col(k) / F.col("n")).otherwise(0.0), 4).alias("score")))
    return hits.select(F.explode(F.array(*each)).alias("x")).select("x.channel", "x.score")


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    """All rows of several tables; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_new(stored: DataFrame, batch: DataFrame, key: str = "content_hash") -> DataFrame:
    """Stored rows and the rows of a batch whose key is not stored yet; of a batch's copies the first by all columns."""
    fresh = batch.join(stored.select(key).distinct(), key, "left_anti")
    fresh = fresh.groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in batch.columns])).alias("__r")).select("__r.*")
    return stored.unionByName(fresh, allowMissingColumns=True)
