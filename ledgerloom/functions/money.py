"""Money from raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_text(text: Column) -> Column:
    """Amount of a money text as decimal(18,2), else null.

    Brackets, a leading minus and a trailing ``Dr`` make it negative, ``Cr`` keeps it positive; currency signs and
    codes, blanks and thousands separators are dropped. Null, blank, a dash and what holds no number give null.
    """
    clean = F.trim(F.regexp_replace(text, r"[\s\p{Z}\p{Cf}]+", " "))
    digits = F.regexp_replace(clean, r"[^0-9.]", "")
    digits = F.when(digits.rlike(r"^(\d+\.?\d*|\.\d+)$"), digits)
    negative = clean.rlike(r"(?i)^\(.*\)$|^[^0-9]*-|-\s*$|\bdr\.?$")
    return (F.when(negative, F.concat(F.lit("-"), digits)).otherwise(digits)).try_cast("decimal(18,2)")
