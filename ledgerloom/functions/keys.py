"""Keys of references, whatever notation they were typed or exported in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for "no reference".
NOTHING_WORDS = ["", "-", "--", "—", "–", "na", "n/a", "#n/a", "n.a.", "nan", "nil", "none", "null", "undefined", "blank"]

#: Zeros of the decimal digit scripts that statements come in (each is followed by its nine other digits).
DIGIT_ZEROS = "٠۰०০੦૦୦௦౦೦൦๐０"


def fold_digits(text: Column) -> Column:
    """Decimal digits of other scripts as ASCII digits."""
    foreign = "".join(chr(ord(zero) + k) for zero in DIGIT_ZEROS for k in range(10))
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, foreign, "0123456789" * len(DIGIT_ZEROS))).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space and invisible characters squeezed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\p{Cf}\p{Cc}]+", " "))


def reference_key(text: Column) -> Column:
    """The key behind a reference; null where it is null, blank or a word for nothing.

    Letter case, blanks, punctuation, labels in front and the notation of a number (leading zeros,
    a decimal tail, an exponent, a text mark, digits of another script) make no difference.
    A reference without any digit is its letters; one that is all zeros is "0".
    """
    # Most references are a label in capitals and digits; these need no more than one look.
    short = F.ltrim(F.ltrim(text, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ_")), F.lit("0"))
    return F.when(short.rlike("^[0-9]+$"), short).otherwise(_any_key(text))


def _any_key(text: Column) -> Column:
    clean = squeeze(fold_digits(text))
    number = F.regexp_replace(clean, r"^[^0-9]+|,", "")
    plain = F.upper(F.regexp_replace(clean, r"[^\p{L}\p{N}]+", ""))
    bare = F.regexp_replace(plain, r"^\p{L}+(?=.)", "")
    bare = F.when(bare.rlike(r"^\d"), F.regexp_replace(bare, r"^0+(?=.)", "")).otherwise(plain)
    notated = number.rlike(r"^\d+(\.\d+)?([eE]\+?\d{1,2})?$") & number.rlike(r"[.eE]")
    as_number = number.try_cast("decimal(38,6)").cast("string")
    key = F.when(notated & F.coalesce(as_number.endswith(".000000"), F.lit(False)), F.regexp_replace(as_number, r"\.0+$", "")).otherwise(bare)
    return F.when(F.lower(clean).isin(NOTHING_WORDS) | (plain == ""), F.lit(None)).otherwise(key)
