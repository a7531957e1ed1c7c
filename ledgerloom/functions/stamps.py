"""One UTC instant for stamps written in many formats.

An ordered cascade of anchored patterns rewrites a stamp into named fields; the first pattern that
matches decides, and strict checks on the fields reject what denotes no instant. A stamp without a
zone is local time of the sender's zone, which comes from a lookup.

Policy for local times: one that occurs twice is its first occurrence; one that never occurs is
moved on by the length of the gap.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import fold_digits, squeeze

DAY_US = 86_400_000_000

# Month names and their accepted short forms.
MONTHS = {
    "JAN": 1, "JANUARY": 1, "FEB": 2, "FEBRUARY": 2, "MAR": 3, "MARCH": 3, "APR": 4, "APRIL": 4, "MAY": 5, "JUN": 6, "JUNE": 6,
    "JUL": 7, "JULY": 7, "AUG": 8, "AUGUST": 8, "SEP": 9, "SEPT": 9, "SEPTEMBER": 9, "OCT": 10, "OCTOBER": 10,
    "NOV": 11, "NOVEMBER": 11, "DEC": 12, "DECEMBER": 12,
}

# Abbreviations that a zone's own people write, in minutes east of UTC.
_US = {"East": {"EST": -300, "EDT": -240}, "Mid": {"CST": -360, "CDT": -300}, "Mountain": {"MST": -420, "MDT": -360}, "West": {"PST": -480, "PDT": -420}}
_CENTRAL_EU = {"CET": 60, "CEST": 120}
ABBREVIATIONS = {
    "America/New_York": _US["East"], "America/Toronto": _US["East"], "America/Detroit": _US["East"],
    "America/Chicago": _US["Mid"], "America/Denver": _US["Mountain"], "America/Phoenix": {"MST": -420}, "America/Los_Angeles": _US["West"],
    "Europe/London": {"GMT": 0, "BST": 60}, "Europe/Dublin": {"GMT": 0, "IST": 60}, "Europe/Lisbon": {"WET": 0, "WEST": 60},
    "Europe/Berlin": _CENTRAL_EU, "Europe/Paris": _CENTRAL_EU, "Europe/Madrid": _CENTRAL_EU, "Europe/Rome": _CENTRAL_EU, "Europe/Amsterdam": _CENTRAL_EU,
    "Europe/Brussels": _CENTRAL_EU, "Europe/Vienna": _CENTRAL_EU, "Europe/Zurich": _CENTRAL_EU, "Europe/Stockholm": _CENTRAL_EU, "Europe/Warsaw": _CENTRAL_EU,
    "Europe/Athens": {"EET": 120, "EEST": 180}, "Europe/Helsinki": {"EET": 120, "EEST": 180}, "Europe/Moscow": {"MSK": 180},
    "Asia/Kolkata": {"IST": 330}, "Asia/Calcutta": {"IST": 330}, "Asia/Karachi": {"PKT": 300}, "Asia/Dubai": {"GST": 240}, "Asia/Singapore": {"SGT": 480},
    "Asia/Hong_Kong": {"HKT": 480}, "Asia/Shanghai": {"CST": 480}, "Asia/Tokyo": {"JST": 540}, "Asia/Seoul": {"KST": 540}, "Asia/Jakarta": {"WIB": 420},
    "Australia/Sydney": {"AEST": 600, "AEDT": 660}, "Australia/Melbourne": {"AEST": 600, "AEDT": 660}, "Australia/Brisbane": {"AEST": 600},
    "Australia/Perth": {"AWST": 480}, "Pacific/Auckland": {"NZST": 720, "NZDT": 780}, "Africa/Johannesburg": {"SAST": 120}, "Africa/Nairobi": {"EAT": 180},
}

_TIME = r"(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?: ?([AP])\.?M\.?)?(?: ?(Z|[A-Z]{2,5}|[+-]\d{2}:?\d{2}))?)"
_SEP = r"(?: |T|, ?)"

#: name, pattern, fields year|month|day|first|second|hour|minute|second|fraction|half|zone (``first``/``second``: day and month in the feed's order).
CASCADE = [
    ("iso", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:{_SEP}{_TIME})?$", "$1|$3|$4|||$5|$6|$7|$8|$9|$10"),
    ("numeric", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:{_SEP}{_TIME})?$", "$4|||$1|$3|$5|$6|$7|$8|$9|$10"),
    ("day_month_name", rf"^(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*,? )?(\d{{1,2}})[ /.-]?([A-Z]{{3,9}})[ /.,-]{{0,2}}(\d{{4}}|\d{{2}})(?:{_SEP}{_TIME})?$", "$3|$2|$1|||$4|$5|$6|$7|$8|$9"),
    ("month_name_day", rf"^(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*,? )?([A-Z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}})(?:{_SEP}{_TIME})?$", "$3|$1|$2|||$4|$5|$6|$7|$8|$9"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})?(?:\.(\d{1,12}))?(Z)?)?$", "$1|$2|$3|||$4|$5|$6|$7||$8"),
]
EPOCH = r"^(\d{10})(?:\.(\d{1,9}))?$"


def ntz_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without zone, whatever the session's zone is."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.unix_date(ts.cast("date")).cast("long") * DAY_US + seconds.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def micros(ts: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970-01-01 UTC of a column of UTC stamps, with or without zone in its type."""
    return ntz_micros(ts) if isinstance(kind, T.TimestampNTZType) else F.unix_micros(ts.cast("timestamp"))


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def stamp_fields(text: Column) -> Column:
    """The fields of the first pattern that matches, joined by ``|``; null where none does."""
    out = F.lit(None).cast("string")
    for _, pattern, fields in reversed(CASCADE):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, fields)).otherwise(out)
    return out


def clean_stamp(text: Column) -> Column:
    """The text the patterns are anchored to: ASCII digits, single blanks, upper case, no text mark."""
    return F.upper(F.regexp_replace(squeeze(fold_digits(text)), "^'", ""))


def steps_to_utc_us(home_zone: str, day_first: str) -> list[dict[str, Column]]:
    """Projections, one after the other, from a cleaned stamp ``__clean`` to its instant ``__us``.

    Each step names what later steps use more than once, so that nothing is computed twice.
    """
    c = F.col
    part = lambda k: F.coalesce(F.get(c("__parts"), F.lit(k)), F.lit(""))
    num = lambda k: part(k).try_cast("int")  # noqa: E731  ("" gives null)
    first_is_day = c(day_first)
    half = c("__half")
    zones = {f"{z} {a}": m for z, names in ABBREVIATIONS.items() for a, m in names.items()}
    zone, hh, mm = c("__zone"), F.substring("__zone", 2, 2).try_cast("int"), F.substring("__zone", -2, 2).try_cast("int")
    serial = c("__serial_us")
    return [
        {"__parts": F.split(stamp_fields(c("__clean")), r"\|", -1)},
        {
            "__year": num(0) + F.when(F.length(part(0)) == 2, 2000).otherwise(0),
            "__month": F.coalesce(num(1), F.try_element_at(_literal_map(MONTHS), part(1)), F.when(first_is_day, num(4)).when(~first_is_day, num(3))),
            "__day": F.coalesce(num(2), F.when(first_is_day, num(3)).when(~first_is_day, num(4))),
            "__hour24": F.coalesce(num(5), F.lit(0)),
            "__minute": F.coalesce(num(6), F.lit(0)),
            "__second": F.coalesce(num(7), F.lit(0)),
            "__micro": F.rpad(F.substring(part(8), 1, 6), 6, "0").try_cast("int"),
            "__half": part(9),
            "__zone": part(10),
            "__serial_us": F.when(c("__clean").rlike(r"^\d{5}(\.\d{1,12})?$"), F.floor((c("__clean").try_cast("decimal(20,12)") - F.lit(25569)) * F.lit(DAY_US)).cast("long")),
        },
        {"__hour": F.when(half == "", c("__hour24")).when(c("__hour24").between(1, 12), c("__hour24") % 12 + F.when(half == "P", 12).otherwise(0))},
        {
            "__local": F.when(serial.isNotNull(), F.expr("dateadd(DAY, cast(floor(__serial_us / 86400000000) AS int), TIMESTAMP_NTZ'1970-01-01 00:00:00')")).when(
                c("__hour").between(0, 23) & (c("__minute") <= 59) & (c("__second") <= 59),
                F.try_make_timestamp_ntz(c("__year"), c("__month"), c("__day"), c("__hour"), c("__minute"), c("__second").cast("decimal(16,6)")),
            ),
        },
        {"__local": F.when(serial.isNotNull(), c("__local") + F.expr("make_dt_interval(0, 0, 0, cast(pmod(__serial_us, 86400000000) / 1000000 AS decimal(18,6)))")).otherwise(c("__local"))},
        {
            "__home": F.when(zone == "", F.convert_timezone(c(home_zone), F.lit("UTC"), c("__local"))).otherwise(c("__local")),
            "__offset": F.when(zone.isin("", "Z", "UTC", "UT", "GMT"), F.lit(0))
            .when(zone.rlike(r"^[+-]\d{2}:?\d{2}$"), F.when((hh <= 18) & (mm <= 59), (hh * 60 + mm) * F.when(zone.startswith("-"), -1).otherwise(1)))
            .otherwise(F.try_element_at(_literal_map(zones), F.concat_ws(" ", c(home_zone), zone))),
        },
        {
            "__us": F.when(c("__clean").rlike(EPOCH), F.floor(c("__clean").try_cast("decimal(30,9)") * 1_000_000).cast("long"))
            .when(c("__clean").rlike(r"^\d{13}$"), c("__clean").try_cast("long") * 1000)
            .when(c("__clean").rlike(r"^\d{16}$"), c("__clean").try_cast("long"))
            .when(c("__clean").rlike(r"^\d{19}$"), F.floor(c("__clean").try_cast("decimal(20,0)") / 1000).cast("long"))
            .otherwise(ntz_micros(c("__home")) - c("__offset").cast("long") * 60_000_000 + F.when(serial.isNull(), c("__micro")).otherwise(0)),
        },
    ]


def known_zone(zone: Column) -> Column:
    """The zone if it is one of the IANA list, else null."""
    return F.when(zone.isin(sorted(available_timezones() - {"Factory", "localtime"})), zone)
