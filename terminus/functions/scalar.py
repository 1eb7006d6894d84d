"""Column-level helpers shared by the operators (all native Spark expressions)."""

from __future__ import annotations

import datetime as dt
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference schema (ENUM declarations, in
# declaration order, which is also their sort order).
VEHICLE_TYPES = ["van", "mini-bus"]
DRIVER_STATUSES = ["available", "on_trip", "unavailable", "off_duty"]
VEHICLE_STATUSES = ["available", "in_service", "maintenance", "retired"]
TRIP_STATUSES = ["waiting", "boarding", "full", "departed", "arrived", "cancelled"]
PAYMENT_STATUSES = ["pending", "paid", "cancelled", "refunded"]
BOOKING_TYPES = ["online", "walk-in"]
PAYMENT_METHODS = ["cash", "gcash", "paymaya", "online", "terminal"]
USER_ROLES = ["admin", "dispatcher", "driver", "passenger"]
USER_STATUSES = ["active", "inactive", "blocked"]
ROUTE_STATUSES = ["active", "inactive"]
# Trip-status groups used by the reference queries.
LIVE_TRIP = ["waiting", "boarding", "full"]           # queue view
ACTIVE_TRIP = ["boarding", "waiting", "departed"]     # dashboard "active", delete guards
DRIVEN_TRIP = ["departed", "arrived"]                 # reports, history
BOOKABLE_TRIP = ["boarding", "full"]                  # create_booking
# ---------------------------------------------------------------------------


def lit_date(d: dt.date | str) -> Column:
    return F.lit(str(d)).cast("date")


def lit_ts(t: dt.datetime | str) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def full_name(first: Column | str, last: Column | str) -> Column:
    """``CONCAT(first, ' ', last)``: NULL when either part is NULL."""
    return F.concat(F.col(first) if isinstance(first, str) else first, F.lit(" "),
                    F.col(last) if isinstance(last, str) else last)


def enum_ordinal(col: Column | str, values: list[str]) -> Column:
    """1-based declaration position of an ENUM value (0 when unknown)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_position(F.array(*[F.lit(v) for v in values]), c)


def minutes_between(start: Column, end: Column) -> Column:
    """``TIMESTAMPDIFF(MINUTE, start, end)``: whole minutes, truncated."""
    return F.timestamp_diff("MINUTE", start, end)


def same_iso_week(ts: Column, day: dt.date) -> Column:
    """``YEARWEEK(ts, 1) = YEARWEEK(day, 1)`` (weeks start on Monday)."""
    return F.date_trunc("week", ts) == F.date_trunc("week", lit_date(day).cast("timestamp_ntz"))


def same_month(ts: Column, day: dt.date) -> Column:
    return F.date_trunc("month", ts) == F.date_trunc("month", lit_date(day).cast("timestamp_ntz"))


def on_day(ts: Column, day: dt.date) -> Column:
    """``DATE(ts) = day``; Catalyst turns this into a pushed half-open range."""
    return F.to_date(ts) == lit_date(day)


def in_days(ts: Column, start: dt.date, end: dt.date) -> Column:
    """``DATE(ts) BETWEEN start AND end`` (whole end day included)."""
    return F.to_date(ts).between(lit_date(start), lit_date(end))


def week_bounds(day: dt.date) -> tuple[dt.date, dt.date]:
    mon = day - dt.timedelta(days=day.weekday())
    return mon, mon + dt.timedelta(days=6)


def month_bounds(day: dt.date) -> tuple[dt.date, dt.date]:
    first = day.replace(day=1)
    nxt = (first.replace(year=first.year + 1, month=1) if first.month == 12
           else first.replace(month=first.month + 1))
    return first, nxt - dt.timedelta(days=1)


def ticket_reference(booking_id: Column, at: Column, wide: bool = True) -> Column:
    """``BT-<year>-<LPAD(id, 4, '0')>``.

    ``wide=False`` keeps the reference's LPAD, which cuts ids above 9999 to
    their first 4 digits (and so repeats references); ``wide=True`` pads to at
    least 4 digits without cutting.
    """
    sid = booking_id.cast("string")
    width = F.greatest(F.lit(4), F.length(sid)) if wide else F.lit(4)
    return F.concat(F.lit("BT-"), F.year(at).cast("string"), F.lit("-"), F.lpad(sid, width, "0"))


def _base_letters() -> tuple[str, str]:
    """Lower-case letters with marks (Latin, Greek, Cyrillic and others below
    U+2000), and the letters that their canonical decomposition starts with."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0x1100), *range(0x1E00, 0x2000))):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and c == c.lower() and all(unicodedata.category(m) == "Mn" for m in parts[1:]):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BASE_LETTERS = _base_letters()
# Letters that the collation compares as others.
EXPANSIONS = {"ß": "ss", "æ": "ae", "œ": "oe", "ς": "σ"}


def unaccented(col: Column | str) -> Column:
    """The letters the reference's collation tells apart: lower case, without
    marks (whether a letter comes composed or with combining marks), expanded."""
    c = F.translate(F.lower(F.col(col) if isinstance(col, str) else col), MARKED, BASE_LETTERS)
    for letter, others in EXPANSIONS.items():
        c = F.replace(c, F.lit(letter), F.lit(others))
    return F.regexp_replace(c, r"\p{Mn}+", "")


def folded(col: Column | str) -> Column:
    """Key of the reference's collation for equality and UNIQUE: case, accents
    and trailing spaces do not count. An equi-join key, so no nested loop."""
    return unaccented(F.rtrim(F.col(col) if isinstance(col, str) else col))


# Stand-ins for an escaped %, _ and backslash while a pattern is taken apart.
_PERCENT, _UNDERSCORE, _BACKSLASH = "\x01", "\x02", "\x03"


def like_parts(term: Column) -> Column:
    """A LIKE term with its escapes resolved: escaped wildcards and backslashes
    become stand-ins, a backslash before any other character goes, and one at the
    end stands for itself. What is left of ``%`` and ``_`` are wildcards."""
    t = F.regexp_replace(unaccented(term), r"\\\\", _BACKSLASH)
    t = F.regexp_replace(F.regexp_replace(t, r"\\%", _PERCENT), r"\\_", _UNDERSCORE)
    return F.regexp_replace(F.regexp_replace(t, r"\\$", _BACKSLASH), r"\\", "")


def like_literal(part: Column) -> Column:
    """The text that a run of literal characters of ``like_parts`` stands for."""
    return F.translate(part, _PERCENT + _UNDERSCORE + _BACKSLASH, "%_\\")


def ci_contains(col: Column, term: Column) -> Column:
    """``col LIKE '%term%'`` under a case- and accent-insensitive collation.

    The user's term keeps its ``%`` and ``_`` wildcards (the reference does not
    escape them), so this is a LIKE on folded text, not a substring test.
    """
    p = like_parts(term)
    for stand_in, text in ((_BACKSLASH, r"\\\\"), (_PERCENT, r"\\%"), (_UNDERSCORE, r"\\_")):
        p = F.regexp_replace(p, stand_in, text)
    return F.like(unaccented(col), F.concat(F.lit("%"), p, F.lit("%")))


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def avg4(c: Column) -> Column:
    """``AVG`` as double rounded to 4 places (same in Spark and the oracle)."""
    return F.round(F.avg(c.cast("double")), 4)
