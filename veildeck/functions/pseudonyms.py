"""Deterministic replacements as columns: salted hashes, dummies, UID remaps, date shifts, masks.

The salt is a column, so that it can come from a one-row table instead of standing in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UID_PREFIX = "1.2.826.0.1.3680043.8.498"
BULLET = "•"


def salted(value: Column, salt: Column, truncate: int = 16) -> Column:
    """sha256(salt, value) in hex, the first `truncate` digits, or all of them for 0 or less."""
    full = F.sha2(F.concat(salt.cast("binary"), F.encode(value, "UTF-8")), 256)
    return F.substring(full, 1, truncate) if truncate > 0 else full


def dummy(value: Column, vr: Column, salt: Column) -> Column:
    token = F.upper(salted(value, salt, 8))
    return F.concat(F.when(vr == "PN", "ANON^").otherwise("ANON"), token)


def remapped_uid(uid: Column, salt: Column, prefix: str = UID_PREFIX) -> Column:
    """A valid UID that depends on uid and salt alone, so references stay linked without a lookup table."""
    h = salted(uid, salt, 0)
    part = lambda at, n: F.conv(F.substring(h, at, n), 16, 10)
    return F.concat(F.lit(prefix + "."), part(1, 15), F.lit("."), part(16, 14))


def date_offset(patient: Column, salt: Column, low: int, high: int) -> Column:
    """Days between low and high, the same for all records of a patient."""
    low, high = min(low, high), max(low, high)
    h = F.sha2(F.concat(salt.cast("binary"), F.encode(F.concat(F.lit("|date|"), patient), "UTF-8")), 256)
    return (F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(high - low + 1).cast("decimal(20,0)")).cast("int") + low


def shifted_date(value: Column, days: Column) -> Column:
    """YYYYMMDD, with anything after it kept; unchanged if that isn't a date."""
    date = F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd")
    moved = F.concat(F.date_format(F.date_add(date, days), "yyyyMMdd"), F.substring(value, 9, 1 << 30))
    return F.coalesce(F.when(value.rlike(r"^\d{8}"), moved), value)


def shifted_da(value: Column, days: Column) -> Column:
    """A date of exactly eight digits; others unchanged."""
    return F.when(value.rlike(r"^\d{8}$"), shifted_date(value, days)).otherwise(value)


def shifted_iso(value: Column, days: Column) -> Column:
    """YYYY-MM-DD with its suffix kept; null if that isn't a date."""
    date = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(F.date_format(F.date_add(date, days), "yyyy-MM-dd"), F.substring(value, 11, 1 << 30)))


def masked(text: Column) -> Column:
    """First and last character with bullets between; bullets alone up to two characters."""
    t, n = F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))
    return F.when(n <= 2, F.repeat(F.lit(BULLET), n)).otherwise(F.concat(F.substring(t, 1, 1), F.repeat(F.lit(BULLET), n - 2), F.substring(t, -1, 1)))


def scrubbed_known(text: Column, known: Column) -> Column:
    """Known values cut out, longest first, in any case and without regard to word bounds; spaces closed up."""
    ordered = F.array_sort(F.filter(known, lambda v: v != ""), lambda a, b: F.length(b) - F.length(a))
    gone = F.aggregate(ordered, text, lambda t, v: F.regexp_replace(t, F.concat(F.lit(r"(?iu)\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(" ")))
    return closed_up(gone)


def closed_up(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"^\s+|\s+$", "")
