"""Column functions on text, days and money shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Taken off both ends of a text: spaces and tabs.
PADDING = " \t"
# English month abbreviations in calendar order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def stripped(c: Column | str) -> Column:
    """Without spaces and tabs at both ends; inner ones stay."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(PADDING))


def plain(c: Column | str) -> Column:
    """Stripped and in lower case; null stays null."""
    return F.lower(stripped(c))


def plain_or_null(c: Column | str) -> Column:
    """Plain, with null for a blank text."""
    return F.nullif(plain(c), F.lit(""))


def real_day(c: Column | str) -> Column:
    """The day written as yyyy-MM-dd, yyyyMMdd, d-MMM-yyyy, dd-MMM-yyyy or dd/MM/yyyy.

    Spaces at the ends are ignored, month names are read in any case. Null where
    the text has another form or names no day of the calendar (years 1 to 9999).
    """
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    iso, packed, slashed, named = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{2})/(\d{2})/(\d{4})$", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$"
    at = F.instr(F.lit(MONTHS), F.lower(part(named, 2)))
    month = F.when((at > 0) & (F.pmod(at - 1, F.lit(3)) == 0), F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0")).otherwise("00")
    text = (
        F.when(t.rlike(iso), t)
        .when(t.rlike(packed), F.concat_ws("-", part(packed, 1), part(packed, 2), part(packed, 3)))
        .when(t.rlike(slashed), F.concat_ws("-", part(slashed, 3), part(slashed, 2), part(slashed, 1)))
        .when(t.rlike(named), F.concat_ws("-", part(named, 3), month, F.lpad(part(named, 1), 2, "0")))
    )
    return F.when(~text.startswith("0000"), text).try_cast("date")


def cents(c: Column | str) -> Column:
    """An amount as an exact decimal with two places; null and what is no number count as 0."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def number(c: Column | str) -> Column:
    """A tolerant number: all but digits, points and minus signs is dropped; what doesn't parse is 0."""
    t = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(t, r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))
