"""Scalar rules of the ledger datasets as column functions; all run in the JVM.

Missing is not null: a missing text is empty, a missing number 0, a missing
flag false. Only days and balances that were never captured are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import number, real_day

__all__ = ["number", "real_day"]


def text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def first_text(*cs: Column) -> Column:
    """The first that is not blank, trimmed; else empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs), F.lit(""))


def first_nonzero(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit(0.0)) for c in cs), F.lit(0.0))


def integer(c: Column) -> Column:
    """Cut off after going through a double, as the number is read."""
    return number(c).cast("bigint")


def flag(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).isin("YES", "TRUE", "1"), F.lit(False))


def iso_day(c: Column) -> Column:
    """A day written exactly as yyyy-MM-dd, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).try_cast("date")


def xml_escaped(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def contains_any(c: Column, *words: str) -> Column:
    low = F.lower(c)
    found = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(low, F.lit(w))
    return F.coalesce(found, F.lit(False))


def tax_head(ledger: Column) -> Column:
    """cgst, sgst or igst by the first that the ledger's name mentions; else null."""
    return F.when(contains_any(ledger, "cgst"), "cgst").when(contains_any(ledger, "sgst", "utgst"), "sgst").when(contains_any(ledger, "igst"), "igst")


def register(voucher_type: Column) -> Column:
    """The register a voucher type belongs to: sales is tested first."""
    return F.when(contains_any(voucher_type, "sales", "credit note"), "sales").when(contains_any(voucher_type, "purchase", "debit note"), "purchase")


def lifecycle(cancelled: Column, optional: Column) -> Column:
    return F.when(cancelled, "cancelled").when(optional, "optional").otherwise("active")


def positive_part(amount: Column) -> Column:
    return F.when(amount > 0, F.abs(amount)).otherwise(0.0)


def negative_part(amount: Column) -> Column:
    return F.when(amount < 0, F.abs(amount)).otherwise(0.0)


def balance_side(amount: Column) -> Column:
    return F.when(amount >= 0, "Liabilities").otherwise("Assets")


def document_key(guid: Column, *others: Column) -> Column:
    """What tells documents apart: the guid in lower case, or the other parts if it is blank."""
    return F.lower(F.coalesce(F.nullif(F.trim(guid), F.lit("")), F.concat_ws("|", *(F.coalesce(o.cast("string"), F.lit("")) for o in others))))


def safe_id(c: Column) -> Column:
    """Letters, digits, dot, underscore and dash; at most 64; one underscore for a blank text."""
    cut = F.left(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]", "_"), F.lit(64))
    return F.when(text(c) == "", "_").otherwise(cut)


def batch_id(agent: Column, company: Column, dataset: Column, start: Column, end: Column, sequence: Column, digest: Column) -> Column:
    window = lambda c: F.when(text(c) == "", "na").otherwise(safe_id(c))
    return F.concat_ws("-", safe_id(agent), safe_id(company), safe_id(dataset), window(start), window(end), F.lpad(sequence.cast("string"), 6, "0"), F.lower(F.left(digest, F.lit(12))))


def group_key(*parts: Column) -> Column:
    return F.upper(F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))


def fiscal_year_start(day: Column) -> Column:
    return F.make_date(F.year(F.add_months(day, -3)), F.lit(4), F.lit(1))


def backoff_minutes(attempt: Column, cap: float = 30.0) -> Column:
    """Doubles with each attempt up to the cap; the sender adds its jitter."""
    return F.least(F.pow(F.lit(2.0), F.least(attempt, F.lit(20))), F.lit(cap))


def capped(c: Column, length: int) -> Column:
    return F.left(c, F.lit(length))


def clamped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))
