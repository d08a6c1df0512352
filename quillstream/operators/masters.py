"""Master records: unnesting, balances carried forward, and lookups among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import scalars as S
from quillstream.session import lookup_join


def opening_bills(ledgers: DataFrame) -> DataFrame:
    """One row a bill of a ledger (column bills); blank references are left out."""
    rows = ledgers.select("master_guid", "master_id", "alter_id", "ledger_name", F.explode("bills").alias("b"))
    return rows.filter(S.text(F.col("b.bill_ref")) != "").select("master_guid", "master_id", "alter_id", "ledger_name", F.trim("b.bill_ref").alias("bill_ref"), "b.bill_type", "b.opening_amount", "b.closing_amount")


def standard_rates(items: DataFrame, array: str) -> DataFrame:
    """One row an entry of a price or cost list; all entries are kept."""
    return items.select("master_guid", "master_id", "alter_id", "item_name", F.explode(array).alias("r")).select("master_guid", "master_id", "alter_id", "item_name", "r.effective_date", "r.rate")


def first_rate(rates: Column, fallback: Column) -> Column:
    """The first of an array that isn't 0, else the fallback."""
    return F.coalesce(F.try_element_at(F.filter(F.coalesce(rates, F.array().cast("array<double>")), lambda r: r != 0), F.lit(1)), fallback)


def with_balances(masters: DataFrame, captured: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the balances captured last for each guid, null where there are none.

    ``captured``: master_guid (unique), balances (map of name to amount) and as_of.
    """
    joined = lookup_join(masters, captured, ["master_guid"], "left", salt_by="master_guid")
    return joined.select(*masters.columns, *(F.try_element_at("balances", F.lit(c)).alias(c) for c in columns), F.col("as_of").alias("balance_as_of"))


def bank_ledgers(ledgers: DataFrame) -> DataFrame:
    """The distinct names of ledgers whose group mentions a bank, in any case."""
    return ledgers.filter(S.contains_any(F.col("parent_group"), "bank")).select("ledger_name").distinct()
