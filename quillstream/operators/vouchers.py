"""Nested vouchers to the voucher datasets: every output is a projection of one parsed frame.

A voucher row has: guid, master_id, alter_id, voucher_date, voucher_type,
voucher_number, reference, narration, party_name, is_cancelled, is_optional,
amount, seen_at, and the arrays entries, legacy_entries, items, legacy_items.
An entry has ledger_name, amount, is_deemed_positive and the arrays bills
(name, bill_type, amount), banks (transaction_type, instrument_date,
instrument_number, bank_name, amount, bankers_date), costs (name, amount) and
categories (category, costs). An item has stock_item, quantity, rate, amount,
godown and batches (names). Header columns ride along with the unnesting, so no
output joins anything back; only first-wins deduplication and the bank book's
lookup move rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import scalars as S
from quillstream.session import lookup_join

HEADER = ["voucher_date", "voucher_type", "voucher_number", "reference", "narration", "party_name", "guid", "master_id", "alter_id", "is_cancelled", "is_optional", "is_deleted", "source_status", "source_last_seen_at"]


def preferred(first: str, second: str) -> Column:
    """The first array unless it has no element, then the second; never both."""
    return F.when(F.size(F.coalesce(F.col(first), F.array())) > 0, F.col(first)).otherwise(F.col(second))


def screened(v: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """The vouchers of a window, and counts of all rows by what became of them.

    ``invalid_date`` has a date text that is no day, ``out_of_window`` a day
    outside start..end, ``duplicate`` a key that an earlier row had; ``kept``
    are the rest. Needs date_text and doc_order besides the voucher columns.
    """
    day = S.real_day("date_text")
    state = v.withColumn("voucher_date", day).withColumn("fate", F.when(day.isNull(), "invalid_date").when(~day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), "out_of_window"))
    key = S.document_key(F.col("guid"), F.col("voucher_date"), F.col("voucher_type"), F.col("voucher_number"), F.col("master_id"))
    # aggregates, not windows: the rows of a key are combined before they are shuffled
    valid = state.filter("fate is null").withColumn("_key", key)
    kept = valid.groupBy("_key").agg(F.min_by(F.struct(*(c for c in state.columns if c != "fate")), "doc_order").alias("_v")).select("_v.*")
    once = valid.groupBy("_key").agg(F.count("*").alias("n")).agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"))
    fates = once.select(F.inline(F.array(*(F.struct(F.lit(f).alias("fate"), F.col(f).alias("vouchers")) for f in ("kept", "duplicate"))))).filter("vouchers > 0")
    return kept, fates.unionByName(state.filter("fate is not null").groupBy("fate").agg(F.count("*").alias("vouchers")))


def headers(v: DataFrame) -> DataFrame:
    status = S.lifecycle(F.col("is_cancelled"), F.col("is_optional"))
    full = v.withColumn("is_deleted", F.lit(False)).withColumn("source_status", status).withColumn("source_last_seen_at", F.col("seen_at"))
    return full.select(*HEADER, "amount")


def _entries(v: DataFrame) -> DataFrame:
    return v.withColumn("used", preferred("entries", "legacy_entries")).drop("entries", "legacy_entries", "items", "legacy_items")


def _unnested(v: DataFrame, keys: list, array: Column, name: str) -> DataFrame:
    """One row an element of ``array``, with its place as line_index.

    The outer form, whose row for an empty array is dropped: for the inner one
    the optimizer infers a filter on the array's size and computes it twice.
    """
    return v.select(*keys, F.posexplode_outer(array).alias("line_index", name)).filter("line_index is not null")


def flat(v: DataFrame) -> DataFrame:
    """One row a ledger line with all header columns: the vouchers dataset, and the day book."""
    full = _entries(v).withColumn("is_deleted", F.lit(False)).withColumn("source_status", S.lifecycle(F.col("is_cancelled"), F.col("is_optional"))).withColumn("source_last_seen_at", F.col("seen_at"))
    lines = _unnested(full, HEADER, F.col("used"), "e")
    return lines.select(*HEADER, F.col("line_index").cast("long").alias("line_index"), "e.ledger_name", "e.amount", "e.is_deemed_positive")


def lines(v: DataFrame) -> DataFrame:
    out = _unnested(_entries(v), ["guid", "voucher_date", "voucher_number"], F.col("used"), "e")
    return out.select(F.col("guid").alias("voucher_guid"), F.lit("ledger").alias("entry_type"), F.col("line_index").cast("long").alias("line_index"), "voucher_date", "voucher_number", "e.ledger_name", "e.amount", "e.is_deemed_positive")


def _children(v: DataFrame, array: Column, kind: str, columns: list[str]) -> DataFrame:
    """Numbers the children of a voucher through all its lines, from 0."""
    keys = [F.col("guid").alias("voucher_guid"), F.lit(kind).alias("entry_type"), "voucher_date", "voucher_number", "voucher_type"]
    out = _unnested(_entries(v), keys, array, "c")
    return out.select("voucher_guid", "entry_type", F.col("line_index").cast("long").alias("line_index"), "voucher_date", *columns)


def _with_ledger(entry: Column, child: str) -> Column:
    return F.transform(F.coalesce(entry[child], F.array()), lambda c: F.struct(entry["ledger_name"].alias("ledger_name"), c.alias("x")))


def bill_allocations(v: DataFrame) -> DataFrame:
    array = F.flatten(F.transform("used", lambda e: _with_ledger(e, "bills")))
    return _children(v, array, "bill_allocation", ["voucher_number", "c.ledger_name", F.col("c.x.name").alias("bill_ref"), "c.x.bill_type", "c.x.amount"])


def bank_allocations(v: DataFrame) -> DataFrame:
    array = F.flatten(F.transform("used", lambda e: _with_ledger(e, "banks")))
    return _children(v, array, "bank_allocation", ["voucher_number", "voucher_type", "c.ledger_name", "c.x.transaction_type", "c.x.instrument_date", "c.x.instrument_number", "c.x.bank_name", "c.x.amount", "c.x.bankers_date"])


def cost_centre_allocations(v: DataFrame) -> DataFrame:
    """Direct allocations of a line come before those in categories; blank names are left out before numbering."""

    def of(e: Column) -> Column:
        made = lambda category: lambda c: F.struct(e["ledger_name"].alias("ledger_name"), category.alias("category"), c["name"].alias("name"), c["amount"].alias("amount"))
        direct = F.transform(F.coalesce(e["costs"], F.array()), made(F.lit("")))
        nested = F.flatten(F.transform(F.coalesce(e["categories"], F.array()), lambda g: F.transform(F.coalesce(g["costs"], F.array()), made(g["category"]))))
        return F.concat(direct, nested)

    array = F.filter(F.flatten(F.transform("used", of)), lambda c: S.text(c["name"]) != "")
    return _children(v, array, "cost_centre_allocation", ["voucher_type", "c.ledger_name", F.col("c.name").alias("cost_centre"), F.col("c.category").alias("cost_category"), "c.amount"])


def inventory_entries(v: DataFrame) -> DataFrame:
    """Items with a blank name are left out before numbering; the godown is the first named by a batch, else the item's own."""
    items = F.filter(F.coalesce(preferred("items", "legacy_items"), F.array()), lambda i: S.text(i["stock_item"]) != "")
    keys = [F.col("guid").alias("voucher_guid"), F.lit("inventory").alias("entry_type"), "voucher_date", "voucher_number", "voucher_type"]
    out = _unnested(v, keys, items, "i")
    first_batch = F.try_element_at(F.filter(F.coalesce("i.batches", F.array()), lambda b: S.text(b) != ""), F.lit(1))
    return out.select("voucher_guid", "entry_type", F.col("line_index").cast("long").alias("line_index"), "voucher_date", "voucher_number", "i.stock_item", "i.quantity", "i.rate", "i.amount", S.first_text(first_batch, F.col("i.godown")).alias("godown"), "voucher_type")


def invoice_lines(v: DataFrame) -> DataFrame:
    sold = inventory_entries(v.filter(S.register(F.col("voucher_type")) == "sales"))
    return sold.select("voucher_guid", F.col("voucher_number").alias("invoice_number"), F.col("voucher_date").alias("invoice_date"), "stock_item", "quantity", "rate", "amount", "godown")


def bank_book(v: DataFrame, banks: DataFrame) -> DataFrame:
    """Lines on ledgers of ``banks`` (column ledger_name, exact case); positive amounts are debits."""
    out = _unnested(_entries(v), ["voucher_date", "voucher_type", "voucher_number", "party_name", "narration", "guid"], F.col("used"), "e")
    rows = out.select("*", F.col("e.ledger_name").alias("ledger_name")).withColumn("bank", F.try_element_at("e.banks", F.lit(1)))
    mine = lookup_join(rows, banks.select("ledger_name").distinct(), ["ledger_name"], "left_semi", salt_by="guid")
    amount = F.col("e.amount")
    return mine.select(
        F.col("ledger_name").alias("bank_account"), F.col("voucher_date").alias("txn_date"), "voucher_type", "voucher_number", S.first_text(F.col("party_name"), F.col("narration")).alias("particulars"),
        S.positive_part(amount).alias("debit"), S.negative_part(amount).alias("credit"), "narration", S.text(F.col("bank.instrument_number")).alias("cheque_number"), F.col("bank.instrument_date").alias("instrument_date"),
    )


def register(v: DataFrame, kind: str) -> DataFrame:
    """The sales or purchase register: totals and taxes of each voucher, whatever its lifecycle.

    Taxes are summed inside the row, over the array of lines; nothing is shuffled.
    """
    zero = F.lit(0).cast("decimal(28,2)")

    def tax(head: str) -> Column:
        lines_of = F.coalesce("used", F.array())
        return F.aggregate(lines_of, zero, lambda a, e: (a + F.when(S.tax_head(e["ledger_name"]) == head, F.abs(e["amount"]).cast("decimal(18,2)")).otherwise(0)).cast("decimal(28,2)")).cast("double").alias(head)

    chosen = _entries(v.filter(S.register(F.col("voucher_type")) == kind))
    return chosen.select(
        F.col("voucher_date").alias("invoice_date"), F.col("voucher_number").alias("invoice_number"), "voucher_type", "party_name", "narration", "reference", "guid", "master_id", "alter_id",
        F.abs("amount").alias("total_amount"), tax("cgst"), tax("sgst"), tax("igst"),
    )


def manifest(v: DataFrame) -> DataFrame:
    return v.select("guid", "voucher_date", "voucher_type", "alter_id", "is_cancelled")


def extents(v: DataFrame, *by: str) -> DataFrame:
    return v.groupBy(*by).agg(F.count("*").alias("vouchers"), F.min("voucher_date").alias("first_date"), F.max("voucher_date").alias("last_date"))


def fan_out(v: DataFrame, banks: DataFrame) -> dict[str, DataFrame]:
    """All voucher datasets of one parsed frame, which the caller keeps or persists."""
    return {
        "vouchers": flat(v), "voucher_headers": headers(v), "voucher_lines": lines(v), "bill_allocations": bill_allocations(v), "bank_allocations": bank_allocations(v),
        "cost_centre_allocations": cost_centre_allocations(v), "inventory_entries": inventory_entries(v).drop("voucher_type"), "day_book": flat(v), "bank_book": bank_book(v, banks),
        "sales_register": register(v, "sales"), "purchase_register": register(v, "purchase"), "sales_invoice_lines": invoice_lines(v), "voucher_guid_manifest": manifest(v),
    }
