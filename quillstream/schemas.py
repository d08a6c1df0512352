"""The 34 ledger datasets: kinds and declared schemas; nothing is ever inferred.

``conformed`` is the projection every dataset goes through before it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

_MASTER = "master_guid string, master_id bigint, alter_id bigint, "
_HEAD = (
    "voucher_date date, voucher_type string, voucher_number string, reference string, narration string, party_name string, guid string, master_id bigint, alter_id bigint, "
    "is_cancelled boolean, is_optional boolean, is_deleted boolean, source_status string, source_last_seen_at string, "
)
_FLAT = _HEAD + "line_index bigint, ledger_name string, amount double, is_deemed_positive boolean"
_CHILD = "voucher_guid string, entry_type string, line_index bigint, voucher_date date, "
_REGISTER = "invoice_date date, invoice_number string, voucher_type string, party_name string, narration string, reference string, guid string, master_id bigint, alter_id bigint, total_amount double, cgst double, sgst double, igst double"

# Names and columns of the datasets as their consumers expect them.
MASTERS = {
    "companies": "company_name string, currency string, books_from date, starting_from date, ending_at date, email string, website string, address string, state string, pincode string, pan string, gstin string",
    "groups": _MASTER + "group_name string, parent string, is_revenue boolean, is_deemed_positive boolean, is_subledger boolean",
    "ledgers": _MASTER
    + "ledger_name string, parent_group string, opening_balance double, closing_balance double, balance_as_of string, gstin string, pan string, state string, country string, address string, pincode string, mobile string, phone string, email string, contact_person string, bank_account_number string, ifsc_code string, bank_name string, branch_name string, is_billwise boolean, is_costcentre boolean",
    "voucher_types": _MASTER + "voucher_type_name string, parent string, alias string, numbering_method string",
    "cost_centres": _MASTER + "cost_centre_name string, parent string, category string",
    "cost_categories": _MASTER + "category_name string",
    "currencies": _MASTER + "currency_name string, symbol string, formal_name string, decimal_places bigint",
    "uom": _MASTER + "uom_name string, original_name string, base_units string, additional_units string, conversion string, is_simple boolean, decimal_places bigint",
    "gst_rates": _MASTER + "item_name string, gst_rate double, hsn_code string, gst_applicable string, supply_type string, tax_classification string",
    "opening_bills": _MASTER + "ledger_name string, bill_ref string, bill_type string, opening_amount double, closing_amount double",
    "stock_groups": _MASTER + "stock_group_name string, parent string",
    "stock_items": _MASTER
    + "item_name string, parent_group string, category string, uom string, opening_qty double, opening_value double, opening_rate double, closing_qty double, closing_value double, closing_rate double, balance_as_of string, gst_rate double, hsn_code string, description string, alias string",
    "godowns": _MASTER + "godown_name string, parent string, address string, has_no_space boolean, has_no_stock boolean",
    "stock_standard_costs": _MASTER + "item_name string, effective_date date, rate double",
    "stock_standard_prices": _MASTER + "item_name string, effective_date date, rate double",
}
VOUCHERS = {
    "vouchers": _FLAT,
    "voucher_headers": _HEAD + "amount double",
    "voucher_lines": _CHILD + "voucher_number string, ledger_name string, amount double, is_deemed_positive boolean",
    "bill_allocations": _CHILD + "voucher_number string, ledger_name string, bill_ref string, bill_type string, amount double",
    "bank_allocations": _CHILD + "voucher_number string, voucher_type string, ledger_name string, transaction_type string, instrument_date date, instrument_number string, bank_name string, amount double, bankers_date date",
    "cost_centre_allocations": _CHILD + "voucher_type string, ledger_name string, cost_centre string, cost_category string, amount double",
    "inventory_entries": _CHILD + "voucher_number string, stock_item string, quantity double, rate double, amount double, godown string",
    "day_book": _FLAT,
    "bank_book": "bank_account string, txn_date date, voucher_type string, voucher_number string, particulars string, debit double, credit double, narration string, cheque_number string, instrument_date date",
    "sales_register": _REGISTER,
    "purchase_register": _REGISTER,
    "sales_invoice_lines": "voucher_guid string, invoice_number string, invoice_date date, stock_item string, quantity double, rate double, amount double, godown string",
    "voucher_guid_manifest": "guid string, voucher_date date, voucher_type string, alter_id bigint, is_cancelled boolean",
}
SNAPSHOTS = {
    "trial_balance": "ledger_name string, closing_debit double, closing_credit double, net_amount double, parent_group string",
    "balance_sheet": "ledger_name string, amount double, parent_group string, category string",
    "profit_loss": "ledger_name string, amount double, parent_group string",
    "stock_summary": "item_name string, stock_group string, opening_qty double, opening_value double, inward_qty double, inward_value double, outward_qty double, outward_value double, closing_qty double, closing_value double",
    "outstanding_payables": "party_name string, parent_group string, amount double",
    "outstanding_receivables": "party_name string, parent_group string, amount double",
}
KINDS = {name: kind for kind, group in (("master", MASTERS), ("voucher", VOUCHERS), ("snapshot", SNAPSHOTS)) for name in group}
AUDIT = "_company string, _sync_timestamp timestamp, _sync_id string"


def schema(dataset: str, audit: bool = False) -> StructType:
    columns = (MASTERS | VOUCHERS | SNAPSHOTS)[dataset]
    return _parse_datatype_string(f"{columns}, {AUDIT}" if audit else columns)


def datasets(kinds: tuple[str, ...] = ("master", "voucher", "snapshot"), without: frozenset[str] = frozenset()) -> list[str]:
    """The datasets of some kinds in their fixed order, but for those switched off."""
    return [d for d, k in KINDS.items() if k in kinds and d not in without]


def conformed(df: DataFrame, dataset: str) -> DataFrame:
    """The dataset's columns in order and type; missing ones are null, others are dropped."""
    return df.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(dataset).fields))


def audited(df: DataFrame, company: str, at: str, sync_id: str) -> DataFrame:
    """With who delivered the rows, when and in which run."""
    return df.withColumns({"_company": F.lit(company), "_sync_timestamp": F.lit(at).cast("timestamp"), "_sync_id": F.lit(sync_id)})
