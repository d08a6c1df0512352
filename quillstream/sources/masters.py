"""Master records and named reports from XML exports, at any depth and in any case of their tags.

An element is cut out of its document as text, wherever it lies and however its
tag is written, and parsed by itself with a declared schema: one row an element,
so that a large document is spread over its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.functions import scalars as S
from quillstream.operators import masters as M
from quillstream.operators import reports
from quillstream.sources.xml import first

# Elements of the export format and their fields, by dataset; fields of one name everywhere come first.
_EVERYWHERE = {"master_guid": "GUID", "master_id": "MASTERID", "alter_id": "ALTERID", "parent": "PARENT", "parent_group": "PARENT", "category": "CATEGORY", "alias": "ADDITIONALNAME", "address": "ADDRESS", "email": "EMAIL", "pincode": "PINCODE", "pan": "INCOMETAXNUMBER", "decimal_places": "DECIMALPLACES"}
_NAMED = {"companies": "company_name", "groups": "group_name", "ledgers": "ledger_name", "voucher_types": "voucher_type_name", "cost_centres": "cost_centre_name", "cost_categories": "category_name", "currencies": "currency_name", "uom": "uom_name", "stock_groups": "stock_group_name", "stock_items": "item_name", "godowns": "godown_name"}
ELEMENTS = {"companies": "COMPANY", "groups": "GROUP", "ledgers": "LEDGER", "voucher_types": "VOUCHERTYPE", "cost_centres": "COSTCENTRE", "cost_categories": "COSTCATEGORY", "currencies": "CURRENCY", "uom": "UNIT", "stock_groups": "STOCKGROUP", "stock_items": "STOCKITEM", "godowns": "GODOWN"}
_FIELDS = {
    "companies": {"currency": "BASICCURRENCYNAME", "books_from": "BOOKSFROM", "starting_from": "STARTINGFROM", "ending_at": "ENDINGAT", "website": "WEBSITE", "state": "STATENAME", "gstin": "GSTREGISTRATIONNUMBER"},
    "groups": {"is_revenue": "ISREVENUE", "is_deemed_positive": "ISDEEMEDPOSITIVE", "is_subledger": "ISSUBLEDGER"},
    "ledgers": {"opening_balance": "OPENINGBALANCE", "closing_balance": "CLOSINGBALANCE", "gstin": "PARTYGSTIN", "state": "LEDSTATENAME", "country": "COUNTRYNAME", "mobile": "LEDGERMOBILE", "phone": "LEDGERPHONE", "contact_person": "LEDGERCONTACT", "bank_account_number": "BANKACCOUNTNUMBER", "ifsc_code": "IFSCODE", "bank_name": "BANKNAME", "branch_name": "BRANCHNAME", "is_billwise": "ISBILLWISEON", "is_costcentre": "ISCOSTCENTRESON"},
    "voucher_types": {"numbering_method": "NUMBERINGMETHOD"},
    "currencies": {"symbol": "EXPANDEDSYMBOL", "formal_name": "MAILINGNAME"},
    "uom": {"original_name": "ORIGINALNAME", "base_units": "BASEUNITS", "additional_units": "ADDITIONALUNITS", "conversion": "CONVERSION", "is_simple": "ISSIMPLEUNIT"},
    "stock_items": {"uom": "BASEUNITS", "opening_qty": "OPENINGBALANCE", "opening_value": "OPENINGVALUE", "opening_rate": "OPENINGRATE", "closing_qty": "CLOSINGBALANCE", "closing_value": "CLOSINGVALUE", "closing_rate": "CLOSINGRATE", "gst_rate": "GSTRATE", "hsn_code": "HSNCODE", "description": "DESCRIPTION"},
    "godowns": {"has_no_space": "HASNOSPACE", "has_no_stock": "HASNOSTOCK"},
}
#: Balances, which are null where a cycle didn't ask for them; see ``operators.masters.with_balances``.
_BALANCES = {"opening_balance", "closing_balance", "closing_qty", "closing_value", "closing_rate"}


def elements(docs: DataFrame, tag: str) -> DataFrame:
    """path, ord (from 0) and element, a row for each element of that local name, at any depth and in any case.

    ``docs``: path and text (see ``xml.documents``). An element within one of
    the same name belongs to it; what isn't closed gives nothing.
    """
    one = rf"(?is)<((?:[\w.-]+:)?{tag}(?=[\s>])[^<>]*>.*?)</(?:[\w.-]+:)?{tag}\s*>"
    return docs.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(one), F.lit(1))).alias("ord", "inner")).select("path", F.col("ord").cast("long").alias("ord"), F.concat(F.lit("<"), F.regexp_replace("inner", rf"(?is)^(?:[\w.-]+:)?{tag}", "ROW"), F.lit("</ROW>")).alias("element"))


def leaves(docs: DataFrame) -> DataFrame:
    """path, ord (from 0), tag (its local name in capitals) and value of each element without children, in the order of the document."""
    leaf = r"(?s)<(?:[\w.-]+:)?([\w.-]+)(?:\s[^<>]*)?(?<!/)>([^<>]*)</(?:[\w.-]+:)?\1\s*>"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(leaf), F.lit(1)).alias("tag"), F.regexp_extract_all("text", F.lit(leaf), F.lit(2)).alias("value"))
    return docs.select("path", F.posexplode(both).alias("ord", "x")).select("path", F.col("ord").cast("long").alias("ord"), F.upper("x.tag").alias("tag"), unescaped(F.col("x.value")).alias("value"))


def unescaped(c: Column) -> Column:
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


def masters(docs: DataFrame, dataset: str, balances: bool = True) -> DataFrame:
    """The columns of a master dataset, a row an element; those with a blank name are left out, but for companies.

    The name is a child or an attribute. Missing texts are empty, missing
    numbers 0, missing flags false, missing days null; so are balances without
    ``balances``, which keep their columns.
    """
    tags = {c: t for c, t in _EVERYWHERE.items()} | _FIELDS.get(dataset, {}) | {_NAMED[dataset]: "NAME"}
    fields = [f for f in schemas.schema(dataset).fields if f.name in tags]
    names = ", ".join(f"`{t}`: array<string>" for t in sorted({tags[f.name] for f in fields}))
    rows = elements(docs, ELEMENTS[dataset]).select(F.from_xml("element", f"struct<_NAME: string, {names}>", {"mode": "PERMISSIVE", "rowTag": "ROW"}).alias("m"))

    def column(f) -> Column:
        of, kind = first(F.col("m")[tags[f.name]]), f.dataType.typeName()
        if tags[f.name] == "NAME":
            return S.first_text(of, F.col("m._NAME")).alias(f.name)
        if f.name in _BALANCES and not balances:
            return F.lit(None).cast(f.dataType).alias(f.name)
        return {"string": lambda: of, "double": lambda: S.number(of), "long": lambda: S.integer(of), "boolean": lambda: S.flag(of), "date": lambda: S.real_day(of)}[kind]().alias(f.name)

    read = rows.select(*map(column, fields))
    return schemas.conformed(read if dataset == "companies" else read.filter(F.col(_NAMED[dataset]) != ""), dataset)


def _nested(docs: DataFrame, tag: str, scalars: list[str], lists: dict[str, str]) -> DataFrame:
    """m: an element's scalars (arrays of texts) and lists (arrays of what their schema says)."""
    fields = ", ".join([f"`{t}`: array<string>" for t in ["GUID", "MASTERID", "ALTERID", "NAME", *scalars]] + [f"`{t}`: array<{k}>" for t, k in lists.items()])
    return elements(docs, tag).select(F.from_xml("element", f"struct<_NAME: string, {fields}>", {"mode": "PERMISSIVE", "rowTag": "ROW"}).alias("m"))


def _identity(name: str) -> list[Column]:
    of = lambda t: first(F.col("m")[t])
    return [of("GUID").alias("master_guid"), S.integer(of("MASTERID")).alias("master_id"), S.integer(of("ALTERID")).alias("alter_id"), S.first_text(of("NAME"), F.col("m._NAME")).alias(name)]


def _struct(*tags: str) -> str:
    return "struct<" + ", ".join(f"`{t}`: array<string>" for t in tags) + ">"


def opening_bills(docs: DataFrame) -> DataFrame:
    """The bills that ledgers open with, a row each (see ``operators.masters.opening_bills``)."""
    rows = _nested(docs, "LEDGER", [], {"BILLALLOCATIONS.LIST": _struct("NAME", "BILLTYPE", "OPENINGBALANCE", "CLOSINGBALANCE")})
    bill = lambda b: F.struct(first(b["NAME"]).alias("bill_ref"), first(b["BILLTYPE"]).alias("bill_type"), S.number(first(b["OPENINGBALANCE"])).alias("opening_amount"), S.number(first(b["CLOSINGBALANCE"])).alias("closing_amount"))
    return M.opening_bills(rows.select(*_identity("ledger_name"), F.transform(F.col("m")["BILLALLOCATIONS.LIST"], bill).alias("bills")))


def standard_rates(docs: DataFrame, kind: str) -> DataFrame:
    """The standard costs or prices (``kind`` COST or PRICE) of stock items by day, a row an entry."""
    tag = f"STANDARD{kind}LIST.LIST"
    rows = _nested(docs, "STOCKITEM", [], {tag: _struct("DATE", "RATE")})
    rate = lambda r: F.struct(S.real_day(first(r["DATE"])).alias("effective_date"), S.number(first(r["RATE"])).alias("rate"))
    return M.standard_rates(rows.select(*_identity("item_name"), F.transform(F.col("m")[tag], rate).alias("rates")), "rates")


def gst_rates(docs: DataFrame) -> DataFrame:
    """The tax of each stock item with a name: from its first list of details, else from the item itself."""
    own = ["HSNCODE", "GSTRATE", "GSTAPPLICABLE", "GSTTYPEOFSUPPLY", "TAXCLASSIFICATIONNAME"]
    rate = "array<struct<`GSTRATE`: array<string>>>"
    detail = _struct("HSNCODE", "HSN", "TAXABILITY", "GSTAPPLICABLE", "GSTTYPEOFSUPPLY", "TAXCLASSIFICATIONNAME")[:-1] + f", `RATEDETAILS.LIST`: {rate}, `RATEDETAILS`: {rate}>"
    rows = _nested(docs, "STOCKITEM", own, {"GSTDETAILS.LIST": detail, "GSTDETAILS": detail})
    d, item = F.coalesce(F.try_element_at(F.col("m")["GSTDETAILS.LIST"], F.lit(1)), F.try_element_at(F.col("m")["GSTDETAILS"], F.lit(1))), lambda t: first(F.col("m")[t])
    of = lambda t: first(d[t])
    none = F.array().cast(rate)
    rates = F.transform(F.concat(F.coalesce(d["RATEDETAILS.LIST"], none), F.coalesce(d["RATEDETAILS"], none)), lambda r: S.number(first(r["GSTRATE"])))
    out = rows.select(
        *_identity("item_name"), M.first_rate(rates, S.number(item("GSTRATE"))).alias("gst_rate"), S.first_text(of("HSNCODE"), of("HSN"), item("HSNCODE")).alias("hsn_code"),
        S.first_text(of("TAXABILITY"), of("GSTAPPLICABLE"), item("GSTAPPLICABLE")).alias("gst_applicable"), S.first_text(of("GSTTYPEOFSUPPLY"), item("GSTTYPEOFSUPPLY")).alias("supply_type"), S.first_text(of("TAXCLASSIFICATIONNAME"), item("TAXCLASSIFICATIONNAME")).alias("tax_classification"),
    )
    return out.filter("item_name <> ''")


# The nodes of a named report that hold a name, and those that hold its amount.
REPORT_NAMES, REPORT_AMOUNTS = ("DSPDISPNAME", "DSPACCNAME", "BSNAME", "PLNAME"), ("DSPCLDRAMTA", "DSPCLDRA", "DSPCLCRA", "BSMAINAMT", "PLMAINAMT")


def named_report(docs: DataFrame, names: tuple[str, ...] = REPORT_NAMES, amounts: tuple[str, ...] = REPORT_AMOUNTS) -> DataFrame:
    """report, ord, name, amount of reports of alternating name and amount nodes, at any depth (see ``reports.pair_walk``)."""
    tag = F.when(F.col("tag").isin(*names), "name").when(F.col("tag").isin(*amounts), "amount")
    return reports.pair_walk(leaves(docs).select(F.col("path").alias("report"), "ord", tag.alias("tag"), "value").filter("tag is not null"))
