"""Documents and files built from whole tables, read back by the sources, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstream.functions import scalars as S
from quillstream.operators import vouchers as V
from quillstream.plans import voucher_queries
from quillstream.sources import masters, ndjson, xml
from quillstream.session import shared_dir, stored, table


def _element(tag, fields, name=None):
    """An element as text: its fields in children that alternate in case; the name may be an attribute."""
    esc = lambda c: S.xml_escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    children = [F.concat(F.lit(f"<{t if k % 2 else t.lower()}>"), esc(c), F.lit(f"</{t if k % 2 else t.lower()}>")) for k, (c, t) in enumerate(fields.items())]
    attribute = F.concat(F.lit(' NAME="'), esc(name), F.lit('"')) if name else F.lit("")
    return F.concat(F.lit(f"<Envelope><BODY><x:{tag.title()} xmlns:x='y'"), attribute, F.lit(">"), *children, F.lit(f"</x:{tag.title()}></BODY></Envelope>"))


def _read(spark, d, name, tag, fields, by_attribute=None, balances=True):
    t = table(spark, d, name)
    docs = t.select(F.lit("doc").alias("path"), _element(tag, fields, by_attribute).alias("text"))
    return masters.masters(docs.withColumn("text", xml.cleaned(F.col("text"))), name, balances).select("master_guid", "master_id", "alter_id", *(c for c in list(fields) + ([by_attribute] if by_attribute else []) if c not in ("master_guid", "master_id", "alter_id")))


_MARKS = {"master_guid": "GUID", "master_id": "MASTERID", "alter_id": "ALTERID"}
_CENTRES = _MARKS | {"cost_centre_name": "NAME", "parent": "PARENT", "category": "CATEGORY"}
_TYPES = _MARKS | {"parent": "PARENT", "alias": "ADDITIONALNAME", "numbering_method": "NUMBERINGMETHOD"}
_LEDGERS = _MARKS | {"ledger_name": "NAME", "parent_group": "PARENT", "opening_balance": "OPENINGBALANCE", "closing_balance": "CLOSINGBALANCE", "gstin": "PARTYGSTIN", "state": "LEDSTATENAME", "is_billwise": "ISBILLWISEON"}


def xml_cost_centres(spark, d):
    """Every cost centre as an element of a document, read back."""
    return _read(spark, d, "cost_centres", "COSTCENTRE", _CENTRES)


def xml_voucher_types(spark, d):
    """Every voucher type, its name an attribute."""
    return _read(spark, d, "voucher_types", "VOUCHERTYPE", _TYPES, "voucher_type_name")


def xml_ledgers(spark, d):
    """Every ledger with its balances and flags."""
    return _read(spark, d, "ledgers", "LEDGER", _LEDGERS)


def xml_ledgers_off_cycle(spark, d):
    """The same in a cycle that asks for no balances."""
    return _read(spark, d, "ledgers", "LEDGER", _LEDGERS, balances=False).select("master_guid", "ledger_name", "opening_balance", "closing_balance")


def _text_sql(c):
    return f"coalesce(trim({c}, ' ' || chr(9)), '') AS {c}"


def _marks_sql():
    return f"{_text_sql('master_guid')}, coalesce(master_id, 0) AS master_id, coalesce(alter_id, 0) AS alter_id"


def named_report(spark, d):
    """Every customer's report of a name and an amount, read from its document; every fifth has no amount node."""
    c = table(spark, d, "customer")
    amount = F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("<dspaccinfo><DspClDrAmt><DSPCLDRA>"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("</DSPCLDRA></DspClDrAmt></dspaccinfo>")))
    text = F.concat(F.lit("<ENVELOPE><DSPACCNAME><DspDispName> "), S.xml_escaped(F.concat(F.col("c_name"), F.lit(" & sons"))), F.lit("</DspDispName></DSPACCNAME>"), amount, F.lit("</ENVELOPE>"))
    docs = c.select(F.col("c_custkey").cast("string").alias("path"), text.alias("text"))
    return masters.named_report(docs).select(F.col("report").cast("bigint").alias("c_custkey"), "name", "amount")


def _items(spark, d):
    """Every part as a stock item with lists of costs and tax details; some details are missing, some rates 0."""
    p = table(spark, d, "part")
    n = lambda x: F.expr(x).cast("string")
    detail = F.concat(F.lit("<GstDetails.List><HSN>"), n("p_size"), F.lit("</HSN><TAXABILITY/><RateDetails.List><GSTRATE>0</GSTRATE></RateDetails.List><RATEDETAILS.LIST><GSTRATE> "), n("p_size % 5"), F.lit(" %</GSTRATE></RATEDETAILS.LIST></GstDetails.List>"))
    costs = F.concat(F.lit("<StandardCostList.List><DATE>20240229</DATE><RATE>"), n("p_size"), F.lit("/nos</RATE></StandardCostList.List><STANDARDCOSTLIST.LIST><DATE>20240230</DATE></STANDARDCOSTLIST.LIST>"))
    text = F.concat(F.lit("<a><StockItem><GUID>g"), n("p_partkey"), F.lit("</GUID><name>"), S.xml_escaped(F.col("p_name")), F.lit("</name><GSTRATE>12</GSTRATE><GSTAPPLICABLE>Yes</GSTAPPLICABLE><HSNCODE>own</HSNCODE>"), F.when(F.col("p_partkey") % 3 > 0, detail).otherwise(""), costs, F.lit("</StockItem></a>"))
    return p.select(F.lit("doc").alias("path"), text.alias("text"))


def xml_standard_costs(spark, d):
    out = masters.standard_rates(_items(spark, d), "COST")
    return out.select("master_guid", "item_name", F.date_format("effective_date", "yyyy-MM-dd").alias("effective_date"), "rate")


def xml_gst_rates(spark, d):
    return masters.gst_rates(_items(spark, d)).select("master_guid", "item_name", "gst_rate", "hsn_code", "gst_applicable", "supply_type")


def xml_opening_bills(spark, d):
    """Every customer as a ledger with two bills, one of which has a blank reference for every third."""
    c = table(spark, d, "customer")
    n = lambda x: F.expr(x).cast("string")
    bill = lambda ref: F.concat(F.lit("<BillAllocations.List><NAME>"), ref, F.lit("</NAME><BILLTYPE>New Ref</BILLTYPE><OPENINGBALANCE>"), n("cast(c_acctbal as decimal(18,2))"), F.lit("</OPENINGBALANCE></BillAllocations.List>"))
    text = F.concat(F.lit("<a><LEDGER NAME='"), F.col("c_name"), F.lit("'><MASTERID> "), n("c_custkey"), F.lit("</MASTERID>"), bill(F.concat(F.lit("B-"), n("c_custkey"))), bill(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise("C")), F.lit("</LEDGER></a>"))
    return masters.opening_bills(c.select(F.lit("doc").alias("path"), text.alias("text"))).select("master_id", "ledger_name", "bill_ref", "bill_type", "opening_amount", "closing_amount")


def batch_files(spark, d):
    """Orders as batches of 500, sealed into files: records, the digest's length and whether bytes were written."""
    o = table(spark, d, "orders").withColumn("slice_no", F.floor(F.col("o_orderkey") / 500))
    root = f"{shared_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex}"
    sealed = ndjson.sealed(o, "slice_no", root)
    back = ndjson.read(spark, root, o.drop("slice_no").schema).groupBy("slice_no").agg(F.count("*").alias("read_back"))
    return sealed.join(back.select(F.col("slice_no").cast("long").alias("slice_no"), "read_back"), "slice_no").select("slice_no", "record_count", "read_back", F.length("checksum_sha256").cast("long").alias("digits"), (F.col("payload_bytes") > 0).alias("written"))


def voucher_datasets(spark, d):
    """The thirteen voucher datasets of one parse, which is kept, with their rows."""
    kept = stored(voucher_queries.nested(spark, d), "vouchers")
    banks = table(spark, d, "part").limit(0).select(F.col("p_name").alias("ledger_name"))
    banks = banks.unionByName(kept.select(F.explode(F.concat("entries", F.coalesce("legacy_entries", F.array()))).alias("e")).select("e.ledger_name").filter(S.contains_any(F.col("ledger_name"), "cgst", "igst")).distinct())
    counts = [f.agg(F.count("*").alias("rows")).select(F.lit(n).alias("dataset"), "rows") for n, f in V.fan_out(kept, banks).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def queries():
    made = [xml_cost_centres, xml_voucher_types, xml_ledgers, xml_ledgers_off_cycle, named_report, xml_standard_costs, xml_gst_rates, xml_opening_bills, batch_files, voucher_datasets]
    return {f.__name__: f for f in made}


def oracle_sql():
    v = voucher_queries.oracle_sql()
    names = {"vouchers": "vouchers_flat", "voucher_guid_manifest": "guid_manifest"}
    sets = ["vouchers", "voucher_headers", "voucher_lines", "bill_allocations", "bank_allocations", "cost_centre_allocations", "inventory_entries", "day_book", "bank_book", "sales_register", "purchase_register", "sales_invoice_lines", "voucher_guid_manifest"]
    led = f"{_marks_sql()}, {_text_sql('ledger_name')}, {_text_sql('parent_group')}, coalesce(opening_balance, 0) AS opening_balance, coalesce(closing_balance, 0) AS closing_balance, {_text_sql('gstin')}, {_text_sql('state')}, coalesce(is_billwise, false) AS is_billwise"
    named = "trim(coalesce({}, ''), ' ' || chr(9)) <> ''"
    return {
        "xml_cost_centres": f"SELECT {_marks_sql()}, {_text_sql('cost_centre_name')}, {_text_sql('parent')}, {_text_sql('category')} FROM cost_centres WHERE {named.format('cost_centre_name')}",
        "xml_voucher_types": f"SELECT {_marks_sql()}, {_text_sql('parent')}, {_text_sql('alias')}, {_text_sql('numbering_method')}, {_text_sql('voucher_type_name')} FROM voucher_types WHERE {named.format('voucher_type_name')}",
        "xml_ledgers": f"SELECT {led} FROM ledgers WHERE {named.format('ledger_name')}",
        "xml_ledgers_off_cycle": f"SELECT {_text_sql('master_guid')}, {_text_sql('ledger_name')}, CAST(NULL AS DOUBLE) AS opening_balance, CAST(NULL AS DOUBLE) AS closing_balance FROM ledgers WHERE {named.format('ledger_name')}",
        "named_report": "SELECT c_custkey, c_name || ' & sons' AS name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM customer WHERE c_custkey % 5 <> 0",
        "xml_standard_costs": "SELECT 'g' || p_partkey AS master_guid, p_name AS item_name, d AS effective_date, CASE WHEN d IS NULL THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS rate FROM part, (VALUES ('2024-02-29'), (NULL)) AS t(d)",
        "xml_gst_rates": "SELECT 'g' || p_partkey AS master_guid, p_name AS item_name, CAST(CASE WHEN p_partkey % 3 > 0 AND p_size % 5 <> 0 THEN p_size % 5 ELSE 12 END AS DOUBLE) AS gst_rate, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS VARCHAR) ELSE 'own' END AS hsn_code, 'Yes' AS gst_applicable, '' AS supply_type FROM part",
        "xml_opening_bills": "SELECT c_custkey AS master_id, c_name AS ledger_name, CASE k WHEN 0 THEN 'B-' || c_custkey ELSE 'C' END AS bill_ref, 'New Ref' AS bill_type, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS opening_amount, CAST(0 AS DOUBLE) AS closing_amount FROM customer, (VALUES (0), (1)) AS t(k) WHERE k = 0 OR c_custkey % 3 <> 0",
        "batch_files": "SELECT o_orderkey // 500 AS slice_no, count(*) AS record_count, count(*) AS read_back, CAST(64 AS BIGINT) AS digits, true AS written FROM orders GROUP BY 1",
        "voucher_datasets": " UNION ALL ".join(f"SELECT '{s}' AS dataset, count(*) AS rows FROM ({v[names.get(s, s)]})" for s in sets),
    }
