"""XML exports: bytes to clean text to nested vouchers.

One illegal character would make the XML reader drop every row of a file, so
documents are read as bytes, decoded by their byte order mark, cleaned and
parsed with a declared schema. Of a repeated scalar element the first counts,
so scalars are declared as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import scalars as S

_ILLEGAL_ENTITY = r"(?i)&#(?:x0*(?:[0-8bcef]|1[0-9a-f]|fff[ef])|0*(?:[0-8]|1[124-9]|2[0-9]|3[01]|6553[45]));"
_ILLEGAL_CHARACTER = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"
#: Bytes of a document at most; larger ones go to the rejects.
MOST_BYTES = 256 * 1024 * 1024


def documents(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """path and text of each file, and the paths and lengths of those that are too large, which aren't read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= most_bytes).select("path", cleaned(decoded(F.col("content"))).alias("text"))
    return small, files.filter(F.col("length") > most_bytes).select("path", "length")


def decoded(content: Column) -> Column:
    """UTF-16 by its byte order mark, else UTF-8; the mark is taken off, malformed bytes are replaced."""
    mark = F.hex(F.substring(content, 1, 3))
    wide = F.when(mark.startswith("FFFE"), F.decode(content, "UTF-16LE")).when(mark.startswith("FEFF"), F.decode(content, "UTF-16BE"))
    return F.regexp_replace(F.coalesce(wide, F.make_valid_utf8(content.cast("string"))), "^﻿", "")


def cleaned(text: Column) -> Column:
    """Without characters that XML doesn't allow, written out or as numeric entities."""
    return F.regexp_replace(F.regexp_replace(text, _ILLEGAL_ENTITY, ""), _ILLEGAL_CHARACTER, "")


def _scalars(*names: str) -> str:
    return ", ".join(f"`{n}`: array<string>" for n in names)


_BILL = f"struct<{_scalars('NAME', 'BILLTYPE', 'AMOUNT')}>"
_BANK = f"struct<{_scalars('TRANSACTIONTYPE', 'INSTRUMENTDATE', 'INSTRUMENTNUMBER', 'BANKNAME', 'AMOUNT', 'BANKERSDATE')}>"
_COST = f"struct<{_scalars('NAME', 'AMOUNT')}>"
_ENTRY = f"struct<{_scalars('LEDGERNAME', 'AMOUNT', 'ISDEEMEDPOSITIVE')}, `BILLALLOCATIONS.LIST`: array<{_BILL}>, `BANKALLOCATIONS.LIST`: array<{_BANK}>, `COSTCENTREALLOCATIONS.LIST`: array<{_COST}>, `CATEGORYALLOCATIONS.LIST`: array<struct<{_scalars('CATEGORY')}, `COSTCENTREALLOCATIONS.LIST`: array<{_COST}>>>>"
_ITEM = f"struct<{_scalars('STOCKITEMNAME', 'ACTUALQTY', 'RATE', 'AMOUNT', 'GODOWNNAME')}, `BATCHALLOCATIONS.LIST`: array<struct<{_scalars('GODOWNNAME')}>>>"
_VOUCHER = (
    f"struct<{_scalars('DATE', 'VOUCHERTYPENAME', 'VOUCHERNUMBER', 'REFERENCE', 'NARRATION', 'PARTYLEDGERNAME', 'GUID', 'MASTERID', 'ALTERID', 'ISCANCELLED', 'ISOPTIONAL', 'AMOUNT')}, "
    f"`ALLLEDGERENTRIES.LIST`: array<{_ENTRY}>, `LEDGERENTRIES.LIST`: array<{_ENTRY}>, `ALLINVENTORYENTRIES.LIST`: array<{_ITEM}>, `INVENTORYENTRIES.LIST`: array<{_ITEM}>>"
)


def first(of: Column) -> Column:
    """The first of a repeated scalar, trimmed; empty if missing."""
    return S.text(F.try_element_at(of, F.lit(1)))


def vouchers(docs: DataFrame, tag: str = "VOUCHER") -> DataFrame:
    """Documents (path, text) to the nested vouchers that the voucher operators take.

    doc_order is the place in its document; date_text the date as written. A
    document that doesn't parse gives nothing. Missing texts are empty, missing
    numbers 0.
    """
    parsed = docs.select("path", F.from_xml("text", f"struct<`{tag}`: array<{_VOUCHER}>>", {"mode": "PERMISSIVE"}).alias("doc"))
    rows = parsed.select("path", F.posexplode(F.col("doc")[tag]).alias("doc_order", "v")).filter("v is not null")

    def each(array: Column, make) -> Column:
        return F.transform(F.coalesce(array, F.array()), make)

    cost = lambda c: F.struct(first(c["NAME"]).alias("name"), S.number(first(c["AMOUNT"])).alias("amount"))

    def entry(e: Column) -> Column:
        return F.struct(
            first(e["LEDGERNAME"]).alias("ledger_name"), S.number(first(e["AMOUNT"])).alias("amount"), S.flag(first(e["ISDEEMEDPOSITIVE"])).alias("is_deemed_positive"),
            each(e["BILLALLOCATIONS.LIST"], lambda b: F.struct(first(b["NAME"]).alias("name"), first(b["BILLTYPE"]).alias("bill_type"), S.number(first(b["AMOUNT"])).alias("amount"))).alias("bills"),
            each(e["BANKALLOCATIONS.LIST"], lambda b: F.struct(first(b["TRANSACTIONTYPE"]).alias("transaction_type"), S.real_day(first(b["INSTRUMENTDATE"])).alias("instrument_date"), first(b["INSTRUMENTNUMBER"]).alias("instrument_number"), first(b["BANKNAME"]).alias("bank_name"), S.number(first(b["AMOUNT"])).alias("amount"), S.real_day(first(b["BANKERSDATE"])).alias("bankers_date"))).alias("banks"),
            each(e["COSTCENTREALLOCATIONS.LIST"], cost).alias("costs"),
            each(e["CATEGORYALLOCATIONS.LIST"], lambda g: F.struct(first(g["CATEGORY"]).alias("category"), each(g["COSTCENTREALLOCATIONS.LIST"], cost).alias("costs"))).alias("categories"),
        )

    def item(i: Column) -> Column:
        return F.struct(first(i["STOCKITEMNAME"]).alias("stock_item"), S.number(first(i["ACTUALQTY"])).alias("quantity"), S.number(first(i["RATE"])).alias("rate"), S.number(first(i["AMOUNT"])).alias("amount"), first(i["GODOWNNAME"]).alias("godown"), each(i["BATCHALLOCATIONS.LIST"], lambda b: first(b["GODOWNNAME"])).alias("batches"))

    v = lambda name: first(F.col("v")[name])
    return rows.select(
        "path", F.col("doc_order").cast("long").alias("doc_order"), v("GUID").alias("guid"), S.integer(v("MASTERID")).alias("master_id"), S.integer(v("ALTERID")).alias("alter_id"), v("DATE").alias("date_text"), S.real_day(v("DATE")).alias("voucher_date"),
        v("VOUCHERTYPENAME").alias("voucher_type"), v("VOUCHERNUMBER").alias("voucher_number"), v("REFERENCE").alias("reference"), v("NARRATION").alias("narration"), v("PARTYLEDGERNAME").alias("party_name"),
        S.flag(v("ISCANCELLED")).alias("is_cancelled"), S.flag(v("ISOPTIONAL")).alias("is_optional"), S.number(v("AMOUNT")).alias("amount"), F.lit("").alias("seen_at"),
        each(F.col("v")["ALLLEDGERENTRIES.LIST"], entry).alias("entries"), each(F.col("v")["LEDGERENTRIES.LIST"], entry).alias("legacy_entries"), each(F.col("v")["ALLINVENTORYENTRIES.LIST"], item).alias("items"), each(F.col("v")["INVENTORYENTRIES.LIST"], item).alias("legacy_items"),
    )


def names(docs: DataFrame, tag: str = "LEDGER") -> DataFrame:
    """Master elements whose name is a child or an attribute: guid, name, parent; blank names are left out."""
    schema = f"struct<`{tag}`: array<struct<_NAME: string, {_scalars('GUID', 'NAME', 'PARENT')}>>>"
    rows = docs.select(F.explode(F.from_xml("text", schema, {"mode": "PERMISSIVE"})[tag]).alias("m"))
    return rows.select(first(F.col("m.GUID")).alias("guid"), S.first_text(F.try_element_at("m.NAME", F.lit(1)), F.col("m._NAME")).alias("name"), first(F.col("m.PARENT")).alias("parent")).filter("name <> ''")
