"""Deeply nested records to related flat tables that keep their parent links.

A body is parsed once, into a variant. Wherever an element may repeat it can be
an array, a lone object, an empty array, null or absent; ``each`` turns all of
these into an array of structs. Nested ``transform`` calls carry the voucher's
keys and the entry's index down, ``flatten`` joins the arrays of one level and
one ``inline`` per target table emits its rows (the outer form, whose empty
row is dropped: it keeps the optimizer from computing the array twice). No row is shuffled but for
keeping the first voucher of each GUID.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import plain_or_null

# Element names of the export format.
BILLS, BANKS, COSTS, CATEGORIES = "BILLALLOCATIONS.LIST", "BANKALLOCATIONS.LIST", "COSTCENTREALLOCATIONS.LIST", "CATEGORYALLOCATIONS.LIST"
ENTRIES, OTHER_ENTRIES = "ALLLEDGERENTRIES.LIST", "LEDGERENTRIES.LIST"
VOUCHER_TEXTS = ["GUID", "DATE", "VOUCHERTYPENAME", "VOUCHERNUMBER", "NARRATION"]
ENTRY_TEXTS = ["LEDGERNAME", "AMOUNT", "ISDEEMEDPOSITIVE"]
CHILD_TEXTS = {BILLS: ["NAME", "BILLTYPE", "AMOUNT"], BANKS: ["TRANSACTIONTYPE", "INSTRUMENTNUMBER", "NAME", "AMOUNT"], COSTS: ["NAME", "AMOUNT"]}

_END = "whole body"


def _struct(fields: list[str]) -> str:
    return "struct<" + ", ".join(f"`{f}`: variant" for f in fields) + ">"


def each(value: str, fields: list[str]) -> str:
    """SQL for the objects in ``value`` (a variant) as an array of structs of variants."""
    listed = f"coalesce(try_variant_get({value}, '$', 'array<variant>'), array({value}))"
    return f"filter(transform({listed}, x -> try_variant_get(x, '$', '{_struct(fields)}')), x -> x is not null)"


def text(value: str) -> str:
    """SQL for a scalar as text without spaces at the ends, empty if missing."""
    return f"coalesce(trim(try_variant_get({value}, '$', 'string')), '')"


def vouchers(messages: DataFrame, number: str = "msg_no", body: str = "body", children: tuple[str, ...] = (BILLS, BANKS, COSTS), head: list[str] = VOUCHER_TEXTS[1:], entry: list[str] = ENTRY_TEXTS, texts: dict[str, list[str]] = CHILD_TEXTS) -> DataFrame:
    """One row per voucher GUID: voucher_guid, msg_no, head (texts) and entries.

    ``head``, ``entry`` and ``texts`` name what is read of vouchers, entries and
    children; only that is shuffled.

    ``entries`` is an array of structs: ledger_name, amount, is_deemed_positive
    and, for each of ``children``, an array of its texts. A body that isn't one
    whole JSON object gives nothing; nor do vouchers with a blank GUID. Of
    several vouchers with one GUID (plain) that of the lowest msg_no counts,
    within a message the first. A null msg_no comes last.
    """
    spark = messages.sparkSession
    if spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        # of a repeated key the last value holds: the setting is read when a frame runs, so it must stay
        warnings.warn("nested: sets spark.sql.variant.allowDuplicateKeys on this session", stacklevel=2)
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Parsed inside an array with an end mark: what follows a body's end breaks the parse or the mark. No filter
    # stands between parsing and unnesting, or it would be pushed below and parse each body once more.
    wrapped = messages.select(F.coalesce(F.col(number), F.lit(2**63 - 1)).cast("long").alias("msg_no"), F.expr(f"""try_parse_json('[' || {body} || ', "{_END}"]')""").alias("w"))
    top = wrapped.selectExpr("msg_no", f"if(try_variant_get(w, '$[1]', 'string') = '{_END}', try_variant_get(w, '$[0]', '{_struct(['VOUCHER', 'ENVELOPE'])}'), null) as top")
    messages_of = each("try_variant_get(top.ENVELOPE, '$.BODY.DATA.TALLYMESSAGE', 'variant')", ["VOUCHER"])
    fields = ["GUID", *head, ENTRIES, OTHER_ENTRIES]
    found = top.selectExpr("msg_no", f"concat({each('top.VOUCHER', fields)}, flatten(transform({messages_of}, m -> {each('m.VOUCHER', fields)}))) as found")
    # outer: for an inner one a filter on the array's size would be inferred and repeat all of the above
    one = found.selectExpr("msg_no", "posexplode_outer(found) as (at, v)").withColumn("voucher_guid", plain_or_null(F.expr("try_variant_get(v.GUID, '$', 'string')"))).filter("voucher_guid is not null")

    wanted = [*entry, *(c for c in children if c != COSTS), *((COSTS, CATEGORIES) if COSTS in children else ())]
    all_entries, other = each(f"v.`{ENTRIES}`", wanted), each(f"v.`{OTHER_ENTRIES}`", wanted)
    names = {"LEDGERNAME": "ledger_name", "AMOUNT": "amount", "ISDEEMEDPOSITIVE": "is_deemed_positive"}
    parts = [f"{text(f'e.{t}')} as {names[t]}" for t in entry]
    row = lambda kind, x: ", ".join(f"{text(f'{x}.{f}')} as {f.lower()}" for f in texts[kind])
    if BILLS in children:
        parts.append(f"transform({each(f'e.`{BILLS}`', texts[BILLS])}, b -> struct({row(BILLS, 'b')})) as bills")
    if BANKS in children:
        parts.append(f"transform({each(f'e.`{BANKS}`', texts[BANKS])}, b -> struct({row(BANKS, 'b')})) as banks")
    if COSTS in children:
        direct = f"transform({each(f'e.`{COSTS}`', texts[COSTS])}, c -> struct('' as category, {row(COSTS, 'c')}))"
        by_category = f"flatten(transform({each(f'e.`{CATEGORIES}`', ['CATEGORY', COSTS])}, g -> transform({each(f'g.`{COSTS}`', texts[COSTS])}, c -> struct({text('g.CATEGORY')} as category, {row(COSTS, 'c')}))))"
        parts.append(f"concat({direct}, {by_category}) as costs")
    read = one.selectExpr("voucher_guid", "msg_no", "at", f"struct({', '.join(f'{text(f"v.{t}")} as {t.lower()}' for t in head) or "1 as read"}) as head", f"{all_entries} as a", f"{other} as o")
    shaped = read.selectExpr("voucher_guid", "msg_no", "at", "head", f"transform(if(size(a) > 0, a, o), e -> struct({', '.join(parts)})) as entries")
    first = shaped.groupBy("voucher_guid").agg(F.min_by(F.struct("msg_no", "head", "entries"), F.struct("msg_no", "at")).alias("v"))
    return first.select("voucher_guid", "v.msg_no", "v.head", "v.entries")


def voucher_table(v: DataFrame) -> DataFrame:
    return v.select("voucher_guid", "msg_no", "head.*")


def entry_table(v: DataFrame) -> DataFrame:
    """voucher_guid, entry_index (from 0, in the order of the body) and the entry's texts."""
    return v.selectExpr("inline_outer(transform(entries, (e, i) -> struct(voucher_guid, cast(i as bigint) as entry_index, e.ledger_name, e.amount, e.is_deemed_positive)))").filter("voucher_guid is not null")


def child_table(v: DataFrame, kind: str, columns: dict[str, str], ledger: bool = True) -> DataFrame:
    """voucher_guid, entry_index, line_index (from 0 through the whole voucher), ledger_name and ``columns``.

    ``kind`` is bills, banks or costs; ``columns`` maps the child's texts to
    names. Without ``ledger`` the entry's ledger isn't read.
    """
    picked = ", ".join(f"c.{f} as {n}" for f, n in columns.items())
    flat = f"flatten(transform(entries, (e, i) -> transform(e.{kind}, c -> struct(cast(i as bigint) as entry_index, {"e.ledger_name as ledger_name, " if ledger else ""}{picked}))))"
    names = ", ".join(f"x.{n}" for n in ("entry_index", *(["ledger_name"] if ledger else []), *columns.values()))
    return v.selectExpr(f"inline_outer(transform({flat}, (x, i) -> struct(voucher_guid, cast(i as bigint) as line_index, {names})))").filter("voucher_guid is not null")
