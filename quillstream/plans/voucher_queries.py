"""Voucher datasets over orders and lineitem.

Orders are vouchers, their lines are ledger lines, stock lines and allocations:
status P is cancelled and O optional, the priority names the voucher type, the
return flag the tax ledger, the line status the side. A voucher's lines are
nested into arrays in a total order, and the operators unnest them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import vouchers as V
from quillstream.plans.common import iso, iso_sql
from quillstream.session import table

_TYPE = {"1-URGENT": "Sales", "2-HIGH": "Purchase", "3-MEDIUM": "Credit Note", "4-NOT SPECIFIED": "Payment", "5-LOW": "Debit Note"}
_HEADS = {"A": "CGST 9%", "N": "Output SGST", "R": "IGST 18%"}


def _case(column: str, values: dict[str, str], prefix: int | None = None) -> str:
    key = f"left({column}, {prefix})" if prefix else column
    return f"CASE {key} " + " ".join(f"WHEN '{k[:prefix] if prefix else k}' THEN '{v}'" for k, v in values.items()) + " END"


_TYPE_SQL, _HEAD_SQL = _case("o_orderpriority", _TYPE, 1), _case("l_returnflag", _HEADS)
_SIGNED = "l_extendedprice * (CASE l_linestatus WHEN 'O' THEN 1 ELSE -1 END)"
_BANKS = "c_mktsegment = 'MACHINERY'"


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as nested vouchers."""
    line = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    bill = "struct(concat('B', l_linenumber) as name, 'New Ref' as bill_type, l_extendedprice as amount)"
    entry = f"""struct({", ".join(order)}, struct({_HEAD_SQL} as ledger_name, {_SIGNED} as amount, l_linestatus = 'O' as is_deemed_positive,
      if(l_returnflag = 'R', array({bill}, struct(concat('C', l_linenumber) as name, 'Agst Ref' as bill_type, -l_extendedprice as amount)), array({bill})) as bills,
      if(l_returnflag = 'A', array(struct('Cheque' as transaction_type, cast(l_shipdate as date) as instrument_date, cast(l_partkey as string) as instrument_number, 'Bank' as bank_name, l_extendedprice as amount, cast(null as date) as bankers_date)), array()) as banks,
      if(l_linenumber % 2 = 0, array(struct(l_linestatus as name, l_quantity as amount)), array()) as costs,
      if(l_linenumber % 3 = 0, array(struct(l_returnflag as category, array(struct(if(l_linestatus = 'F', '', 'Centre') as name, l_tax as amount)) as costs)), array()) as categories) as e,
      struct(if(l_linenumber = 7, ' ', p_name) as stock_item, l_quantity as quantity, l_extendedprice / l_quantity as rate, l_extendedprice as amount, s_name as godown, if(l_linenumber % 2 = 1, array('', concat('Store ', l_linenumber)), array()) as batches) as i) as x"""
    per = line.selectExpr("l_orderkey", entry).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    entries, items = "coalesce(transform(xs, x -> x.e), array())", "coalesce(transform(xs, x -> x.i), array())"
    # every third voucher comes in the older shape, every sixth in both
    both, old = "o_orderkey % 6 = 0", "o_orderkey % 3 = 0"
    return o.selectExpr(
        "concat('V-', o_orderkey) as guid", "o_orderkey as master_id", "o_orderkey * 2 as alter_id", "cast(o_orderdate as date) as voucher_date", f"{_TYPE_SQL} as voucher_type", "cast(o_orderkey as string) as voucher_number",
        "'' as reference", "concat('order ', o_orderkey) as narration", "if(o_orderkey % 5 = 0, ' ', c_name) as party_name", "o_orderstatus = 'P' as is_cancelled", "o_orderstatus = 'O' as is_optional", "o_totalprice as amount", "cast(o_orderdate as string) as seen_at",
        f"if({old} and not {both}, array(), {entries}) as entries", f"if({old}, {entries}, null) as legacy_entries", f"if({old} and not {both}, null, {items}) as items", f"if({old}, {items}, array()) as legacy_items",
    )


_HEAD_COLUMNS = f"""CAST(o_orderdate AS DATE) AS voucher_date, {_TYPE_SQL} AS voucher_type, CAST(o_orderkey AS VARCHAR) AS voucher_number, '' AS reference, 'order ' || o_orderkey AS narration, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE c_name END AS party_name,
  'V-' || o_orderkey AS guid, o_orderkey AS master_id, o_orderkey * 2 AS alter_id, o_orderstatus = 'P' AS is_cancelled, o_orderstatus = 'O' AS is_optional, false AS is_deleted,
  CASE o_orderstatus WHEN 'P' THEN 'cancelled' WHEN 'O' THEN 'optional' ELSE 'active' END AS source_status, CAST(o_orderdate AS VARCHAR) AS source_last_seen_at"""
_CTE = f"""WITH h AS (SELECT *, {_HEAD_COLUMNS} FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) - 1 AS line_index, {_HEAD_SQL} AS ledger_name, {_SIGNED} AS signed FROM lineitem),
v AS (SELECT * FROM h JOIN l ON l_orderkey = o_orderkey)"""
_HEAD_NAMES = ", ".join(V.HEADER)


def _q(make):
    return lambda spark, d: iso(make(nested(spark, d)))


def _bank_book(spark: SparkSession, d: str) -> DataFrame:
    banks = spark.createDataFrame([("CGST 9%",), ("IGST 18%",)], "ledger_name string")
    return iso(V.bank_book(nested(spark, d), banks))


def _screen_input(spark: SparkSession, d: str) -> DataFrame:
    """Orders as delivered: dates in several forms, some wrong, some orders delivered twice, some guids blank."""
    day = "cast(o_orderdate as date)"
    forms = f"CASE o_orderkey % 7 WHEN 0 THEN date_format({day}, 'yyyyMMdd') WHEN 1 THEN date_format({day}, 'dd/MM/yyyy') WHEN 2 THEN date_format({day}, 'd-MMM-yyyy') WHEN 3 THEN '31-31-2026' ELSE date_format({day}, 'yyyy-MM-dd') END"
    rows = table(spark, d, "orders").selectExpr("if(o_orderkey % 11 = 0, ' ', concat('v-', o_orderkey % 20000)) as guid", "o_orderkey as master_id", f"{_TYPE_SQL} as voucher_type", "cast(o_orderkey as string) as voucher_number", f"{forms} as date_text", "o_orderkey as doc_order")
    again = rows.filter("doc_order % 4 = 0").selectExpr("upper(guid) as guid", "master_id", "voucher_type", "voucher_number", "date_text", "doc_order + 100000000 as doc_order")
    return rows.unionByName(again)


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return iso(V.screened(_screen_input(spark, d), "1996-01-01", "1999-12-31")[0].select("guid", "voucher_number", "voucher_date", "doc_order"))


def _fates(spark: SparkSession, d: str) -> DataFrame:
    return V.screened(_screen_input(spark, d), "1996-01-01", "1999-12-31")[1]


_SCREEN = f"""WITH r AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'v-' || (o_orderkey % 20000) END AS guid, o_orderkey AS master_id, {_TYPE_SQL} AS voucher_type, CAST(o_orderkey AS VARCHAR) AS voucher_number,
  CASE WHEN o_orderkey % 7 <> 3 THEN CAST(o_orderdate AS DATE) END AS voucher_date, o_orderkey AS doc_order FROM orders),
a AS (SELECT * FROM r UNION ALL SELECT upper(guid), master_id, voucher_type, voucher_number, voucher_date, doc_order + 100000000 FROM r WHERE doc_order % 4 = 0),
f AS (SELECT *, lower(coalesce(nullif(trim(guid), ''), concat_ws('|', CAST(voucher_date AS VARCHAR), voucher_type, voucher_number, master_id))) AS k,
  CASE WHEN voucher_date IS NULL THEN 'invalid_date' WHEN voucher_date NOT BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' THEN 'out_of_window' END AS reject FROM a),
j AS (SELECT *, coalesce(reject, CASE WHEN row_number() OVER (PARTITION BY k, reject IS NULL ORDER BY doc_order) > 1 THEN 'duplicate' ELSE 'kept' END) AS fate FROM f)"""


def _month_extents(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("window"), F.col("o_orderdate").cast("date").alias("voucher_date"))
    return iso(V.extents(v, "window"))


def _shape_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines taken from the newer and the older list shape, of vouchers that have both or one."""
    n = nested(spark, d).select((F.size(F.coalesce("entries", F.array())) > 0).alias("newer"), F.size(F.coalesce("legacy_entries", F.array())).alias("older"), F.size(V.preferred("entries", "legacy_entries")).alias("used"))
    return n.groupBy("newer").agg(F.count("*").alias("vouchers"), F.sum("used").alias("lines_used"), F.sum("older").alias("lines_older"))


def queries():
    return {
        "voucher_headers": _q(V.headers), "vouchers_flat": _q(V.flat), "day_book": _q(V.flat), "voucher_lines": _q(V.lines), "bill_allocations": _q(V.bill_allocations), "bank_allocations": _q(V.bank_allocations),
        "cost_centre_allocations": _q(V.cost_centre_allocations), "inventory_entries": _q(lambda v: V.inventory_entries(v).drop("voucher_type")), "sales_invoice_lines": _q(V.invoice_lines), "bank_book": _bank_book,
        "sales_register": _q(lambda v: V.register(v, "sales")), "purchase_register": _q(lambda v: V.register(v, "purchase")), "guid_manifest": _q(V.manifest),
        "dedupe_first_wins": _kept, "reject_counts": _fates, "window_extents": _month_extents, "shape_preference": _shape_counts,
    }


def oracle_sql():
    flat = f"{_CTE} SELECT {_HEAD_NAMES}, line_index, ledger_name, signed AS amount, l_linestatus = 'O' AS is_deemed_positive FROM v"
    child = "'V-' || o_orderkey AS voucher_guid, '{}' AS entry_type, row_number() OVER (PARTITION BY o_orderkey ORDER BY {}) - 1 AS line_index, voucher_date"
    stock = f"""{_CTE}, s AS (SELECT v.*, p_name AS stock_item, CASE WHEN l_linenumber % 2 = 1 THEN 'Store ' || l_linenumber ELSE s_name END AS godown FROM v LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber <> 7)"""
    register = lambda kinds: f"""{_CTE} SELECT voucher_date AS invoice_date, voucher_number AS invoice_number, voucher_type, party_name, narration, reference, guid, master_id, alter_id, abs(o_totalprice) AS total_amount,
  {", ".join(f"CAST(coalesce((SELECT sum(CAST(l_extendedprice AS DECIMAL(18,2))) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = '{f}'), 0) AS DOUBLE) AS {n}" for f, n in (("A", "cgst"), ("N", "sgst"), ("R", "igst")))} FROM h WHERE voucher_type IN {kinds}"""  # noqa: E731
    sql = {
        "voucher_headers": f"{_CTE} SELECT {_HEAD_NAMES}, o_totalprice AS amount FROM h",
        "vouchers_flat": flat, "day_book": flat,
        "voucher_lines": f"{_CTE} SELECT 'V-' || o_orderkey AS voucher_guid, 'ledger' AS entry_type, line_index, voucher_date, voucher_number, ledger_name, signed AS amount, l_linestatus = 'O' AS is_deemed_positive FROM v",
        "bill_allocations": f"""{_CTE}, b AS (SELECT *, 0 AS k, 'B' || l_linenumber AS bill_ref, 'New Ref' AS bill_type, l_extendedprice AS bill_amount FROM v UNION ALL SELECT *, 1, 'C' || l_linenumber, 'Agst Ref', -l_extendedprice FROM v WHERE l_returnflag = 'R')
  SELECT {child.format('bill_allocation', 'line_index, k')}, voucher_number, ledger_name, bill_ref, bill_type, bill_amount AS amount FROM b""",
        "bank_allocations": f"""{_CTE}, b AS (SELECT * FROM v WHERE l_returnflag = 'A') SELECT {child.format('bank_allocation', 'line_index')}, voucher_number, voucher_type, ledger_name, 'Cheque' AS transaction_type, CAST(l_shipdate AS DATE) AS instrument_date,
  CAST(l_partkey AS VARCHAR) AS instrument_number, 'Bank' AS bank_name, l_extendedprice AS amount, CAST(NULL AS DATE) AS bankers_date FROM b""",
        "cost_centre_allocations": f"""{_CTE}, b AS (SELECT *, 0 AS k, l_linestatus AS cost_centre, '' AS cost_category, l_quantity AS a FROM v WHERE l_linenumber % 2 = 0 UNION ALL SELECT *, 1, 'Centre', l_returnflag, l_tax FROM v WHERE l_linenumber % 3 = 0 AND l_linestatus <> 'F')
  SELECT {child.format('cost_centre_allocation', 'line_index, k')}, voucher_type, ledger_name, cost_centre, cost_category, a AS amount FROM b""",
        "inventory_entries": f"{stock} SELECT {child.format('inventory', 'line_index')}, voucher_number, stock_item, l_quantity AS quantity, l_extendedprice / l_quantity AS rate, l_extendedprice AS amount, godown FROM s",
        "sales_invoice_lines": f"{stock} SELECT 'V-' || o_orderkey AS voucher_guid, voucher_number AS invoice_number, voucher_date AS invoice_date, stock_item, l_quantity AS quantity, l_extendedprice / l_quantity AS rate, l_extendedprice AS amount, godown FROM s WHERE voucher_type IN ('Sales', 'Credit Note')",
        "bank_book": f"""{_CTE} SELECT ledger_name AS bank_account, voucher_date AS txn_date, voucher_type, voucher_number, CASE WHEN trim(party_name) <> '' THEN trim(party_name) ELSE narration END AS particulars,
  greatest(signed, 0.0) AS debit, greatest(-signed, 0.0) AS credit, narration, CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS cheque_number, CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) END AS instrument_date FROM v WHERE l_returnflag IN ('A', 'R')""",
        "sales_register": register("('Sales', 'Credit Note')"), "purchase_register": register("('Purchase', 'Debit Note')"),
        "guid_manifest": f"{_CTE} SELECT guid, voucher_date, voucher_type, alter_id, is_cancelled FROM h",
        "dedupe_first_wins": f"{_SCREEN} SELECT guid, voucher_number, voucher_date, doc_order FROM j WHERE fate = 'kept'",
        "reject_counts": f"{_SCREEN} SELECT fate, count(*) AS vouchers FROM j GROUP BY fate",
        "window_extents": "SELECT strftime(o_orderdate, '%Y-%m') AS \"window\", count(*) AS vouchers, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1",
        "shape_preference": """WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
  SELECT NOT (o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0) AND n > 0 AS newer, count(*) AS vouchers, CAST(sum(n) AS BIGINT) AS lines_used, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN n ELSE 0 END) AS BIGINT) AS lines_older FROM n GROUP BY 1""",
    }
    days = {"bank_allocations": ["voucher_date", "instrument_date", "bankers_date"], "sales_invoice_lines": ["invoice_date"], "bank_book": ["txn_date", "instrument_date"], "sales_register": ["invoice_date"], "purchase_register": ["invoice_date"], "window_extents": ["first_date", "last_date"], "reject_counts": [], "shape_preference": []}
    return {k: iso_sql(s, *names) if (names := days.get(k, ["voucher_date"])) else s for k, s in sql.items()}
