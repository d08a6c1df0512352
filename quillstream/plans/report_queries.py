"""Masters and snapshot reports over customers, suppliers, parts and the ledgers table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import masters, reports
from quillstream.plans.common import iso, iso_sql
from quillstream.session import table


def _balances(spark: SparkSession, d: str) -> DataFrame:
    """Customers are debtors by market segment, suppliers creditors."""
    c = table(spark, d, "customer").selectExpr("c_name as ledger_name", "concat('Sundry DEBTORS - ', c_mktsegment) as parent_group", "c_acctbal as closing")
    s = table(spark, d, "supplier").selectExpr("s_name as ledger_name", "'sundry Creditors' as parent_group", "s_acctbal as closing")
    return c.unionByName(s)


_BALANCES = "b AS (SELECT c_name AS ledger_name, 'Sundry DEBTORS - ' || c_mktsegment AS parent_group, c_acctbal AS closing FROM customer UNION ALL SELECT s_name, 'sundry Creditors', s_acctbal FROM supplier)"
_TB = "SELECT ledger_name, CASE WHEN closing < 0 THEN -closing ELSE 0 END AS closing_debit, CASE WHEN closing > 0 THEN closing ELSE 0 END AS closing_credit, -closing AS net_amount, parent_group FROM b WHERE closing <> 0"


def trial_balance(spark, d):
    return reports.trial_balance(_balances(spark, d))


def trial_balance_fallback(spark, d):
    """The report of a period without rows: the ledgers' balances take its place."""
    empty = _balances(spark, d).filter("closing > 1e12")
    return reports.or_else(reports.trial_balance(empty), reports.trial_balance(_balances(spark, d)))


def trial_balance_primary(spark, d):
    """The report has rows of its own, so the fallback stays out."""
    own = _balances(spark, d).filter("closing > 5000")
    return reports.or_else(reports.trial_balance(own), reports.trial_balance(_balances(spark, d)))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("amount"))
    n = table(spark, d, "nation")
    return n.join(per, n["n_nationkey"] == per["c_nationkey"], "left").select(F.col("n_name").alias("group_name"), (F.col("n_regionkey") % 2 == 1).alias("is_revenue"), F.coalesce(F.when(F.col("n_nationkey") % 3 == 0, -F.col("amount")).otherwise(F.col("amount")), F.lit(0)).cast("double").alias("amount"))


_GROUPS = """g AS (SELECT n_name AS group_name, n_regionkey % 2 = 1 AS is_revenue, CAST(coalesce(CASE WHEN n_nationkey % 3 = 0 THEN -a ELSE a END, 0) AS DOUBLE) AS amount FROM nation
  LEFT JOIN (SELECT c_nationkey, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS a FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"""


def stock_summary(spark, d):
    """Lines with status F came in, those with O went out."""
    dec = lambda c: F.col(c).cast("decimal(18,2)")
    moved = table(spark, d, "lineitem").groupBy("l_partkey").agg(*(F.coalesce(F.sum(F.when(F.col("l_linestatus") == s, dec(c))), F.lit(0)).cast("double").alias(n) for s, c, n in (("F", "l_quantity", "inward_qty"), ("F", "l_extendedprice", "inward_value"), ("O", "l_quantity", "outward_qty"), ("O", "l_extendedprice", "outward_value"))))
    p = table(spark, d, "part")
    j = p.join(moved, p["p_partkey"] == moved["l_partkey"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    items = j.select(F.concat("p_name", F.lit(" "), "p_partkey").alias("item_name"), F.col("p_brand").alias("stock_group"), F.col("p_size").cast("double").alias("opening_qty"), F.lit(0.0).alias("opening_value"), zero("inward_qty"), zero("inward_value"), zero("outward_qty"), zero("outward_value"))
    items = items.withColumn("closing_qty", F.col("opening_qty") + F.col("inward_qty") - F.col("outward_qty")).withColumn("closing_value", F.lit(0.0)).withColumn("closing_value_alt", F.col("inward_value"))
    return reports.stock_summary(items)


_STOCK = """WITH m AS (SELECT l_partkey, """ + ", ".join(f"CAST(coalesce(sum(CAST({c} AS DECIMAL(18,2))) FILTER (l_linestatus = '{s}'), 0) AS DOUBLE) AS {n}" for s, c, n in (("F", "l_quantity", "iq"), ("F", "l_extendedprice", "iv"), ("O", "l_quantity", "oq"), ("O", "l_extendedprice", "ov"))) + """ FROM lineitem GROUP BY 1),
s AS (SELECT p_name || ' ' || p_partkey AS item_name, p_brand AS stock_group, CAST(p_size AS DOUBLE) AS opening_qty, 0.0::DOUBLE AS opening_value, coalesce(iq, 0) AS inward_qty, coalesce(iv, 0) AS inward_value, coalesce(oq, 0) AS outward_qty, coalesce(ov, 0) AS outward_value,
  p_size + coalesce(iq, 0) - coalesce(oq, 0) AS closing_qty, coalesce(iv, 0) AS closing_value FROM part LEFT JOIN m ON l_partkey = p_partkey)
SELECT * FROM s WHERE opening_qty <> 0 OR closing_qty <> 0 OR closing_value <> 0"""


def _walked(c):
    c = c.selectExpr("c_nationkey as report", "c_custkey as k", "if(c_custkey % 2 = 0, upper(c_mktsegment), lower(c_mktsegment)) || cast(c_custkey % 50 as string) as nm", "c_acctbal")
    nodes = c.selectExpr("report", "inline(filter(array(named_struct('ord', k * 2, 'tag', 'name', 'value', nm), named_struct('ord', k * 2 + 1, 'tag', 'amount', 'value', cast(cast(c_acctbal as decimal(18,2)) as string))), x -> not (x.tag = 'amount' and k % 5 = 0)))")
    return reports.pair_walk(nodes)


def report_pair_walk(spark, d):
    """Customers as alternating name and amount nodes; every fifth has no amount node and names repeat in other case."""
    return _walked(table(spark, d, "customer"))


_WALK = """WITH c AS (SELECT c_nationkey AS report, c_custkey * 2 AS ord, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || (c_custkey % 50) AS name, c_acctbal AS amount, c_custkey AS k FROM customer)
SELECT report, ord, name, amount FROM c WHERE k % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY report, lower(name) ORDER BY ord) = 1"""


def bank_ledgers(spark, d):
    return masters.bank_ledgers(table(spark, d, "ledgers"))


def opening_bills(spark, d):
    """Customers with their orders as bills; some references are blank."""
    bills = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.expr("struct(if(o_orderkey % 9 = 0, ' ', concat(' B-', o_orderkey)) as bill_ref, o_orderstatus as bill_type, o_totalprice as opening_amount, -o_totalprice as closing_amount)")).alias("bills"))
    c = table(spark, d, "customer").selectExpr("concat('L-', c_custkey) as master_guid", "c_custkey as master_id", "c_custkey + 1 as alter_id", "c_name as ledger_name", "c_custkey")
    return masters.opening_bills(c.join(bills, F.col("c_custkey") == F.col("o_custkey")))


def standard_prices(spark, d):
    p = table(spark, d, "part").selectExpr("concat('P-', p_partkey) as master_guid", "p_partkey as master_id", "p_partkey as alter_id", "p_name as item_name", "transform(sequence(1, 1 + p_size % 3), k -> struct(date_add(date'2026-03-31', k) as effective_date, p_retailprice + k as rate)) as rates")
    return iso(masters.standard_rates(p, "rates"))


def gst_rates(spark, d):
    """The first rate of an item's details that isn't 0, else its own."""
    p = table(spark, d, "part").selectExpr("concat('P-', p_partkey) as master_guid", "p_name as item_name", "if(p_size % 2 = 0, array(0.0D, cast(p_size as double), 18.0D), if(p_size % 3 = 0, array(0.0D), null)) as rates", "if(p_size % 5 = 0, ' ', p_brand) as hsn", "p_type as hsn_alt")
    return p.select("master_guid", "item_name", masters.first_rate(F.col("rates"), F.lit(5.0)).alias("gst_rate"), masters.S.first_text(F.col("hsn"), F.col("hsn_alt")).alias("hsn_code"))


def balance_carry_forward(spark, d):
    """Half the customers had their balances captured; the rest keep null."""
    c = table(spark, d, "customer").selectExpr("concat('L-', c_custkey) as master_guid", "c_name as ledger_name")
    cap = table(spark, d, "customer").filter("c_custkey % 2 = 0").selectExpr("concat('L-', c_custkey) as master_guid", "map('OPENING', c_acctbal, 'CLOSING', c_acctbal * 2) as balances", "'2026-06-15' as as_of")
    return masters.with_balances(c, cap, ["OPENING", "CLOSING"])


def groups(spark, d):
    """Regions are root groups, nations the groups below them."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    child = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").selectExpr("concat('G-', n_nationkey) as master_guid", "n_name as group_name", "r_name as parent", "n_regionkey % 2 = 1 as is_revenue")
    return r.selectExpr("concat('R-', r_regionkey) as master_guid", "r_name as group_name", "'' as parent", "r_regionkey % 2 = 1 as is_revenue").unionByName(child).filter("trim(group_name) <> ''")


def queries():
    out = {f.__name__: f for f in (trial_balance, trial_balance_fallback, trial_balance_primary, stock_summary, report_pair_walk, bank_ledgers, opening_bills, standard_prices, gst_rates, balance_carry_forward, groups)}
    return out | {
        "balance_sheet": lambda s, d: reports.group_report(_groups(s, d), False), "profit_loss": lambda s, d: reports.group_report(_groups(s, d), True),
        "outstanding_receivables": lambda s, d: reports.outstanding(_balances(s, d), "Sundry Debtors"), "outstanding_payables": lambda s, d: reports.outstanding(_balances(s, d), "Sundry Creditors"),
    }


def oracle_sql():
    return {
        "trial_balance": f"WITH {_BALANCES} {_TB}", "trial_balance_fallback": f"WITH {_BALANCES} {_TB}", "trial_balance_primary": f"WITH {_BALANCES} {_TB} AND closing > 5000",
        "balance_sheet": f"WITH {_GROUPS} SELECT group_name AS ledger_name, amount, '' AS parent_group, CASE WHEN amount >= 0 THEN 'Liabilities' ELSE 'Assets' END AS category FROM g WHERE NOT is_revenue AND amount <> 0",
        "profit_loss": f"WITH {_GROUPS} SELECT group_name AS ledger_name, amount, '' AS parent_group FROM g WHERE is_revenue AND amount <> 0",
        "outstanding_receivables": "SELECT c_name AS party_name, 'Sundry DEBTORS - ' || c_mktsegment AS parent_group, c_acctbal AS amount FROM customer WHERE c_acctbal <> 0",
        "outstanding_payables": "SELECT s_name AS party_name, 'sundry Creditors' AS parent_group, s_acctbal AS amount FROM supplier WHERE s_acctbal <> 0",
        "stock_summary": _STOCK, "report_pair_walk": _WALK,
        "bank_ledgers": "SELECT DISTINCT ledger_name FROM ledgers WHERE parent_group ILIKE '%bank%'",
        "opening_bills": "SELECT 'L-' || c_custkey AS master_guid, c_custkey AS master_id, c_custkey + 1 AS alter_id, c_name AS ledger_name, 'B-' || o_orderkey AS bill_ref, o_orderstatus AS bill_type, o_totalprice AS opening_amount, -o_totalprice AS closing_amount FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 9 <> 0",
        "standard_prices": iso_sql("SELECT 'P-' || p_partkey AS master_guid, p_partkey AS master_id, p_partkey AS alter_id, p_name AS item_name, DATE '2026-03-31' + CAST(k AS INTEGER) AS effective_date, p_retailprice + k AS rate FROM part, unnest(range(1, 2 + p_size % 3)) AS u(k)", "effective_date"),
        "gst_rates": "SELECT 'P-' || p_partkey AS master_guid, p_name AS item_name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 5.0 END AS gst_rate, CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_brand END AS hsn_code FROM part",
        "balance_carry_forward": "SELECT 'L-' || c_custkey AS master_guid, c_name AS ledger_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS \"OPENING\", CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 END AS \"CLOSING\", CASE WHEN c_custkey % 2 = 0 THEN '2026-06-15' END AS balance_as_of FROM customer",
        "groups": "SELECT 'R-' || r_regionkey AS master_guid, r_name AS group_name, '' AS parent, r_regionkey % 2 = 1 AS is_revenue FROM region UNION ALL SELECT 'G-' || n_nationkey, n_name, r_name, n_regionkey % 2 = 1 FROM nation LEFT JOIN region ON r_regionkey = n_regionkey",
    }
