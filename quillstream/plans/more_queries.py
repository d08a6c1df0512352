"""Scans, window filters and further checks as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.functions.text import plain_or_null
from quillstream.operators import batches as B
from quillstream.operators import warehouse as W
from quillstream.plans import voucher_queries as VQ
from quillstream.plans import windows as P
from quillstream.plans.common import iso, iso_sql
from quillstream.operators import vouchers as V
from quillstream.session import shared_dir, table
from quillstream.sources import collection


def collection_scan(spark, d):
    """Orders landed by month, then two columns of one period read back."""
    path = f"{shared_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    collection.land(table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")), path, "day")
    return collection.scan(spark, path, ["o_orderkey", "o_totalprice"], "day", "1997-03-10", "1997-06-20")


def window_filter(spark, d):
    """Orders inside and outside a period by status."""
    inside = F.col("o_orderdate").cast("date").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def plan_rechunk(spark, d):
    """Windows of batches wider than three days in pieces, oldest first."""
    from quillstream.functions.text import real_day

    w = table(spark, d, "upload_batches").select("dataset", real_day("window_from").alias("a"), real_day("window_to").alias("b")).filter("a <= b").distinct()
    return iso(P.forward_windows(w, "a", "b", 3).select("dataset", "a", "b", F.col("ord").cast("long").alias("ord"), "window_from", "window_to"))


def duplicate_suppressed(spark, d):
    """New batches that no active one equals: half of them differ in their content."""
    q = table(spark, d, "upload_batches")
    new = q.filter("sequence_no % 3 = 0").select("batch_id", "dataset", "company", F.when(F.col("sequence_no") % 2 == 0, F.concat("content_checksum", F.lit("x"))).otherwise(F.col("content_checksum")).alias("content_checksum"), "record_count", "window_from", "window_to").distinct()
    return B.suppressed(new, q, ["pending", "uploading", "failed", "acked"]).select("batch_id")


def recon_registers(spark, d):
    """Sales register totals a month against the headers', where they differ: headers of one priority are lacking."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).alias("total")
    n = VQ.nested(spark, d)
    a = V.register(n, "sales").groupBy(month("invoice_date")).agg(total("total_amount"))
    b = V.headers(n).filter("voucher_type = 'Sales'").groupBy(month("voucher_date")).agg(total("amount"))
    return W.compared(a, b, ["month"], ["total"]).select("month", *(F.col(f"total_{s}").cast("double").alias(f"total_{s}") for s in ("source", "target", "diff")))


def distinct_names(spark, d):
    """Ledger names that differ in more than case and padding, with how they are written."""
    led = table(spark, d, "ledgers").select(plain_or_null("ledger_name").alias("name"), "ledger_name").filter("name is not null")
    return led.groupBy("name").agg(F.countDistinct("ledger_name").alias("spellings"), F.min("ledger_name").alias("first_spelling"))


def conformed_headers(spark, d):
    """The voucher headers table under its declared schema."""
    return iso(schemas.conformed(table(spark, d, "voucher_headers"), "voucher_headers"))


def ledger_turnover(spark, d):
    """Bills a ledger and month, from references to the chart of accounts, compared plain."""
    b = table(spark, d, "bill_allocations").select(plain_or_null("ledger_name").alias("name"), F.date_format("voucher_date", "yyyy-MM").alias("month"), F.coalesce(F.col("amount"), F.lit(0.0)).cast("decimal(18,2)").alias("amount")).filter("name is not null and month is not null")
    sums = b.groupBy("name", "month").agg(F.count("*").alias("bills"), F.sum("amount").cast("double").alias("total"))
    chart = table(spark, d, "ledgers").groupBy(plain_or_null("ledger_name").alias("name")).agg(F.min("parent_group").alias("parent_group"))
    return sums.join(chart, "name").select("name", "parent_group", "month", "bills", "total")


def queries():
    return {f.__name__: f for f in (collection_scan, window_filter, plan_rechunk, duplicate_suppressed, recon_registers, distinct_names, conformed_headers, ledger_turnover)}


def oracle_sql():
    from quillstream.plans.problems import _day_sql

    plain = "nullif(lower(trim({}, ' ' || chr(9))), '')"
    return {
        "collection_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-10' AND DATE '1997-06-20'",
        "window_filter": "SELECT o_orderstatus, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') AS inside, count(*) FILTER (CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') AS outside FROM orders GROUP BY 1",
        "plan_rechunk": iso_sql(f"WITH w AS (SELECT DISTINCT dataset, {_day_sql('window_from')} AS a, {_day_sql('window_to')} AS b FROM upload_batches) SELECT dataset, a, b, k AS ord, a + CAST(k * 3 AS INTEGER) AS window_from, least(b, a + CAST(k * 3 AS INTEGER) + 2) AS window_to FROM w, unnest(range(0, (b - a) // 3 + 1)) AS u(k) WHERE a <= b", "a", "b", "window_from", "window_to"),
        "duplicate_suppressed": "SELECT DISTINCT batch_id FROM upload_batches WHERE sequence_no % 6 = 0",
        "recon_registers": """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS a, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority = '1-URGENT'), 0) AS b FROM orders WHERE left(o_orderpriority, 1) IN ('1', '3') GROUP BY 1)
  SELECT month, CAST(a AS DOUBLE) AS total_source, CAST(b AS DOUBLE) AS total_target, CAST(a - b AS DOUBLE) AS total_diff FROM o WHERE a <> b""",
        "distinct_names": f"SELECT {plain.format('ledger_name')} AS name, count(DISTINCT ledger_name) AS spellings, min(ledger_name) AS first_spelling FROM ledgers WHERE {plain.format('ledger_name')} IS NOT NULL GROUP BY 1",
        "conformed_headers": iso_sql("SELECT voucher_date, voucher_type, voucher_number, reference, narration, party_name, guid, master_id, alter_id, is_cancelled, is_optional, is_deleted, source_status, source_last_seen_at, amount FROM voucher_headers", "voucher_date"),
        "ledger_turnover": f"""WITH b AS (SELECT {plain.format('ledger_name')} AS name, strftime(voucher_date, '%Y-%m') AS month, count(*) AS bills, CAST(sum(CAST(coalesce(amount, 0) AS DECIMAL(18,2))) AS DOUBLE) AS total FROM bill_allocations WHERE voucher_date IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT {plain.format('ledger_name')} AS name, min(parent_group) AS parent_group FROM ledgers GROUP BY 1) SELECT b.name, parent_group, month, bills, total FROM b JOIN c ON c.name = b.name""",
    }
