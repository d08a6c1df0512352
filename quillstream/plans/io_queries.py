"""Scalar rules, sources, sinks and streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import scalars as S
from quillstream.operators import vouchers as V
from quillstream.plans.common import iso, literal, values_sql
from quillstream.session import shared_dir, table
from quillstream.sources import ndjson, xml
from quillstream.streaming import pump

_NUMBERS = ["-1,23,456.78", "12 Nos", "2.5 Dr.", "5-", "", "1e5", "= 12 Nos 5 Box", "Rs. 5", None, "-7", "0.10", "abc"]
_FLAGS = ["Yes", "TRUE", "1", "No", "", " yes ", None, "0", "true"]
_DAYS = ["20260401", "2026-04-01", "1-Apr-2026", "01-Apr-2026", "01/04/2026", "20260431", "junk", "31-31-2026", "", None, " 2026-04-02 ", "2026-4-2", "29/02/2024", "29-Feb-2023"]
_IDS = ["plain-id_1.0", "a b/c", "", None, "x" * 80, "Müller & Söhne", "  pad  "]
_TEXTS = [(" a ", "b"), ("", " c "), (None, None), (" ", "d"), (None, "e")]

_XML = """<ENVELOPE><VOUCHER><GUID>AB-1</GUID><DATE>20260401</DATE><VOUCHERTYPENAME>Sales</VOUCHERTYPENAME><VOUCHERNUMBER>1</VOUCHERNUMBER><VOUCHERNUMBER>2</VOUCHERNUMBER><AMOUNT>-1,250.50</AMOUNT><ISCANCELLED>Yes</ISCANCELLED>
<ALLLEDGERENTRIES.LIST><LEDGERNAME>A &amp; B&#4;</LEDGERNAME><AMOUNT>10</AMOUNT><BILLALLOCATIONS.LIST><NAME>R1</NAME><AMOUNT>4</AMOUNT></BILLALLOCATIONS.LIST><BILLALLOCATIONS.LIST><NAME>R2</NAME><AMOUNT>6</AMOUNT></BILLALLOCATIONS.LIST></ALLLEDGERENTRIES.LIST>
<ALLLEDGERENTRIES.LIST><LEDGERNAME>C</LEDGERNAME><AMOUNT>-10</AMOUNT><BILLALLOCATIONS.LIST><NAME>R3</NAME></BILLALLOCATIONS.LIST></ALLLEDGERENTRIES.LIST><LEDGERENTRIES.LIST><LEDGERNAME>twice</LEDGERNAME></LEDGERENTRIES.LIST></VOUCHER>
<VOUCHER><GUID>CD-2</GUID><DATE>2-Apr-2026</DATE><LEDGERENTRIES.LIST><LEDGERNAME>old shape\u0001</LEDGERNAME><AMOUNT>7</AMOUNT><BILLALLOCATIONS.LIST><NAME/></BILLALLOCATIONS.LIST></LEDGERENTRIES.LIST></VOUCHER></ENVELOPE>"""
_MASTERS = "<ENVELOPE><LEDGER NAME='By attribute'><GUID>1</GUID><PARENT>P</PARENT></LEDGER><LEDGER NAME='attribute'><GUID>2</GUID><NAME>By child</NAME></LEDGER><LEDGER><GUID>3</GUID><NAME> </NAME></LEDGER></ENVELOPE>"


def numeric_parse(spark, d):
    t = literal(spark, [(i, x) for i, x in enumerate(_NUMBERS)], "i long, x string")
    return t.select("i", S.number(F.col("x")).alias("number"), S.integer(F.col("x")).alias("whole"))


def bool_parse(spark, d):
    return literal(spark, [(i, x) for i, x in enumerate(_FLAGS)], "i long, x string").select("i", S.flag(F.col("x")).alias("flag"))


def date_parse(spark, d):
    return iso(literal(spark, [(i, x) for i, x in enumerate(_DAYS)], "i long, x string").select("i", S.real_day("x").alias("day"), S.iso_day(F.col("x")).alias("iso_day")))


def invalid_date_reject(spark, d):
    """Window bounds of batches by whether they name a day."""
    b = table(spark, d, "upload_batches").select(F.explode(F.array("window_from", "window_to")).alias("x"))
    return b.groupBy(F.when(F.col("x").isNull(), "missing").when(S.real_day("x").isNull(), "invalid").otherwise("valid").alias("verdict")).agg(F.count("*").alias("n"))


def id_sanitise(spark, d):
    return literal(spark, [(i, x) for i, x in enumerate(_IDS)], "i long, x string").select("i", S.safe_id(F.col("x")).alias("safe_id"))


def text_fallback(spark, d):
    return literal(spark, [(i, *x) for i, x in enumerate(_TEXTS)], "i long, a string, b string").select("i", S.text(F.col("a")).alias("own"), S.first_text(F.col("a"), F.col("b")).alias("first"))


def xml_escape(spark, d):
    return table(spark, d, "part").select("p_partkey", S.xml_escaped(F.concat(F.lit("<"), "p_name", F.lit("&'"), "p_brand", F.lit('">'))).alias("escaped"))


def _docs(spark: SparkSession, text: str) -> DataFrame:
    return literal(spark, [("doc", text)], "path string, text string").withColumn("text", xml.cleaned(F.col("text")))


def xml_scrub_parse(spark, d):
    return iso(xml.vouchers(_docs(spark, _XML)).select("doc_order", "guid", "voucher_date", "voucher_type", "voucher_number", "amount", "is_cancelled"))


def xml_bill_allocations(spark, d):
    return V.bill_allocations(xml.vouchers(_docs(spark, _XML))).select("voucher_guid", "line_index", "ledger_name", "bill_ref", "amount")


def xml_masters(spark, d):
    return xml.names(_docs(spark, _MASTERS))


def ndjson_roundtrip(spark, d):
    """Suppliers written as compressed JSON lines by nation and read back."""
    s = table(spark, d, "supplier")
    path = f"{shared_dir(spark).rstrip('/')}/ndjson-{uuid.uuid4().hex}"
    ndjson.write(s, path, ["s_nationkey"])
    return ndjson.read(spark, path, s.schema).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def map_json_roundtrip(spark, d):
    """Balances as a map, to JSON and back."""
    c = table(spark, d, "customer").select("c_custkey", F.to_json(F.create_map(F.lit("OPENING"), "c_acctbal", F.lit("CLOSING"), F.col("c_acctbal") * 2)).alias("stored"))
    back = c.select("c_custkey", F.from_json("stored", "map<string,double>").alias("m"))
    return back.select("c_custkey", F.try_element_at("m", F.lit("OPENING")).alias("opening"), F.try_element_at("m", F.lit("CLOSING")).alias("closing"), F.size("m").cast("long").alias("n"))


def stream_daily_counts(spark, d):
    counts = pump.daily_counts(pump.source(spark, d, "events"), "ts", ["event_type"])
    return counts.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_upsert(spark, d):
    return pump.upserted(pump.source(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


def alert_throttle(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'")
    return pump.throttled(e, F.col("user_id") % 20, "ts", "event_id", 360)


def queries():
    made = [numeric_parse, bool_parse, date_parse, invalid_date_reject, id_sanitise, text_fallback, xml_escape, xml_scrub_parse, xml_bill_allocations, xml_masters, ndjson_roundtrip, map_json_roundtrip, stream_daily_counts, stream_upsert, alert_throttle]
    return {f.__name__: f for f in made}


def oracle_sql():
    v = lambda rows, *names: values_sql([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], ["i", *names])
    num = "coalesce(try_cast(regexp_replace(x, '[^0-9.\\-]', '', 'g') AS DOUBLE), 0)"
    day = """CASE WHEN regexp_full_match(trim(x, ' '), '\\d{4}-\\d{2}-\\d{2}|\\d{8}|\\d{2}/\\d{2}/\\d{4}|\\d{1,2}-[A-Za-z]{3}-\\d{4}')
  THEN strftime(coalesce(try_strptime(trim(x, ' '), '%Y-%m-%d'), try_strptime(trim(x, ' '), '%Y%m%d'), try_strptime(trim(x, ' '), '%d/%m/%Y'), try_strptime(trim(x, ' '), '%d-%b-%Y')), '%Y-%m-%d') END"""
    return {
        "numeric_parse": f"SELECT CAST(i AS BIGINT) AS i, {num} AS number, CAST(trunc({num}) AS BIGINT) AS whole FROM {v(_NUMBERS, 'x')}",
        "bool_parse": f"SELECT CAST(i AS BIGINT) AS i, coalesce(upper(trim(x)) IN ('YES', 'TRUE', '1'), false) AS flag FROM {v(_FLAGS, 'x')}",
        "date_parse": f"SELECT CAST(i AS BIGINT) AS i, {day} AS day, CASE WHEN regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_cast(x AS DATE) AS VARCHAR) END AS iso_day FROM {v(_DAYS, 'x')}",
        "invalid_date_reject": f"WITH b AS (SELECT unnest([window_from, window_to]) AS x FROM upload_batches) SELECT CASE WHEN x IS NULL THEN 'missing' WHEN {day} IS NULL THEN 'invalid' ELSE 'valid' END AS verdict, count(*) AS n FROM b GROUP BY 1",
        "id_sanitise": f"SELECT CAST(i AS BIGINT) AS i, CASE WHEN coalesce(trim(x), '') = '' THEN '_' ELSE left(regexp_replace(trim(x), '[^A-Za-z0-9._-]', '_', 'g'), 64) END AS safe_id FROM {v(_IDS, 'x')}",
        "text_fallback": f"SELECT CAST(i AS BIGINT) AS i, coalesce(trim(a), '') AS own, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), '') AS first FROM {v(_TEXTS, 'a', 'b')}",
        "xml_escape": "SELECT p_partkey, '&lt;' || p_name || '&amp;&apos;' || p_brand || '&quot;&gt;' AS escaped FROM part",
        "xml_scrub_parse": "SELECT CAST(o AS BIGINT) AS doc_order, guid, voucher_date, voucher_type, voucher_number, CAST(amount AS DOUBLE) AS amount, is_cancelled FROM (VALUES (0, 'AB-1', '2026-04-01', 'Sales', '1', -1250.5, true), (1, 'CD-2', '2026-04-02', '', '', 0, false)) AS t(o, guid, voucher_date, voucher_type, voucher_number, amount, is_cancelled)",
        "xml_bill_allocations": "SELECT g AS voucher_guid, CAST(k AS BIGINT) AS line_index, l AS ledger_name, r AS bill_ref, CAST(a AS DOUBLE) AS amount FROM (VALUES ('AB-1', 0, 'A & B', 'R1', 4), ('AB-1', 1, 'A & B', 'R2', 6), ('AB-1', 2, 'C', 'R3', 0), ('CD-2', 0, 'old shape', '', 0)) AS t(g, k, l, r, a)",
        "xml_masters": "SELECT * FROM (VALUES ('1', 'By attribute', 'P'), ('2', 'By child', '')) AS t(guid, name, parent)",
        "ndjson_roundtrip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
        "map_json_roundtrip": "SELECT c_custkey, c_acctbal AS opening, c_acctbal * 2 AS closing, CAST(2 AS BIGINT) AS n FROM customer",
        "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "stream_upsert": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
        "alert_throttle": """WITH RECURSIVE e AS (SELECT user_id % 20 AS k, epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'error'),
s AS (SELECT k, min(t) AS t FROM e GROUP BY k UNION ALL SELECT s.k, (SELECT min(e.t) FROM e WHERE e.k = s.k AND e.t >= s.t + 21600000000) FROM s WHERE EXISTS (SELECT 1 FROM e WHERE e.k = s.k AND e.t >= s.t + 21600000000))
SELECT CAST(s.k AS VARCHAR) AS alert_key, min(e.event_id) AS event_id FROM s JOIN e ON e.k = s.k AND e.t = s.t GROUP BY s.k, s.t""",
    }
