"""Batches, queue, planning, warehouse upkeep and reconciliation as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import scalars as S
from quillstream.functions.text import plain, plain_or_null
from quillstream.operators import batches as B
from quillstream.operators import warehouse as W
from quillstream.plans import windows as P
from quillstream.plans.common import iso, iso_sql
from quillstream.session import table

# ------------------------------------------------------------------ batches


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy").alias("dataset"), F.floor(F.col("o_orderkey") / 1000).alias("bucket"), "o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderstatus")


def _slices(spark, d):
    return B.sliced(_orders(spark, d), ["dataset"], "bucket", ["o_orderkey"], 500)


def batch_slices(spark, d):
    return _slices(spark, d).groupBy("dataset", "slice_no").agg(F.count("*").alias("record_count"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def content_checksum(spark, d):
    rows = _slices(spark, d)
    return B.checksums(rows, ["dataset"], B.content_line(rows.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")))


def batch_id(spark, d):
    b = table(spark, d, "upload_batches")
    return b.select("batch_id", S.batch_id(F.lit("agent 01"), F.col("company"), F.col("dataset"), F.col("window_from"), F.col("window_to"), F.col("sequence_no"), F.col("checksum_sha256")).alias("made_id")).distinct()


_SLICED = "r AS (SELECT strftime(o_orderdate, '%Y') AS dataset, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y') ORDER BY o_orderkey) - 1 AS row_nr, * FROM orders), s AS (SELECT *, row_nr // 500 AS slice_no FROM r)"
_SAFE = "CASE WHEN coalesce(trim({0}, ' '), '') = '' THEN '{1}' ELSE left(regexp_replace(trim({0}, ' '), '[^A-Za-z0-9._-]', '_', 'g'), 64) END"

_ACTIVE = ["pending", "uploading", "failed"]


def _queue(spark, d):
    return table(spark, d, "upload_batches")


def next_sequence(spark, d):
    q = _queue(spark, d)
    return B.next_sequence(q.filter("status <> 'acked'"), q.filter("status = 'acked'"))


def equivalent_batch(spark, d):
    """Batches acknowledged, as if made anew, with the oldest one still active that equals them."""
    q = _queue(spark, d)
    keys = ["batch_id", "dataset", "company", "content_checksum", "record_count", "window_from", "window_to"]
    return B.equivalents(q.select(*keys).distinct(), q, _ACTIVE + ["acked"]).select("batch_id", "same_as")


_EQ = """WITH n AS (SELECT DISTINCT batch_id, dataset, company, content_checksum, record_count, window_from, window_to FROM upload_batches),
q AS (SELECT dataset, company, content_checksum, record_count, window_from, window_to, batch_id AS same_as FROM upload_batches WHERE status IN ('pending', 'uploading', 'failed', 'acked')
  QUALIFY row_number() OVER (PARTITION BY dataset, company, content_checksum, record_count, window_from, window_to ORDER BY created_utc NULLS FIRST, sequence_no, batch_id) = 1)
SELECT n.batch_id, q.same_as FROM n LEFT JOIN q ON n.dataset IS NOT DISTINCT FROM q.dataset AND n.company IS NOT DISTINCT FROM q.company AND n.content_checksum IS NOT DISTINCT FROM q.content_checksum
  AND n.record_count IS NOT DISTINCT FROM q.record_count AND n.window_from IS NOT DISTINCT FROM q.window_from AND n.window_to IS NOT DISTINCT FROM q.window_to"""


def dequeue_next(spark, d):
    """The oldest batch that is due."""
    due = _queue(spark, d).filter(F.col("status").isin("pending", "uploading") & (F.col("next_attempt_utc").isNull() | (F.col("next_attempt_utc") <= "2026-06-30T00:00:00Z")))
    return due.orderBy("created_utc", "sequence_no", "batch_id").limit(1).select("batch_id", "dataset", "created_utc")


def list_by_status(spark, d):
    return _queue(spark, d).filter("status = 'failed'").orderBy("created_utc", "batch_id").limit(50).select("batch_id", "status", "created_utc")


def queue_stats(spark, d):
    state = lambda s: F.count_if(F.col("status") == s).alias(s)
    return _queue(spark, d).agg(state("pending"), state("failed"), state("acked"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("payload_bytes"), F.max("created_utc").alias("last_created"), F.max_by("batch_id", F.struct("created_utc", "batch_id")).alias("last_batch"))


def _files(spark, d):
    """Payload files as a listing would give them: some are gone, some nobody knows."""
    known = _queue(spark, d).filter("sequence_no % 7 <> 0").select(F.col("payload_path").alias("path"), F.to_timestamp(F.lit("2026-06-30 12:00:00")).alias("modified"))
    loose = table(spark, d, "nation").select(F.concat(F.lit("queue/x/"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, ".tmp").otherwise(".ndjson.gz")).alias("path"), F.timestamp_seconds(F.lit(1782820800) - F.col("n_nationkey") * 600).alias("modified"))
    return known.unionByName(loose).distinct()


def orphan_payloads(spark, d):
    return B.orphan_payloads(_files(spark, d), _queue(spark, d), "2026-06-30 12:00:00").select("path")


def missing_payloads(spark, d):
    return B.missing_payloads(_queue(spark, d), _files(spark, d), ["pending", "uploading", "failed"]).select("batch_id", "payload_path", "status")


def ack_move(spark, d):
    """Sizes of queue and history after the batches of even number were acknowledged."""
    q = _queue(spark, d)
    left, kept = B.acknowledged(q.filter("status <> 'acked'"), q.filter("status = 'acked'"), q.filter("status <> 'acked' and sequence_no % 2 = 0"))
    return left.select(F.lit("queue").alias("side"), "batch_id", "sequence_no").unionByName(kept.select(F.lit("history").alias("side"), "batch_id", "sequence_no"))


def retry_backoff(spark, d):
    return _queue(spark, d).filter("retry_count > 0").select("batch_id", "retry_count", S.backoff_minutes(F.col("retry_count")).alias("wait_minutes"))


def purge_cutoff(spark, d):
    return _queue(spark, d).filter("created_utc >= '2026-01-01T00:00:00Z'").select("batch_id", "created_utc")


# --------------------------------------------------------------------- events


def error_groups(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").withColumn("message", F.concat("event_type", F.lit(" "), "props"))
    g = e.groupBy(S.group_key(F.col("event_type"), (F.col("user_id") % 20).cast("string"), F.lit("load")).alias("group_key"))
    return g.agg(F.count("*").alias("errors"), F.max("message").alias("highest_message"), F.max_by("message", F.struct("ts", "event_id")).alias("latest_message"))


def error_group_ids(spark, d):
    """The group of each error, a row each: a group may hold any number of them."""
    e = table(spark, d, "events").filter("event_type = 'error'")
    return e.select(S.group_key(F.col("event_type"), (F.col("user_id") % 20).cast("string"), F.lit("load")).alias("group_key"), "event_id")


def recent_errors(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(25).select("event_id", "user_id", "value")


def change_gate(spark, d):
    """Companies whose highest alter_id moved beyond their checkpoints."""
    seen = table(spark, d, "voucher_types").groupBy(F.col("_company").alias("company")).agg(F.max("alter_id").alias("seen"))
    stored = table(spark, d, "sync_checkpoints").filter("dataset = 'voucher_types'").groupBy("company").agg(F.max("last_alter_id").alias("stored"))
    return seen.join(stored, "company", "left").select("company", "seen", "stored", (F.col("seen").isNull() | F.col("stored").isNull() | (F.col("seen") != F.col("stored"))).alias("gate_open"))


def checkpoint_advance(spark, d):
    """The latest checkpoint of each dataset and company."""
    c = table(spark, d, "sync_checkpoints").select("dataset", "company", "last_success_utc", F.col("last_alter_id").cast("double").alias("last_alter_id"), "last_to_date", "_sync_id")
    return W.latest(c, ["dataset", "company"], ["last_success_utc", "_sync_id", "last_alter_id", "last_to_date"])


# ------------------------------------------------------------------- planning


def _plans(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.date_sub(F.lit("2026-07-30").cast("date"), F.col("n_nationkey") * 17).alias("start"), F.lit("2026-07-30").cast("date").alias("today"), F.date_sub(F.lit("2026-07-30").cast("date"), F.col("n_nationkey")).alias("last_to"))


def plan_full_windows(spark, d):
    return iso(P.full_windows(_plans(spark, d), "start", "today", 31).select("n_nationkey", F.col("ord").cast("long").alias("ord"), "window_from", "window_to"))


def plan_incremental(spark, d):
    start, gap = P.incremental_bounds(F.col("last_to"), F.col("today"), 7)
    p = P.forward_windows(_plans(spark, d).withColumn("first", start).withColumn("gap_days", gap), "first", "today", 5)
    return iso(p.select("n_nationkey", "gap_days", F.col("ord").cast("long").alias("ord"), "window_from", "window_to"))


def fy_start(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return iso(days.groupBy(S.fiscal_year_start(F.col("day")).alias("fiscal_year")).agg(F.count("*").alias("days"), F.min("day").alias("first_day")))


def window_split(spark, d):
    w = _plans(spark, d).withColumn("mid", F.expr("date_add(start, cast(floor(datediff(today, start) / 2) as int))"))
    both = F.when(F.col("start") == F.col("today"), F.array(F.struct(F.col("start").alias("a"), F.col("today").alias("b")))).otherwise(F.array(F.struct(F.col("start").alias("a"), F.col("mid").alias("b")), F.struct(F.date_add("mid", 1).alias("a"), F.col("today").alias("b"))))
    return iso(w.select("n_nationkey", F.posexplode(both).alias("part", "w")).select("n_nationkey", F.col("part").cast("long").alias("part"), F.col("w.a").alias("window_from"), F.col("w.b").alias("window_to")))


# ------------------------------------------------------------------ warehouse


def upsert_latest(spark, d):
    """Vouchers by guid: the row of the highest alter_id, of those the one delivered last."""
    v = table(spark, d, "voucher_headers").filter(plain_or_null("guid").isNotNull()).select("guid", "_company", "alter_id", "_sync_timestamp", "is_deleted", "amount")
    return W.latest(v.withColumn("guid", plain("guid")), ["_company", "guid"], ["alter_id", "_sync_timestamp"]).drop("_sync_timestamp")


def child_replace(spark, d):
    """Bill allocations: of each voucher the set of its last delivery."""
    b = table(spark, d, "bill_allocations").select(plain_or_null("voucher_guid").alias("voucher_guid"), "_company", "line_index", "row_id", "_sync_timestamp", "amount").filter("voucher_guid is not null")
    cut = F.lit("2026-01-01").cast("timestamp_ntz")
    return W.children_replaced(b.filter(F.col("_sync_timestamp") < cut), b.filter(F.col("_sync_timestamp") >= cut), ["voucher_guid"]).select("voucher_guid", "line_index", "row_id")


def snapshot_replace(spark, d):
    """The ledgers' state with the part of one group delivered anew."""
    led = table(spark, d, "ledgers").select("parent_group", "ledger_name", "closing_balance")
    new = led.filter("parent_group = 'Sundry Debtors'").withColumn("closing_balance", -F.col("closing_balance"))
    return W.snapshot_replaced(led, new, ["parent_group"])


def deletion_sweep(spark, d):
    """Orders without lines within a window are marked deleted."""
    h = table(spark, d, "orders").select(F.concat(F.lit("V-"), "o_orderkey").alias("guid"), F.col("o_orderdate").cast("date").alias("voucher_date"), F.lit(False).alias("is_deleted"), F.lit("active").alias("source_status"))
    m = table(spark, d, "lineitem").select(F.concat(F.lit("v-"), "l_orderkey").alias("guid"))
    return iso(W.swept(h, m, "1996-01-01", "1999-12-31"))


# -------------------------------------------------------------- reconciliation


def recon_counts(spark, d):
    """Vouchers a month and type in the source against those with lines, where they differ."""
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("kind"), "o_orderkey")
    with_lines = o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    count = lambda x: x.groupBy("month", "kind").agg(F.count("*").alias("vouchers"))
    return W.compared(count(o), count(with_lines), ["month", "kind"], ["vouchers"])


def recon_double_entry(spark, d):
    """Vouchers whose debits and credits differ."""
    side = lambda s, n: F.coalesce(F.sum(F.when(F.col("l_linestatus") == s, F.col("l_extendedprice").cast("decimal(18,2)"))), F.lit(0)).alias(n)
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(side("O", "debit"), side("F", "credit"))
    return sums.filter("debit <> credit").select("l_orderkey", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"), (F.col("debit") - F.col("credit")).cast("double").alias("difference"))


def recon_cancelled(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.count("*").alias("vouchers"), F.count_if(F.col("o_orderstatus") == "P").alias("cancelled"))


def recon_stock(spark, d):
    """Quantities by part taken from the lines against the sum of those by supplier, where they differ."""
    q = F.sum(F.col("l_quantity").cast("decimal(18,2)"))
    line = table(spark, d, "lineitem")
    a = line.groupBy("l_partkey").agg(q.alias("quantity"))
    b = line.filter("l_suppkey % 10 <> 3").groupBy("l_partkey").agg(q.alias("quantity"))
    out = W.compared(a, b, ["l_partkey"], ["quantity"])
    return out.select("l_partkey", *(F.col(f"quantity_{s}").cast("double").alias(f"quantity_{s}") for s in ("source", "target", "diff")))


def control_totals(spark, d):
    a = F.col("amount").cast("decimal(18,2)")
    v = table(spark, d, "voucher_headers")
    return v.groupBy(F.coalesce(F.date_format("voucher_date", "yyyy-MM"), F.lit("none")).alias("month")).agg(F.count("*").alias("records"), F.coalesce(F.sum(a), F.lit(0)).cast("double").alias("total"), F.coalesce(F.sum(F.abs(a)), F.lit(0)).cast("double").alias("gross"), F.count_if("is_cancelled").alias("cancelled"))


def count_validation(spark, d):
    """Tables that must not be empty if others have rows, checked on counts of one row each."""
    n = {t: table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("dataset"), "n") for t in ("ledgers", "voucher_headers", "bill_allocations", "bank_book")}
    counts = n["ledgers"]
    for t in ("voucher_headers", "bill_allocations", "bank_book"):
        counts = counts.unionByName(n[t])
    return counts.agg(F.max(F.when(F.col("dataset") == "ledgers", F.col("n"))).alias("ledgers"), F.sum(F.when(F.col("dataset") != "ledgers", F.col("n"))).alias("others")).select("ledgers", "others", F.when((F.col("others") > 0) & (F.col("ledgers") == 0), "no ledgers").otherwise("ok").alias("verdict"))


def company_match(spark, d):
    """Companies of batches that, plain, some voucher type delivery has too."""
    have = table(spark, d, "voucher_types").select(plain("_company").alias("company")).distinct()
    return _queue(spark, d).select(plain("company").alias("company")).distinct().join(have, "company", "left_semi")


def queries():
    made = [batch_slices, content_checksum, batch_id, next_sequence, equivalent_batch, dequeue_next, list_by_status, queue_stats, orphan_payloads, missing_payloads, ack_move, retry_backoff, purge_cutoff, error_groups, error_group_ids, recent_errors, change_gate, checkpoint_advance]
    made += [plan_full_windows, plan_incremental, fy_start, window_split, upsert_latest, child_replace, snapshot_replace, deletion_sweep, recon_counts, recon_double_entry, recon_cancelled, recon_stock, control_totals, count_validation, company_match]
    return {f.__name__: f for f in made}


def oracle_sql():
    files = """f AS (SELECT DISTINCT payload_path AS path, TIMESTAMP '2026-06-30 12:00:00' AS modified FROM upload_batches WHERE sequence_no % 7 <> 0
  UNION SELECT 'queue/x/' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.tmp' ELSE '.ndjson.gz' END, TIMESTAMP '2026-06-30 12:00:00' - INTERVAL 600 SECOND * n_nationkey FROM nation)"""
    plans = "p AS (SELECT n_nationkey, DATE '2026-07-30' - n_nationkey * 17 AS start, DATE '2026-07-30' AS today, DATE '2026-07-30' - n_nationkey AS last_to FROM nation)"
    return {
        "batch_slices": f"WITH {_SLICED} SELECT dataset, slice_no, count(*) AS record_count, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM s GROUP BY 1, 2",
        "content_checksum": f"WITH {_SLICED} SELECT dataset, slice_no, count(*) AS record_count, sha256(string_agg(o_custkey || '|' || o_orderkey || '|' || o_orderstatus || '|' || CAST(o_totalprice AS DECIMAL(18,2)), chr(10) ORDER BY row_nr)) AS content_checksum FROM s GROUP BY 1, 2",
        "batch_id": f"SELECT DISTINCT batch_id, 'agent_01-' || {_SAFE.format('company', '_')} || '-' || {_SAFE.format('dataset', '_')} || '-' || {_SAFE.format('window_from', 'na')} || '-' || {_SAFE.format('window_to', 'na')} || '-' || lpad(CAST(sequence_no AS VARCHAR), 6, '0') || '-' || lower(left(checksum_sha256, 12)) AS made_id FROM upload_batches",
        "next_sequence": "SELECT dataset, coalesce(max(sequence_no), 0) + 1 AS next_sequence FROM upload_batches GROUP BY 1",
        "equivalent_batch": _EQ,
        "dequeue_next": "SELECT batch_id, dataset, created_utc FROM upload_batches WHERE status IN ('pending', 'uploading') AND (next_attempt_utc IS NULL OR next_attempt_utc <= '2026-06-30T00:00:00Z') ORDER BY created_utc NULLS FIRST, sequence_no, batch_id LIMIT 1",
        "list_by_status": "SELECT batch_id, status, created_utc FROM upload_batches WHERE status = 'failed' ORDER BY created_utc NULLS FIRST, batch_id LIMIT 50",
        "queue_stats": "SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'acked') AS acked, CAST(coalesce(sum(payload_bytes), 0) AS BIGINT) AS payload_bytes, max(created_utc) AS last_created, arg_max(batch_id, (created_utc, batch_id)) AS last_batch FROM upload_batches",
        "orphan_payloads": f"WITH {files} SELECT path FROM f WHERE path NOT IN (SELECT payload_path FROM upload_batches WHERE payload_path IS NOT NULL) AND (path LIKE '%.tmp' OR modified < TIMESTAMP '2026-06-30 11:00:00')",
        "missing_payloads": f"WITH {files} SELECT batch_id, payload_path, status FROM upload_batches q WHERE status IN ('pending', 'uploading', 'failed') AND NOT EXISTS (SELECT 1 FROM f WHERE f.path = q.payload_path)",
        "ack_move": """WITH a AS (SELECT DISTINCT batch_id FROM upload_batches WHERE status <> 'acked' AND sequence_no % 2 = 0)
  SELECT 'queue' AS side, batch_id, sequence_no FROM upload_batches WHERE status <> 'acked' AND batch_id NOT IN (FROM a) UNION ALL SELECT 'history', batch_id, sequence_no FROM upload_batches WHERE status = 'acked' AND batch_id NOT IN (FROM a)
  UNION ALL SELECT 'history', batch_id, sequence_no FROM upload_batches WHERE status <> 'acked' AND batch_id IN (FROM a)""",
        "retry_backoff": "SELECT batch_id, retry_count, CAST(least(pow(2, least(retry_count, 20)), 30) AS DOUBLE) AS wait_minutes FROM upload_batches WHERE retry_count > 0",
        "purge_cutoff": "SELECT batch_id, created_utc FROM upload_batches WHERE created_utc >= '2026-01-01T00:00:00Z'",
        "error_groups": """WITH e AS (SELECT *, event_type || ' ' || props AS message, upper(left(sha256(concat_ws('|', event_type, CAST(user_id % 20 AS VARCHAR), 'load')), 16)) AS group_key FROM events WHERE event_type = 'error')
  SELECT group_key, count(*) AS errors, max(message) AS highest_message, arg_max(message, (ts, event_id)) AS latest_message FROM e GROUP BY 1""",
        "error_group_ids": "SELECT upper(left(sha256(concat_ws('|', event_type, CAST(user_id % 20 AS VARCHAR), 'load')), 16)) AS group_key, event_id FROM events WHERE event_type = 'error'",
        "recent_errors": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25",
        "change_gate": "WITH s AS (SELECT _company AS company, max(alter_id) AS seen FROM voucher_types GROUP BY 1), c AS (SELECT company, max(last_alter_id) AS stored FROM sync_checkpoints WHERE dataset = 'voucher_types' GROUP BY 1) SELECT s.company, seen, stored, seen IS NULL OR stored IS NULL OR seen <> stored AS gate_open FROM s LEFT JOIN c ON c.company = s.company",
        "checkpoint_advance": "SELECT dataset, company, last_success_utc, CAST(last_alter_id AS DOUBLE) AS last_alter_id, last_to_date, _sync_id FROM sync_checkpoints QUALIFY row_number() OVER (PARTITION BY dataset, company ORDER BY last_success_utc DESC NULLS LAST, _sync_id DESC NULLS LAST, last_alter_id DESC NULLS LAST, last_to_date DESC NULLS LAST) = 1",
        "plan_full_windows": iso_sql(f"WITH {plans} SELECT n_nationkey, k AS ord, greatest(start, today - CAST(k * 31 AS INTEGER) - 30) AS window_from, today - CAST(k * 31 AS INTEGER) AS window_to FROM p, unnest(range(0, (today - start) // 31 + 1)) AS u(k)", "window_from", "window_to"),
        "plan_incremental": iso_sql(f"""WITH {plans}, b AS (SELECT *, least(last_to + 1, today) AS resume, today - 7 AS back FROM p), c AS (SELECT *, least(resume, back) AS first, greatest(CAST(back - resume AS INTEGER), 0) AS gap_days FROM b)
  SELECT n_nationkey, gap_days, k AS ord, first + CAST(k * 5 AS INTEGER) AS window_from, least(today, first + CAST(k * 5 AS INTEGER) + 4) AS window_to FROM c, unnest(range(0, (today - first) // 5 + 1)) AS u(k)""", "window_from", "window_to"),
        "fy_start": iso_sql("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT make_date(year(day) - CASE WHEN month(day) < 4 THEN 1 ELSE 0 END, 4, 1) AS fiscal_year, count(*) AS days, min(day) AS first_day FROM d GROUP BY 1", "fiscal_year", "first_day"),
        "window_split": iso_sql(f"""WITH {plans}, m AS (SELECT *, start + CAST((today - start) // 2 AS INTEGER) AS mid FROM p) SELECT n_nationkey, CAST(0 AS BIGINT) AS part, start AS window_from, CASE WHEN start = today THEN today ELSE mid END AS window_to FROM m
  UNION ALL SELECT n_nationkey, 1, mid + 1, today FROM m WHERE start <> today""", "window_from", "window_to"),
        "upsert_latest": "SELECT lower(trim(guid, ' ' || chr(9))) AS guid, _company, alter_id, is_deleted, amount FROM voucher_headers WHERE trim(coalesce(guid, ''), ' ' || chr(9)) <> '' QUALIFY row_number() OVER (PARTITION BY _company, lower(trim(guid, ' ' || chr(9))) ORDER BY alter_id DESC NULLS LAST, _sync_timestamp DESC NULLS LAST, is_deleted DESC NULLS LAST, amount DESC NULLS LAST) = 1",
        "child_replace": """WITH b AS (SELECT nullif(lower(trim(voucher_guid, ' ' || chr(9))), '') AS voucher_guid, line_index, row_id, _sync_timestamp >= TIMESTAMP '2026-01-01' AS new FROM bill_allocations WHERE _sync_timestamp IS NOT NULL)
  SELECT voucher_guid, line_index, row_id FROM b WHERE voucher_guid IS NOT NULL AND (new OR voucher_guid NOT IN (SELECT voucher_guid FROM b WHERE new AND voucher_guid IS NOT NULL))""",
        "snapshot_replace": "SELECT parent_group, ledger_name, CASE WHEN parent_group = 'Sundry Debtors' THEN -closing_balance ELSE closing_balance END AS closing_balance FROM ledgers",
        "deletion_sweep": iso_sql("""SELECT 'V-' || o_orderkey AS guid, CAST(o_orderdate AS DATE) AS voucher_date, g AS is_deleted, CASE WHEN g THEN 'deleted' ELSE 'active' END AS source_status FROM (SELECT *, CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS g FROM orders)""", "voucher_date"),
        "recon_counts": """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS kind, count(*) AS a, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS b FROM orders GROUP BY 1, 2) SELECT month, kind, a AS vouchers_source, b AS vouchers_target, a - b AS vouchers_diff FROM o WHERE a <> b""",
        "recon_double_entry": """WITH s AS (SELECT l_orderkey, coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_linestatus = 'O'), 0) AS debit, coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_linestatus = 'F'), 0) AS credit FROM lineitem GROUP BY 1)
  SELECT l_orderkey, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, CAST(debit - credit AS DOUBLE) AS difference FROM s WHERE debit <> credit""",
        "recon_cancelled": "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS vouchers, count(*) FILTER (o_orderstatus = 'P') AS cancelled FROM orders GROUP BY 1",
        "recon_stock": """WITH q AS (SELECT l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS a, coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_suppkey % 10 <> 3), 0) AS b FROM lineitem GROUP BY 1)
  SELECT l_partkey, CAST(a AS DOUBLE) AS quantity_source, CAST(b AS DOUBLE) AS quantity_target, CAST(a - b AS DOUBLE) AS quantity_diff FROM q WHERE a <> b""",
        "control_totals": "SELECT coalesce(strftime(voucher_date, '%Y-%m'), 'none') AS month, count(*) AS records, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS total, CAST(coalesce(sum(abs(CAST(amount AS DECIMAL(18,2)))), 0) AS DOUBLE) AS gross, count(*) FILTER (is_cancelled) AS cancelled FROM voucher_headers GROUP BY 1",
        "count_validation": "SELECT l AS ledgers, o AS others, CASE WHEN o > 0 AND l = 0 THEN 'no ledgers' ELSE 'ok' END AS verdict FROM (SELECT (SELECT count(*) FROM ledgers) AS l, (SELECT count(*) FROM voucher_headers) + (SELECT count(*) FROM bill_allocations) + (SELECT count(*) FROM bank_book) AS o)",
        "company_match": "SELECT DISTINCT lower(trim(company, ' ' || chr(9))) AS company FROM upload_batches WHERE lower(trim(company, ' ' || chr(9))) IN (SELECT lower(trim(_company, ' ' || chr(9))) FROM voucher_types)",
    }
