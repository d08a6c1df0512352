"""Gates, checkpoints, coverage, transitions and checks over the project's state tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstream.functions.text import plain, plain_or_null, real_day
from quillstream.operators import sync, warehouse
from quillstream.plans.problems import _day_sql
from quillstream.session import shared_dir, table

_TODAY, _TARGET, _NOW = "2026-06-30", "2026-04-01", "2026-06-30T00:00:00Z"


# ------------------------------------------------------------------- gates


def _seen(spark, d):
    """Each company's change marks: the highest alter_id of its voucher types and of its vouchers."""
    masters = table(spark, d, "voucher_types").groupBy(F.col("_company").alias("company")).agg(F.max("alter_id").alias("masters"))
    return masters.join(table(spark, d, "voucher_headers").groupBy(F.col("_company").alias("company")).agg(F.max("alter_id").alias("vouchers")), "company", "left")


def _gate_state(spark, d):
    """The marks stored at the gates: those of companies some run of which is done are up to date for masters, of the rest behind."""
    done = table(spark, d, "sync_checkpoints").groupBy("company").agg(F.max("full_sync_done").alias("done"), F.count_if(F.col("last_alter_id").isNull()).alias("unknown"))
    s = _seen(spark, d).join(done, "company", "left")
    marks = F.array(F.struct(F.lit(sync.GATES["masters"]).alias("dataset"), F.when(F.col("done") == 1, F.col("masters")).otherwise(F.col("masters") - 1).alias("last_alter_id")), F.struct(F.lit(sync.GATES["vouchers"]).alias("dataset"), F.when(F.col("unknown") % 2 == 0, F.col("vouchers")).alias("last_alter_id")))
    return s.select(F.concat(F.lit(" "), F.upper("company")).alias("company"), F.inline(marks))


_SEEN = """m AS (SELECT _company AS company, max(alter_id) AS masters FROM voucher_types GROUP BY 1), v AS (SELECT _company AS company, max(alter_id) AS vouchers FROM voucher_headers GROUP BY 1),
seen AS (SELECT m.company, masters, vouchers FROM m LEFT JOIN v ON v.company = m.company)"""
_GATE = f"""WITH {_SEEN}, c AS (SELECT company, max(full_sync_done) AS done, count(*) FILTER (last_alter_id IS NULL) AS unknown FROM sync_checkpoints GROUP BY 1),
held AS (SELECT s.company, CASE WHEN done = 1 THEN masters ELSE masters - 1 END AS hm, CASE WHEN unknown % 2 = 0 THEN vouchers END AS hv FROM seen s LEFT JOIN c ON c.company = s.company)
SELECT s.company, NOT coalesce(s.masters = hm, false) AS run_masters, NOT coalesce(s.vouchers = hv, false) AS run_vouchers FROM seen s LEFT JOIN held h ON h.company = s.company"""


def gate_phases(spark, d):
    """Which companies' masters and vouchers are walked again."""
    return sync.gates(_seen(spark, d), _gate_state(spark, d))


def gate_commit(spark, d):
    """The marks stored after each company's last run, whose batches that failed are failed datasets."""
    b = table(spark, d, "upload_batches").select("company", "sync_id", (F.col("status") == "failed").alias("failed"))
    last = b.groupBy("company").agg(F.max("sync_id").alias("sync_id"))
    return sync.gates_committed(_seen(spark, d), b.join(last, ["company", "sync_id"], "left_semi"), _NOW)


_COMMIT = f"""WITH {_SEEN}, l AS (SELECT company, max(sync_id) AS run FROM upload_batches GROUP BY 1), ok AS (SELECT b.company FROM upload_batches b JOIN l ON l.company = b.company AND l.run = b.sync_id GROUP BY 1 HAVING count(*) FILTER (status = 'failed') = 0),
k AS (SELECT * FROM seen WHERE company IN (SELECT company FROM ok WHERE company IS NOT NULL) AND masters IS NOT NULL AND vouchers IS NOT NULL)
SELECT company, '_alter_gate_masters' AS dataset, masters AS last_alter_id, '{_NOW}' AS last_success_utc, true AS full_sync_done FROM k UNION ALL SELECT company, '_alter_gate_vouchers', vouchers, '{_NOW}', true FROM k"""

# -------------------------------------------------------------- checkpoints


def _windows(spark, d):
    """Batches as walked windows: those of vouchers belong to a full walk, those without records are empty snapshots."""
    b = table(spark, d, "upload_batches").select("dataset", "company", real_day("window_from").alias("window_from"), real_day("window_to").alias("window_to"), (F.col("status") == "failed").alias("failed"), F.when(F.col("dataset").contains("balance"), F.coalesce("record_count", F.lit(0))).cast("long").alias("rows"))
    return b.filter("window_from <= window_to").withColumn("target", F.when(F.col("dataset").contains("voucher"), F.lit(_TARGET)).cast("date"))


_WINDOWS = f"""w AS (SELECT dataset, company, {_day_sql('window_from')} AS a, {_day_sql('window_to')} AS z, status = 'failed' AS failed, CASE WHEN contains(dataset, 'balance') THEN coalesce(record_count, 0) END AS n, record_count FROM upload_batches)"""


def _stored(spark, d):
    c = warehouse.latest(table(spark, d, "sync_checkpoints"), ["dataset", "company"], ["last_success_utc", "_sync_id", "last_alter_id", "last_to_date", "last_from_date", "full_sync_done"])
    return c.select("dataset", "company", real_day("last_from_date").alias("last_from"), real_day("last_to_date").alias("last_to"), F.col("last_alter_id").alias("marker"), (F.col("full_sync_done") == 1).alias("full_sync_done"))


def checkpoint_walk(spark, d):
    """The checkpoints after all windows of the batches were walked."""
    out = sync.advanced(_stored(spark, d), _windows(spark, d).filter("dataset is not null and company is not null"), F.lit(_TODAY).cast("date"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("last_from", "last_to")})


_WALKED = f"""WITH {_WINDOWS},
m AS (SELECT dataset, company, min(a) AS a, max(z) AS z, contains(dataset, 'voucher') AS is_full FROM w WHERE a <= z AND NOT coalesce(failed, false) AND (n IS NULL OR n > 0) AND dataset IS NOT NULL AND company IS NOT NULL GROUP BY ALL),
c AS (SELECT dataset, company, {_day_sql('last_from_date')} AS f, {_day_sql('last_to_date')} AS t, last_alter_id AS marker, coalesce(full_sync_done = 1, false) AS done FROM sync_checkpoints
  QUALIFY row_number() OVER (PARTITION BY dataset, company ORDER BY last_success_utc DESC NULLS LAST, _sync_id DESC NULLS LAST, last_alter_id DESC NULLS LAST, last_to_date DESC NULLS LAST, last_from_date DESC NULLS LAST, full_sync_done DESC NULLS LAST) = 1),
j AS (SELECT coalesce(c.dataset, m.dataset) AS dataset, coalesce(c.company, m.company) AS company, f, t, marker, coalesce(done, false) AS done, a, z, is_full FROM c FULL JOIN m ON m.dataset = c.dataset AND m.company = c.company)
SELECT dataset, company, strftime(CASE WHEN a IS NULL THEN f WHEN is_full THEN least(f, a) ELSE coalesce(f, a) END, '%Y-%m-%d') AS last_from, strftime(CASE WHEN a IS NULL THEN t WHEN is_full THEN greatest(t, z) ELSE z END, '%Y-%m-%d') AS last_to,
  CASE WHEN a IS NOT NULL AND is_full THEN 2 ELSE marker END AS marker, CASE WHEN a IS NULL THEN done WHEN is_full THEN least(f, a) <= DATE '{_TARGET}' ELSE done OR z >= DATE '{_TODAY}' END AS full_sync_done FROM j"""


def coverage_days(spark, d):
    """The evidence of the windows walked, appended to a table by two runs and summed up by dataset and company."""
    w = _windows(spark, d)
    path = f"{shared_dir(spark).rstrip('/')}/coverage-{uuid.uuid4().hex}"
    for run in ("first", "second"):
        part = w.filter("not failed") if run == "first" else w.filter("failed")
        sync.appended(sync.coverage(part, F.lit(run), F.lit(_NOW)), path)
    days = F.datediff("window_to", "window_from").cast("long") + 1
    return spark.read.parquet(path).groupBy("dataset", "company").agg(F.count_if("covered").alias("walked"), F.count_if(~F.col("covered")).alias("not_walked"), F.sum(days).alias("days"))


_COVERED = f"WITH {_WINDOWS} SELECT dataset, company, count(*) FILTER (NOT failed) AS walked, count(*) FILTER (failed) AS not_walked, CAST(sum(z - a + 1) AS BIGINT) AS days FROM w WHERE a <= z AND failed IS NOT NULL GROUP BY 1, 2"


def checkpoints_ordered(spark, d):
    """All stored checkpoints with their place by dataset and company."""
    c = _stored(spark, d).select("dataset", "company", "marker", "full_sync_done")
    return c.orderBy(F.col("dataset").asc_nulls_first(), F.col("company").asc_nulls_first())


# -------------------------------------------------------------- transitions

_QUEUE = ["batch_id", "sequence_no", "created_utc", "status", "retry_count", "next_attempt_utc", "last_error"]


def _queue(spark, d):
    return table(spark, d, "upload_batches").filter("batch_id is not null").select(*_QUEUE)


def retry_transition(spark, d):
    """Uploads that failed for now are tried again, those tried often are given up, and what was cut off waits again."""
    q = _queue(spark, d)
    fell = q.filter("status = 'uploading'").groupBy("batch_id").agg(F.max("retry_count").alias("n"))
    error = F.concat(F.lit("upload failed: "), F.repeat(F.lit("x"), F.lit(3000)))
    q = sync.rescheduled(q, fell.filter("n < 3").select("batch_id", error.alias("error"), F.lit(_NOW).alias("next_attempt_utc")))
    q = sync.failed_for_good(q, fell.filter("n >= 3").select("batch_id", F.lit("given up").alias("error")))
    return sync.recovered(q).select(*_QUEUE[:-1], F.length("last_error").alias("error_length"))


_RETRIED = f"""WITH f AS (SELECT batch_id, max(retry_count) AS n FROM upload_batches WHERE status = 'uploading' AND batch_id IS NOT NULL GROUP BY 1)
SELECT q.batch_id, sequence_no, created_utc, CASE WHEN n < 3 THEN 'pending' WHEN n >= 3 THEN 'failed' WHEN status = 'uploading' THEN 'pending' ELSE status END AS status, CASE WHEN n < 3 THEN coalesce(retry_count, 0) + 1 ELSE retry_count END AS retry_count,
  CASE WHEN n < 3 THEN '{_NOW}' ELSE next_attempt_utc END AS next_attempt_utc, CASE WHEN n < 3 THEN 2000 WHEN n >= 3 THEN 8 ELSE length(last_error) END AS error_length FROM upload_batches q LEFT JOIN f ON f.batch_id = q.batch_id WHERE q.batch_id IS NOT NULL"""


def requeue_failed(spark, d):
    return sync.requeued(_queue(spark, d))


def runs_closed(spark, d):
    """Runs that delivered are finished with their rows, the rest abandoned."""
    b = table(spark, d, "upload_batches").filter("sync_id is not null").groupBy("sync_id").agg(F.min("created_utc").alias("started_utc"), F.coalesce(F.sum(F.when(F.col("status") == "acked", F.col("record_count"))), F.lit(0)).alias("n"), F.count_if(F.col("status") == "failed").alias("bad"))
    none = F.lit(None).cast("string")
    runs = b.select("sync_id", "started_utc", none.alias("finished_utc"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("rows_total"), none.alias("error_message"))
    results = b.filter("n > 0").select("sync_id", F.lit(_NOW).alias("finished_utc"), F.when(F.col("bad") == 0, "success").otherwise("partial").alias("status"), F.col("n").alias("rows_total"), none.alias("error_message"))
    return sync.abandoned(sync.finished(runs, results))


_CLOSED = f"""WITH b AS (SELECT sync_id, min(created_utc) AS started_utc, CAST(coalesce(sum(record_count) FILTER (status = 'acked'), 0) AS BIGINT) AS n, count(*) FILTER (status = 'failed') AS bad FROM upload_batches WHERE sync_id IS NOT NULL GROUP BY 1)
SELECT sync_id, started_utc, CASE WHEN n > 0 THEN '{_NOW}' END AS finished_utc, CASE WHEN n = 0 THEN 'abandoned' WHEN bad = 0 THEN 'success' ELSE 'partial' END AS status, n AS rows_total, CASE WHEN n = 0 THEN 'process terminated mid-run' END AS error_message FROM b"""


def errors_reported(spark, d):
    """Errors appended with their texts cut, then marked as reported where their user has more than one."""
    e = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", F.col("props").alias("message"), F.lit(False).alias("reported"))
    path = f"{shared_dir(spark).rstrip('/')}/errors-{uuid.uuid4().hex}"
    sync.appended(e, path, {"message": 12})
    kept = spark.read.parquet(path)
    many = kept.groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 1")
    ids = kept.join(many, "user_id", "left_semi").select("event_id")
    return sync.marked(kept, ids, "event_id", "reported")


_REPORTED = "SELECT event_id, user_id, left(props, 12) AS message, count(*) OVER (PARTITION BY user_id) > 1 AS reported FROM events WHERE event_type = 'error'"


def queue_today(spark, d):
    """Batches that wait or are sent, failed ones, those acknowledged since the day began, and the bytes of all."""
    s = F.col("status")
    return table(spark, d, "upload_batches").agg(F.count_if(s.isin("pending", "uploading")).alias("waiting"), F.count_if(s == "failed").alias("failed"), F.count_if((s == "acked") & (F.col("created_utc") >= "2026-01-01")).alias("acked_today"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("payload_bytes"))


_STATS = "SELECT count(*) FILTER (status IN ('pending', 'uploading')) AS waiting, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'acked' AND created_utc >= '2026-01-01') AS acked_today, CAST(coalesce(sum(payload_bytes), 0) AS BIGINT) AS payload_bytes FROM upload_batches"


def company_resolved(spark, d):
    """The company of each dataset's checkpoints: the configured one, else the first of its batches."""
    found = table(spark, d, "upload_batches").filter("company is not null").groupBy("dataset").agg(F.sort_array(F.collect_set(F.trim("company"))).alias("discovered"))
    configured = F.when(F.col("dataset").contains("voucher"), F.lit(" Chosen ")).otherwise(F.lit("  "))
    return found.select("dataset", sync.resolved_company(configured, F.col("discovered")).alias("company"))


_RESOLVED = "SELECT dataset, CASE WHEN contains(dataset, 'voucher') THEN 'Chosen' ELSE min(trim(company, ' ')) FILTER (trim(company, ' ') <> '') END AS company FROM upload_batches WHERE company IS NOT NULL GROUP BY 1"


def snapshot_cadence(spark, d):
    """Deliveries of voucher types and whether the one before of the company fell on the same day, half past five hours east."""
    from pyspark.sql import Window

    runs = table(spark, d, "voucher_types").filter("_sync_timestamp is not null").groupBy("_company", "_sync_id").agg(F.min("_sync_timestamp").alias("at"))
    before = F.lag("at").over(Window.partitionBy("_company").orderBy("at", "_sync_id"))
    return runs.select("_company", "_sync_id", F.coalesce(sync.same_local_day(F.col("at"), before, "Asia/Kolkata"), F.lit(False)).alias("same_day"))


_CADENCE = """WITH r AS (SELECT _company, _sync_id, min(_sync_timestamp) AS seen FROM voucher_types WHERE _sync_timestamp IS NOT NULL GROUP BY 1, 2)
SELECT _company, _sync_id, coalesce(CAST(seen + INTERVAL 330 MINUTE AS DATE) = CAST(lag(seen) OVER (PARTITION BY _company ORDER BY seen, _sync_id NULLS FIRST) + INTERVAL 330 MINUTE AS DATE), false) AS same_day FROM r"""


def masters_off_cycle(spark, d):
    """Ledgers in a cycle that asks for balances of debtors only; the other balances are null."""
    led = table(spark, d, "ledgers").select("master_guid", "alter_id", "parent_group", "opening_balance", "closing_balance")
    return sync.toggled(led, ["opening_balance", "closing_balance"], F.col("parent_group").contains("Debtors"))


_OFF = "SELECT master_guid, alter_id, parent_group, CASE WHEN contains(parent_group, 'Debtors') THEN opening_balance END AS opening_balance, CASE WHEN contains(parent_group, 'Debtors') THEN closing_balance END AS closing_balance FROM ledgers"

# ----------------------------------------------------------- reconciliation


def _cents(c):
    return F.coalesce(F.col(c).try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def control_totals_bank(spark, d):
    """Records, debit, credit and gross turnover of the bank book by month."""
    b = table(spark, d, "bank_book").groupBy(F.coalesce(F.date_format("txn_date", "yyyy-MM"), F.lit("none")).alias("month"))
    total = lambda x, n: F.sum(x).cast("double").alias(n)
    return b.agg(F.count("*").alias("records"), total(_cents("debit"), "debit"), total(_cents("credit"), "credit"), total(F.abs(_cents("debit")) + F.abs(_cents("credit")), "gross"))


_D = "CAST(coalesce({}, 0) AS DECIMAL(18,2))"
_BANK = f"SELECT coalesce(strftime(txn_date, '%Y-%m'), 'none') AS month, count(*) AS records, CAST(sum({_D.format('debit')}) AS DOUBLE) AS debit, CAST(sum({_D.format('credit')}) AS DOUBLE) AS credit, CAST(sum(abs({_D.format('debit')}) + abs({_D.format('credit')})) AS DOUBLE) AS gross FROM bank_book GROUP BY 1"


def recon_gst(spark, d):
    """Tax by year and head in the registers against the tax in the lines, with their difference."""
    heads = {"A": "cgst", "N": "sgst", "R": "igst"}
    line = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy").alias("year"), "o_orderpriority"), "l_orderkey")
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    by = lambda rows: rows.groupBy("year").agg(*(F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, amount)), F.lit(0)).alias(n) for f, n in heads.items()))
    out = warehouse.compared(by(line), by(line.filter("left(o_orderpriority, 1) <> '4'")), ["year"], list(heads.values()))
    return out.select("year", *(F.col(f"{n}_{s}").cast("double").alias(f"{n}_{s}") for n in heads.values() for s in ("source", "target", "diff")))


_GST = """WITH t AS (SELECT strftime(o_orderdate, '%Y') AS year, l_returnflag AS f, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, left(o_orderpriority, 1) <> '4' AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT year, """ + ", ".join(f"coalesce(sum(a) FILTER (f = '{f}'), 0) AS {n}_source, coalesce(sum(a) FILTER (f = '{f}' AND r), 0) AS {n}_target" for f, n in (("A", "cgst"), ("N", "sgst"), ("R", "igst"))) + """ FROM t GROUP BY 1)
SELECT year, """ + ", ".join(f"CAST({n}_source AS DOUBLE) AS {n}_source, CAST({n}_target AS DOUBLE) AS {n}_target, CAST({n}_source - {n}_target AS DOUBLE) AS {n}_diff" for n in ("cgst", "sgst", "igst")) + " FROM s WHERE cgst_source <> cgst_target OR sgst_source <> sgst_target OR igst_source <> igst_target"


def recon_ledger_balances(spark, d):
    """Closing balances of ledgers as delivered last against those as delivered first, where they differ."""
    led = table(spark, d, "ledgers").select(plain_or_null("ledger_name").alias("ledger"), "alter_id", "_sync_timestamp", F.coalesce(F.col("closing_balance"), F.lit(0.0)).alias("closing")).filter("ledger is not null")
    pick = lambda how: led.groupBy("ledger").agg(how(F.struct("alter_id", "_sync_timestamp", "closing")).alias("v")).select("ledger", F.col("v.closing").cast("decimal(18,2)").alias("closing"))
    out = warehouse.compared(pick(F.max), pick(F.min), ["ledger"], ["closing"])
    return out.select("ledger", *(F.col(f"closing_{s}").cast("double").alias(f"closing_{s}") for s in ("source", "target", "diff")))


_LEDGERS = """WITH l AS (SELECT nullif(lower(trim(ledger_name, ' ' || chr(9))), '') AS ledger, alter_id, _sync_timestamp AS seen, coalesce(closing_balance, 0) AS c FROM ledgers),
x AS (SELECT ledger, CAST(first(c ORDER BY alter_id DESC NULLS LAST, seen DESC NULLS LAST, c DESC) AS DECIMAL(18,2)) AS a, CAST(first(c ORDER BY alter_id NULLS FIRST, seen NULLS FIRST, c) AS DECIMAL(18,2)) AS b FROM l WHERE ledger IS NOT NULL GROUP BY 1)
SELECT ledger, CAST(a AS DOUBLE) AS closing_source, CAST(b AS DOUBLE) AS closing_target, CAST(a - b AS DOUBLE) AS closing_diff FROM x WHERE a <> b"""


def recon_results(spark, d):
    """One row a check of the whole delivery: its two sides, their difference and whether it holds."""
    t = lambda n: table(spark, d, n)
    row = lambda df, name, a, b: df.agg(a.cast("double").alias("source"), b.cast("double").alias("target")).select(F.lit(name).alias("check_name"), "source", "target")
    total = lambda c: F.coalesce(F.sum(_cents(c)), F.lit(0))
    checks = [
        row(t("bank_book"), "bank_double_entry", total("debit"), total("credit")),
        row(t("voucher_headers"), "vouchers_once", F.count(plain_or_null("guid")), F.count_distinct(plain_or_null("guid"))),
        row(t("bill_allocations"), "bills_numbered", F.count("*"), F.count_distinct("row_id")),
        row(t("bill_allocations"), "bills_balanced", F.coalesce(F.sum(F.when(F.col("amount") > 0, _cents("amount"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("amount") < 0, -_cents("amount"))), F.lit(0))),
        row(t("ledgers"), "ledgers_once", F.count(plain_or_null("ledger_name")), F.count_distinct(plain_or_null("ledger_name"))),
        row(t("upload_batches"), "companies_plain", F.count_distinct("company"), F.count_distinct(plain("company"))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select("*", (F.col("source") - F.col("target")).alias("difference"), (F.col("source") == F.col("target")).alias("holds"))


_P = "nullif(lower(trim({}, ' ' || chr(9))), '')"
_RESULTS = f"""WITH r AS (SELECT 'bank_double_entry' AS check_name, CAST(coalesce(sum({_D.format('debit')}), 0) AS DOUBLE) AS source, CAST(coalesce(sum({_D.format('credit')}), 0) AS DOUBLE) AS target FROM bank_book
UNION ALL SELECT 'vouchers_once', count({_P.format('guid')}), count(DISTINCT {_P.format('guid')}) FROM voucher_headers UNION ALL SELECT 'bills_numbered', count(*), count(DISTINCT row_id) FROM bill_allocations
UNION ALL SELECT 'bills_balanced', CAST(coalesce(sum({_D.format('amount')}) FILTER (amount > 0), 0) AS DOUBLE), CAST(coalesce(-sum({_D.format('amount')}) FILTER (amount < 0), 0) AS DOUBLE) FROM bill_allocations
UNION ALL SELECT 'ledgers_once', count({_P.format('ledger_name')}), count(DISTINCT {_P.format('ledger_name')}) FROM ledgers UNION ALL SELECT 'companies_plain', count(DISTINCT company), count(DISTINCT lower(trim(company, ' ' || chr(9)))) FROM upload_batches)
SELECT *, source - target AS difference, source = target AS holds FROM r"""


def queries():
    made = [gate_phases, gate_commit, checkpoint_walk, coverage_days, checkpoints_ordered, retry_transition, requeue_failed, runs_closed, errors_reported, queue_today, company_resolved, snapshot_cadence, masters_off_cycle]
    made += [control_totals_bank, recon_gst, recon_ledger_balances, recon_results]
    return {f.__name__: f for f in made}


def oracle_sql():
    return {
        "gate_phases": _GATE, "gate_commit": _COMMIT, "checkpoint_walk": _WALKED, "coverage_days": _COVERED,
        "checkpoints_ordered": _WALKED[: _WALKED.index("j AS (")].rstrip().rstrip(",") + " SELECT dataset, company, marker, done AS full_sync_done FROM c",
        "retry_transition": _RETRIED,
        "requeue_failed": f"SELECT batch_id, sequence_no, created_utc, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, retry_count, CASE WHEN status IS DISTINCT FROM 'failed' THEN next_attempt_utc END AS next_attempt_utc, CASE WHEN status IS DISTINCT FROM 'failed' THEN last_error END AS last_error FROM upload_batches WHERE batch_id IS NOT NULL",
        "runs_closed": _CLOSED, "errors_reported": _REPORTED, "queue_today": _STATS, "company_resolved": _RESOLVED, "snapshot_cadence": _CADENCE, "masters_off_cycle": _OFF,
        "control_totals_bank": _BANK, "recon_gst": _GST, "recon_ledger_balances": _LEDGERS, "recon_results": _RESULTS,
    }
