"""The general data problems 1 to 6 as queries over the project's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.text import number, plain_or_null, real_day
from quillstream.operators import hierarchy as tree
from quillstream.operators import intervals, nested, references, rolling, snapshots
from quillstream.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------- 1: intervals


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "upload_batches").select("company", "dataset", real_day("window_from").alias("a"), real_day("window_to").alias("b"))
    spans = intervals.periods_and_gaps(b, ["company", "dataset"], "a", "b")
    return spans.select("company", "dataset", "span_kind", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("day_from", "day_to")))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Days covered and left out, and the number of periods and gaps, by company and dataset."""
    spans = p1_found(spark, d)
    days = F.datediff(F.to_date("day_to"), F.to_date("day_from")).cast("long") + 1
    kind = lambda k: F.col("span_kind") == k
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return spans.groupBy("company", "dataset").agg(
        F.count_if(kind("period")).alias("periods"), F.count_if(kind("gap")).alias("gaps"),
        zero(F.sum(F.when(kind("period"), days))).alias("days_covered"), zero(F.sum(F.when(kind("gap"), days))).alias("days_left_out"),
    )


_DAY = """CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(t AS DATE)
  WHEN regexp_full_match(t, '\\d{8}') THEN try_cast(t[1:4] || '-' || t[5:6] || '-' || t[7:8] AS DATE)
  WHEN regexp_full_match(t, '\\d{2}/\\d{2}/\\d{4}') THEN try_cast(t[7:10] || '-' || t[4:5] || '-' || t[1:2] AS DATE)
  WHEN regexp_full_match(t, '\\d{1,2}-[A-Za-z]{3}-\\d{4}') THEN CAST(try_strptime(t, '%d-%b-%Y') AS DATE) END"""


def _day_sql(column: str) -> str:
    return _DAY.replace("(t,", f"(trim({column}, ' '),").replace("t[", f"trim({column}, ' ')[").replace("cast(t ", f"cast(trim({column}, ' ') ")


_P1 = f"""WITH b AS (SELECT DISTINCT company, dataset, {_day_sql('window_from')} AS a, {_day_sql('window_to')} AS z FROM upload_batches),
o AS (SELECT *, max(z) OVER (PARTITION BY company, dataset ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM b WHERE a <= z),
n AS (SELECT *, sum(CASE WHEN a <= reached + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY company, dataset ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run FROM o),
p AS (SELECT company, dataset, min(a) AS a, max(z) AS z FROM n GROUP BY company, dataset, run),
g AS (SELECT company, dataset, z + 1 AS a, lead(a) OVER (PARTITION BY company, dataset ORDER BY a) - 1 AS z FROM p),
spans AS (SELECT company, dataset, 'period' AS span_kind, a, z FROM p UNION ALL SELECT company, dataset, 'gap', a, z FROM g WHERE z IS NOT NULL)"""

# -------------------------------------------------------------- 2: hierarchies


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    cc = table(spark, d, "cost_centres").select(plain_or_null("master_guid").alias("id"), F.struct(F.col("alter_id"), F.col("_sync_timestamp"), F.col("_company").alias("scope"), plain_or_null("cost_centre_name").alias("name"), plain_or_null("parent").alias("parent")).alias("v"))
    cc = cc.filter("id is not null").groupBy("id").agg(F.max("v").alias("v")).select(F.lit("cost_centres").alias("tree"), "v.scope", "id", "v.name", "v.parent").filter("name is not null")
    kept = _voucher_type_deliveries(spark, d)
    vt = snapshots.versions(table(spark, d, "voucher_types"), "_company", "_sync_id", "master_guid", ["alter_id", "_sync_timestamp"], ["voucher_type_name", "parent"], kept.filter("next_run is null"))
    vt = vt.select(F.lit("voucher_types").alias("tree"), F.col("company").alias("scope"), F.col("key").alias("id"), plain_or_null("voucher_type_name").alias("name"), plain_or_null("parent").alias("parent"))
    return cut(cc.unionByName(vt))


def _renamed(h: DataFrame) -> DataFrame:
    return h.select(F.col("tree").alias("tree_name"), F.col("scope").alias("company"), F.col("id").alias("node_guid"), F.col("root_id").alias("root_guid"), F.col("depth").alias("node_depth"), *(F.col(c).alias("node_path") for c in h.columns if c == "path"), *(c for c in ("parent_id", "closes_loop") if c in h.columns))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _renamed(tree.hierarchy(_nodes(spark, d), paths=False, loops=False)).select("tree_name", "company", "node_guid", "root_guid", "node_depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The names from the root down to each node, null for nodes caught in a loop."""
    return _renamed(tree.hierarchy(_nodes(spark, d), loops=False)).select("tree_name", "company", "node_guid", "node_path")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a node and one below it, with their distance."""
    return tree.descendants(_nodes(spark, d)).select(F.col("tree").alias("tree_name"), F.col("scope").alias("company"), "ancestor_id", "descendant_id", "distance")


def p2_loops(spark: SparkSession, d: str) -> DataFrame:
    """One edge of each loop, from node_guid back to its parent, that closes it."""
    return _renamed(tree.hierarchy(_nodes(spark, d), paths=False)).filter("closes_loop").select("tree_name", "company", "node_guid", F.col("parent_id").alias("parent_guid"))


_PLAIN = "lower(trim({}, ' ' || chr(9)))"


def _plain_sql(c: str) -> str:
    return f"nullif({_PLAIN.format(c)}, '')"


_KEPT = """done AS (SELECT DISTINCT company, _sync_id FROM sync_checkpoints WHERE dataset = 'voucher_types' AND full_sync_done = 1),
seen AS (SELECT _company AS company, _sync_id AS run, min(_sync_timestamp) AS seen_at FROM voucher_types v WHERE EXISTS (SELECT 1 FROM done WHERE done.company = v._company AND done._sync_id = v._sync_id) GROUP BY ALL),
kept AS (SELECT company, run, row_number() OVER (PARTITION BY company ORDER BY seen_at, run) AS nr, lead(run) OVER (PARTITION BY company ORDER BY seen_at, run) AS next_run FROM seen)"""
_P2 = f"""WITH RECURSIVE {_KEPT},
cc AS (SELECT {_plain_sql('master_guid')} AS id, arg_max(struct_pack(company := _company, name := {_plain_sql('cost_centre_name')}, parent := {_plain_sql('parent')}), (alter_id, _sync_timestamp)) AS v FROM cost_centres GROUP BY 1),
vt AS (SELECT kept.company, {_plain_sql('master_guid')} AS id, arg_max(struct_pack(name := {_plain_sql('voucher_type_name')}, parent := {_plain_sql('parent')}), (alter_id, _sync_timestamp)) AS v
  FROM voucher_types t JOIN kept ON kept.company = t._company AND kept.run = t._sync_id AND kept.next_run IS NULL GROUP BY 1, 2),
n AS (SELECT 'cost_centres' AS tree, v.company AS company, id, v.name AS name, v.parent AS parent FROM cc WHERE id IS NOT NULL AND v.name IS NOT NULL
  UNION ALL SELECT 'voucher_types', company, id, v.name, v.parent FROM vt WHERE id IS NOT NULL),
names AS (SELECT tree, company, name, min(id) AS id FROM n WHERE name IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT n.*, names.id AS up FROM n LEFT JOIN names ON n.tree = names.tree AND n.company = names.company AND n.parent = names.name),
walk AS (SELECT tree, company, id, id AS root, 0 AS depth, coalesce(name, '') AS path FROM e WHERE up IS NULL
  UNION ALL SELECT e.tree, e.company, e.id, w.root, w.depth + 1, w.path || ' / ' || coalesce(e.name, '') FROM walk w JOIN e ON e.tree = w.tree AND e.company = w.company AND e.up = w.id),
pairs AS (SELECT e.tree, e.company, e.up AS ancestor_id, e.id AS descendant_id, 1 AS distance FROM e JOIN walk w ON w.tree = e.tree AND w.company = e.company AND w.id = e.id WHERE e.up IS NOT NULL
  UNION ALL SELECT p.tree, p.company, e.up, p.descendant_id, p.distance + 1 FROM pairs p JOIN e ON e.tree = p.tree AND e.company = p.company AND e.id = p.ancestor_id WHERE e.up IS NOT NULL)"""

# from every node caught in a loop to all it reaches by going up
_P2_LOOPS = f"""{_P2}, caught AS (SELECT e.* FROM e WHERE e.up IS NOT NULL AND NOT EXISTS (SELECT 1 FROM walk w WHERE w.tree = e.tree AND w.company = e.company AND w.id = e.id)),
climb AS (SELECT tree, company, id AS start, up AS reached FROM caught UNION SELECT c.tree, c.company, c.start, e.up FROM climb c JOIN caught e ON e.tree = c.tree AND e.company = c.company AND e.id = c.reached),
low AS (SELECT tree, company, start, min(reached) AS least, bool_or(reached = start) AS on_loop FROM climb GROUP BY 1, 2, 3)"""

# ------------------------------------------------------------------- 3: nested


def _with(spark: SparkSession, d: str, *children: str, **wanted: object) -> DataFrame:
    return nested.vouchers(table(spark, d, "raw_messages"), children=children, **({"head": []} | wanted))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    bills = _with(spark, d, nested.BILLS, entry=[], texts={nested.BILLS: ["NAME"]})
    return nested.child_table(bills, "bills", {"name": "bill_ref"}, ledger=False).select("voucher_guid", "line_index", "bill_ref")


def p3_vouchers(spark: SparkSession, d: str) -> DataFrame:
    return nested.voucher_table(_with(spark, d, head=nested.VOUCHER_TEXTS[1:], entry=["LEDGERNAME"])).select("voucher_guid", "msg_no", F.col("date").alias("date_text"), F.col("vouchertypename").alias("voucher_type"), F.col("vouchernumber").alias("voucher_number"), "narration")


def p3_ledger_entries(spark: SparkSession, d: str) -> DataFrame:
    return nested.entry_table(_with(spark, d)).withColumn("amount", number("amount"))


def p3_bill_allocations(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_table(_with(spark, d, nested.BILLS, entry=["LEDGERNAME"]), "bills", {"name": "bill_ref", "billtype": "bill_type", "amount": "amount"}).withColumn("amount", number("amount"))


def p3_bank_allocations(spark: SparkSession, d: str) -> DataFrame:
    v = _with(spark, d, nested.BANKS, entry=["LEDGERNAME"])
    return nested.child_table(v, "banks", {"transactiontype": "transaction_type", "instrumentnumber": "instrument_number", "amount": "amount"}).withColumn("amount", number("amount"))


def p3_cost_centre_allocations(spark: SparkSession, d: str) -> DataFrame:
    v = _with(spark, d, nested.COSTS, entry=["LEDGERNAME"])
    return nested.child_table(v, "costs", {"category": "cost_category", "name": "cost_centre", "amount": "amount"}).withColumn("amount", number("amount"))


def _list_sql(x: str) -> str:
    """The objects of a JSON value that may be an array, an object or nothing, as a list."""
    return f"list_filter(CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] ELSE [] END, lambda j: json_type(j) = 'OBJECT')"


_BILLS_OF = _list_sql("""json_extract(e, '$."BILLALLOCATIONS.LIST"')""").replace("lambda j", "lambda q").replace("json_type(j)", "json_type(q)")
_P3_VOUCHERS = f"""docs AS (SELECT coalesce(msg_no, 9223372036854775807) AS msg_no, CAST(body AS JSON) AS j FROM raw_messages WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
inner_lists AS (SELECT msg_no, {_list_sql("json_extract(j, '$.VOUCHER')")} AS a, {_list_sql("json_extract(j, '$.ENVELOPE.BODY.DATA.TALLYMESSAGE')")} AS m FROM docs),
listed AS (SELECT msg_no, list_concat(a, flatten(list_transform(m, lambda t: {_list_sql("json_extract(t, '$.VOUCHER')").replace("lambda j", "lambda r").replace("json_type(j)", "json_type(r)")}))) AS l FROM inner_lists),
one AS (SELECT msg_no, unnest(l) AS v, unnest(range(len(l))) AS pos FROM listed),
keyed AS (SELECT *, {_plain_sql("json_extract_string(v, '$.GUID')")} AS voucher_guid FROM one),
firsts AS (SELECT *, {_list_sql('''json_extract(v, '$."ALLLEDGERENTRIES.LIST"')''')} AS ea, {_list_sql('''json_extract(v, '$."LEDGERENTRIES.LIST"')''')} AS eo FROM keyed WHERE voucher_guid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY voucher_guid ORDER BY msg_no, pos) = 1),
entries AS (SELECT voucher_guid, msg_no, v, CASE WHEN len(ea) > 0 THEN ea ELSE eo END AS es FROM firsts),
each_entry AS (SELECT voucher_guid, unnest(es) AS e, unnest(range(len(es))) AS entry_index FROM entries)"""
_P3_BILLS = f"""{_P3_VOUCHERS},
bills AS (SELECT voucher_guid, entry_index, coalesce(trim(json_extract_string(e, '$.LEDGERNAME'), ' '), '') AS ledger_name, unnest({_BILLS_OF}) AS b, unnest(range(len({_BILLS_OF}))) AS k FROM each_entry),
numbered AS (SELECT *, row_number() OVER (PARTITION BY voucher_guid ORDER BY entry_index, k) - 1 AS line_index FROM bills)"""


def _inner_list_sql(x: str, name: str) -> str:
    return _list_sql(x).replace("lambda j", f"lambda {name}").replace("json_type(j)", f"json_type({name})")


_BANKS_OF = _inner_list_sql("""json_extract(e, '$."BANKALLOCATIONS.LIST"')""", "q")
_DIRECT_OF = _inner_list_sql("""json_extract(e, '$."COSTCENTREALLOCATIONS.LIST"')""", "q")
_CATEGORIES_OF = _inner_list_sql("""json_extract(e, '$."CATEGORYALLOCATIONS.LIST"')""", "q")
_CENTRES_OF = _inner_list_sql("""json_extract(g, '$."COSTCENTREALLOCATIONS.LIST"')""", "q")
_P3_BANKS = f"""{_P3_VOUCHERS},
banks AS (SELECT voucher_guid, entry_index, e, unnest({_BANKS_OF}) AS b, unnest(range(len({_BANKS_OF}))) AS k FROM each_entry),
numbered AS (SELECT *, row_number() OVER (PARTITION BY voucher_guid ORDER BY entry_index, k) - 1 AS line_index FROM banks)"""
_P3_COSTS = f"""{_P3_VOUCHERS},
direct AS (SELECT voucher_guid, entry_index, e, 0 AS part, 0 AS gi, unnest({_DIRECT_OF}) AS b, unnest(range(len({_DIRECT_OF}))) AS k, '' AS cost_category FROM each_entry),
categories AS (SELECT voucher_guid, entry_index, e, unnest({_CATEGORIES_OF}) AS g, unnest(range(len({_CATEGORIES_OF}))) AS gi FROM each_entry),
costs AS (SELECT * FROM direct UNION ALL SELECT voucher_guid, entry_index, e, 1, gi, unnest({_CENTRES_OF}), unnest(range(len({_CENTRES_OF}))), coalesce(trim(json_extract_string(g, '$.CATEGORY'), ' '), '') FROM categories),
numbered AS (SELECT *, row_number() OVER (PARTITION BY voucher_guid ORDER BY entry_index, part, gi, k) - 1 AS line_index FROM costs)"""
_TEXT = "coalesce(trim(json_extract_string({}, '$.{}'), ' '), '')"

_NUMBER = "coalesce(try_cast(regexp_replace({}, '[^0-9.\\-]', '', 'g') AS DOUBLE), 0)"

# ------------------------------------------------------------------ 4: rolling

P4_LENGTHS = [7, 30]


def _bank_runs(spark: SparkSession, d: str, amounts: list[str]) -> DataFrame:
    rows = table(spark, d, "bank_book").filter("txn_date is not null")
    rows = rows.filter(plain_or_null("bank_account").isNotNull())
    once = rolling.unrepeated(rows, ["row_id", "_sync_timestamp", "_sync_id"], ["_company", "bank_account", "txn_date", "debit", "credit"])
    turnover = F.coalesce("debit", F.lit(0.0)).try_cast("decimal(18,2)") + F.coalesce("credit", F.lit(0.0)).try_cast("decimal(18,2)")
    named = once.select(F.col("_company").alias("company"), plain_or_null("bank_account").alias("bank_account"), "txn_date", "debit", "credit", turnover.alias("turnover"))
    return rolling.trailing_runs(named, ["company", "bank_account"], "txn_date", amounts, P4_LENGTHS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    runs = _bank_runs(spark, d, ["turnover"])
    # turnover_7 / 7 > 3 * turnover_30 / 30, without division
    steep = runs.filter(F.col("turnover_7") * 10 > F.col("turnover_30") * 7)
    days = rolling.each_day(steep, F.date_add("first_day", 29))
    return days.select("company", "bank_account", F.date_format("day_on", "yyyy-MM-dd").alias("day_on"))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of debit and credit over 7 and 30 days for every day of every account."""
    days = rolling.each_day(_bank_runs(spark, d, ["debit", "credit"]))
    cols = [F.col(f"{a}_{n}").cast("double").alias(f"{a}_total_{n}") for a in ("debit", "credit") for n in P4_LENGTHS]
    means = [(F.col(f"{a}_{n}").cast("double") / n).alias(f"{a}_mean_{n}") for a in ("debit", "credit") for n in P4_LENGTHS]
    return days.select("company", "bank_account", F.date_format("day_on", "yyyy-MM-dd").alias("day_on"), *cols, *means)


_P4 = f"""WITH once AS (SELECT DISTINCT * EXCLUDE (row_id, _sync_timestamp, _sync_id) FROM bank_book WHERE txn_date IS NOT NULL AND {_plain_sql('bank_account')} IS NOT NULL),
daily AS (SELECT _company AS company, {_plain_sql('bank_account')} AS bank_account, txn_date AS d, sum(CAST(coalesce(debit, 0) AS DECIMAL(18,2))) AS debit, sum(CAST(coalesce(credit, 0) AS DECIMAL(18,2))) AS credit FROM once GROUP BY 1, 2, 3),
bounds AS (SELECT company, bank_account, min(d) AS a, max(d) AS z FROM daily GROUP BY 1, 2),
calendar AS (SELECT company, bank_account, a, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM bounds),
filled AS (SELECT c.company, c.bank_account, c.a, c.d, coalesce(debit, 0) AS debit, coalesce(credit, 0) AS credit FROM calendar c LEFT JOIN daily x ON x.company = c.company AND x.bank_account = c.bank_account AND x.d = c.d),
rolled AS (SELECT *, sum(debit) OVER w7 AS debit_7, sum(debit) OVER w30 AS debit_30, sum(credit) OVER w7 AS credit_7, sum(credit) OVER w30 AS credit_30 FROM filled
  WINDOW w7 AS (PARTITION BY company, bank_account ORDER BY d ROWS 6 PRECEDING), w30 AS (PARTITION BY company, bank_account ORDER BY d ROWS 29 PRECEDING))"""

# --------------------------------------------------------------- 5: references


def _references(spark: SparkSession, d: str) -> DataFrame:
    month = lambda c: F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("none"))
    ref = lambda field, target: F.struct(F.lit(field).alias("src_field"), F.lit(target).alias("target"), plain_or_null(field).alias("key"))
    ba = table(spark, d, "bill_allocations").select(
        F.lit("bill_allocations").alias("src_table"), month("voucher_date").alias("month_of"), "row_id", F.col("_sync_timestamp").alias("at"),
        F.inline(F.array(ref("voucher_guid", "voucher_headers"), ref("ledger_name", "ledgers"))),
    )
    bb = table(spark, d, "bank_book").select(
        F.lit("bank_book").alias("src_table"), month("txn_date").alias("month_of"), "row_id", F.col("_sync_timestamp").alias("at"), F.inline(F.array(ref("bank_account", "ledgers")))
    )
    return ba.unionByName(bb).filter("key is not null")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    vh = table(spark, d, "voucher_headers").groupBy(plain_or_null("guid").alias("key")).agg(F.min("_sync_timestamp").alias("live_from"), F.max(F.struct("alter_id", "_sync_timestamp", "is_deleted")).alias("newest"))
    vh = vh.filter("not coalesce(newest.is_deleted, false)").select(F.lit("voucher_headers").alias("target"), "key", "live_from")
    led = table(spark, d, "ledgers").groupBy(plain_or_null("ledger_name").alias("key")).agg(F.min("_sync_timestamp").alias("live_from"))
    return vh.unionByName(led.select(F.lit("ledgers").alias("target"), "key", "live_from"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(_references(spark, d), _parents(spark, d), "row_id").select("src_table", "src_field", "month_of", "row_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references by table, field and month."""
    return p5_found(spark, d).groupBy("src_table", "src_field", "month_of").agg(F.count("*").alias("orphans"))


_P5 = f"""WITH refs AS (
  SELECT 'bill_allocations' AS src_table, 'voucher_guid' AS src_field, voucher_date AS day, row_id, _sync_timestamp AS at, 'voucher_headers' AS target, {_plain_sql('voucher_guid')} AS k FROM bill_allocations
  UNION ALL SELECT 'bill_allocations', 'ledger_name', voucher_date, row_id, _sync_timestamp, 'ledgers', {_plain_sql('ledger_name')} FROM bill_allocations
  UNION ALL SELECT 'bank_book', 'bank_account', txn_date, row_id, _sync_timestamp, 'ledgers', {_plain_sql('bank_account')} FROM bank_book),
parents AS (SELECT 'voucher_headers' AS target, {_plain_sql('guid')} AS k, min(_sync_timestamp) AS since, arg_max(is_deleted, (alter_id, _sync_timestamp, is_deleted)) AS gone FROM voucher_headers GROUP BY 2
  UNION ALL SELECT 'ledgers', {_plain_sql('ledger_name')}, min(_sync_timestamp), false FROM ledgers GROUP BY 2),
found AS (SELECT r.src_table, r.src_field, coalesce(strftime(r.day, '%Y-%m'), 'none') AS month_of, r.row_id FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.k = r.k
  WHERE r.k IS NOT NULL AND (p.k IS NULL OR coalesce(p.gone, false) OR r.at < p.since))"""

# ---------------------------------------------------------------- 6: snapshots


def _voucher_type_deliveries(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "sync_checkpoints").filter("dataset = 'voucher_types' and full_sync_done = 1").select("company", F.col("_sync_id").alias("run"))
    return cut(snapshots.deliveries(table(spark, d, "voucher_types"), "_company", "_sync_id", "_sync_timestamp", done))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    columns = ["alter_id", "voucher_type_name", "parent", "alias", "numbering_method"]
    kept = snapshots.versions(table(spark, d, "voucher_types"), "_company", "_sync_id", "master_guid", ["alter_id", "_sync_timestamp"], columns, _voucher_type_deliveries(spark, d))
    return snapshots.changes(kept, columns[:1], columns[1:]).select("company", F.col("run").alias("sync_id"), F.col("key").alias("master_guid"), "change_kind")


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of added, removed and changed records by snapshot."""
    kind = lambda k: F.count_if(F.col("change_kind") == k).alias(k)
    return p6_found(spark, d).groupBy("company", "sync_id").agg(kind("added"), kind("removed"), kind("changed"))


_STATE = ["voucher_type_name", "parent", "alias", "numbering_method"]
_P6 = f"""WITH {_KEPT},
best AS (SELECT t._company AS company, kept.nr, t._sync_id AS run, {_plain_sql('master_guid')} AS k, arg_max(row(alter_id, {', '.join(f"trim(coalesce({c}, ''), ' ' || chr(9))" for c in _STATE)}), (alter_id, _sync_timestamp, {', '.join(_STATE)})) AS state
  FROM voucher_types t JOIN kept ON kept.company = t._company AND kept.run = t._sync_id WHERE {_plain_sql('master_guid')} IS NOT NULL GROUP BY ALL),
pairs AS (SELECT a.company, a.run AS earlier, a.next_run AS run, a.nr FROM kept a WHERE a.next_run IS NOT NULL),
old AS (SELECT p.company, p.run, b.k, b.state FROM pairs p JOIN best b ON b.company = p.company AND b.run = p.earlier),
new AS (SELECT p.company, p.run, b.k, b.state FROM pairs p JOIN best b ON b.company = p.company AND b.run = p.run),
found AS (SELECT coalesce(n.company, o.company) AS company, coalesce(n.run, o.run) AS sync_id, coalesce(n.k, o.k) AS master_guid,
  CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN n.state IS DISTINCT FROM o.state THEN 'changed' END AS change_kind
  FROM old o FULL JOIN new n ON n.company = o.company AND n.run = o.run AND n.k = o.k)"""


def queries() -> dict[str, Query]:
    made = [p1_found, p1_coverage, p2_found, p2_paths, p2_descendants, p2_loops, p3_found, p3_vouchers, p3_ledger_entries, p3_bill_allocations, p3_bank_allocations, p3_cost_centre_allocations]
    made += [p4_found, p4_rolling, p5_found, p5_report, p6_found, p6_summary]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    iso = "strftime({}, '%Y-%m-%d') AS {}"
    return {
        "p1_found": f"{_P1} SELECT company, dataset, span_kind, {iso.format('a', 'day_from')}, {iso.format('z', 'day_to')} FROM spans",
        "p1_coverage": f"""{_P1} SELECT company, dataset, count(*) FILTER (span_kind = 'period') AS periods, count(*) FILTER (span_kind = 'gap') AS gaps,
  CAST(coalesce(sum(z - a + 1) FILTER (span_kind = 'period'), 0) AS BIGINT) AS days_covered, CAST(coalesce(sum(z - a + 1) FILTER (span_kind = 'gap'), 0) AS BIGINT) AS days_left_out FROM spans GROUP BY 1, 2""",
        "p2_found": f"{_P2} SELECT e.tree AS tree_name, e.company, e.id AS node_guid, coalesce(w.root, 'cycle') AS root_guid, CAST(coalesce(w.depth, -1) AS BIGINT) AS node_depth FROM e LEFT JOIN walk w ON w.tree = e.tree AND w.company = e.company AND w.id = e.id",
        "p2_paths": f"{_P2} SELECT e.tree AS tree_name, e.company, e.id AS node_guid, w.path AS node_path FROM e LEFT JOIN walk w ON w.tree = e.tree AND w.company = e.company AND w.id = e.id",
        "p2_descendants": f"{_P2} SELECT tree AS tree_name, company, ancestor_id, descendant_id, CAST(distance AS BIGINT) AS distance FROM pairs",
        "p3_found": f"WITH {_P3_BILLS} SELECT voucher_guid, line_index, {_TEXT.format('b', 'NAME')} AS bill_ref FROM numbered",
        "p3_bill_allocations": f"WITH {_P3_BILLS} SELECT voucher_guid, line_index, entry_index, ledger_name, {_TEXT.format('b', 'NAME')} AS bill_ref, {_TEXT.format('b', 'BILLTYPE')} AS bill_type, {_NUMBER.format(_TEXT.format('b', 'AMOUNT'))} AS amount FROM numbered",
        "p3_ledger_entries": f"WITH {_P3_VOUCHERS} SELECT voucher_guid, entry_index, {_TEXT.format('e', 'LEDGERNAME')} AS ledger_name, {_NUMBER.format(_TEXT.format('e', 'AMOUNT'))} AS amount, {_TEXT.format('e', 'ISDEEMEDPOSITIVE')} AS is_deemed_positive FROM each_entry",
        "p3_vouchers": f"WITH {_P3_VOUCHERS} SELECT voucher_guid, msg_no, {_TEXT.format('v', 'DATE')} AS date_text, {_TEXT.format('v', 'VOUCHERTYPENAME')} AS voucher_type, {_TEXT.format('v', 'VOUCHERNUMBER')} AS voucher_number, {_TEXT.format('v', 'NARRATION')} AS narration FROM entries",
        "p2_loops": f"{_P2_LOOPS} SELECT low.tree AS tree_name, low.company, start AS node_guid, caught.up AS parent_guid FROM low JOIN caught ON caught.tree = low.tree AND caught.company = low.company AND caught.id = low.start WHERE on_loop AND start = least",
        "p3_bank_allocations": f"WITH {_P3_BANKS} SELECT voucher_guid, line_index, entry_index, {_TEXT.format('e', 'LEDGERNAME')} AS ledger_name, {_TEXT.format('b', 'TRANSACTIONTYPE')} AS transaction_type, {_TEXT.format('b', 'INSTRUMENTNUMBER')} AS instrument_number, {_NUMBER.format(_TEXT.format('b', 'AMOUNT'))} AS amount FROM numbered",
        "p3_cost_centre_allocations": f"WITH {_P3_COSTS} SELECT voucher_guid, line_index, entry_index, {_TEXT.format('e', 'LEDGERNAME')} AS ledger_name, cost_category, {_TEXT.format('b', 'NAME')} AS cost_centre, {_NUMBER.format(_TEXT.format('b', 'AMOUNT'))} AS amount FROM numbered",
        "p4_found": f"{_P4} SELECT company, bank_account, {iso.format('d', 'day_on')} FROM rolled WHERE d >= a + 29 AND (debit_7 + credit_7) * 10 > (debit_30 + credit_30) * 7",
        "p4_rolling": f"{_P4} SELECT company, bank_account, {iso.format('d', 'day_on')}, "
        + ", ".join(f"CAST({a}_{n} AS DOUBLE) AS {a}_total_{n}, CAST({a}_{n} AS DOUBLE) / {n} AS {a}_mean_{n}" for a in ("debit", "credit") for n in P4_LENGTHS)
        + " FROM rolled",
        "p5_found": f"{_P5} SELECT src_table, src_field, month_of, row_id FROM found",
        "p5_report": f"{_P5} SELECT src_table, src_field, month_of, count(*) AS orphans FROM found GROUP BY 1, 2, 3",
        "p6_found": f"{_P6} SELECT * FROM found WHERE change_kind IS NOT NULL",
        "p6_summary": f"{_P6} SELECT company, sync_id, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed, count(*) FILTER (change_kind = 'changed') AS changed FROM found WHERE change_kind IS NOT NULL GROUP BY 1, 2",
    }
