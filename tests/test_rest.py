"""Planner, text rules, sources, sinks and streams."""

import gzip
import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillstream.functions import scalars as S
from quillstream.operators import vouchers as V
from quillstream.plans import windows as P
from quillstream.sources import ndjson, xml
from quillstream.streaming import pump


def test_full_plan_is_newest_first_and_contiguous():
    p = P.plan(date(2026, 7, 30), None, 31, 7)
    assert p.full and p.windows[0][1] == date(2026, 7, 30) and p.windows[-1][0] == date(2026, 4, 1)
    assert all(a[0] == b[1] + timedelta(1) for a, b in zip(p.windows, p.windows[1:]))


def test_resumed_full_plan_goes_on_below_its_frontier():
    p = P.plan(date(2026, 7, 30), date(2026, 4, 1), 31, 7, date(2026, 6, 1), date(2026, 7, 30), P.DONE_MARKER)
    assert p.windows[0][1] == date(2026, 5, 31)
    assert P.plan(date(2026, 7, 30), date(2026, 4, 1), 31, 7, date(2026, 4, 1), None, P.DONE_MARKER).windows == []


def test_incremental_plan_reports_gaps():
    p = P.plan(date(2026, 7, 30), None, 31, 7, None, date(2026, 7, 18), full_done=True)
    assert p.windows[0][0] == date(2026, 7, 19) and p.gap_days == 4
    ahead = P.plan(date(2026, 7, 30), None, 5, 7, None, date(2026, 8, 5), full_done=True)
    assert ahead.windows[0][0] == date(2026, 7, 23) and ahead.gap_days == 0


def test_finished_checkpoint_without_a_last_day_goes_on_from_the_lookback():
    p = P.plan(date(2026, 7, 30), None, 31, 7, full_done=True)
    assert (p.windows, p.full, p.gap_days) == ([(date(2026, 7, 23), date(2026, 7, 30))], False, 0)
    assert P.plan(date(2026, 7, 30), None, 31, -3, None, date(2026, 7, 29), full_done=True).gap_days == 0


@pytest.mark.parametrize("newest_first", [True, False])
def test_what_is_left_after_a_timeout_is_walked_in_smaller_windows(newest_first):
    walked = P.chunks(date(2026, 5, 1), date(2026, 5, 30), 10, newest_first)
    left, days = P.after_timeout(walked, 1, newest_first)
    assert days == 5 and {b - a for a, b in left} == {timedelta(4)}
    covered = sorted(a + timedelta(n) for a, b in left for n in range((b - a).days + 1))
    assert covered == sorted(a + timedelta(n) for a, b in walked[1:] for n in range((b - a).days + 1))
    assert P.after_timeout([(date(2026, 5, 1), date(2026, 5, 1)), (date(2026, 5, 2), date(2026, 5, 2))], 0, False) == ([(date(2026, 5, 2), date(2026, 5, 2))], 1)


def test_rechunk_and_halves():
    pieces = P.rechunk([(date(2026, 3, 1), date(2026, 3, 9))], 3, True)
    assert [a.day for a, _ in pieces] == [7, 4, 1]
    assert P.halves((date(2026, 3, 1), date(2026, 3, 4)), False) == [(date(2026, 3, 1), date(2026, 3, 2)), (date(2026, 3, 3), date(2026, 3, 4))]
    assert P.halves((date(2026, 3, 1), date(2026, 3, 1)), True) == [(date(2026, 3, 1), date(2026, 3, 1))]
    assert P.after_slow(7, 70, 100) == 3 and P.after_slow(1, 90, 100) == 1 and P.after_slow(7, 10, 100) == 7
    assert P.gate_open(None, 3) and not P.gate_open(3, 3)


def test_frame_plan_equals_the_driver_plan(spark):
    starts = [(date(2026, 7, 30) - timedelta(n), date(2026, 7, 30)) for n in range(0, 100, 9)] + [(date(2026, 8, 2), date(2026, 7, 30))]
    got = P.full_windows(spark.createDataFrame(starts, "start date, today date"), "start", "today", 31).collect()
    assert sorted((r.start, r.ord, r.window_from, r.window_to) for r in got) == sorted((a, k, *w) for a, b in starts for k, w in enumerate(P.chunks(a, b, 31, True)))


@pytest.mark.parametrize("text,want", [("2024-02-29", "2024-02-29"), (" 5-may-2024 ", "2024-05-05"), ("05-MAY-2024", "2024-05-05"), ("31/12/2023", "2023-12-31"), ("20240230", None), ("0000-00-00", None), ("0000-01-01", None), ("5-Mai-2024", None), ("2024-1-01", None), ("1-anf-2024", None), ("", None), (None, None), ("9999-12-31", "9999-12-31")])
def test_real_day(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(S.real_day("x").alias("d")).first().d
    assert (got and got.isoformat()) == want


def test_backoff_and_ids(spark):
    r = spark.range(1).select(S.backoff_minutes(F.lit(3)).alias("a"), S.backoff_minutes(F.lit(99)).alias("b"), S.batch_id(F.lit("A 1"), F.lit("C"), F.lit("d"), F.lit(""), F.lit(None).cast("string"), F.lit(42), F.lit("ABCDEF0123456789")).alias("c")).first()
    assert (r.a, r.b, r.c) == (8.0, 30.0, "A_1-C-d-na-na-000042-abcdef012345")


def test_xml_bytes(spark, tmp_path):
    body = "<ENVELOPE><VOUCHER><GUID>G</GUID><ALLLEDGERENTRIES.LIST><LEDGERNAME>é&#x1F;\x02</LEDGERNAME></ALLLEDGERENTRIES.LIST></VOUCHER></ENVELOPE>"
    (tmp_path / "a.xml").write_bytes(b"\xff\xfe" + body.encode("utf-16-le"))
    (tmp_path / "b.xml").write_bytes(b"\xfe\xff" + body.encode("utf-16-be"))
    (tmp_path / "c.xml").write_bytes(b"\xef\xbb\xbf" + body.encode())
    (tmp_path / "d.xml").write_bytes(body.encode())
    (tmp_path / "e.xml").write_bytes(b"not xml")
    (tmp_path / "f.xml").write_bytes(b"x" * 2000)
    docs, rejected = xml.documents(spark, str(tmp_path), most_bytes=1000)
    assert [r.ledger_name for r in V.lines(xml.vouchers(docs)).collect()] == ["é"] * 4
    assert [r.length for r in rejected.collect()] == [2000]


def test_fan_out_names_all_datasets(spark):
    docs = spark.createDataFrame([("d", "<E><VOUCHER><GUID>G</GUID><VOUCHERTYPENAME>sales order</VOUCHERTYPENAME><ALLLEDGERENTRIES.LIST><LEDGERNAME>UTGST</LEDGERNAME><AMOUNT>-90</AMOUNT></ALLLEDGERENTRIES.LIST><ALLINVENTORYENTRIES.LIST><STOCKITEMNAME> </STOCKITEMNAME></ALLINVENTORYENTRIES.LIST></VOUCHER></E>")], "path string, text string")
    out = V.fan_out(xml.vouchers(docs), spark.createDataFrame([("UTGST",)], "ledger_name string"))
    counts = {k: df.count() for k, df in out.items()}
    assert len(counts) == 13 and counts["sales_register"] == 1 and counts["purchase_register"] == 0 and counts["bank_book"] == 1 and counts["inventory_entries"] == 0
    assert out["sales_register"].first().sgst == 90.0
    assert out["bank_book"].first().credit == 90.0


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    ndjson.write(df, str(tmp_path / "o"))
    files = list((tmp_path / "o").glob("*.json.gz"))
    lines = [json.loads(x) for f in files for x in gzip.open(f, "rt")]
    assert {"a": 1, "b": None} in lines
    (tmp_path / "o" / "more.json").write_text('\n{"a": 3}\nbroken\n')
    assert sorted((r.a or 0) for r in ndjson.read(spark, str(tmp_path / "o"), df.schema).collect()) == [0, 1, 2, 3]
    body = json.loads(ndjson.envelope(df, {"agent": "x"}, []).first().body)
    assert body["record_count"] == 2 and body["agent"] == "x"


def test_stream_upsert_over_several_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, k, f"v{k}"), (k + 10, 0, "once")], "k int, nr int, v string").coalesce(1).write.parquet(str(tmp_path / "t.parquet"), mode="append")
    stream = spark.readStream.schema("k int, nr int, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t.parquet"))
    got = {r.k: r.v for r in pump.upserted(stream, ["k"], ["nr"]).collect()}
    assert got == {1: "v2", 10: "once", 11: "once", 12: "once"}


def test_throttle_against_a_loop(spark):
    import random

    rnd = random.Random(2)
    rows = sorted((k, rnd.randint(0, 5000), n) for n, k in enumerate(rnd.choices("abc", k=300)))
    df = spark.createDataFrame([(k, t, n) for k, t, n in rows], "k string, t long, n int").withColumn("ts", F.timestamp_seconds("t"))
    want, last = set(), {}
    for k, t, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or t - last[k] >= 600:
            last[k] = t
            want.add(n)
    assert {r.n for r in pump.throttled(df, F.col("k"), "ts", "n", 10).collect()} == want


def test_scan_prunes_folders_and_columns(spark, tmp_path):
    from quillstream.sources import collection

    df = spark.createDataFrame([(n, date(2024, 1, 1) + timedelta(n), n, "c") for n in range(100)] + [(999, None, 1, "c")], "id int, day date, alter_id int, _company string")
    path = str(tmp_path / "landed")
    collection.land(df, path, "day")
    got = collection.scan(spark, path, ["id"], "day", "2024-01-30", "2024-02-02", "c")
    assert sorted(r.id for r in got.collect()) == [29, 30, 31, 32]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cast(_month" in plan or "PartitionFilters: [isnotnull(_month" in plan
    assert "alter_id" not in plan.split("ReadSchema")[1]
    assert collection.highest(spark, path) == 99
    collection.land_again(df.filter("id = 5").withColumn("alter_id", F.lit(500)), path, "day")
    assert (collection.highest(spark, path), collection.scan(spark, path, ["id"]).count()) == (500, 101 - 31 + 1)


def test_every_dataset_has_a_schema(spark):
    from quillstream import schemas

    assert len(schemas.datasets()) == 34 and len(schemas.datasets(("master",))) == 15
    assert "uom" not in schemas.datasets(without=frozenset({"uom"}))
    for name in schemas.datasets():
        assert len(set(schemas.schema(name, audit=True).names)) == len(schemas.schema(name, audit=True).names)
    docs = spark.createDataFrame([("d", "<E><VOUCHER><GUID>G</GUID></VOUCHER></E>")], "path string, text string")
    out = V.fan_out(xml.vouchers(docs), spark.createDataFrame([], "ledger_name string"))
    for name, df in out.items():
        assert sorted(df.columns) == sorted(schemas.schema(name).names), name
        assert schemas.conformed(df, name).schema.simpleString() == schemas.schema(name).simpleString()


def test_pair_walk_reads_all_nations(spark, data):
    import __spark_entry__ as e

    nations = {r.c_nationkey for r in spark.read.parquet(f"{data}/customer.parquet").filter("c_custkey % 5 <> 0").select("c_nationkey").distinct().collect()}
    assert {r.report for r in e.queries()["report_pair_walk"](spark, data).select("report").distinct().collect()} == nations
    assert max(nations) >= 20


def test_stream_upsert_goes_on_after_a_restart(spark, tmp_path):
    """State and checkpoint lie in one folder: a second run takes only what is new, and finds what was there."""
    folder, base = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "k string, n int, x string"
    events = lambda: spark.readStream.schema(schema).parquet(folder)
    spark.createDataFrame([("a", 1, "old"), ("b", 1, "b"), (None, 1, "none")], schema).write.mode("append").parquet(folder)
    first = {tuple(r) for r in pump.upserted(events(), ["k"], ["n"], base).collect()}
    assert first == {("a", 1, "old"), ("b", 1, "b"), (None, 1, "none")}
    spark.createDataFrame([("a", 2, "new"), ("a", 0, "late"), ("c", 1, "c")], schema).write.mode("append").parquet(folder)
    for _ in range(2):  # the second time there is nothing new
        again = {tuple(r) for r in pump.upserted(events(), ["k"], ["n"], base).collect()}
        assert again == {("a", 2, "new"), ("b", 1, "b"), ("c", 1, "c"), (None, 1, "none")}
