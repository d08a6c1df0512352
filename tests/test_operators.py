"""The general operators against brute force on small tables."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstream import session
from quillstream.operators import batches, hierarchy, intervals, nested, numbering, references, reports, rolling, snapshots, sync, warehouse
from quillstream.session import lookup_join

# ------------------------------------------------------------------ intervals


def _brute_spans(rows):
    out = []
    for key in {r[0] for r in rows}:
        days = sorted({a + timedelta(n) for k, a, b in rows if k == key and a and b and a <= b for n in range((b - a).days + 1)})
        runs = []
        for d in days:
            if runs and runs[-1][1] + timedelta(1) == d:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        out += [(key, "period", a, b) for a, b in runs]
        out += [(key, "gap", x[1] + timedelta(1), y[0] - timedelta(1)) for x, y in zip(runs, runs[1:])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1, 2, 7, 366])
def test_intervals_against_days(spark, shard):
    rnd = random.Random(shard)
    base = date(2023, 12, 20)
    rows = []
    for _ in range(300):
        a = base + timedelta(rnd.randint(0, 400))
        rows.append((rnd.choice(["a", "b", "c", "d"]), a, a + timedelta(rnd.choice([-3, 0, 0, 1, 5, 40]))))
    rows += [("a", None, base), ("a", base, None), ("hot", date(1999, 1, 1), date(2003, 1, 1))] + [("hot", base, base)] * 50
    df = spark.createDataFrame(rows, "key string, a date, b date").withColumn("lo", F.lit("x"))
    got = intervals.periods_and_gaps(df, ["key"], "a", "b", shard).collect()
    assert sorted(map(tuple, got), key=str) == _brute_spans(rows)


def test_intervals_null_entity_and_empty(spark):
    df = spark.createDataFrame([(None, date(2024, 1, 1), date(2024, 1, 2)), (None, date(2024, 1, 4), date(2024, 1, 4))], "key string, a date, b date")
    assert sorted(r.span_kind for r in intervals.periods_and_gaps(df, ["key"], "a", "b").collect()) == ["gap", "period", "period"]
    assert intervals.periods_and_gaps(df.limit(0), ["key"], "a", "b").collect() == []


# ---------------------------------------------------------------- hierarchies


def _brute_tree(rows):
    names = {}
    for i, n, _ in sorted(rows, reverse=True):
        if n is not None:
            names[n] = i
    up = {i: names.get(p) if p is not None else None for i, _, p in rows}
    out = {}
    for i in up:
        path, j = [], i
        while j is not None and j not in path:
            path.append(j)
            j = up[j]
        out[i] = ("cycle", -1, None) if j is not None else (path[-1], len(path) - 1, path[:0:-1])
    return out


def _brute_closers(rows):
    names = {n: i for i, n, _ in sorted(rows, reverse=True) if n is not None}
    up = {i: names.get(p) if p is not None else None for i, _, p in rows}
    out = set()
    for i in up:
        path, j = [], i
        while j is not None and j not in path:
            path.append(j)
            j = up[j]
        if j is not None:
            out.add(min(path[path.index(j) :]))
    return out


@pytest.mark.parametrize("seed,every", [(1, 10**6), (2, 10**6), (3, 12)])
def test_hierarchy_against_walking_up(spark, seed, every):
    rnd = random.Random(seed)
    names = [f"n{k}" for k in range(60)]
    rows = [(f"i{k:02}", n if rnd.random() > 0.05 else None, rnd.choice(names[:k] or [None]) if rnd.random() < 0.8 else rnd.choice([*names, None, "nothing"])) for k, n in enumerate(names)]
    rows += [("self", "self", "self"), ("l1", "l1", "l2"), ("l2", "l2", "l1"), ("into", "into", "l1"), ("twin", "n3", None)]
    df = spark.createDataFrame([("t", "s", *r) for r in rows], "tree string, scope string, id string, name string, parent string").withColumn("node", F.lit("clash"))
    result = hierarchy.hierarchy(df, every=every).collect()
    got = {r.id: (r.root_id, r.depth, r.ancestors) for r in result}
    want = _brute_tree(rows)
    assert {k: (v[0], v[1]) for k, v in got.items()} == {k: (v[0], v[1]) for k, v in want.items()}
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in want.items()}
    names_of = {i: n or "" for i, n, _ in rows}
    assert {r.id: r.path for r in result} == {k: None if v[2] is None else hierarchy.SEPARATOR.join(names_of[x] for x in [*v[2], k]) for k, v in want.items()}
    assert {r.id for r in result if r.closes_loop} == _brute_closers(rows)
    plain = {r.id: (r.root_id, r.depth) for r in hierarchy.hierarchy(df, False, every).collect()}
    assert plain == {k: (v[0], v[1]) for k, v in want.items()}
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in hierarchy.descendants(df, every).collect()}
    assert pairs == {(a, k, v[1] - n) for k, v in want.items() if v[2] is not None for n, a in enumerate(v[2])}


def test_hierarchy_long_chain_and_scopes(spark):
    chain = [("t", s, f"{s}{k}", f"n{k}", f"n{k - 1}" if k else None) for s in ("a", None) for k in range(300)]
    df = spark.createDataFrame(chain, "tree string, scope string, id string, name string, parent string")
    got = hierarchy.hierarchy(df).agg(F.max("depth"), F.countDistinct("root_id"), F.count_if("closes_loop")).first()
    assert tuple(got) == (299, 2, 0)


@pytest.mark.parametrize("every", [150, 10**6])
def test_hierarchy_of_long_loops_and_stars(spark, every):
    """Loops over many cut nodes with ways leading into them, and a node of many children below another one."""
    loop = [(f"{k:03}", f"l{k}", f"l{(k + 1) % 300}") for k in range(300)] + [(f"i{k:03}", f"i{k}", f"i{k + 1}" if k < 99 else "l7") for k in range(100)]
    star = [("s", "s", None), ("t", "t", "s")] + [(f"x{k}", f"x{k}", "t" if k % 2 else "s") for k in range(400)]
    df = spark.createDataFrame([("t", "s", *r) for r in loop + star], "tree string, scope string, id string, name string, parent string")
    got = {r.id: (r.root_id, r.depth, r.closes_loop) for r in hierarchy.hierarchy(df, False, every).collect()}
    want = {i: ("cycle", -1, i == "000") for i, _, _ in loop} | {"s": ("s", 0, False), "t": ("s", 1, False)} | {f"x{k}": ("s", 1 + k % 2, False) for k in range(400)}
    assert got == want


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_hierarchy_of_large_components(spark, shape):
    """Depths of a component that several pieces make up: linear in its size, without paths."""
    n, every = 20_000, 8_000
    parent = F.when(F.col("id") > 0, F.concat(F.lit("n"), (F.col("id") - 1 if shape == "chain" else F.lit(0)).cast("string")))
    df = spark.range(n).select(F.lit("t").alias("tree"), F.lit("s").alias("scope"), F.format_string("%07d", "id").alias("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), parent.alias("parent"))
    got = hierarchy.hierarchy(df, False, every).agg(F.count("*"), F.max("depth"), F.sum("depth"), F.countDistinct("root_id")).first()
    assert tuple(got) == ((n, n - 1, n * (n - 1) // 2, 1) if shape == "chain" else (n, 1, n - 1, 1))


# -------------------------------------------------------------------- rolling


def test_rolling_against_sums(spark):
    rnd = random.Random(5)
    base = date(2024, 1, 1)
    rows = [(rnd.choice("ab"), base + timedelta(rnd.randint(0, 90)), rnd.choice([None, rnd.randint(-500, 900) / 100])) for _ in range(120)] + [("a", None, 5.0), ("one", base, 1.25)]
    df = spark.createDataFrame(rows, "k string, day date, x double").withColumn("real", F.lit(1))
    got = {(r.k, r.day_on): (float(r.x_7), float(r.x_30)) for r in rolling.each_day(rolling.trailing_runs(df, ["k"], "day", ["x"], [7, 30])).collect()}
    want = {}
    for k in {"a", "b", "one"}:
        own = [(d, round((x or 0) * 100)) for kk, d, x in rows if kk == k and d]
        for n in range((max(d for d, _ in own) - min(d for d, _ in own)).days + 1):
            d = min(d for d, _ in own) + timedelta(n)
            want[k, d] = tuple(sum(x for e, x in own if 0 <= (d - e).days < m) / 100 for m in (7, 30))
    assert got == want
    assert rolling.trailing_runs(df.limit(0), ["k"], "day", ["x"], [7]).collect() == []


def test_unrepeated_tells_nulls_apart(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "a", "x", None), (3, "a", None, "x"), (4, "a", "", "x")], "id int, k string, p string, q string")
    assert rolling.unrepeated(df, ["id"], ["k"]).count() == 3


# ----------------------------------------------------------------- references


def test_references_against_lookup(spark):
    rnd = random.Random(7)
    at = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    keys = [f"ab-{k:06x}" for k in range(0, 9000, 3)] + [f"ledger {k}" for k in range(200)] + ["", "plain", "é", "ffff", "0", "00", "000"]
    parents = [("t", k, at(rnd.randint(0, 50)) if rnd.random() > 0.1 else None) for k in keys if rnd.random() > 0.3]
    known = {k: since for _, k, since in parents}
    refs = [(n, "t", rnd.choice(keys) if n % 3 else "ab-000003", at(rnd.randint(0, 60)) if rnd.random() > 0.05 else None) for n in range(4000)] + [(9999, "t", None, at(1))]
    r = spark.createDataFrame(refs, "row_id int, target string, key string, at timestamp").withColumn("live_from", F.lit("clash"))
    p = spark.createDataFrame(parents, "target string, key string, live_from timestamp")
    got = sorted(x.row_id for x in references.orphans(r, p, "row_id").collect())
    want = sorted(n for n, _, k, t in refs if k is not None and (k not in known or known[k] is not None and t is not None and t < known[k]))
    assert got == want
    assert references.orphans(r, p.limit(0), "row_id").count() == 4000
    assert references.orphans(r.limit(0), p, "row_id").count() == 0


def test_serial_is_lossless(spark):
    keys = ["", "a", "0", "00", "abc-00ff", "x" * 5 + "f" * 40, "ünï 12", "g", "12345678901234567890"]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", *references.serial(F.col("key"))).collect()
    assert [r.stem + (f"{r.number:0{r.width}x}" if r.width else "") for r in rows] == [r.key for r in rows]
    assert len({(r.stem, r.width, r.number) for r in rows}) == len(keys)


# ------------------------------------------------------------------ snapshots


def test_snapshots_against_sets(spark):
    rnd = random.Random(11)
    rows, states = [], []
    for run in range(6):
        state = {f"g{k}": (rnd.randint(1, 3), rnd.choice(["p", " p\t", None, "", "P"])) for k in range(30) if rnd.random() > 0.3}
        states.append(state)
        for g, (alter, text) in state.items():
            rows.append(("c", f"r{run}", g.upper() if run % 2 else f" {g}", alter, text, datetime(2024, 1, 1 + run)))
            rows.append(("c", f"r{run}", g, 0, "stale", datetime(2024, 1, 1 + run)))
        rows.append(("c", f"r{run}", " ", 1, "blank", datetime(2024, 1, 1 + run)))
    df = spark.createDataFrame(rows, "company string, run string, guid string, alter_id int, name string, at timestamp").withColumn("key", F.lit(1)).withColumn("rank", F.lit(1))
    done = spark.createDataFrame([("c", f"r{k}") for k in (0, 1, 3, 4)], "company string, run string")
    kept = snapshots.deliveries(df, "company", "run", "at", done)
    v = snapshots.versions(df, "company", "run", "guid", ["alter_id", "at"], ["alter_id", "name"], kept)
    got = sorted((r.run, r.key, r.change_kind) for r in snapshots.changes(v, ["alter_id"], ["name"]).collect())
    clean = lambda s: (s[0], (s[1] or "").strip(" \t"))
    want = []
    for a, b in ((0, 1), (1, 3), (3, 4)):
        for g in states[a].keys() | states[b].keys():
            kind = "removed" if g not in states[b] else "added" if g not in states[a] else "changed" if clean(states[a][g]) != clean(states[b][g]) else None
            if kind:
                want.append((f"r{b}", g, kind))
    assert got == sorted(want)


# --------------------------------------------------------------------- nested

_BODIES = {
    1: '{"VOUCHER": {"GUID": " A-1 ", "ALLLEDGERENTRIES.LIST": [{"BILLALLOCATIONS.LIST": [{"NAME": " x "}, null, {"NAME": 7}]}, null, {"BILLALLOCATIONS.LIST": {"NAME": null}}], "LEDGERENTRIES.LIST": {"BILLALLOCATIONS.LIST": {"NAME": "never"}}}}',
    2: '{"ENVELOPE": {"BODY": {"DATA": {"TALLYMESSAGE": [{"VOUCHER": [{"GUID": "a-1", "LEDGERENTRIES.LIST": {"BILLALLOCATIONS.LIST": {"NAME": "late"}}}, {"GUID": "B", "ALLLEDGERENTRIES.LIST": [], "LEDGERENTRIES.LIST": {"BILLALLOCATIONS.LIST": [{}]}}]}, null]}}}}',
    3: '{"VOUCHER": {"GUID": "cut", ', 4: "", 5: None, 6: "null", 7: "[1]", 8: '{"VOUCHER": {"GUID": "tail"}} x', 9: '{"VOUCHER": null, "ENVELOPE": "text"}', 10: '{"VOUCHER": {"GUID": " ", "LEDGERENTRIES.LIST": {"BILLALLOCATIONS.LIST": {"NAME": "blank"}}}}',
    11: '{"VOUCHER": {"GUID": "tail"}}, {"VOUCHER": {"GUID": "tail"}}', 12: ' {"VOUCHER": {"GUID": "C", "GUID": "c2", "LEDGERENTRIES.LIST": {"BILLALLOCATIONS.LIST": {"NAME": "' + "y" * 100_000 + '"}}}}\n',
}


def test_nested_shapes(spark):
    df = spark.createDataFrame(list(_BODIES.items()), "msg_no long, body string").withColumn("top", F.lit(0)).repartition(3)
    v = nested.vouchers(df, children=(nested.BILLS,))
    got = sorted((r.voucher_guid, r.line_index, r.bill_ref[:4]) for r in nested.child_table(v, "bills", {"name": "bill_ref"}).collect())
    assert got == [("a-1", 0, "x"), ("a-1", 1, "7"), ("a-1", 2, ""), ("b", 0, ""), ("c2", 0, "yyyy")]


def test_nested_levels_keep_their_links(spark):
    body = '{"VOUCHER": {"GUID": "g", "LEDGERENTRIES.LIST": [{"LEDGERNAME": "one", "CATEGORYALLOCATIONS.LIST": {"CATEGORY": "k", "COSTCENTREALLOCATIONS.LIST": [{"NAME": "n", "AMOUNT": "1,5"}]}, "COSTCENTREALLOCATIONS.LIST": {"NAME": "direct"}}, {"LEDGERNAME": "two", "BANKALLOCATIONS.LIST": {"NAME": "b"}}]}}'
    v = nested.vouchers(spark.createDataFrame([(1, body)], "msg_no long, body string"))
    costs = nested.child_table(v, "costs", {"category": "category", "name": "name"}).collect()
    assert [(r.entry_index, r.line_index, r.ledger_name, r.category, r["name"]) for r in costs] == [(0, 0, "one", "", "direct"), (0, 1, "one", "k", "n")]
    assert [r.entry_index for r in nested.child_table(v, "banks", {"name": "name"}).collect()] == [1]
    assert nested.entry_table(v).count() == 2 and nested.voucher_table(v).count() == 1


# ---------------------------------------------------------------- the smaller


@pytest.mark.parametrize("rows", [0, 10**6])
@pytest.mark.parametrize("how,want", [("inner", 60), ("left", 90), ("left_semi", 60), ("left_anti", 30)])
def test_lookup_join_both_ways(spark, rows, how, want):
    big = spark.range(90).select(F.col("id").alias("n"), F.when(F.col("id") < 60, "hot").alias("k"))
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    assert lookup_join(big, small, ["k"], how, salt_by="n", rows=rows).count() == want


def test_lookup_join_parts_hot_keys(spark, monkeypatch):
    """Beyond the limit a key's rows are parted by their number; the lookup's rows are copied for hot keys alone."""
    monkeypatch.setattr(session, "KEY_ROWS", 1_000)
    big = spark.range(30_000).select((F.col("id") * (F.col("id") % 3) % 6_000).alias("k"), F.col("id").alias("n"))
    small = spark.range(8_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = lookup_join(big, small, ["k"], salt_by="n", rows=10)
    assert joined.count() == joined.select("n").distinct().count() == 30_000
    assert lookup_join(big, small.filter("k <> 0"), ["k"], "left_anti", salt_by="n", rows=10).count() == big.filter("k = 0").count()


def test_orphans_beyond_the_broadcast_limit(spark):
    """More faulty keys than may be broadcast: the last step shuffles, and gives the same."""
    refs = spark.range(260_000).select(F.lit("t").alias("target"), F.format_string("%08x", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("key"), F.timestamp_seconds(F.col("id")).alias("at"), F.col("id").alias("row_id"))
    parents = spark.range(0, 50_000).select(F.lit("t").alias("target"), F.format_string("%08x", "id").alias("key"), F.timestamp_seconds(F.lit(100)).alias("live_from"))
    out = references.orphans(refs, parents, "row_id")
    want = refs.filter("cast(conv(key, 16, 10) as bigint) >= 50000 or row_id < 100")
    assert out.count() == want.count() > 140_000 and out.join(want, "row_id", "left_anti").count() == 0


def test_bytes_decide_a_broadcast_too(spark):
    long = spark.range(100).select("id", F.repeat(F.lit("x"), F.lit(400_000)).alias("s"))
    assert not session.may_broadcast(long) and session.may_broadcast(long.select("id")) and session.may_broadcast(long.limit(0))


def test_swap_cut_off_between_its_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    warehouse.swapped(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    warehouse.recovered(spark, path)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t.old").exists()


def test_checkpoints_and_gates(spark):
    day = date(2026, 5, 1)
    held = spark.createDataFrame([("full", "c", date(2026, 5, 20), date(2026, 6, 1), 2, False), ("inc", "c", day, date(2026, 5, 2), None, False), ("idle", None, None, None, 7, None)], "dataset string, company string, last_from date, last_to date, marker long, full_sync_done boolean")
    walked = [("full", "c", date(2026, 5, 10), date(2026, 5, 19), day, False, None), ("full", "c", day, date(2026, 5, 9), day, True, None), ("inc", "c", date(2026, 5, 3), date(2026, 5, 9), None, None, None), ("snap", "c", day, day, None, False, 0), ("new", "c", day, day, None, False, 3)]
    w = spark.createDataFrame(walked, "dataset string, company string, window_from date, window_to date, target date, failed boolean, rows long")
    got = {r.dataset: tuple(r)[2:] for r in sync.advanced(held, w, F.lit("2026-05-09").cast("date")).collect()}
    assert got == {"full": (date(2026, 5, 10), date(2026, 6, 1), 2, False), "inc": (day, date(2026, 5, 9), None, True), "idle": (None, None, 7, False), "new": (day, day, None, False)}
    seen = spark.createDataFrame([("A ", 5, 9), ("b", None, 9), ("d", 5, 9)], "company string, masters long, vouchers long")
    marks = spark.createDataFrame([("a", sync.GATES["masters"], 5), ("a", sync.GATES["vouchers"], 8), ("b", sync.GATES["masters"], 5), ("b", sync.GATES["vouchers"], 9)], "company string, dataset string, last_alter_id long")
    assert {tuple(r) for r in sync.gates(seen, marks).collect()} == {("A ", False, True), ("b", True, False), ("d", True, True)}
    assert {(r.run_masters, r.run_vouchers) for r in sync.gates(seen, marks, False).collect()} == {(True, True)}


def test_numbered_over_buckets(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.floor(F.col("id") / 40).alias("b"))
    got = numbering.numbered(df, ["k"], "b", [F.col("v")]).collect()
    assert all(r.row_nr == r.v // 3 for r in got) and len(got) == 500


def test_checksum_ignores_audit_and_order(spark):
    a = spark.createDataFrame([(n, n // 4, f"x{n}" if n % 2 else None, "run") for n in range(8)], "row_nr long, slice_no long, x string, _sync_id string")
    sums = lambda df: sorted(map(tuple, batches.checksums(df, [], batches.content_line(df.drop("row_nr", "slice_no"))).collect()))
    assert sums(a) == sums(a.withColumn("_sync_id", F.lit("other")).orderBy(F.desc("row_nr")))
    assert sums(a) != sums(a.withColumn("x", F.coalesce("x", F.lit(""))))


def test_latest_and_children(spark):
    old = spark.createDataFrame([("A", 1, "x"), ("a", 2, "y"), ("b", 1, None), ("b", 1, None)], "k string, nr int, v string")
    assert sorted((r.k, r.v) for r in warehouse.latest(old, [F.lower("k")], ["nr"]).collect()) == [("a", "y"), ("b", None)]
    new = spark.createDataFrame([("b", 5, "z")], "k string, nr int, v string")
    assert sorted(r.k for r in warehouse.children_replaced(old, new, ["k"]).collect()) == ["A", "a", "b"]
    assert warehouse.upserted(old, new, ["k"], ["nr"]).filter("k = 'b'").first().v == "z"


def test_swap_reads_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    warehouse.swapped(spark.range(3).toDF("n"), path)
    warehouse.swapped(spark.read.parquet(path).withColumn("n", F.col("n") + 1), path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_pair_walk(spark):
    nodes = [("r", 0, "name", "Cash"), ("r", 1, "amount", "1,000"), ("r", 2, "name", "lonely"), ("r", 3, "name", " cash "), ("r", 4, "amount", "2"), ("r", 5, "name", " "), ("r", 6, "amount", "3")]
    got = reports.pair_walk(spark.createDataFrame(nodes, "report string, ord int, tag string, value string")).collect()
    assert [(r["name"], r.amount) for r in got] == [("Cash", 1000.0)]
