"""The mix against a plain queue on one machine."""

import pytest
from pyspark.sql import functions as F

from quillstream.llm import mixture as M

TARGETS = [(" A ", 0.5, 1), ("b", 0.3, 3), ("C", 0.1, 2), ("none", 0.1, 4), (None, 0.2, 1), ("zero", 0.0, 1)]


@pytest.fixture
def sizes(spark):
    rows = [(n, "a", 50 + n % 7) for n in range(400)] + [(1000 + n, "b", 20 + n % 11) for n in range(60)] + [(2000 + n, "c", 5 + n % 3) for n in range(90)] + [(3000, "a", 0), (3001, "zzz", 7)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


@pytest.fixture
def targets(spark):
    return M.target_table(spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long").withColumn("tokens", F.lit("clash")))


def _collected(df):
    return [tuple(r) for r in df.select("doc_id", "source", "copy_no", "n_tokens", "mix_offset").orderBy("mix_offset").collect()]


def test_shares_hold_and_repeats_are_capped(spark, sizes, targets):
    mixed = M.mix(sizes, targets)
    rows = _collected(mixed)
    at = 0
    for _, _, _, n, offset in rows:
        assert offset == at
        at += n
    report = {r.source: r for r in M.shares(mixed, sizes, targets).collect()}
    assert report["none"].actual_share == 0 and "zero" not in report and "zzz" not in report
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert report[source].actual_share == pytest.approx(share / 0.9, abs=0.02)
        assert report[source].copies_used <= report[source].max_repeats
    assert len({r[:3] for r in rows}) == len(rows)
    # the source that runs out first gives all it has
    assert any(report[s].tokens_mixed >= report[s].tokens_available * report[s].max_repeats - 100 for s in "abc")


def test_a_given_budget_goes_on_when_sources_run_out(sizes, targets):
    rows = _collected(M.mix(sizes, targets, total_tokens=20_000))
    assert 19_900 <= sum(r[3] for r in rows) <= 20_000
    assert max(r[2] for r in rows if r[1] == "b") == 3


@pytest.mark.parametrize("bucket", [1, 7, 10**6])
def test_buckets_change_nothing(sizes, targets, monkeypatch, bucket):
    want = _collected(M.mix(sizes, targets))
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    assert _collected(M.mix(sizes, targets)) == want


def test_every_prefix_holds_the_shares(sizes, targets):
    rows = _collected(M.mix(sizes, targets))
    for part in (0.25, 0.5, 0.75):
        head = rows[: int(len(rows) * part)]
        total = sum(r[3] for r in head)
        assert sum(r[3] for r in head if r[1] == "b") / total == pytest.approx(1 / 3, abs=0.05)


def test_a_long_document_leaves_no_gap(spark):
    """While one source's long document isn't finished, another goes on until the budget, which the third sets, is reached."""
    sizes = spark.createDataFrame([(n, "a", 10) for n in range(300)] + [(1000 + n, "b", 10) for n in range(40)] + [(2000, "c", 5000)], "doc_id long, source string, n_tokens long")
    targets = M.target_table(spark.createDataFrame([("a", 0.4, 1), ("b", 0.2, 1), ("c", 0.4, 1)], "source string, target_share double, max_repeats long"))
    assert 1990 <= sum(r[3] for r in _collected(M.mix(sizes, targets))) <= 2000


def test_empty(sizes, targets):
    assert _collected(M.mix(sizes.limit(0), targets)) == []
    assert _collected(M.mix(sizes, targets.limit(0))) == []
    assert M.shares(M.mix(sizes.limit(0), targets), sizes.limit(0), targets).count() == 4


def test_sizes_come_from_plain_sources(spark, targets):
    docs = spark.createDataFrame([(1, "one two", "\tB "), (2, None, "a"), (3, "x", None), (4, "x", "elsewhere"), (5, "", "c")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.source, r.n_tokens) for r in M.sized(docs, targets, "doc_id", "text", "source", M.tokenizer.VOCABULARY).collect()}
    assert got == {1: ("b", 2), 2: ("a", 0), 5: ("c", 0)}
