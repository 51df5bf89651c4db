"""Inputs that must be refused, whatever their size, and answers that must not depend on it."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tapeloom.config import CleanSpec, ClockSpec, SplitSpec, TokenSpec
from tapeloom.operators import compare, markov, ordering
from tapeloom.plans.prepare import prepare
from tapeloom.sources.zipcsv import csv_members
from tapeloom.streaming import ingest


@pytest.mark.parametrize("rows", [10, 300_000])
@pytest.mark.parametrize("odd", ["NaN", "Infinity"])
def test_order_statistics_refuse_what_is_not_finite(spark, rows, odd):
    df = spark.range(rows).select(F.when(F.col("id") == 3, F.lit(odd).cast("double")).otherwise(F.col("id").cast("double")).alias("x"))
    with pytest.raises(ValueError, match="not finite"):
        ordering.order_statistics(df, {"x": [2]}, {"x": rows})


def test_order_statistics_agree_whatever_is_gathered(spark):
    df = spark.range(20_000).select(((F.col("id") * 7919) % 5003).cast("double").alias("x"))
    ranks = {"x": [0, 17, 9_999, 19_999]}
    assert ordering.order_statistics(df, ranks, {"x": 20_000}, gather=0) == ordering.order_statistics(df, ranks, {"x": 20_000}, gather=10**9)


def test_repeated_keys_are_an_error(spark):
    rows = [("test", "a", 1, 1.0), ("test", "a", 1, 9.0), ("test", "b", 1, 2.0)]
    metrics = spark.createDataFrame(rows, "split string, method string, seed int, nll double")
    twice = spark.createDataFrame([("x", 1, 0.5), ("x", 1, 0.7)], "comparison string, seed int, delta double")
    studies = metrics.withColumn("study", F.lit("old"))
    for df in (
        compare.pivot_metrics(metrics, ["split", "seed"], "method", ["a", "b"]),
        compare.paired_differences(metrics, [("a", "b")], ["split"]),
        compare.wins_ties(twice, ["comparison"], [1]),
        compare.gap_change(studies, "study", "old", "new", "a", "b", ["split", "seed"]),
    ):
        with pytest.raises(PySparkException, match="more than once"):
            df.collect()


@pytest.mark.parametrize("strength", [0.0, -1.0, float("nan"), float("inf")])
def test_strengths_are_positive_and_finite(strength):
    with pytest.raises(ValueError):
        markov.check_strength(strength)


SPLIT = SplitSpec(seen=("AAA",), heldout=("BBB",), train=("2025-02-03",), val=("2025-02-04",), test=("2025-02-05",))


def _tape(spark, *times):
    rows = [(i, "AAA", t, 10.0, 5, "0", "@") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "seq int, symbol string, timestamp string, price double, size int, tr_corr string, tr_scond string")


def _prepared(spark, *times):
    return prepare(_tape(spark, *times), CleanSpec(), SPLIT, TokenSpec(bins=2, context=1), ClockSpec())


def test_prepare_refuses_mixed_zones(spark):
    assert _prepared(spark, "2025-02-03 15:00:00", "not a time").kept.count() == 1
    assert _prepared(spark).kept.count() == 0
    with pytest.raises(ValueError, match="mixed"):
        # The zoned print falls outside the calendar: it counts all the same.
        _prepared(spark, "2025-02-03 15:00:00", "2031-02-03T15:00:00Z").kept.count()


def test_stream_refuses_mixed_zones(spark, tmp_path):
    raw = _tape(spark, "2025-02-03 15:00:00", "2025-02-03T15:00:00Z")
    raw.coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "feed"))
    with pytest.raises(Exception, match="mixed"):
        ingest.clean_stream(feed, CleanSpec(), SPLIT, str(tmp_path / "out"), str(tmp_path / "progress"))


def test_archive_members(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        for name in ("b.CSV", "deep/a.csv", "__MACOSX/deep/a.csv", "notes.txt", "folder.csv/"):
            out.writestr(name, "")
    assert csv_members(str(tmp_path / "a.zip")) == ["b.CSV", "deep/a.csv"]
    zipfile.ZipFile(tmp_path / "b.zip", "w").close()
    with pytest.raises(ValueError, match="no CSV"):
        csv_members(str(tmp_path / "b.zip"))


def _whole_tape(spark, drop=(), correction=True):
    """Six prints for each session of the calendar but those of ``drop``."""
    sessions = [("AAA", "2025-02-03"), ("AAA", "2025-02-04"), ("AAA", "2025-02-05"), ("BBB", "2025-02-05")]
    rows = [(i, s, f"{d} 10:00:0{i}", 10.0 + i * i % 5, 5 + i, "0", "@") for s, d in sessions if (s, d) not in drop for i in range(6)]
    df = spark.createDataFrame(rows, "seq int, symbol string, timestamp string, price double, size int, tr_corr string, tr_scond string")
    return df if correction else df.drop("tr_corr")


def test_prepare_refuses_missing_sessions(spark):
    args = (SPLIT, TokenSpec(bins=2, context=1), ClockSpec())
    assert prepare(_whole_tape(spark), CleanSpec(), *args).sessions.count() == 4
    two = SplitSpec(seen=("AAA", "CCC"), heldout=("BBB",), train=("2025-02-03",), val=("2025-02-04",), test=("2025-02-05",))
    with pytest.raises(ValueError, match="3 expected sessions"):
        prepare(_whole_tape(spark), CleanSpec(), two, *args[1:]).sessions
    skipping = prepare(_whole_tape(spark), CleanSpec(), two, *args[1:], missing="skip")
    assert skipping.sessions.count() == 4
    assert [r.key for r in skipping.report.where("section = 'warnings'").collect()] == ["3 expected sessions are missing or short and were skipped"]
    with pytest.raises(ValueError, match="policy"):
        prepare(_whole_tape(spark), CleanSpec(), *args, missing="ignore")


def test_prepare_refuses_empty_splits(spark):
    tape = _whole_tape(spark, drop=[("AAA", "2025-02-04")])
    with pytest.raises(ValueError, match="val"):
        prepare(tape, CleanSpec(), SPLIT, TokenSpec(bins=2, context=1), ClockSpec(), missing="skip").sessions
    short = _whole_tape(spark)
    with pytest.raises(ValueError, match="heldout.*test.*train.*val"):
        prepare(short, CleanSpec(), SPLIT, TokenSpec(bins=2, context=5), ClockSpec(), missing="skip").sessions


def test_tolerated_columns_leave_a_warning(spark):
    spec = CleanSpec(require_quality_fields=False)
    p = prepare(_whole_tape(spark, correction=False), spec, SPLIT, TokenSpec(bins=2, context=1), ClockSpec())
    got = {r.key for r in p.report.where("section = 'warnings'").collect()}
    assert got == {"correction filter skipped: tr_corr missing"}
    with pytest.raises(ValueError, match="tr_corr"):
        prepare(_whole_tape(spark, correction=False), CleanSpec(), SPLIT, TokenSpec(bins=2, context=1), ClockSpec())


def test_calendar_is_two_maps(spark):
    from tapeloom.operators import clean

    split = SplitSpec(seen=("A", "B"), heldout=("C",), train=("2025-02-03", "2025-02-04"), val=("2025-02-05",), test=("2025-02-06",))
    rows = {(r.symbol, str(r.date)): r.split for r in clean.calendar(spark, split).collect()}
    assert len(rows) == 9 and rows["C", "2025-02-06"] == "heldout" and rows["B", "2025-02-04"] == "train"
    pairs = spark.createDataFrame([(s, f"2025-02-0{d}") for s in ("A", "B", "C", "D", None) for d in range(2, 8)] + [("A", None)], "symbol string, d string")
    marked = clean.assign_split(pairs.withColumn("date", F.col("d").cast("date")), split)
    assert {(r.symbol, r.d): r.split for r in marked.collect() if r.split} == rows
    assert "Join" not in marked._jdf.queryExecution().toString()


@pytest.mark.parametrize("p, good", [([0.5, 0.5], True), ([0.5, 0.4], False), ([1.0, 0.0], False), ([1.5, -0.5], False), ([0.5, None], False), ([], False)])
def test_shrinkage_refuses_unfit_priors(spark, p, good):
    prior = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "token int, p double")
    counts = spark.createDataFrame([(0, 1, 3)], "prev int, next int, n long")
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "prev int, next int")
    for act in (lambda: markov.shrinkage_prob(pairs, counts, prior, 1.0, 2), lambda: markov.strength_scores(pairs, counts, prior, [1.0], 2)):
        if good:
            assert act().count() > 0
        else:
            with pytest.raises(ValueError, match="prior"):
                act()


def test_signed_comparison_sees_both_sides(spark):
    from tapeloom.operators import clock

    rows = lambda *r: spark.createDataFrame(list(r), "k int, v double")
    a = rows((1, 0.5), (2, None), (3, 1.0), (3, 1.0), (4, 1.0))
    keys = lambda x, y: sorted(r.k for r in clock.changed_keys(x, y, ["k"], ["v"]).collect())
    assert keys(a, a) == [] and keys(a, rows((4, 1.0 + 1e-12), (3, 1.0), (3, 1.0), (2, None), (1, 0.5))) == []
    b = rows((1, 0.6), (2, 0.0), (3, 1.0), (5, 1.0))
    assert keys(a, b) == keys(b, a) == [1, 2, 3, 4, 5]


def test_planted_leak_is_found(spark, monkeypatch):
    """Inputs that look past the anchor change when later prices do."""
    import test_tasks
    from tapeloom.operators import clock, events

    trades = test_tasks.trade_frame(spark, *test_tasks.regular(1400))
    factor = F.exp(0.002 * F.sin(F.col("r")))
    args = (trades, events.all_sessions(trades), test_tasks.SPEC, test_tasks.CLEAN, test_tasks.CONTEXT, 300, factor)
    assert clock.causality_check(*args).first().changed_inputs == 0
    honest = clock.clock_examples
    monkeypatch.setattr(clock, "clock_examples", lambda found, spec: honest(found, spec).withColumn("log_vol_history", F.col("T2_target")))
    assert clock.causality_check(*args).first().changed_inputs == 1


def test_audit_reads_only_touched_buckets(spark, tmp_path):
    """Ties that straddle batches are counted, and the second audit looks at the one day that the second batch brought."""
    from tapeloom.operators import clean

    schema = "seq int, symbol string, timestamp string, price double, size int, tr_corr string, tr_scond string"
    row = lambda i, t, price=10.0: (i, "AAA", t, price, 5, "0", "@")
    batches = [
        [row(0, "2025-02-03 10:00:00"), row(1, "2025-02-03 10:00:00", 11.0), row(2, "2025-02-04 10:00:00"), row(3, "2025-02-05 10:00:00")],
        [row(4, "2025-02-04 10:00:00"), row(5, "2025-02-04 10:00:01"), row(6, "bad")],
    ]
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    read = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(feed / f"{i}"))
        stream = spark.readStream.schema(schema).parquet(f"{feed}/*")
        ingest.clean_stream(stream, CleanSpec(), SPLIT, out, str(tmp_path / "progress"))
        read.append([d - 20122 for d in ingest.update_tallies(spark, out)])
        assert ingest.update_tallies(spark, out) == []
        got = {(r.section, r.key): r.n for r in ingest.landed_audit(spark, out).collect()}
        whole = clean.annotate(spark.read.schema(schema).parquet(*[f"{feed}/{k}" for k in range(i + 1)]), CleanSpec(), SPLIT)
        assert got == {(r.section, r.key): r.n for r in clean.audit(whole).collect()}
    assert read == [[0, 1, 2], [1]] and got["total", "same_symbol_timestamp_ties"] == 2 and got["total", "identical_print_rows"] == 1


def test_changed_input_is_prepared_anew(spark, tmp_path):
    from tapeloom.plans.prepare import prepared_tape

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.limit(50).write.parquet(str(tmp_path / "events.parquet"))
    first = prepared_tape(spark, str(tmp_path))
    assert prepared_tape(spark, str(tmp_path)) is first and first.tape.count() == 50
    source.limit(60).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert prepared_tape(spark, str(tmp_path)).tape.count() == 60
