"""Ordering, features, tokens, windows and Markov models on small worked cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions.columns import joint_decode, joint_encode, seq_decode, seq_encode
from tapeloom.operators import events, markov, ordering, tokens, windows

KEY = ("symbol", "date")


def session_frame(spark, sequences, columns, name="S"):
    data = [(f"{name}{i}", "2025-02-03", "train", e, len(seq), *row) for i, seq in enumerate(sequences) for e, row in enumerate(seq)]
    return spark.createDataFrame(data, f"symbol string, date string, split string, e bigint, events bigint, {columns}")


def test_positions_and_frames_split_a_busy_session(spark):
    """One session holds nearly all rows, all at one instant for a third of them."""
    random.seed(1)
    times = [5] * 100 + [random.randrange(1000) for _ in range(200)]
    data = [("hot", t, i, float(i)) for i, t in enumerate(times)] + [("cold", 1, 1000, 1.0)]
    df = spark.createDataFrame(data, "k string, t bigint, seq bigint, v double").repartition(7)
    placed = ordering.positions(df, ["k"], ["t", "seq"], "pos", total="n")
    expected = {row[2]: i for i, row in enumerate(sorted(r for r in data if r[0] == "hot"))}
    got = {r.seq: (r.pos, r.n) for r in placed.where("k = 'hot'").collect()}
    assert got == {seq: (i, 300) for seq, i in expected.items()}
    values = [r[3] for r in sorted(r for r in data if r[0] == "hot")]
    framed = ordering.framed(placed, ["k"], "pos", lambda w: {"s": F.sum("v").over(w.rowsBetween(-20, 3)), "l": F.lag("v", 20).over(w)}, before=20, after=3)
    for r in framed.where("k = 'hot'").collect():
        assert r.s == sum(values[max(0, r.pos - 20) : r.pos + 4]) and r.l == (values[r.pos - 20] if r.pos >= 20 else None)
    sums = ordering.running_totals(placed, ["k"], "pos", {"c": F.col("v")})
    assert {r.pos: r.c for r in sums.where("k = 'hot'").collect()} == {i: sum(values[: i + 1]) for i in range(300)}


@pytest.mark.parametrize("gather,accuracy", [(100_000, 10_000), (5, 50), (3, 10)])
def test_order_statistics_are_exact(spark, gather, accuracy):
    random.seed(2)
    values = [0.0] * 400 + [random.gauss(0, 1) for _ in range(500)] + [float(random.randrange(5)) for _ in range(300)]
    random.shuffle(values)
    df = spark.createDataFrame([(v, None if i % 3 else v) for i, v in enumerate(values)], "a double, b double")
    a, b = sorted(values), sorted(v for i, v in enumerate(values) if i % 3 == 0)
    ranks = {"a": [0, 1, 10, 299, 300, 600, 601, 900, 1199], "b": [0, 57, 200, 399]}
    got = ordering.order_statistics(df, ranks, {"a": len(a), "b": len(b)}, gather, accuracy)
    assert got == {**{("a", r): a[r] for r in ranks["a"]}, **{("b", r): b[r] for r in ranks["b"]}}
    with pytest.raises(ValueError, match="Rank"):
        ordering.order_statistics(df, {"a": [1200]}, {"a": 1200})


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "a double")
    assert ordering.exact_quantiles(df, {"a": [0.0, 0.25, 1 / 3, 0.5, 1.0]})["a"] == pytest.approx([0, 2.25, 3.0, 4.5, 9])


def test_event_features(spark):
    data = [("A", "2025-02-03", "train", t, i, p, s) for i, (t, p, s) in enumerate([(0, 100.0, 1.0), (1_000_000_000, 101.0, 3.0), (1_000_000_002, 99.0, 5.0)])]
    data += [("B", "2025-02-03", "train", 0, 9, 1.0, 1.0)]
    kept = spark.createDataFrame(data, "symbol string, date string, split string, ts_ns bigint, seq bigint, price double, size double")
    trades = events.event_features(events.number_trades(kept))
    got = events.events_of(trades).orderBy("e").collect()
    assert [r.e for r in got] == [0, 1] and got[0].events == 2
    assert [got[0].f0, got[0].f1, got[0].f2] == pytest.approx([math.log1p(1), 10000 * math.log(1.01), math.log1p(3)])
    assert [got[1].g0, got[1].g1, got[1].g2] == [got[0].f0, got[0].f1, got[0].f2] and got[0].g0 is None
    assert got[1].f0 == pytest.approx(2e-9, rel=1e-9)


def test_recover_times(spark):
    ns = [123456789, 124000000, 125111111, 200000000, 200000001, 200000010]
    gaps = [(math.log1p((b - a) / 1e9),) for a, b in zip(ns, ns[1:])]
    frame = session_frame(spark, [gaps], "f0 double")
    anchors = [("S0", "2025-02-03", 0, ns[0]), ("S0", "2025-02-03", 3, ns[3]), ("S0", "2025-02-03", 5, ns[5])]
    schema = "symbol string, date string, r bigint, anchor_ns bigint"
    found = events.recover_ns(frame, spark.createDataFrame(anchors, schema))
    events.require_same_offsets(found)
    assert [r.ts_ns for r in found.orderBy("r").collect()] == ns[1:]
    shifted = [*anchors[:2], (*anchors[2][:3], ns[5] + 10)]
    with pytest.raises(ValueError, match="disagree"):
        events.require_same_offsets(events.recover_ns(frame, spark.createDataFrame(shifted, schema)))


def test_code_parity(spark):
    a = session_frame(spark, [[(0, 1, 2), (1, 1, 1)]], "c0 int, c1 int, c2 int")
    events.assert_same_codes(a, a)
    with pytest.raises(ValueError, match="1 events"):
        events.assert_same_codes(a, a.where("e = 0"))
    with pytest.raises(ValueError, match="2 events"):
        events.assert_same_codes(a, a.withColumn("c1", F.lit(3)))


def train_frame(spark, rows):
    return spark.createDataFrame(rows, "f0 double, f1 double, f2 double")


def test_bins_of_equal_values(spark):
    zeros = train_frame(spark, [(0.0, 0.0, 0.0)] * 100)
    binner = tokens.fit_bins(zeros, 8)
    assert binner.edges == ((0.0,) * 7,) * 3 and binner.centers == ((0.0,) * 8,) * 3
    coded = tokens.assign_bins(train_frame(spark, [(1e6, -1e6, 0.0)]), binner.edges).first()
    assert (coded.c0, coded.c1, coded.c2) == (7, 0, 7)
    with pytest.raises(ValueError, match="finite"):
        tokens.fit_bins(train_frame(spark, [(float("nan"), 0.0, 0.0)]), 8)
    with pytest.raises(ValueError, match="No training"):
        tokens.fit_bins(zeros.where("f0 > 1"), 8)
    assert tokens.Binner.from_frame(binner.to_frame(spark)) == binner


def test_edges_ignore_other_splits(spark):
    random.seed(3)
    rows = [("train" if i % 2 else "heldout", random.random(), random.random(), random.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "split string, f0 double, f1 double, f2 double")
    changed = df.withColumn("f2", F.when(F.col("split") == "heldout", 1e9).otherwise(F.col("f2")))
    assert tokens.fit_bins(df.where("split = 'train'"), 8) == tokens.fit_bins(changed.where("split = 'train'"), 8)


def test_joint_and_sequential_codes(spark):
    cube = spark.range(512).select(*[F.floor(F.col("id") / 8**k) % 8 for k in (2, 1, 0)]).toDF("a", "b", "c")
    token = joint_encode([F.col(c) for c in "abc"], 8)
    back = cube.withColumn("t", token).withColumns({f"d{i}": c for i, c in enumerate(joint_decode(F.col("t"), 8))})
    assert back.select("t").distinct().count() == 512 and back.where("a <> d0 or b <> d1 or c <> d2").count() == 0
    one = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],)], "ev array<array<int>>").withColumn("s", seq_encode(F.col("ev"), 8, (2, 0, 1)))
    row = one.withColumn("back", seq_decode(F.col("s"), 8, (2, 0, 1))).first()
    assert row.s == [19, 1, 10, 22, 4, 13] and row.back == row.ev
    for bad in ([1, 2], [19, 1, 99]):
        with pytest.raises(Exception, match="multiple of 3|block of its field"):
            spark.createDataFrame([(bad,)], "s array<int>").select(seq_decode(F.col("s"), 8, (2, 0, 1))).collect()


def test_windows_stay_in_their_session(spark):
    sequences = [[(10 * i + j,) for j in range(n)] for i, n in enumerate((7, 40, 3))]
    coded = session_frame(spark, sequences, "token int")
    for stride in (1, 2, 5, 11):
        got = {(r.symbol, r.start): r.tokens for r in windows.windows(coded, 4, stride).collect()}
        expected = {
            (f"S{i}", s): [t for (t,) in seq[s : s + 5]] for i, seq in enumerate(sequences) for s in range(0, len(seq) - 4, stride)
        }
        assert got == expected


def test_window_numbers(spark):
    sessions = spark.createDataFrame(
        [("A", "1", "train", 9), ("A", "2", "train", 5), ("B", "1", "train", 4), ("B", "2", "val", 6), ("C", "1", "train", 8)],
        "symbol string, date string, split string, events bigint",
    )
    counts = windows.window_counts(sessions, 4, 2)
    assert [(r.first, r.last) for r in counts.where("split = 'train'").orderBy("symbol", "date").collect()] == [(0, 3), (3, 4), (4, 4), (4, 6)]
    asked = spark.createDataFrame([("train", i) for i in range(6)], "split string, window_index bigint")
    placed = windows.locate(asked, counts, 2).orderBy("window_index").collect()
    assert [(r.symbol, r.date, r.start) for r in placed] == [("A", "1", 0), ("A", "1", 2), ("A", "1", 4), ("A", "2", 0), ("C", "1", 0), ("C", "1", 2)]
    even = windows.evaluation_subset(spark.createDataFrame([("a", 10), ("b", 3), ("c", 1)], "split string, n bigint"), 4)
    got = {}
    for r in even.collect():
        got.setdefault(r.split, []).append(r.window_index)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [0, 3, 6, 9], "b": [0, 1, 2], "c": [0]}


def test_coverage_of_one_window(spark):
    totals = spark.createDataFrame([("train", 1)], "split string, n bigint")
    stream = windows.sample_stream(totals, [42], 4, 2)
    assert stream.count() == 8
    located = stream.select("seed", "step", F.lit("S").alias("symbol"), F.lit("1").alias("date"), F.lit(0).alias("start"))
    got = {(r.supervision, r.step): (r.target_exposures, r.unique_targets) for r in windows.coverage(located, 3, 2, [4]).collect()}
    assert got == {("last", 4): (8, 1), ("dense", 4): (24, 3)}


def test_streams_and_subsets_are_fixed_nested_and_even(spark):
    totals = spark.createDataFrame([("train", 10)], "split string, n bigint")
    draws = [r.window_index for r in windows.sample_stream(totals, [1], 500, 10).orderBy("step", "slot").collect()]
    again = [r.window_index for r in windows.sample_stream(totals, [1], 500, 10).orderBy("step", "slot").collect()]
    assert draws == again and all(400 < draws.count(i) < 600 for i in range(10))
    df = spark.range(1000).withColumnRenamed("id", "example")
    ranked = windows.nested_subsets(df.repartition(5), ["example"], [1, 2], [10, 50])
    sets = {(s, b): {r.example for r in ranked.where((F.col("seed") == s) & (F.col("rank") <= b)).collect()} for s in (1, 2) for b in (10, 50)}
    assert sets[1, 10] < sets[1, 50] and len(sets[1, 50]) == 50 and sets[1, 50] != sets[2, 50]


def chain_frame(spark):
    frame = session_frame(spark, [[(0,), (1,), (0,), (1,)], [(1,), (1,), (0,)]], "token int")
    return ordering.framed(frame, KEY, "e", lambda w: {"prev": F.lag("token").over(w)}, before=1)


def test_transitions(spark):
    frame = chain_frame(spark)
    got = lambda stride: {(r.prev, r.next): r.n for r in markov.transition_counts(frame, 1, stride).collect()}
    assert got(1) == {(0, 1): 2, (1, 0): 2, (1, 1): 1}
    assert got(2) == {(0, 1): 2, (1, 1): 1}


def test_shrinkage_and_strength(spark):
    counts = spark.createDataFrame([(0, 0, 90), (0, 1, 10)], "prev int, next int, n bigint")
    prior = spark.createDataFrame([(0, 0.5), (1, 0.5)], "token int, p double")
    pairs = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "prev int, next int")
    got = {(r.prev, r.next): r.p for r in markov.shrinkage_prob(pairs, counts, prior, 10, 2).collect()}
    assert got == pytest.approx({(0, 0): 95 / 110, (0, 1): 15 / 110, (1, 0): 0.5, (1, 1): 0.5})
    val = spark.createDataFrame([(0, 1), (0, 1)], "prev int, next int")
    assert markov.select_strength(markov.strength_scores(val, counts, prior, [1, 100], 2)).first().strength == 100
    same = spark.createDataFrame([(1, 1)], "prev int, next int")
    assert markov.select_strength(markov.strength_scores(same, counts, prior, [100, 1, 10], 2)).first().strength == 1
    for bad in (0, -1):
        with pytest.raises(ValueError, match="positive"):
            markov.shrinkage_prob(pairs, counts, prior, bad, 2)
    markov.check_prior(prior)
    with pytest.raises(ValueError, match="prior"):
        markov.check_prior(prior.where("token = 0"))


def test_field_losses(spark):
    counts = spark.createDataFrame([(0, t, t + 1) for t in range(8)], "prev int, next int, n bigint")
    prior = spark.createDataFrame([(t, (t + 1) / 36) for t in range(8)], "token int, p double")
    pairs = spark.createDataFrame([(0, 5)], "prev int, next int")
    row = markov.field_nll(pairs, counts, prior, 3.0, 2).first()
    assert [row.interval_nll, row.price_nll, row.size_nll] == pytest.approx([-math.log(26 / 36), -math.log(11 / 26), -math.log(6 / 11)])
    assert row.nll == pytest.approx(row.interval_nll + row.price_nll + row.size_nll)


def test_occupancy_reports_empty_bins(spark):
    coded = spark.createDataFrame([(0, 1, 1)], "c0 int, c1 int, c2 int")
    got = {(r.field, r.bin): r.n for r in tokens.bin_occupancy(coded, 2).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1, (2, 0): 0, (2, 1): 1}
