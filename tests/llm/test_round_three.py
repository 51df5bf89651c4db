"""Counts and verdicts of the operators that were reworked, against brute force and the library."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import quality, tokencounts
from tapeloom.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")


def test_token_counts_of_odd_texts_equal_the_library(spark, tables):
    rng = random.Random(9)
    alphabet = ["a", "b", "e", "th", "ing", " ", "  ", "▁", "é", "日", "本", "\n", "\t", "0", "<s>", "</s>", "🙂", "́", "q", "-", "=="]
    texts = [None, "", " ", "   ", "a", " a", "a "] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += ["x" * 5000, "=" * 3000, "".join(rng.choice("ACGT") for _ in range(20_000)), texts[9]]
    model = tokencounts.Model(PATH)
    assert model.totals([t or "" for t in texts]) == [len(model.model.encode(t or "")) for t in texts]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_ string, text__ int, prefix_tokens int").repartition(3)
    got = {r.doc_id: r for r in tokencounts.token_totals(docs, PATH).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(model.model.encode(t or "")) for i, t in enumerate(texts)}
    assert {(r.text_, r.text__, r.prefix_tokens) for r in got.values()} == {("x", 1, 2)}
    cut = tokencounts.truncated(docs, PATH, 7)
    assert cut.columns == docs.columns and max(len(model.model.encode(r.text or "")) for r in cut.collect()) == 7
    assert tokencounts.report(docs.where("false"), PATH).count() == 0


def test_prefixes_of_a_text_without_spaces():
    """Every prefix of a short one against the library; a long one in one go."""
    model = tokencounts.Model(PATH)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdeé日-") for _ in range(400))
    assert model.prefixes(text).tolist() == [len(model.model.encode(text[: i + 1])) for i in range(len(text))]
    long = "".join(rng.choice("abcdefghij日") for _ in range(100_000))
    assert model.total(long) == len(model.model.encode(long))


def test_log_ratios_and_verdicts(spark, tables, corpus, monkeypatch):
    """Both multinomials recounted by plain dictionaries over the hashed words and pairs."""
    from tapeloom.llm.scan import SPACED, scan, text_bytes
    import pyarrow as pa

    monkeypatch.setattr(quality, "FAN_IN", 2)
    rows = [*corpus[0], (3, None), (None, corpus[0][30][1])]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, trusted int, id__ string").repartition(5)
    labels = spark.createDataFrame([(i, q) for i, q in [(20, 1), (21, 1), (22, 1), (22, 0), (25, 1), (25, 1), (None, 1), (999, 1)]], "doc_id long, quality int")
    trusted = {20, 21, 25}
    grams = []
    for _, t in rows:
        words = scan(*text_bytes(pa.array([t or ""])), SPACED).hash
        both = [int(h) for h in words] + [int(quality.mix(words[i : i + 1] * quality._PAIR + words[i + 1 : i + 2])[0]) for i in range(len(words) - 1)]
        grams.append([g >> (64 - quality.BUCKET_BITS) for g in both])
    raw, target = collections.Counter(), collections.Counter()
    for (i, _), g in zip(rows, grams):
        raw.update(g)
        if i in trusted:
            target.update(g)
    size, total = 1 << quality.BUCKET_BITS, sum(raw.values())
    smooth = {b: quality.SMOOTHING * n / total * size for b, n in raw.items()}
    p = {b: math.log((target[b] + smooth[b]) / (sum(target.values()) + sum(smooth.values()))) for b in raw}
    q = {b: math.log((raw[b] + smooth[b]) / (total + sum(smooth.values()))) for b in raw}
    want = [sum(p[b] - q[b] for b in g) / max(1, len(g)) for g in grams]
    got = quality.report(docs, labels).collect()
    assert np.allclose(sorted(r.log_ratio for r in got), sorted(want), atol=1e-5)
    assert sum(r.kept for r in got) == sum(w >= quality.THRESHOLD and not f for w, f in zip(sorted(want), [r.base_failed for r in sorted(got, key=lambda r: r.log_ratio)]))
    assert all(r.kept == (not r.base_failed and r.log_ratio >= quality.THRESHOLD) for r in got) and 0 < sum(r.kept for r in got) < len(got)
    empty = quality.report(docs.where(F.lit(False)), labels)
    assert empty.count() == 0


def _matrix(parts, shards, seed):
    from tapeloom.llm import sharding

    rows = [sharding.matrix_row(np.cumsum(parts), shards, seed, p) for p in range(len(parts))]
    table = np.array([own for own, _ in rows])
    assert (table.sum(axis=1) == parts).all() and (table.sum(axis=0) == sharding.shard_sizes(sum(parts), shards)).all()
    for p, (_, before) in enumerate(rows):
        assert (before == table[:p].sum(axis=0)).all()
    return table


def test_matrix_has_the_law_of_a_uniform_shuffle():
    """Every matrix of a tiny case occurs as often as among all ways to deal the rows."""
    import itertools

    parts, shards = [2, 1, 3], 2
    owner = [p for p, n in enumerate(parts) for _ in range(n)]
    want = collections.Counter()
    for chosen in itertools.combinations(range(6), 3):
        want[tuple(sum(owner[c] == p for c in chosen) for p in range(3))] += 1
    draws = 6000
    got = collections.Counter(tuple(_matrix(parts, shards, seed)[:, 0].tolist()) for seed in range(draws))
    assert set(got) <= set(want)
    chi = sum((got[m] - draws * w / 20) ** 2 / (draws * w / 20) for m, w in want.items())
    assert chi < 25  # 5 degrees of freedom


def test_matrix_of_billions_of_rows():
    """Margins are exact and moments right where counts are beyond numpy's sampler."""
    parts, shards = [3_000_000_001, 17, 0, 5_000_000_000, 2_500_000_000], 3
    first = np.array([_matrix(parts, shards, seed)[0] for seed in range(400)], float)
    total = sum(parts)
    mean = parts[0] / shards
    deviation = (parts[0] * (1 / 3) * (2 / 3) * (total - parts[0]) / (total - 1)) ** 0.5
    z = (first - mean) / deviation
    assert np.abs(z.mean(axis=0)).max() < 4 / 20 and np.abs(z.std(axis=0) - 1).max() < 0.15
    assert np.corrcoef(z[:, 0], z[:, 1])[0, 1] < -0.3


def test_rejection_agrees_with_exact_probabilities():
    from tapeloom.llm import sharding

    rng = np.random.default_rng(3)
    good, bad, n, draws = 12, 30, 9, 20_000
    got = collections.Counter(sharding._by_rejection(rng, good, bad, n) for _ in range(draws))
    p = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)}
    chi = sum((got[k] - draws * v) ** 2 / (draws * v) for k, v in p.items() if draws * v > 5)
    assert chi < 28
    for a, b in ((1_000, 1_500), (10**10, 10**10 + 12345), (5_000, 4_000)):
        exact = math.fsum(math.log(x) for x in range(min(a, b) + 1, max(a, b) + 1)) * (1 if a > b else -1)
        assert abs(sharding._log_factorials(a, b) - exact) < 1e-9 * abs(exact)


def test_sharding_of_odd_tables(spark, tables):
    from tapeloom.llm import sharding

    rows = [(i % 3, "same", 7, 1) for i in range(100)] + [(None, None, 7, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, row__ int, dealt int").repartition(6)
    got = sharding.shuffled(df, 4)
    assert got.columns == ["doc_id", "text", "row__", "dealt", "shard", "slot"]
    taken = sorted((r.shard, r.slot) for r in got.collect())
    assert taken == [(s, k) for s, n in enumerate([26, 26, 26, 25]) for k in range(n)]
    assert sharding.report(df.where("false")).count() == 0


def test_ftrl_against_a_plain_loop(spark, tables):
    """The classifier's weights by dictionaries and Python floats, one coordinate at a time, and scores from them."""
    from tapeloom.llm import toxicity

    rng = random.Random(6)
    bad, good = ["vile", "rotten", "awful"], ["table", "river", "cloud", "seven"]
    settings = toxicity.Settings(alpha=0.5, beta=1.0, l1=0.4, l2=0.1, passes=3)
    sets, labels = [], []
    for i in range(120):
        y = int(rng.random() < 0.4)
        own = rng.sample(range(40), rng.randrange(0, 9)) + ([50 + rng.randrange(3)] if y and rng.random() < 0.8 else [])
        sets.append(np.array(sorted(set(own)), np.uint32))
        labels.append(y)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        if k != "bias" and abs(z[k]) <= settings.l1:
            return 0.0
        lift, l2 = (0.0, 0.0) if k == "bias" else (math.copysign(settings.l1, z[k]), settings.l2)
        return (lift - z[k]) / ((settings.beta + math.sqrt(n[k])) / settings.alpha + l2)

    for _ in range(settings.passes):
        for own, y in zip(sets, labels):
            keys = [*own.tolist(), "bias"]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k in keys:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / settings.alpha * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in z if k != "bias" and weight(k)}
    feature, got, bias = toxicity.ftrl(sets, np.array(labels), settings)
    assert set(feature.tolist()) == set(want) and 3 < len(want) < 43
    assert np.allclose([want[f] for f in feature.tolist()], got, atol=2e-4) and abs(bias - weight("bias")) < 2e-4
    # Repeated rows, nulls, empty tables and extra columns.
    texts = [(i, f"{rng.choice(bad)} {rng.choice(good)} {rng.choice(good)}" if i % 3 == 0 else f"{rng.choice(good)} {rng.choice(good)}") for i in range(90)]
    rows = [(i, t, 1, "s") for i, t in texts] + [(None, "vile", 1, "s"), (1, None, 1, "s"), (2, "", 1, "s"), (2, "", 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y__ int, score string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity.report(docs, marks)
    assert found.count() == 94 and found.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.report(docs.where("false"), marks).count() == 0
    assert {r.score for r in toxicity.report(docs, marks.where("false")).collect()} == {0.5}


def test_packing_against_the_least_possible():
    """Tiny cases: never more than one sequence above the optimum that a search of all packings finds, mostly none above."""
    from tapeloom.llm import packing

    rng = random.Random(12)

    def optimum(sizes, capacity):
        best = len(sizes)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                    place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return best

    above = 0
    for _ in range(150):
        capacity = rng.choice([7, 10, 16])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        plan = packing.make_plan(dict(collections.Counter(sizes)), capacity)
        length, rank = np.array(sizes), np.array([sizes[:i].count(s) for i, s in enumerate(sizes)])
        sequence, offset = plan.place(length, rank)
        used = collections.defaultdict(list)
        for s, at, n in zip(sequence.tolist(), offset.tolist(), sizes):
            used[s].append((at, n))
        for pieces in used.values():
            pieces.sort()
            assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= capacity
        least = optimum(sizes, capacity)
        assert least <= len(used) <= least + 1
        above += len(used) > least
    assert above <= 15


def test_packing_of_odd_tables(spark, tables):
    from tapeloom.llm import packing

    path = tokenizer("byte_bpe_50k.json")
    rows = [(1, "a b", 5, 6), (1, "a b", 5, 6), (None, None, 5, 6), (2, "", 5, 6), (3, "word " * 3000, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, offset int")
    got = packing.pack(docs, path).collect()
    assert sorted(r.doc_id or 0 for r in got if r.piece == 0) == [0, 1, 1, 2, 3] and all(0 < r.length <= 1024 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) for v in by.values())
    assert packing.pack(docs.where("false"), path).count() == 0
