"""Trie, fingerprints and whitening against plain Python and numpy, with every odd case."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import fingerprints, trie, whitening

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- trie


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole[c] = tuple(t[2:] for t in [*own.get(base, [])[:h], *own[c][h:]])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], set()).add(c)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    out = set()

    def walk(prefix):
        below = [walk(k) for k in children.get(prefix, [])]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + ((len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0)
        ends = ",".join(map(str, sorted(c for c in members[prefix] if len(whole[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.add((min(members[prefix]), len(prefix), parent, len(members[prefix]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return out


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 207, 399, -3, -105]:
        for turn in range(rng.choice([0, 1, 1, 2, 3, 6, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "é", ""])))
    rows += [(300, t, "user", f"long {t}") for t in range(12)]  # a long one and two copies of it, one longer
    rows += [(500, t, "user", f"long {t}") for t in range(12)] + [(600, t, "user", f"long {t}") for t in range(13)]
    for c in range(700, 720):  # many equal ones
        rows += [(c, 0, "user", "same"), (c, 1, "user", "end")]
    rows += [(800, None, "user", "first"), (800, 5, None, "x"), (800, 5, "user", None), (800, 5, "user", "tie"), (800, 5, "user", "tie"), (None, 0, "user", "lost")]
    rng.shuffle(rows)
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, key string, chunk int"


@pytest.mark.parametrize("limit", [3, 100_000])
def test_trie(spark, tables, limit):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], CONVERSATIONS).repartition(4)
    got = [tuple(r) for r in trie.report(df, limit).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_chunks_and_folds(spark, tables, monkeypatch):
    """Chunk and fold borders inside strings and groups."""
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = odd_conversations()
    rows += [(c, t, "user", "many") for c in range(2000, 2040) for t in range(6)]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], CONVERSATIONS)
    assert {tuple(r) for r in trie.report(df, 5).collect()} == brute_trie(rows)
    ids = list(range(5000))
    folded = trie._digest(trie._fold(iter([_members(ids[:1300]), _members(ids[1300:])])))
    [got] = [r for b in folded for r in b.to_pylist()]
    assert got == {"rep": 0, "length": 3, "copies": 5000, "ends": hashlib.sha256(",".join(map(str, ids)).encode()).digest()}


def _members(ids):
    import pyarrow as pa

    same = lambda x: pa.array([x] * len(ids), pa.int64())
    return pa.RecordBatch.from_arrays([same(1), same(2), same(3), pa.array(ids, pa.int64())], ["a", "b", "length", "conv_id"])


def test_trie_of_nothing(spark, tables):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert trie.report(none).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x", 0, "", 0)], CONVERSATIONS)
    assert trie.report(lost).count() == 0


# ---------------------------------------------------------------- fingerprints


def sketch(text, k=128):
    words = SPACED.findall(text or "")
    runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return sorted(hashlib.md5(r.encode()).hexdigest()[:16] for r in runs)[:k]


def alike(a, b, k=128):
    union = sorted(set(a) | set(b))[:k]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


@pytest.mark.parametrize("k", [128, 4])
def test_fingerprints(spark, tables, corpus, k):
    rows = corpus[0] + [(None, "no id"), (None, None), (5, "tie b"), (5, "tie a"), (5, "tie a"), (-7, "least id of all here")]
    line = sorted(((i is None, -(i or 0), t or "", i) for i, t in rows))
    want = []
    for at, (_, _, text, i) in enumerate(line):
        following = line[(at + 1) % len(line)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = sketch(text, k), sketch(edited, k), sketch(following, k)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b, k), alike(a, c, k)))
    schema = "doc_id long, text string, sketch string, next int, __home int, __words int, __guest int, n_chars int"
    df = spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, 5) for i, t in rows], schema).repartition(7)
    got = [tuple(r)[:7] for r in fingerprints.report(df, k).collect()]
    by = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=by) == sorted(want, key=by)
    lined = fingerprints.with_next(df)
    assert lined.count() == len(rows) and set(df.columns) - {"sketch", "next"} <= set(lined.columns)


def test_fingerprints_of_few_rows(spark, tables):
    schema = "doc_id long, text string"
    assert fingerprints.report(spark.createDataFrame([], schema)).count() == 0
    [one] = fingerprints.report(spark.createDataFrame([(4, "abcd")], schema)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    lost = fingerprints.report(spark.createDataFrame([(None, "b d"), (None, "a c")], schema)).collect()
    assert sorted(r.edited_sha256 for r in lost) == sorted(hashlib.sha256(x).hexdigest() for x in (b"a b", b"b a"))


def test_sketches_merge_and_estimate(spark, tables):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    words = [word() for _ in range(6000)]
    parts = [(g, " ".join(words[s : s + 1004])) for g, s in enumerate(range(0, 5000, 1000))]
    df = spark.createDataFrame([("all", t) for _, t in parts] + [("none", " "), (None, "one two"), (None, "one two")], "g string, text string")
    got = {r.g: r.sketch for r in fingerprints.merged(fingerprints.sketched(df), ["g"]).collect()}
    assert got == {"all": sketch(" ".join(words[:5004])), "none": [], None: sketch("one two")}
    half = spark.createDataFrame([(" ".join(words[:4000]), " ".join(words[2000:6000]), " ".join(words[:2000]))], "a string, b string, c string")
    for c in "abc":
        half = fingerprints.sketched(half, c, f"s{c}", 1024)
    a, b, c = F.col("sa"), F.col("sb"), F.col("sc")
    est = half.select(fingerprints.resemblance(a, b, 1024), fingerprints.containment(c, a, 1024), fingerprints.containment(a, c, 1024), fingerprints.distinct_shingles(a, 1024)).first()
    assert abs(est[0] - 1 / 3) < 0.06 and est[1] > 0.9 and abs(est[2] - 0.5) < 0.08 and abs(est[3] / 3996 - 1) < 0.12


def test_fingerprints_stay_in_the_jvm(spark, tables):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = fingerprints.report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1  # the texts are shuffled once


# ---------------------------------------------------------------- whitening


def quantised(rows):
    keep = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in keep), default=0)
    return [(i, x) for i, x in keep if dims and len(x) == dims]


def check_whitening(spark, rows, kind="float", components=16):
    df = spark.createDataFrame([(v, i, 3, "n") for i, v in rows], f"embedding array<{kind}>, vec_id long, n int, component string").repartition(3)
    got = whitening.report(df, components).collect()
    kept = quantised(rows)
    x = np.array(sorted({tuple(v) for _, v in kept}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    t = (x * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(t.T @ t / n)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    m = min(components, int(np.sum(values > 1e-12 * values[0])))
    assert len(got) == m * len(kept)
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r)
    by_id = {}
    for i, v in kept:
        by_id.setdefault(i, []).append(np.array(v, dtype=object))
    w = np.zeros((len(kept), m))
    want = np.zeros((len(kept), m))
    at = 0
    for i, vs in by_id.items():
        assert sorted(r.deviation for r in found[i]) == sorted(int(((v * n - sums) ** 2).sum()) for v in vs for _ in range(m))
        assert len(found[i]) == len(vs) * m
        if len(vs) == 1:
            for r in found[i]:
                w[at, r.component - 1] = r.whitened
                assert r.n == n and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and 0 <= r.identity_error < 1e-8
            want[at] = (vs[0] * n - sums).astype(float) / n @ vectors[:, :m] / np.sqrt(values[:m])
            at += 1
    return w[:at], want[:at], values


def test_whitening(spark, tables):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((24, 24))
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(24) @ mix]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector many times
    rows += [(2000, None), (2001, []), (2002, [1.0] * 23), (2003, [*rows[0][1][:-1], None]), (2004, [*rows[0][1][:-1], float("nan")]), (2005, [float("inf")] * 24)]
    w, want, values = check_whitening(spark, rows)
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w * signs - want).max() < 1e-8 and np.all(values[:-1] / values[1:] > 1.001)


def test_whitening_of_repeated_and_missing_directions(spark, tables):
    """Equal variances in several directions, constant dimensions and fewer rows than dimensions."""
    corners = [[a, b, c, 0.0, 5.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    w, want, values = check_whitening(spark, list(enumerate(corners)), "double")
    assert w.shape[1] == 3 and np.allclose(w.T @ w / len(w), np.eye(3), atol=1e-10)  # any turn of the three is right
    rng = np.random.default_rng(8)
    few = [(i, rng.standard_normal(30).tolist()) for i in range(6)]
    w, want, _ = check_whitening(spark, few, "double")
    assert w.shape[1] == 5 and np.abs(np.abs(w) - np.abs(want)).max() < 1e-8


def test_whitening_of_little(spark, tables):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]):
        assert whitening.report(spark.createDataFrame(rows, schema)).count() == 0
    got = whitening.report(spark.createDataFrame([(1, [0.0]), (None, [1.0])], schema)).collect()
    assert sorted(abs(r.whitened) for r in got) == [1.0, 1.0] and {r.deviation for r in got} == {64**2}
    huge = whitening.report(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], schema)).collect()
    assert {r.deviation for r in huge} == {None}


def test_bidiagonalisation_ends_early_with_the_right_values():
    """On a wide matrix few steps do, and a value that occurs twice is found twice."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    r, _ = np.linalg.qr(rng.standard_normal((400, 300)))
    sigma = np.concatenate([[100.0, 90.0, 90.0, 50.0], 0.9 ** np.arange(296)])
    x = (r * sigma) @ q.T
    steps = []

    def products(basis, v):
        steps.append(1)
        w = x @ v
        return x.T @ w, (x @ basis).T @ w, float(w @ w)

    v, b = whitening.bidiagonalised(products, 300, 4, rng)
    assert np.allclose(np.linalg.svd(b)[1][:4], sigma[:4], rtol=1e-12) and len(b) < 120
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12 and np.abs(np.triu(b, 2)).max() == 0 and np.abs(np.tril(b, -1)).max() == 0
