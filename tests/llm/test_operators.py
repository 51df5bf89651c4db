"""The operators against brute force on the small corpus."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate, katz, minhash, packing, quality, sharding, substrings, suffixes, tokencounts, toxicity
from tapeloom.llm.queries import QUERIES, tokenizer

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination(tables, corpus, block_bytes):
    rows, items = corpus
    windows = collections.defaultdict(set)
    for k, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(k))
    want = {}
    for i, text in rows:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit[s : s + n] = [1] * n
                    found |= own
        want[i] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    docs, bench = tables
    got = by_id(decontaminate.report(docs, bench, block_bytes=block_bytes), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == want and sum(v[4] for v in want.values()) == 2
    kept = decontaminate.clean_rows(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if not v[4]}


def test_decontamination_of_spans(tables):
    docs, bench = tables
    left = decontaminate.decontaminate(docs.where("doc_id in (0, 14)"), bench, mode="spans")
    again = decontaminate.report(left.select(F.col("id").alias("doc_id"), "text"), bench)
    assert [r.n_hit for r in again.collect()] == [0, 0]


def test_substrings(tables, corpus):
    seen, want = set(), {}
    for i, text in corpus[0]:
        w = SPACED.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert by_id(substrings.report(tables[0]), "n_words", "n_removed", "kept_sha256") == want


def test_suffixes(tables, corpus):
    raw = [(i, (t or "").encode()) for i, t in corpus[0]]
    seen = collections.Counter(b[s : s + 200] for _, b in raw for s in range(len(b) - 199))
    want = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = sum(1 for q in range(len(b)) if gone[q] and not (q and gone[q - 1]))
        want[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    assert by_id(suffixes.report(tables[0]), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffixes.deduplicated(tables[0], bytewise=False).where("kept is null").count() == 1


def test_merging_runs_keeps_order_and_prefixes():
    rng = np.random.default_rng(3)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for _ in range(n)) for n in (0, 5, 1, 17, 30)]
    shared = [suffixes.front_coded(r)[0].tolist() for r in runs]
    order, lengths = suffixes.merge(runs, shared)
    turn = [iter(r) for r in runs]
    merged = [next(turn[k]) for k in order]
    assert merged == sorted(x for r in runs for x in r)
    assert lengths == [0] + [suffixes.common(a, b) for a, b in zip(merged[:-1], merged[1:], strict=True)]


def test_near_copies(tables, corpus):
    sets = {}
    for i, text in corpus[0]:
        w = SPACED.findall(text or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    got = by_id(minhash.report(tables[0]), "class_id", "keep")
    assert got == {i: (root[i], root[i] == i) for i in sets}
    kept = minhash.clean_rows(tables[0])
    assert kept.columns == tables[0].columns and kept.count() == len(set(root.values()))


def test_near_copies_of_a_dense_group(spark):
    """Copies with five changed words each: all in one class, though most pairs are below the similarity and no star joins them."""
    rng, rows = np.random.default_rng(7), []
    for d in range(600):
        words = [f"b{k}" for k in range(400)]
        for k in rng.choice(400, 5, replace=False).tolist():
            words[k] = f"x{d}_{k}"
        rows.append((d, " ".join(words), "kept"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    assert {r.class_id for r in minhash.report(docs).collect()} == {0}
    left = minhash.clean_rows(docs).collect()
    assert [tuple(r) for r in left] == rows[:1]


@pytest.mark.parametrize("weighted", [False, True])
def test_near_copies_of_a_group_with_few_links(spark, monkeypatch, weighted):
    """Copies with six changed words each: few of all pairs are links, and every link counts, across blocks too."""
    monkeypatch.setattr(minhash, "BLOCK", 100)
    rng, sets = np.random.default_rng(8), {}
    for d in range(1200):
        words = [f"b{k % 390}" for k in range(400)]
        for k in rng.choice(400, 6, replace=False).tolist():
            words[k] = f"x{d}_{k}"
        sets[d] = words
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in sets.items()], "doc_id long, text string")
    bags = {d: collections.Counter(tuple(w[k : k + 5]) for k in range(396)) for d, w in sets.items()}
    names = {g: i for i, g in enumerate(sorted({g for b in bags.values() for g in b}))}
    most = 2 if weighted else 1
    have = np.zeros((len(bags), most * len(names)), np.float32)
    for d, bag in bags.items():
        for g, n in bag.items():
            have[d, [most * names[g] + k for k in range(min(n, most))]] = 1
    shared, size = have @ have.T, have.sum(axis=1)
    linked = shared >= 0.8 * (size[:, None] + size - shared)
    want = np.arange(len(bags))
    while (now := np.where(linked, want, len(bags)).min(axis=1)).tolist() != want.tolist():
        want = now
    got = by_id(minhash.report(docs, weighted=weighted), "class_id")
    assert [got[d][0] for d in range(len(bags))] == want.tolist() and 1 < len(set(want.tolist())) < len(bags)


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    element = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    a, b = rng.integers(1, 4, 400).astype(float), rng.integers(0, 4, 400).astype(float)
    have = b > 0
    signature = minhash.signatures(np.concatenate([element, element[have]]), np.concatenate([a, b[have]]), np.repeat([0, 1], [400, int(have.sum())]), 2, k=2000)
    assert abs((signature[0] == signature[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_packing(tables, corpus):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(tables[0], path).toPandas().sort_values(["doc_id", "piece"])
    for i, text in corpus[0]:
        ids, own, at = [*library.encode(text or "", add_special_tokens=False).ids, 2], got[got.doc_id == i], 0
        for k, p in enumerate(own.itertuples()):
            assert (p.piece, p.start) == (k, at) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids) and (len(own) == -(-len(ids) // 1024)) and (own.length[1:] == 1024).all()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024


def test_packing_plan_is_tight_and_whole():
    rng = np.random.default_rng(4)
    counts = collections.Counter(rng.integers(1, 1025, 5000).tolist())
    plan = packing.make_plan(dict(counts))
    length = np.concatenate([np.full(n, k) for k, n in counts.items()])
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = plan.place(length, rank)
    used = np.zeros((plan.sequences, 1024), np.int8)
    for s, o, n in zip(sequence, offset, length, strict=True):
        used[s, o : o + n] += 1
    assert used.max() == 1 and plan.sequences <= 1.02 * length.sum() / 1024 + 1


def test_sharding(tables, corpus):
    got = sharding.report(tables[0], shards=7).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and sorted(got.doc_id) == [i for i, _ in corpus[0]]
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert dict(zip(got.doc_id, got.text_crc32, strict=True)) == {i: zlib.crc32((t or "").encode()) for i, t in corpus[0]}
    n = np.arange(1000)
    assert sorted(sharding.permuted(n, np.full(1000, 1000), np.full(1000, 9))) == n.tolist()


def test_quality(spark, tables, corpus):
    labels = spark.createDataFrame([(i, int(i > 18), 0) for i, _ in corpus[0]], "doc_id long, quality int, toxic int")
    want = {}
    for i, text in corpus[0]:
        text = text or ""
        w, seen, dup = SPACED.findall(text), set(), 0
        for line in text.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = [0] * len(w)
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                cover[k : k + 8] = [1] * 8
        want[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(cover), len(w) < 20 or 100 * sum(cover) > 30 * len(w))
    got = quality.report(tables[0], labels)
    assert by_id(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("kept and base_failed").count() == 0 and got.where("kept").count() > 20


def test_quality_counts_all_trusted_texts(spark):
    labels = spark.range(20_050).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(labels).count() == 20_050


def test_katz(tables, corpus):
    tokens = {i: [*SPACED.findall((t or "").translate(LOWER)), None] for i, t in corpus[0]}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c1, c2, after = collections.Counter(), collections.Counter(), collections.Counter()
    for i in train:
        c1.update(tokens[i])
        c2.update(zip(["<s>", *tokens[i]], tokens[i], strict=False))
        after.update(["<s>", *tokens[i][:-1]])
    total, distinct = sum(c1.values()), len(c1)
    few = collections.Counter(c1.values())
    unigrams = katz.Unigrams(np.array([total, distinct, *[few[r] for r in range(1, 7)]]))
    p1 = lambda w: float(unigrams.p(np.array([c1[w]]))[0])
    pairs = collections.Counter(c2.values())
    factors = katz.discounts({1: total - sum(c for c in c2.values() if c > 1), **{r: pairs[r] for r in range(2, 7)}})

    def after_(u):
        n, seen = max(after[u], 1), {w: c for (v, w), c in c2.items() if v == u and c > 1}
        taken = sum(factors[min(c, 6)] * c for c in seen.values()) / n
        scale = n / (n + 1) if 1 - taken < 1 / (n + 1) else 1.0
        rest = (1 - scale * taken) / (1 - sum(p1(w) for w in seen)) if seen else 1.0
        return lambda w: scale * factors[min(seen[w], 6)] * seen[w] / n if w in seen else rest * p1(w)

    assert abs(sum(after_("<s>")(w) for w in c1) + (after_("<s>")("never seen")) - 1) < 1e-9
    got = by_id(katz.report(tables[0], least=2), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, t in tokens.items():
        score = sum(math.log10(after_(u)(w)) for u, w in zip(["<s>", *t], t, strict=False))
        base = sum(math.log10((c1[w] + 1) / (total + distinct + 1)) for w in t)
        assert got[i][:4] == (i not in train, len(t), sum(c1[w] > 0 for w in t), total)
        assert got[i][4:] == pytest.approx((base, score), rel=1e-9)


def test_katz_with_pairs_seen_once(tables, corpus):
    """Every pair seen in training is discounted and scored itself."""
    tokens = {i: [*SPACED.findall((t or "").translate(LOWER)), None] for i, t in corpus[0]}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c1, c2, after = collections.Counter(), collections.Counter(), collections.Counter()
    for i in train:
        c1.update(tokens[i])
        c2.update(zip(["<s>", *tokens[i]], tokens[i], strict=False))
        after.update(["<s>", *tokens[i][:-1]])
    total, distinct = sum(c1.values()), len(c1)
    few = collections.Counter(c1.values())
    unigrams = katz.Unigrams(np.array([total, distinct, *[few[r] for r in range(1, 7)]]))
    p1 = lambda w: float(unigrams.p(np.array([c1[w]]))[0])
    pairs = collections.Counter(c2.values())
    factors = katz.discounts({r: pairs[r] for r in range(1, 7)})

    def after_(u):
        n, seen = max(after[u], 1), {w: c for (v, w), c in c2.items() if v == u}
        taken = sum(factors[min(c, 6)] * c for c in seen.values()) / n
        scale = n / (n + 1) if 1 - taken < 1 / (n + 1) else 1.0
        rest = (1 - scale * taken) / (1 - sum(p1(w) for w in seen)) if seen else 1.0
        return lambda w: scale * factors[min(seen[w], 6)] * seen[w] / n if w in seen else rest * p1(w)

    assert abs(sum(after_("<s>")(w) for w in c1) + (after_("<s>")("never seen")) - 1) < 1e-9
    got = by_id(katz.report(tables[0], least=1), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, t in tokens.items():
        score = sum(math.log10(after_(u)(w)) for u, w in zip(["<s>", *t], t, strict=False))
        base = sum(math.log10((c1[w] + 1) / (total + distinct + 1)) for w in t)
        assert got[i][:4] == (i not in train, len(t), sum(c1[w] > 0 for w in t), total)
        assert got[i][4:] == pytest.approx((base, score), rel=1e-9)


def test_the_query_of_lm_scoring_counts_pairs_seen_once(spark, tables, tmp_path):
    tables[0].write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(QUERIES["op9_lm_scoring"](spark, str(tmp_path)), "score")
    assert {i: v[0] for i, v in got.items()} == pytest.approx({i: v[0] for i, v in by_id(katz.report(tables[0], least=1), "score").items()}, rel=1e-9)
    assert got[4] == by_id(katz.report(tables[0]), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")[4] != by_id(katz.report(tables[0], least=2), "score")[4]


def test_token_counts(tables, corpus):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {i: (len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in corpus[0]}
    assert by_id(tokencounts.report(tables[0], path), "n_bytes", "n_tokens", "over_limit") == want
    model = tokencounts.Model(path)
    for text in ["", " a▁ b", "a  b c ", "x   ", "é ü\n b\t", "▁", "one two"]:
        assert model.prefixes(text).tolist() == [len(library.encode(text[: k + 1])) for k in range(len(text))]
    short = tokencounts.truncated(tables[0].where("doc_id in (0, 4, 18)"), path, 3)
    assert all(len(library.encode(r.text or "")) <= 3 for r in short.collect())


def test_prefix_counts_of_a_text_without_spaces(spark, monkeypatch):
    """100,000 characters without a space: each prefix follows from shorter ones, and the query's count is the table's last entry."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/\t\n的是不了人我在有他这é東"))
    text = "".join(rng.choice(letters, 100_000).tolist())
    path = tokenizer("piece_bpe_32k.model")
    model = tokencounts.Model(path)
    library, asked = model.model, []
    monkeypatch.setattr(model, "model", type("Counted", (), {"encode": lambda self, x, **k: asked.append(x) or library.encode(x, **k)})())
    got = model.prefixes(text)
    assert len(asked) <= 2 and len(got) == 100_000
    for k in [*range(300), 999, 50_000, 99_999]:
        assert got[k] == len(library.encode(text[: k + 1]))
    assert model.total(text) == got[-1] == len(library.encode(text))


def test_toxicity(spark, tables):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some plain"), F.concat(F.lit("w"), F.col("id") % 50), F.when(F.col("id") % 4 == 0, F.lit("you vile thing"))).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = toxicity.report(docs, labels).toPandas()
    held = got[got.held_out]
    assert len(got) == 400 and ((held.doc_id % 4 == 0) == (held.score > 0.5)).all() and got.score.between(0, 1).all()
    none = toxicity.report(tables[0], labels.limit(0)).toPandas()
    assert (none.score == 0.5).all() and (none.predicted == 0).all()


@pytest.mark.parametrize("run", [substrings.report, suffixes.report, minhash.report, sharding.report, katz.report])
def test_empty_tables(tables, run):
    assert run(tables[0].limit(0)).count() == 0
