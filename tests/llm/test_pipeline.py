"""The pipeline on the small corpus against its stages worked out by hand."""

import collections
import re

import corpus_pipeline
from tapeloom.llm.queries import tokenizer

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})


def near_copies(rows):
    sets, root = {}, {}
    for i, text in rows:
        w = SPACED.findall(text or "")
        sets[i], root[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), i
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return [(i, t) for i, t in rows if root[i] == i]


def without_repeats(rows):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[s : s + 200] for b in raw.values() for s in range(len(b) - 199))
    out = []
    for i, text in rows:
        gone = bytearray(len(raw[i]))
        for s in range(len(raw[i]) - 199):
            if seen[raw[i][s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        kept, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((i, None if text is None else "".join(kept)))
    return out


def test_pipeline(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    rows, items = corpus
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = without_repeats(near_copies(rows))
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    grams = lambda t: set(zip(*[words(t)[k:] for k in range(13)], strict=False))
    # The long item alone is found, in two documents, and fills more than a twentieth of both.
    hit = lambda t: bool(grams(t) & grams(items[0][1]))
    want = {i: t for i, t in left if not hit(t)}
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    lengths = got.groupby("doc_id").length.sum().to_dict()
    expected = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {i: n for i, n in lengths.items() if expected.get(i) != n} == {} and lengths.keys() == expected.keys()
    assert got.groupby("sequence_id").length.sum().max() <= 1024 and len(want) == len(left) - 2
