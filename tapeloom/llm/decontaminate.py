"""Benchmark decontamination: a hash set of benchmark n-grams is broadcast, documents are scanned, hits are verified and cut.

The benchmark is cut into blocks of at most ``BLOCK_BYTES`` of text by a hash of its rows; one block at a time is sent
to the tasks as ordered window hashes plus the windows themselves, and documents pass it without any shuffle. A larger
benchmark therefore costs more passes, not more memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import land
from .scan import ALNUM, LOWER, contains, covered, runs, scan, sequence_hash, slices, text_bytes, window_starts

WINDOW = 13
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = LOWER.tobytes()
#: A document is contaminated if one in so many of its words is hit.
SHARE = 20


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text; none for a null."""
    return _WORD.findall((text or "").encode().translate(_LOWER))


@dataclass
class Index:
    """Windows of one block: per length the ordered hashes, and each window's own items."""

    hashes: dict[int, np.ndarray]
    items: dict[bytes, tuple[str, ...]]


def build_index(rows: list[tuple[str, str | None]], window: int) -> Index:
    found: dict[bytes, set[str]] = {}
    hashes: dict[int, list[np.ndarray]] = {}
    for item, text in rows:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            found.setdefault(b" ".join(words[i : i + n]), set()).add(item)
        if n:
            joined = b" ".join(words)
            scanned = scan(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), ALNUM, LOWER)
            hashes.setdefault(n, []).append(sequence_hash(scanned.hash, n))
    return Index({n: np.unique(np.concatenate(h)) for n, h in hashes.items()}, {k: tuple(sorted(v)) for k, v in found.items()})


def block_count(benchmark: DataFrame, text: str, limit: int) -> int:
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(1, math.ceil(total / limit))


def blocks_of(benchmark: DataFrame, item: str, text: str, window: int, limit: int) -> Iterator[Index]:
    """The benchmark in blocks whose size was looked up first. Rows without an id count as item ``""``."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = block_count(rows, "text", limit)
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block) if count > 1 else rows
        yield build_index([tuple(r) for r in part.collect()], window)


def _hits(batch: pa.RecordBatch, index: Index) -> list[tuple[int, np.ndarray, list[set]]]:
    """Number of words, hit words as start and end bytes, and items, for every row."""
    data, offsets = text_bytes(batch.column("text"))
    words = scan(data, offsets, ALNUM, LOWER)
    hit = np.zeros(len(words), bool)
    items: list[set] = [set() for _ in range(batch.num_rows)]
    for n, known in index.hashes.items():
        hashed = sequence_hash(words.hash, n)
        near = contains(hashed, known) & window_starts(words, n)
        sure = []
        for i in np.flatnonzero(near).tolist():
            window = b" ".join([data[s:e].tobytes() for s, e in zip(words.start[i : i + n], words.end[i : i + n], strict=True)])
            if owners := index.items.get(window.translate(_LOWER)):
                sure.append(i)
                items[int(np.searchsorted(words.first, i, "right")) - 1].update(owners)
        hit |= covered(np.array(sure, np.int64), n, len(words))
    out = []
    for r in range(batch.num_rows):
        lo, hi = words.first[r], words.first[r + 1]
        at = np.flatnonzero(hit[lo:hi]) + lo
        out.append((int(hi - lo), np.stack([words.start[at], words.end[at]], 1) - offsets[r], items[r]))
    return out


#: What is known of a document: its words, hit words as byte places, and the items that occur in it.
FOUND = "id long, text string, n_words long, hits binary, items array<string>"


def scan_documents(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with its hit words (pairs of byte places, ordered) and the items found in it.

    Null texts have no words; an empty benchmark hits nothing; equal items are hit together; rows that repeat are
    judged each by itself. Other columns, whatever their names, are left out.
    """
    state = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"),
                        F.lit(b"").alias("hits"), F.array().cast("array<string>").alias("items"))
    for k, index in enumerate(blocks_of(benchmark, item, item_text, window, block_bytes)):
        def mark(batches, index=index):
            for batch in (s for b in batches for s in slices(b, "text")):
                n_words, hits, items = [], [], []
                for (n, places, found), old, names in zip(_hits(batch, index), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    if old:
                        places = np.unique(np.concatenate([places, np.frombuffer(old, "<i8").reshape(-1, 2)]), axis=0)
                    n_words.append(n)
                    hits.append(places.astype("<i8").tobytes())
                    items.append(sorted(found.union(names)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()),
                                                  pa.array(items, pa.list_(pa.string()))], ["id", "text", "n_words", "hits", "items"])

        if k:
            state = land(state, "hits")
        state = state.mapInArrow(mark, FOUND)
    return state


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: words, hit words, number and digest of the items, and the verdict."""
    found = scan_documents(docs, benchmark, **options)
    n_hit = (F.length("hits") / 16).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def _cut(text: str | None, places: np.ndarray) -> str | None:
    """The text without the hit words, and without what parts two neighbouring ones."""
    if text is None or not len(places):
        return text
    raw, gone = text.encode(), np.zeros(len(text.encode()), bool)
    for s, e in places.tolist():
        gone[s:e] = True
    for (_, e), (s, _) in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        if not _WORD.search(raw[e:s].translate(_LOWER)):
            gone[e:s] = True
    start, end = runs(~gone, np.zeros(0, np.int64))
    return b"".join(raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", **options) -> DataFrame:
    """``id, text`` of what may stay: contaminated documents go (``documents``), or hit words are cut out (``spans``)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    found = scan_documents(docs, benchmark, **options)
    if mode == "documents":
        return found.where(~is_contaminated((F.length("hits") / 16).cast("long"), F.col("n_words"))).select("id", "text")

    def cut(batches):
        for batch in batches:
            places = [np.frombuffer(h, "<i8").reshape(-1, 2) for h in batch.column("hits").to_pylist()]
            texts = [_cut(t, p) for t, p in zip(batch.column("text").to_pylist(), places, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return found.mapInArrow(cut, "id long, text string")


def items_digest(items: list[str]) -> str:
    """What :func:`report` gives for a list of items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def clean_rows(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all their columns, that are not contaminated; nothing is joined or shuffled.

    The benchmark's blocks are applied one after the other. As a verdict counts hit words of all blocks, more than one
    block goes by way of :func:`scan_documents` and a join on a row number.
    """
    if block_count(benchmark, item_text, block_bytes) > 1:
        kept = land(docs.withColumn("row__", F.monotonically_increasing_id()), "docs")
        bad = report(kept.select(F.col("row__"), F.col(text).alias("text")), benchmark, id="row__", item=item, item_text=item_text, window=window, block_bytes=block_bytes)
        return kept.join(bad.where("contaminated").select(F.col("doc_id").alias("row__")), "row__", "left_anti").drop("row__")
    (index,) = blocks_of(benchmark, item, item_text, window, block_bytes)

    def keep(batches):
        for batch in (s for b in batches for s in slices(b, text)):
            probe = pa.RecordBatch.from_arrays([batch.column(text)], ["text"])
            stay = [not (len(p) > 0 and SHARE * len(p) >= n) for n, p, _ in _hits(probe, index)]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
