"""Quality rules by the log-likelihood ratio of hashed n-grams between trusted texts and the raw corpus.

Words and pairs of words are hashed to ``BUCKETS`` buckets. Counts of all documents give one multinomial, counts of trusted
documents the other; the mean logarithm of their ratio over a document's n-grams, so divided by its length, is compared
with a fixed threshold, the same for every document. Each task counts into arrays of fixed size; blocks of them
are added up by block number, so the exchange has a bounded size per task and no frequent n-gram is a key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import LINES, SPACED, byte_table, covered, mix, row_sums, scan, sequence_hash, slices, text_bytes, window_starts

BUCKET_BITS = 18
#: Added to each count.
SMOOTHING = 0.5
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.2

_BLOCK = 1 << 12
#: Tasks whose blocks are added up together first.
FAN_IN = 512
_PAIR = np.uint64(0x9FB21C651E98DF25)
SYMBOL = ~byte_table(b"#*$%&|<>")
REPEAT, FEWEST, MOST_REPEATED = 8, 20, 30


def ngrams(words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and neighbouring pairs, with the row of each."""
    row, h = words.row, words.hash
    same = row[1:] == row[:-1]
    both = np.concatenate([h, mix(h[:-1] * _PAIR + h[1:])[same]]) if len(h) else h
    return (both >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate([row, row[:-1][same]])


@dataclass
class Ratios:
    """Log ratio of the two multinomials for each bucket."""

    log_ratio: np.ndarray


def fit(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text") -> Ratios:
    """Ratios from all of ``docs`` and those of them whose ids ``trusted`` (one column, each id once) lists.

    Texts meet the trusted ids by one shuffle, whatever the number of ids, and stream past a table of the ids of their partition, unsorted.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("id__"), F.lit(True).alias("trusted")).hint("shuffle_hash")
    marked = docs.select(F.col(id).alias("id__"), F.col(text).alias("text")).join(ids, "id__", "left")

    def count(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        totals = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in (s for b in batches for s in slices(b, "text")):
            bucket, row = ngrams(scan(*text_bytes(batch.column("text")), SPACED))
            totals[0] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
            own = batch.column("trusted").is_valid().to_numpy(zero_copy_only=False)
            totals[1] += np.bincount(bucket[own[row]], minlength=1 << BUCKET_BITS)
        if totals[0].any():
            blocks = range((1 << BUCKET_BITS) // _BLOCK)
            parts = [totals[:, b * _BLOCK : (b + 1) * _BLOCK].astype("<i8").tobytes() for b in blocks]
            columns = [pa.array(list(blocks), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "task", "counts"])

    def add(table):
        total = sum(np.frombuffer(c, "<i8") for c in table.column("counts").to_pylist())
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1) for c in ("block", "task")), pa.array([total.tobytes()], pa.binary())], ["block", "task", "counts"])

    schema = "block int, task int, counts binary"
    # Two steps, so that no group holds a block of every task.
    counted = marked.select("text", "trusted").mapInArrow(count, schema)
    counted = counted.groupBy("block", F.expr(f"task div {FAN_IN}").alias("group")).applyInArrow(add, schema)
    raw, target = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for r in counted.groupBy("block").applyInArrow(add, schema).collect():
        own = slice(r["block"] * _BLOCK, (r["block"] + 1) * _BLOCK)
        raw[own], target[own] = np.frombuffer(r["counts"], "<i8").reshape(2, _BLOCK)
    if not target.any():
        return Ratios(np.zeros(1 << BUCKET_BITS, np.float32))
    p, q = target + SMOOTHING * raw / max(raw.sum(), 1) * len(raw), raw + SMOOTHING * raw / max(raw.sum(), 1) * len(raw)
    seen = raw > 0
    out = np.zeros(1 << BUCKET_BITS)
    out[seen] = np.log(p[seen] / p.sum()) - np.log(q[seen] / q.sum())
    return Ratios(out.astype(np.float32))


def measures(batch: pa.RecordBatch, ratios: Ratios) -> dict[str, np.ndarray]:
    """All figures of every row."""
    data, offsets = text_bytes(batch.column("text"))
    words = scan(data, offsets, SPACED)
    n = len(offsets) - 1
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = heads[words.end] - heads[words.start]
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    lines = scan(data, offsets, LINES)
    filled = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_row, line_hash = lines.row[filled], lines.hash[filled]
    distinct = _distinct(line_row, line_hash, n)
    windows = sequence_hash(words.hash, REPEAT)
    at = np.flatnonzero(window_starts(words, REPEAT))
    row = words.row
    order = np.lexsort((windows[at], row[at]))
    same = (windows[at][order][1:] == windows[at][order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
    often = np.zeros(len(at), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    repeated = covered(at[often], REPEAT, len(words))
    bucket, gram_row = ngrams(words)
    grams = np.bincount(gram_row, minlength=n)
    ratio = np.bincount(gram_row, weights=ratios.log_ratio[bucket], minlength=n)
    return {
        "n_words": words.per_row.astype(np.int64),
        "word_chars": row_sums(chars, words.first),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_row, minlength=n) - distinct,
        "n_repeat_words": row_sums(repeated, words.first),
        "log_ratio": ratio / np.maximum(grams, 1),
    }


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each row."""
    order = np.lexsort((value, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (value[order][1:] != value[order][:-1])
    return np.bincount(row[order][new], minlength=n)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio")


def scored(docs: DataFrame, ratios: Ratios, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the figures, ``base_failed`` and ``kept`` of every document.

    A null or empty text has no words, so it fails the base rules. Repeated rows are judged alike.
    """
    chosen = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def judge(batches):
        for batch in (s for b in batches for s in slices(b, "text")):
            found = measures(batch, ratios)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[c]) for c in FIGURES)], ["doc_id", *FIGURES])

    schema = "doc_id long, " + ", ".join(f"{c} {'double' if c == 'log_ratio' else 'long'}" for c in FIGURES)
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return chosen.mapInArrow(judge, schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))


def trusted_ids(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """All ids labelled as good and nowhere as bad."""
    one = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("id__")).agg(F.min("quality").alias("quality"))
    return one.where("quality = 1").select("id__")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Figures and verdicts of all documents, with the documents labelled as good as trusted texts."""
    return scored(docs, fit(docs, trusted_ids(labels)))
