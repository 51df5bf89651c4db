"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The classifier is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of their id; their features are worked out
in parallel and one task runs the per-coordinate updates. The L1 term leaves a few thousand weights, which are sent to the
tasks that score every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import ALNUM, LOWER, mix, scan, slices, text_bytes

#: Bound of the labelled rows that the classifier is fitted on.
SAMPLE = 12_000
#: Features are hashed to so many bits.
BITS = 22
THRESHOLD = 0.7

_BIGRAM, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    passes: int = 5


@dataclass
class Weights:
    """Weights that are not zero, by feature in order, and the intercept."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.feature] = self.weight
        return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, pairs of neighbours and pairs with one word between, with the row of each."""
    words = scan(data, offsets, ALNUM, LOWER)
    row, h = words.row, words.hash
    parts, rows = [h], [row]
    for gap, salt in ((1, _BIGRAM), (2, _SKIP)):
        if len(h) > gap:
            ok = row[gap:] == row[:-gap]
            parts.append(mix(h[:-gap] * salt + h[gap:])[ok])
            rows.append(row[:-gap][ok])
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


def sample_of(labels: DataFrame, label: str, usable, id: str = "doc_id", bound: int = SAMPLE) -> DataFrame:
    """At most ``bound`` labelled ids with one label each; rows without id or label are left out, the larger of two labels counts."""
    rows = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & usable)
    one = rows.groupBy(F.col(id).cast("long").alias("id__")).agg(F.max(F.col(label).cast("int")).alias("y__"))
    return one.orderBy(F.xxhash64("id__"), "id__").limit(bound)


def fit(docs: DataFrame, sample: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> Weights:
    """Weights from the sampled rows; all zero, a score of one half, if the sample lacks one of the two classes."""
    chosen = docs.select(F.col(id).cast("long").alias("id__"), F.col(text).alias("text")).join(F.broadcast(sample), "id__")

    def extract(batches):
        for batch in (s for b in batches for s in slices(b, "text")):
            feature, row = features(*text_bytes(batch.column("text")))
            own = np.unique((row << np.int64(BITS)) | feature)
            ends = np.searchsorted(own >> np.int64(BITS), np.arange(1, batch.num_rows))
            sets = [x.astype("<u4").tobytes() for x in np.split(own & ((1 << BITS) - 1), ends)]
            yield pa.RecordBatch.from_arrays([batch.column("id__"), batch.column("y__"), pa.array(sets, pa.binary())], ["id", "y", "features"])

    def learn(table):
        ids, y = table.column("id").to_numpy(), table.column("y").to_numpy()
        sets = [np.frombuffer(f.as_buffer(), "<u4") for f in table.column("features")]
        # Rows of one id come by size and sum of their features, so equal inputs are learned in one order.
        order = np.lexsort(([int(s.sum(dtype=np.uint64)) & 0xFFFFFFFF for s in sets], [len(s) for s in sets], ids))
        order = order[np.random.default_rng(5).permutation(len(order))].tolist()
        index, weight, bias = ftrl([sets[i] for i in order], y[order], settings)
        return pa.Table.from_arrays([pa.array([*index.tolist(), -1], pa.int64()), pa.array([*weight.tolist(), bias], pa.float64())], ["feature", "weight"])

    found = chosen.mapInArrow(extract, "id long, y int, features binary").groupBy().applyInArrow(learn, "feature long, weight double").collect()
    bias = next((r["weight"] for r in found if r["feature"] < 0), 0.0)
    rows = sorted((r["feature"], r["weight"]) for r in found if r["feature"] >= 0)
    return Weights(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float32), bias)


def ftrl(sets: list[np.ndarray], y: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal updates, one document at a time: weights that are not zero, and the intercept."""
    if not len(y) or y.min() == y.max():
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    z, n = np.zeros((1 << BITS) + 1, np.float32), np.zeros((1 << BITS) + 1, np.float32)
    a, b, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2
    last = np.array([1 << BITS])

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((b + np.sqrt(ni)) / a + l2))
        w[-1] = -zi[-1] / ((b + np.sqrt(ni[-1])) / a)  # the intercept is not thinned out
        return w

    for _ in range(settings.passes):
        for own, label in zip(sets, y.tolist(), strict=True):
            at = np.concatenate([own, last])
            zi, ni = z[at].astype(np.float64), n[at].astype(np.float64)
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-min(max(w.sum(), -30.0), 30.0))) - label
            root = np.sqrt(ni + g * g)
            z[at] = zi + g - (root - np.sqrt(ni)) / a * w
            n[at] = ni + g * g
    at = np.append(np.flatnonzero(np.abs(z[:-1]) > l1), 1 << BITS)
    w = weights(z[at].astype(np.float64), n[at].astype(np.float64))
    return at[:-1], w[:-1], float(w[-1])


def scores_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """Score of each row: every feature counts once."""
    feature, row = features(data, offsets)
    known = np.flatnonzero(table[feature])
    own = np.unique((row[known].astype(np.int64) << np.int64(BITS)) | feature[known])
    total = np.bincount(own >> np.int64(BITS), weights=table[own & ((1 << BITS) - 1)], minlength=len(offsets) - 1) + bias
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


_tables: dict[bytes, np.ndarray] = {}


def _scores(batch: pa.RecordBatch, text: str, weights: Weights) -> np.ndarray:
    key = weights.feature.tobytes() + weights.weight.tobytes()
    if key not in _tables:
        _tables.clear()
        _tables[key] = weights.table()
    return scores_of(*text_bytes(batch.column(text)), _tables[key], weights.bias)


def scored(docs: DataFrame, weights: Weights, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (0 to 1); a null text scores as an empty one. A column of that name is replaced."""
    docs = docs.drop(column)

    def score(batches):
        for batch in (s for b in batches for s in slices(b, text)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_scores(batch, text, weights))], [*batch.schema.names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, f"{schema}, `{column}` double")


def clean_rows(docs: DataFrame, weights: Weights, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    def keep(batches):
        for batch in (s for b in batches for s in slices(b, text)):
            yield batch.filter(pa.array(_scores(batch, text, weights) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def fold(id: str = "doc_id"):
    """The fixed fold of a row: crc32 of its id as text, modulo 3; fold 1 is held out."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 3


def report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), bound: int = SAMPLE) -> DataFrame:
    """One row per document: fold, score and prediction. Labels of the held-out fold are never read."""
    weights = fit(docs, sample_of(labels, "toxic", fold() != 1, bound=bound), settings)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(chosen, weights).select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
