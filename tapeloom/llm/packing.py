"""Best-fit packing of token sequences by large-item matching, planned on exact counts of lengths.

A sequence takes at most ``capacity`` tokens, so a piece has one of ``capacity`` lengths and the packing of any number of
pieces is a plan over counts of lengths. The driver sees those counts only; each piece finds its place from its length and
its rank among the pieces of that length.

Pieces above a third of the capacity are large: no three share a sequence. They are matched from the largest down, each
with the largest one that still fits. Smaller pieces then go, from the largest down, into the tightest gap that holds them.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import land
from .scan import slices

CAPACITY = 1024
END = 2
#: Words whose ids a task remembers.
REMEMBERED = 250_000
#: New words that are encoded as one text.
TOGETHER = 1_000

_UNEVEN = re.compile(r" (?![^\s\x1c-\x1f])")
_CUT = re.compile(r" (?=[^\s\x1c-\x1f])")


class Encoder:
    """Token ids of whole texts. Every pattern of the byte-level tokenizer takes a space only in front of other characters or
    among spaces, so a text may be cut before each space that another character follows, and pieces are remembered."""

    def __init__(self, path: str):
        # One thread for each task: Spark runs a task on every core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # Bytes of text that each id stands for: a byte-level token has one character for each.
        sizes = {i: len(token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        sizes |= {i: len(token.content.encode()) for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.sizes = np.zeros(max(sizes, default=0) + 1, np.int64)
        self.sizes[list(sizes)] = list(sizes.values())

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The same for words with a space in front: many as one text, whose ids are told apart by the bytes they stand for."""
        runs = ["".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        encoded = self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in encoded]) if runs else np.zeros(0, "<u4")
        ends = np.cumsum([len(w.encode()) for w in words], dtype=np.int64)
        reached = np.cumsum(self.sizes[ids])
        at = np.searchsorted(reached, ends)
        if len(words) and not (len(ids) and reached[-1] == ends[-1] and np.array_equal(reached[at], ends)):
            return self._encode(words)  # some token does not stand for the bytes of its text
        blob, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
        return [blob[a:b] for a, b in zip(cuts, cuts[1:])]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit numbers; pieces that are new are encoded together."""
        cut = [_CUT.split(t) if _UNEVEN.search(t) else t.split(" ") for t in texts]
        heads = self._encode([words.pop(0) for words in cut])
        known = self.known
        room = max(0, REMEMBERED - len(known))
        new = list(set().union(*cut).difference(known))
        made = dict(zip(new, self._encode_words([f" {w}" for w in new]), strict=True))
        known.update(made)
        out = [b"".join([head, *map(known.__getitem__, words)]) for head, words in zip(heads, cut, strict=True)]
        for w in new[room:]:
            del known[w]
        return out

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document, numbered within the task that made them and the length (``part``, ``rank``).

    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity`` of which the first may be shorter. A null
    text counts as empty and still has its end id. ``with_ids`` adds the ids. Land the result before using ranks.
    """
    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        last = np.array([end], "<u4").tobytes()
        for batch in (s for b in batches for s in slices(b, "text")):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).many(texts), strict=True):
                ids += last
                total = len(ids) // 4
                at, k = 0, 0
                while at < total:
                    size = (total % capacity or capacity) if at == 0 else capacity
                    blob = ids[4 * at : 4 * (at + size)]
                    rows.append((doc, k, at, size, zlib.crc32(blob), part, int(seen[size]), blob))
                    seen[size] += 1
                    at, k = at + size, k + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            n = len(names) if with_ids else -1
            yield pa.RecordBatch.from_arrays(columns[:n] if n < 0 else columns, names[:n] if n < 0 else names)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(cut, PIECE + (", ids binary" if with_ids else ""))


@dataclass
class Plan:
    """Row ``i``: pieces of one length and ranks from ``rank`` on go to places ``offset + j * length`` (``j`` below ``per``) of
    the sequences from ``sequence`` on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    per: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << np.int64(44)) | rank.astype(np.int64)
        at = np.searchsorted((self.length << np.int64(44)) | self.rank, key, "right") - 1
        nth = rank - self.rank[at]
        return self.sequence[at] + nth // self.per[at], self.offset[at] + nth % self.per[at] * length


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of so many pieces of each length. Its size depends on ``capacity`` alone."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, deque] = {}
    made = 0

    def put(n: int, count: int, sequence: int, offset: int, per: int = 1) -> None:
        rows.append((n, used[n], sequence, offset, per))
        used[n] += count
        left[n] -= count

    def free(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            gaps.setdefault(gap, deque()).append((sequence, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] and (m < n or m == n and left[m] > 1)), None)
            if mate is None:
                count = left[n]
                put(n, count, made, 0)
                free(capacity - n, made, count)
            elif mate == n:
                count = left[n] // 2
                put(n, 2 * count, made, 0, 2)
                free(capacity - 2 * n, made, count)
            else:
                count = min(left[n], left[mate])
                put(n, count, made, 0)
                put(mate, count, made, n)
                free(capacity - n - mate, made, count)
            made += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                per = capacity // n
                gap, count, sequence = capacity, max(1, left[n] // per), made
                made += count
            else:
                sequence, count = gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap]
            per = min(gap // n, left[n])
            fit = min(count, left[n] // per)
            put(n, fit * per, sequence, capacity - gap, per)
            free(gap - per * n, sequence, fit)
            free(gap, sequence + fit, count - fit)
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, sequences=made)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there; places leave no gap. ``with_ids`` carries the ids along."""
    landed = land(pieces_of(docs, path, capacity, end, with_ids), "pieces")
    counts = landed.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    totals = {r["length"]: r["n"] for r in landed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(totals, capacity)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
                sequence, offset = plan.place(batch.column("length").to_numpy(), rank)
                columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                more = [batch.column("ids")] if with_ids else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset), *more], names + ["ids"] * with_ids)

    return landed.join(before, ["length", "part"]).mapInArrow(place, PLACED + (", ids binary" if with_ids else ""))


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (array) and the documents in order."""
    packed = pack(docs, path, capacity, end, with_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))

    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))

    def unpack(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.frombuffer(b"".join(p["ids"] for p in r["parts"]), "<u4").astype(np.int32) for r in rows]
            docs_ = [[p["doc_id"] for p in r["parts"]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(docs_, pa.list_(pa.int64()))], ["sequence_id", "ids", "doc_ids"])

    return joined.mapInArrow(unpack, "sequence_id long, ids array<int>, doc_ids array<long>")
